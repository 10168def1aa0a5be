"""Iterative jobs over edge tables: PageRank, communities, Markov chains.

Each round is a join and an aggregate over edges; lineage is cut with checkpoint() into the shared
folder. What reaches the driver is one number a round.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.store import cut


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 100, directed: bool = False) -> DataFrame:
    """Weighted PageRank of edges (src, dst, weight): node, pagerank, degree. Ranks add up to 1.

    Rank of nodes without outgoing edges is spread evenly. Stops when the total change is below tolerance x nodes.
    """
    e = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    if not directed:
        e = e.union(e.select("dst", "src", "weight"))
    e = e.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    total = e.groupBy("src").agg(F.sum("weight").alias("t"))
    e = cut(e.join(total, "src").select("src", "dst", (F.col("weight") / F.col("t")).alias("w")))
    nodes = cut(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    n = nodes.count()
    if n == 0:
        return nodes.select("node", F.lit(0.0).alias("pagerank"), F.lit(0).cast("long").alias("degree"))
    ends = e.select(F.col("src").alias("node")).distinct().withColumn("out", F.lit(True))
    ranks = nodes.withColumn("r", F.lit(1.0 / n))
    for _ in range(rounds):
        loose = ranks.join(ends, "node", "left_anti").agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("loose"))
        got = e.join(ranks, e["src"] == ranks["node"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("w") * F.col("r")).alias("g"))
        new = nodes.join(got, "node", "left").join(ranks.withColumnRenamed("r", "old"), "node").crossJoin(F.broadcast(loose))
        new = cut(new.select("node", ((1 - damping) / n + damping * (F.coalesce("g", F.lit(0.0)) + F.col("loose") / n)).alias("r"), "old"))
        moved = new.agg(F.sum(F.abs(F.col("r") - F.col("old")))).first()[0]
        ranks = new.select("node", "r")
        if moved < tolerance * n:
            break
    degree = edges.select(F.col("src").alias("node")).union(edges.select("dst")).groupBy("node").agg(F.count("*").alias("degree"))
    return ranks.join(degree, "node").select("node", F.col("r").alias("pagerank"), "degree")


def label_propagation(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """Communities of undirected edges (src, dst, weight): node, community (its least node).

    In each round a node takes the label with most weight among its neighbours and itself, ties to the least;
    stops when no label changes.
    """
    e = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    e = cut(e.union(e.select("dst", "src", "weight")))
    labels = cut(e.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")))
    # a node's own label counts as much as its heaviest edge, so that two nodes don't swap for ever
    own = e.groupBy(F.col("src").alias("node")).agg(F.max("weight").alias("weight"))
    for _ in range(rounds):
        heard = e.join(labels, e["dst"] == labels["node"]).select(F.col("src").alias("node"), "label", "weight")
        heard = heard.union(own.join(labels, "node").select("node", "label", "weight")).groupBy("node", "label").agg(F.sum("weight").alias("w"))
        new = heard.groupBy("node").agg(F.min(F.struct((-F.col("w")).alias("m"), "label"))["label"].alias("label"))
        new = cut(new)
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        labels = new
        if not changed:
            break
    least = labels.groupBy("label").agg(F.min("node").alias("community"))
    return labels.join(least, "label").select("node", "community")


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row: weighted modularity of a partition (node, community) of undirected edges."""
    side = lambda s: communities.select(F.col("node").alias(s), F.col("community").alias(f"c_{s}"))
    e = edges.join(side("src"), "src").join(side("dst"), "dst")
    m = e.agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("c_src") == F.col("c_dst"), F.col("weight")).otherwise(0.0)).alias("inside"))
    ends = e.select(F.col("c_src").alias("c"), "weight").union(e.select("c_dst", "weight")).groupBy("c").agg(F.sum("weight").alias("d"))
    spread = ends.agg(F.sum(F.col("d") * F.col("d")).alias("dd"), F.count("*").alias("n_communities"))
    return m.crossJoin(spread).select((F.col("inside") / F.col("m") - F.col("dd") / (4 * F.col("m") * F.col("m"))).alias("modularity"), "n_communities")


def steady_state(chain: DataFrame, tolerance: float = 1e-9, rounds: int = 1000) -> DataFrame:
    """Long-run share of each state of a chain (src, dst, p): state, share. Rows are scaled to 1; states without a row stay put."""
    total = chain.groupBy("src").agg(F.sum("p").alias("t"))
    e = chain.join(total, "src").where("t > 0").select("src", "dst", (F.col("p") / F.col("t")).alias("p"))
    states = e.select(F.col("src").alias("s")).union(e.select("dst")).distinct()
    stay = states.join(e.select(F.col("src").alias("s")).distinct(), "s", "left_anti")
    e = cut(e.union(stay.select(F.col("s").alias("src"), F.col("s").alias("dst"), F.lit(1.0))))
    n = states.count()
    pi = cut(states.select(F.col("s").alias("state"), F.lit(1.0 / max(n, 1)).alias("share")))
    for _ in range(rounds):
        # the mean of both keeps periodic chains from swinging, with the same limit
        new = e.join(pi, e["src"] == pi["state"]).groupBy(F.col("dst").alias("state")).agg(F.sum(F.col("p") * F.col("share")).alias("x"))
        new = cut(pi.join(new, "state", "left").select("state", F.col("share").alias("old"), (0.5 * F.col("share") + 0.5 * F.coalesce("x", F.lit(0.0))).alias("share")))
        moved = new.agg(F.max(F.abs(F.col("share") - F.col("old")))).first()[0] or 0.0
        pi = new.select("state", "share")
        if moved < tolerance:
            break
    return pi


def absorption(chain: DataFrame, tolerance: float = 1e-9, rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Chance of ending in each absorbing state (src, dst, probability), and expected steps (src, steps), from each other state.

    Absorbing states lead only to themselves. Sums Q^k R and Q^k 1 until the mass still moving is below tolerance.
    """
    moves = chain.where("p > 0")
    out = moves.groupBy("src").agg(F.sum("p").alias("t"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("p")).otherwise(0.0)).alias("own"))
    ends = cut(moves.select(F.col("dst").alias("s")).union(moves.select("src")).distinct().join(out.where("own < t").select(F.col("src").alias("s")), "s", "left_anti"))
    e = cut(moves.join(out, "src").where("own < t").select("src", "dst", (F.col("p") / F.col("t")).alias("p")))
    at = cut(e.select(F.col("src").alias("start"), F.col("src").alias("at")).distinct().withColumn("m", F.lit(1.0)))
    got, steps = [], []
    for k in range(rounds):
        steps.append(at.groupBy("start").agg(F.sum("m").alias("steps")))
        moved = cut(at.join(e, at["at"] == e["src"]).groupBy("start", "dst").agg(F.sum(F.col("m") * F.col("p")).alias("m")))
        got.append(moved.join(ends.withColumnRenamed("s", "dst"), "dst", "left_semi").select("start", "dst", "m"))
        at = moved.join(ends.withColumnRenamed("s", "dst"), "dst", "left_anti").select("start", F.col("dst").alias("at"), "m")
        left = at.agg(F.max("m")).first()[0] or 0.0
        if k % 10 == 9:  # keep the plan short
            got, steps = [cut(_sum(got, ["start", "dst"], "m"))], [cut(_sum(steps, ["start"], "steps"))]
        if left < tolerance:
            break
    return _sum(got, ["start", "dst"], "m").select(F.col("start").alias("src"), "dst", F.col("m").alias("probability")), _sum(steps, ["start"], "steps").select(F.col("start").alias("src"), "steps")


def _sum(parts: list[DataFrame], by: list[str], value: str) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*by).agg(F.sum(value).alias(value))


def markov_substitution(chain: DataFrame, rounds: int = 500, tolerance: float = 1e-6) -> DataFrame:
    """Powers of a row-stochastic matrix (src, dst, p) until they settle. Raises where they don't, as those of a periodic chain."""
    base = cut(chain.groupBy("src", "dst").agg(F.sum("p").alias("p")))
    now = base
    for _ in range(rounds):
        step = now.select("src", F.col("dst").alias("via"), F.col("p").alias("a")).join(base.select(F.col("src").alias("via"), "dst", F.col("p").alias("b")), "via")
        step = cut(step.groupBy("src", "dst").agg(F.sum(F.col("a") * F.col("b")).alias("p")))
        moved = step.join(now.withColumnRenamed("p", "old"), ["src", "dst"], "full").agg(F.max(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0] or 0.0
        now = step
        if moved < tolerance:
            return now
    raise ArithmeticError(f"the chain does not settle in {rounds} steps")
