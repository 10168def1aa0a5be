"""Association rules."""

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranks import ranked
from ..functions.store import cut, stored


#: Sets of up to this many products are counted by joins; longer ones are mined by FP-growth.
JOIN_LEN = 3


def frequent_itemsets(tx: DataFrame, min_support: float = 0.01, max_len: int = 3) -> tuple[DataFrame, int]:
    """items (sorted), freq of the sets of at most max_len products, and the number of baskets.

    Up to JOIN_LEN each basket's frequent sets grow by its later frequent products, so only sets whose
    parts are frequent are ever counted.
    """
    items = cut(tx.select("transaction_id", "stockcode").distinct())
    n = items.select("transaction_id").distinct().count()
    often = lambda sets: sets.groupBy("items").agg(F.count("*").alias("freq")).where(F.col("freq") >= min_support * n)
    one = items.select("transaction_id", F.array("stockcode").alias("items"), F.col("stockcode").alias("last"))
    known = often(one)
    if max_len > JOIN_LEN:
        baskets = items.join(known.select(F.col("items")[0].alias("stockcode")), "stockcode", "left_semi").groupBy("transaction_id").agg(F.collect_set("stockcode").alias("items"))
        # baskets without a frequent product are no rows of `baskets`; support stays a share of all baskets, and is
        # asked for half a basket low, as it is multiplied back and rounded up inside
        kept = max(1, baskets.count())
        low = min(1.0, max(0.0, (min_support * n - 0.5) / kept))
        model = FPGrowth(itemsCol="items", minSupport=low, numPartitions=tx.sparkSession.sparkContext.defaultParallelism).fit(baskets)
        sets = model.freqItemsets.where((F.size("items") <= max_len) & (F.col("freq") >= min_support * n))
        return sets.select(F.array_sort("items").alias("items"), "freq"), n
    grown = one.join(known.select("items"), "items", "left_semi")
    single = grown.select("transaction_id", F.col("last").alias("next"))
    out = known
    for _ in range(max_len - 1):
        grown = grown.join(single, "transaction_id").where("next > last").select("transaction_id", F.concat("items", F.array("next")).alias("items"), F.col("next").alias("last"))
        known = often(grown)
        out = out.unionByName(known)
        grown = grown.join(known.select("items"), "items", "left_semi")
    return cut(out), n


def generate_rules(sets: DataFrame, n: int, min_confidence: float = 0.1) -> DataFrame:
    """Every split of an itemset into two parts, with support, confidence, lift, leverage, conviction and Zhang's measure."""
    s = sets.where(F.size("items") >= 2)
    # the subsets of a set of k items as the numbers 1 to 2^k - 2
    split = s.select("items", "freq", F.explode(F.sequence(F.lit(1), (F.pow(F.lit(2), F.size("items")) - 2).cast("int"))).alias("bits"))
    pick = lambda want: F.filter("items", lambda x, i: F.floor(F.col("bits") / F.pow(F.lit(2.0), i)) % 2 == want)
    split = split.select("freq", pick(1).alias("antecedents"), pick(0).alias("consequents"))
    one = lambda c, v: sets.select(F.col("items").alias(c), F.col("freq").alias(v))
    r = split.join(one("antecedents", "fa"), "antecedents").join(one("consequents", "fc"), "consequents")
    a, c, ac = F.col("fa") / n, F.col("fc") / n, F.col("freq") / n
    # quotients of counts, so that a rule exactly at a bound stays there
    confidence, lift = F.col("freq") / F.col("fa"), F.col("freq") * n / (F.col("fa") * F.col("fc"))
    r = r.select("antecedents", "consequents", a.alias("antecedent_support"), c.alias("consequent_support"), ac.alias("support"), confidence.alias("confidence"), lift.alias("lift"), (ac - a * c).alias("leverage"))
    top = F.greatest(F.col("support") * (1 - F.col("antecedent_support")), F.col("antecedent_support") * (F.col("consequent_support") - F.col("support")))
    return r.where(F.col("confidence") >= min_confidence).withColumns({"conviction": F.when(F.col("confidence") < 1, (1 - F.col("consequent_support")) / (1 - F.col("confidence"))).otherwise(F.lit(float("inf"))), "zhangs_metric": F.when(top != 0, F.col("leverage") / top).otherwise(0.0)})


def filter_rules(rules: DataFrame, min_support: float = 0.0, min_confidence: float = 0.0, min_lift: float = 0.0, max_lift: float = 100.0) -> DataFrame:
    return rules.where((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence) & F.col("lift").between(min_lift, max_lift))


def flag_redundant(rules: DataFrame) -> DataFrame:
    """is_redundant: a rule with fewer of the same antecedents and the same consequent is at least as strong."""
    b = rules.select(F.col("consequents").alias("_c"), F.col("antecedents").alias("_a"), F.col("confidence").alias("_k"), F.col("lift").alias("_l"))
    # rules meet on a shared antecedent item, not just on the consequent
    mine = rules.where(F.size("antecedents") >= 2).withColumn("_i", F.explode("antecedents"))
    hit = (F.col("consequents") == F.col("_c")) & (F.col("_i") == F.col("_a")[0]) & (F.size("_a") < F.size("antecedents")) & (F.size(F.array_except("_a", "antecedents")) == 0) & (F.col("_k") >= F.col("confidence")) & (F.col("_l") >= F.col("lift"))
    bad = mine.join(b, hit, "left_semi").select("antecedents", "consequents").distinct().withColumn("is_redundant", F.lit(True))
    return rules.join(bad, ["antecedents", "consequents"], "left").withColumn("is_redundant", F.coalesce("is_redundant", F.lit(False)))


def rules_to_table(rules: DataFrame) -> DataFrame:
    """A readable line per rule."""
    return rules.withColumn("rule", F.concat(F.array_join("antecedents", " + "), F.lit(" -> "), F.array_join("consequents", " + ")))


def benjamini_hochberg(p: DataFrame, key: str, value: str) -> DataFrame:
    """q-values of p-values: the least of p n / rank over this and larger p. Ranks and minima go by ranges of p."""
    raw = ranked(p.select(key, value), value, key).withColumn("_q", F.col(value) * F.col("n") / F.col("rank"))
    later = raw.groupBy("range").agg(F.min("_q").alias("_m"))
    later = later.withColumn("_later", F.min("_m").over(W.orderBy("range").rowsBetween(1, W.unboundedFollowing))).drop("_m")
    own = F.min("_q").over(W.partitionBy("range").orderBy(value, key).rowsBetween(0, W.unboundedFollowing))
    return raw.withColumn("_own", own).join(F.broadcast(later), "range").select(key, value, F.least(F.lit(1.0), F.col("_own"), F.col("_later")).alias("q_value"))


#: Up to this many sets are sent to every task; more are met by a shuffle.
SMALL_SETS = 100_000


def lift_interval(tx: DataFrame, rules: DataFrame, resamples: int = 200, seed: int = 42) -> DataFrame:
    """5 % and 95 % of each rule's lift when customers are drawn again with Poisson(1) weights.

    A customer's weight in a resample is a hash of both, so every rule sees the same draws. Baskets are counted once for each
    set that a rule names, not for each rule, and a set's sums in all resamples come from one pass.
    """
    rules = cut(rules.select("antecedents", "consequents").withColumn("both", F.array_sort(F.array_union("antecedents", "consequents"))))
    parts = rules.select(F.explode(F.array(F.array_sort("antecedents"), F.array_sort("consequents"), "both")).alias("s")).distinct()
    # a basket meets a set by the set's first and last product
    sets = cut(parts.select("s", F.col("s")[0].alias("x"), F.element_at("s", -1).alias("y")))
    if sets.count() <= SMALL_SETS:
        sets = F.broadcast(sets)
    items = tx.select("customer_id", "transaction_id", "stockcode").distinct().groupBy("customer_id", "transaction_id").agg(F.array_sort(F.collect_set("stockcode")).alias("i"))
    draws = range(1, resamples + 1)

    def weight(b: int) -> Column:
        u = F.pmod(F.xxhash64("customer_id", F.lit(b), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        out, total, term = F.lit(0), 0.36787944117144233, 0.36787944117144233
        for k in range(1, 8):
            out = out + F.when(u >= total, 1).otherwise(0)
            term /= k
            total += term
        return out

    baskets = stored(items.withColumn("w", F.array(*[weight(b).cast("byte") for b in draws])))
    sums = lambda w: F.array(*[F.sum(F.get(w, F.lit(b - 1))) for b in draws])
    size = baskets.agg(sums(F.col("w")).alias("n"))
    pairs = F.expr("flatten(transform(i, (x, k) -> transform(slice(i, k + 1, size(i)), y -> struct(x, y))))")
    met = baskets.select("w", "i", F.explode(pairs).alias("p")).select("w", "i", "p.x", "p.y").join(sets, ["x", "y"])
    met = met.where((F.size("s") <= 2) | (F.size(F.array_except("s", "i")) == 0))
    counts = cut(met.groupBy("s").agg(sums(F.col("w")).alias("c")))
    of = lambda key, name: counts.select(F.col("s").alias(key), F.col("c").alias(name))
    t = rules.withColumns({"a": F.array_sort("antecedents"), "c": F.array_sort("consequents")}).join(of("a", "na"), "a").join(of("c", "nc"), "c").join(of("both", "nac"), "both", "left").crossJoin(F.broadcast(size))
    t = t.select("antecedents", "consequents", F.explode(F.arrays_zip("n", "na", "nc", F.coalesce("nac", F.transform("n", lambda _: F.lit(0).cast("long"))).alias("nac"))).alias("d")).select("antecedents", "consequents", "d.*")
    lift = t.where("na > 0 AND nc > 0").withColumn("lift", F.col("nac") * F.col("n") / (F.col("na") * F.col("nc")))
    return lift.groupBy("antecedents", "consequents").agg(F.percentile("lift", F.array(F.lit(0.05), F.lit(0.95))).alias("q")).select("antecedents", "consequents", F.col("q")[0].alias("lift_ci_lower"), F.col("q")[1].alias("lift_ci_upper"))
