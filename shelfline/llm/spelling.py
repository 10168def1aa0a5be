"""Spelling variants: words one edit apart, found by walking tries level by level.

States (word, at, node) say how much of a word has been read and which node of a trie was reached.
One level joins them with the edges of that depth. A state without an edit stands on the word's own
prefix and may replace or delete its next letter; one with an edit must read the rest as it is, and
is a neighbour where the word and a node that ends a word meet. Edits in the second half of a word are made in the trie of
words, those in the first half in the trie of reversed words, so that no edit is made near a root, where nearly every letter has an edge.
"""

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, shared_dir
from .warc import remove

#: Letters walked one level at a time; what is longer is closed by one join on hashes.
LEVELS = 32
#: Shares of the states of one node, each with a copy of its edges.
SALTS = 8
#: Edges of a level that are broadcast at most; two levels of 90 letters have 8,190.
BROADCAST_EDGES = 10_000
#: Code points of a word and occurrences, at least.
SIZE, OFTEN = 5, 3
#: A form has so many times its word's occurrences, at least.
TIMES = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "[A-Za-zÀ-ÿ]"
PRIME, BASE = (1 << 61) - 1, 1_000_003


def letter(at: Column) -> Column:
    """The letter of `word` at a place, from 0; empty behind its end."""
    return F.substring(F.col("word"), at + 1, F.lit(1))


def both_ways(words: DataFrame) -> DataFrame:
    """Words as they are (back false) and reversed."""
    every = words.select("word", "n", F.lit(False).alias("back"))
    return every.union(words.select(F.reverse("word"), "n", F.lit(True)))


def trie(words: DataFrame) -> DataFrame:
    """back, depth, node (the prefix), edges (letter, n of the word that ends there or null), own_n: a row per node."""
    steps = words.select("back", "word", "n", F.length("word").alias("size"), F.explode(F.sequence(F.lit(0), F.length("word"))).alias("depth"))
    on = F.col("depth") < F.col("size")
    steps = steps.select("back", "depth", F.substring("word", F.lit(1), F.col("depth")).alias("node"), F.when(on, letter(F.col("depth"))).alias("letter"), F.when(F.col("depth") + on.cast("int") == F.col("size"), F.col("n")).alias("n"))
    steps = steps.groupBy("back", "depth", "node", "letter").agg(F.max("n").alias("n"))
    edge = F.when(F.col("letter").isNotNull(), F.struct("letter", "n"))
    return steps.groupBy("back", "depth", "node").agg(F.collect_list(edge).alias("edges"), F.max(F.when(F.col("letter").isNull(), F.col("n"))).alias("own_n"))


def step(states: DataFrame, level: DataFrame, few: bool) -> DataFrame:
    """The states one edge further, those that have read their word only where a word ends."""
    if few:
        met = states.join(F.broadcast(level), ["back", "node"])
    else:
        salt = F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int")
        met = states.withColumn("salt", salt).join(level.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))), ["back", "node", "salt"])
    to = lambda at: lambda e: F.struct(at.alias("at"), F.concat("node", e["letter"]).alias("node"), e["n"].alias("other_n"))
    at, size = F.col("at"), F.length("word")
    here, after = letter(at), letter(at + 1)
    follow = F.transform(F.filter("edges", lambda e: e["letter"] == here), to(at + 1))
    # of two words that differ by one letter the one with the larger letter finds the other; an insertion is the other's deletion
    replace = F.transform(F.filter("edges", lambda e: e["letter"] < here), to(at + 1))
    # of equal letters in a row the last to be read is deleted; read backwards only if the whole row is in the word's first half
    row = at + 1 - F.length(F.rtrim(F.substring("word", F.lit(1), at + 1), here))
    mine = ~F.col("back") | (size - at + row - 2 < F.floor(size / 2))
    delete = F.transform(F.filter("edges", lambda e: (e["letter"] == after) & (here != after) & mine), to(at + 2))
    last = F.when((at + 1 == size) & F.col("own_n").isNotNull() & mine, F.array(F.struct((at + 1).alias("at"), F.col("node").alias("node"), F.col("own_n").alias("other_n"))))
    moves = F.when(F.col("edited"), follow).otherwise(F.concat(replace, delete, F.coalesce(last, F.slice(follow, 1, 0))))
    out = met.select("back", "word", "n", F.inline(moves))
    return out.where((F.col("at") < size) | F.col("other_n").isNotNull()).withColumn("done", F.col("at") == size)


STATES = "back boolean, word string, n long, at int, node string, other_n long, done boolean, level int"


def tail_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For words of LEVELS letters and more: a hash of the whole, and of longer ones for each place hashes with that letter replaced or deleted."""
    for batch in batches:
        for word, own in zip(batch["word"], batch["code"], strict=True):
            code = [ord(c) for c in word]
            size, before, power = len(code), [0], [1]
            for c in code:
                before.append((before[-1] * BASE + c + 1) % PRIME)
                power.append(power[-1] * BASE % PRIME)
            rows = [("whole", size, -1, before[-1])]
            for p in range(size if size > LEVELS else 0):
                rest = power[size - 1 - p]
                rows.append(("replaced", size, p, (before[-1] - (code[p] + 1) * rest) % PRIME))
                if p + 1 == size or code[p] != code[p + 1]:
                    rows.append(("deleted", size - 1, -1, (before[p] * rest + before[-1] - before[p + 1] * rest) % PRIME))
            for i in range(0, len(rows), 10_000):
                yield pd.DataFrame(rows[i : i + 10_000], columns=["kind", "size", "place", "key"]).assign(code=own)


def tails(words: DataFrame) -> DataFrame:
    """Pairs of words one edit apart, the first (the longer) of more than LEVELS letters. Equal hashes propose them, the words decide."""
    long = words.where(F.length("word") >= LEVELS).withColumn("code", F.xxhash64("word"))
    keys = cut(long.select("word", "code").mapInPandas(tail_keys, "kind string, size long, place long, key long, code long"))
    kind = lambda k, name: keys.where(F.col("kind") == k).select("size", "place", "key", F.col("code").alias(name))
    cols = ["size", "place", "key"]
    # a key of "replaced" is shared by at most one word per letter of the alphabet
    met = kind("replaced", "a").join(kind("replaced", "b"), cols).where("a < b").union(kind("deleted", "a").join(kind("whole", "b"), cols)).select("a", "b").distinct()
    side = lambda k, w, n: long.select(F.col("code").alias(k), F.col("word").alias(w), F.col("n").alias(n))
    both = met.join(side("a", "word", "n"), "a").join(side("b", "other", "other_n"), "b")
    return both.where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n")


def near_words(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: each pair of different words that are one inserted, deleted or replaced code point apart, once.

    words has word and n, each word once, without nulls.
    """
    spark = words.sparkSession
    longest = words.agg(F.max(F.length("word"))).first()[0]
    if not longest:
        return words.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n")).limit(0)
    path = f"{shared_dir(spark)}/trie-{uuid.uuid4().hex}"
    short = both_ways(words.where(F.length("word") <= LEVELS))
    trie(short).repartition("depth", F.pmod(F.xxhash64("back", "node"), F.lit(SALTS))).write.partitionBy("depth").parquet(f"{path}/edges")
    edges = spark.read.schema("back boolean, node string, edges array<struct<letter: string, n: long>>, own_n long, depth int").parquet(f"{path}/edges")
    size = dict(edges.groupBy("depth").agg(F.sum(F.size("edges"))).collect())  # a row per depth
    first = F.when(F.col("back"), F.length("word") - F.floor(F.length("word") / 2)).otherwise(F.floor(F.length("word") / 2))
    states = spark.read.schema(STATES)
    for depth in range(min(longest, LEVELS)):
        level, few = edges.where(F.col("depth") == depth).drop("depth"), size.get(depth, 0) <= BROADCAST_EDGES
        own = short.where((F.length("word") > depth) & (first <= depth)).select("back", "word", "n", F.lit(depth).alias("at"), F.substring("word", 1, depth).alias("node"), F.lit(False).alias("edited"))
        # a node with one edge that ends no word offers no edit
        now = step(own, level.where((F.size("edges") > 1) | F.col("own_n").isNotNull()), few)
        if depth:
            open_ = states.parquet(f"{path}/states").where((F.col("level") == depth - 1) & ~F.col("done"))
            now = now.unionByName(step(open_.drop("other_n", "done", "level").withColumn("edited", F.lit(True)), level, few))
        now.withColumn("level", F.lit(depth)).write.mode("append").partitionBy("level", "done").parquet(f"{path}/states")
    turned = lambda c: F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c))
    out = states.parquet(f"{path}/states").where("done").select(turned("word").alias("word"), "n", turned("node").alias("other"), "other_n")
    if longest > LEVELS:
        out = out.unionByName(tails(words))
    out = cut(out)
    remove(spark, path)
    return out


def group_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n: each word with its near word of largest n, if that has `times` its own, and where forms lead.

    words has word and n. Of near words of equal n the smallest in code-point order counts. Null words are
    left out, a null n counts 0, rows of one word add up, other columns are not read. Words are compared
    as they stand, whatever their length or letters. From one form to the next n grows at least
    `times`-fold (words without occurrences have no form), so that roots are found in few doublings.
    """
    words = cut(words.where("word IS NOT NULL").groupBy("word").agg(F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("n")))
    pairs = near_words(words)
    both = pairs.select("word", F.col("other").alias("to"), F.col("other_n").alias("to_n")).union(pairs.select("other", "word", "n"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("to_n")).alias("minus"), "to")).alias("best"))
    good = (-F.col("best.minus") >= times * F.col("n")) & (-F.col("best.minus") > F.col("n"))
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.to")).alias("form"), F.when(good, -F.col("best.minus")).alias("form_n"))
    rows = cut(rows)
    hops = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = cut(hops.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        hops = further.drop("moved")
        if further.where("moved").isEmpty():
            break
    return rows.join(hops, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def runs(docs: DataFrame, least: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, run: maximal runs of letters of whole texts, A to Z lower-cased, of `least` code points or more. Null texts have none."""
    found = docs.select(F.col(doc_id).alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))).alias("run"))
    return found.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))


def misspelt(found: DataFrame, one_in: int = 97) -> DataFrame:
    """Runs as words: one of `one_in`, chosen by a checksum of id and run, loses a letter. A null id counts as empty."""
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    rest = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return found.withColumn("h", h).select(F.when(F.col("h") % one_in == 0, rest).otherwise(F.col("run")).alias("word"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    words = misspelt(runs(docs)).where(F.length("word") >= SIZE).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    return group_variants(words)


OP13_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents
), hashed AS (
  SELECT run, count(*) AS k, xor(4294967295, any_value(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(id || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))) AS h
  FROM runs, bits WHERE length(run) >= 5 GROUP BY id, run
), words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n
  FROM (SELECT k, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), cuts AS (
  SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS p FROM words)
), pairs AS (
  SELECT a.word AS a, a.n AS an, b.word AS b, b.n AS bn FROM cuts a JOIN cuts b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, c.n, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, w.n, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word
), best AS (
  SELECT a AS word, count(*) AS n_near, first(b ORDER BY bn DESC, b) AS b, max(bn) AS bn FROM pairs GROUP BY a
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 2 * n THEN b END AS form, CASE WHEN bn >= 2 * n THEN bn END AS form_n
  FROM words w LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root FROM forms
  UNION SELECT walk.word, form FROM walk JOIN forms ON walk.root = forms.word WHERE form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms
JOIN (SELECT walk.word, walk.root FROM walk JOIN forms f ON walk.root = f.word WHERE f.form IS NULL) USING (word)
"""
