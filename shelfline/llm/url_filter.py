"""URL filter: rules on hosts and paths, else logistic regression on hashed character n-grams.

DataFrame and MLlib operations only. The regression is fitted on a small table of labelled
URLs; its BUCKETS coefficients then score every URL in one expression.
"""

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1024
GRAMS = (3, 4)
REGULARISATION = 0.02
#: Hosts with rules that are broadcast at most; more of them are joined by shuffle.
BROADCAST_HOSTS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: URLs to learn from, 1 for those to block.
LABELLED = [
    ("http://cheap-meds.biz/buy/pills-online", 1),
    ("http://discount-pills.example/order?drug=1", 1),
    ("http://best-cheap-pills.info/no-prescription", 1),
    ("http://pills-online-store.biz/cheap/viagra", 1),
    ("http://casino-bonus.win/free-spins", 1),
    ("http://online-casino-jackpot.club/slots/bonus", 1),
    ("http://poker-and-casino.bet/free-bonus", 1),
    ("http://free-slots-casino.top/win", 1),
    ("http://xxx-videos.adult/free/porn", 1),
    ("http://hot-adult-dating.xyz/sex-chat", 1),
    ("http://porn-tube.xxx/free-porn", 1),
    ("http://free-sex-cams.adult/live", 1),
    ("http://warez-download.to/crack/keygen", 1),
    ("http://free-crack-keygen.ru/serial", 1),
    ("http://torrent-warez.cc/full-crack", 1),
    ("http://payday-loans-fast.biz/apply-now", 1),
    ("http://instant-payday-loan.info/cash", 1),
    ("http://replica-watches-cheap.shop/rolex", 1),
    ("http://cheap-replica-bags.shop/sale", 1),
    ("http://click-ads-tracker.net/ads/click?id=1", 1),
    ("http://spam-offers.click/win-prize", 1),
    ("http://lose-weight-fast-pills.biz/miracle", 1),
    ("https://www.cityuniversity.edu/library/opening-hours", 0),
    ("https://docs.framework.dev/en/guide/install.html", 0),
    ("https://news.daily-herald.com/en/2021/politics", 0),
    ("https://blog.gardeners.net/de/3301.html", 0),
    ("https://www.museum.org/es/collection/", 0),
    ("https://m.weather.net/fr/forecast?page=2", 0),
    ("http://recipes.kitchen.com/en/48211", 0),
    ("https://wiki.history.org/en/article_120", 0),
    ("https://www.citycouncil.gov/services/permits", 0),
    ("https://blog.travellers.com/es/9921/", 0),
    ("https://shop.bookstore.com/en/7731#top", 0),
    ("http://forum.cyclists.net/en/thread/5512.html", 0),
    ("https://science.journal.org/fr/abstract/61", 0),
    ("https://www.hospital.org/en/departments", 0),
    ("http://thernon.net/de/2210", 0),
    ("https://ortheating.com/en/31440.html", 0),
    ("http://m.ingstone.org/es/8123?utm_source=feed", 0),
    ("https://www.hertion.net/fr/5520/", 0),
    ("https://www.school.edu/en/courses/algebra", 0),
    ("https://sports.results.com/en/league/table", 0),
    ("https://parliament.gov/debates/2019", 0),
    ("https://help.software.com/en/kb/404.html", 0),
]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and for URLs without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def gram_buckets(host: Column, path: Column) -> Column:
    """Buckets of the n-grams of host and path, digits taken as 0, each place marked."""
    places = [F.concat(F.lit("^"), host, F.lit("$")), F.concat(F.lit("/"), F.lower(path))]

    def grams(place: int, p: Column, n: int) -> Column:
        # the one-element array binds the characters, so that they are split once and not for each gram
        each = lambda cs: F.transform(F.sequence(F.lit(1), F.greatest(F.size(cs) - (n - 1), F.lit(1))), lambda i: F.pmod(F.xxhash64(F.lit(place), F.array_join(F.slice(cs, i, F.lit(n)), "")), F.lit(BUCKETS)).cast("int"))
        return F.get(F.transform(F.array(F.split(p, "")), each), 0)

    return F.concat(*[grams(k, F.regexp_replace(p, "[0-9]", "0"), n) for k, p in enumerate(places) for n in GRAMS])


def fit_url_model(labelled: DataFrame, url: str = "url", label: str = "label") -> list[float]:
    """BUCKETS weights and the bias, from a small table; rows with a null label are left out.

    A table with one class only gives a model that always answers that class.
    """
    rows = labelled.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("label"), gram_buckets(host_of(F.col(url)), path_of(F.col(url))).alias("g"))
    kinds = [r[0] for r in rows.select("label").distinct().collect()]
    if len(kinds) < 2:
        return [0.0] * BUCKETS + [8.0 if kinds == [1.0] else -8.0]
    share = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.size(F.filter("g", lambda x: x == b)) / F.sqrt(F.size("g").cast("double")))
    data = rows.select("label", array_to_vector(share).alias("features")).coalesce(1).cache()
    model = LogisticRegression(regParam=REGULARISATION, maxIter=60).fit(data)
    data.unpersist()
    return [*model.coefficients.toArray().tolist(), model.intercept]


def url_score(model: list[float], host: Column, path: Column) -> Column:
    """Probability that a URL is to be blocked."""
    weight = F.array(*[F.lit(float(w)) for w in model[:-1]])
    total = lambda g: F.aggregate(g, F.lit(0.0), lambda t, b: t + F.get(weight, b), lambda t: t / F.sqrt(F.size(g).cast("double")))
    return 1 / (1 + F.exp(-F.get(F.transform(F.array(gram_buckets(host, path)), total), 0) - F.lit(model[-1])))


def filter_urls(pages: DataFrame, rules: DataFrame, model: list[float], url: str = "url", threshold: float = 0.5) -> DataFrame:
    """The rows of pages, whole, with a column `found`: struct (host, path, rule, verdict, score), in place of one of that name.

    rules has host, path and verdict (allow or block). A rule fits its host and all subdomains if the
    path starts with the rule's; the longest fitting rule wins, of equal ones block. Without
    one the rule is null and the verdict is block from a score of `threshold` on. Null URLs and those without :// have
    an empty host and path.
    """
    by_host = rules.groupBy("host").agg(F.collect_set(F.struct(F.length(F.concat("host", "path")).alias("size"), F.col("verdict"), F.col("path"), F.concat("host", "path").alias("text"))).alias("own"))
    size = by_host.agg(F.count("*"), F.max(F.size(F.split("host", r"\.")))).first()
    near = F.broadcast if size[0] <= BROADCAST_HOSTS else (lambda df: df)
    kept = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != "found"]).alias("_row")
    out = pages.select(kept, host_of(F.col(url)).alias("_host"), path_of(F.col(url)).alias("_path"))
    own = []
    for labels in range(1, (size[1] or 0) + 1):
        suffix = F.substring_index("_host", ".", -labels)
        exact = F.when(F.size(F.split("_host", r"\.")) >= labels, suffix)
        side = by_host.select(F.col("host").alias(f"_h{labels}"), F.col("own").alias(f"_o{labels}"))
        out = out.join(near(side), exact == F.col(f"_h{labels}"), "left")
        own.append(F.coalesce(F.col(f"_o{labels}"), F.array().cast(by_host.schema["own"].dataType)))
    fitting = F.filter(F.concat(*own), lambda r: F.col("_path").startswith(r["path"])) if own else F.array().cast(by_host.schema["own"].dataType)
    best = F.array_max(F.transform(fitting, lambda r: F.struct(r["size"].alias("size"), r["verdict"].alias("verdict"), r["text"].alias("text"))))
    scored = out.select("_row", "_host", "_path", best.alias("_best"), url_score(model, F.col("_host"), F.col("_path")).alias("_score"))
    verdict = F.coalesce(F.col("_best.verdict"), F.when(F.col("_score") >= threshold, "block").otherwise("allow"))
    return scored.select("_row", F.struct(F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_best.text").alias("rule"), verdict.alias("verdict"), F.col("_score").alias("score")).alias("found")).select("_row.*", "found")


#: The query's rules, as host, path and verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit_url_model(spark.createDataFrame(LABELLED, "url string, label int"))
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, rules, model).select("page_id", "found.host", "found.path", "found.rule", "found.verdict", "found.score")
