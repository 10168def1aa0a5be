import re

from shelfline.llm import url_filter as U


def expected(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), v, h + p) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[2] if fit else None, max(fit)[1] if fit else None


def test_rules_and_score(spark):
    model = U.fit_url_model(spark.createDataFrame(U.LABELLED, "url string, label int"))
    urls = ["http://A.Example.ORG/es/1", "https://example.org/en/12?x", "https://example.org/en/2", "http://org/", "http://org", "http://x.org?q=/a", "ftp://com/de/#a", "http://n.com/fr/x://y", "notorg.com/de/", None, "", "http://myorg/", "http://É.org/Es/", "a://b://c/d", "http://blog.cheap-pills.example.net/de/6890", "http://tionsh.example.net/en/2", "http://h.net/" + "x" * 60000]
    df = spark.createDataFrame([(i, u, "z", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, found int")
    got = {r.page_id: r for r in U.filter_urls(df, spark.createDataFrame(U.RULES, "host string, path string, verdict string"), model).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        f, (host, path, rule, verdict) = got[i].found, expected(u)
        assert (f.host, f.path, f.rule) == (host, path, rule), u
        assert f.verdict == (verdict or ("block" if f.score >= 0.5 else "allow"))
        assert got[i].host == "z"
    assert got[14].found.verdict == "block" and got[15].found.verdict == "allow"
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert U.filter_urls(df, none, model).where("found.rule IS NOT NULL").count() == 0
    assert U.filter_urls(df.limit(0), none, model).count() == 0


def test_fit_separates_its_table(spark):
    df = spark.createDataFrame(U.LABELLED, "url string, label int")
    model = U.fit_url_model(df)
    none = spark.createDataFrame([], "host string, path string, verdict string")
    rows = U.filter_urls(df, none, model).collect()
    assert sum((r.found.verdict == "block") == (r.label == 1) for r in rows) >= 0.95 * len(rows)
    assert U.fit_url_model(df.where("label = 1"))[-1] > 0 and U.fit_url_model(df.limit(0))[-1] < 0
