"""URL filter: rules and parsing in plain Python, the models by counting."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from ledgerlens.llm import urlfilter as U
from ledgerlens.llm.queries import op3_url_filter

SF = "/root/testdata/sf0.01"


def parse(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def rule(host, path, rules=U.RULES):
    best = None
    for verdict, text in rules:
        h, _, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            if best is None or len(text) > len(best[1]):
                best = (verdict, text)
    return best


URLS = [None, "", "   ", "no scheme", "http://", "://x.org/", "HTTP://A.Example.ORG/en/1?x#y",
        "http://example.org/en/12", "http://org/", "http://org", "http://sub.org?x", "http://notorg/",
        "http://xorg/", "http://a.com/de/x", "http://a.com/fr/", "http://a.com/fr", "http://com/de/",
        "http://a.net/p#://b.org/", "http://É.org/ä", "http://a.org:80/", "http://a.com/DE/x",
        "http://example.org/es/", "http://example.org/es", "http://a.net/" + "x" * 20_000,
        "http://a.net/1", "http://a.net/1"]


def test_hosts_paths_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn(
        "host", F.lit("mine")).withColumn("form", F.lit(1))
    rows = {r["page_id"]: r for r in U.judge_urls(df).collect()}
    assert len(rows) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = parse(url)
        best = rule(host, path)
        r = rows[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, best[1] if best else None), url
        if best:
            assert r["verdict"] == best[0] and r["score"] is None
        else:
            assert r["verdict"] in ("allow", "block")
    assert rows[0]["verdict"] == rows[1]["verdict"] == rows[2]["verdict"] == "block"


def model_scores(examples, texts, order=U.ORDER, beta=U.SMOOTHING):
    counts = [Counter(), Counter()]
    totals = [Counter(), Counter()]
    for form, accepted, weight in examples:
        s = "\x02" * order + form + "\x03"
        for end in range(order, len(s)):
            for n in range(order + 1):
                counts[accepted][s[end - n:end + 1]] += weight
                totals[accepted][s[end - n:end], n] += weight
    out = {}
    for form in texts:
        s, total = "\x02" * order + form + "\x03", 0.0
        for end in range(order, len(s)):
            p = [1 / 256, 1 / 256]
            for n in range(order + 1):
                for k in (0, 1):
                    p[k] = (counts[k][s[end - n:end + 1]] + beta * p[k]) / (totals[k][s[end - n:end], n] + beta)
            total += math.log(p[1]) - math.log(p[0])
        out[form] = total / (len(form) + 1)
    return out


def test_scores_match_counting(spark):
    examples = [("a.org/x", True, 3), ("b.org/yé", True, 1), ("spam.com/x", False, 2), ("a.com/", False, 1)]
    texts = ["a.org/x", "new.net/é", "", "zzzz" * 100]
    model = U.train(spark.createDataFrame(examples, "form string, accepted boolean, weight long"))
    got = {r["form"]: r["score"] for r in U.score(
        spark.createDataFrame([(t,) for t in texts], "form string"), model).collect()}
    want = model_scores(examples, texts)
    assert set(got) == set(want)
    assert all(abs(got[t] - want[t]) < 1e-9 for t in texts)


def test_threshold(spark):
    rows = [(s / 10, s > 4, 1) for s in range(10)] + [(0.1, True, 1)]
    t = U.calibrate(spark.createDataFrame(rows, "score double, accepted boolean, weight long"))
    assert 0.4 < t <= 0.5
    assert U.calibrate(spark.createDataFrame([(1.0, True, 1)], "score double, accepted boolean, weight long")) == 0


def test_no_examples_and_no_rows(spark):
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    row = U.judge_urls(df).first()
    assert (row["rule"], row["score"], row["verdict"]) == (None, 0.0, "allow")
    assert U.judge_urls(df.limit(0)).count() == 0


def test_query_follows_the_rules(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    whole = {r["page_id"]: r for r in op3_url_filter(spark, SF).collect()}
    assert len(whole) == pages.count()
    for r in pages.collect():
        host, path = parse(r["url"])
        best = rule(host, path)
        got = whole[r["page_id"]]
        assert (got["host"], got["path"], got["rule"]) == (host, path, best[1] if best else None)
        assert best is None or got["verdict"] == best[0]


def test_models_judge_urls_that_they_have_not_seen(spark):
    """Half of the URLs that rules decide are learned from; the models give
    the others the verdict of their rule, mostly."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url").distinct()
    host, path = U.host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"),
                          U.model_text(F.col("url")).alias("form"))
    _, decision = U.fitting_rule(F.col("host"), F.col("path"), U.RULES)
    known = parsed.withColumn("decision", decision).filter("decision is not null").groupBy("form").agg(
        F.first("decision").alias("decision"), F.count(F.lit(1)).alias("weight"))
    known = known.select("form", (F.col("decision") == "allow").alias("accepted"), "weight",
                         F.pmod(F.xxhash64("form"), F.lit(4)).alias("part")).cache()
    model = U.train(known.filter("part < 2"))
    scores = U.score(known.filter("part >= 2"), model)
    threshold = U.calibrate(known.filter("part = 2").join(scores, "form"))
    seen = known.filter("part = 3").join(scores, "form").groupBy("accepted").agg(
        F.avg(((F.col("score") >= threshold) == F.col("accepted")).cast("double")).alias("right"),
        F.count(F.lit(1)).alias("n")).collect()
    known.unpersist()
    assert len(seen) == 2 and all(r["right"] >= 0.8 and r["n"] > 10 for r in seen), seen
