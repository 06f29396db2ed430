"""Mixing against its SQL, the distribution and the target weights."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import mixing as M
from ledgerlens.llm.queries import ORACLE_SQL, op6_mixing
from ledgerlens.plans.compare import compare, duckdb_connection


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    out = compare("op6", op6_mixing(spark, sf), duckdb_connection(sf), ORACLE_SQL["op6_mixing"])
    assert out.ok and out.types_match, out.detail


@pytest.mark.parametrize("rate", [0.0, 0.3, 2.5, 40.0, 1234.5])
def test_counts_follow_the_distribution(spark, rate):
    n = 4000
    x = spark.range(n).select(M.poisson_copies(F.col("id").cast("string"), F.lit(rate)).alias("k"))
    r = x.agg(F.avg("k").alias("m"), F.var_samp("k").alias("v"),
              F.avg((F.col("k") == 0).cast("double")).alias("z")).first()
    assert abs(r["m"] - rate) < 6 * math.sqrt(rate / n) + 1e-9
    assert abs(r["v"] - rate) < 0.2 * rate + 1e-9
    assert abs(r["z"] - math.exp(-rate)) < 0.05


def test_weights_and_nulls(spark, docs_of):
    rows = [(i, f"t{i}", "en", "big") for i in range(3000)] + [
        (i, f"u{i}", "en", "small") for i in range(1000)] + [(None, None, None, None)] * 5
    docs = docs_of(rows).withColumn("_copies", F.lit(7)).withColumn("rate", F.lit("x"))
    mixed = M.mix(docs, {"big": 1, "small": 3})
    assert mixed.columns == ["doc_id", "text", "lang", "source", "_copies", "copy", "rate", "mix_key"]
    n = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert None not in n  # not among the weights
    assert abs(n["small"] / (n["small"] + n["big"]) - 0.75) < 0.03
    assert abs(n["small"] + n["big"] - 4005) < 300
    assert mixed.filter("_copies <> 7").count() == 0
    copies = mixed.groupBy("doc_id", "source").agg(F.max("copy").alias("m"), F.count("*").alias("n"))
    assert copies.filter("m <> n").count() == 0
    # by their own weight, null is a source like others; equal rows one by one
    own = M.mix(docs_of(rows), exponent=1.0, epochs=6.0).filter("source is null")
    assert own.select("mix_key").distinct().count() == own.count() > 0
    assert M.mix(docs_of([])).count() == 0


def test_reproducible_and_shuffled(spark, docs_of):
    docs = docs_of([(i, f"t{i}", "en", f"s{i % 3}") for i in range(500)])
    one = M.mix(docs).collect()
    two = M.mix(docs.repartition(7)).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))
    assert [r["doc_id"] for r in one] != sorted(r["doc_id"] for r in one)


@pytest.mark.parametrize("seed", range(5))
def test_weights_hold_where_a_third_of_the_rows_are_equal(spark, docs_of, seed):
    rows = [(i, f"t{i}", "en", "b") for i in range(6000)] + [(7, "same", "en", "a")] * 3000
    mixed = M.mix(docs_of(rows).repartition(5), {"a": 1, "b": 1}, seed=seed)
    n = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(n["a"] / (n["a"] + n["b"]) - 0.5) < 0.03
    sizes = [r["count"] for r in mixed.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]
    assert mixed.select("mix_key").distinct().count() == mixed.count()


def test_equal_keys_with_other_columns_and_chunks(spark, docs_of, monkeypatch):
    """Rows that differ in a column the draw does not see are all kept."""
    monkeypatch.setattr(M, "_CHUNK", 3)
    rows = [(1, "x", lang, "s") for lang in ("en", "de", None) for _ in range(7)] + [(2, "y", "en", "s")]
    numbered = M.mix(docs_of(rows), exponent=1.0, epochs=50.0)
    counts = {r["lang"]: r["count"] for r in numbered.filter("doc_id = 1").groupBy("lang").count().collect()}
    assert set(counts) == {"en", "de", None} and all(200 < n < 500 for n in counts.values())
    assert sorted(map(str, numbered.collect())) == sorted(
        map(str, M.mix(docs_of(rows).repartition(3), exponent=1.0, epochs=50.0).collect()))
