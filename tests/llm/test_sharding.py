"""Sharding against its law, its inverse and other partitionings."""

import zlib

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import sharding
from ledgerlens.llm.queries import op1_sharding

SF = "/root/testdata/sf0.001"


def placed(df, n=40):
    return sharding.assign_shards(df, n).collect()


def check_law(rows, n_shards):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by.get(s, [])) for s in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 100])
@pytest.mark.parametrize("shards", [1, 3, 40])
def test_counts_and_slots(docs_of, n, shards):
    rows = placed(docs_of([(i, f"text {i}") for i in range(n)]), shards)
    assert len(rows) == n
    check_law(rows, shards)


def test_nulls_repeats_and_extra_columns(docs_of):
    docs = docs_of([(None, None), (None, "a"), (1, ""), (1, ""), (1, ""), (2, "é" * 50)])
    docs = docs.withColumn("shard", F.lit("x")).withColumn("slot", F.lit(None)).withColumn(
        "h1", F.lit(5))
    rows = placed(docs, 3)
    check_law(rows, 3)
    assert sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == sorted(
        (i, len(t.encode()) + 16, zlib.crc32(t.encode()))
        for i, t in [(0, ""), (0, "a"), (1, ""), (1, ""), (1, ""), (2, "é" * 50)])
    whole = sharding.shard_documents(docs, 3)
    assert whole.columns == ["doc_id", "text", "lang", "source", "h1", "shard", "slot"]
    assert whole.count() == 6
    check_law(whole.collect(), 3)


def test_independent_of_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = {(r["doc_id"], r["shard"], r["slot"]) for r in placed(docs)}
    assert one == {(r["doc_id"], r["shard"], r["slot"]) for r in placed(docs.repartition(13))}


@pytest.mark.parametrize("n", [1, 2, 5, 255, 256, 257, 10_007])
def test_permutation_and_inverse(spark, n):
    x = spark.range(n)
    p = x.select("id", sharding.feistel(F.col("id"), F.lit(n)).alias("p"))
    back = p.select("id", "p", sharding.feistel(F.col("p"), F.lit(n), inverse=True).alias("b"))
    rows = back.collect()
    assert sorted(r["p"] for r in rows) == list(range(n))
    # walking back needs at most as many steps as walking there
    assert all(r["b"] == r["id"] for r in rows)
    if n > 1000:
        assert sum(r["p"] == r["id"] for r in rows) < 20


def test_query(spark):
    rows = op1_sharding(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in
            spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    check_law(rows, 40)
    for r in rows:
        data = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 16, zlib.crc32(data), "rows")
