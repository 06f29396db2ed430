"""The pipeline: its form, each stage on its own input, and without llm."""

import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as P
from ledgerlens.llm import decontamination, queries
from ledgerlens.llm.common import table
from tests.llm import test_decontamination, test_minhash

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(P.__file__))
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output, written and read again."""
    docs, out = table(spark, SF, "documents"), {}
    for name, f in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        f(spark, docs, SF).write.parquet(path)
        out[name] = docs, (docs := spark.read.parquet(path))
    return out


def rows(df):
    return sorted(map(str, df.select(*COLUMNS).collect()))


def test_form(stages):
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix_sources", "shard"]
    for name, (_, after) in stages.items():
        assert after.columns == COLUMNS + (["shard", "slot"] if name == "shard" else [])


def test_language_id_keeps_clean_documents(stages):
    before, after = stages["language_id"]
    assert set(rows(after)) <= set(rows(before))
    assert after.count() >= 0.99 * before.filter("length(text) > 50").count()


def test_near_dedup_keeps_one_of_each_group(stages):
    before, after = stages["near_dedup"]
    want = {d for d, _, c, kept in test_minhash.brute(
        [(r["doc_id"], r["text"]) for r in before.collect()]) if kept}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(want)


def test_decontamination_by_the_rule(spark, stages):
    before, after = stages["decontaminate"]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    verdict = test_decontamination.brute([(r["doc_id"], r["text"]) for r in before.collect()], items)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(v[0] for v in verdict if not v[-1])


def test_mixing_repeats_whole_rows(stages):
    before, after = stages["mix_sources"]
    assert set(rows(after)) <= set(rows(before))
    assert 0.8 < after.count() / before.count() < 1.2


def test_sharding_places_every_row(stages):
    before, after = stages["shard"]
    assert rows(after) == rows(before)
    sizes = [r["count"] for r in after.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    assert after.select("shard", "slot").distinct().count() == after.count()


def test_edge_rows_go_through(spark, docs_of, tmp_path):
    """Nulls, empty and repeated rows, columns with the operators' names."""
    table(spark, SF, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = docs_of([(None, None), (1, ""), (2, "the cat " * 30), (2, "the cat " * 30), (None, "the cat"),
                    (3, "el gato y el perro " * 9)] + [(i, f"word{i} of text", "en", "s") for i in range(9, 30)])
    for c in ("shard", "rejected", "node", "copy", "n_hit", "score"):
        docs = docs.withColumn(c, F.lit("x"))
    for name, f in P.STAGES:
        out = f(spark, docs, str(tmp_path))
        assert set(docs.columns) <= set(out.columns)
        assert f(spark, docs.limit(0), str(tmp_path)).count() == 0
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.count() > 0


def test_run(spark):
    assert P.run(spark, SF).columns == [*COLUMNS, "shard", "slot"]
    assert P.ORACLE_SQL is None


def test_registered():
    names = set(entry.queries())
    assert {"pipeline", *queries.QUERIES} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(entry.oracle_sql()) <= names


@pytest.mark.parametrize("emptied", [False, True])
def test_library_works_without_the_subpackage(tmp_path, emptied):
    """Also if a folder without modules is left."""
    for name in ("ledgerlens", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    if emptied:
        (tmp_path / "ledgerlens/llm/__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op1') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True,
                         env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert out.stdout.split()[-2:] == ["55", "False"], out.stderr


def test_nothing_else_imports_the_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "ledgerlens")):
        if os.sep + "llm" in folder:
            continue
        for name in files:
            if name.endswith(".py"):
                text = open(os.path.join(folder, name)).read()
                assert "import" not in text or "ledgerlens.llm" not in text, name


def test_benchmark_in_blocks_is_the_same(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    a, _ = decontamination.occurrences(docs, bench)
    b, _ = decontamination.occurrences(docs, bench, block=100)
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
