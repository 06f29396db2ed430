"""Staged tables: fresh, complete, reused; and folders of intermediates."""

import datetime as dt
import os
import shutil
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import materialize as MT
from ledgerlens.plans import catalog as CAT
from ledgerlens.plans import reports as R
from ledgerlens.plans.catalog import REPORTS
from ledgerlens.sources import schemas
from ledgerlens.sources import staging as S
from ledgerlens.sources.tables import from_frames

SF = "/root/testdata/sf0.001"
NAMES = ("orders", "customer", "nation", "region", "lineitem", "part")


@pytest.fixture
def source(tmp_path):
    folder = tmp_path / "warehouse"
    folder.mkdir()
    for n in NAMES:
        shutil.copy(f"{SF}/{n}.parquet", folder / f"{n}.parquet")
    return str(folder)


def orders_count(tables):
    return {r["table_name"]: r["total_rows"] for r in R.dq_row_counts(tables).collect()}["order_list"]


def test_changed_source_gives_new_answers(spark, source):
    first = S.staged_tables(spark, source)
    before = orders_count(first)
    assert S.staged_tables(spark, source) is first
    fewer = spark.read.parquet(f"{SF}/orders.parquet").limit(100).toPandas()
    os.remove(f"{source}/orders.parquet")
    fewer.to_parquet(f"{source}/orders.parquet", coerce_timestamps="us")
    after = orders_count(S.staged_tables(spark, source))
    assert before == 1500 and after == 100


def test_unfinished_staging_is_refused_and_staged_again(spark, source, tmp_path):
    location = str(tmp_path / "kept")
    S.stage_tables(spark, source, location=location)
    assert orders_count(S.open_staged(spark, location)) == 1500
    with pytest.raises(FileExistsError):
        S.stage_tables(spark, source, location=location)
    half = str(tmp_path / "half")
    shutil.copytree(f"{location}/order_list", f"{half}/order_list")
    with pytest.raises(FileNotFoundError):
        S.open_staged(spark, half)
    S.stage_tables(spark, source, location=half)
    assert orders_count(S.open_staged(spark, half)) == 1500
    other = tmp_path / "other"
    other.mkdir()
    (other / "mine.txt").write_text("x")
    with pytest.raises(FileExistsError):
        S.stage_tables(spark, source, location=str(other))


def test_reopened_fact_keeps_its_bucketing(spark, source, tmp_path):
    location = str(tmp_path / "kept")
    tables = S.stage_tables(spark, source, location=location)
    reports = (R.monthly_trend, R.category_performance)
    want = [sorted(map(tuple, r(tables).collect())) for r in reports]
    spark.catalog.clearCache()
    for t in spark.catalog.listTables():
        if t.name.startswith("ledgerlens_staged_"):
            spark.sql(f"DROP TABLE {t.name}")  # external: the files stay
    again = S.open_staged(spark, location)
    for report in reports:
        plan = report(again)._jdf.queryExecution().executedPlan().toString()
        assert "order_id" not in "".join(x for x in plan.split("\n") if "Exchange hash" in x)
    assert [sorted(map(tuple, r(again).collect())) for r in reports] == want
    S._staged.clear()  # tables dropped above


def test_released_tables_are_removed(spark):
    df = MT.materialize(spark.range(5), "stage-test")
    path = df._ledgerlens_path.replace("file:", "")
    assert os.path.isdir(path) and df.count() == 5
    MT.release(df)
    assert not os.path.exists(path)
    MT.release(df)  # nothing left to do


def frames(spark, hot=0, repeated=False, orphans=5):
    """200 orders of 2 lines, and one more of ``hot`` lines."""
    orders = [(f"O{i}", dt.date(2020, 1, 1) + dt.timedelta(days=i % 90), f"C{i % 37}", f"S{i % 5}",
               f"T{i % 11}") for i in range(201)]
    if repeated:
        orders += [("O3", dt.date(2020, 2, 2), "Other", "S9", None), orders[4]]
    lines = [(f"O{i}", D(10 + i + 3 * j), D(5 - i % 9), 1 + j, f"c{i % 3}", f"s{(i + j) % 7}", f"m{j}")
             for i in range(200) for j in range(2)]
    lines += [("O200", D(j % 50), D(j % 7 - 3), 1, f"c{j % 3}", f"s{j % 7}", "m0") for j in range(hot)]
    lines += [(None if i % 2 else "nowhere", D(1), D(-1), 1, "c0", "s0", None) for i in range(orphans)]
    targets = [("Jan-20", f"c{i}", D(1000 * i)) for i in range(3)]
    return [spark.createDataFrame(orders, schemas.ORDER_LIST),
            spark.createDataFrame(lines, schemas.ORDER_DETAILS),
            spark.createDataFrame(targets, schemas.SALES_TARGET)]


def same_reports(staged, plain, names=REPORTS):
    for name in names:
        a, b = (sorted(map(str, REPORTS[name](t).collect())) for t in (staged, plain))
        assert a == b, name


def test_hot_order_is_split(spark):
    """A third of all lines belong to one order: no task reads them all, and
    every report is the same as without staging."""
    parts = frames(spark, hot=250)
    staged = S.stage_frames(*parts, S.scratch_path(spark, "staged"))
    for table in (staged.fact_table, staged.order_details):
        per_file = table.where("order_id = 'O200'").groupBy(F.input_file_name()).count()
        sizes = [r["count"] for r in per_file.collect()]
        assert sum(sizes) == 250 and len(sizes) == 8 and max(sizes) < 40
    bucketed = staged.order_details.inputFiles()
    assert any("order_details_hot" in f for f in bucketed) and staged.order_sums is not None
    assert staged.order_sums.where("order_id = 'O200'").count() == 1
    same_reports(staged, from_frames(*parts))


def test_no_hot_order_no_split(spark):
    parts = frames(spark, orphans=0)
    base = S.scratch_path(spark, "staged")
    staged = S.stage_frames(*parts, base)
    assert "Union" not in staged.fact_table._jdf.queryExecution().optimizedPlan().toString()
    assert not any("_hot" in f for f in staged.order_details.inputFiles())
    again = S.open_staged(spark, base)
    same_reports(again, from_frames(*parts), ["business_summary", "dq_row_counts", "top_customers"])


def test_repeated_order_ids_turn_sums_per_order_off(spark):
    parts = frames(spark, hot=30, repeated=True)
    staged = S.stage_frames(*parts, S.scratch_path(spark, "staged"))
    assert staged.order_sums is None
    same_reports(staged, from_frames(*parts))


def test_empty_tables_can_be_staged(spark):
    parts = [p.limit(0) for p in frames(spark)]
    staged = S.stage_frames(*parts, S.scratch_path(spark, "staged"))
    same_reports(staged, from_frames(*parts),
                 ["business_summary", "dq_row_counts", "loss_summary", "rfm_segments", "category_performance"])


def test_smallest_table_that_answers(spark):
    t = S.staged_tables(spark, SF)
    def read(df):
        return {f.split("/")[-2] for f in df.inputFiles()}
    assert read(t.sales(["state"], ["amount"])) == {"order_sums"}
    assert read(t.sales([], ["category", "amount"], orders=False)) == {"pair_sums"}
    assert read(t.sales([], ["category", "amount"])) == {"sales_fact"}
    assert read(t.sales(["state"], ["category"], orders=False)) == {"sales_fact"}
    with pytest.raises(ValueError, match="count orders"):
        from ledgerlens.operators import measures as M
        M.measures(t.sales([], ["amount"], orders=False), [], [M.orders()])


def test_no_set_of_values_in_one_buffer(spark):
    t = S.staged_tables(spark, SF)
    for report in (R.business_summary, R.executive_summary, R.state_performance):
        plan = report(t)._jdf.queryExecution().executedPlan().toString()
        assert "collect_set" not in plan and "sales_fact" not in plan


def written_below(spark):
    folder = S.scratch_path(spark, "x").rsplit("/", 1)[0].replace("file:", "")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


@pytest.mark.parametrize("repeated", [False, True])
def test_what_reads_a_table_once_stages_nothing(spark, source, repeated):
    if repeated:  # a repeated part repeats its lines, as in the staged table
        part = spark.read.parquet(f"{SF}/part.parquet").toPandas()
        part._append(part).to_parquet(f"{source}/part.parquet")
        lines = spark.read.parquet(f"{SF}/lineitem.parquet").toPandas()
        lines.loc[:9, "l_extendedprice"] = 0.0
        lines.to_parquet(f"{source}/lineitem.parquet", coerce_timestamps="us")
    before = written_below(spark)
    got = {n: CAT.run_on_warehouse(n)(spark, source).collect() for n in sorted(CAT.READ_ONCE)}
    assert written_below(spark) == before
    staged = S.staged_tables(spark, source)
    assert S.mapped_tables(spark, source) is staged
    for name, rows in got.items():
        assert sorted(map(str, rows)) == sorted(map(str, REPORTS[name](staged).collect())), name
    assert got["dq_bad_amounts"][0][0] == (20 if repeated else 0)


def test_buckets_grow_with_the_lines(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_LINES", 20)
    assert S.fact_buckets(spark, 161) == 9 and S.fact_buckets(spark, 160) == S.fact_buckets(spark) == 8
    parts = frames(spark, hot=30)  # 435 lines
    base = S.scratch_path(spark, "staged")
    staged = S.stage_frames(*parts, base)
    assert S._read_mark(spark, base)["buckets"] == 22
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"  # as before
    same_reports(staged, from_frames(*parts))
