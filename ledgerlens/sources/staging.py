"""Stage the mapped sales tables once, as Parquet in the shared folder.

Mapping the warehouse tables costs joins (orders x customer x nation x
region, lineitem x part) and per-line decimal arithmetic, and 31 reports
read the sales fact, itself a join of the two largest tables on
order_id. Staging does that once, the way the original analysis loaded
its tables before querying them:

    order_list     orders with customer, nation and region attributes
    order_details  lines with amount, profit and part attributes, bucketed
                   by order_id: the only exchange of the lines
    sales_fact     order_list JOIN order_details ON order_id, bucketed the
                   same: the join and COUNT(DISTINCT order_id) need no
                   exchange of lines
    order_sums     one row per order that has lines, with their sums
    pair_sums      one row per (category, sub-category), the same (small)
    sales_target   the derived targets (small)

Reports take the smallest of these that can answer (``SalesTables.sales``).
What reads a mapped table only once takes ``mapped_tables`` and stages nothing.

**No sort of the lines.** There are more buckets where there are more lines,
so that the orders of a bucket fit a hash table, and a task writes the rows
of its buckets as they come.

**Hot orders.** A bucket holds whole orders. An order with more lines than a
bucket has on average (so there are fewer such orders than buckets) would
make one large file and one long task: its lines, and lines without an
order id, go to a second, salted part of order_details and of the fact,
spread over all tasks, and readers get the union. Their rows in the tables
of sums are like any other.

Files go under the session's ``spark.checkpoint.dir`` (shared storage on
a cluster, so a lost executor loses nothing). Each report then scans only
the staged columns it needs. Staged tables are reused within one Spark
application as long as the source files (path, length, modification time)
are the same; otherwise they are staged anew. A folder of staged tables is
complete when it has its marker file, which is written last.
"""

from __future__ import annotations

import hashlib
import json
import threading
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.measures import line_sums
from ledgerlens.operators.materialize import (
    delete_folder, file_system, remove_at_exit, scratch_path, write_bytes,
)
from ledgerlens.sources.schemas import DETAIL_COLUMNS, ORDER_COLUMNS, TARGET_COLUMNS, WAREHOUSE
from ledgerlens.sources.tables import PAIR, SalesTables
from ledgerlens.sources.warehouse import Warehouse

FACT_COLUMNS = ORDER_COLUMNS + [c for c in DETAIL_COLUMNS if c != "order_id"]
STAGED_NAMES = ("order_list", "order_details", "order_details_hot", "sales_fact", "sales_fact_hot",
                "order_sums", "pair_sums", "sales_target")
MARKER = "_staged.json"
BROADCAST_ORDERS = 100_000  # rows of an order each
BUCKET_LINES = 1_000_000  # at most, on average

_lock = threading.Lock()
_staged: dict[tuple[str, str], tuple[str, SalesTables]] = {}


def source_state(spark: SparkSession, root: str) -> str:
    """A digest of the listing (path, length, modification time) of the
    stored tables under ``root`` that the mapping reads."""
    listing = []
    for name in sorted(WAREHOUSE):
        fs, path = file_system(spark, f"{root.rstrip('/')}/{name}.parquet")
        files = fs.listFiles(path, True)
        while files.hasNext():
            f = files.next()
            listing.append(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(listing)).encode()).hexdigest()


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _table_name(path: str) -> str:
    return "ledgerlens_staged_" + hashlib.sha256(path.encode()).hexdigest()[:16]


def _open_bucketed(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """A table of this application's catalog that names the bucketing of the
    files at ``path``; they stay where they are."""
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                           for f in spark.read.parquet(path).schema.fields)
        spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY (order_id) "
                  f"INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def _write_bucketed(df: DataFrame, path: str, buckets: int) -> DataFrame:
    # one file per bucket and writing task: rows of a bucket come together
    # first (Spark leaves the exchange out where they already are)
    (df.repartition(buckets, "order_id").write.mode("errorifexists").format("parquet")
     .bucketBy(buckets, "order_id").option("path", path).saveAsTable(_table_name(path)))
    return df.sparkSession.table(_table_name(path))


@contextmanager
def _unsorted(spark: SparkSession):
    """Joins hash the side whose partitions are all small instead of sorting
    both, and bucketed writes open a file per bucket instead of sorting."""
    names = {"spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
             "spark.sql.maxConcurrentOutputFileWriters": "4"}
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, value in names.items():
            spark.conf.set(n, value)
        yield
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def hot_orders(details: DataFrame, buckets: int, total: int | None = None) -> list:
    """Ids of orders with more lines than a bucket has on average: fewer than
    ``buckets`` of them, so few enough to name in a condition."""
    lines = details.where(F.col("order_id").isNotNull()).groupBy("order_id").agg(
        F.count(F.lit(1)).alias("lines"))
    if total is None:
        total = details.select("order_id").count()
    hot = lines.where(F.col("lines") * buckets > total).select("order_id").collect()
    return [r["order_id"] for r in hot] if buckets > 1 else []


def _is_hot(hot: list) -> Column:
    return F.col("order_id").isNull() | F.col("order_id").isin(hot) if hot else F.col("order_id").isNull()


def _stage_lines(order_list: DataFrame, details: DataFrame, base: str, buckets: int, hot: list) -> dict:
    """Write order_details, the fact and the tables of sums below ``base``."""
    salted = details.where(_is_hot(hot))
    if hot:
        salted = salted.repartition(buckets)
    lines = _write_bucketed(details.where(~F.coalesce(_is_hot(hot), F.lit(True))),
                            f"{base}/order_details", buckets)
    hot_lines = _write(salted, f"{base}/order_details_hot")
    fact = _write_bucketed(order_list.join(lines, "order_id").select(*FACT_COLUMNS),
                           f"{base}/sales_fact", buckets)
    per_order, whole = fact.groupBy(*ORDER_COLUMNS).agg(*line_sums()), fact
    if hot:
        of_hot = order_list.where(F.col("order_id").isin(hot))
        # fewer rows than buckets, unless order_list repeats ids
        if of_hot.limit(BROADCAST_ORDERS + 1).count() <= BROADCAST_ORDERS:
            of_hot = F.broadcast(of_hot)
        hot_fact = of_hot.join(hot_lines, "order_id").select(*FACT_COLUMNS)
        hot_fact = _write(hot_fact.repartition(buckets), f"{base}/sales_fact_hot")
        per_order = per_order.unionByName(hot_fact.groupBy(*ORDER_COLUMNS).agg(*line_sums()))
        whole = whole.unionByName(hot_fact)
    sums = _write_bucketed(per_order, f"{base}/order_sums", buckets)
    _write(whole.groupBy(*PAIR).agg(*line_sums()), f"{base}/pair_sums")
    return {"buckets": buckets, "hot": bool(hot), "split": hot_lines.limit(1).count() > 0,
            "unique": _unique(sums)}


def _unique(order_sums: DataFrame) -> bool:
    """Whether order ids are a key: if order_list repeats one with other
    attributes, rows per order cannot count orders and are not used."""
    repeated = order_sums.groupBy("order_id").count().where(F.col("count") > 1)
    return repeated.limit(1).count() == 0


def _open(spark: SparkSession, base: str, mark: dict) -> SalesTables:
    """The tables staged below ``base``: lines and fact with their salted
    parts, where they have one."""
    def plain(name):
        return spark.read.parquet(f"{base}/{name}")

    lines, sums = (_open_bucketed(spark, f"{base}/{n}", mark["buckets"])
                   for n in ("order_details", "order_sums"))
    if mark["split"]:
        lines = lines.unionByName(plain("order_details_hot"))
    return SalesTables(plain("order_list"), lines, plain("sales_target"),
                       fact_table=_open_fact(spark, base, mark),
                       order_sums=sums if mark["unique"] else None, pair_sums=plain("pair_sums"))


def _open_fact(spark: SparkSession, base: str, mark: dict) -> DataFrame:
    fact = _open_bucketed(spark, f"{base}/sales_fact", mark["buckets"])
    return fact.unionByName(spark.read.parquet(f"{base}/sales_fact_hot")) if mark["hot"] else fact


def _mark(spark: SparkSession, base: str, mark: dict) -> None:
    write_bytes(spark, f"{base}/{MARKER}", json.dumps(mark).encode())


def _read_mark(spark: SparkSession, base: str) -> dict | None:
    fs, path = file_system(spark, f"{base}/{MARKER}")
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def fact_buckets(spark: SparkSession, lines: int = 0) -> int:
    """Buckets of the staged fact: ``ledgerlens.factBuckets`` in the session
    conf, else the number of shuffle partitions, or more where a bucket would
    have more than ``BUCKET_LINES`` of the ``lines``."""
    return int(spark.conf.get("ledgerlens.factBuckets", None)
               or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines // BUCKET_LINES)))


def _base_folder(spark: SparkSession, location: str | None) -> str:
    """``location``, emptied if an earlier staging there did not end; or a
    new folder that goes with the application."""
    if not location:
        return scratch_path(spark, "staged")
    base = location.rstrip("/")
    fs, path = file_system(spark, base)
    if fs.exists(path):
        if _read_mark(spark, base):
            raise FileExistsError(f"{base} already holds staged tables; open them or name another folder")
        names = {s.getPath().getName() for s in fs.listStatus(path)}
        if names - set(STAGED_NAMES):
            raise FileExistsError(f"{base} holds other files: {sorted(names - set(STAGED_NAMES))}")
        for name in names:  # what an aborted staging left
            delete_folder(spark, f"{base}/{name}")
    return base


def stage_tables(spark: SparkSession, root: str, location: str | None = None) -> SalesTables:
    """Build the staged tables from the warehouse under ``root``.

    ``location`` names a folder (shared storage) to keep them in, so that
    later applications can open them with ``open_staged`` instead of
    staging again; by default a new folder under the checkpoint folder is
    used. Complete staged tables at ``location`` are not overwritten."""
    w = Warehouse(spark, root)
    base = _base_folder(spark, location)
    tables = stage_frames(w.orders(ORDER_COLUMNS), w.details(DETAIL_COLUMNS),
                          Warehouse.targets_from, base, w.details(["order_id"]))
    if not location:
        remove_at_exit(spark, base)
    return tables


def stage_frames(order_list: DataFrame, order_details: DataFrame,
                 sales_target: DataFrame | Callable[[SalesTables], DataFrame], base: str,
                 line_ids: DataFrame | None = None) -> SalesTables:
    """Stage three tables below the folder ``base``. ``sales_target`` may be
    derived from the staged fact. Any table may be empty; lines without an
    order and orders without lines stay in their tables. ``line_ids``: the
    lines' order ids, where they can be counted without building the lines."""
    spark = order_list.sparkSession
    ids = (order_details if line_ids is None else line_ids).select("order_id")
    lines = ids.count()
    buckets = fact_buckets(spark, lines)
    hot = hot_orders(ids, buckets, lines)
    with _unsorted(spark):
        orders = _write(order_list.select(*ORDER_COLUMNS).repartition(buckets), f"{base}/order_list")
        mark = _stage_lines(orders, order_details.select(*DETAIL_COLUMNS), base, buckets, hot)
    if not isinstance(sales_target, DataFrame):
        sales_target = sales_target(SalesTables(orders, lambda: None, lambda: None,
                                                fact_table=_open_fact(spark, base, mark)))
    _write(sales_target.select(*TARGET_COLUMNS), f"{base}/sales_target")
    _mark(spark, base, mark)
    return _open(spark, base, mark)


def stage_csv_tables(spark: SparkSession, orders_path: str, details_path: str,
                     targets_path: str, trim: bool = False, ignore_case: bool = False
                     ) -> tuple[SalesTables, dict[str, DataFrame]]:
    """Load the three CSV files leniently and stage them like the warehouse.

    Rows that fail to parse are not coerced: they are stored per table as
    ``(raw_line, reason)`` rejects in the pass that stores the good ones, so
    the caller can report or keep them. ``trim`` removes blanks around text
    values (``"Kerala "``); ``ignore_case`` makes text other than ids compare
    and group without regard to case. Returns the staged tables and the
    rejects; ``load_csv_tables`` returns the line counts as well.
    """
    tables, loads = load_csv_tables(spark, orders_path, details_path, targets_path, trim, ignore_case)
    return tables, {name: load.rejects for name, load in loads.items()}


def load_csv_tables(spark: SparkSession, orders_path: str, details_path: str, targets_path: str,
                    trim: bool = False, ignore_case: bool = False):
    """As :func:`stage_csv_tables`, with a ``csv.Load`` (good rows, rejects and
    line counts) per table."""
    from ledgerlens.sources import schemas
    from ledgerlens.sources.csv import clean_text, load_csv, normalise_case

    base = scratch_path(spark, "staged-csv")
    loads = {name: load_csv(spark, path, schema, f"{base}/loaded/{name}") for name, path, schema in [
        ("order_list", orders_path, schemas.ORDER_LIST),
        ("order_details", details_path, schemas.ORDER_DETAILS),
        ("sales_target", targets_path, schemas.SALES_TARGET)]}
    remove_at_exit(spark, base)
    good = {name: clean_text(load.good) if trim else load.good for name, load in loads.items()}
    tables = stage_frames(good["order_list"], good["order_details"], good["sales_target"], base)
    if ignore_case:
        # sums of values that differ in case are added up when they are grouped
        frames = [normalise_case(df) for df in (tables.order_list, tables.order_details, tables.sales_target,
                                                tables.fact_table, tables.pair_sums)]
        sums = tables.order_sums and normalise_case(tables.order_sums)
        tables = SalesTables(*frames[:3], fact_table=frames[3], order_sums=sums, pair_sums=frames[4])
    return tables, loads


def open_staged(spark: SparkSession, location: str) -> SalesTables:
    """Open tables staged earlier with ``stage_tables(..., location=...)``;
    refuses a folder whose staging did not end."""
    base = location.rstrip("/")
    mark = _read_mark(spark, base)
    if mark is None:
        raise FileNotFoundError(f"{base} holds no complete staged tables (no {MARKER}); stage them again")
    return _open(spark, base, mark)


def use_staged(spark: SparkSession, root: str, tables: SalesTables) -> None:
    """Make ``tables`` the staged tables of ``root`` in this application,
    until the source files change."""
    with _lock:
        _staged[(spark.sparkContext.applicationId, root.rstrip("/"))] = (
            source_state(spark, root), tables)


def staged_tables(spark: SparkSession, root: str) -> SalesTables:
    """Staged tables for ``root``: built on first use in this application,
    and again when the source files have changed."""
    key = (spark.sparkContext.applicationId, root.rstrip("/"))
    with _lock:
        state = source_state(spark, root)
        if key not in _staged or _staged[key][0] != state:
            _staged[key] = (state, stage_tables(spark, root))
        return _staged[key][1]


def mapped_tables(spark: SparkSession, root: str) -> SalesTables:
    """The staged tables of ``root`` where this application has them, else the
    mapping itself: for what reads a table only once, where staging would
    shuffle and write far more than is read. All joins of the mapping are
    kept, as a repeated key of a dimension repeats rows."""
    with _lock:
        state, tables = _staged.get((spark.sparkContext.applicationId, root.rstrip("/")), (None, None))
        if tables and state == source_state(spark, root):
            return tables
    w = Warehouse(spark, root)
    return SalesTables(lambda: w.orders(ORDER_COLUMNS), lambda: w.details(DETAIL_COLUMNS),
                       lambda: w.targets().select(*TARGET_COLUMNS))
