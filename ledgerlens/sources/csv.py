"""CSV readers for the order, order-line and target files.

File format: header row, comma separated, no quoting, CRLF line ends,
order dates written ``dd-MM-yyyy``, month labels ``MMM-yy``. Values are
kept as written (``"Kerala "`` keeps its trailing blank); use
``clean_text`` to trim.

Two load modes:

* strict (``read_*``): explicit schema, FAILFAST; the header must have the
  expected names in order, and one malformed record fails the load. All columns of every record are parsed once, when the file is
  loaded into the shared folder, so that reports that read few columns
  cannot miss a bad one.
* lenient (``read_with_rejects``): every field is read as text and
  converted with ``try_cast`` / ``try_to_date``; rows where a non-empty
  field fails to convert or would lose digits, or the line has the wrong
  field count, go to a rejects DataFrame with the raw line and a reason
  instead of being silently coerced. The header is checked as well.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.materialize import materialize
from ledgerlens.sources import schemas
from ledgerlens.sources.tables import SalesTables

ORDER_DATE_FORMAT = "dd-MM-yyyy"


def _reader(spark: SparkSession):
    """``enforceSchema`` off compares every file's header with the names of
    the schema; without column pruning all fields of a record are parsed."""
    return (spark.read
            .option("header", True)
            .option("enforceSchema", False)
            .option("columnPruning", False)
            .option("dateFormat", ORDER_DATE_FORMAT)
            .option("ignoreTrailingWhiteSpace", False)
            .option("ignoreLeadingWhiteSpace", False))


def _with_header(schema: T.StructType) -> T.StructType:
    """The schema under the names that the file's header must have."""
    return T.StructType([T.StructField(h, f.dataType) for h, f in
                         zip(schemas.HEADERS[tuple(schema.names)], schema.fields)])


def _strict(spark: SparkSession, path: str, schema: T.StructType, label: str) -> DataFrame:
    whole = _reader(spark).schema(_with_header(schema)).option("mode", "FAILFAST").csv(path)
    return materialize(whole.toDF(*schema.names), f"staged-{label}")


# Other schemas than the original's have the same columns with other types.

def read_order_list(spark: SparkSession, path: str,
                    schema: T.StructType = schemas.ORDER_LIST) -> DataFrame:
    return _strict(spark, path, schema, "order-list")


def read_order_details(spark: SparkSession, path: str,
                       schema: T.StructType = schemas.ORDER_DETAILS) -> DataFrame:
    return _strict(spark, path, schema, "order-details")


def read_sales_target(spark: SparkSession, path: str,
                      schema: T.StructType = schemas.SALES_TARGET) -> DataFrame:
    return _strict(spark, path, schema, "sales-target")


def read_sales_tables(spark: SparkSession, orders_path: str, details_path: str,
                      targets_path: str, ignore_case: bool = False) -> SalesTables:
    """The three CSV files as one bundle for the reports (strict load);
    with ``ignore_case`` text other than ids compares without case."""
    frames = [read_order_list(spark, orders_path), read_order_details(spark, details_path),
              read_sales_target(spark, targets_path)]
    return SalesTables(*[normalise_case(f) if ignore_case else f for f in frames])


def _convert(raw: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.DateType):
        return F.try_to_date(raw, ORDER_DATE_FORMAT)
    if isinstance(dtype, T.StringType):
        return raw
    return raw.try_cast(dtype)


def _flagged(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` and ``raw_line, reason`` of every line; the
    reason is null where all fields convert."""
    text_schema = T.StructType(
        [T.StructField(f.name, T.StringType()) for f in _with_header(schema).fields]
        + [T.StructField("_corrupt", T.StringType())])
    raw = (_reader(spark).schema(text_schema)
           .option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt")
           .csv(path)).toDF(*schema.names, "_corrupt")
    typed = raw.select(
        *[_convert(F.col(f.name), f.dataType).alias(f.name) for f in schema.fields],
        *[F.col(f.name).alias("_raw_" + f.name) for f in schema.fields],
        "_corrupt")
    failures = [
        F.when(F.col("_raw_" + f.name).isNotNull() & F.col(f.name).isNull(),
               F.lit(f"bad {f.name}"))
        for f in schema.fields if not isinstance(f.dataType, T.StringType)
    ]
    # a number with more digits than the column keeps would be rounded
    failures += [
        F.when(F.col("_raw_" + f.name).try_cast(T.DecimalType(38, 18)) != F.col(f.name),
               F.lit(f"{f.name} loses digits"))
        for f in schema.fields if isinstance(f.dataType, (T.DecimalType, T.IntegerType))
    ]
    reason = F.coalesce(
        F.when(F.col("_corrupt").isNotNull(), F.lit("malformed line")), *failures)
    raw_line = F.coalesce(
        F.col("_corrupt"),
        F.concat_ws(",", *[F.coalesce(F.col("_raw_" + f.name), F.lit("")) for f in schema.fields]))
    return typed.select(*[f.name for f in schema.fields],
                        F.when(reason.isNotNull(), raw_line).alias("raw_line"), reason.alias("reason"))


def read_with_rejects(spark: SparkSession, path: str,
                      schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Lenient load: ``(good, rejected)``, both read from the file when used
    (:func:`load_csv` reads it once).

    ``good`` has ``schema``; ``rejected`` has ``(raw_line, reason)``.
    Empty fields become NULL in ``good`` (the NULL profile reports them).
    """
    flagged = _flagged(spark, path, schema)
    return (flagged.where(F.col("reason").isNull()).select(*schema.names),
            flagged.where(F.col("reason").isNotNull()).select("raw_line", "reason"))


@dataclass(frozen=True)
class Load:
    """What a lenient load stored, and how many lines it saw."""
    good: DataFrame
    rejects: DataFrame
    lines: int
    loaded: int
    rejected: int


def load_csv(spark: SparkSession, path: str, schema: T.StructType, folder: str) -> Load:
    """Lenient load in one pass: good rows and rejects are stored side by side
    in ``folder`` (Parquet, one subfolder each), and the lines, good rows and
    rejects are counted in the job that writes them. A file without lines
    gives empty tables and zero counts."""
    counted = Observation()
    bad = F.col("reason").isNotNull()
    flagged = _flagged(spark, path, schema).observe(
        counted, F.count(F.lit(1)).alias("lines"),
        F.count(F.when(bad, 1)).alias("rejected"), F.count(F.when(~bad, 1)).alias("loaded"))
    (flagged.withColumn("rejected", bad).write.mode("errorifexists").partitionBy("rejected")
     .parquet(folder))
    seen = counted.get
    whole = T.StructType([*schema.fields, T.StructField("raw_line", T.StringType()),
                          T.StructField("reason", T.StringType()),
                          T.StructField("rejected", T.BooleanType())])
    stored = spark.read.schema(whole).parquet(folder)
    return Load(stored.where("not rejected").select(*schema.names),
                stored.where("rejected").select("raw_line", "reason"),
                seen["lines"], seen["loaded"], seen["rejected"])


def clean_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Trim blanks around text values (``"Kerala "`` -> ``"Kerala"``)."""
    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.select(*[F.trim(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])


def normalise_case(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Compare and group the given text columns (default: all but
    ``order_id``) case-insensitively, as a server with a case-insensitive
    default collation would."""
    names = columns if columns is not None else [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name != "order_id"]
    return df.select(*[F.collate(F.col(c), "UTF8_LCASE").alias(c) if c in names else F.col(c)
                       for c in df.columns])
