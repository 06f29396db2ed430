"""Write results and tables: CSV in the original file format, and sinks
with a manifest.

A sink writes each result in one pass that also counts its rows and sums a
hash of every row. When all results are written, the manifest names them
with rows and digest; it is written last, so a folder without one is not
complete. ``verify`` reads everything back and compares: the digest does
not depend on the order of rows or on how they are split into files.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.materialize import file_system, write_bytes
from ledgerlens.sources.csv import ORDER_DATE_FORMAT
from ledgerlens.sources.schemas import HEADERS

MANIFEST = "_manifest.json"
# text that stands for NULL in CSV sinks; empty text is written as ""
CSV_NULL = r"\N"
FORMATS = ("parquet", "csv", "json")


def write_csv(df: DataFrame, path: str) -> str:
    """One of the sales tables in the original file format: the original
    header names, dates ``dd-MM-yyyy``, CRLF line ends, blanks kept. The
    header is repeated in every part file. Returns ``path``."""
    named = df.toDF(*HEADERS[tuple(df.columns)])
    (named.write.mode("errorifexists").option("header", True)
     .option("dateFormat", ORDER_DATE_FORMAT).option("lineSep", "\r\n")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def _text(df: DataFrame, name: str) -> Column:
    kind, column = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.StringType) and not kind.isUTF8BinaryCollation():
        column = F.collate(column, "UTF8_BINARY")
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def row_sum(df: DataFrame) -> Column:
    """Sum of a hash of every row's values as text; 0 for no rows. Repeated
    rows count each."""
    row = F.xxhash64(*[_text(df, c) for c in df.columns])
    return F.coalesce(F.sum(row.cast(T.DecimalType(20, 0))), F.lit(0).cast(T.DecimalType(30, 0)))


def _counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), row_sum(df).alias("digest")), seen


def _writer(df: DataFrame, kind: str):
    out = df.write.format(kind)
    if kind == "csv":
        out = (out.option("header", True).option("nullValue", CSV_NULL)
               .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
               .option("escape", '"'))
    return out.option("ignoreNullFields", False) if kind == "json" else out


def _read(spark: SparkSession, path: str, kind: str, schema: T.StructType) -> DataFrame:
    reader = spark.read.schema(schema).format(kind)
    if kind == "csv":
        reader = (reader.option("header", True).option("enforceSchema", False)
                  .option("nullValue", CSV_NULL).option("emptyValue", "").option("multiLine", True)
                  .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
                  .option("escape", '"').option("mode", "FAILFAST"))
    return reader.load(path)


def write_results(spark: SparkSession, results: dict[str, Callable[[], DataFrame]], folder: str,
                  kind: str = "parquet") -> list[dict]:
    """Write each result to ``<folder>/<name>`` and then the manifest; returns
    its entries ``name, format, rows, digest, schema``. An earlier manifest is
    removed first, and results of the same names are replaced."""
    if kind not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    base = folder.rstrip("/")
    fs, manifest = file_system(spark, f"{base}/{MANIFEST}")
    fs.delete(manifest, False)
    entries = []
    for name, build in results.items():
        df, seen = _counted(build())
        _writer(df, kind).mode("overwrite").save(f"{base}/{name}")
        entries.append({"name": name, "format": kind, "rows": seen.get["rows"],
                        "digest": str(seen.get["digest"]), "schema": df.schema.jsonValue()})
    write_bytes(spark, f"{base}/{MANIFEST}", json.dumps({"results": entries}).encode())
    return entries


def read_manifest(spark: SparkSession, folder: str) -> list[dict]:
    fs, path = file_system(spark, f"{folder.rstrip('/')}/{MANIFEST}")
    if not fs.exists(path):
        raise FileNotFoundError(f"{folder} has no {MANIFEST}: its results are not complete")
    stream = fs.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())["results"]
    finally:
        stream.close()


def read_result(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A written result with the types that it was written with."""
    entry = {e["name"]: e for e in read_manifest(spark, folder)}[name]
    return _read(spark, f"{folder.rstrip('/')}/{name}", entry["format"],
                 T.StructType.fromJson(entry["schema"]))


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """``report, format, rows_written, rows_read, same_rows``: every result of
    the manifest, read back."""
    out = []
    for e in read_manifest(spark, folder):
        back = read_result(spark, folder, e["name"])
        seen = back.agg(F.count(F.lit(1)).alias("rows"), row_sum(back).alias("digest")).first()
        out.append((e["name"], e["format"], e["rows"], seen["rows"],
                    seen["rows"] == e["rows"] and str(seen["digest"]) == e["digest"]))
    return spark.createDataFrame(
        out, "report string, format string, rows_written long, rows_read long, same_rows boolean")
