"""Small helpers shared by the operators."""

from __future__ import annotations

import io
import os
import re
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.materialize import remove_at_exit, scratch_path, write_bytes

# A side with at most this many narrow rows (an id and a few numbers) is
# broadcast: some tens of MB. Larger ones take part in a shuffled join.
BROADCAST_ROWS = 500_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# inside a character class: the blanks that separate words and are
# stripped from lines (space, and tab to carriage return)
BLANKS = r"\x20\x09-\x0D"
_AFTER_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers, once per
    application, as ``--py-files`` would; not needed where the package is
    installed on all machines. The archive lies in the shared folder."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    out.write(file, os.path.relpath(file, os.path.dirname(package)))
    folder = scratch_path(spark, "modules")
    write_bytes(spark, f"{folder}/ledgerlens.zip", archive.getvalue())
    remove_at_exit(spark, folder)
    spark.sparkContext.addPyFile(f"{folder}/ledgerlens.zip")
    _shipped.add(app)


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z and nothing else (``lower`` does just that, and
    faster, where every character is one byte)."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds


def row_digest(columns: list[Column]) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of the columns. Equal rows have equal
    digests; different rows share both with probability 2^-128 a pair."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(0x5EED), *columns)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the (materialized) ``df`` has at most ``rows``
    rows; otherwise leave the join to be shuffled. The result of the join
    is the same either way."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spare(name: str, columns: list[str]) -> str:
    """``name``, with underscores until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def byte_pieces(data: bytes, size: int = 1 << 20):
    """``data`` cut after blanks into pieces of about ``size`` bytes."""
    start = 0
    while len(data) - start > size:
        at = _AFTER_BLANK.search(data, start + size)
        end = at.end() if at else len(data)
        yield data[start:end]
        start = end
    yield data[start:]


def word_pieces(text: str, size: int = 1 << 20):
    """The words of a text, A-Z lower-cased, in non-empty lists piece by
    piece. (Blanks and case of bytes are those of ASCII.)"""
    for piece in byte_pieces(text.encode("utf-8", "surrogatepass"), size):
        words = piece.lower().split()
        if words:
            yield words
