"""Differential check of a Spark report against its SQL oracle (DuckDB).

Used by the tests and ``scripts/check_oracle.py``. Values are compared
order-insensitively after normalising (decimals by value, dates as ISO
text), columns matched by name; output types are compared as well.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from decimal import Decimal

WAREHOUSE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                    "events", "documents", "embeddings", "pages", "benchmark", "labels",
                    "conversations")

_SPARK_TO_SQL = {"bigint": "BIGINT", "string": "VARCHAR", "date": "DATE", "int": "INTEGER",
                 "double": "DOUBLE", "boolean": "BOOLEAN"}


def duckdb_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in WAREHOUSE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, Decimal):
        return ("dec", format(v.normalize(), "f"))
    if isinstance(v, (dt.date, dt.datetime)):
        return ("date", v.isoformat())
    if isinstance(v, float):
        return ("num", round(v, 9))
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, int):
        return ("num", v)
    return ("val", v)


def _spark_type(t) -> str:
    s = t.simpleString()
    if s.startswith("decimal"):
        return s.upper().replace(" ", "")
    return _SPARK_TO_SQL.get(s, s.upper())


@dataclass
class Outcome:
    name: str
    rows_spark: int = 0
    rows_sql: int = 0
    names_match: bool = False
    types_match: bool = False
    values_match: bool = False
    detail: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return self.names_match and self.values_match and self.rows_spark == self.rows_sql


def compare(name: str, spark_df, con, sql: str) -> Outcome:
    out = Outcome(name)
    rel = con.sql(sql)
    sql_cols = list(rel.columns)
    sql_types = [str(t).upper().replace(" ", "") for t in rel.types]
    sql_rows = rel.fetchall()
    spark_cols = spark_df.columns
    spark_types = [_spark_type(f.dataType) for f in spark_df.schema.fields]
    spark_rows = [tuple(r) for r in spark_df.collect()]
    out.rows_spark, out.rows_sql = len(spark_rows), len(sql_rows)
    out.names_match = sorted(spark_cols) == sorted(sql_cols)
    if not out.names_match:
        out.detail.append(f"columns spark={spark_cols} sql={sql_cols}")
        return out
    st = dict(zip(spark_cols, spark_types))
    qt = dict(zip(sql_cols, sql_types))
    bad_types = [f"{c}: spark {st[c]} sql {qt[c]}" for c in sorted(spark_cols) if st[c] != qt[c]]
    out.types_match = not bad_types
    out.detail.extend(bad_types)
    order = sorted(spark_cols)
    si = [spark_cols.index(c) for c in order]
    qi = [sql_cols.index(c) for c in order]
    a = sorted((tuple(_norm(r[i]) for i in si) for r in spark_rows), key=repr)
    b = sorted((tuple(_norm(r[i]) for i in qi) for r in sql_rows), key=repr)
    out.values_match = a == b
    if not out.values_match:
        sa, sb = set(a), set(b)
        only_a = [x for x in a if x not in sb][:3]
        only_b = [x for x in b if x not in sa][:3]
        out.detail.append(f"columns {order}")
        out.detail.append(f"only spark: {only_a}")
        out.detail.append(f"only sql:   {only_b}")
    return out
