"""ledgerlens: retail sales analytics as Spark DataFrame operators.

Layout
------
sources/    explicit-schema readers (CSV, Parquet) and the mapping of the
            warehouse tables onto the three sales tables
functions/  column expressions shared by all reports (money, ratios, month keys)
operators/  reusable DataFrame operators (fact, measures, data quality,
            windows, scalable global ranking, targets, customers)
plans/      the report catalogue, its registry and the SQL oracle
llm/        operators of a training-data pipeline (optional)
"""

from ledgerlens.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
