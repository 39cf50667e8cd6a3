"""Every registered query of the engine and its SQL."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.plans import audit, cited_queries, statement_queries, table_queries, text_queries


def plain(df: DataFrame) -> DataFrame:
    """Integers as bigint and floats as double, as SQL engines return them."""
    wide = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}
    return df.select(*[F.col(f"`{c}`").cast(wide[k]).alias(c) if k in wide else F.col(f"`{c}`") for c, k in df.dtypes])


def _plain(query):
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(query(spark, sf_dir))

    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit report of each document: overall score, counts by severity, gate."""
    return plain(audit.audit(text_queries.docs(spark, sf_dir), keep=False).scores)


def queries() -> dict:
    return {k: _plain(f) for k, f in (text_queries.QUERIES | table_queries.QUERIES | statement_queries.QUERIES | cited_queries.QUERIES).items()} | {"audit_report": flagship}


def oracle_sql() -> dict[str, str]:
    return text_queries.SQL | table_queries.SQL | statement_queries.SQL | cited_queries.SQL
