"""What the query modules share: rounding on both sides and registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import register
from .adapters import view, with_views


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round double columns, so that sums in another order compare equal; -0 becomes 0."""
    return df.select(*(((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c)) for c, t in df.dtypes))


def rounded_sql(inner: str, doubles: str, others: str = "", digits: int = 6) -> str:
    """The same over SQL; column lists are comma-separated names."""
    d = [f"round({c.strip()}, {digits}) + 0e0 AS {c.strip()}" for c in doubles.split(",")]
    return f"SELECT {', '.join([*(c.strip() for c in others.split(',') if c.strip()), *d])} FROM ({inner}) q"


def add(name: str, views: str, query: Callable[..., DataFrame], inner: str | None, doubles: str = "", others: str = "", digits: int = 6) -> None:
    """Register ``query`` over the named views with its SQL; ``doubles`` are rounded on both sides."""
    names = views.split()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(query(*(view(spark, sf_dir, n) for n in names)), digits)

    text = None
    if inner is not None:
        text = with_views(*names) + (rounded_sql(inner, doubles, others, digits) if doubles else f"SELECT * FROM ({inner}) q")
    register(name, run, text)
