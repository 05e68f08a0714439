"""Sort, top-k and argmax (T1-T5) and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultcast.operators.windows import dedupe_first


def top_k(df: DataFrame, score: str, k: int, keys=None, tie: str | None = None, absolute: bool = False) -> DataFrame:
    """The k best rows by score (descending, ``tie`` ascending breaks ties).

    Without keys this is a distributed take-ordered (each task keeps k rows);
    with keys a window per key on the (small) scored table.
    """
    keys = list(keys or [])
    s = F.abs(F.col(score)) if absolute else F.col(score)
    order = [s.desc_nulls_last()] + ([F.col(tie).asc()] if tie else [])
    if not keys:
        return df.orderBy(*order).limit(k)
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= k).drop("_rn")


def best_model(board: DataFrame, keys=("system",), score: str = "r2", name: str = "model_name",
               tie_digits: int = 9) -> DataFrame:
    """The highest score per key; scores equal to ``tie_digits`` decimals are ties, and ties
    go to the first name in alphabetical order (so float noise never picks the winner)."""
    keyed = board.withColumn("_score_key", F.rint(F.col(score) * float(10 ** tie_digits)))
    return top_k(keyed, "_score_key", 1, keys, tie=name).drop("_score_key")


def preview(df: DataFrame, n: int = 5, order=("date",)) -> DataFrame:
    """T5: the first n rows by ``order`` (a take-ordered, not a full sort)."""
    return df.orderBy(*order).limit(n)


def union_series(history: DataFrame, forecast: DataFrame, key: str = "ts") -> DataFrame:
    """U1 (+W8): all rows of both, one row per key: history wins, then the row of the smaller hash. Not sorted."""
    both = history.withColumn("_src", F.lit(0)).unionByName(forecast.withColumn("_src", F.lit(1)))
    return dedupe_first(both, key, ["_src", F.xxhash64(*history.columns)]).drop("_src")


def sort_by(df: DataFrame, key: str = "ts") -> DataFrame:
    """Global sort, for output only."""
    return df.orderBy(key)


def distinct_values(df: DataFrame, cols) -> DataFrame:
    """Distinct values (hash aggregate with map-side combine)."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    return df.select(*cols).distinct()
