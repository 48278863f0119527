"""Exact cosine nearest neighbours of a query vector, in Arrow batches with a top-k of each batch before the global one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(df: DataFrame, column: str) -> DataFrame:
    """Rows with unit vectors; zero, empty and non-finite vectors are left out."""
    finite = F.forall(F.col(column), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col(column).isNotNull() & finite).withColumn("__n", norm(F.col(column))).where(F.col("__n") > 1e-12).withColumn(
        column, F.transform(column, lambda x: x.cast("double") / F.col("__n"))
    ).drop("__n")


def nearest(df: DataFrame, query: list[float], k: int, id_column: str = "id", column: str = "vec") -> DataFrame:
    """(id, cosine) of the k rows nearest to ``query``; ties by the id as text. Vectors of another length are skipped."""
    q = np.asarray(query, dtype=np.float64)
    q = q / np.linalg.norm(q)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, v) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if v is not None and len(v) == len(q) and None not in v]
            if not rows:
                continue
            x = np.array([v for _, v in rows], dtype=np.float64)
            n = np.linalg.norm(x, axis=1)
            with np.errstate(all="ignore"):
                c = np.round(x @ q / n, 12)
            ok = np.flatnonzero(np.isfinite(c) & (n > 1e-12))
            if len(ok) > k:  # ties at the border all stay
                ok = ok[c[ok] >= np.partition(c[ok], -k)[-k]]
            yield pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in ok], pa.int64()), pa.array(c[ok])], ["id", "cosine"])

    scored = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(column).cast("array<double>").alias("v")).mapInArrow(score, "id bigint, cosine double")
    return scored.orderBy(F.desc("cosine"), F.col("id").cast("string")).limit(k)


def distance_score(c: Column) -> Column:
    return F.round(1 / (1 + (1 - c)), 6)


def similarity_score(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def separation_text() -> Column:
    """The text that is embedded for the separation index: who to whom on which day, and what."""
    some = lambda c: F.when(c != "", c).otherwise(F.lit("?"))
    return F.concat(some(F.col("sender")), F.lit(" to "), some(F.col("recipient")), F.lit(" on "), some(F.substring("ts", 1, 10)), F.lit(": "), F.col("content"))
