"""ROUGE-1/2/L of prediction and reference, per row and as the plain mean over rows.

Row scores are F1 shares; corpus scores are means times 100. An empty side scores 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from corpusloom.functions import text as T
from corpusloom.session import ship


def _ngrams(tokens: Column, n: int) -> Column:
    if n == 1:
        return tokens

    def of(t: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>"))

    return T.bound(tokens, of)


def _count(grams: Column, gram: Column) -> Column:
    return F.size(F.filter(grams, lambda x: x == gram))


def overlap_f1(prediction: Column, reference: Column, n: int) -> Column:
    """F1 of the multiset overlap of n-grams of two token arrays."""

    def of(sides: Column) -> Column:
        p, r = sides["p"], sides["r"]
        shared = F.aggregate(F.array_intersect(p, r), F.lit(0), lambda acc, g: acc + F.least(_count(p, g), _count(r, g)))
        empty = (F.size(p) == 0) | (F.size(r) == 0)
        return F.when(empty, F.lit(0.0)).otherwise(2.0 * shared / (F.size(p) + F.size(r)))

    return T.bound(F.struct(_ngrams(prediction, n).alias("p"), _ngrams(reference, n).alias("r")), of)


def lcs_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a row at a time in array operations."""
    if not len(a) or not len(b):
        return 0
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        step = np.where(b == x, row[:-1] + 1, row[1:])
        row[1:] = np.maximum.accumulate(np.maximum(step, row[1:]))
    return int(row[-1])


@pandas_udf(DoubleType())
def lcs_f1(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    def one(p, r) -> float:
        if p is None or r is None or not len(p) or not len(r):
            return 0.0
        ids = {t: i for i, t in enumerate({*p, *r})}
        n = lcs_length(np.array([ids[t] for t in p]), np.array([ids[t] for t in r]))
        return 2.0 * n / (len(p) + len(r))

    return pd.Series([one(p, r) for p, r in zip(prediction, reference, strict=True)], dtype="float64")


def rouge_rows(rows: DataFrame, prediction: str = "prediction", reference: str = "reference", with_l: bool = True) -> DataFrame:
    """Adds rouge1, rouge2 and, unless turned off, rougeL."""
    ship(rows.sparkSession)
    out = rows.withColumn("_p", T.rouge_tokens(F.col(prediction))).withColumn("_r", T.rouge_tokens(F.col(reference)))
    out = out.withColumn("rouge1", overlap_f1(F.col("_p"), F.col("_r"), 1)).withColumn("rouge2", overlap_f1(F.col("_p"), F.col("_r"), 2))
    if with_l:
        out = out.withColumn("rougeL", lcs_f1(F.col("_p"), F.col("_r")))
    return out.drop("_p", "_r")


def rouge_corpus(rows: DataFrame, by: tuple[str, ...] = (), digits: int = 2) -> DataFrame:
    """Mean scores times 100 of rows that have them."""
    names = [c for c in ("rouge1", "rouge2", "rougeL") if c in rows.columns]
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), *(F.round(F.avg(c) * 100, digits).alias(c) for c in names))
