"""Batch inference behind a small protocol: any object with ``summarize(list[str]) -> list[str]``."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import partial
from importlib import import_module
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType

from corpusloom.config import DataConfig, GenerationConfig
from corpusloom.functions import text as T
from corpusloom.operators.stats import head_cap
from corpusloom.session import ship

PREFIX = "summarize: "


class Summarizer(Protocol):
    def summarize(self, texts: list[str]) -> list[str]: ...


class LeadSummarizer:
    """The first words of each text; the stand-in where no model is at hand."""

    def __init__(self, words: int = 20):
        self.words = words

    def summarize(self, texts: list[str]) -> list[str]:
        return [" ".join(t.split()[: self.words]) for t in texts]


def model_of(name: str, options: GenerationConfig | None = None) -> Callable[[], Summarizer]:
    """What makes the summarizer of a name: ``lead:N``, or ``module:function`` called with the decoding options."""
    kind, _, rest = name.partition(":")
    if kind == "lead":
        return partial(LeadSummarizer, int(rest or 20))

    def make() -> Summarizer:
        return getattr(import_module(kind), rest)(options or GenerationConfig())

    return make


def summarize_text(text: str, make: Callable[[], Summarizer], prefix: str = "") -> str:
    """One text without a session; a blank one is an error."""
    if not text.strip():
        raise ValueError("the input text is blank")
    return make().summarize([prefix + " ".join(unicodedata.normalize("NFC", text).split())])[0].strip()


def prefixed(text: Column, prefix: str = PREFIX) -> Column:
    """Model input: prefix and cleaned text."""
    return F.concat(F.lit(prefix), T.clean_text(text))


def compression_ratio(article: Column, summary: Column, digits: int = 1) -> Column:
    """Share of words saved in percent; null for an article without words."""
    a, s = T.word_count(article), T.word_count(summary)
    return F.round(F.when(a > 0, (1 - s / a) * 100), digits)


def summarize(rows: DataFrame, make: Callable[[], Summarizer], text_col: str = "article", batch: int = 8) -> DataFrame:
    """Adds ``prediction``. make() runs once per task, where the model is loaded; blank texts get an empty one."""
    ship(rows.sparkSession)

    @pandas_udf(StringType())
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for series in batches:
            texts = series.fillna("").tolist()
            out = [""] * len(texts)
            todo = [i for i, t in enumerate(texts) if t.strip()]
            for at in range(0, len(todo), batch):
                some = todo[at : at + batch]
                for i, summary in zip(some, model.summarize([texts[i] for i in some]), strict=True):
                    out[i] = summary
            yield pd.Series(out)

    return rows.withColumn("prediction", predict(F.col(text_col)))


def tokenize(rows: DataFrame, make: Callable[[], Callable[[list[str]], list[list[int]]]], text_col: str, out_col: str, most: int) -> DataFrame:
    """Adds token ids cut to ``most``; make() gives a function of texts and runs once per task."""
    ship(rows.sparkSession)

    @pandas_udf(ArrayType(IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for series in batches:
            yield pd.Series(encode(series.fillna("").tolist()))

    return rows.withColumn(out_col, F.slice(ids(F.col(text_col)), 1, most))


def byte_tokenizer() -> Callable[[list[str]], list[list[int]]]:
    """Byte-level ids: UTF-8 bytes moved up by 3, and the end token 1."""
    return lambda texts: [[b + 3 for b in t.encode()] + [1] for t in texts]


def tokenize_splits(rows: DataFrame, config: DataConfig, make: Callable[[], Callable[[list[str]], list[list[int]]]] = byte_tokenizer) -> DataFrame:
    """Adds input_ids (prefix and article) and labels (summary), each cut to its length, after the caps of the splits."""
    caps = {"train": config.max_train_samples, "validation": config.max_eval_samples, "test": config.max_eval_samples}
    capped = head_cap(rows, caps).withColumn("_input", prefixed(F.col("article"), config.source_prefix)).withColumn("_target", T.clean_text(F.col("summary")))
    out = tokenize(capped, make, "_input", "input_ids", config.max_source_length)
    return tokenize(out, make, "_target", "labels", config.max_target_length).drop("_input", "_target")
