"""Visually identical text with different characters (problem 6): skeletons, plain forms and look-alike groups.

``unlike_fields`` takes the skeleton of every text: a text is a candidate only if decomposing it and replacing each
character by its prototype changes more than its case and its canonical form. Whether the candidate differs from
its plain form is then checked exactly. ``skeleton_groups`` groups originals of equal skeleton.

Defined results: a null field has no row in ``unlike_fields`` and a null plain form; an empty text is its own
plain form; texts are read whole; repeated rows each count; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.plain import differs, plain_form, prototype, unlike_prototype
from corpusloom.llm.shingles import suspects
from corpusloom.session import ship


def _unlike(names: list[str]):
    schema = pa.schema([("id", pa.int64()), ("field_name", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, name in enumerate(names):
                texts = [t or "" for t in batch.column(k + 1).to_pylist()]
                # a text without any character of the tables is its own prototype
                rows = [i for i in np.flatnonzero(suspects(texts)).tolist() if unlike_prototype(texts[i]) and differs(texts[i])]
                yield pa.RecordBatch.from_pydict(
                    {"id": batch.column(0).take(pa.array(rows, pa.int64())), "field_name": [name] * len(rows)}, schema=schema
                )

    return run


def unlike_fields(records: DataFrame, id_col: str = "pair_id", fields: tuple[str, ...] = ("article", "summary")) -> DataFrame:
    """(id_col, field_name): the fields whose text differs from its plain form, letter case aside."""
    ship(records.sparkSession)
    narrow = records.select(F.col(f"`{id_col}`").cast("long").alias("id"), *(F.col(f"`{c}`").cast("string") for c in fields))
    return narrow.mapInArrow(_unlike(list(fields)), "id long, field_name string").withColumnRenamed("id", id_col)


def _forms(columns: list[str], how) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = list(batch.columns)
            for name in columns:
                at = batch.schema.get_field_index(name)
                texts = batch.column(at).to_pylist()
                for i in np.flatnonzero(suspects([t or "" for t in texts])).tolist():
                    texts[i] = how(texts[i])
                arrays[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return run


def plain_texts(records: DataFrame, fields: tuple[str, ...] = ("article", "summary")) -> DataFrame:
    """The records with the named fields in plain form; all else as it was."""
    ship(records.sparkSession)
    return records.mapInArrow(_forms(list(fields), plain_form), records.schema)


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128-bit hashes of the skeleton and of the text as it is. Case stays: a text and its capitals do not look the same."""
    import xxhash

    for batch in batches:
        texts = [t for t in batch.column(0).to_pylist() if t]
        pairs = [(xxhash.xxh3_128_intdigest(prototype(t)), xxhash.xxh3_128_intdigest(t)) for t in texts]
        halves = np.array([(h >> 64, h & (1 << 64) - 1) for pair in pairs for h in pair], np.uint64).view(np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([pa.array(halves[:, k]) for k in range(4)], names=["skeleton_hash", "skeleton_low", "form_hash", "form_low"])


def skeleton_groups(records: DataFrame, fields: tuple[str, ...] = ("article", "summary")) -> DataFrame:
    """(skeleton_hash, texts, forms): texts of equal skeleton that are written in more than one way."""
    ship(records.sparkSession)
    one = F.explode(F.array(*(F.col(f"`{c}`").cast("string") for c in fields))).alias("text")
    names = ["skeleton_hash", "skeleton_low", "form_hash", "form_low"]
    hashed = records.select(one).mapInArrow(_skeletons, ", ".join(f"{n} long" for n in names))
    by_form = hashed.groupBy(*names).agg(F.count("*").alias("n"))
    groups = by_form.groupBy(*names[:2]).agg(F.sum("n").alias("texts"), F.count("*").alias("forms"))
    return groups.filter("forms > 1").drop("skeleton_low")
