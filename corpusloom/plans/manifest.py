"""Dataset manifest of a folder with train.csv, validation.csv and test.csv: hashes, sizes, overlaps, and its gates."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import splits, stats
from corpusloom.session import session, ship
from corpusloom.sources import files, paths
from corpusloom.sources import pairs as sources


def _is_dataset(folder: str) -> bool:
    """Whether a folder holds all three files, each with both columns in its header."""
    files = [f"{folder}/{s}.csv" for s in sources.SPLITS]
    if not all(map(paths.exists, files)):
        return False
    spark = SparkSession.getActiveSession() or session()
    return all({"article", "summary"} <= set(spark.read.option("header", "true").csv(f).columns) for f in files)


def find_dataset(candidates: list[str]) -> str:
    """The one folder that holds the data set."""
    found = [c for c in candidates if _is_dataset(c)]
    if len(found) != 1:
        raise FileNotFoundError(f"one dataset folder expected, found {found}")
    return found[0]


def build(spark: SparkSession, folder: str, strict: bool = True) -> dict[str, Any]:
    """The manifest; strict: blank rows, repeated articles or shared articles are errors."""
    ship(spark)
    rows = None
    for split in sources.SPLITS:
        frame = sources.read_pairs(spark, f"{folder}/{split}.csv", strict=True).withColumn("split", F.lit(split))
        rows = frame if rows is None else rows.unionByName(frame)
    table = {r["split"]: r.asDict() for r in stats.dataset_manifest(rows).collect()}
    overlap = splits.overlap_counts(rows.withColumn("article_key", T.manifest_key(F.col("article")))).first().asDict()
    for split, row in table.items():
        path = f"{folder}/{split}.csv"
        row |= {"file": Path(path).name, "sha256": files.sha256_file(path)}
    if strict:
        bad = [s for s, r in table.items() if r["empty_rows"] or r["duplicate_articles"]]
        if bad or any(overlap.values()):
            raise ValueError(f"blank or repeated rows in {bad}; overlaps {overlap}")
    return {"columns": ["article", "summary"], "splits": table, "cross_split_article_overlap": overlap}
