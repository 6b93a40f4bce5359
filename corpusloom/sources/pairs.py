"""Sources of article/summary pairs: files with column aliases, split layouts, and the tables of this project."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources import paths

# Accepted names, first match in this order.
ARTICLE_ALIASES = ("article", "document", "source", "text")
SUMMARY_ALIASES = ("summary", "sumary", "target", "abstract")
SPLITS = ("train", "validation", "test")
CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def find_column(columns: list[str], aliases: tuple[str, ...]) -> str:
    """The column of the best alias; case and padding of headers ignored, the last of equal headers wins."""
    order = {alias: place for place, alias in enumerate(aliases)}
    folded = [c.strip().casefold() for c in columns]
    ranked = [(order[name], -place) for place, name in enumerate(folded) if name in order]
    if not ranked:
        raise ValueError(f"none of {', '.join(aliases)} among the columns {columns}")
    return columns[-min(ranked)[1]]


def _suffix(path: str) -> str:
    suffix = "." + path.rpartition(".")[2].casefold()
    if suffix not in (".csv", ".parquet", ".pq"):
        raise ValueError(f"neither CSV nor Parquet: {path}")
    return suffix


def read_pairs(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """article, summary, _source_file, _source_row of one CSV or Parquet file; strict: no aliases."""
    if _suffix(path) == ".csv":
        raw = spark.read.options(**CSV).csv(path)
        row: Column = F.monotonically_increasing_id()  # a multi-line file is one partition, in order
    else:
        raw = spark.read.parquet(path)
        row = F.col("_metadata.row_index")
    if strict:
        missing = [c for c in ("article", "summary") if c not in raw.columns]
        if missing:
            raise ValueError(f"{path} lacks {missing}; it has {raw.columns}")
        article, summary = "article", "summary"
    else:
        article, summary = find_column(raw.columns, ARTICLE_ALIASES), find_column(raw.columns, SUMMARY_ALIASES)
    return raw.select(
        F.col(f"`{article}`").cast("string").alias("article"),
        F.col(f"`{summary}`").cast("string").alias("summary"),
        F.lit(str(path)).alias("_source_file"),
        row.cast("bigint").alias("_source_row"),
    ).fillna("", ["article", "summary"])


def empty_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "article string, summary string, _source_file string, _source_row bigint")


def read_files(spark: SparkSession, files: list[str], strict: bool = False) -> DataFrame:
    """Files in order, with the ordinal ``row_ord`` of (file, row); CSV files come before Parquet files if mixed."""
    if not files:
        return empty_pairs(spark).withColumn("row_ord", F.lit(0).cast("bigint"))
    ranked = sorted(files, key=lambda f: (_suffix(f) != ".csv", f))
    frames = [read_pairs(spark, f, strict).withColumn("row_ord", F.lit(k << 40) + F.col("_source_row")) for k, f in enumerate(ranked)]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def resolve_files(folder: str, pattern: str) -> list[str]:
    found = paths.glob(folder, pattern)
    if not found:
        raise FileNotFoundError(f"no file for {pattern} in {folder}")
    return found


def read_labelled(spark: SparkSession, files: dict[str, list[str]]) -> DataFrame:
    """The files of every split as one frame with ``split``."""
    return reduce(DataFrame.unionByName, [read_files(spark, own).withColumn("split", F.lit(split)) for split, own in files.items()])


def split_files(folder: str, pattern: str) -> dict[str, list[str]]:
    """The files of train/, validation/ and test/ of a folder; a missing folder has none."""
    return {split: paths.glob(f"{folder}/{split}", pattern) for split in SPLITS}


def flat_files(folder: str) -> dict[str, list[str]]:
    """The train*, valid* and test* Parquet files of a flat folder; train and validation must be there."""
    found = {split: paths.glob(folder, f"{start}*.parquet") for split, start in zip(SPLITS, ("train", "valid", "test"), strict=True)}
    for split in SPLITS[:2]:
        if not found[split]:
            raise FileNotFoundError(f"no {split} files in {folder}")
    return found


def read_split_layout(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    return read_labelled(spark, split_files(folder, pattern))


def read_flat_layout(spark: SparkSession, folder: str) -> DataFrame:
    return read_labelled(spark, flat_files(folder))


def detect_layout(folder: str) -> str:
    """'split' if train/ and validation/ exist, else 'original'."""
    return "split" if all(paths.is_folder(f"{folder}/{s}") for s in SPLITS[:2]) else "original"


def check_file_selection(folder: str, pattern: str) -> None:
    """At most one CSV per split, and of the same name in all splits."""
    variants = {s: [f.rpartition("/")[2] for f in own if f.casefold().endswith(".csv")] for s, own in split_files(folder, pattern).items()}
    for split, names in variants.items():
        if len(names) > 1:
            raise ValueError(f"{split} has more than one CSV variant: {names}")
    if len(names := set(sum(variants.values(), []))) > 1:
        raise ValueError(f"splits have different CSV variants: {sorted(names)}")


def find_split_file(folder: str, split: str) -> str:
    """The one file named ``{split}_*.*``."""
    found = paths.glob(folder, f"{split}_*.*")
    if len(found) != 1:
        raise ValueError(f"one file for {split} expected in {folder}, found {len(found)}")
    return found[0]


def resolve_data_path(path: str, folders: tuple[str, ...] = ()) -> str:
    """An absolute path as it is, else the first that exists under the working directory or the folders."""
    if path.startswith("/") or "://" in path:
        return path
    for base in (".", *folders):
        if paths.exists(f"{base}/{path}"):
            return paths.absolute(f"{base}/{path}").removeprefix("file:")
    raise FileNotFoundError(path)


def find_by_content(spark: SparkSession, pattern: str, sha256: str) -> DataFrame:
    """path of the files whose content has the hash; files are hashed where they are read."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.filter(F.sha2("content", 256) == sha256).select("path").orderBy("path")


def project_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The project's three tables as one frame, in one scan: split, row_ord, article, summary, outlet, lineage."""
    files = spark.read.parquet(*(f"{folder}/{split}.parquet" for split in SPLITS))
    split = F.regexp_extract("_metadata.file_path", rf"/({'|'.join(SPLITS)})\.parquet", 1)
    return files.select(
        split.alias("split"), F.col("pair_id").alias("row_ord"), "article", "summary", "outlet", "_source_file", "_source_row"
    )
