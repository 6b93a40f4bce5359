"""Cleaning from raw splits to published ones: normalize, filter, deduplicate, resolve leakage, report, publish."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import CleaningConfig
from corpusloom.functions import text as T
from corpusloom.operators import dedup, neardup, quality, splits, stats
from corpusloom.session import checkpoint, ship
from corpusloom.sources import pairs as sources
from corpusloom.sources import paths, sinks


def clean(pairs: DataFrame, config: CleaningConfig) -> dict[str, DataFrame]:
    """Stages over rows (split, row_ord, article, summary, …): keyed, decided, unique, distant, resolved.

    Near-duplicates go before leakage is resolved, test first unless train has priority, also when re-splitting.
    """
    rules = quality.QualityRules(config.min_article_words, config.min_summary_words, config.max_summary_ratio)
    keyed = quality.with_keys(pairs, config.remove_repeated_sentences, config.min_repeated_sentence_chars)
    decided = checkpoint(quality.quality_reasons(keyed, rules))
    keys = ["article_key"] if config.dedupe_by == "article" else ["article_key", "summary_key"]
    kept = decided.filter("reason is null")
    unique = dedup.keep_first(kept, ["split", *keys], ["split", "row_ord"])
    priority = splits.TRAIN_FIRST if config.leakage_policy == "train-priority" else splits.TEST_FIRST
    distant = checkpoint(neardup.remove_near_duplicates(unique, config.near_duplicate_threshold, priority))
    resolved = splits.resolve_leakage(distant, config.leakage_policy, keys, config.train_ratio, config.validation_ratio)
    return {"decided": decided, "unique": unique, "distant": distant, "resolved": checkpoint(resolved)}


def near_examples(unique: DataFrame, config: CleaningConfig) -> list[dict[str, Any]]:
    """The first dropped near-duplicates with the text that was kept, each with its split and row."""
    if config.near_duplicate_threshold <= 0:
        return []
    priority = splits.TRAIN_FIRST if config.leakage_policy == "train-priority" else splits.TEST_FIRST
    return [r.asDict() for r in neardup.near_duplicate_examples(unique, config.near_duplicate_threshold, priority).collect()]


def report(stages: dict[str, DataFrame], config: CleaningConfig) -> dict[str, Any]:
    """Counts of every stage by split, overlaps before and after, and length statistics; a few rows each."""
    by = lambda frame: {r["split"]: r["count"] for r in frame.groupBy("split").count().collect()}
    decided = stages["decided"]
    rejected: dict[str, dict[str, int]] = {}
    for r in quality.reject_counts(decided).collect():
        rejected.setdefault(r["split"], {})[r["reason"]] = r["rows"]
    out = {
        "config": vars(config),
        "input_rows": by(decided),
        "dropped_quality": rejected,
        "normalized": {r["split"]: r.asDict() for r in quality.normalized_counts(decided).collect()},
        "after_exact_duplicates": by(stages["unique"]),
        "after_near_duplicates": by(stages["distant"]),
        "near_duplicate_examples": near_examples(stages["unique"], config),
        "overlap_before": splits.overlap_counts(stages["distant"]).first().asDict(),
        "overlap_after": splits.overlap_counts(stages["resolved"]).first().asDict(),
        "articles_with_multiple_summaries": stats.summary_conflicts(stages["unique"]).first()["conflicts"],
        "output_rows": by(stages["resolved"]),
        "output_length_statistics": [r.asDict() for r in stats.length_statistics(stages["resolved"]).collect()],
    }
    if any(out["overlap_after"].values()):
        raise RuntimeError(f"splits still share articles: {out['overlap_after']}")
    return out


def run(spark: SparkSession, source: str, output: str, config: CleaningConfig) -> dict[str, Any]:
    """Read a folder, clean it and publish splits with a report; with audit_only the report alone."""
    ship(spark)
    if problems := config.problems():
        raise ValueError("; ".join(problems))
    layout = sources.detect_layout(source) if config.layout == "auto" else config.layout
    if layout == "split":
        sources.check_file_selection(source, config.pattern)
        files = sources.split_files(source, config.pattern)
    else:
        files = sources.flat_files(source)
    rows = sources.read_labelled(spark, files)
    sinks.check_output(output, [source])
    stages = clean(rows, config)
    found = report(stages, config)
    if not (found["output_rows"].get("train") and found["output_rows"].get("validation")):
        raise ValueError("no training or validation rows are left")
    fmt = config.output_format
    if fmt == "auto":
        fmt = sinks.infer_format([f for own in files.values() for f in own])

    def write(folder: str) -> None:
        if not config.audit_only:
            sinks.write_splits(stages["resolved"], folder, fmt)
        sinks.save_json(found, f"{folder}/cleaning_report.json")

    sinks.publish(output, write)
    return found


def split_flat(pairs: DataFrame, train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """A flat table with the split of each row, by the bucket of the key of its normalized article."""
    key = T.canonical_key(T.normalize_text(F.col("article")))
    return pairs.withColumn("split", splits.assign_split(key, train, validation))


def run_two(spark: SparkSession, source: str, output: str, variant: str, config: CleaningConfig, unused: tuple[str, ...] = ()) -> dict[str, Any]:
    """Clean the Parquet splits of a flat folder and one of its CSV files, split by hash, into parquet/ and medical/.

    The other CSV files are alternate forms of the same texts and are listed as skipped, but for the unused ones.
    """
    ship(spark)
    sinks.check_output(output, [source])
    files = {f.rpartition("/")[2]: f for f in paths.glob(source, "*.csv")}
    if variant not in files:
        raise FileNotFoundError(f"{source} has no {variant}")
    flat = split_flat(sources.read_files(spark, [files[variant]]), config.train_ratio, config.validation_ratio)
    tables = {"parquet": sources.read_flat_layout(spark, source), "medical": flat}
    reports = {}
    with sinks.Staged(output) as folder:
        for name, rows in tables.items():
            stages = clean(rows, config)
            reports[name] = report(stages, config) | {"staged_rows": rows.groupBy("split").count().toPandas().set_index("split")["count"].to_dict()}
            if not config.audit_only:
                sinks.write_splits(stages["resolved"], f"{folder}/{name}", "parquet" if name == "parquet" else "csv")
        manifest = {
            "layout": "original", "input_dir": source, "output_dir": output, "medical_variant": variant,
            "not_used": [n for n in unused if n in files], "skipped_transformed_variants": sorted(set(files) - {variant, *unused}), "datasets": reports,
        }
        sinks.save_json(manifest, f"{folder}/cleaning_manifest.json")
    return manifest
