"""Domain filter: kept splits and an audit of what was excluded, validated before they are published."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import classify, dedup, splits
from corpusloom.session import checkpoint, ship
from corpusloom.sources import pairs as sources
from corpusloom.sources import sinks


def validate(kept: DataFrame) -> dict[str, Any]:
    """Overlaps on the punctuation-blind text, blank rows and duplicate pairs of the kept rows."""
    rows = kept.withColumn("article_key", T.matching_text(F.col("article"))).withColumn("summary_key", T.matching_text(F.col("summary")))
    blank = rows.filter((F.trim("article") == "") | (F.trim("summary") == "")).count()
    copies = dedup.duplicate_counts(rows, ["split"], ["article", "summary"])
    return {
        "overlap": splits.overlap_counts(rows).first().asDict(),
        "empty_rows": blank,
        "duplicate_pairs": {r["split"]: r["duplicates"] for r in copies.collect()},
    }


def run(spark: SparkSession, source: str, output: str, audit: str, lexicon: DataFrame) -> dict[str, Any]:
    """Classify {split}_*.* files of a folder; kept rows go to output, excluded ones with reasons to audit."""
    ship(spark)
    sinks.check_output(output, [source])
    sinks.check_output(audit, [source])
    rows, inputs = None, {}
    for split in sources.SPLITS:
        path = sources.find_split_file(source, split)
        # hashed where it is read; binaryFile gives the whole file to one task
        digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
        inputs[split] = {"input_file": path.rpartition("/")[2], "input_sha256": digest}
        frame = sources.read_pairs(spark, path, strict=True).withColumn("split", F.lit(split))
        rows = frame if rows is None else rows.unionByName(frame)
    decided = checkpoint(classify.classify(rows.select("split", "article", "summary"), lexicon))
    rates = [r.asDict() for r in classify.keep_rates(decided).collect()]
    report = {
        "inputs": inputs,
        "splits": rates,
        "totals": next((r for r in rates if r["split"] is None), None),
        "reasons": [r.asDict() for r in classify.decision_counts(decided).orderBy("split", "keep", "reason").collect()],
        "validation": validate(decided.filter("keep")),
    }
    columns = ["split", "keep", "reason", "score", "summary_evidence", "article_support_score", "article", "summary"]
    # both are written before either is published, so a failure leaves neither
    with sinks.Staged(output) as kept, sinks.Staged(audit) as excluded:
        sinks.write_splits(decided.filter("keep"), kept, "csv")
        decided.filter("not keep").select(*columns).write.option("header", "true").option("escape", '"').csv(f"{excluded}/excluded.csv")
        sinks.save_json(report, f"{excluded}/filter_report.json")
    return report
