"""Evaluation records: token sanitation, generated lengths, predictions, leaderboards and deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources import paths, sinks

# Files and prefixes in the order they are looked for.
METRIC_FILES = ("eval_results.json", "validation_metrics.json", "test_metrics.json")
PREFIXES = ("eval_", "validation_", "test_", "")
SCORES = ("rouge1", "rouge2", "rougeL")


def sanitize_tokens(ids: Column, vocabulary: int, pad: int = 0) -> Column:
    """Ids below 0 (the ignored label among them) or beyond the vocabulary become the pad id."""
    return F.transform(ids, lambda x: F.when((x < 0) | (x >= vocabulary), F.lit(pad)).otherwise(x))


def generated_length(rows: DataFrame, ids: str, pad: int = 0) -> DataFrame:
    """(rows, gen_len): mean number of tokens that are not padding, one digit."""
    n = F.size(F.filter(F.col(ids), lambda x: x != pad))
    return rows.agg(F.count("*").alias("rows"), F.round(F.avg(n), 1).alias("gen_len"))


def prediction_records(predictions: DataFrame, sources: DataFrame) -> DataFrame:
    """(index, article, reference, prediction) by ordinal; an article that is missing is empty."""
    joined = predictions.join(sources.select("index", "article"), "index", "left")
    return joined.select("index", F.coalesce("article", F.lit("")).alias("article"), "reference", "prediction")


def coalesce_scores(metrics: DataFrame) -> DataFrame:
    """run and scores of metric rows in long form (run, name, value): the first prefix present, else 0."""
    out = []
    for score in SCORES:
        picks = [F.max(F.when(F.col("name") == f"{p}{score}", F.col("value"))) for p in PREFIXES]
        out.append(F.coalesce(*picks, F.lit(0.0)).alias(score))
    return metrics.groupBy("run").agg(*out)


def first_metric_file(files: DataFrame) -> DataFrame:
    """(run, file) of the first known metric file of every run, from rows (run, file)."""
    rank = F.array_position(F.array(*map(F.lit, METRIC_FILES)), F.col("file"))
    return files.filter(rank > 0).groupBy("run").agg(F.min_by("file", rank).alias("file"))


def leaderboard(scores: DataFrame) -> DataFrame:
    """Runs by rougeL, best first, then by name; adds the place."""
    from pyspark.sql.window import Window

    order = Window.orderBy(F.desc("rougeL"), F.asc("run"))  # one row a run
    return scores.withColumn("place", F.row_number().over(order).cast("bigint"))


def model_delta(scores: DataFrame, base: str, tuned: str, digits: int = 2) -> DataFrame:
    """(metric, base, tuned, delta) of two runs."""
    stack = ", ".join(f"'{s}', {s}" for s in SCORES)
    long = scores.selectExpr("run", f"stack({len(SCORES)}, {stack}) as (metric, value)")
    pick = lambda run: F.max(F.when(F.col("run") == run, F.col("value")))
    both = long.filter(F.col("run").isin(base, tuned)).groupBy("metric").agg(pick(base).alias("base"), pick(tuned).alias("tuned"))
    return both.withColumn("delta", F.round(F.col("tuned") - F.col("base"), digits))


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics in long form (run, name, value) of the first metric file of each run folder."""
    rows = []
    for run in sorted(paths.listing(folder)):  # one row a run and metric: runs are few
        held = set(paths.listing(f"{folder}/{run}")) if paths.is_folder(f"{folder}/{run}") else set()
        if name := next((n for n in METRIC_FILES if n in held), None):
            data = sinks.load_json(f"{folder}/{run}/{name}")
            rows += [(run, k, float(v)) for k, v in data.items() if isinstance(v, int | float) and not isinstance(v, bool)]
    return spark.createDataFrame(rows, "run string, name string, value double")


def markdown_table(board: list) -> str:
    """A leaderboard as Markdown, two decimals."""
    lines = ["| Run | ROUGE-1 | ROUGE-2 | ROUGE-L |", "|-----|---------|---------|--------|"]
    lines += [f"| {r['run']} | {r['rouge1']:.2f} | {r['rouge2']:.2f} | {r['rougeL']:.2f} |" for r in board]
    return "\n".join(lines) + "\n"
