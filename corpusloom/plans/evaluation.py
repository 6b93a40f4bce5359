"""Evaluation: predictions of a summarizer, their scores, and the files that tell of them."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from corpusloom.operators import evaluation, inference, rouge
from corpusloom.session import checkpoint
from corpusloom.sources import paths, sinks


def evaluate(
    rows: DataFrame, make: Callable[[], inference.Summarizer], output: str, split: str = "test", export: bool = True,
    encode: Callable = inference.byte_tokenizer, longest: int = 1 << 20,
) -> dict[str, Any]:
    """rows (index, article, reference) to predictions.jsonl, unless turned off, and {split}_metrics.json.

    gen_len is the mean number of tokens of a prediction, by the tokenizer that encode makes.
    """
    began = time.time()
    predicted = checkpoint(inference.summarize(rows, make))
    scored = rouge.rouge_rows(predicted.select("index", "prediction", "reference"))
    found = rouge.rouge_corpus(scored).first()
    tokens = inference.tokenize(predicted.select("prediction"), encode, "prediction", "ids", longest)
    length = evaluation.generated_length(tokens, "ids").first()["gen_len"]
    took = time.time() - began
    metrics = {f"{split}_{k}": found[k] for k in ("rouge1", "rouge2", "rougeL")}
    metrics |= {f"{split}_gen_len": length, f"{split}_runtime": round(took, 4), f"{split}_samples_per_second": round(found["rows"] / max(took, 1e-9), 3)}
    if export:
        sinks.write_jsonl(evaluation.prediction_records(predicted.select("index", "reference", "prediction"), rows), f"{output}/predictions.jsonl")
    sinks.save_json(metrics, f"{output}/{split}_metrics.json")
    return metrics


def summarize_runs(spark: SparkSession, folder: str) -> list[dict[str, Any]]:
    """Leaderboard of the run folders as CSV, Markdown and best_run.json; empty if there is no run."""
    board = evaluation.leaderboard(evaluation.coalesce_scores(evaluation.read_runs(spark, folder))).orderBy("place").drop("place")
    rows = [r.asDict() for r in board.collect()]
    if rows:
        lines = ["run,rouge1,rouge2,rougeL"] + [f"{r['run']},{r['rouge1']},{r['rouge2']},{r['rougeL']}" for r in rows]
        paths.write_text(f"{folder}/summary_results.csv", "\n".join(lines) + "\n")
        paths.write_text(f"{folder}/summary_results.md", evaluation.markdown_table(rows))
        sinks.save_json(rows[0], f"{folder}/best_run.json")
    return rows


def compare_models(base: dict[str, Any], tuned: dict[str, Any], folder: str, names: tuple[str, str] = ("base", "tuned"), split: str = "test") -> dict[str, Any]:
    """model_comparison.json and .csv of two metric dictionaries: scores, seconds, speed, and what the second gained."""
    columns = {**{k: k for k in evaluation.SCORES}, "runtime_seconds": "runtime", "samples_per_second": "samples_per_second"}
    rows = [{"model": n, **{c: m.get(f"{split}_{k}") for c, k in columns.items()}} for n, m in zip(names, (base, tuned), strict=True)]
    gained = {k: round(float(rows[1][k] or 0) - float(rows[0][k] or 0), 2) for k in evaluation.SCORES}
    out = {"models": rows, f"{names[1]}_minus_{names[0]}": gained}
    sinks.save_json(out, f"{folder}/model_comparison.json")
    table = [",".join(rows[0])] + [",".join("" if v is None else str(v) for v in r.values()) for r in rows]
    paths.write_text(f"{folder}/model_comparison.csv", "\n".join(table) + "\n")
    return out
