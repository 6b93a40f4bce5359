"""Registered queries over the project's tables: one for each operator, over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import classify, dedup, evaluation, inference, lexicon, neardup, quality, rouge, splits, stats
from corpusloom.plans import oracle
from corpusloom.session import ship
from corpusloom.sources.pairs import project_pairs

Query = Callable[[SparkSession, str], DataFrame]


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return project_pairs(spark, folder)


def _keyed(spark: SparkSession, folder: str) -> DataFrame:
    return quality.with_keys(_pairs(spark, folder).select("split", "row_ord", "article", "summary"))


def _kept(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_reasons(_keyed(spark, folder)).filter("reason is null").drop("reason")


def normalize_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _keyed(spark, folder).select("row_ord", "article", "summary", "article_changed", "summary_changed")


def canonical_keys(spark: SparkSession, folder: str) -> DataFrame:
    return _keyed(spark, folder).select("row_ord", "article_key", "summary_key")


def text_identities(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("summary")
    return _pairs(spark, folder).select("row_ord", T.matching_text(s).alias("matching"), T.manifest_key(s).alias("manifest"), T.clean_text(s).alias("clean"))


def word_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _keyed(spark, folder).select("row_ord", "article_words", "summary_words")


def normalized_counts(spark: SparkSession, folder: str) -> DataFrame:
    return quality.normalized_counts(_keyed(spark, folder))


def strip_markup(spark: SparkSession, folder: str) -> DataFrame:
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    return documents.select("doc_id", T.strip_markup(F.col("text")).alias("text"))


def quality_decisions(spark: SparkSession, folder: str, ratio: float = 1.0) -> DataFrame:
    rules = quality.QualityRules(max_summary_ratio=ratio)
    decided = quality.quality_reasons(_keyed(spark, folder), rules)
    return decided.select("split", "row_ord", F.coalesce("reason", F.lit("kept")).alias("reason"))


def reject_reason_counts(spark: SparkSession, folder: str) -> DataFrame:
    return quality.reject_counts(quality.quality_reasons(_keyed(spark, folder)))


def dedup_first(spark: SparkSession, folder: str, keys: tuple[str, ...]) -> DataFrame:
    return dedup.first_ordinals(_kept(spark, folder), ["split", *keys], ["split", "row_ord"])


def duplicate_counts(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.duplicate_counts(_kept(spark, folder), ["split"], ["article_key"])


def reloaded_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = _pairs(spark, folder)
    return dedup.duplicate_counts(rows, ["split"], ["_source_file", "_source_row"])


def split_overlap_counts(spark: SparkSession, folder: str) -> DataFrame:
    return splits.overlap_counts(_kept(spark, folder))


def leakage(spark: SparkSession, folder: str, policy: str) -> DataFrame:
    return splits.resolve_leakage(_kept(spark, folder), policy, ["article_key"]).select("split", "row_ord")


def hash_buckets(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("article_key")
    return _keyed(spark, folder).select("row_ord", T.stable_bucket(key).alias("bucket"), splits.assign_split(key).alias("split"))


def resplit_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = splits.resplit(_kept(spark, folder), ["article_key", "summary_key"])
    return out.select("row_ord", "input_split", "split")


def split_row_counts(spark: SparkSession, folder: str) -> DataFrame:
    assigned = _keyed(spark, folder).select(splits.assign_split(F.col("article_key")).alias("split"))
    return assigned.groupBy("split").agg(F.count("*").alias("rows"))


def length_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return stats.length_statistics(_keyed(spark, folder))


def summary_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return stats.summary_conflicts(_keyed(spark, folder))


def dataset_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return stats.dataset_manifest(_pairs(spark, folder))


def head_cap(spark: SparkSession, folder: str) -> DataFrame:
    return stats.head_cap(_pairs(spark, folder), {"train": 500, "validation": 50, "test": None}).select("split", "row_ord")


def sentence_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = _keyed(spark, folder).select("row_ord", T.split_sentences(F.col("article")).alias("s"))
    return rows.select("row_ord", F.posexplode("s").alias("place", "sentence")).withColumn("place", F.col("place").cast("bigint"))


def _without_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.remove_repeated_sentences(_keyed(spark, folder).select("split", "row_ord", "article"))


def repeated_sentence_removal(spark: SparkSession, folder: str) -> DataFrame:
    return _without_repeats(spark, folder).select("row_ord", "article", "sentences_removed")


def repeated_sentence_counts(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.repeated_sentence_counts(_without_repeats(spark, folder))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.distinct_texts(_keyed(spark, folder))


def shingle_counts(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.with_shingles(_texts(spark, folder)).select(F.col("first.row_ord").alias("row_ord"), F.col("n").cast("bigint").alias("shingles"))


def bottom_k_signature(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.with_shingles(_texts(spark, folder)).select(F.col("first.row_ord").alias("row_ord"), T.bottom_k(F.col("sh")).alias("signature"))


def near_dup_pairs(spark: SparkSession, folder: str) -> DataFrame:
    found = neardup.similar_keys(_keyed(spark, folder), 0.8)
    return found.select(F.col("first_a.row_ord").alias("row_a"), F.col("first_b.row_ord").alias("row_b"), F.round("likeness", 6).alias("likeness"))


def near_dup_survivors(spark: SparkSession, folder: str) -> DataFrame:
    kept = _kept(spark, folder).select("split", "row_ord", "article_key")
    return neardup.remove_near_duplicates(kept, 0.8).select("split", "row_ord")


def near_dup_examples(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicate_examples(_kept(spark, folder), 0.8)  # the feature is the first 20 of them


def _demo(spark: SparkSession, folder: str) -> DataFrame:
    return classify.classify(_pairs(spark, folder).select("split", "row_ord", "article", "summary"), lexicon.demo_lexicon(spark))


def lexicon_hits(spark: SparkSession, folder: str) -> DataFrame:
    terms = lexicon.load_lexicon(lexicon.demo_lexicon(spark))
    rows = _pairs(spark, folder).select("row_ord", T.matching_text(F.col("summary")).alias("m"))
    found = lexicon.collect_evidence(rows, "m", terms, "s_", lexicon.EVIDENCE)
    by_category = F.array(*(F.struct(F.lit(c).alias("category"), F.col(f"s_{c}").alias("terms")) for c in lexicon.EVIDENCE))
    hits = found.select(F.explode(by_category).alias("h")).select("h.category", F.explode("h.terms").alias("term"))
    return hits.groupBy("category", "term").agg(F.count("*").alias("rows"))


def evidence_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _demo(spark, folder).select("row_ord", "score", "article_support_score")


def domain_classify(spark: SparkSession, folder: str) -> DataFrame:
    return _demo(spark, folder).select("row_ord", "keep", "reason", "summary_evidence")


def exclusion_audit_counts(spark: SparkSession, folder: str) -> DataFrame:
    return classify.decision_counts(_demo(spark, folder))


def keep_rates(spark: SparkSession, folder: str) -> DataFrame:
    out = classify.keep_rates(_demo(spark, folder))
    return out.withColumn("split", F.coalesce("split", F.lit("all")))


def _predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Prediction: the first 30 words of the article."""
    rows = _keyed(spark, folder).select("split", "row_ord", "article", F.col("summary").alias("reference"))
    return rows.withColumn("prediction", F.array_join(F.slice(T.split_words(F.col("article")), 1, 30), " "))


def rouge_n_rows(spark: SparkSession, folder: str, n: int) -> DataFrame:
    scored = rouge.rouge_rows(_predictions(spark, folder), with_l=False)
    return scored.select("row_ord", F.round(f"rouge{n}", 6).alias(f"rouge{n}"))


def rouge_l_rows(spark: SparkSession, folder: str) -> DataFrame:
    return rouge.rouge_rows(_predictions(spark, folder)).select("row_ord", F.round("rougeL", 6).alias("rougeL"))


def rouge_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return rouge.rouge_corpus(rouge.rouge_rows(_predictions(spark, folder)), ("split",))


def prediction_export(spark: SparkSession, folder: str) -> DataFrame:
    made = _predictions(spark, folder).withColumnRenamed("row_ord", "index")
    return evaluation.prediction_records(made.select("index", "reference", "prediction"), made.filter("split <> 'test'").select("index", "article"))


def run_leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    scores = rouge_corpus(spark, folder)
    return evaluation.leaderboard(scores.select(F.col("split").alias("run"), "rouge1", "rouge2", "rougeL"))


def model_delta(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.model_delta(run_leaderboard(spark, folder), "validation", "test")


def metric_files(spark: SparkSession, folder: str) -> DataFrame:
    """Which metrics file counts for a run, runs and files made from orders."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    names = F.array(*map(F.lit, (*reversed(evaluation.METRIC_FILES), "train_results.json")))
    file = F.element_at(names, (F.pmod("o_custkey", F.lit(4)) + 1).cast("int"))
    runs = F.concat(F.lit("run"), F.pmod("o_orderkey", F.lit(997)).cast("string"))
    return evaluation.first_metric_file(orders.select(runs.alias("run"), file.alias("file")))


def score_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of runs by the first prefix present, runs and names made from orders."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    pick = lambda column, names: F.element_at(F.array(*map(F.lit, names)), (F.pmod(column, F.lit(len(names))) + 1).cast("int"))
    name = F.concat(pick("o_custkey", evaluation.PREFIXES), pick("o_orderkey", evaluation.SCORES))
    runs = F.concat(F.lit("run"), F.pmod("o_orderkey", F.lit(997)).cast("string"))
    return evaluation.coalesce_scores(orders.select(runs.alias("run"), name.alias("name"), F.pmod("o_custkey", F.lit(100)).cast("double").alias("value")))


def durations(spark: SparkSession, folder: str) -> DataFrame:
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    return orders.select("o_orderkey", T.format_duration(F.pmod("o_orderkey", F.lit(9000))).alias("took"))


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/orders.parquet")
    ids = F.array(*((F.pmod(F.col("o_orderkey") * m, F.lit(401)) - 20).cast("int") for m in (1, 3, 7, 11)))
    return rows.select("o_orderkey", evaluation.sanitize_tokens(ids, 300).alias("ids"))


def token_sanitize(spark: SparkSession, folder: str) -> DataFrame:
    return _tokens(spark, folder).select("o_orderkey", F.array_join("ids", ",").alias("ids"))


def generation_length(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.generated_length(_tokens(spark, folder), "ids")


def prefix_inputs(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select("row_ord", inference.prefixed(F.col("article")).alias("input"))


def compression_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return _keyed(spark, folder).select("row_ord", inference.compression_ratio(F.col("article"), F.col("summary")).alias("saved"))


def tokenize_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = inference.tokenize(_pairs(spark, folder).select("row_ord", "article", "summary"), inference.byte_tokenizer, "article", "input_ids", 768)
    rows = inference.tokenize(rows, inference.byte_tokenizer, "summary", "labels", 160)
    return rows.select("row_ord", F.size("input_ids").cast("bigint").alias("inputs"), F.size("labels").cast("bigint").alias("labels"))


def summarize_batch(spark: SparkSession, folder: str) -> DataFrame:
    rows = _keyed(spark, folder).select("row_ord", "article")
    return inference.summarize(rows, inference.LeadSummarizer).select("row_ord", "prediction")


def queries() -> dict[str, Query]:
    named = (
        normalize_documents, canonical_keys, text_identities, word_counts, normalized_counts, strip_markup, quality_decisions,
        reject_reason_counts, duplicate_counts, reloaded_rows, split_overlap_counts, hash_buckets, resplit_dedup, split_row_counts,
        length_statistics, summary_conflicts, dataset_manifest, head_cap, sentence_split, repeated_sentence_removal,
        repeated_sentence_counts, shingle_counts, bottom_k_signature, near_dup_pairs, near_dup_survivors, near_dup_examples,
        lexicon_hits, evidence_scores, domain_classify, exclusion_audit_counts, keep_rates, rouge_corpus, prediction_export,
        run_leaderboard, model_delta, token_sanitize, generation_length, prefix_inputs, compression_ratio, tokenize_pairs,
        summarize_batch, metric_files, score_prefixes, durations,
    )
    found: dict[str, Query] = {f.__name__: f for f in named}
    found |= {
        "quality_max_ratio": partial(quality_decisions, ratio=0.3),
        "dedup_pair_first": partial(dedup_first, keys=("article_key", "summary_key")),
        "dedup_article_first": partial(dedup_first, keys=("article_key",)),
        "leakage_test_priority": partial(leakage, policy="test-priority"),
        "leakage_train_priority": partial(leakage, policy="train-priority"),
        "rouge1_rows": partial(rouge_n_rows, n=1),
        "rouge2_rows": partial(rouge_n_rows, n=2),
        "rougeL_rows": rouge_l_rows,
    }
    return found


def oracle_sql() -> dict[str, str]:
    return oracle.statements()
