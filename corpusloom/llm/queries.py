"""Queries of the training-data problems over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import areas, defects, leaks, levels, lookalikes, neardup, overlap, packing, sentences

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs, members = neardup.near_duplicates(_table(spark, folder, "train"), threshold=0.5)
    return neardup.all_pairs(pairs, members).toDF("pair_id_a", "pair_id_b")


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicate_groups(_table(spark, folder, "train"), threshold=0.8).withColumnRenamed("id", "pair_id")


def _areas(spark: SparkSession, folder: str) -> DataFrame:
    return areas.subject_areas(_table(spark, folder, "train"), _table(spark, folder, "subject_areas"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _areas(spark, folder).select("pair_id", "area_code")


def p4_composition(spark: SparkSession, folder: str) -> DataFrame:
    found = _areas(spark, folder).join(_table(spark, folder, "train").select("pair_id", "outlet"), "pair_id")
    return found.groupBy("outlet", "area_code").agg(F.count("*").alias("records"), F.avg("share").alias("mean_share"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return defects.defective_pairs(_table(spark, folder, "train"))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    found = p5_found(spark, folder).join(_table(spark, folder, "train").select("pair_id", "outlet"), "pair_id")
    return found.groupBy("outlet", "defect").agg(F.count("*").alias("records"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.unlike_fields(_table(spark, folder, "train"))


def p6_plain(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.plain_texts(_table(spark, folder, "train").select("pair_id", "article", "summary"))


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.skeleton_groups(_table(spark, folder, "train"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentence_units(_table(spark, folder, "train"))


def _held_out(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: _table(spark, folder, name) for name in ("validation", "test")}


def _overlaps(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.cross_split_overlaps(_table(spark, folder, "train"), _held_out(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _overlaps(spark, folder).filter("kind <> 'short'").select("split_name", "train_id", "eval_id")


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlap_report(_overlaps(spark, folder), _held_out(spark, folder))


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), _table(spark, folder, "containers"))


def p7_filling(spark: SparkSession, folder: str) -> DataFrame:
    return packing.filling_report(p7_packed(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_items(_table(spark, folder, "documents"), _table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leak_report(p8_found(spark, folder), _table(spark, folder, "eval_items"))


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    tables = (_table(spark, folder, name) for name in ("documents", "level_samples", "eval_items"))
    return levels.reading_levels(*tables)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder).select("doc_id", "reading_level")


def p9_profile(spark: SparkSession, folder: str) -> DataFrame:
    graded = _levels(spark, folder).join(_table(spark, folder, "documents").select("doc_id", "source"), "doc_id")
    return graded.groupBy("source", "reading_level").agg(F.count("*").alias("documents"), F.avg("grade").alias("mean_grade"))


def p9_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return levels.level_accuracy(_table(spark, folder, "level_samples"))


def queries() -> dict[str, Query]:
    return {name: value for name, value in globals().items() if name[0] == "p" and name[1:2].isdigit()}
