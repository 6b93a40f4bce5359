"""Domain classification: evidence of article and summary, a weighted score and an ordered ladder of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.lexicon import collect_evidence, load_lexicon, medical_score, serialize_evidence

GENERIC_TREATMENT = "dùng thuốc"
# Anatomy terms any of which alone makes a text about human biology.
BIOLOGY_ANATOMY = ("âm đạo", "dương vật", "tử cung", "buồng trứng", "tinh hoàn")


def _has(category: str) -> Column:
    return F.size(f"s_{category}") > 0


def _meets(left: str, right: str) -> Column:
    return F.arrays_overlap(F.col(f"s_{left}"), F.col(right))


def predicates(rows: DataFrame, biology: tuple[str, ...] = BIOLOGY_ANATOMY) -> DataFrame:
    """Adds the derived predicates of the ladder as boolean columns."""
    h = _has
    specific = F.size(F.array_except("s_treatment", F.array(F.lit(GENERIC_TREATMENT)))) > 0
    generic = F.array_contains("s_treatment", GENERIC_TREATMENT)
    out = rows.withColumn("specific_treatment", specific)
    out = out.withColumn(
        "treatment_focus",
        specific | (generic & (h("disease") | h("clinical") | h("health_system") | h("human") | h("symptom"))),
    )
    out = out.withColumn("medical_core", h("disease") | F.col("treatment_focus"))
    care = h("clinical") | h("health_system") | h("symptom")
    zoonotic = (F.size("s_human_zoonotic") > 0) & _meets("disease", "s_human_zoonotic") & (h("human") | care)
    exposure = (F.size("s_human_exposure") > 0) & (h("treatment") | care)
    person = h("human") & (
        h("treatment") | h("clinical") | h("prevention") | h("symptom") | (h("disease") & h("health_system"))
    )
    out = out.withColumn("human_medical", zoonotic | exposure | person)
    out = out.withColumn(
        "clinical_focus", h("clinical") & (h("symptom") | h("anatomy") | (h("human") & (F.size("s_clinical") >= 2)))
    )
    out = out.withColumn("biomedical_research", h("research") & (h("disease") | h("treatment") | h("anatomy")))
    core = _meets("anatomy", "s_core_research_anatomy")
    out = out.withColumn(
        "translational",
        F.col("biomedical_research") & (h("disease") | h("treatment") | ((h("human") | (F.size("a_human") > 0)) & core)),
    )
    out = out.withColumn("symptom_focus", (F.size("s_symptom") >= 2) & ~h("lifestyle") & ~h("deceptive_health"))
    out = out.withColumn(
        "healthcare_focus",
        h("health_system") & (F.col("medical_core") | h("clinical") | h("symptom") | h("prevention") | h("research")),
    )
    out = out.withColumn(
        "preventive_health",
        h("prevention") & (h("disease") | h("clinical") | h("health_system") | h("anatomy") | h("symptom")),
    )
    named = F.arrays_overlap("s_anatomy", F.array(*map(F.lit, biology)))
    out = out.withColumn(
        "human_biology",
        h("anatomy") & (h("human") | h("research") | h("health_system") | (F.size("s_anatomy") >= 2) | named),
    )
    support = F.least(F.lit(6), F.floor(medical_score("a_") / 3)).cast("int")
    return out.withColumn("article_support_score", support).withColumn("score", (medical_score("s_") + support).cast("int"))


def ladder() -> list[tuple[Column, bool, str]]:
    """(condition, keep, reason), first match wins."""
    h, c, score = _has, F.col, F.col("score")
    administered = c("biomedical_research") | c("preventive_health") | (h("disease") & (c("clinical_focus") | h("symptom") | h("prevention")))
    return [
        (h("veterinary"), False, "veterinary_content"),
        (h("animal") & h("taxonomy"), False, "zoology_or_ecology"),
        (h("animal") & ~c("human_medical") & ~c("translational"), False, "nonhuman_animal_content"),
        (h("plant"), False, "plant_care"),
        (h("non_biomedical_social"), False, "social_or_human_interest_story"),
        (h("strong_lifestyle"), False, "nonmedical_lifestyle"),
        (h("lifestyle") & ~h("disease"), False, "nonmedical_lifestyle"),
        (h("deceptive_health"), False, "deceptive_or_nonmedical_health_content"),
        (h("legal_or_crime"), False, "legal_or_crime_content"),
        (h("strong_administrative"), False, "healthcare_administration_only"),
        (h("administrative") & ~administered, False, "healthcare_administration_only"),
        (h("incident") & ~(h("disease") & c("specific_treatment") & c("clinical_focus")), False, "incident_without_medical_focus"),
        (c("medical_core") & (score >= 7), True, "disease_or_treatment"),
        (c("biomedical_research") & (score >= 7), True, "biomedical_research"),
        (c("healthcare_focus") & (score >= 8), True, "healthcare_system_or_clinical_care"),
        (c("preventive_health") & (score >= 8), True, "prevention_or_human_health"),
        (c("clinical_focus") & (score >= 8), True, "clinical_care"),
        (c("symptom_focus") & (score >= 10), True, "human_symptoms_or_injury"),
        (c("human_biology") & (score >= 8), True, "human_biology"),
    ]


def classify(
    pairs: DataFrame, lexicon: DataFrame, biology: tuple[str, ...] = BIOLOGY_ANATOMY, rules: list[tuple[Column, bool, str]] | None = None
) -> DataFrame:
    """Adds keep, reason, score, summary_evidence and article_support_score.

    rules: (condition, keep, reason) in order, over the evidence columns s_*, a_* and the predicates; the ladder if left out.
    """
    terms = load_lexicon(lexicon)
    rows = pairs.withColumn("_sm", T.matching_text(F.col("summary"))).withColumn("_am", T.matching_text(F.col("article")))
    rows = collect_evidence(rows, "_sm", terms, "s_")
    rows = predicates(collect_evidence(rows, "_am", terms, "a_", ("human", *_scored())), biology)
    keep, reason = F.lit(False), F.lit("insufficient_biomedical_evidence")
    for condition, kept, name in reversed(ladder() if rules is None else rules):
        keep, reason = F.when(condition, kept).otherwise(keep), F.when(condition, name).otherwise(reason)
    decided = rows.withColumn("keep", keep).withColumn("reason", reason).withColumn("summary_evidence", serialize_evidence("s_"))
    return decided.select(*pairs.columns, "keep", "reason", "score", "summary_evidence", "article_support_score")


def _scored() -> tuple[str, ...]:
    from corpusloom.operators.lexicon import WEIGHTS

    return tuple(WEIGHTS)


def decision_counts(decided: DataFrame) -> DataFrame:
    """(split, keep, reason, rows) of kept and excluded rows."""
    return decided.groupBy("split", "keep", "reason").agg(F.count("*").alias("rows"))


def keep_rates(decided: DataFrame) -> DataFrame:
    """(split, input_rows, kept_rows, excluded_rows, keep_rate) of every split and, with a null split, of all."""
    per = decided.groupBy("split").agg(F.count("*").alias("input_rows"), F.sum(F.col("keep").cast("bigint")).alias("kept_rows"))
    whole = per.rollup("split").agg(F.sum("input_rows").alias("input_rows"), F.sum("kept_rows").alias("kept_rows"))
    rate = F.round(F.try_divide(F.col("kept_rows"), F.col("input_rows")), 6)
    return whole.withColumn("excluded_rows", F.col("input_rows") - F.col("kept_rows")).withColumn("keep_rate", rate)
