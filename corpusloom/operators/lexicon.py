"""Phrase lexicons: which terms of which category a text holds. The lexicon is data, a frame (category, term)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from corpusloom.functions import text as T
from corpusloom.session import ship

SHARD = 100_000  # terms of an automaton

#: A small lexicon of our own to show the classifier with; users bring theirs as a frame or a CSV file.
DEMO: dict[str, tuple[str, ...]] = {
    "human": ("người bệnh", "bệnh nhân", "trẻ nhỏ", "phụ nữ mang thai", "người cao tuổi", "thanh niên", "patients", "women"),
    "disease": ("viêm phổi", "đột quỵ", "suy thận", "hen phế quản", "sốt xuất huyết", "viêm gan", "thủy đậu", "động kinh", "asthma", "sepsis"),
    "human_zoonotic": ("cúm gia cầm", "bệnh dại"),
    "treatment": ("kháng sinh", "insulin", "xạ trị", "lọc máu", "phẫu thuật", "truyền dịch", "dùng thuốc", "dialysis"),
    "clinical": ("nhập viện", "chẩn đoán", "hồi sức", "hội chẩn", "xét nghiệm", "siêu âm", "biopsy"),
    "health_system": ("bệnh viện", "trạm y tế", "phòng khám", "khoa hồi sức", "hospital", "clinic"),
    "anatomy": ("tim", "gan", "phổi", "não", "thận", "cột sống", "khớp gối", "liver", "lung"),
    "symptom": ("khó thở", "sốt cao", "chóng mặt", "đau ngực", "buồn nôn", "phát ban", "fever", "fatigue"),
    "prevention": ("tiêm nhắc", "rửa tay", "tiêm chủng", "vắc xin", "đeo khẩu trang", "hạn chế muối"),
    "research": ("nhóm nghiên cứu", "thử nghiệm", "mẫu máu", "giả dược", "placebo", "cohort study"),
    "animal": ("con mèo", "đàn lợn", "chim bồ câu", "con bê", "đàn vịt", "chó con", "chuột"),
    "human_exposure": ("bị chó cắn", "lây sang người"),
    "core_research_anatomy": ("não", "tim", "gan", "tế bào"),
    "veterinary": ("thú y", "chuồng trại", "vật nuôi"),
    "taxonomy": ("loài mới", "phân loài"),
    "plant": ("chậu lan", "giàn mướp", "cây giống", "phân hữu cơ", "lớp mùn"),
    "incident": ("hỏa hoạn", "tai nạn giao thông", "camera ghi hình"),
    "legal_or_crime": ("khởi tố", "bị can", "bị cáo", "truy tố", "luật sư", "tòa", "jurors", "prosecutors"),
    "administrative": ("bổ nhiệm", "ngân sách", "nghị định", "công văn", "thanh tra"),
    "strong_administrative": ("gói thầu", "điều chuyển công tác", "đấu thầu"),
    "deceptive_health": ("thần dược", "chữa bách bệnh"),
    "lifestyle": ("thời trang", "trang điểm", "áo dài", "son lì"),
    "strong_lifestyle": ("người mẫu", "stylist", "chủ salon"),
    "non_biomedical_social": ("quỹ học bổng", "thiện nguyện", "mái ấm", "học trò nghèo"),
}
#: Categories that make up the evidence; the other lexicons only refine a rule.
EVIDENCE = tuple(c for c in DEMO if c not in ("human_zoonotic", "human_exposure", "core_research_anatomy"))
WEIGHTS = {"disease": 5, "treatment": 5, "clinical": 3, "health_system": 2, "anatomy": 2, "symptom": 2, "prevention": 2, "research": 2}


def demo_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, t) for c, terms in DEMO.items() for t in terms], "category string, term string")


def load_lexicon(lexicon: DataFrame) -> dict[str, list[str]]:
    """Normalized, distinct terms by category; a lexicon is a list that people keep, of any length that the driver holds."""
    ship(lexicon.sparkSession)
    terms = lexicon.select("category", F.trim(T.matching_text(F.col("term"))).alias("term")).distinct().filter("term <> ''")
    out: dict[str, list[str]] = {}
    for category, term in terms.orderBy("category", "term").collect():
        out.setdefault(category, []).append(term)
    return out


def _finder(spark: SparkSession, pairs: list[tuple[str, str]]):
    """A column function: "category<0x01>term" of every term that a padded matching text holds, in one walk over the text."""
    shared = spark.sparkContext.broadcast(pairs)

    @pandas_udf(ArrayType(StringType()))
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        held: dict[str, list[str]] = {}
        for category, term in shared.value:
            held.setdefault(f" {term} ", []).append(f"{category}\x01{term}")
        automaton = ahocorasick.Automaton()
        for phrase, names in held.items():
            automaton.add_word(phrase, names)
        automaton.make_automaton()
        for texts in batches:
            yield pd.Series([sorted({n for _, names in automaton.iter(t) for n in names}) if t else [] for t in texts], dtype=object)

    return find.asNondeterministic()  # worked out once for all the categories that are taken from it


def collect_evidence(rows: DataFrame, matching: str, terms: dict[str, list[str]], prefix: str, categories: tuple[str, ...] = tuple(DEMO)) -> DataFrame:
    """Adds a sorted array of found terms for every category, named prefix + category; terms in shards of ``SHARD``."""
    every = [(c, t) for c in categories for t in terms.get(c, [])]
    if not every:
        return rows.withColumns({f"{prefix}{c}": F.array().cast("array<string>") for c in categories})
    shards = [_finder(rows.sparkSession, every[k : k + SHARD])(F.col(matching)) for k in range(0, len(every), SHARD)]
    out = rows.withColumn("_found", shards[0] if len(shards) == 1 else F.concat(*shards))
    cut = lambda c: F.transform(F.filter("_found", lambda x: F.startswith(x, F.lit(f"{c}\x01"))), lambda x: F.substring(x, len(c) + 2, 1 << 30))
    return out.withColumns({f"{prefix}{c}": F.array_sort(cut(c)) for c in categories}).drop("_found")


def medical_score(prefix: str) -> Column:
    """Weighted count of distinct terms."""
    out = F.lit(0)
    for category, weight in WEIGHTS.items():
        out = out + F.size(f"{prefix}{category}") * weight
    return out


def serialize_evidence(prefix: str) -> Column:
    """category=term|term;… of the categories with terms, in fixed order, terms sorted."""
    parts = [
        F.when(F.size(f"{prefix}{c}") > 0, F.concat(F.lit(f"{c}="), F.array_join(F.array_sort(f"{prefix}{c}"), "|"))) for c in EVIDENCE
    ]
    return F.concat_ws(";", *parts)
