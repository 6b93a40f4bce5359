"""Quality, deduplication, splits, near-duplicates, classification, scores: small cases and model checks."""

import itertools
import random
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import classify, dedup, evaluation, inference, lexicon, neardup, quality, rouge, splits, stats, vertical

LONG = "một hai ba bốn năm sáu bảy tám chín mười mười một"


def pairs(spark, rows):
    return spark.createDataFrame(rows, "split string, row_ord bigint, article string, summary string")


@pytest.mark.parametrize(
    "article,summary,reason",
    [
        (None, "", "empty_article"), (LONG, None, "empty_summary"), ("một hai", "một", "article_too_short"), (LONG, "một", "summary_too_short"),
        (LONG, LONG.upper(), "summary_equals_article"), (LONG, LONG + " x", "summary_not_shorter_than_article"), (LONG, "một hai ba", None),
        ("", "", "empty_article"), ("một hai ba", "<p></p>", "empty_summary"),
    ],
)
def test_ladder(spark, article, summary, reason):
    frame = pairs(spark, [("train", 1, article, summary)])
    assert quality.quality_reasons(quality.with_keys(frame)).first()["reason"] == reason


def test_ratio_rule_and_counts(spark):
    frame = pairs(spark, [("train", 1, LONG, "một hai ba"), ("train", 2, LONG, "một hai ba bốn năm sáu"), ("test", 3, None, "x")])
    keyed = quality.with_keys(frame)
    decided = quality.quality_reasons(keyed, quality.QualityRules(max_summary_ratio=0.3))
    assert {r["row_ord"]: r["reason"] for r in decided.collect()} == {1: None, 2: "summary_too_long", 3: "empty_article"}
    assert {tuple(r) for r in quality.reject_counts(decided).collect()} == {("train", "summary_too_long", 1), ("test", "empty_article", 1)}
    assert {r["split"]: r["normalized_articles"] for r in quality.normalized_counts(keyed).collect()} == {"train": 0, "test": 1}


def test_keep_first_and_duplicates(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), ("b", 1, 1), ("a", 1, 4)], "k string, s int, o int")
    assert {tuple(r) for r in dedup.keep_first(rows, ["k", "s"], ["o"]).collect()} == {("a", 1, 4), ("a", 2, 3), ("b", 1, 1)}
    assert {tuple(r) for r in dedup.duplicate_counts(rows, ["k"], ["s"]).collect()} == {("a", 3, 2, 1), ("b", 1, 1, 0)}


def test_repeated_sentences(spark):
    thirty, short = "a" * 29 + ".", "b" * 28 + "."
    text = f"{thirty} {short} {thirty.upper()} {short}"
    row = dedup.remove_repeated_sentences(pairs(spark, [("train", 1, text, "")]).select("split", "article")).first()
    assert row["article"] == f"{thirty} {short} {short}" and row["sentences_removed"] == 1


def test_priorities_and_resplit(spark):
    rows = [("train", 1, "k"), ("validation", 2, "k"), ("test", 3, "k"), ("train", 4, "m"), ("validation", 5, "m"), ("train", 6, "n"), ("train", 7, "n")]
    frame = spark.createDataFrame(rows, "split string, row_ord int, article_key string")
    left = lambda policy: {r["row_ord"] for r in splits.resolve_leakage(frame, policy, ["article_key"]).collect()}
    assert left("test-priority") == {3, 5, 6, 7} and left("train-priority") == {1, 4, 6, 7}
    assert left("resplit") == {1, 4, 6}
    assert splits.overlap_counts(frame).first().asDict() == {"train_validation": 2, "train_test": 1, "validation_test": 1}
    with pytest.raises(ValueError):
        splits.resolve_leakage(frame, "error", ["article_key"])
    with pytest.raises(ValueError):
        splits.resolve_leakage(frame, "none", ["article_key"])
    assert splits.overlap_counts(splits.by_priority(frame)).first().asDict() == {"train_validation": 0, "train_test": 0, "validation_test": 0}


def greedy(order, likes):
    kept, dropped = [], set()
    for x in order:
        if any((min(x, y), max(x, y)) in likes for y in kept):
            dropped.add(x)
        else:
            kept.append(x)
    return dropped


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_survivors(spark, seed):
    rng = random.Random(seed)
    likes = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(45)} | {(k, k + 1) for k in range(50, 60)}
    edges = spark.createDataFrame(sorted(likes), "first_a int, first_b int")
    state = {r["first"]: r["dropped"] for r in neardup.greedy_survivors(None, edges).collect()}
    assert {k for k, v in state.items() if v} == greedy(range(70), likes)


def test_near_duplicates_follow_the_greedy_model(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(60)] for _ in range(8)]
    texts = []
    for _ in range(50):
        text = list(rng.choice(base))
        for _ in range(rng.choice((0, 1, 2, 4))):
            text[rng.randrange(60)] = rng.choice(vocabulary)
        texts.append(" ".join(text))
    texts += ["a b c d", "a b c d", texts[0]]
    rows = [(rng.choice(splits.TRAIN_FIRST), k, t, "") for k, t in enumerate(texts)]
    keyed = quality.with_keys(pairs(spark, rows))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    order = sorted(range(len(rows)), key=lambda i: (splits.TEST_FIRST.index(rows[i][0]), i))
    kept = []
    for i in order:
        near = [j for j in kept if texts[i] != texts[j] and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])]
        if not near:
            kept.append(i)
    found = {r["row_ord"] for r in neardup.remove_near_duplicates(keyed, 0.6).collect()}
    assert found == set(kept)
    assert neardup.remove_near_duplicates(keyed, 0).count() == len(rows)
    assert neardup.near_duplicate_examples(keyed, 0.6).count() == min(20, len({texts[i] for i in set(order) - set(kept)}))


def test_statistics(spark):
    values = [3, 8, 13, 21, 2, 40]
    rows = [("train", k, " ".join(["w"] * n), " ".join(["w"] * (n // 2))) for k, n in enumerate(values)]
    row = stats.length_statistics(quality.with_keys(pairs(spark, rows))).filter("measure = 'article_words'").first()
    assert [row[c] for c in ("rows", "min", "max")] == [6, 2.0, 40.0]
    assert [row[c] for c in ("p50", "p90", "p95", "p99")] == [round(float(np.quantile(values, q)), 3) for q in (0.5, 0.9, 0.95, 0.99)]
    conflict = [("train", 1, LONG, "a b c"), ("test", 2, LONG, "a b d"), ("test", 3, LONG + " x", "a b d")]
    assert stats.summary_conflicts(quality.with_keys(pairs(spark, conflict))).first()["conflicts"] == 1
    manifest = stats.dataset_manifest(pairs(spark, [*conflict, ("test", 4, LONG, None)])).filter("split = 'test'").first()
    assert manifest["rows"] == 3 and manifest["empty_rows"] == 1 and manifest["duplicate_articles"] == 1
    assert stats.head_cap(pairs(spark, conflict), {"train": 1, "test": 1}).count() == 2


def classified(spark, summary, article="", terms=None):
    words = spark.createDataFrame([(c, t) for c, ts in (terms or lexicon.DEMO).items() for t in ts], "category string, term string")
    return classify.classify(pairs(spark, [("train", 1, article, summary)]), words).first()


TERMS = {c: (f"zz{c.replace('_', '')}", f"yy{c.replace('_', '')}") for c in lexicon.DEMO} | {"treatment": ("dùng thuốc", "zztreatment")}
LADDER = [
    ("zzveterinary zzdisease", "veterinary_content"), ("zzanimal zztaxonomy", "zoology_or_ecology"), ("zzanimal", "nonhuman_animal_content"),
    ("zzanimal zzhuman zzclinical zzplant", "plant_care"), ("zznonbiomedicalsocial", "social_or_human_interest_story"),
    ("zzstronglifestyle zzdisease", "nonmedical_lifestyle"), ("zzlifestyle", "nonmedical_lifestyle"),
    ("zzlifestyle zzdisease zzclinical", "disease_or_treatment"), ("zzdeceptivehealth", "deceptive_or_nonmedical_health_content"),
    ("zzlegalorcrime", "legal_or_crime_content"), ("zzstrongadministrative", "healthcare_administration_only"),
    ("zzadministrative zzdisease", "healthcare_administration_only"), ("zzadministrative zzdisease zzsymptom", "disease_or_treatment"),
    ("zzincident zzdisease zzclinical", "incident_without_medical_focus"),
    ("zzincident zzdisease zzclinical zzsymptom zztreatment", "disease_or_treatment"),
    ("zzdisease zzhealthsystem", "disease_or_treatment"), ("zzdisease", "insufficient_biomedical_evidence"),
    ("dùng thuốc", "insufficient_biomedical_evidence"), ("dùng thuốc zzsymptom", "disease_or_treatment"),
    ("zzresearch zzanatomy yyanatomy yyresearch", "biomedical_research"), ("zzhealthsystem zzclinical zzprevention yyprevention", "healthcare_system_or_clinical_care"),
    ("zzprevention yyprevention zzanatomy yyanatomy", "prevention_or_human_health"), ("zzclinical yyclinical zzsymptom", "clinical_care"),
    ("zzsymptom yysymptom zzanatomy yyanatomy zzhuman", "human_biology"), ("", "insufficient_biomedical_evidence"),
    ("kzzveterinary", "insufficient_biomedical_evidence"), ("zz-veterinary", "insufficient_biomedical_evidence"),
]


def test_rules_in_order(spark):
    words = spark.createDataFrame([(c, t) for c, ts in TERMS.items() for t in ts], "category string, term string")
    frame = pairs(spark, [("train", k, "", s) for k, (s, _) in enumerate(LADDER)])
    got = {r["row_ord"]: r["reason"] for r in classify.classify(frame, words).collect()}
    assert [got[k] for k in range(len(LADDER))] == [r for _, r in LADDER]


def test_rules_of_ones_own(spark):
    frame = pairs(spark, [("train", 1, "", "zzveterinary"), ("train", 2, "", "zzplant")])
    words = spark.createDataFrame([(c, t) for c, ts in TERMS.items() for t in ts], "category string, term string")
    own = [(F.size("s_veterinary") > 0, True, "animals")]
    assert {r["row_ord"]: (r["keep"], r["reason"]) for r in classify.classify(frame, words, rules=own).collect()} == {
        1: (True, "animals"), 2: (False, "insufficient_biomedical_evidence")
    }


def test_score_and_evidence(spark):
    row = classified(spark, "Sốt cao, viêm phổi; VIÊM-PHỔI?", "insulin và kháng sinh, xạ trị", None)
    assert row["summary_evidence"] == "disease=viêm phổi;anatomy=phổi;symptom=sốt cao"
    assert row["article_support_score"] == 5 and row["score"] == 9 + 5 and row["keep"]
    counts = classify.keep_rates(pairs(spark, []).withColumn("keep", F.lit(True))).collect()
    assert len(counts) <= 1


def test_rouge(spark):
    rows = [(0, "the cat sat", "the cat sat on the mat"), (1, "", "a"), (2, None, "a"), (3, "a_b c", "A B c"), (4, "a a a", "a b a")]
    frame = spark.createDataFrame(rows, "i int, prediction string, reference string")
    got = {r["i"]: r for r in rouge.rouge_rows(frame).collect()}
    assert got[0]["rouge1"] == pytest.approx(6 / 9) and got[0]["rouge2"] == pytest.approx(4 / 7) and got[0]["rougeL"] == pytest.approx(6 / 9)
    assert got[1]["rouge1"] == got[2]["rougeL"] == 0.0 and got[3]["rouge1"] == 1.0
    assert got[4]["rouge1"] == pytest.approx(4 / 6) and got[4]["rougeL"] == pytest.approx(4 / 6)
    assert rouge.rouge_corpus(rouge.rouge_rows(frame)).first()["rows"] == 5


def test_common_subsequence_against_the_table():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, b = rng.integers(0, 5, rng.integers(0, 15)), rng.integers(0, 5, rng.integers(0, 15))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert rouge.lcs_length(a, b) == table[-1, -1]


def test_tokens_and_boards(spark):
    frame = spark.createDataFrame([([-5, -100, 3, 40000],)], "ids array<int>").select(evaluation.sanitize_tokens(F.col("ids"), 100).alias("ids"))
    assert frame.first()["ids"] == [0, 0, 3, 0]
    assert evaluation.generated_length(frame, "ids").first()["gen_len"] == 1.0
    metrics = [("a", "test_rouge1", 1.0), ("a", "rougeL", 5.0), ("b", "eval_rougeL", 5.0), ("b", "test_rougeL", 9.0), ("c", "loss", 1.0)]
    scores = evaluation.coalesce_scores(spark.createDataFrame(metrics, "run string, name string, value double"))
    board = [(r["run"], r["rougeL"], r["rouge1"]) for r in evaluation.leaderboard(scores).orderBy("place").collect()]
    assert board == [("a", 5.0, 1.0), ("b", 5.0, 0.0), ("c", 0.0, 0.0)]
    delta = {r["metric"]: r["delta"] for r in evaluation.model_delta(scores, "c", "a").collect()}
    assert delta == {"rouge1": 1.0, "rouge2": 0.0, "rougeL": 5.0}
    files = spark.createDataFrame([("x", "test_metrics.json"), ("x", "eval_results.json"), ("y", "other.json")], "run string, file string")
    assert [tuple(r) for r in evaluation.first_metric_file(files).collect()] == [("x", "eval_results.json")]


def test_inference(spark):
    frame = spark.createDataFrame([(1, " ".join("abcdefghijklmnopqrstuvwxyz")), (2, None), (3, "  ")], "i int, article string")
    got = {r["i"]: r["prediction"] for r in inference.summarize(frame, lambda: inference.LeadSummarizer(3), batch=2).collect()}
    assert got == {1: "a b c", 2: "", 3: ""}
    ids = inference.tokenize(frame, inference.byte_tokenizer, "article", "ids", 4).orderBy("i").collect()
    assert ids[0]["ids"] == [100, 35, 101, 35] and ids[1]["ids"] == [1]
    saved = frame.select(inference.compression_ratio(F.col("article"), F.lit("a b")).alias("r")).collect()
    assert saved[0]["r"] == 92.3 and saved[1]["r"] is None


@pytest.mark.parametrize("slots, cell", [(None, 10**6), (3, 300)])
def test_near_duplicates_ship_a_shingle_once_and_find_what_comparing_all_finds(spark, monkeypatch, slots, cell):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(120)]
    base = [[rng.choice(vocabulary) for _ in range(50)] for _ in range(12)]
    texts = []
    for _ in range(90):
        text = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 3))):
            text[rng.randrange(50)] = rng.choice(vocabulary)
        texts.append(rng.choice((" ", " ", ", ")).join(text))  # other keys of equal shingles
    rows = [(rng.choice(splits.TEST_FIRST), (1 << 62) + k * 3, t, "") for k, t in enumerate([*texts, "a b c", *texts[:5]])]
    keyed = quality.with_keys(pairs(spark, rows))
    monkeypatch.setattr(neardup, "similar_texts", partial(vertical.similar_texts, slots=slots, cell=cell))
    firsts = {}
    for split, at, text, _ in rows:
        first = splits.TEST_FIRST.index(split), at
        firsts[text] = min(first, firsts.get(text, first))
    sets = {first: set(T.shingles_of(text)) for text, first in firsts.items()}
    order = sorted(sets)
    like = lambda x, y: len(sets[x] & sets[y]) / len(sets[x] | sets[y]) if sets[x] and sets[y] else 0.0
    wanted = {(x, y): like(x, y) for x, y in itertools.combinations(order, 2) if like(x, y) >= 0.6}
    found = {(tuple(r[0]), tuple(r[1])): r[2] for r in neardup.similar_keys(keyed, 0.6).collect()}
    assert found == wanted and 1.0 in wanted.values()
    kept, best = [], {}
    for y in order:
        near = [x for x in kept if (x, y) in wanted]
        if near:
            best[y] = min(near, key=lambda x: (-wanted[x, y], x))
        else:
            kept.append(y)
    assert {r["row_ord"] for r in neardup.remove_near_duplicates(keyed, 0.6).collect()} == {at for _, at, t, _ in rows if firsts[t] in kept}
    got = [(r["dropped_row"], r["kept_row"]) for r in neardup.near_duplicate_examples(keyed, 0.6).collect()]
    assert got == [(y[1], best[y][1]) for y in order if y in best][:20]
    frame = keyed.select("row_ord", F.lit(0).alias("kind"), "article_key")
    packed = frame.mapInArrow(vertical._entries(np.array(vertical.even_keys(16, 16), np.int32), 1, runs_of=neardup.key_runs), vertical._ENTRY)
    assert packed.selectExpr("sum(length(idx)) / 2").first()[0] == sum(len(sets[firsts[t]]) for _, _, t, _ in rows)


def test_texts_without_a_bottom_k_hash_in_common_are_no_pair(spark):
    keyed = spark.createDataFrame([("test", 1, " ".join(f"w{k}" for k in range(80)) + " x y"), ("test", 2, " ".join(f"w{k}" for k in range(80)))], "split string, row_ord long, article_key string")
    a, b = (set(T.shingles_of(r["article_key"])) for r in keyed.collect())
    for k in (1, 2, 5):
        shared = set(sorted(a)[:k]) & set(sorted(b)[:k])
        assert neardup.similar_keys(keyed, 0.8, k=k).count() == bool(shared)
