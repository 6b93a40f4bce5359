"""The SQL that the registered queries are compared with, for an engine with nfc_normalize, regular expressions and
list functions. Compatibility forms are spelled out for the characters that the tables hold: full-width letters,
digits and punctuation, ligatures, the Thai sara am; entities likewise for the one that occurs."""

from __future__ import annotations

from corpusloom.operators.lexicon import DEMO, EVIDENCE, WEIGHTS

_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
_WORD = r"[\p{L}\p{N}_]+"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _space(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g'))"


def strip(x: str) -> str:
    x = rf"regexp_replace({x}, '[\x{{200B}}\x{{200C}}\x{{200D}}\x{{2060}}\x{{FEFF}}]', '', 'g')"
    x = f"regexp_replace({x}, '</?[A-Za-z][^>]*>', ' ', 'g')"
    return _space(rf"regexp_replace({x}, '\p{{Cc}}', ' ', 'g')")


def norm(x: str) -> str:
    return strip(f"nfc_normalize(replace(coalesce({x}, ''), '&nbsp;', chr(160)))")


def compat(x: str) -> str:
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("…", "..."), ("ำ", "ํา"), ("²", "2"), ("ª", "a"), ("º", "o")):
        x = f"replace({x}, {_q(a)}, {_q(b)})"
    return f"nfc_normalize(translate({x}, {_q(_FULL)}, {_q(_PLAIN)}))"


def fold(x: str) -> str:
    return f"replace(replace(lower({compat(x)}), 'ß', 'ss'), 'ς', 'σ')"


def key(x: str) -> str:
    return _space(fold(x))


def words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+'), lambda w: w <> '')"


def count(x: str) -> str:
    return f"CAST(len({words(f'coalesce({x}, {_q('')})')}) AS BIGINT)"


def matching(x: str) -> str:
    return rf"' ' || trim(regexp_replace({fold(f'coalesce({x}, {_q(str())})')}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) || ' '"


def sentences(x: str) -> str:
    marked = rf"regexp_replace({x}, '([.!?][\"”’'']*)[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', '\1' || chr(1), 'g')"
    marked = marked.replace('\\"', '"')
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(s)), lambda s: s <> '')"


_PAIRS = "WITH pairs AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT '{s}' AS split, pair_id AS row_ord, article AS raw_article, summary AS raw_summary, _source_file, _source_row FROM {s}"
    for s in ("train", "validation", "test")
) + ")"
_NORM = f"{_PAIRS}, normed AS MATERIALIZED (SELECT *, {norm('raw_article')} AS article, {norm('raw_summary')} AS summary FROM pairs)"
_KEYED = (
    f"{_NORM}, keyed AS MATERIALIZED (SELECT *, {key('article')} AS article_key, {key('summary')} AS summary_key, "
    f"{count('article')} AS article_words, {count('summary')} AS summary_words FROM normed)"
)


def _decided(ratio: float) -> str:
    return (
        f"{_KEYED}, decided AS MATERIALIZED (SELECT *, CASE WHEN article = '' THEN 'empty_article' WHEN summary = '' THEN 'empty_summary' "
        "WHEN article_words < 10 THEN 'article_too_short' WHEN summary_words < 3 THEN 'summary_too_short' "
        "WHEN article_key = summary_key THEN 'summary_equals_article' "
        "WHEN summary_words >= article_words THEN 'summary_not_shorter_than_article' "
        f"WHEN summary_words / nullif(article_words, 0) > {ratio} THEN 'summary_too_long' END AS reason FROM keyed)"
    )


_DECIDED = _decided(1.0)
_KEPT = f"{_DECIDED}, kept AS MATERIALIZED (SELECT * FROM decided WHERE reason IS NULL)"
_TEST_RANK = "CASE split WHEN 'test' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END"
_TRAIN_RANK = "CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END"
_HEX = (
    "(list_sum(list_transform(range(1, 17), lambda i: CAST(strpos('0123456789abcdef', substr(sha256(article_key), CAST(i AS INT), 1)) - 1 AS HUGEINT) "
    "* CAST(pow(16, 16 - i) AS HUGEINT))))"
)
_BUCKET = f"(CAST({_HEX} AS DOUBLE) / 18446744073709551616.0)"
_ASSIGN = f"CASE WHEN {_BUCKET} < 0.8 THEN 'train' WHEN {_BUCKET} < {0.8 + 0.1!r} THEN 'validation' ELSE 'test' END"


def _dedup(keys: str) -> str:
    return f"{_KEPT} SELECT split, row_ord FROM kept QUALIFY row_number() OVER (PARTITION BY split, {keys} ORDER BY row_ord) = 1"


def _leak(rank: str) -> str:
    return f"{_KEPT} SELECT split, row_ord FROM kept QUALIFY {rank} = min({rank}) OVER (PARTITION BY article_key)"


def _grams(tokens: str, n: int) -> str:
    if n == 1:
        return tokens
    return f"list_transform(range(1, len({tokens}) - {n - 2}), lambda i: array_to_string({tokens}[i:i + {n - 1}], ' '))"


def _rouge_rows(n: int) -> str:
    case = lambda x: f"replace(replace(replace(replace(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ'), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl')"
    tok = lambda x: rf"regexp_extract_all(nfc_normalize({case(x)}), '[\p{{L}}\p{{N}}]+')"
    return (
        f"{_NORM}, made AS MATERIALIZED (SELECT split, row_ord, {tok(f'array_to_string(({words("article")})[1:30], {_q(" ")})')} AS p, "
        f"{tok('summary')} AS r FROM normed), grams AS (SELECT split, row_ord, {_grams('p', n)} AS p, {_grams('r', n)} AS r FROM made), "
        "pg AS (SELECT row_ord, g, count(*) AS n FROM (SELECT row_ord, unnest(p) AS g FROM grams) GROUP BY ALL), "
        "rg AS (SELECT row_ord, g, count(*) AS n FROM (SELECT row_ord, unnest(r) AS g FROM grams) GROUP BY ALL), "
        "shared AS (SELECT row_ord, sum(least(pg.n, rg.n)) AS n FROM pg JOIN rg USING (row_ord, g) GROUP BY row_ord), "
        f"scored AS MATERIALIZED (SELECT split, row_ord, CASE WHEN len(p) = 0 OR len(r) = 0 THEN 0.0 ELSE 2.0 * coalesce(shared.n, 0) / (len(p) + len(r)) END AS rouge{n} "
        "FROM grams LEFT JOIN shared USING (row_ord))"
    )


def _rouge_both() -> str:
    first = _rouge_rows(1).replace(" grams ", " grams1 ").replace("FROM grams)", "FROM grams1)").replace("FROM grams ", "FROM grams1 ")
    for name in ("pg", "rg", "shared", "scored"):
        first = first.replace(f"{name} AS ", f"{name}1 AS ").replace(f"{name}.n", f"{name}1.n").replace(f"FROM {name} ", f"FROM {name}1 ").replace(f"JOIN {name} ", f"JOIN {name}1 ")
    second = _rouge_rows(2)
    tail = second[second.index("grams AS (") :]
    corpus = (
        "corpus AS (SELECT a.split, count(*) AS rows, round(avg(a.rouge1) * 100, 2) AS rouge1, round(avg(b.rouge2) * 100, 2) AS rouge2, "
        "round(avg(l.rougel) * 100, 2) AS \"rougeL\" FROM scored1 a JOIN scored b USING (row_ord) JOIN scored_l l USING (row_ord) GROUP BY a.split)"
    )
    return f"{first.replace('WITH pairs', 'WITH RECURSIVE pairs', 1)}, {_LCS}, {tail}, {corpus}"


# The table of common subsequences row by row, one step of the recursion for each token of p; within a row the running maximum.
_LCS = (
    "lcs AS (SELECT row_ord, 0 AS i, p, r, list_transform(range(len(r) + 1), lambda j: 0) AS d FROM made UNION ALL "
    "SELECT row_ord, i + 1, p, r, list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j])) FROM ("
    "SELECT *, list_transform(range(len(r) + 1), lambda j: CASE WHEN j = 0 THEN 0 "
    "ELSE greatest(d[j + 1], CASE WHEN r[j] = p[i + 1] THEN d[j] + 1 ELSE 0 END) END) AS c FROM lcs WHERE i < len(p))), "
    "scored_l AS MATERIALIZED (SELECT row_ord, CASE WHEN len(p) = 0 OR len(r) = 0 THEN 0.0 ELSE 2.0 * d[len(r) + 1] / (len(p) + len(r)) END AS rougel "
    "FROM lcs WHERE i = len(p))"
)


def _terms(category: str) -> str:
    terms = sorted({t for t in DEMO[category]})
    return "[" + ", ".join(_q(t) for t in terms) + "]"


def _found(category: str, text: str) -> str:
    return f"list_filter({_terms(category)}, lambda t: contains({text}, ' ' || t || ' '))"


def _evidence() -> str:
    s = ", ".join(f"{_found(c, 'sm')} AS s_{c}" for c in DEMO)
    a = ", ".join(f"{_found(c, 'am')} AS a_{c}" for c in ("human", *WEIGHTS))
    matched = f"matched AS MATERIALIZED (SELECT *, {matching('raw_summary')} AS sm, {matching('raw_article')} AS am FROM pairs)"
    return f"{_PAIRS}, {matched}, evidence AS MATERIALIZED (SELECT split, row_ord, {s}, {a} FROM matched)"


def _classified() -> str:
    h = lambda c: f"len(s_{c}) > 0"
    score = lambda p: "(" + " + ".join(f"len({p}_{c}) * {w}" for c, w in WEIGHTS.items()) + ")"
    biology = "['âm đạo', 'dương vật', 'tử cung', 'buồng trứng', 'tinh hoàn']"
    care = f"({h('clinical')} OR {h('health_system')} OR {h('symptom')})"
    return (
        f"{_evidence()}, step1 AS (SELECT *, len(list_filter(s_treatment, lambda t: t <> 'dùng thuốc')) > 0 AS specific FROM evidence), "
        f"step2 AS (SELECT *, specific OR (list_contains(s_treatment, 'dùng thuốc') AND ({h('disease')} OR {h('clinical')} OR {h('health_system')} OR {h('human')} OR {h('symptom')})) AS tfocus, "
        f"{h('research')} AND ({h('disease')} OR {h('treatment')} OR {h('anatomy')}) AS research, "
        f"{h('clinical')} AND ({h('symptom')} OR {h('anatomy')} OR ({h('human')} AND len(s_clinical) >= 2)) AS cfocus, "
        f"(list_has_any(s_disease, s_human_zoonotic) AND ({h('human')} OR {care})) OR ({h('human_exposure')} AND ({h('treatment')} OR {care})) OR "
        f"({h('human')} AND ({h('treatment')} OR {h('clinical')} OR {h('prevention')} OR {h('symptom')} OR ({h('disease')} AND {h('health_system')}))) AS hmed, "
        f"CAST(least(6, {score('a')} // 3) AS INTEGER) AS article_support_score FROM step1), "
        f"step3 AS (SELECT *, {h('disease')} OR tfocus AS core, "
        f"research AND ({h('disease')} OR {h('treatment')} OR (({h('human')} OR len(a_human) > 0) AND list_has_any(s_anatomy, s_core_research_anatomy))) AS transl, "
        f"len(s_symptom) >= 2 AND NOT ({h('lifestyle')}) AND NOT ({h('deceptive_health')}) AS sfocus, "
        f"{h('prevention')} AND ({h('disease')} OR {h('clinical')} OR {h('health_system')} OR {h('anatomy')} OR {h('symptom')}) AS preventive, "
        f"{h('anatomy')} AND ({h('human')} OR {h('research')} OR {h('health_system')} OR len(s_anatomy) >= 2 OR list_has_any(s_anatomy, {biology})) AS biology, "
        f"CAST({score('s')} + article_support_score AS INTEGER) AS score FROM step2), "
        f"step4 AS (SELECT *, {h('health_system')} AND (core OR {h('clinical')} OR {h('symptom')} OR {h('prevention')} OR {h('research')}) AS hfocus FROM step3), "
        "decisions AS MATERIALIZED (SELECT *, CASE "
        f"WHEN {h('veterinary')} THEN 'veterinary_content' WHEN {h('animal')} AND {h('taxonomy')} THEN 'zoology_or_ecology' "
        f"WHEN {h('animal')} AND NOT hmed AND NOT transl THEN 'nonhuman_animal_content' WHEN {h('plant')} THEN 'plant_care' "
        f"WHEN {h('non_biomedical_social')} THEN 'social_or_human_interest_story' WHEN {h('strong_lifestyle')} THEN 'nonmedical_lifestyle' "
        f"WHEN {h('lifestyle')} AND NOT ({h('disease')}) THEN 'nonmedical_lifestyle' "
        f"WHEN {h('deceptive_health')} THEN 'deceptive_or_nonmedical_health_content' WHEN {h('legal_or_crime')} THEN 'legal_or_crime_content' "
        f"WHEN {h('strong_administrative')} THEN 'healthcare_administration_only' "
        f"WHEN {h('administrative')} AND NOT (research OR preventive OR ({h('disease')} AND (cfocus OR {h('symptom')} OR {h('prevention')}))) THEN 'healthcare_administration_only' "
        f"WHEN {h('incident')} AND NOT ({h('disease')} AND specific AND cfocus) THEN 'incident_without_medical_focus' "
        "WHEN core AND score >= 7 THEN 'disease_or_treatment' WHEN research AND score >= 7 THEN 'biomedical_research' "
        "WHEN hfocus AND score >= 8 THEN 'healthcare_system_or_clinical_care' WHEN preventive AND score >= 8 THEN 'prevention_or_human_health' "
        "WHEN cfocus AND score >= 8 THEN 'clinical_care' WHEN sfocus AND score >= 10 THEN 'human_symptoms_or_injury' "
        "WHEN biology AND score >= 8 THEN 'human_biology' ELSE 'insufficient_biomedical_evidence' END AS reason FROM step4), "
        "classified AS MATERIALIZED (SELECT *, reason IN ('disease_or_treatment', 'biomedical_research', 'healthcare_system_or_clinical_care', "
        "'prevention_or_human_health', 'clinical_care', 'human_symptoms_or_injury', 'human_biology') AS keep FROM decisions)"
    )


_SHINGLES = (
    f"{_KEYED}, texts AS MATERIALIZED (SELECT article_key AS key, arg_min(row_ord, ({_TEST_RANK}) * 1000000000 + row_ord) AS row_ord, "
    f"min(({_TEST_RANK}) * 1000000000 + row_ord) AS first FROM keyed GROUP BY article_key), "
    rf"tokens AS MATERIALIZED (SELECT row_ord, first, regexp_extract_all(key, '{_WORD}') AS w FROM texts), "
    "sets AS MATERIALIZED (SELECT row_ord, first, CASE WHEN len(w) < 5 THEN [] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], chr(31)))) END AS sh FROM tokens)"
)


# Survivors one text after the other in processing order: a text is dropped if it is like one that was kept.
_WALK = (
    _SHINGLES.replace(_KEYED, _KEPT, 1).replace("FROM keyed GROUP BY", "FROM kept GROUP BY").replace("WITH pairs", "WITH RECURSIVE pairs", 1)
    + ", flat AS MATERIALIZED (SELECT first, len(sh) AS n, unnest(sh) AS g FROM sets), "
    "edges AS MATERIALIZED (SELECT fa, fb, k / (na + nb - k) AS likeness FROM (SELECT a.first AS fa, b.first AS fb, any_value(a.n) AS na, any_value(b.n) AS nb, "
    "CAST(count(*) AS DOUBLE) AS k FROM flat a JOIN flat b ON a.g = b.g AND a.first < b.first AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n GROUP BY 1, 2) "
    "WHERE k / (na + nb - k) >= 0.8), "
    "nodes AS MATERIALIZED (SELECT first, row_number() OVER (ORDER BY first) AS i FROM (SELECT fa AS first FROM edges UNION SELECT fb FROM edges)), "
    "near AS MATERIALIZED (SELECT n.i, n.first, list(m.i) AS before FROM nodes n LEFT JOIN edges e ON e.fb = n.first LEFT JOIN nodes m ON m.first = e.fa GROUP BY ALL), "
    "walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS stay UNION ALL SELECT near.i, CASE WHEN list_has_any(near.before, walk.stay) THEN walk.stay "
    "ELSE list_append(walk.stay, near.i) END FROM walk JOIN near ON near.i = walk.i + 1), "
    "last AS MATERIALIZED (SELECT stay FROM walk ORDER BY i DESC LIMIT 1), "
    "state AS MATERIALIZED (SELECT first, NOT list_contains((SELECT stay FROM last), i) AS dropped FROM nodes)"
)


def statements() -> dict[str, str]:
    sizes = f"SELECT split, count(*) AS rows FROM (SELECT {_ASSIGN} AS split FROM keyed) GROUP BY split"
    stat = (
        "SELECT split, measure, count(*) AS rows, round(min(v), 3) AS min, round(quantile_cont(v, 0.5), 3) AS p50, round(quantile_cont(v, 0.9), 3) AS p90, "
        "round(quantile_cont(v, 0.95), 3) AS p95, round(quantile_cont(v, 0.99), 3) AS p99, round(max(v), 3) AS max FROM long GROUP BY split, measure"
    )
    long = (
        "long AS (SELECT split, 'article_words' AS measure, CAST(article_words AS DOUBLE) AS v FROM keyed UNION ALL "
        "SELECT split, 'summary_words', CAST(summary_words AS DOUBLE) FROM keyed UNION ALL "
        "SELECT split, 'summary_article_ratio', CAST(summary_words AS DOUBLE) / nullif(article_words, 0) FROM keyed)"
    )
    has = lambda s: f"max(CASE WHEN split = '{s}' THEN 1 ELSE 0 END) AS {s}"
    overlap = (
        f"{_KEPT}, per AS (SELECT article_key, {has('train')}, {has('validation')}, {has('test')} FROM kept GROUP BY article_key) "
        "SELECT CAST(coalesce(sum(train * validation), 0) AS BIGINT) AS train_validation, CAST(coalesce(sum(train * test), 0) AS BIGINT) AS train_test, "
        "CAST(coalesce(sum(validation * test), 0) AS BIGINT) AS validation_test FROM per"
    )
    mkey = f"lower({_space(compat('coalesce(raw_article, ' + _q('') + ')'))})"
    raw = lambda c: count(f"raw_{c}")
    manifest = (
        f"{_PAIRS}, m AS (SELECT split, {raw('article')} AS aw, {raw('summary')} AS sw, trim(coalesce(raw_article, ''), ' ') = '' OR trim(coalesce(raw_summary, ''), ' ') = '' AS blank, "
        f"{mkey} AS k FROM pairs) SELECT split, count(*) AS rows, CAST(sum(CASE WHEN blank THEN 1 ELSE 0 END) AS BIGINT) AS empty_rows, "
        "round(avg(aw), 2) AS article_words_mean, round(median(aw), 2) AS article_words_median, round(avg(sw), 2) AS summary_words_mean, "
        "round(median(sw), 2) AS summary_words_median, count(*) - count(DISTINCT k) AS duplicate_articles FROM m GROUP BY split"
    )
    cut = f"cut AS MATERIALIZED (SELECT split, row_ord, {sentences('article')} AS s FROM normed)"
    repeats = (
        f"{_NORM}, {cut}, k AS MATERIALIZED (SELECT *, list_transform(s, lambda x: {key('x')}) AS k FROM cut), "
        "kept_s AS MATERIALIZED (SELECT split, row_ord, len(s) AS n, list_filter(s, lambda x, i: length(k[i]) < 30 OR list_position(k, k[i]) = i) AS t FROM k), "
        "cleaned AS MATERIALIZED (SELECT split, row_ord, coalesce(array_to_string(t, ' '), '') AS article, CAST(n - len(t) AS BIGINT) AS sentences_removed FROM kept_s)"
    )
    pred = f"array_to_string(({words('article')})[1:30], ' ')"
    ids = ", ".join(f"CAST((o_orderkey * {m}) % 401 - 20 AS INTEGER)" for m in (1, 3, 7, 11))
    tokens = f"WITH t AS (SELECT o_orderkey, list_transform([{ids}], lambda x: CASE WHEN x < 0 OR x >= 300 THEN 0 ELSE x END) AS ids FROM orders)"
    nfc = f"nfc_normalize(coalesce(raw_article, {_q('')}))"
    hits = " UNION ALL ".join(f"SELECT '{c}' AS category, unnest(s_{c}) AS term FROM evidence" for c in EVIDENCE)
    serialized = "concat_ws(';', " + ", ".join(f"CASE WHEN len(s_{c}) > 0 THEN '{c}=' || array_to_string(list_sort(s_{c}), '|') END" for c in EVIDENCE) + ")"
    rates = "round(CAST(sum(CASE WHEN keep THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6)"
    board = (
        f"{_rouge_both()}, board AS (SELECT split AS run, rouge1, rouge2, \"rougeL\", row_number() OVER (ORDER BY \"rougeL\" DESC, split) AS place FROM corpus)"
    )
    delta = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, max(CASE WHEN run = 'validation' THEN \"{m}\" END) AS base, max(CASE WHEN run = 'test' THEN \"{m}\" END) AS tuned FROM board"
        for m in ("rouge1", "rouge2", "rougeL")
    )
    return {
        "normalize_documents": f"{_NORM} SELECT row_ord, article, summary, raw_article IS DISTINCT FROM article AS article_changed, raw_summary IS DISTINCT FROM summary AS summary_changed FROM normed",
        "canonical_keys": f"{_KEYED} SELECT row_ord, article_key, summary_key FROM keyed",
        "text_identities": f"{_PAIRS} SELECT row_ord, {matching('raw_summary')} AS matching, lower({_space(compat('coalesce(raw_summary, ' + _q('') + ')'))}) AS manifest, {_space('nfc_normalize(coalesce(raw_summary, ' + _q('') + '))')} AS clean FROM pairs",
        "word_counts": f"{_KEYED} SELECT row_ord, article_words, summary_words FROM keyed",
        "normalized_counts": f"{_NORM} SELECT split, count(*) AS rows, CAST(sum(CASE WHEN raw_article IS DISTINCT FROM article THEN 1 ELSE 0 END) AS BIGINT) AS normalized_articles, CAST(sum(CASE WHEN raw_summary IS DISTINCT FROM summary THEN 1 ELSE 0 END) AS BIGINT) AS normalized_summaries FROM normed GROUP BY split",
        "strip_markup": f"SELECT doc_id, {strip('text')} AS text FROM documents",
        "quality_decisions": f"{_DECIDED} SELECT split, row_ord, coalesce(reason, 'kept') AS reason FROM decided",
        "quality_max_ratio": f"{_decided(0.3)} SELECT split, row_ord, coalesce(reason, 'kept') AS reason FROM decided",
        "reject_reason_counts": f"{_DECIDED} SELECT split, reason, count(*) AS rows FROM decided WHERE reason IS NOT NULL GROUP BY split, reason",
        "dedup_pair_first": _dedup("article_key, summary_key"),
        "dedup_article_first": _dedup("article_key"),
        "duplicate_counts": f"{_KEPT} SELECT split, count(*) AS rows, count(DISTINCT article_key) AS distinct_keys, count(*) - count(DISTINCT article_key) AS duplicates FROM kept GROUP BY split",
        "reloaded_rows": f"{_PAIRS} SELECT split, count(*) AS rows, count(DISTINCT (_source_file, _source_row)) AS distinct_keys, count(*) - count(DISTINCT (_source_file, _source_row)) AS duplicates FROM pairs GROUP BY split",
        "split_overlap_counts": overlap,
        "leakage_test_priority": _leak(_TEST_RANK),
        "leakage_train_priority": _leak(_TRAIN_RANK),
        "hash_buckets": f"{_KEYED} SELECT row_ord, {_BUCKET} AS bucket, {_ASSIGN} AS split FROM keyed",
        "resplit_dedup": f"{_KEPT}, firsts AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY article_key, summary_key ORDER BY {_TRAIN_RANK}, row_ord) = 1) SELECT row_ord, split AS input_split, {_ASSIGN} AS split FROM firsts",
        "split_row_counts": f"{_KEYED} {sizes}",
        "length_statistics": f"{_KEYED}, {long} {stat}",
        "summary_conflicts": f"{_KEYED} SELECT count(*) AS conflicts FROM (SELECT article_key FROM keyed GROUP BY article_key HAVING count(DISTINCT summary_key) > 1)",
        "dataset_manifest": manifest,
        "head_cap": f"{_PAIRS} SELECT split, row_ord FROM pairs QUALIFY row_number() OVER (PARTITION BY split ORDER BY row_ord) <= CASE split WHEN 'train' THEN 500 WHEN 'validation' THEN 50 ELSE 1000000000 END",
        "sentence_split": f"{_NORM}, {cut} SELECT row_ord, CAST(unnest(range(len(s))) AS BIGINT) AS place, unnest(s) AS sentence FROM cut",
        "repeated_sentence_removal": f"{repeats} SELECT row_ord, article, sentences_removed FROM cleaned",
        "repeated_sentence_counts": f"{repeats} SELECT split, CAST(sum(CASE WHEN sentences_removed > 0 THEN 1 ELSE 0 END) AS BIGINT) AS articles_with_repeats, CAST(sum(sentences_removed) AS BIGINT) AS sentences_removed FROM cleaned GROUP BY split",
        "shingle_counts": f"{_SHINGLES} SELECT row_ord, CAST(len(sh) AS BIGINT) AS shingles FROM sets",
        "near_dup_pairs": (
            f"{_SHINGLES}, flat AS MATERIALIZED (SELECT row_ord, first, len(sh) AS n, unnest(sh) AS g FROM sets), "
            "shared AS (SELECT a.row_ord AS row_a, b.row_ord AS row_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM flat a JOIN flat b ON a.g = b.g AND a.first < b.first "
            "AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n GROUP BY 1, 2) "
            "SELECT row_a, row_b, round(CAST(k AS DOUBLE) / (na + nb - k), 6) AS likeness FROM shared WHERE CAST(k AS DOUBLE) / (na + nb - k) >= 0.8"
        ),
        "near_dup_survivors": (
            f"{_WALK} SELECT split, row_ord FROM kept WHERE article_key NOT IN (SELECT t.key FROM texts t JOIN state s ON s.first = t.first WHERE s.dropped)"
        ),
        "near_dup_examples": (
            f"{_WALK}, best AS (SELECT fb, arg_min(fa, (-likeness, fa)) AS fa, max(likeness) AS likeness FROM edges "
            "JOIN state x ON x.first = fa AND NOT x.dropped JOIN state y ON y.first = fb AND y.dropped GROUP BY fb ORDER BY fb LIMIT 20) "
            "SELECT ['test', 'validation', 'train'][fb // 1000000000 + 1] AS dropped_split, fb % 1000000000 AS dropped_row, "
            "['test', 'validation', 'train'][fa // 1000000000 + 1] AS kept_split, fa % 1000000000 AS kept_row, round(likeness, 6) AS word_5gram_jaccard FROM best"
        ),
        "lexicon_hits": f"{_evidence()} SELECT category, term, count(*) AS rows FROM ({hits}) GROUP BY category, term",
        "evidence_scores": f"{_classified()} SELECT row_ord, score, article_support_score FROM classified",
        "domain_classify": f"{_classified()} SELECT row_ord, keep, reason, {serialized} AS summary_evidence FROM classified",
        "exclusion_audit_counts": f"{_classified()} SELECT split, keep, reason, count(*) AS rows FROM classified GROUP BY split, keep, reason",
        "keep_rates": f"{_classified()} SELECT coalesce(split, 'all') AS split, count(*) AS input_rows, CAST(sum(CASE WHEN keep THEN 1 ELSE 0 END) AS BIGINT) AS kept_rows, CAST(sum(CASE WHEN keep THEN 0 ELSE 1 END) AS BIGINT) AS excluded_rows, {rates} AS keep_rate FROM classified GROUP BY ROLLUP (split)",
        "rouge1_rows": f"{_rouge_rows(1)} SELECT row_ord, round(rouge1, 6) AS rouge1 FROM scored",
        "rouge2_rows": f"{_rouge_rows(2)} SELECT row_ord, round(rouge2, 6) AS rouge2 FROM scored",
        "rougeL_rows": f"{_rouge_rows(1).replace('WITH pairs', 'WITH RECURSIVE pairs', 1)}, {_LCS} SELECT row_ord, round(rougel, 6) AS \"rougeL\" FROM scored_l",
        "rouge_corpus": f"{_rouge_both()} SELECT * FROM corpus",
        "prediction_export": f"{_NORM} SELECT row_ord AS index, CASE WHEN split = 'test' THEN '' ELSE article END AS article, summary AS reference, {pred} AS prediction FROM normed",
        "run_leaderboard": f"{board} SELECT * FROM board",
        "model_delta": f"{board} SELECT metric, base, tuned, round(tuned - base, 2) AS delta FROM ({delta})",
        "token_sanitize": f"{tokens} SELECT o_orderkey, array_to_string(ids, ',') AS ids FROM t",
        "generation_length": f"{tokens} SELECT count(*) AS rows, round(avg(len(list_filter(ids, lambda x: x <> 0))), 1) AS gen_len FROM t",
        "prefix_inputs": f"{_PAIRS} SELECT row_ord, 'summarize: ' || {_space(nfc)} AS input FROM pairs",
        "compression_ratio": f"{_KEYED} SELECT row_ord, round(CASE WHEN article_words > 0 THEN (1 - CAST(summary_words AS DOUBLE) / article_words) * 100 END, 1) AS saved FROM keyed",
        "tokenize_pairs": f"{_PAIRS} SELECT row_ord, CAST(least(768, octet_length(encode(coalesce(raw_article, ''))) + 1) AS BIGINT) AS inputs, CAST(least(160, octet_length(encode(coalesce(raw_summary, ''))) + 1) AS BIGINT) AS labels FROM pairs",
        "metric_files": (
            "SELECT run, arg_min(file, place) AS file FROM (SELECT 'run' || CAST(o_orderkey % 997 AS VARCHAR) AS run, "
            "['test_metrics.json', 'validation_metrics.json', 'eval_results.json', 'train_results.json'][o_custkey % 4 + 1] AS file, "
            "3 - o_custkey % 4 AS place FROM orders) WHERE place > 0 GROUP BY run"
        ),
        "score_prefixes": (
            "WITH m AS (SELECT 'run' || CAST(o_orderkey % 997 AS VARCHAR) AS run, ['eval_', 'validation_', 'test_', ''][o_custkey % 4 + 1] || "
            "['rouge1', 'rouge2', 'rougeL'][o_orderkey % 3 + 1] AS name, CAST(o_custkey % 100 AS DOUBLE) AS value FROM orders) SELECT run, "
            + ", ".join(
                "coalesce(" + ", ".join(f"max(CASE WHEN name = '{p}{m}' THEN value END)" for p in ("eval_", "validation_", "test_", "")) + f', 0.0) AS "{m}"'
                for m in ("rouge1", "rouge2", "rougeL")
            )
            + " FROM m GROUP BY run"
        ),
        "durations": (
            "SELECT o_orderkey, CASE WHEN s >= 3600 THEN CAST(s // 3600 AS VARCHAR) || 'h ' ELSE '' END || "
            "CASE WHEN s % 3600 >= 60 THEN CAST(s % 3600 // 60 AS VARCHAR) || 'm ' ELSE '' END || CAST(s % 60 AS VARCHAR) || 's' AS took "
            "FROM (SELECT o_orderkey, o_orderkey % 9000 AS s FROM orders)"
        ),
        "summarize_batch": f"{_NORM} SELECT row_ord, array_to_string(({words('article')})[1:20], ' ') AS prediction FROM normed",
    }
