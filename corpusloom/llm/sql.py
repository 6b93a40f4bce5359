"""SQL for those training-data queries that SQL can express.

Words are those of the plain form as far as equality goes: zero-width characters are deleted, special spaces separate,
full-width forms and ligatures are spelled out, and look-alike letters are merged with the letter they look like in
every text alike, which keeps equal words equal. All pairs that share a run are counted, without any filter.
"""

from __future__ import annotations

from corpusloom.llm.plain import _KANA, _LATIN, _TO_LATIN

_WIDE = "".join(chr(c) for a, b in ((0xFF10, 0xFF1A), (0xFF21, 0xFF3B), (0xFF41, 0xFF5B)) for c in range(a, b))
_FROM = _WIDE + "".join(map(chr, _TO_LATIN)) + "".join(_KANA)
_TO = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE) + "".join(_TO_LATIN.values()) + "".join(_KANA.values())
assert len(_FROM) == len(_TO) and _LATIN
_HIDDEN = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}]"


def _words(text: str) -> str:
    x = f"regexp_replace(coalesce({text}, ''), '</?[A-Za-z][^<>]*>', ' ', 'g')"
    x = f"regexp_replace({x}, '{_HIDDEN}', '', 'g')"
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("Ǆ", "DŽ"), ("ǆ", "dž"), ("ĳ", "ij"), ("Ĳ", "IJ")):
        x = f"replace({x}, '{a}', '{b}')"
    apart = f"nfc_normalize(translate(nfc_normalize({x}), '{_FROM}', '{_TO}'))"
    return rf"regexp_extract_all(lower({apart}), '[\p{{L}}\p{{N}}\p{{M}}_]+')"


def _runs(table: str, columns: str, text: str, name: str) -> str:
    """CTE of the distinct five-word runs of every row, and of their number."""
    w = f"SELECT {columns}, {_words(text)} AS w FROM {table}"
    runs = "CASE WHEN len(w) < 5 THEN [] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i + 4], ' ')))) END"
    names = ", ".join(c.split(" AS ")[-1].strip() for c in columns.split(","))
    return f"{name}_s AS MATERIALIZED (SELECT {names}, {runs} AS s FROM ({w})), {name} AS MATERIALIZED (SELECT {names}, len(s) AS n, unnest(s) AS g FROM {name}_s)"


def _overlaps() -> str:
    parts = []
    for field in ("article", "summary"):
        parts.append(_runs("train", "pair_id", field, f"t_{field}"))
        held = f"(SELECT 'validation' AS split_name, pair_id, {field} FROM validation UNION ALL SELECT 'test', pair_id, {field} FROM test)"
        parts.append(_runs(held, "split_name, pair_id", field, f"e_{field}"))
        parts.append(
            f"p_{field} AS MATERIALIZED (SELECT split_name, train_id, eval_id FROM (SELECT e.split_name, t.pair_id AS train_id, e.pair_id AS eval_id, any_value(t.n) AS a, "
            f"any_value(e.n) AS b, CAST(count(*) AS DOUBLE) AS k FROM t_{field} t JOIN e_{field} e USING (g) GROUP BY ALL) WHERE k / (a + b - k) >= 0.5)"
        )
    return f"WITH {', '.join(parts)}, found AS MATERIALIZED (SELECT * FROM p_article UNION SELECT * FROM p_summary)"


def _report() -> str:
    held = lambda c: f"(SELECT 'validation' AS split_name, pair_id, {c} FROM validation UNION ALL SELECT 'test', pair_id, {c} FROM test)"
    same = " UNION ALL ".join(
        f"SELECT e.split_name, t.pair_id AS train_id, e.pair_id AS eval_id, CASE WHEN len(w) < 5 THEN 2 ELSE 0 END AS rank "
        f"FROM (SELECT pair_id, {_words(c)} AS w FROM train) t JOIN (SELECT split_name, pair_id, {_words(c)} AS w FROM {held(c)}) e USING (w) WHERE len(w) > 0"
        for c in ("article", "summary")
    )
    kinds = ", ".join(f"CAST(coalesce(sum({k}), 0) AS BIGINT) AS {k}" for k in ("links", "exact", "near", "short"))
    return (
        f"{_overlaps()}, every AS (SELECT *, 1 AS rank FROM found UNION ALL {same}), best AS (SELECT split_name, train_id, eval_id, min(rank) AS rank FROM every GROUP BY ALL), "
        "per AS (SELECT split_name, eval_id AS pair_id, count(*) AS links, count(*) FILTER (rank = 0) AS exact, count(*) FILTER (rank = 1) AS near, "
        f"count(*) FILTER (rank = 2) AS short FROM best GROUP BY ALL) SELECT split_name, outlet, count(*) AS records, count(links) AS overlapping, "
        f"count(*) FILTER (exact > 0) AS exact_records, {kinds} FROM {held('outlet')} LEFT JOIN per USING (split_name, pair_id) GROUP BY split_name, outlet"
    )


def _groups(train: str) -> str:
    return (
        f"WITH {train}, cls AS MATERIALIZED (SELECT pair_id, min(pair_id) OVER (PARTITION BY list_sort(s)) AS class_id FROM r_s WHERE len(s) > 0), "
        "one AS MATERIALIZED (SELECT r.* FROM r JOIN cls USING (pair_id) WHERE pair_id = class_id), "
        "pairs AS (SELECT a.pair_id AS x, b.pair_id AS y FROM one a JOIN one b ON a.g = b.g AND a.pair_id < b.pair_id GROUP BY ALL "
        "HAVING CAST(count(*) AS DOUBLE) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.8), "
        "links AS (SELECT class_id, count(*) AS links FROM (SELECT x AS class_id FROM pairs UNION ALL SELECT y FROM pairs) GROUP BY class_id) "
        "SELECT pair_id, class_id, coalesce(links, 0) AS links FROM cls LEFT JOIN links USING (class_id)"
    )


def oracle_sql() -> dict[str, str]:
    train = _runs("train", "pair_id", "coalesce(article, '') || ' ' || coalesce(summary, '')", "r")
    leaks = (
        f"WITH {_runs('documents', 'doc_id', 'text', 'd')}, {_runs('eval_items', 'item_id', 'text', 'q')}, found AS MATERIALIZED ("
        "SELECT doc_id, item_id FROM (SELECT d.doc_id, q.item_id, any_value(q.n) AS n, count(*) AS k FROM d JOIN q USING (g) GROUP BY ALL) WHERE k >= 0.4 * n)"
    )
    return {
        "p1_found": (
            f"WITH {train} SELECT pair_id_a, pair_id_b FROM (SELECT a.pair_id AS pair_id_a, b.pair_id AS pair_id_b, any_value(a.n) AS na, any_value(b.n) AS nb, "
            "CAST(count(*) AS DOUBLE) AS k FROM r a JOIN r b ON a.g = b.g AND a.pair_id < b.pair_id GROUP BY ALL) WHERE k / (na + nb - k) >= 0.5"
        ),
        "p1_groups": _groups(train),
        "p3_report": _report(),
        "p3_found": f"{_overlaps()} SELECT split_name, train_id, eval_id FROM found",
        "p8_found": f"{leaks} SELECT doc_id, item_id FROM found",
        "p8_items": (
            f"{leaks} SELECT item_id, any_value(item_kind) AS item_kind, count(found.doc_id) AS documents FROM eval_items LEFT JOIN found USING (item_id) GROUP BY item_id"
        ),
    }
