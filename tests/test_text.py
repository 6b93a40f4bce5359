"""Text functions against plain Python on hand-written rows."""

import hashlib
import html
import re
import unicodedata
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as T

ROWS = [
    None, "", "  ", "&lt;b&gt;Sốt&lt;/b&gt; cao", "a&amp;lt;b", "ho​t", "a<br/>b", "3 < 5 và 7 > 2", "é", "e​́",
    "a\x85b\x1cc\xa0d", "Straße", "STRASSE", "Ａｂ　ｃ", 'A. B? "C." D', "v1.2 là bản", "một hai ba bốn", "x" * 5000 + " y", "tab\tnew\nline",
]


def normal(t):
    t = unicodedata.normalize("NFC", html.unescape(t or ""))
    t = re.sub("[​‌‍⁠﻿]", "", t)
    t = re.sub("</?[A-Za-z][^>]*>", " ", t)
    t = "".join(" " if unicodedata.category(c) == "Cc" else c for c in t)
    return re.sub(r"\s+", " ", t).strip()


def folded(t):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t).casefold()).strip()


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(ROWS)), "i int, t string")


def column(frame, expression):
    return [r[0] for r in frame.orderBy("i").select(expression).collect()]


def test_normalize_text(rows):
    assert column(rows, T.normalize_text(F.col("t"))) == [normal(t) for t in ROWS]


def test_normalize_cases(rows):
    got = column(rows, T.normalize_text(F.col("t")))
    assert got[3] == "Sốt cao" and got[4] == "a&lt;b" and got[5] == "hot" and got[6] == "a b" and got[7] == ROWS[7]
    assert got[8] == "é" and len(got[9]) == 2 and got[10] == "a b c d"


def test_canonical_key(rows):
    got = column(rows, T.canonical_key(T.normalize_text(F.col("t"))))
    assert got == [folded(normal(t)) for t in ROWS]
    assert got[11] == got[12]


def test_matching_and_manifest(rows):
    assert column(rows, T.matching_text(F.col("t")))[14] == " a b c d "
    assert column(rows, T.matching_text(F.col("t")))[0] == "  "
    assert column(rows, T.manifest_key(F.col("t")))[11:14] == ["straße", "strasse", "ab c"]


def test_word_count(rows):
    assert column(rows, T.word_count(F.col("t"))) == [len((t or "").split()) for t in ROWS]


def test_sentences(rows):
    got = column(rows, T.split_sentences(F.coalesce("t", F.lit(""))))
    assert got[14] == ["A.", "B?", '"C."', "D"] and got[15] == ["v1.2 là bản"] and got[0] == []


def test_shingles(spark):
    words = [None, [], ["a"] * 4, ["a", "b", "c", "d", "e", "f"], ["a"] * 9]
    frame = spark.createDataFrame(list(enumerate(words)), "i int, w array<string>")
    got = column(frame, T.shingles(F.coalesce("w", F.array().cast("array<string>"))))
    for w, values in zip(words, got, strict=True):
        w = w or []
        assert set(values) == {zlib.crc32("\x1f".join(w[k : k + 5]).encode()) for k in range(len(w) - 4)}
    assert [sorted(v)[:32] for v in got] == column(frame, T.bottom_k(T.shingles(F.coalesce("w", F.array().cast("array<string>")))))


def test_shingles_of_keys(spark):
    keys = [None, "", "a b c d", "a b, c-d e f_1 ²g", "ß " * 9]
    frame = spark.createDataFrame(list(enumerate(keys)), "i int, k string")
    words = F.regexp_extract_all(F.coalesce("k", F.lit("")), F.lit(f"({T.WORD})"), F.lit(1))
    assert column(frame, T.key_shingles(F.col("k"))) == column(frame, F.array_sort(T.shingles(words)))


def test_jaccard(spark):
    frame = spark.createDataFrame([(0, [1, 2, 3], [2, 3, 4]), (1, [], [1]), (2, [1], [1])], "i int, a array<bigint>, b array<bigint>")
    assert column(frame, T.jaccard(F.col("a"), F.col("b"))) == [0.5, 0.0, 1.0]


def test_stable_bucket(rows):
    got = column(rows, T.stable_bucket(F.coalesce("t", F.lit(""))))
    assert got == [int.from_bytes(hashlib.sha256((t or "").encode()).digest()[:8], "big") / 2**64 for t in ROWS]


def test_duration(spark):
    frame = spark.createDataFrame([(0, 3723.9), (1, 59.0), (2, 0.0), (3, 3600.0)], "i int, s double")
    assert column(frame, T.format_duration(F.col("s"))) == ["1h 2m 3s", "59s", "0s", "1h 0s"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x2FFF, exclude_categories=("Cs", "Cn", "Co"))), min_size=1, max_size=20))
def test_normalization_of_any_text(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert column(frame, T.normalize_text(F.col("t"))) == [normal(t) for t in texts]
