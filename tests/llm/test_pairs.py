"""Near-duplicates, cross-split overlaps and item leaks against brute force."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest

from corpusloom.llm import leaks, neardup, overlap, vertical
from corpusloom.llm.shingles import batch_runs, batch_words, words

SCHEMA = "pair_id long, article string, summary string, outlet string, id long, text string, kind string"


def runs(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def like(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def variants(seed, n, size=60):
    """Texts of a small vocabulary, most of them edits of others, with repeats, nulls and long ones."""
    rng = random.Random(seed)
    vocabulary = [f"từ{k}" for k in range(80)] + ["β", "cœur", "Ðình", "２５", "学生", "don't"]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(3, size))] for _ in range(max(2, n // 4))]
    out = []
    for k in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 6))):
            text.insert(rng.randrange(len(text) + 1), rng.choice(vocabulary))
        out.append(" ".join(text))
    return [*out, None, "", "một hai ba", " ".join(vocabulary * 40), " ".join(vocabulary * 40)]


def records(spark, texts, start=0):
    rows = [(start + k, t, None if k % 5 else "thêm một câu ngắn ở đây", None, k, "clash", "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), {r[0]: r for r in rows}


def test_words_hash_alike_in_batches():
    texts = variants(1, 50)
    hashed, owner = batch_words(texts)
    known = {}
    for k, text in enumerate(texts):
        own = hashed[owner == k].tolist()
        assert len(own) == len(words(text))
        for word, value in zip(words(text), own, strict=True):
            assert known.setdefault(word, value) == value
    assert len(set(known.values())) == len(known)
    found, who = batch_runs(texts)
    for k, text in enumerate(texts):
        assert len(set(found[who == k].tolist())) == len(runs(text))


@pytest.mark.parametrize("threshold,seed", [(0.5, 3), (0.8, 4)])
def test_near_duplicates_are_those_of_brute_force(spark, threshold, seed):
    frame, rows = records(spark, variants(seed, 90))
    pairs, members = neardup.near_duplicates(frame, threshold=threshold)
    found = {tuple(r) for r in neardup.all_pairs(pairs, members).collect()}
    sets = {k: runs(f"{r[1] or ''} {r[2] or ''}") for k, r in rows.items()}
    assert found == {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if like(sets[a], sets[b]) >= threshold}
    groups = {r["id"]: r for r in neardup.near_duplicate_groups(frame, threshold=threshold).collect()}
    assert set(groups) == {k for k, s in sets.items() if s}
    assert all(sets[k] == sets[r["class_id"]] for k, r in groups.items())


def test_tags_separate_words():
    assert words("<p>Một hai<br/>ba</p> 3 < 5 và x<y") == ["một", "hai", "ba", "3", "5", "và", "x", "y"]
    assert words("a<b") == ["a", "b"] and words(None) == []


def test_a_group_of_copies_is_one_class(spark):
    texts = ["cùng một bản tin được đăng lại nhiều lần ở đây"] * 300 + variants(9, 20)
    frame, _ = records(spark, texts)
    pairs, members = neardup.near_duplicates(frame, threshold=0.5)
    assert members.filter("id < 300 and id % 5 > 0").select("rep").distinct().count() == 1
    assert pairs.count() < 300


def test_empty_tables(spark):
    frame = spark.createDataFrame([], SCHEMA)
    pairs, members = neardup.near_duplicates(frame)
    assert neardup.all_pairs(pairs, members).count() == 0
    assert overlap.cross_split_overlaps(frame, {"test": frame}).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    documents = spark.createDataFrame([], "doc_id long, text string")
    assert leaks.leaked_items(documents, items).count() == 0


def test_cross_split_overlaps_are_those_of_brute_force(spark):
    train, a = records(spark, variants(5, 60))
    test, b = records(spark, variants(5, 40), 1000)
    other, c = records(spark, variants(6, 30), 2000)
    rows = overlap.cross_split_overlaps(train, {"validation": other, "test": test}).collect()
    found = {tuple(r)[:3] for r in rows if r["kind"] != "short"}
    expected, equal = set(), set()
    for name, side in (("test", b), ("validation", c)):
        for i, x in a.items():
            for j, y in side.items():
                if any(like(runs(x[f]), runs(y[f])) >= 0.5 for f in (1, 2)):
                    expected.add((name, i, j))
                if any(words(x[f]) == words(y[f]) and len(words(x[f])) > 4 for f in (1, 2)):
                    equal.add((name, i, j))
    assert found == expected
    assert {tuple(r)[:3] for r in rows if r["kind"] == "exact"} == equal
    report = overlap.overlap_report(overlap.cross_split_overlaps(train, {"test": test}), {"test": test}).collect()
    assert sum(r["records"] for r in report) == test.count()


def test_ids_stay_as_they_are_and_short_records_are_told_apart(spark):
    text, large = "một bản tin dài hơn năm từ được đăng lại", 9007199254740993
    train = spark.createDataFrame([(large, text, None), (large + 1, "Hôm nay trời đẹp", "")], "pair_id long, article string, summary string")
    test = spark.createDataFrame([(large + 2, text.upper() + "!", None), (large, "hôm nay, trời đẹp.", "")], train.schema)
    found = {tuple(r) for r in overlap.cross_split_overlaps(train, {"validation": test, "test": test}).collect()}
    assert found == {(s, large, large + 2, "exact") for s in ("validation", "test")} | {(s, large + 1, large, "short") for s in ("validation", "test")}


def test_slots_do_not_change_the_pairs(spark):
    texts = variants(3, 120, 120)
    texts += [" ".join([*t.split(), "mọi", "bản", "tin", "đều", "kết", "thúc", "như", "nhau"]) for t in texts if t]
    frame = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "id long, kind int, text string").repartition(6)
    sets = [runs(t or "") for t in texts]
    wanted = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if like(sets[a], sets[b]) >= 0.5}
    for fragments, slots in ((16, 1), (16, 3), (4, 7), (70, 2)):
        pairs, members = vertical.similar_texts(frame, 0.5, fragments=fragments, slots=slots)
        assert {tuple(r) for r in neardup.all_pairs(pairs, members).collect()} == wanted


def test_a_part_goes_to_a_bounded_number_of_slots():
    rng = np.random.default_rng(5)
    runs_ = np.sort(rng.integers(1 << 20, 1 << 62, 4000).astype(np.uint64))
    begin, size = np.arange(0, 4000, 16), np.full(250, 16)
    for slots in (2, 8, 64, 1000):
        slot, part, role = vertical._routes(runs_, begin, size, 1, slots, 0.5, runs_[::40].copy())
        assert np.bincount(part).max() <= 10 and (np.bincount(part[role & 2 > 0]) == 1).all() and slot.max() < slots


@pytest.mark.parametrize("most", [1 << 24, 1500])
def test_leaks_are_those_of_brute_force(spark, most):
    texts = variants(7, 50)
    items = [t for t in variants(7, 25, 30) if t] + [None]
    documents = [(k, f"{t or ''} {texts[(k * 7) % len(texts)] or ''}" if k % 9 else t, "vi") for k, t in enumerate(texts)]
    asked = [(k, t, "quiz") for k, t in enumerate(items)]
    found = leaks.leaked_items(
        spark.createDataFrame(documents, "doc_id long, text string, lang string"),
        spark.createDataFrame(asked, "item_id long, text string, item_kind string"), shard_bytes=most,
    )
    sets = {k: runs(t) for k, t, _ in asked}
    expected = {(d, k) for d, t, _ in documents for k, s in sets.items() if s and len(runs(t) & s) >= 0.4 * len(s)}
    assert {tuple(r)[:2] for r in found.collect()} == expected
    assert all(r["held"] == len(runs(documents[r["doc_id"]][1]) & sets[r["item_id"]]) and r["score"] > 0 for r in found.collect())
    report = leaks.leak_report(found, spark.createDataFrame(asked, "item_id long, text string, item_kind string"))
    assert report.count() == len(asked)


def test_block_max_wand_reads_less_and_finds_the_same(data):
    items = pd.read_parquet(f"{data}/eval_items.parquet")
    texts = pd.read_parquet(f"{data}/documents.parquet").text.tolist()
    index = leaks.ItemIndex(items.item_id.tolist(), items.text.tolist(), 0.4)
    found = {(d, int(index.ids[k])) for d, k, *_ in index.search(*batch_runs(texts), len(texts))}
    sets = {k: runs(t) for k, t in zip(items.item_id, items.text, strict=True)}
    assert found == {(d, k) for d, t in enumerate(texts) for k, s in sets.items() if s and len(runs(t) & s) >= 0.4 * len(s)} and found
    assert index.read < index.postings  # beside the documents that were left before any cursor was opened


def grown(words_so_far, n, rng, inside):
    """n more words whose runs fall into the first of 16 fragments, or outside of it."""
    out = list(words_so_far)
    while n:
        made = [f"w{rng.randrange(10**9)}" for _ in range(64)]
        hashed, owner = batch_runs([" ".join([*out[-4:], w]) for w in made])
        fits = [made[k] for k, h in zip(owner, hashed, strict=True) if (int(h) >> 48 < 4096) == inside] if len(out) > 3 else made
        out += fits[:1]
        n -= bool(fits)
    return out


def test_pairs_whose_rare_runs_and_likeness_lie_in_different_fragments(spark):
    rng = random.Random(2)
    common, texts = grown([], 18, rng, False), []
    for _ in range(8):
        rare = grown(common, 6, rng, True)  # shared by two texts only, in a fragment where they are unlike
        texts += [" ".join(grown(rare, k, rng, True)) for k in (10, rng.randint(8, 11))]
    frame = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "id long, kind int, text string").repartition(3)
    sets = [runs(t) for t in texts]
    wanted = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if like(sets[a], sets[b]) >= 0.5}
    pairs, members = vertical.similar_texts(frame, 0.5, fragments=16)
    assert {tuple(r) for r in neardup.all_pairs(pairs, members).collect()} == wanted and len(wanted) > 3
    sides = frame.withColumn("kind", (frame.id % 2).cast("int"))
    pairs, members = vertical.similar_texts(sides, 0.5, cross=True, fragments=16)
    assert {tuple(r) for r in neardup.all_pairs(pairs, members).collect()} == {(a, b) for a, b in wanted if (a + b) % 2}


def test_keys_spread_evenly():
    keys = vertical.even_keys(16, 8)
    places = [vertical._mur(k) % 8 for k in keys]
    assert len(set(keys)) == 16 and max(places.count(p) for p in range(8)) == 2


def test_keys_hash_as_the_engine_does(spark):
    keys = vertical.even_keys(12, 12)
    got = spark.createDataFrame([(k,) for k in keys], "k int").selectExpr("hash(k)").collect()
    assert [r[0] for r in got] == [vertical._mur(k) for k in keys]


def test_whole_train_table_against_brute_force(spark, data):
    frame = spark.read.parquet(f"{data}/train.parquet")
    pairs, members = neardup.near_duplicates(frame, threshold=0.5)
    found = {tuple(r) for r in neardup.all_pairs(pairs, members).collect()}
    rows = pd.read_parquet(f"{data}/train.parquet")
    sets = {i: runs(f"{a or ''} {s or ''}") for i, a, s in zip(rows.pair_id, rows.article, rows.summary, strict=True)}
    assert found == {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if like(sets[a], sets[b]) >= 0.5}
    assert np.all([a < b for a, b in found])


@pytest.mark.parametrize("name", ["p1_found", "p1_groups", "p3_found", "p3_report", "p8_found", "p8_items"])
def test_queries_against_sql(spark, data, name):
    import glob
    import os

    import duckdb

    from corpusloom.llm import queries, sql

    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    wanted = con.execute(sql.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    frame = queries.queries()[name](spark, data)
    assert sorted(frame.columns) == sorted(columns)
    assert sorted(map(tuple, frame.select(*columns).collect()), key=repr) == sorted(wanted.fetchall(), key=repr)


@pytest.mark.parametrize("cross", [False, True])
def test_a_part_is_shipped_once_however_many_slots_there_are(spark, cross):
    texts = variants(11, 160, 120)
    frame = spark.createDataFrame([(k, k % 2 + 16 * (k % 3 == 0) if cross else 0, t) for k, t in enumerate(texts)], "id long, kind int, text string").repartition(9)
    pairs, members = vertical.similar_texts(frame, 0.5, cross=cross, slots=5, cell=300)
    sets = [runs(t or "") for t in texts]
    alike = lambda a, b: like(sets[a], sets[b]) >= 0.5 and (not cross or ((a + b) % 2 and (a % 3 == 0) == (b % 3 == 0)))
    wanted = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if alike(a, b)}
    found = {tuple(r) for r in neardup.all_pairs(pairs, members).collect()}
    assert {p for p in found if alike(*p)} == wanted and wanted and (cross or found == wanted)
    shipped = frame.select("id", "kind", "text").coalesce(1).mapInArrow(
        vertical._entries(np.array(vertical.fragment_keys(16, 5, 16), np.int32), 5), vertical._ENTRY
    ).selectExpr("sum(length(idx)) / 2").first()[0]
    assert shipped == sum(map(len, sets))


def test_slots_of_a_fragment_are_in_one_partition():
    keys = vertical.fragment_keys(16, 7, 40)
    assert len(set(keys)) == 16 * 7 and [vertical._mur(k) % 40 for k in keys] == [f for f in range(16) for _ in range(7)]


def test_short_texts_have_fewer_parts_and_blocks_tell_of_no_tasks(spark):
    texts = variants(13, 150, 60)
    frame = spark.createDataFrame([(k, k % 2, t) for k, t in enumerate(texts)], "id long, kind int, text string").coalesce(1)
    pack = lambda coarse: frame.mapInArrow(vertical._entries(np.array(vertical.even_keys(16, 16), np.int32), 1, coarse), vertical._ENTRY)
    assert "tasks" not in pack(frozenset()).columns
    shipped = [pack(c).selectExpr("sum(length(idx)) / 2", "sum(length(marks)) / 16", "count(idx)").first() for c in (frozenset(), frozenset([0]))]
    assert shipped[0][0] == shipped[1][0] and shipped[1][1] < 0.7 * shipped[0][1] and shipped[1][2] < shipped[0][2]
    sets = [runs(t or "") for t in texts]
    assert np.mean([len(t or "") for t in texts]) <= vertical.SHORT_BYTES
    for slots, cell in ((1, 10**6), (3, 200)):
        pairs, members = vertical.similar_texts(frame, 0.5, cross=True, slots=slots, cell=cell)
        found = {tuple(r) for r in neardup.all_pairs(pairs, members).collect() if (r[0] + r[1]) % 2}
        assert found == {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if (a + b) % 2 and like(sets[a], sets[b]) >= 0.5} and found
