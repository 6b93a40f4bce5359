"""Plain forms, sentence units, reading levels, packing, areas and defects on small cases."""

import random
import unicodedata
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import areas, defects, levels, lookalikes, packing, sentences
from corpusloom.llm.plain import WORD, differs, plain_form, skeleton
from corpusloom.llm.shingles import plain_batch

PLAIN = [
    ("interferon α", "interferon α"), ("Đề tа̀i", "Đề tài"), ("huуện", "huyện"), ("Ðình", "Đình"), ("conﬁrmed", "confirmed"),
    ("ｐｒｅｇｎａｎｔ", "pregnant"), ("TS.B‌S.", "TS.BS."), ("Москва", "Москва"), ("χρόνος", "χρόνος"), ("cœur", "cœur"),
    ("a b　c", "a b c"), ("é", "é"), ("柳塘，镇。", "柳塘，镇。"), ("“ok” «x»", "“ok” «x»"), ("５２", "52"), ("", ""), (None, None),
    ("so­ft", "soft"), ("thuốc chẹn β", "thuốc chẹn β"), ("ΟΚ của", "OK của"), ("эxо", "эхо"),
]


@pytest.mark.parametrize("text,plain", PLAIN)
def test_plain_form(text, plain):
    assert plain_form(text) == plain
    assert plain_form(plain) == plain
    assert differs(text) == (text != plain)
    assert plain_batch([text]) == [plain or ""]


def test_skeletons_of_look_alikes_are_equal():
    assert len({skeleton(t) for t in ("Đình", "Ðình", "Đình", "Đ​ình", "Đìnһ")}) == 1
    assert skeleton("Đình") != skeleton("Dinh")
    assert skeleton(None) is None


def test_look_alike_queries(spark):
    rows = [(1, "huуện", "ok", "a"), (2, None, "ｘ", "b"), (3, "", "huyện", None), (4, "huyện", None, "c"), (4, "huyện", None, "c")]
    frame = spark.createDataFrame(rows, "pair_id long, article string, summary string, id string")
    assert {tuple(r) for r in lookalikes.unlike_fields(frame).collect()} == {(1, "article"), (2, "summary")}
    plain = {r["pair_id"]: r for r in lookalikes.plain_texts(frame).collect()}
    assert plain[1]["article"] == "huyện" and plain[2]["article"] is None and plain[2]["id"] == "b"
    group = lookalikes.skeleton_groups(frame).collect()
    assert [(r["texts"], r["forms"]) for r in group] == [(4, 2)]
    assert lookalikes.unlike_fields(frame.limit(0)).count() == 0


def test_groups_are_of_texts_that_look_the_same(spark):
    rows = [(1, "HUYỆN", "huyện"), (2, "HUУỆN", "Huyện"), (3, "", None)]  # the second has a Cyrillic letter
    frame = spark.createDataFrame(rows, "pair_id long, article string, summary string")
    assert [(r["texts"], r["forms"]) for r in lookalikes.skeleton_groups(frame).collect()] == [(2, 2)]
    assert lookalikes.skeleton_groups(frame.filter("pair_id <> 2")).count() == 0
    assert lookalikes.skeleton_groups(frame.limit(0)).columns == ["skeleton_hash", "texts", "forms"]


@pytest.fixture(scope="module")
def splitter(data):
    return sentences.fit(pd.read_parquet(f"{data}/train.parquet").article)


CASES = [
    "Ca mổ kéo dài 9 giờ.| Đừng chủ quan!| Con số là bao nhiêu, 8 hay 691?| Hết.",
    "Ê-kíp của TS.BS. Ngụy Uyển Huân ở TP. Sông Mơ dùng 3.2 mg thuốc.| Ở Q. 4, mọi việc ổn.| Họ rời Q. 4.| Sau đó im lặng.",
    "Đến nay vẫn còn 86 ý kiến... chưa được phản hồi.| Gồm ngư dân, tổ trưởng, v.v. và người khác.| Có giáo viên, v.v.| Theo ông, tốt.",
    '"Ai cũng mong sẽ khác. Mọi việc ổn định", BS.CKII Lữ Bảo Nhiên nói.| Tiếp theo là bản tin.',
    'Hàng xóm chỉ nói gọn: "Mọi việc rất tích cực!"| Thử nghiệm mù đôi bắt đầu.',
    '"Tôi đã chờ lâu! Mọi việc rất nhanh?" - tổ trưởng hỏi khi gặp GS.TS. Bạch Hải Vỹ.| Sau đó họ đi.',
    "Danh sách gồm: 1. gia đình; 2. hàng xóm; 3. thanh niên.| Đêm gây quỹ thành công.",
    "Dr. Maren E. Wexcombe closed 3.5 mm at 5 p.m. on vitamin D.| The ward in St. Orrin agreed, i.e. 3% of it.| Fine.",
    "The second word.|Blood tests rose.|\nThe view from Quayside|\nA blinded comparison ran.",
    "M. Gaspard A. Brunelois précise : « Restez calmes. »| Après 8 jours, c'est fini.| Pourquoi avoir attendu 44 mois ?| Rien.",
    "检查显示指标为8.7。|37天后，好转。|逄知远医生说：“我们等了69天。请大家保持冷静。”|患者入院。|“请大家保持冷静！”邻居说。|为什么？|好。",
    "霧積朔医師は「原因は古い設備だ。長い移動だ。」と話した。|「33日待った！」と家族は言った。|治療は9.5日。",
    "ผลตรวจปอดอยู่ที่ 7.5 เทียบกับค่าปกติ 89.9 หน่วย| ญาติของผู้ป่วยรอมา 8 เดือนแล้ว| แพทย์กล่าวว่า “เรารอ มานาน”",
]


@pytest.mark.parametrize("marked", CASES)
def test_sentence_units(splitter, marked):
    text = marked.replace("|", "")
    assert splitter.sentences(text) == [p.strip() for p in marked.split("|")]


def test_sentence_offsets_and_odd_inputs(splitter, spark):
    for text in (None, "", "  \n 　", "​"):
        assert splitter.units(text) == []
    text = "  Ｔrong khi đó, ê-kíp của Ｔ​S. Lê Văn An đến. Hết giờ! "
    units = splitter.units(text)
    assert [text[a:b] for a, b in units] == ["Ｔrong khi đó, ê-kíp của Ｔ​S. Lê Văn An đến.", "Hết giờ!"]
    long = "Một câu dài vừa phải để thử. " * 20_000
    assert len(splitter.units(long)) == 20_000
    frame = spark.createDataFrame([(1, "Một câu. Hai câu."), (2, None), (None, "Ba câu.")], "pair_id long, article string")
    assert sentences.sentence_units(frame).count() == 3
    assert sentences.sentence_units(frame.limit(0)).count() == 0


def test_boundaries_agree_on_held_out_rows(data):
    """Fitted on half of the texts, the sure boundaries of the other half come out right."""
    texts = [t for t in pd.read_parquet(f"{data}/train.parquet").article if t]
    model = sentences.fit(texts[::2])
    right = total = 0
    for text in texts[1::2]:
        for line in sentences._LINE.finditer(sentences.view(text)):
            for end, to, features in sentences.candidates(line[0]):
                if (label := sentences.sure(features, to >= len(line[0].rstrip()))) is not None:
                    total += 1
                    right += model.decide(features) == label
    assert total > 500 and right / total > 0.99


def test_reading_levels(spark, data):
    samples = spark.read.parquet(f"{data}/level_samples.parquet")
    accuracy = {r["lang"]: r["right"] / r["samples"] for r in levels.level_accuracy(samples).collect()}
    assert accuracy["vi"] > 0.9
    known = samples.selectExpr("sample_id as doc_id", "text", "reading_level as wanted")
    graded = levels.reading_levels(known, samples).join(known, "doc_id")
    assert graded.filter("reading_level = wanted").count() > 0.95 * known.count()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "<p></p>"), (None, "Con ngủ sớm nhé!"), (5, "Con ngủ sớm nhé! " * 30_000)], "doc_id long, text string")
    out = {r["doc_id"]: r["reading_level"] for r in levels.reading_levels(odd, samples).collect()}
    assert len(out) == 5 and out[5] == 1
    assert levels.reading_levels(odd.limit(0), samples).count() == 0
    assert levels.reading_levels(odd, samples.limit(0)).count() == 5


def test_held_out_passages_do_not_count(spark, data):
    samples = spark.read.parquet(f"{data}/level_samples.parquet")
    low = "Con ngủ sớm nhé! Bé ăn 6 quả chuối. Em mệt quá rồi."
    passage = " ".join(r["text"] for r in samples.filter("reading_level = 4 and lang = 'vi'").limit(3).collect())
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    frame = spark.createDataFrame([(1, f"{low} {passage}")], "doc_id long, text string")
    assert levels.reading_levels(frame, samples, items).first()["reading_level"] == 1
    assert levels.reading_levels(frame, samples).first()["reading_level"] == 4
    many = items.unionByName(spark.createDataFrame([(k, f"đoạn văn số {k} không có ở đâu cả") for k in range(2, 40)], items.schema))
    assert levels.reading_levels(frame, samples, many, shard=9).first()["reading_level"] == 1


@pytest.mark.parametrize("windows", [2, 256])
def test_packing(spark, windows):
    rows = [(k, "a" * ((k * 37) % 90)) for k in range(400)] + [(1000, None), (1001, "é" * 400), (1001, "é" * 400), (None, "b")]
    items = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kinds = spark.createDataFrame([("small", 100), ("large", 350)], "container_kind string, capacity_tokens long")
    placed = packing.pack(items, kinds, windows=windows).toPandas()
    fill = placed.groupby(["container_kind", "capacity_tokens", "container_id"]).tokens.sum().reset_index()
    assert (fill.tokens <= fill.capacity_tokens).all()
    size = sum(len((t or "").encode()) + 1 for _, t in rows)
    assert placed.groupby("container_kind").tokens.sum().tolist() == [size, size]
    split = placed[placed.piece > 0]
    assert set(split.doc_id) == {1001}
    assert (placed[(placed.doc_id == 1001) & (placed.container_kind == "large")].groupby("piece").size() == 2).all()
    report = packing.filling_report(packing.pack(items, kinds, windows=windows)).toPandas()
    assert (report.free_share < 0.2).all()
    assert packing.pack(items.limit(0), kinds).count() == 0


def test_packing_holds_when_the_order_of_items_changes(spark, monkeypatch):
    """Many small partitions behind a shuffle, merged in several levels of small groups."""
    monkeypatch.setattr(packing, "MERGED", 8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = [(k, "a" * ((k * 53) % 70)) for k in range(600)]
        items = spark.createDataFrame(rows, "doc_id long, text string").orderBy(F.rand()).repartition(23)
        kinds = spark.createDataFrame([("small", 100)], "container_kind string, capacity_tokens long")
        placed = packing.pack(items, kinds, windows=4)
        for _ in range(2):  # each time the plan of the placements could run again
            found = placed.toPandas()
            assert sorted(found.doc_id) == list(range(600)) and (found.groupby("container_id").tokens.sum() <= 100).all()
        containers = found.container_id.nunique()
        assert containers * 100 * 0.85 < found.tokens.sum()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_best_fit():
    packer = packing.Packer(10, 2)
    assert [packer.put(s) for s in (6, 7, 3, 4, 9, 1)] == [0, 1, 1, 0, 2, 2]
    packer = packing.Packer(10, 1)
    assert [packer.put(s) for s in (6, 7, 3)] == [0, 1, 1]


def test_subject_areas(spark, data):
    data = data.replace("sf0.001", "sf0.01")  # enough documents to learn from
    frame = spark.read.parquet(f"{data}/train.parquet")
    names = spark.read.parquet(f"{data}/subject_areas.parquet")
    sport = "Vòng loại bắt đầu 5/6, mỗi đội đá 7 lượt trên sân. Trọng tài rút 3 thẻ. "
    garden = "Lá vàng do đất bí, hãy xới gốc rồi bón 51 g phân hữu cơ. "
    odd = [(900001, sport * 3 + garden), (900002, sport + garden), (900003, None), (900004, "Video"), (900005, "  "), (900006, garden * 5000)]
    more = spark.createDataFrame(odd, "pair_id long, article string")
    found = areas.subject_areas(frame.select("pair_id", "article").unionByName(more), names).filter("pair_id > 900000").collect()
    got = {(r["pair_id"], r["area_code"]) for r in found}
    assert got == {(900001, "sport"), (900002, "sport"), (900002, "gardening"), (900006, "gardening")}
    assert areas.subject_areas(frame.limit(0), names).count() == 0 and areas.subject_areas(frame, names.limit(0)).count() == 0


def test_area_labels_come_from_neighbours():
    """Sentences without any keyword are told by what they stand beside; neutral ones by standing everywhere."""
    rng = random.Random(4)
    topic = [[f"key{a} start", *(f"alpha{a}x{k} beta{a}x{k}" for k in range(8))] for a in range(8)]
    neutral = [f"plain{k} words{k}" for k in range(3)]
    sentences, document, wanted = [], [], []
    for d in range(400):
        for _ in range(8):
            general = rng.random() < 0.25
            sentences.append(rng.choice(neutral if general else topic[d % 8]))
            document.append(d)
            wanted.append(8 if general else d % 8)
    bucket, owner = areas.sentence_features(sentences)
    hits = np.array([[f"key{a} " in s for a in range(8)] for s in sentences], float)
    share = areas.neighbour_labels(bucket, owner, np.array(document), hits).argmax(1)
    assert (share == wanted).mean() > 0.97


def test_area_classifiers_on_held_out_sentences(data):
    data = data.replace("sf0.001", "sf0.01")
    rows = pd.read_parquet(f"{data}/train.parquet")
    table = pd.read_parquet(f"{data}/subject_areas.parquet").sort_values("area_code")
    described = list(table[["area_code", "title_vi", "scope_note"]].itertuples(index=False, name=None))
    _, model = areas.fit_areas(list(zip(rows.article, rows.summary, strict=True)), described)
    assert model.held_out > 0.9  # sentences without keywords, of documents kept out of the fit


DEFECTS = {
    "empty": ["", None, "  ", "N/A", "Tóm tắt:", "[không có tóm tắt]", "<br/>", "...", "—"],
    "wrong_language": [
        "With the second biopsy unexpected since late March, pregnant women in Eastmere blame long travel times and the nurse expects more cases.",
        "白鹭洲出现早餐计划，涉及184名护士，郗望舒医生建议多喝水。",
    ],
    "sound": [
        "Ca bệnh được theo dõi tại khoa hồi sức, huyết áp dao động và thân nhiệt ổn định.",
        "Gia đình ở tỉnh Lâm Sa từ chối kháng sinh suốt 27 tuần, bác sĩ nói không thể ép và chỉ khuyên hạn chế muối.",
        "Lien quan ca ghep than keo dai, Benh vien Phu san Ngan Thong thong bao 61 truong hop phuc tap do thiet bi cu.",
    ],
}


def test_defects(spark, data):
    base = spark.read.parquet(f"{data}/train.parquet").select("pair_id", "article", "summary")
    article = base.filter("pair_id = 1 or length(article) > 600").orderBy("pair_id").first()["article"]
    vietnamese = next(
        r["article"] for r in base.orderBy("pair_id").collect() if r["article"] and r["article"].count("đ") > 20 and len(r["article"]) > 600
    )
    rows, wanted = [], {}
    for name, texts in DEFECTS.items():
        for text in texts:
            wanted[900000 + len(rows)] = name
            rows.append((900000 + len(rows), vietnamese, text))
    wanted[900000 + len(rows)] = "copied"
    rows.append((900000 + len(rows), vietnamese, vietnamese))
    wanted[900000 + len(rows)] = "truncated"
    rows.append((900000 + len(rows), vietnamese, DEFECTS["sound"][0] + " Nhóm nghiên cứu của bác sĩ Lữ Bảo Nhiên phân tích 31 mẫu máu và nhận"))
    for stub in (None, "", "Video"):
        wanted[900000 + len(rows)] = "sound"
        rows.append((900000 + len(rows), stub, "N/A"))
    assert article
    frame = base.unionByName(spark.createDataFrame(rows, "pair_id long, article string, summary string"))
    found = {r["pair_id"]: r["defect"] for r in defects.defective_pairs(frame).filter("pair_id >= 900000").collect()}
    assert {k: found.get(k, "sound") for k in wanted} == wanted
    assert defects.defective_pairs(base.limit(0)).count() == 0


SOUND = [
    "石桥乡出现术后感染，涉及640名孕妇，逄青禾主任建议咨询药师。白鹭洲中心医院为一例肾移植手术讨论了59个小时。",
    "霧ヶ原で術後の感染があり、814人の高齢者に影響した。蓮見坂岳斗教授は食事の記録を勧めている。",
]


def test_copies_of_a_sound_record_are_no_template(spark, data):
    base = spark.read.parquet(f"{data}/train.parquet").select("pair_id", "article", "summary")
    prose = [r["article"] for r in base.orderBy("pair_id").collect() if r["article"] and len(r["article"]) > 600 and r["article"].count("đ") > 20]
    local = "石桥乡卫生院上周收治了多名病人，{}。医生说他们都已经好转。镇政府请大家注意饮水卫生，并在三天以内完成检查。"
    rows = [(900000 + k, local.format("有人发热"), SOUND[0]) for k in range(5)]  # loaded again and again
    rows += [(900010 + k, local.format(f"第{k}号病房已满"), SOUND[0]) for k in range(4)]  # a whole summary, though of few words
    rows += [(900020 + k, "霧ヶ原の病院では患者が増えている。医師は早めの受診を勧めた。町は水の検査を三日以内に終えると発表した。", SOUND[1]) for k in range(3)]
    rows += [(900030 + k, prose[0], "Qwxz vbnm") for k in range(4)]  # short, but of one article
    rows += [(900040 + k, text, "Zzyx kpqr") for k, text in enumerate(dict.fromkeys(prose[:9]))]  # short and of many
    frame = base.unionByName(spark.createDataFrame(rows, "pair_id long, article string, summary string"))
    found = {r["pair_id"]: r["defect"] for r in defects.defective_pairs(frame).filter("pair_id >= 900000").collect()}
    assert not [k for k, v in found.items() if v == "empty" and k < 900040]
    assert [found.get(k) for k in range(900040, 900043)] == ["empty"] * 3


def test_openings_behind_an_unlike_lead_are_clustered(spark):
    rows = [(1, "a b c d", [5, 6]), (2, "e f g h", [5, 6]), (3, "a b c x", [5, 7]), (4, "e f g y", [5, 8]), (5, "p q", [9])]
    found = {}
    for r in defects.opening_clusters(spark.createDataFrame(rows, "opening_hash long, opening string, sign array<long>")).collect():
        found.setdefault(r["cluster"], set()).add(r["opening_hash"])
    assert {1, 3} in found.values() and {2, 4} in found.values()
    assert not any(len(x & {1, 3}) and len(x & {2, 4}) for x in found.values()) and 5 not in set().union(*found.values())


OPENERS = ["Xin lỗi,", "Rất tiếc,", "Thành thật xin lỗi bạn,"]
OBJECTS = ["bài viết này", "nội dung trên", "văn bản bạn gửi"]


def refusals(spark, data):
    """Refusals of unlike articles, the same refusal of copies of one article, and reports of a refusal."""
    data = data.replace("sf0.001", "sf0.01")  # more summaries, to tell what is typical
    base = spark.read.parquet(f"{data}/train.parquet").select("pair_id", "article", "summary")
    rows = base.orderBy("pair_id").collect()
    prose = list(dict.fromkeys(r["article"] for r in rows if r["article"] and len(r["article"]) > 300 and r["article"].count("đ") > 8))
    say = [f"{a} tôi không thể tóm tắt {b}." for a in OPENERS for b in OBJECTS]
    more = [(900000 + k, text, say[k % len(say)]) for k, text in enumerate(prose[:40])]
    more += [(910000 + k, prose[-1], "Bệnh nhân từ chối mổ, bác sĩ xin lỗi vì chưa thể hẹn lại lịch khám cho người nhà.") for k in range(20)]
    return base.unionByName(spark.createDataFrame(more, "pair_id long, article string, summary string"))


def test_refusals_are_found_by_their_clusters(spark, data, monkeypatch):
    frame = refusals(spark, data)
    found = {r["pair_id"]: r["defect"] for r in defects.defective_pairs(frame).filter("pair_id >= 900000").collect()}
    assert sum(found.get(900000 + k) == "refusal" for k in range(40)) >= 25
    assert not [k for k in found if k >= 910000]
    none = lambda openings, least: openings.select("opening_hash", F.lit(0).cast("long").alias("cluster")).limit(0)
    monkeypatch.setattr(defects, "opening_clusters", none)
    monkeypatch.setattr(defects, "TEMPLATE", 41)  # nor by openings that are equal
    without = {r["pair_id"] for r in defects.defective_pairs(frame).filter("defect = 'refusal'").collect()}
    assert not without


def test_models_of_defects_come_from_all_records(spark, data):
    base = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/train.parquet").select("pair_id", "article", "summary")
    # ids with the largest hashes, so that a sample by the smallest ones holds none of them
    last = spark.range(900000, 1000000).orderBy(F.xxhash64("id").desc()).limit(60)
    ids = [r["id"] for r in last.collect()]
    text = "Bệnh viện mở lại khoa số {}, sau {} ngày sửa chữa. Người dân xã Mai được khám tại trạm Zorvane quelmt. Đoàn bác sĩ hẹn gặp {} bà mẹ tại trạm Zorvane quelmt."
    rows = [(i, text.format(k, k + 3, k + 11), f"Khoa số {k} của bệnh viện mở lại tại trạm Zorvane quelmt.") for k, i in enumerate(ids)]
    rows[0] = (*rows[0][:2], "Người dân được hẹn tiêm tại trạm Zorvane quelmt")  # whole, as the others end alike
    rows[1] = (*rows[1][:2], "Người dân được hẹn tiêm tại trạm Zorvane quel")
    frame = base.unionByName(spark.createDataFrame(rows, "pair_id long, article string, summary string"))
    found = {r["pair_id"]: r["defect"] for r in defects.defective_pairs(frame).filter(F.col("pair_id").isin(ids)).collect()}
    assert (found.get(ids[0]), found.get(ids[1])) == (None, "truncated")


def test_counts_of_all_records_whatever_their_partitions(spark, data):
    records = spark.read.parquet(f"{data}/train.parquet").select("pair_id", "article", "summary")
    rows = records.toPandas()
    judge = defects.Judge(list(rows.article), list(rows.summary))
    for parts in (1, 5):
        other = defects.fit_all(records.repartition(parts))
        assert all((a == b).all() for x, y in zip(other.endings.seen, judge.endings.seen, strict=True) for a, b in zip(x, y, strict=True))
        assert (other.languages.odds.values_ == judge.languages.odds.values_).all() and other.splitter.weights == judge.splitter.weights
        assert other.grounding.share.keys() == judge.grounding.share.keys()
        assert all((other.grounding.share[k].values_ == v.values_).all() for k, v in judge.grounding.share.items())
    gains = [0.5, -0.25, 0.125, 0.75, 0.0, 0.0, 1.0]
    frame = spark.createDataFrame([("vi", g, None) for g in gains] + [("", None, 0.5)], "spoken string, gain double, every double")
    middle, upper = np.quantile(gains, (0.5, 0.75))
    assert defects.typical(frame) == {"vi": (middle, pytest.approx((upper - middle) / 0.6745)), "": (0.5, 1e-3)}


def test_short_sentences_copied_beside_long_ones(data):
    rows = pd.read_parquet(f"{data}/train.parquet")
    judge = defects.Judge(list(rows.article), list(rows.summary))
    short = ["Bệnh viện đã mở cửa lại.", "Người dân được tiêm miễn phí.", "Lịch khám không có thay đổi."]
    long = [" ".join(f"{w}{k}x{j}" for j in range(40)).capitalize() + "." for k, w in enumerate(("tin", "bài", "ý"))]
    article = " ".join(t for pair in zip(long, short, strict=True) for t in pair)
    assert len(judge.splitter.sentences(article)) == 6
    assert judge.judge(article, " ".join(short), article.lower().replace(".", "").split(), " ".join(short).lower().replace(".", "").split())[0] == "copied"


def test_few_sentences_are_looked_at_to_tell_copies(data, monkeypatch):
    rows = pd.read_parquet(f"{data}/train.parquet")
    judge = defects.Judge(list(rows.article), list(rows.summary))
    shared = "Bệnh viện mở lại khoa khám sau nhiều ngày"
    article = " ".join([f"Người dân nói rằng {shared.lower()} sửa chữa tại xã {k} và {k + 1} của huyện này." for k in range(400)])
    seen, decide = [], sentences.Boundaries.decide
    monkeypatch.setattr(sentences.Boundaries, "decide", lambda self, features: seen.append(1) or decide(self, features))
    frame = pa.RecordBatch.from_pydict({"id": [1], "article": [article], "summary": [f"{shared} dài, theo lời của tổ trưởng."]})
    (out,) = defects._examine(SimpleNamespace(value=judge))(iter([frame]))
    assert out.column("found").to_pylist() == [None] and len(seen) < 20


def test_no_more_sentences_are_held_than_told(data):
    rows = pd.read_parquet(f"{data}/train.parquet").fillna("")
    judge = defects.Judge(list(rows.article), list(rows.summary))
    articles, summaries = defects.plain_batch(list(rows.article)), defects.plain_batch([defects.without_markup(t) for t in rows.summary])
    for k in range(0, len(articles), 3):  # every third is copied in part, with words of its own between
        units = judge.splitter.sentences(articles[k], plain=True)
        summaries[k] = " ".join(u if j % 3 else u[: len(u) * 2 // 3] for j, u in enumerate(units) if (j + k) % 4)
    articles += ["Một hai ba. Bốn năm sáu! Một hai ba.", "İzmir'de İlk gün. ΟΔΟΣ ΑΣ.", "", "ngày 3.5 và TS. Lê Văn An đến.\x85Một hai ba"]
    summaries += ["Một hai ba", "i̇zmir'de i̇lk gün οδος ας", "Một hai ba", "3.5 và TS. Lê Văn An đến. Một hai ba"]
    most = defects.most_held(defects.Layout(articles), defects.Layout(summaries))
    bound = copied = 0
    for article, summary, upper in zip(articles, summaries, most, strict=True):
        own, tokens = defects._near(summary), WORD.findall(article.lower())
        units = [g for u in judge.splitter.sentences(article, plain=True) if (g := defects._near(u))]
        held = sum(len(g & own) >= 0.6 * len(g) for g in units)
        if own and isinstance(next(iter(own)), tuple):
            assert upper is None or held <= upper
            bound += upper is not None
            assert judge.copied(article, own, tokens, upper) == (held >= 0.5 * len(units) > 0)
        assert judge.copied(article, own, tokens) == (held >= 0.5 * len(units) > 0)
        copied += held >= 0.5 * len(units) > 0
    assert bound > 50 and copied > 10


def test_frequent_boundaries_have_the_same_features(data, monkeypatch):
    rows = pd.read_parquet(f"{data}/train.parquet").fillna("")
    lines = [m[0] for t in (*rows.article, *rows.summary) for m in sentences._LINE.finditer(t)]
    lines += ["Tên: A. Ông; B. C.", "Gồm: 1. Nhà; 2. Xe 12. Hết 123. ", "TS. An gặp Dr. Bo lúc 5 p.m. nay… Rồi v.v.", "“A. B.” C."]
    fast = [list(sentences.candidates(line)) for line in lines]
    monkeypatch.setattr(sentences, "_common", lambda *_: None)
    assert fast == [list(sentences.candidates(line)) for line in lines]


def test_endings_on_held_out_sentences(data):
    rows = pd.read_parquet(f"{data}/train.parquet")
    splitter = sentences.fit(rows.article)
    whole = [u.rstrip(".") for t in rows.article if t for u in splitter.sentences(unicodedata.normalize("NFC", t)) if u.endswith(".")]
    model = defects.Endings(whole[::2])
    rest = [s for s in whole[1::2] if len(s) > 40]
    right = sum(model.whole(s) for s in rest) + sum(not model.whole(s[: len(s) // 2]) for s in rest)
    assert right / (2 * len(rest)) > 0.8  # some hundred sentences to learn from; 2,000 records give far more


@pytest.mark.parametrize("text", ["هذا نص قصير. لا أعرف؟ نعم أعرف.", "यह पहला वाक्य है। यह दूसरा है।", "នេះជាប្រយោគទីមួយ។ នេះជាប្រយោគទីពីរ។", "Սա առաջինն է։ Սա երկրորդն է։"])
def test_full_stops_of_other_scripts(data, text):
    model = sentences.fit(pd.read_parquet(f"{data}/train.parquet").article)
    assert len(model.sentences(text)) == 2
    assert "".join(model.sentences(text)).replace(" ", "") == text.replace(" ", "")


@pytest.mark.parametrize("text,unlike", [("ｘin", True), ("Ηa Nội", True), ("bài", False), ("bài", True), ("β", False), ("a​b", True), ("1️⃣ 𝐚", True), ("", False)])
def test_prototypes_tell_candidates(text, unlike):
    from corpusloom.llm.plain import unlike_prototype

    assert unlike_prototype(text) is unlike
    assert not differs(text) or unlike_prototype(text)
