"""Sources, sinks, configuration, whole pipelines, streams and the driver's entry."""

import json
from functools import partial

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom import cli
from corpusloom import config as configuration
from corpusloom.operators import inference, lexicon
from corpusloom.plans import cleaning, evaluation, filtering, manifest
from corpusloom.sources import pairs as sources
from corpusloom.sources import files, sinks
from corpusloom.streaming import landing

LONG = "Người bệnh nhập viện vì viêm phổi nặng và được điều trị bằng kháng sinh trong mười ngày liền"


def write_csv(path, rows, header="article,summary"):
    path.parent.mkdir(parents=True, exist_ok=True)
    quote = lambda x: '"' + x.replace('"', '""') + '"'
    path.write_text("\n".join([header, *(",".join(map(quote, r)) for r in rows)]) + "\n", encoding="utf-8")


def test_columns_and_csv(spark, tmp_path):
    assert sources.find_column([" Text ", "SUMARY"], sources.ARTICLE_ALIASES) == " Text "
    assert sources.find_column(["a", "Article", "ARTICLE"], sources.ARTICLE_ALIASES) == "ARTICLE"
    with pytest.raises(ValueError):
        sources.find_column(["x"], sources.SUMMARY_ALIASES)
    write_csv(tmp_path / "a.csv", [("NA", ""), ('hai\n"dòng"', "x")], "Document,Target")
    rows = sources.read_pairs(spark, str(tmp_path / "a.csv")).orderBy("_source_row").collect()
    assert [(r["article"], r["summary"]) for r in rows] == [("NA", ""), ('hai\n"dòng"', "x")]
    with pytest.raises(ValueError):
        sources.read_pairs(spark, str(tmp_path / "a.csv"), strict=True)
    with pytest.raises(ValueError):
        sources.read_pairs(spark, "a.txt")
    with pytest.raises(FileNotFoundError):
        sources.resolve_files(str(tmp_path), "*.pq")


def test_order_of_files(spark, tmp_path):
    frame = spark.createDataFrame([("p", "q")], "article string, summary string")
    frame.coalesce(1).write.parquet(str(tmp_path / "a.parquet"))
    write_csv(tmp_path / "z.csv", [("r", "s"), ("t", "u")])
    files = [str(next((tmp_path / "a.parquet").glob("*.parquet"))), str(tmp_path / "z.csv")]
    rows = sources.read_files(spark, files).orderBy("row_ord").collect()
    assert [r["article"] for r in rows] == ["r", "t", "p"]
    assert sources.read_files(spark, []).count() == 0


def test_layout_checks(spark, tmp_path):
    assert sources.detect_layout(str(tmp_path)) == "original"
    for split in sources.SPLITS:
        write_csv(tmp_path / split / "news.csv", [(LONG, "một hai ba")])
    assert sources.detect_layout(str(tmp_path)) == "split"
    sources.check_file_selection(str(tmp_path), "*.csv")
    write_csv(tmp_path / "test" / "other.csv", [])
    with pytest.raises(ValueError):
        sources.check_file_selection(str(tmp_path), "*.csv")
    with pytest.raises(FileNotFoundError):
        sources.read_flat_layout(spark, str(tmp_path))
    with pytest.raises(ValueError):
        sources.find_split_file(str(tmp_path), "train")
    import hashlib

    content = (tmp_path / "train" / "news.csv").read_bytes()
    found = sources.find_by_content(spark, str(tmp_path / "*" / "news.csv"), hashlib.sha256(content).hexdigest())
    assert found.count() == 3


def test_output_guards(tmp_path):
    (tmp_path / "in").mkdir()
    with pytest.raises(ValueError):
        sinks.check_output(str(tmp_path / "in" / "out"), [str(tmp_path / "in")])
    (tmp_path / "full").mkdir()
    (tmp_path / "full" / "x").write_text("x")
    with pytest.raises(FileExistsError):
        sinks.check_output(str(tmp_path / "full"), [])
    with pytest.raises(RuntimeError):
        sinks.publish(str(tmp_path / "out"), lambda folder: (_ for _ in ()).throw(RuntimeError("stop")))
    assert not (tmp_path / "out").exists() and not list(tmp_path.glob(".out-*"))
    assert sinks.infer_format(["a.PQ", "b.parquet"]) == "parquet"
    with pytest.raises(ValueError):
        sinks.infer_format(["a.csv", "b.parquet"])


def test_cleaning_pipeline(spark, tmp_path):
    other = LONG.replace("viêm phổi", "suy thận") + " tại một bệnh viện ở thành phố"
    own = "Đội chủ nhà thắng trận cuối nhờ bàn thắng ở phút bù giờ trên sân nhà đông khán giả"
    write_csv(tmp_path / "in/train/n.csv", [(LONG, "một hai ba"), (LONG, "Một  hai ba"), (other, "một hai ba"), ("ngắn", "một hai ba"), (LONG + " nữa", "x y z"), (own, "x y z")])
    write_csv(tmp_path / "in/validation/n.csv", [(other, "bốn năm sáu")])
    write_csv(tmp_path / "in/test/n.csv", [(LONG + " a b", "một hai ba")])
    config = configuration.build({"cleaning": {"pattern": "*.csv", "near_duplicate_threshold": 0.8}}).cleaning
    report = cleaning.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), config)
    assert report["dropped_quality"] == {"train": {"article_too_short": 1}}
    assert report["input_rows"] == {"train": 6, "validation": 1, "test": 1}
    assert report["overlap_before"]["train_validation"] == 1 and not any(report["overlap_after"].values())
    assert report["after_exact_duplicates"] == {"train": 4, "validation": 1, "test": 1}
    assert report["output_rows"] == {"train": 1, "validation": 1, "test": 1}
    assert spark.read.option("header", "true").csv(str(tmp_path / "out/train/cleaned.csv")).first()["article"] == own
    assert json.loads((tmp_path / "out/cleaning_report.json").read_text())["articles_with_multiple_summaries"] == 1


def test_filter_pipeline(spark, tmp_path):
    rows = [(LONG, "Bệnh nhân viêm phổi nhập viện"), ("Chậu lan rừng", "Chậu lan ra hoa")]
    for split in sources.SPLITS:
        write_csv(tmp_path / f"in/{split}_1.csv", rows)
    report = filtering.run(spark, str(tmp_path / "in"), str(tmp_path / "kept"), str(tmp_path / "audit"), lexicon.demo_lexicon(spark))
    assert {r["split"]: r["keep_rate"] for r in report["splits"]} == {"train": 0.5, "validation": 0.5, "test": 0.5, None: 0.5}
    audit = spark.read.option("header", "true").csv(str(tmp_path / "audit/excluded.csv"))
    assert {r["reason"] for r in audit.collect()} == {"plant_care"} and audit.count() == 3
    assert report["validation"]["overlap"]["train_test"] == 1


def test_evaluation_pipeline(spark, tmp_path):
    rows = spark.createDataFrame([(k, LONG, "Người bệnh nhập viện") for k in range(3)], "index bigint, article string, reference string")
    metrics = evaluation.evaluate(rows, partial(inference.LeadSummarizer, 4), str(tmp_path / "runs/a"))
    assert metrics["test_rouge1"] == 100.0
    sinks.save_json({"eval_rougeL": 10}, str(tmp_path / "runs/b/eval_results.json"))
    board = evaluation.summarize_runs(spark, str(tmp_path / "runs"))
    assert [r["run"] for r in board] == ["a", "b"]
    assert json.loads((tmp_path / "runs/best_run.json").read_text())["run"] == "a"
    assert (tmp_path / "runs/summary_results.md").read_text().splitlines()[2].startswith("| a | 100.00")
    predictions = spark.read.json(str(tmp_path / "runs/a/predictions.jsonl"))
    assert set(predictions.columns) == {"index", "article", "reference", "prediction"}


def test_files_and_manifest(spark, tmp_path):
    for k, split in enumerate(sources.SPLITS):
        write_csv(tmp_path / f"d/{split}.csv", [(f"{LONG} {k}", "một hai ba")])
    folder = manifest.find_dataset([str(tmp_path), str(tmp_path / "d")])
    made = manifest.build(spark, folder)
    assert made["splits"]["train"]["rows"] == 1 and made["splits"]["test"]["sha256"] == files.sha256_file(f"{folder}/test.csv")
    before = files.fingerprint(folder)
    write_csv(tmp_path / "d/test.csv", [(f"{LONG} 0", "một hai ba")])
    assert files.fingerprint(folder) != before
    with pytest.raises(ValueError):
        manifest.build(spark, folder)
    assert manifest.build(spark, folder, strict=False)["cross_split_article_overlap"]["train_test"] == 1
    with pytest.raises(FileNotFoundError):
        manifest.find_dataset([str(tmp_path)])
    assert files.bundle(folder, ["test.csv", "none"], str(tmp_path / "b.zip")) == ["test.csv"]
    files.unbundle(str(tmp_path / "b.zip"), ["test.csv"], str(tmp_path / "u"))
    with pytest.raises(FileNotFoundError):
        files.unbundle(str(tmp_path / "b.zip"), ["x"], str(tmp_path / "u"))
    assert files.read_input_text(path=f"{folder}/test.csv").startswith("article") and files.read_input_text(" a ") == "a"
    with pytest.raises(ValueError):
        files.read_input_text(" ")


def test_configuration(tmp_path):
    config = configuration.build({"cleaning": {"min_article_words": "12", "audit_only": "true"}, "data": {"max_train_samples": None}})
    assert config.cleaning.min_article_words == 12 and config.cleaning.audit_only
    changed = configuration.override(config, {"cleaning.dedupe_by": "article"})
    assert changed.cleaning.dedupe_by == "article" and config.cleaning.dedupe_by == "pair"
    for bad in ({"x": {}}, {"data": {"y": 1}}, {"cleaning": {"near_duplicate_threshold": 0.3}}, {"cleaning": {"train_ratio": 0.95}}, {"data": {"max_source_length": "x"}}):
        with pytest.raises(ValueError):
            configuration.build(bad)
    with pytest.raises(ValueError):
        configuration.override(config, {"cleaning.none": 1})
    (tmp_path / "c.yaml").write_text('{"cleaning": {"layout": "split"}}')
    assert configuration.to_dict(configuration.load(str(tmp_path / "c.yaml")))["cleaning"]["layout"] == "split"


def test_exit_codes(spark, tmp_path):
    assert cli.main(["clean", str(tmp_path / "none"), str(tmp_path / "out")]) == 2
    (tmp_path / "runs").mkdir()
    assert cli.main(["leaderboard", str(tmp_path / "runs")]) == 0


def test_predict_and_evaluate(spark, tmp_path, capsys):
    assert cli.main(["predict", "--text", LONG, "--model", "lead:3", "--prefix", ""]) == 0
    assert capsys.readouterr().out.strip() == " ".join(LONG.split()[:3])
    assert cli.main(["predict", "--text", "  "]) == 2 and cli.main(["predict", "--text", LONG, "--model", "none"]) == 2
    write_csv(tmp_path / "t.csv", [(LONG, "Người bệnh nhập viện"), (LONG, "Người bệnh")])
    assert cli.main(["evaluate", str(tmp_path / "t.csv"), str(tmp_path / "runs/a"), "--split", "test", "--model", "lead:4"]) == 0
    metrics = sinks.load_json(str(tmp_path / "runs/a/test_metrics.json"))
    assert metrics["test_gen_len"] == len(" ".join(LONG.split()[:4]).encode()) + 1
    assert sinks.read_jsonl(spark, str(tmp_path / "runs/a/predictions.jsonl"), "index bigint, prediction string").count() == 2
    found = evaluation.compare_models({"test_rouge1": 10.0}, metrics, str(tmp_path / "runs"))
    assert found["tuned_minus_base"]["rouge1"] == round(metrics["test_rouge1"] - 10, 2)
    assert (tmp_path / "runs/model_comparison.csv").read_text().splitlines()[0].startswith("model,rouge1")


def test_two_data_sets(spark, tmp_path):
    texts = [LONG.replace("mười ngày", f"{k} tuần và {k + 3} ngày ở khoa số {k}") for k in range(40)]
    frame = spark.createDataFrame([(t, "một hai ba") for t in texts], "article string, summary string")
    for k, name in enumerate(("train", "valid", "test")):
        frame.filter(F.pmod(F.hash("article"), F.lit(3)) == k).coalesce(1).write.parquet(str(tmp_path / f"x{k}"))
        part = next((tmp_path / f"x{k}").glob("*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        part.rename(tmp_path / f"in/{name}.parquet")
    for name in ("a.csv", "b.csv", "sum.csv"):
        write_csv(tmp_path / "in" / name, [(t + " b", "một hai ba") for t in texts])
    config = configuration.build({"cleaning": {"near_duplicate_threshold": 0}}).cleaning
    made = cleaning.run_two(spark, str(tmp_path / "in"), str(tmp_path / "out"), "a.csv", config, ("sum.csv",))
    assert made["skipped_transformed_variants"] == ["b.csv"] and made["not_used"] == ["sum.csv"]
    assert sum(made["datasets"]["medical"]["staged_rows"].values()) == 40 and (tmp_path / "out/medical/train/cleaned.csv").exists()
    assert sinks.load_json(str(tmp_path / "out/cleaning_manifest.json"))["medical_variant"] == "a.csv"


def test_capped_tokens_and_numbers(spark):
    rows = spark.createDataFrame([("train", k, " a  b ", "c") for k in range(3)] + [("test", 9, "x", "y" * 9)], "split string, row_ord bigint, article string, summary string")
    config = configuration.build({"data": {"max_train_samples": 2, "max_source_length": 12, "max_target_length": 4}}).data
    out = {r["row_ord"]: r for r in inference.tokenize_splits(rows, config).collect()}
    assert set(out) == {0, 1, 9} and len(out[0]["input_ids"]) == 12 and len(out[9]["labels"]) == 4 and bytes(x - 3 for x in out[0]["input_ids"]) == b"summarize: a"
    from corpusloom.functions import text as T

    shown = spark.createDataFrame([(1234567.0,), (1234.5,), (0.0,)], "n double").select(T.format_number(F.col("n")).alias("s")).collect()
    assert [r["s"] for r in shown] == ["1,234,567", "1,234.50", "0"]


def test_stream(spark, data, tmp_path):
    stream = landing.unique_stream(landing.decided_stream(landing.read_landing(spark, f"{data}/train.parquet*")))
    query = (
        stream.select("pair_id").writeStream.format("memory").queryName("unique_pairs").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "checkpoint")).start()
    )
    query.processAllAvailable()
    query.stop()
    assert 0 < spark.table("unique_pairs").count() < 200


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"split", "reason", "rows"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_common_subsequence_scores_against_brute_force(spark, data):
    from corpusloom.functions import text as T

    def common(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    scores = {}
    made = entry.catalog._predictions(spark, data).select("split", T.rouge_tokens(F.col("prediction")).alias("p"), T.rouge_tokens(F.col("reference")).alias("r"))
    for split, p, r in made.collect():
        scores.setdefault(split, []).append(2 * common(p, r) / (len(p) + len(r)) if p and r else 0.0)
    mean = {k: 100 * sum(v) / len(v) for k, v in scores.items()}
    queries = entry.queries()
    corpus = {r["split"]: r for r in queries["rouge_corpus"](spark, data).collect()}
    board = {r["run"]: r for r in queries["run_leaderboard"](spark, data).collect()}
    assert {k: r["rougeL"] for k, r in corpus.items()} == pytest.approx(mean, abs=0.00501)
    assert {k: r["rougeL"] for k, r in board.items()} == pytest.approx(mean, abs=0.00501)
    assert sorted(board, key=lambda k: board[k]["place"]) == sorted(mean, key=lambda k: -mean[k])
    assert any(r["rougeL"] != r["rouge1"] for r in board.values())
    delta = {r["metric"]: r for r in queries["model_delta"](spark, data).collect()}["rougeL"]
    assert (delta["base"], delta["tuned"]) == (board["validation"]["rougeL"], board["test"]["rougeL"])
    assert delta["delta"] == pytest.approx(mean["test"] - mean["validation"], abs=0.011)


@pytest.mark.parametrize("name", sorted(entry.catalog.oracle_sql()))
def test_query_against_sql(spark, data, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    wanted = con.execute(entry.oracle_sql()[name])
    columns = sorted(c[0] for c in wanted.description)
    where = [[c[0] for c in wanted.description].index(c) for c in columns]
    plain = lambda v: round(float(v), 9) if isinstance(v, float) else v
    expected = sorted((tuple(plain(r[k]) for k in where) for r in wanted.fetchall()), key=repr)
    frame = entry.queries()[name](spark, data)
    assert sorted(frame.columns) == columns
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    assert got == expected
