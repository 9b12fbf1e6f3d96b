import json

import pytest
from pyspark.sql import functions as F

from anchorgrid.operators import checks
from anchorgrid.sources import files, words


def test_predictions_fail_on_bad_line_and_on_nothing(spark, tmp_path):
    good = {"model": "m", "fold": 0, "sample_id": "1", "group_id": "g", "label": 1, "logit": 0.1, "probability": 0.5, "threshold": 0.5, "prediction": 1}
    path = tmp_path / "p.jsonl"
    path.write_text(json.dumps(good) + "\n")
    assert files.read_predictions(spark, str(path)).count() == 1
    path.write_text(json.dumps(good) + "\n{broken\n")
    with pytest.raises(Exception):
        files.read_predictions(spark, str(path)).collect()
    assert [r.line_no for r in files.bad_json_lines(spark, str(path)).collect()] == [2]
    path.write_text("")
    with pytest.raises(files.SourceError):
        files.read_predictions(spark, str(path))


def test_fold_layout_is_checked(spark):
    df = spark.createDataFrame([("train", 1), ("test", 2)], "split string, label int")
    with pytest.raises(files.SourceError):
        files.check_fold(df, {"word"})
    with pytest.raises(files.SourceError):
        files.check_fold(df, {"label"})


def test_summaries_from_disk(spark, tmp_path):
    folder = tmp_path / "m1" / "target-cue_window-500" / "variant" / "cross_validation_seed-3"
    folder.mkdir(parents=True)
    text = {"fold_statistics": {"validation": {}, "test": {"f1": {"mean": 0.5, "num_valid_folds": 2}}}, "folds": {"0": {"run_name": "r"}}}
    (folder / "x_cross_validation_summary.json").write_text(json.dumps(text))
    (folder / "y_cross_validation_summary.json").write_text("[]")
    rows = files.read_summaries(spark, str(tmp_path))
    assert rows.filter("issue is not null").count() == 1
    assert [tuple(r) for r in files.summary_metrics(rows).collect()] == [("m1", "target-cue_window-500", "variant", 3, "f1", 0.5, 2)]


def test_missing_coordinate_is_an_error(spark):
    tokens = spark.createDataFrame([(1, 0, 0, "w")], "audio int, sentence int, token int, word_id string")
    at = spark.createDataFrame([("n", "cue_tokens", 1, 0, 5)], "negation_id string, field string, audio int, sentence int, token int")
    with pytest.raises(Exception, match="no word at coordinate"):
        words.coordinates_to_links(at, tokens).collect()


def test_negation_table_is_replaced(spark, tmp_path):
    links = spark.createDataFrame([("n1", "cue_tokens", "a"), ("n1", "scope_tokens", "c"), ("n1", "scope_tokens", "b")], "negation_id string, field string, word_id string")
    words.write_negations(links, str(tmp_path / "n"))
    words.write_negations(links.withColumn("negation_id", F.lit("n2")), str(tmp_path / "n"))
    back = spark.read.parquet(str(tmp_path / "n")).collect()
    assert [(r.negation_id, r.cue_tokens, r.scope_tokens) for r in back] == [("n2", ["a"], ["b", "c"])]


def test_checks_raise(spark):
    with pytest.raises(checks.CheckError):
        checks.require_empty(checks.duplicate_ids(spark.range(2).union(spark.range(1)), "id"), "duplicates")


def test_datasets_are_found_by_table_or_folder(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 2, s) for i, s in enumerate(["train", "train", "validation", "test"])], "id int, label int, split string")
    for name in ("train", "validation", "test"):
        part = rows.where(F.col("split") == name).drop("split")
        part.write.parquet(str(tmp_path / "deep" / "fold-3" / name))
    (tmp_path / "flat").mkdir()
    for name in ("train", "validation", "test"):
        rows.where(F.col("split") == name).drop("split").toPandas().to_parquet(tmp_path / "flat" / f"{name}-00000-of-00001.parquet")
    files.write_folds(rows.withColumn("fold", F.lit(1)), str(tmp_path / "written"))
    rows.write.mode("overwrite").saveAsTable("anchorgrid_fold_test")
    want = sorted((r.id, r.label, r.split) for r in rows.collect())
    for dataset, fold in ((str(tmp_path / "deep"), 3), (str(tmp_path / "flat"), None), (str(tmp_path / "written"), 1), ("anchorgrid_fold_test", None)):
        got = files.load_fold_dataset(spark, dataset, {"id", "label"})
        assert sorted((r.id, r.label, r.split) for r in got.collect()) == want, dataset
        if fold is not None:
            assert {r.fold for r in got.collect()} == {fold}
    spark.sql("DROP TABLE anchorgrid_fold_test")
    for bad in (str(tmp_path / "nothing"), "no_such_table"):
        with pytest.raises(files.SourceError):
            files.load_fold_dataset(spark, bad)
    with pytest.raises(files.SourceError, match="lacks columns"):
        files.load_fold_dataset(spark, str(tmp_path / "flat"), {"word"})


def test_written_summaries_are_read_back(spark, tmp_path):
    summary = "struct(struct(map('f1', struct(m AS mean, 3 AS num_valid_folds)) AS validation, map('f1', struct(m AS mean, 3 AS num_valid_folds)) AS test) AS fold_statistics, map('0', struct('r' AS run_name)) AS folds)"
    runs = spark.createDataFrame([("a", "tgt-x_wL-5", None, 1, 0.25), ("a", "tgt-x_wL-5", "v 1", 2, 0.5), ("b", "target-y", "v", 1, float("nan"))], "model string, family string, variant string, seed int, m double")
    files.write_summaries(runs.withColumn("summary", F.expr(summary)), str(tmp_path / "s"))
    got = files.read_summaries(spark, str(tmp_path / "s"))
    assert got.where("issue IS NOT NULL").isEmpty()
    rows = sorted((r.model, r.family, r.seed, r.mean) for r in files.summary_metrics(got).where("model = 'a'").collect())
    assert rows == [("a", "tgt-x_wL-5", 1, 0.25), ("a", "tgt-x_wL-5", 2, 0.5)]
    variants = {(r.model, r.seed): r.variant for r in got.collect()}
    assert variants[("a", 1)] is None and variants[("b", 1)] == "v" and variants[("a", 2)].replace("%20", " ") == "v 1"
    assert files.summary_metrics(got).where("model = 'b'").first()["mean"] is None
