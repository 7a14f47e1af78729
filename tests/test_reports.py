"""Configurations side by side: parameters as rows, tables and records."""

import json

import pytest

from cadenza.operators import reports, scoring

FACTS = "rec long, key string, true_key string, meter string, true_meter string, tempo double, true_tempo double, form string, true_form string"
NOTE = "struct<pitch: int, start: double, dur: double, conf: double>"


@pytest.fixture(scope="module")
def scores(spark):
    """Two recordings, one right and one a step off in half of its notes, under two floors of confidence."""
    truth = [(60 + i, i * 0.5, 0.5, 1.0) for i in range(4)]
    heard = [(60 + i + (i % 2), i * 0.5, 0.5, 0.9 - 0.5 * (i % 2)) for i in range(4)]
    pairs = spark.createDataFrame([(1, truth, truth), (2, heard, truth)], f"rec long, pred array<{NOTE}>, truth array<{NOTE}>")
    tunes = spark.createDataFrame([(r, "G major", "G major", "4/4", "4/4", 100.0, 100.0 + 10 * (r == 2), "AABB", "AABB") for r in (1, 2)], FACTS)
    configurations = {"all": {"least": 0}, "sure": {"least": 0.5, "other": 2}}
    each = reports.with_configurations(pairs, configurations).selectExpr("config", "rec", "filter(pred, x -> x.conf >= least) as pred", "truth")
    facts = reports.with_configurations(tunes, configurations)
    got = scoring.transcription_score(scoring.align_notes(each), facts, ("config", "rec"))
    return got.selectExpr("*", "concat('tune ', rec) as title", "'clean' as difficulty").cache()


def test_parameters_are_columns(spark):
    got = reports.with_configurations(spark.createDataFrame([(1, 9.0)], "rec long, least double"), {"a": {"least": 1}, "b": {"other": 2}})
    assert {tuple(r) for r in got.select("rec", "config", "least", "other").collect()} == {(1, "a", 1.0, None), (1, "b", None, 2.0)}


def test_each_configuration_has_its_own_scores(scores):
    of = {(r.config, r.rec): r for r in scores.collect()}
    assert len(of) == 4 and of["all", 1].pitch == of["sure", 1].pitch == 1.0 and of["all", 2].pitch == of["sure", 2].pitch == 0.5
    assert of["all", 2].n_notes > of["sure", 2].n_notes == 2 and of["all", 2].auc == 1.0 and of["sure", 2].n_wrong == 0
    means = {(r.config, r.metric): r.value for r in reports.summary(scores).collect()}
    assert means["all", "pitch"] == 0.75 and means["all", "tempo_error"] == pytest.approx(50 / 11) and means["sure", "key_right"] == 1.0
    wide = {r.metric: (r["all"], r.sure) for r in reports.comparison(scores, ["all", "sure"]).collect()}
    assert set(wide) == set(reports.COMPARED) and wide["pitch"] == (0.75, 0.75) and wide["auc"][0] == 0.75


def test_comparison_as_text(scores):
    lines = [r.text for r in reports.comparison_table(scores, ["sure", "absent"]).orderBy("line").collect()]
    assert lines[0] == "metric                              sure          absent" and lines[1] == "-" * 56
    assert lines[2] == "pitch                              0.750               -" and len(lines) == 2 + len(reports.COMPARED)


def test_scores_as_text(scores):
    lines = [r.text for r in reports.score_table(scores).where("config = 'all'").orderBy("part", "rec").collect()]
    assert lines[0] == "tune                  diff     pitch pclass  onset    dur    seq  key  form  tempo%" and lines[1] == lines[4] == "-" * 89
    assert lines[2] == "tune 1                clean     1.00   1.00   1.00   1.00   1.00    Y     Y     0.0"
    assert lines[3].startswith("tune 2                clean     0.50") and lines[3].endswith("     9.1")
    assert lines[5].startswith("MEAN                            0.75") and lines[6].startswith("confidence: AUC 0.750  flag precision") and lines[7] == "octave-error rate: 0.000"


def test_records(scores):
    got = [(r.config, r.kind, json.loads(r.json)) for r in reports.report_records(scores).collect()]
    assert sorted((c, k) for c, k, _ in got) == [("all", "aggregate"), ("all", "score"), ("all", "score"), ("sure", "aggregate"), ("sure", "score"), ("sure", "score")]
    assert all(("rec" in x) == (k == "score") and "pitch" in x for _, k, x in got)


def test_nothing(scores):
    none = scores.where("false")
    assert reports.summary(none).count() == reports.score_table(none).count() == reports.report_records(none).count() == 0
    assert [r.text[-1] for r in reports.comparison_table(none, ["all"]).orderBy("line").collect()][2:] == ["-"] * len(reports.COMPARED)
