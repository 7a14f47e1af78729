"""Alignment and scores: planted insertions and deletions, a plain table of cells, and edge cases."""

import random

import pytest

from cadenza.operators import scoring as sc

NOTE = "struct<pitch: int, start: double, dur: double, conf: double>"
PAIRS = f"rec long, pred array<{NOTE}>, truth array<{NOTE}>"


def line(*pitches, conf=0.9):
    return [(p, i * 0.5, 0.5, conf) for i, p in enumerate(pitches)]


def score(spark, pred, truth):
    return sc.section_accuracy(sc.align_notes(spark.createDataFrame([(1, pred, truth)], PAIRS))).head()


def plain_total(a, b):
    total = {(i, j): -float(i + j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            total[i, j] = max(total[i - 1, j - 1] + worth(a[i - 1], b[j - 1]), total[i - 1, j] - 1, total[i, j - 1] - 1)
    return total[len(a), len(b)]


def worth(x, y):
    return (2.0 if x[0] == y[0] else 0.5 if (x[0] - y[0]) % 12 == 0 else -1.0) - min(2.0, abs(x[1] - y[1]) / 2)


def test_paths_are_best_and_whole():
    rng = random.Random(2)
    for _ in range(80):
        a, b = ([(rng.choice([60, 62, 72, 74]), rng.randrange(12) / 4) for _ in range(rng.randint(0, 9))] for _ in range(2))
        path = sc.best_path(a, b)
        assert [i for i, _ in path if i is not None] == list(range(len(a))) and [j for _, j in path if j is not None] == list(range(len(b)))
        assert sum(-1.0 if i is None or j is None else worth(a[i], b[j]) for i, j in path) == pytest.approx(plain_total(a, b))


def test_an_extra_and_a_missing_note(spark):
    truth = line(74, 76, 78, 79)
    extra = [*truth[:2], (69, 0.75, 0.25, 0.4), *truth[2:]]
    got = score(spark, extra, truth)
    assert (got.pitch, got.insertions, got.deletions, got.n_matched) == (1.0, 1, 0, 4)
    got = score(spark, truth[:1] + truth[2:], truth)
    assert (got.pitch, got.onset, got.insertions, got.deletions) == (0.75, 0.75, 0, 1)


def test_octaves_lengths_and_onsets(spark):
    got = score(spark, [(62, 0.0, 0.5, 0.9), (76, 0.8, 1.0, 0.9)], line(74, 76))
    assert (got.pitch, got.pitch_class, got.duration, got.onset) == (0.5, 1.0, 0.5, 0.5)


def test_nothing_heard_or_nothing_there(spark):
    got = score(spark, None, line(74, 76))
    assert (got.pitch, got.deletions, got.n_predicted, got.sequence_similarity) == (0.0, 2, 0, 0.0)
    got = score(spark, line(74), [])
    assert (got.pitch, got.insertions, got.n_truth) == (0.0, 1, 0)


def test_confidence_is_judged_by_rank(spark):
    pred = [(74, 0.0, 0.5, 0.9), (75, 0.5, 0.5, 0.2), (78, 1.0, 0.5, 0.8), (79, 1.5, 0.5, 0.6)]
    aligned = sc.align_notes(spark.createDataFrame([(1, pred, line(74, 76, 78, 79)), (2, line(74), line(74))], PAIRS))
    got = {r.rec: r for r in sc.calibration(aligned).collect()}
    assert (got[1].n_notes, got[1].n_wrong, got[1].n_flagged, got[1].flag_precision, got[1].flag_recall, got[1].auc) == (4, 1, 2, 0.5, 1.0, 1.0) and got[2].auc == 0.5


def test_facts_of_tunes(spark):
    rows = [(1, "Bb", "4/4", 110.0, "AABBAABB", "A# Major", "4/4", 100.0, "AABB"), (2, "D dorian", "3/4", 90.0, None, "D", "4/4", 90.0, "AB")]
    got = {r.rec: tuple(r)[1:] for r in sc.tune_facts(spark.createDataFrame(rows, "rec long, key string, meter string, tempo double, form string, true_key string, true_meter string, true_tempo double, true_form string")).collect()}
    assert got[1] == (True, True, True, pytest.approx(10.0)) and got[2] == (False, False, False, 0.0)


def test_pairs_of_all_shapes_are_aligned_once(spark):
    """Rows of mixed shapes, empty and null sides included, keep their order and paths, also few cells at a time; the scores' plan aligns nothing again."""
    rng = random.Random(2)
    side = lambda: None if rng.random() < 0.1 else [(60 + rng.randrange(14), i * 0.5, 0.5, rng.random()) for i in range(rng.randrange(5))]
    df = spark.createDataFrame([(i, side(), side()) for i in range(60)], PAIRS)
    for cells in (1, 50, 2_000_000):
        for r in sc.align_notes(df, cells).collect():
            of = lambda xs: [(x.pitch, x.start) for x in xs or ()]
            assert [tuple(x) for x in r.path] == sc.best_path(of(r.pred), of(r.truth)), r
    facts = spark.createDataFrame([(1, "D", "D", "4/4", "4/4", 1.0, 1.0, "A", "A")], "rec long, key string, true_key string, meter string, true_meter string, tempo double, true_tempo double, form string, true_form string")
    got = sc.transcription_score(sc.align_notes(df), facts)
    assert got.count() == 60 and "MapInArrow" not in got._jdf.queryExecution().optimizedPlan().toString()
