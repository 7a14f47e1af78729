"""Sections built from passes: planted passes, and a plain fold in Python."""

import itertools
import random

import duckdb
import pyarrow as pa
import pytest

from cadenza.operators import consensus as co
from cadenza.plans import consensus as plan

NOTES = "rec long, label string, block long, seq long, start double, dur double, pitch int, conf double, error double"
SECTIONS = "rec long, label string, beats double, beats_per_bar int, bars int, odd double"
GOOD, FLAT, OTHER = [74, 76, 78, 79], [74, 76, 77, 79], [55, 57, 59, 60]


def passes(*pitches, rec=1, label="A", conf=0.9, dur=0.5):
    return [(rec, label, b, i, i * dur, dur, p, conf, 0.0) for b, line in enumerate(pitches) for i, p in enumerate(line)]


def build(spark, rows, sections=((1, "A", 2.0, 4, None, None),), **kw):
    got = co.build_sections(spark.createDataFrame(rows, NOTES), spark.createDataFrame(list(sections), SECTIONS), **kw)
    return sorted(got.notes.collect(), key=lambda r: (r.rec, r.label, r.seq)), {(r.rec, r.label): r for r in got.reports.collect()}


def test_three_passes_outvote_one(spark):
    notes, reports = build(spark, passes(GOOD, GOOD, GOOD, FLAT))
    assert [n.pitch for n in notes] == GOOD and [tuple(x) for x in notes[2].alternatives] == [(77, 0.25)]
    assert reports[1, "A"].used == [0, 1, 2, 3] and reports[1, "A"].reason == "voted" and abs(notes[2].agreement - 0.75) < 1e-12


def test_an_even_split_is_unsure(spark):
    notes, reports = build(spark, passes(GOOD, GOOD, FLAT, FLAT))
    third = notes[2]
    assert third.pitch == 78 and third.agreement == 0.5 and third.alternatives[0].pitch == 77
    assert reports[1, "A"].conf < build(spark, passes(GOOD, GOOD, GOOD, GOOD))[1][1, "A"].conf


def test_an_unlike_pass_is_left_out(spark):
    notes, reports = build(spark, passes(GOOD, GOOD, GOOD, OTHER))
    assert [n.pitch for n in notes] == GOOD and reports[1, "A"].excluded == [3]
    assert build(spark, passes(GOOD, OTHER))[1][1, "A"].reason == "unaligned"


def test_without_a_vote_the_surest_pass_holds(spark):
    rows = passes(GOOD) + [(1, "A", 1, i, i * 0.5, 0.5, p, 0.95, 0.0) for i, p in enumerate(FLAT)]
    notes, reports = build(spark, rows, enabled=False)
    assert [n.pitch for n in notes] == FLAT and reports[1, "A"].used == [1] and reports[1, "A"].mean_agreement == 0.0 and not reports[1, "A"].excluded
    assert build(spark, passes(GOOD))[1][1, "A"].reason == "single"


def test_an_octave_slip_costs_no_agreement(spark):
    notes, _ = build(spark, passes(GOOD, GOOD, [74, 64, 78, 79]))
    assert notes[1].pitch == 76 and notes[1].agreement == 1.0 and notes[1].alternatives[0].pitch == 64


def test_repeated_notes_stay_apart_and_lifts_are_closed(spark):
    rows = [(1, "A", b, i, t, d, p, 0.9, 0.0) for b in range(2) for i, (t, d, p) in enumerate(((0.0, 0.5, 74), (0.5, 0.5, 74), (1.0, 0.25, 76), (1.5, 0.5, 78)))]
    notes, _ = build(spark, rows, [(1, "A", 3.0, 4, None, None)])
    assert [(n.pitch, n.start, n.dur) for n in notes] == [(74, 0.0, 0.5), (74, 0.5, 0.5), (76, 1.0, 0.5), (78, 1.5, 0.5), (None, 2.0, 1.0)]


def test_the_odd_bar_stands_where_the_phrase_breaks(spark):
    line = [(i * 0.5, 0.5) for i in range(8)] + [(4.0, 2.0)] + [(6 + i * 0.5, 0.5) for i in range(12)] + [(12.0, 2.0)]
    rows = [(1, "A", b, i, t, d, 70 + i % 9, 0.9, 0.0) for b in range(2) for i, (t, d) in enumerate(line)]
    notes, _ = build(spark, rows, [(1, "A", 14.0, 4, 4, 2.0)])
    beats = {m: sum(n.dur for n in notes if n.measure == m) for m in range(1, 5)}
    assert sum(beats.values()) == 14 and beats[4] > 2
    assert {n.measure for n in build(spark, rows, [(1, "A", 14.0, 4, None, None)])[0]} == {1, 2, 3, 4}


def test_no_notes(spark):
    assert build(spark, passes([])) == ([], {})


@pytest.mark.parametrize("seed", [1, 2])
def test_votes_by_a_plain_fold(spark, seed):
    rng = random.Random(seed)
    grids = [(1, f"s{k}", b, [rng.choice([-1, 60, 61, 72, 73]) for _ in range(12)], rng.choice([0.25, 0.5, 1.0])) for k in range(6) for b in range(rng.randint(1, 5))]
    got = {(r.label, r.slot): (r.pitch, r.agreement, [tuple(x) for x in r.alternatives]) for r in co.vote_slots(spark.createDataFrame(grids, "rec long, label string, block long, slots array<int>, weight double")).collect()}
    for k in range(6):
        mine = [g for g in grids if g[1] == f"s{k}"]
        for s in range(12):
            tally, classes = {}, {}
            for *_, slots, w in mine:
                tally[slots[s]] = tally.get(slots[s], 0) + w
            for p, w in tally.items():
                classes[p if p < 0 else p % 12] = classes.get(p if p < 0 else p % 12, 0) + w
            pc = max(classes, key=classes.get)
            pitch = max((p for p in tally if (p if p < 0 else p % 12) == pc), key=tally.get)
            total = sum(tally.values())
            order = sorted(tally.items(), key=lambda x: -x[1])
            assert got[f"s{k}", s] == (pitch, classes[pc] / total, [(p, w / total) for p, w in order[1:3] if p != pitch])


def test_six_digits_as_the_sql_rounds(spark):
    """Ties of the seventh digit fall as DuckDB's round() lets them."""
    values = [(k * 1e-6 + 5e-7,) for k in range(700_000, 716_000, 7)]
    want = duckdb.connect().execute("SELECT round(x, 6) FROM (SELECT unnest($1::DOUBLE[]) AS x)", [[v for (v,) in values]]).fetchall()
    assert [(r.x,) for r in spark.createDataFrame(values, "x double").coalesce(1).select(plan._six("x")).collect()] == want


def test_means_are_sums_in_order(spark):
    """0.1 + 0.2 + 0.3 is summed by place, whatever the order of the rows."""
    rows = [(1, "A", i, v) for i, v in ((2, 0.3), (0, 0.1), (1, 0.2))]
    for some in itertools.permutations(rows):
        assert co._mean(spark.createDataFrame(list(some), "rec long, label string, seq long, conf double"), "seq", "conf").head().conf == (0.1 + 0.2 + 0.3) / 3


def test_few_sections_are_held_at_once():
    """A batch of 600 sections comes out in parts, all notes of it once."""
    slot = pa.struct([("slot", pa.int32()), ("pitch", pa.int32()), ("agreement", pa.float64()), ("salience", pa.float64()), ("error", pa.float64()), ("starts", pa.bool_()), ("alternatives", pa.list_(pa.struct([("pitch", pa.int32()), ("share", pa.float64())])))])
    rows = [{"rec": i, "label": "A", "x": [{"slot": s, "pitch": 60 + s // 2, "agreement": 1.0, "salience": 0.1, "error": 0.0, "starts": False, "alternatives": []} for s in range(6)]} for i in range(600)]
    parts = list(co._notes(iter([pa.RecordBatch.from_pylist(rows, pa.schema([("rec", pa.int64()), ("label", pa.string()), ("x", pa.list_(slot))]))])))
    assert max(len(set(p.column("rec").to_pylist())) for p in parts) <= 256
    assert [x for p in parts for x in p.column("rec").to_pylist()] == [i for i in range(600) for _ in range(3)]


def test_passes_compare_as_the_column_does(spark):
    """Passes of several lengths, octaves off and silent ones; in build_sections() no row of pairs is left to interpreted lambdas."""
    from pyspark.sql import functions as F

    from cadenza.operators.form import alignment_score

    rng = random.Random(9)
    grids = [(rec, "A", b, rng.random(), [rng.choice([-1, 60, 62, 72, 74, 50]) for _ in range(rng.choice([5, 5, 5, 9, 1, 0]))]) for rec in range(40) for b in range(rng.randint(1, 6))]
    grids += [(99, "A", b, 0.5, [-1] * 5) for b in range(3)]
    df = spark.createDataFrame(grids, "rec long, label string, block long, conf double, slots array<int>")
    a, b = df.alias("a"), df.alias("b")
    pairs = a.join(b, F.expr("a.rec = b.rec")).select("a.rec", F.col("a.block").alias("i"), F.col("b.block").alias("j"), alignment_score(F.col("a.slots"), F.col("b.slots")).alias("score"))
    want = {(r.rec, r.i, r.j): r.score for r in pairs.collect()}
    rows = df.groupBy("rec", "label").agg(F.array_sort(F.collect_list(F.struct("block", "conf", "slots"))).alias("all")).withColumn("scored", F.lit(True))
    got = rows.mapInArrow(co._compared, "rec long, label string, all array<struct<block: bigint, conf: double, slots: array<int>>>, alike array<array<double>>").collect()
    assert {(r.rec, i, j): x for r in got for i, some in enumerate(r.alike) for j, x in enumerate(some)} == want
    assert "transform" not in co.judged_sections(df)._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[1]
