"""Chains and sequential kernels against plain Python."""

import itertools
import random
import statistics

import numpy as np

from cadenza import functions as fn
from cadenza.operators import chains
from cadenza.operators import kernels as kn


def folded(values, off=0.65, persist=2, memory=64):
    """The cuts of one run, frame by frame."""
    out, begin, held, away = [], 0, [], 0
    for i, p in enumerate(values):
        if not held:
            held.append(p)
        elif abs(p - statistics.median(held[-memory:])) > off:
            away += 1
            if away >= persist:
                out.append((begin, i - away + 1))
                begin, held, away = i - away + 1, [p], 0
        else:
            away = 0
            held.append(p)
    return [*out, (begin, len(values))]


def test_runs_are_split_as_by_a_fold(spark):
    rng = random.Random(3)
    runs = {}
    for run in range(25):
        level, values = 60.0, []
        for _ in range(rng.randint(1, 300)):
            level = rng.choice([level] * 12 + [level + 1, level - 2])
            values.append(round(level + rng.gauss(0, 0.35), 3))
        runs[run] = values
    rows = [(1, run, i, v) for run, values in runs.items() for i, v in enumerate(values)]
    rng.shuffle(rows)
    for options in ({}, {"persist": 3, "memory": 5}):
        got = kn.split_runs(spark.createDataFrame(rows, "rec long, run long, frame long, midi double"), **options).collect()
        assert sorted((r.run, r.note_start, r.note_end) for r in got) == [(run, a, b) for run, values in runs.items() for a, b in folded(values, **options)]


def worth(notes, back=2.0):
    """What a line is worth, or None if a note can't follow another."""
    total = -0.8
    for k, (start, end, pitch, amp) in enumerate(notes):
        total += 2 * amp * min(end - start, 0.6) / 0.2
        if k:
            s, e, p, _ = notes[k - 1]
            if not s < start <= s + back:
                return None
            far = abs(pitch - p)
            total -= 0.02 * far + 0.05 * max(0, far - 5) + (0.4 if far >= 11.5 else 0) + max(0, start - e) + 1.5 * max(0, e - start)
    return total


def test_voice_is_the_best_of_all_lines(spark):
    rng = random.Random(6)
    rows = []
    for rec in range(40):
        t = 0.0
        for _ in range(9):
            t += rng.choice([0.0, 0.1, 0.2, 0.3, 2.5])
            rows.append((rec, round(t, 3), round(t + rng.choice([0.0, 0.1, 0.25, 0.9]), 3), rng.choice([50, 64, 66, 71, 76, 88]), round(rng.random(), 3)))
    got = {}
    for r in kn.select_voice(spark.createDataFrame(rows, "rec long, start double, end double, pitch int, amp double")).collect():
        got.setdefault(r.rec, []).append((r.start, r.end, r.pitch))
    for rec in range(40):
        notes = sorted(x[1:] for x in rows if x[0] == rec and x[3] >= 64 and x[2] > x[1])
        lines = [[notes[i] for i in c] for n in range(1, len(notes) + 1) for c in itertools.combinations(range(len(notes)), n)]
        best = max((w for w in map(worth, lines) if w is not None), default=None)
        # of notes alike in all but loudness the line can only hold the loudest
        mine = sorted({n[:3]: n for n in notes if n[:3] in got.get(rec, [])}.values())
        assert len(mine) == len(got.get(rec, []))
        assert best is None and not mine or abs(worth(mine) - best) < 1e-9


def test_clean_runs_its_stages_in_order(spark):
    rows = [(1, i, i * 0.01, None if 50 <= i < 52 else 57.0 if 80 <= i < 110 else 30.0 if 20 <= i < 23 else 69.0, 0.9) for i in range(200)]
    got = {r.frame: r.midi for r in chains.clean(spark.createDataFrame(rows, "rec long, frame long, t double, midi double, conf double")).collect()}
    assert len(got) == 200 and {round(m, 6) for m in got.values() if m is not None} == {69.0} and sum(m is None for m in got.values()) == 0


def test_segment_finds_planted_notes(spark):
    pitch = [69.0] * 100 + [71.0] * 100 + [None] * 20 + [73.0] * 50 + [None] * 2 + [73.1] * 50 + [None] * 30 + [60.0] * 3
    f = spark.createDataFrame([(1, i, i * 0.01, p, 0.5) for i, p in enumerate(pitch)], "rec long, frame long, t double, midi double, conf double")
    told = lambda df: sorted((round(r.start, 3), round(r.end, 3), round(r.pitch)) for r in df.collect())
    assert told(chains.segment(f, 0.01)) == [(0.0, 1.0, 69), (1.0, 2.0, 71), (2.2, 3.22, 73)]
    onsets = spark.createDataFrame([(1, 0.5), (1, 0.97)], "rec long, t double")
    assert told(chains.segment(f, 0.01, onsets))[:3] == [(0.0, 0.5, 69), (0.5, 1.0, 69), (1.0, 2.0, 71)]


def test_samples_of_a_curve(spark):
    rng = random.Random(1)
    curve = sorted({round(rng.random() * 10, 2) for _ in range(40)})
    y = [rng.random() for _ in curve]
    times = [-1.0, curve[0], curve[7], 11.0, *(round(rng.random() * 10, 3) for _ in range(60))]
    got = chains.sample_at(spark.createDataFrame([(1, t) for t in times], "rec long, t double"), spark.createDataFrame([(1, *p) for p in zip(curve, y, strict=True)], "rec long, t double, y double"))
    assert all(abs(r.y - np.interp(r.t, curve, y)) < 1e-12 for r in got.collect()) and got.count() == len(set(times))


def test_keys_are_read_back(spark):
    rows = [("A mixolydian",), ("B- minor",), ("D",), ("E- odd",), ("H major",), (None,)]
    got = [(r.k.tonic, r.k.mode) for r in spark.createDataFrame(rows, "t string").select(fn.parse_key(fn.F.col("t")).alias("k")).collect()]
    assert got == [(9, "mixolydian"), (10, "minor"), (2, "major"), (3, "major"), (None, "major"), (None, "major")]


def test_verdicts(spark):
    lines = {1: [60] * 8 + [62] * 2, 2: [60] * 4 + [62] * 2 + [64] * 2 + [65] * 2, 3: [60, 62, 64, 65, 67], 4: [60, 60]}
    notes = spark.createDataFrame([(r, i, p) for r, line in lines.items() for i, p in enumerate(line)] + [(5, 0, None)], "rec long, seq long, pitch int")
    forms = spark.createDataFrame([(1, "AABB"), (2, "A"), (3, None)], "rec long, form string")
    got = {r.rec: r for r in chains.verdict(chains.concentration(notes), forms).collect()}
    assert {r: (x.reading, x.level, x.sectioned) for r, x in got.items()} == {1: ("collapsed", "bad", True), 2: ("concentrated", "warn", False), 3: ("spread", "warn", False), 4: ("collapsed", "bad", False)}
    assert got[1].text.startswith("fell onto 60 and 62: 100 %") and got[4].text.startswith("fell onto 60: ") and got[2].text.endswith("no sections were found")


def test_pass_spans(spark):
    notes = spark.createDataFrame([(1, "A", 0, 1, 2.0, 0.5, 0.4), (1, "A", 0, 0, 1.0, 9.0, None), (1, "B", 1, 2, 3.0, 1.0, None)], "rec long, label string, pass long, seq long, start_sec double, dur_sec double, conf double")
    assert sorted(tuple(r) for r in chains.pass_spans(notes).collect()) == [(1, "A", 0, 2, 0.4, 1.0, 2.5), (1, "B", 1, 1, 0.0, 3.0, 4.0)]
