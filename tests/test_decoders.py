"""Best lines against searches over all of them, on small inputs."""

import itertools
import random

import numpy as np
import pytest

from cadenza.operators import decoders as de
from cadenza.operators.lines import BestLine

FRAGMENTS = "rec long, frag long, start long, pitch array<double>, salience array<double>"


def line_by_hand(fragments, hop, costs=de.COSTS):
    """The best of all chains of fragments (frag, start, pitch, salience), as {frame: (midi, conf)}."""
    middles = [np.median(p) for _, _, p, _ in fragments]
    low, high = np.percentile(middles, 10), np.percentile(middles, 90)

    def worth(f):
        _, _, p, s = f
        spread = np.percentile(p, 90) - np.percentile(p, 10) if len(p) > 2 else 0
        height = np.clip((np.median(p) - low) / max(high - low, 1e-6), 0, 1)
        return len(p) * hop * (np.mean(s) + 0.8 * height) * (0.05 if len(p) * hop > 2.5 and spread < 0.5 else 1)

    def total(chain):
        value = sum(map(worth, chain))
        for a, b in itertools.pairwise(chain):
            gap, leap = b[1] - a[1] - len(a[2]), abs(np.median(b[2]) - np.median(a[2]))
            if b[1] <= a[1] or gap * hop > 2:
                return -np.inf
            value -= 0.35 * max(0, leap - 0.4) + 1.5 * (abs(leap - 12) < 1) + 0.5 * max(0, gap) * hop
        return value

    ordered = sorted(fragments, key=lambda f: (f[1], f[0]))
    chains = (c for n in range(1, len(fragments) + 1) for c in itertools.combinations(ordered, n))
    out = {}
    for _, start, p, s in max(chains, key=total):
        out |= {start + i: (p[i], s[i]) for i in range(len(p))}
    peak = max(c for _, c in out.values()) or 1
    return {t: (m, c / peak) for t, (m, c) in out.items()}


def test_fragments_by_brute_force(spark):
    rng, want, rows = random.Random(3), {}, []
    for rec in range(30):
        mine, start = [], 0
        for frag in range(rng.randint(1, 9)):
            n = rng.randint(1, 12)
            base = rng.uniform(55, 85)
            mine.append((frag, start, [base + rng.uniform(-2, 2) * (frag % 3 > 0) for _ in range(n)], [rng.random() for _ in range(n)]))
            start += rng.randint(0, 22)
        rng.shuffle(mine)
        rows += [(rec, *f) for f in mine]
        want[rec] = line_by_hand(mine, 0.25)
    got = {}
    for r in de.decode_fragments(spark.createDataFrame(rows, FRAGMENTS), 0.25).collect():
        got.setdefault(r.rec, {})[r.frame] = (r.midi, r.conf)
    assert set(got) == set(want)
    for rec, line in want.items():
        assert got[rec].keys() == line.keys() and np.allclose([got[rec][t] for t in sorted(line)], [line[t] for t in sorted(line)])


def test_a_quiet_moving_line_wins_over_a_loud_held_pitch(spark):
    moving = [(1, i + 1, i * 100, [p] * 100, [0.45] * 100) for i, p in enumerate((74.0, 76.0, 78.0, 76.0, 74.0, 72.0))]
    got = de.decode_fragments(spark.createDataFrame([(1, 0, 0, [69.0] * 600, [1.0] * 600), *moving], FRAGMENTS), 0.01).collect()
    assert len(got) > 200 and sum(abs(r.midi - 69) < 0.5 for r in got) < 0.5 * len(got)


def test_fragments_edges(spark):
    assert de.decode_fragments(spark.createDataFrame([], FRAGMENTS), 0.01).count() == 0
    rows = [(1, 0, -2, [60.0, 61.0, 62.0], [0.5, 1.0, 0.5]), (1, 1, 1, [70.0, None], [0.25, 0.25]), (1, 2, 5, [], []), (1, 3, 6, [None, None], [1.0, 1.0])]
    got = {r.frame: (r.midi, r.conf) for r in de.decode_fragments(spark.createDataFrame(rows, FRAGMENTS), 0.01).collect()}
    assert set(got) <= {0, 1, 2} and max(c for _, c in got.values()) == 1.0


def viterbi(frames, costs=de.COSTS):
    """frames: a list of (midi, score) arrays, one after another."""
    score, back = frames[0][1], []
    for (before, _), (midi, own) in itertools.pairwise(frames):
        size = np.abs(midi[None] - before[:, None])
        total = score[:, None] - (1.4 * np.maximum(0, size - 0.4) + 1.5 * (np.abs(size - 12) < 1))
        back.append(total.argmax(0))
        score = total.max(0) + own
    k, way = int(score.argmax()), []
    for step in reversed(back):
        way.append(k)
        k = int(step[k])
    return [*way, k][::-1]


@pytest.fixture(scope="module")
def lattice(spark):
    rng, rows = random.Random(9), []
    for rec in range(3):
        for frame in range(120):
            if rng.random() < 0.06 and rec:
                continue
            rows += [(rec, frame, k, rng.choice([60.0, 62.0, 72.0]) + rng.random(), rng.random()) for k in range(rng.randint(1, 4))]
    return spark.createDataFrame(rows, "rec long, frame long, k long, midi double, salience double").cache()


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_candidates_by_plain_viterbi(spark, lattice, block):
    scored, want = {}, {}
    for r in de.candidate_scores(lattice, 0.02).collect():
        scored.setdefault((r.rec, r.frame), []).append((r.k, r.midi, r.salience, r.score))
    for rec in range(3):
        frames = sorted(t for x, t in scored if x == rec)
        for _, run in itertools.groupby(enumerate(frames), lambda x: x[1] - x[0]):
            run = [t for _, t in run]
            each = [sorted(scored[rec, t]) for t in run]
            way = viterbi([(np.array([c[1] for c in x]), np.array([c[3] for c in x])) for x in each])
            want |= {(rec, t): x[k][1:3] for t, x, k in zip(run, each, way, strict=True)}
    got = {(r.rec, r.frame): (r.midi, r.conf) for r in de.decode_candidates(lattice, 0.02, block=block).collect()}
    for rec in range(3):
        chosen = {key: x for key, x in want.items() if key[0] == rec}
        usual, peak = np.median([s for _, s in chosen.values() if s > 0]), max(s for _, s in chosen.values())
        assert {key: (m, s / peak) for key, (m, s) in chosen.items() if s >= 0.35 * usual} == {key: x for key, x in got.items() if key[0] == rec}


def test_held_candidates_lose(spark):
    scores = {(r.frame, r.k): r.score for r in de.candidate_scores(spark.createDataFrame([(1, t, k, 70.0 if k else 60.0 + t % 12, 0.5) for t in range(400) for k in (0, 1)], "rec long, frame long, k long, midi double, salience double"), 0.01).collect()}
    assert scores[200, 1] < scores[200, 0]


def test_ways_of_one_worth_fall_as_in_the_sql():
    """Of two ways worth 7.43 the SQL's sums (off first, then gain) are equal, so the earlier holds; with the gain first, the later was a digit larger."""
    offs = {("p", "x"): 1.24, ("r", "x"): 0.47}
    line = BestLine(lambda before, item: True, lambda before, item: offs.get((before, item)))
    for item, gain in (("p", 2.85), ("r", 2.08), ("x", 5.82)):
        line.add(item, gain, gain)
    assert line.items() == ["p", "x"]


def test_runs_of_all_lengths_over_small_batches(spark):
    """Many runs, of one to nine frames with one to three candidates, walked together from batches of seven rows, as each alone; the line's plan walks nothing again."""
    rng = random.Random(8)
    rows = [(rec, run * 10 + f, k, rng.uniform(60, 75), rng.random() + 0.1) for rec in range(3) for run in range(12) for f in range(rng.randrange(1, 10)) for k in range(rng.randrange(1, 4))]
    lattice = spark.createDataFrame(rows, "rec long, frame long, k long, midi double, salience double")
    told = lambda **more: sorted(tuple(r) for r in de.decode_candidates(lattice, 0.02, **more).collect())
    want = told(block=2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert told() == want
        assert "MapInArrow" not in de.decode_candidates(lattice, 0.02)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
