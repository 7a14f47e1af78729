"""Operators on constructed rows with hand-computed results."""

import math

from pyspark.sql import functions as F

from cadenza import functions as fn
from cadenza import sources, streaming
from cadenza.operators import frames as fr
from cadenza.operators import kernels as kn
from cadenza.operators import music as mu


def contour(spark, midi, conf=1.0):
    return spark.createDataFrame([(1, i, i * 0.01, None if m is None else float(m), conf) for i, m in enumerate(midi)], "rec long, frame long, t double, midi double, conf double")


def midi_of(df):
    return [r.midi for r in df.orderBy("frame").collect()]


def test_voiced_runs(spark):
    got = fr.voiced_runs(contour(spark, [None, 60, 61, None, None, 62])).orderBy("run_start").collect()
    assert [(r.run_start, r.run_end, r.n) for r in got] == [(1, 3, 2), (5, 6, 1)]
    assert fr.voiced_runs(contour(spark, [None, None])).count() == 0


def test_octave_correction_moves_a_dropped_octave_but_no_leap(spark):
    assert midi_of(fr.octave_correction(contour(spark, [69] * 40 + [57] * 10 + [69] * 40), 30)) == [69.0] * 90
    leap = [69] * 50 + [76] * 50
    assert midi_of(fr.octave_correction(contour(spark, leap), 30)) == [float(x) for x in leap]


def test_jump_gate_drops_every_other_candidate(spark):
    assert midi_of(fr.jump_gate(contour(spark, [60, 60, 72, 60, 60]))) == [60, 60, None, 60, 60]
    # 72, 60 and 72 are all candidates; the first and the third go
    assert midi_of(fr.jump_gate(contour(spark, [60, 72, 60, 72, 60]))) == [60, None, 60, None, 60]


def test_gaps_are_filled_inclusive_of_both_ends(spark):
    got = midi_of(fr.fill_gaps(contour(spark, [69, None, None, None, 70] + [None] * 6 + [70])))
    assert got[:5] == [69, 69, 69.5, 70, 70] and got[5:11] == [None] * 6
    assert midi_of(fr.fill_gaps(contour(spark, [None, 60, None]))) == [None, 60, None]


def test_rolling_median_pads_with_end_values(spark):
    got = [r["median"] for r in fr.rolling_median(contour(spark, [1, 5, 9, 2, 2]), 1).orderBy("frame").collect()]
    assert got == [1, 5, 5, 2, 2]


def test_split_runs(spark):
    f = spark.createDataFrame([(1, 1, i, m) for i, m in enumerate([69.0] * 10 + [71.0] * 10 + [71.1, 80.0, 71.0])], "rec long, run long, frame long, midi double")
    assert [(r.note_start, r.note_end) for r in kn.split_runs(f).orderBy("note_start").collect()] == [(0, 10), (10, 23)]


def test_quantized_starts_increase(spark):
    n = spark.createDataFrame([(1, i, 60, b, 0.5, 1.0) for i, b in enumerate([0.0, 0.05, 0.1, 1.0])], "rec long, seq long, pitch int, beat double, dur double, conf double")
    assert [(r.q, r.q_dur) for r in mu.quantize(n).orderBy("seq").collect()] == [(0, 1), (1, 1), (2, 2), (4, 2)]


def test_times_between_and_beyond_beats(spark):
    beats = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (1, 2, 4.0)], "rec long, beat_idx long, t double")
    times = spark.createDataFrame([(1, 0.25), (1, 1.5), (1, 3.0), (1, 5.5), (2, 7.0)], "rec long, t double")
    assert [r.beat for r in mu.on_beats(times, beats).orderBy("rec", "t").collect()] == [-0.5, 0.5, 1.5, 3.0, 7.0]


def test_vote_takes_the_class_then_the_octave(spark):
    s = spark.createDataFrame([(1, 0, 0, 62, 1.0), (1, 0, 1, 74, 1.5), (1, 0, 2, 64, 2.0)], "rec long, slot int, block int, pitch int, weight double")
    got = mu.vote(s).head()
    assert got.pitch == 74 and math.isclose(got.agreement, 2.5 / 4.5)


def test_auc_with_ties(spark):
    rows = [("all", 1.0, True), ("all", 0.0, False), ("none", 0.0, True), ("none", 1.0, False), ("tie", 1.0, True), ("tie", 1.0, False), ("one", 1.0, True)]
    got = {r.grp: r.auc for r in mu.auc(spark.createDataFrame(rows, "grp string, score double, positive boolean")).collect()}
    assert got == {"all": 1.0, "none": 0.0, "tie": 0.5, "one": 0.5}


def test_coverage_doesnt_change_by_transposition(spark):
    def notes(rec, up):
        return [(rec, i, p + up, float(i), 1.0, 1.0) for i, p in enumerate([60, 62, 64, 65, 67, 65, 64, 62, 60, 67, 69, 71, 72])]

    schema = "rec long, seq long, pitch int, beat double, dur double, conf double"
    catalog = mu.ngrams(mu.intervals(spark.createDataFrame(notes(1, 0), schema)))
    got = mu.coverage(catalog, mu.ngrams(mu.intervals(spark.createDataFrame(notes(9, 5), schema)))).head()
    assert got.coverage == 1.0


def test_alignment_counts_an_insertion_and_an_octave(spark):
    t = "array<struct<pitch:int,beat:double>>"
    pairs = spark.createDataFrame([(1, [(60, 0.0), (61, 0.5), (62, 1.0), (76, 2.0)], [(60, 0.0), (62, 1.0), (64, 2.0)])], f"rec long, pred {t}, truth {t}")
    got = kn.align(pairs).head()
    assert (got.exact, got.octave, got.gaps) == (2, 1, 1) and got.score == 2 + 2 + 0.5 - 1


def test_leader_groups(spark):
    pairs = [(1, i, j, 0.9 if (i < 2) == (j < 2) else 0.1) for i in range(4) for j in range(i + 1, 4)]
    got = kn.leaders(spark.createDataFrame(pairs, "rec long, i long, j long, similarity double"), 0.5).head()
    assert got.labels == "AABB" and math.isclose(got.quality, 0.8)


def test_scalar_functions(spark):
    one = spark.range(1)
    span = lambda x: one.select(fn.nearest_duration(F.lit(x))).head()[0]
    assert [span(x) for x in (0.52, 0.98, 0.26, 2.05, 0.88, 0.76)] == [0.5, 1.0, 0.25, 2.0, 1.0, 0.75]
    form = lambda x: one.select(fn.reduced_form(F.lit(x))).head()[0]
    assert [form(x) for x in ("ABAB", "AAAA", "AABB", "")] == ["AB", "A", "AABB", ""]
    assert one.select(fn.hz_to_midi(F.lit(440.0)), fn.hz_to_midi(F.lit(0.0))).head()[:] == (69.0, None)


def test_notation(spark, tmp_path):
    (tmp_path / "a.abc").write_text("% remark\nX:1\nT:One\nM:2/4\nK:D\nD2 ^F/2A | d'4 :|\nz2 E,3/2 |\nX:2\nT:no key\n")
    tunes = sources.read_notation(spark, str(tmp_path))
    assert [(r.title, r.key, r.beats_per_bar) for r in sources.notation_fields(tunes).collect()] == [("One", "D", 2.0)]
    got = sources.notation_notes(tunes).orderBy("section", "seq").collect()
    assert [(r.section, r.pitch, r.start_tick, r.dur_tick) for r in got] == [(0, 62, 0, 960), (0, 66, 960, 240), (0, 69, 1200, 480), (0, 86, 1680, 1920), (1, None, 0, 960), (1, 52, 960, 720)]


def test_stream_of_frames(spark, tmp_path):
    spark.sql("SELECT 1L AS rec, timestamp'2024-01-01 00:00:10' AS ts, 69.0D AS midi, 0.9D AS conf UNION ALL SELECT 1, timestamp'2024-01-01 00:00:20', 30.0, 0.9").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("rec long, ts timestamp, midi double, conf double").parquet(str(tmp_path / "in"))
    query = streaming.voiced_share(streaming.gated(stream)).writeStream.format("memory").queryName("voiced").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert [(r.n, r.voiced, r.pitch) for r in spark.sql("SELECT * FROM voiced").collect()] == [(2, 0.5, 69.0)]


def test_grams_of_words_are_made_in_their_row(spark):
    """As ngrams() makes them from a row for each word, none of texts that are too short, and without a shuffle."""
    texts = spark.createDataFrame([(1, "a b c a b c".split()), (2, ["a", "b"]), (3, []), (4, None), (5, ["x", "y", "z"])], "owner long, words array<string>")
    got = mu.word_ngrams(texts, 3)
    each = texts.select("owner", F.posexplode("words").alias("seq", "x"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mu.ngrams(each, 3).select("owner", "g").collect()))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
