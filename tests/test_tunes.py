import random

import numpy as np
from pyspark.sql import functions as F

from cadenza.operators import chance, cleaning, form, frames, sections
from cadenza.operators import music as mu
from cadenza.sources import export, notation_notes


def contour(spark, midi):
    return spark.createDataFrame([(1, i, i * 0.01, None if m is None else float(m), 1.0) for i, m in enumerate(midi)], "rec long, frame long, t double, midi double, conf double")


def midi_of(df):
    return [r.midi for r in df.orderBy("frame").collect()]


def test_median_stays_inside_runs(spark):
    got = midi_of(cleaning.median_in_runs(contour(spark, [60, 60, 72, 60, 60, None, 50, 51]), 2))
    assert got == [60.0] * 5 + [None, 50.0, 51.0]


def test_vibrato_is_flattened_and_steps_stay(spark):
    wobble = [60 + 0.3 * (-1) ** i for i in range(30)]
    got = midi_of(cleaning.flatten_vibrato(contour(spark, wobble), 9))
    assert max(got[9:21]) - min(got[9:21]) < 0.1
    step = [60.0] * 20 + [65.0] * 20
    flat = midi_of(cleaning.flatten_vibrato(contour(spark, step), 9))
    assert flat[19:21] == [60.0, 65.0]


def test_drone_goes_only_where_the_melody_is_elsewhere(spark):
    melody = [70.0] * 50 + [62.0] * 40 + [71.0] * 50
    assert midi_of(cleaning.drop_drones(contour(spark, melody)))[50:90] == [None] * 40
    alone = [62.0] * 140
    assert midi_of(cleaning.drop_drones(contour(spark, alone))) == alone


def test_bass_coupling_needs_enough_frames(spark):
    high, low = contour(spark, [70.0] * 10), contour(spark, [58.0] * 9 + [55.0])
    assert cleaning.bass_coupling(high, low, 5).collect()[0].coupling == 0.9
    assert cleaning.bass_coupling(high, low, 50).collect()[0].coupling is None


def test_beats_fold_both_ways(spark):
    beats = spark.createDataFrame([(r, i, float(i)) for r in (1, 2) for i in range(5)], "rec long, beat_idx long, t double")
    factors = spark.createDataFrame([(1, 2.0), (2, 0.5)], "rec long, factor double")
    got = cleaning.fold_beats(beats, factors).orderBy("rec", "beat_idx").collect()
    assert [r.t for r in got if r.rec == 1] == [0, 0.5, 1, 1.5, 2, 2.5, 3, 3.5, 4]
    assert [(r.beat_idx, r.t) for r in got if r.rec == 2] == [(0, 0), (1, 2), (2, 4)]


def test_bar_layouts(spark):
    beats = spark.createDataFrame([(16.0,), (32.0,), (18.0,), (34.0,), (3.0,)], "b double")
    got = {r.b: r.l for r in beats.select("b", form.bar_layout(F.col("b")).alias("l")).collect()}
    assert (got[16.0].beats_per_bar, got[16.0].bars) == (2, 8)
    assert (got[32.0].beats_per_bar, got[32.0].bars, got[32.0].odd) == (4, 8, None)
    assert (got[34.0].beats_per_bar, got[34.0].odd) == (4, 2)
    assert got[3.0] is None


def test_slot_similarity_on_columns_and_in_the_search_agree(spark):
    rng = random.Random(5)
    grid = np.array([[rng.choice([-1, 60, 62, 72]) for _ in range(12)] for _ in range(6)] + [[-1] * 12] * 2)
    rows = [(i, j, grid[i].tolist(), grid[j].tolist()) for i in range(8) for j in range(i + 1, 8)]
    got = spark.createDataFrame(rows, "i int, j int, a array<int>, b array<int>").select("i", "j", form.slot_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    sim = form._similarities(grid)
    assert all(abs(sim[r.i, r.j] - r.s) < 1e-12 for r in got) and sim[6, 7] == 1.0


def test_form_plausibility(spark):
    rows = [(o, i, x) for o, text in ((1, "AABBAABB"), (2, "ABCDEFG"), (3, "BBAABB")) for i, x in enumerate(text)]
    got = {r.owner: r.score for r in form.form_plausibility(spark.createDataFrame(rows, "owner long, seq long, label string")).collect()}
    assert got[1] == 1.0 and got[3] == 1.0 and got[2] < 0.2
    assert abs(got[1] - form._worth(list("AABBAABB"))[1]) < 1e-12 and abs(got[2] - form._worth(list("ABCDEFG"))[1]) < 1e-12


def tune(spark):
    rng = random.Random(2)
    a, b = ([rng.randint(60, 80) for _ in range(32)] for _ in range(2))
    played = (a + a + b + b) * 2
    return spark.createDataFrame([(1, i, p, i * 0.5, 0.5) for i, p in enumerate(played)], "rec long, seq long, pitch int, start double, dur double")


def test_search_finds_the_planted_form(spark):
    notes = tune(spark)
    got = form.search_form(notes, notes.groupBy("rec").agg(F.min("start").alias("first_beat"))).collect()
    assert [(r.block_beats, r.offset, r.form, r.beats_per_bar, r.bars) for r in got] == [(16, 0.0, "AABBAABB", 2, 8)]
    few = notes.where("seq < 7")
    assert form.search_form(few, few.groupBy("rec").agg(F.min("start").alias("first_beat"))).count() == 0


def test_lengths_keep_to_the_period(spark):
    spans = spark.createDataFrame([(1, 128.0, 32.0), (2, 128.0, 3.0), (3, 40.0, None), (4, 20.0, None)], "rec long, beats double, period double")
    got = {r.rec: r.lengths for r in form.candidate_lengths(spans).collect()}
    assert got == {1: [16, 32], 2: list(range(16, 49)), 3: [16, 17, 18, 19, 20], 4: []}


def test_slot_notes_split_repeats_and_absorb_short_rests(spark):
    pitches = [60, 60, 60, 60, None, 62, 62, None, None, None, 64, 64]
    votes = spark.createDataFrame([(1, s, p, 1.0) for s, p in enumerate(pitches) if p], "rec long, slot int, pitch int, agreement double")
    marks = spark.createDataFrame([(1, 1), (1, 2)], "rec long, slot int")
    got = [(r.pitch, r.start, r.dur) for r in sections.slot_notes(votes, marks, 12).orderBy("seq").collect()]
    assert got == [(60, 0.0, 0.5), (60, 0.5, 0.75), (62, 1.25, 0.5), (None, 1.75, 0.75), (64, 2.5, 0.5)]


def test_odd_bar_stands_where_no_note_crosses(spark):
    starts = [0.0, 4.0, 6.0, 10.0]
    notes = spark.createDataFrame([(1, i, s, d) for i, (s, d) in enumerate(zip(starts, (4.0, 2.0, 4.0, 4.0), strict=True))], "rec long, seq long, start double, dur double")
    layouts = spark.createDataFrame([(1, 4, 4, 2)], "rec long, beats_per_bar int, bars int, odd int")
    assert [r.measure for r in sections.measures(notes, layouts).orderBy("seq").collect()] == [1, 2, 3, 4]


def test_sections_match_once(spark):
    pairs = spark.createDataFrame([(1, "A", "x", 0.9), (1, "A", "y", 0.9), (1, "B", "x", 1.0), (1, "B", "y", 0.2)], "rec long, truth string, pred string, similarity double")
    assert sorted((r.truth, r.pred) for r in sections.match_sections(pairs).collect()) == [("A", "x"), ("B", "y")]


def test_a_tune_is_above_chance_and_walks_are_not(spark):
    rng = random.Random(9)
    rows = [(t, i, rng.randint(60, 80)) for t in range(4) for i in range(80)]
    catalog = mu.ngrams(mu.intervals(spark.createDataFrame(rows, "rec long, seq long, pitch int")), 4)
    walks = mu.ngrams(mu.intervals(chance.walks(spark, 10)), 4)
    base = chance.null_baseline(catalog, walks, 10)
    assert base.count() == 4 and all(0 <= r.chance < 0.2 and r.spread >= 1e-3 for r in base.collect())
    best = chance.against_chance(mu.coverage(catalog, catalog), base).where("rank = 1").collect()
    assert all(r.tune == r.rec and r.confident for r in best) and len(best) == 4


def test_walks_are_reproducible_and_in_range(spark):
    a, b = (sorted(tuple(r) for r in chance.walks(spark.newSession(), 3, seed=4, length=50).collect()) for _ in range(2))
    assert a == b and len(a) == 150 and all(60 <= p <= 84 for _, _, p in a)


def test_notation_round_trip(spark):
    rows = [(1, "A", i // 4 + 1, i, p, t) for i, (p, t) in enumerate([(60, 480), (61, 960), (None, 240), (74, 720), (66, 120), (83, 480), (96, 1440), (47, 480)])]
    notes = spark.createDataFrame(rows, "rec long, section string, measure int, seq int, pitch int, dur_tick long")
    tunes = spark.createDataFrame([(1, "x", "4/4", 120.0, "C major", 0, 2)], "rec long, title string, meter string, tempo double, key string, sharps int, repeats int")
    text = export.tune_text(notes, tunes)
    assert text.collect()[0].text.startswith("X:1\nT:x\nM:4/4\nL:1/8\nQ:1/4=120\nK:C\nP:A\n|:C ^C2 z/2 d3/2|^F/4 b c''3 B,,:|")
    back = notation_notes(text.select(F.lit("s").alias("source"), F.col("rec").alias("tune"), "text")).orderBy("seq").collect()
    assert [(r.pitch, r.dur_tick) for r in back] == [(p, t) for *_, p, t in rows]


def test_signature_decides_accidentals(spark):
    rows = spark.createDataFrame([(66, 2), (65, 2), (70, -1), (71, -1), (68, 0)], "m int, s int")
    assert [r.p for r in rows.select(export.notation_pitch(F.col("m"), F.col("s")).alias("p")).collect()] == ["F", "=F", "B", "=B", "^G"]


def test_rows_and_records_for_writers(spark):
    raw = contour(spark, [60, None])
    got = export.frame_rows(raw, frames.gate(raw, low=61)).orderBy("frame").collect()
    assert [(r.raw_midi, r.clean_midi) for r in got] == [("60.0000", ""), ("", "")]
    records = export.note_records(spark.createDataFrame([(1, 1, 62), (1, 0, 60)], "rec long, seq int, pitch int")).collect()
    assert records[0].json == '{"rec":1,"n_notes":2,"notes":[{"seq":0,"pitch":60},{"seq":1,"pitch":62}]}'


def test_musicxml(spark, tmp_path):
    note = "<note><pitch><step>{}</step>{}<octave>{}</octave></pitch><duration>{}</duration></note>"
    bars = (
        f"<measure><attributes><divisions>2</divisions></attributes>{note.format('C', '', 4, 2)}{note.format('F', '<alter>1</alter>', 4, 1)}<note><rest/><duration>1</duration></note></measure>"
        f"<measure>{note.format('G', '', 4, 4)}<barline><repeat direction=\"backward\"/></barline></measure><measure>{note.format('A', '', 5, 3)}</measure>"
    )
    (tmp_path / "x.xml").write_text(f"<score-partwise><part>{bars}</part></score-partwise>")
    got = export.read_musicxml(spark, str(tmp_path / "x.xml")).orderBy("section", "measure", "seq").collect()
    assert [(r.section, r.measure, r.pitch, r.dur_tick) for r in got] == [(0, 1, 60, 960), (0, 1, 66, 480), (0, 1, None, 480), (0, 2, 67, 1920), (1, 1, 81, 1440)]


def test_best_above_chance_without_a_table_of_pairs(spark):
    """Blocks of three entries give what the table of all pairs gives, ties and an entry without a baseline included."""
    rng = random.Random(5)
    rows = [(o, i, rng.choice((-2, 2, 5))) for o in range(10) for i in range(12)]
    rows += [(10 + k, i, x) for k in range(3) for o, i, x in rows if o == 4]
    catalog = mu.ngrams(spark.createDataFrame(rows, "owner long, seq long, x int"), 3).localCheckpoint()
    walks = mu.ngrams(mu.intervals(chance.walks(spark, 10)), 3)
    base = chance.null_baseline(catalog, walks, 10).where("tune <> 2").localCheckpoint()
    got = chance.identified_above_chance(catalog, catalog, base, most=4, block=3)
    want = chance.against_chance(mu.coverage(catalog, catalog), base, most=4)
    plain = lambda df: sorted((r.rec, r["rank"], r.tune, round(r.coverage, 9), round(r.z, 6), round(r.margin, 6), r.confident) for r in df.collect())
    assert plain(got) == plain(want)
