"""Queries on cleaning, forms, sections and notation, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import chance as ch
from ..operators import cleaning as cl
from ..operators import form as fo
from ..operators import music as mu
from ..operators import sections as se
from ..sources import HOP, export, frames, notes, table
from ..storage import stash
from .sql import _BLOCKS, _FRAMES, _NOTES, _RLE, _RUNS


def _nine(df: DataFrame, *doubles: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in doubles})


def run_median(spark: SparkSession, d: str) -> DataFrame:
    return _nine(cl.median_in_runs(frames(spark, d)).select("rec", "frame", "midi"), "midi")


def vibrato(spark: SparkSession, d: str) -> DataFrame:
    return _nine(cl.flatten_vibrato(frames(spark, d), 2, 4.0).select("rec", "frame", "midi"), "midi")


def drones(spark: SparkSession, d: str) -> DataFrame:
    return cl.drop_drones(frames(spark, d), least=1, around=10).select("rec", "frame", "midi")


def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    return _nine(cl.cells(frames(spark, d), F.col("t"), 20), "midi")


def loudest_note(spark: SparkSession, d: str) -> DataFrame:
    n = notes(spark, d)
    events = n.select("rec", "seq", (F.col("seq") * 0.25).alias("start"), (F.col("seq") * 0.25 + F.col("dur")).alias("end"), "pitch", F.col("conf").alias("amp"))
    return _nine(cl.loudest(events, 0.125), "conf")


def coupling(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    return _nine(cl.bass_coupling(f, f.withColumn("midi", F.col("midi") - F.floor(F.col("conf") * 500) % 3), 20).withColumn("frames", F.col("frames").cast("long")), "coupling")


def held_pitch(spark: SparkSession, d: str) -> DataFrame:
    return _nine(cl.persistence(frames(spark, d).where("midi is not null").select("rec", "frame", "midi"), HOP, 6.0), "held")


def _strength(spark: SparkSession, d: str) -> DataFrame:
    return notes(spark, d).select("rec", F.col("seq").alias("beat_idx"), F.col("conf").alias("strength"))


def inferred_meter(spark: SparkSession, d: str) -> DataFrame:
    s = _strength(spark, d)
    found = cl.meter(s, mu.best_phase(s, 4))
    return _nine(found.select("rec", "beats_per_bar", F.col("phase").cast("int").alias("phase"), "confidence"), "confidence")


def folded_beats(spark: SparkSession, d: str) -> DataFrame:
    n = notes(spark, d)
    factors = n.select("rec").distinct().select("rec", F.pow(F.lit(2.0), (F.col("rec") % 5 - 2).cast("double")).alias("factor"))
    return _nine(cl.fold_beats(n.select("rec", F.col("seq").alias("beat_idx"), F.col("beat").alias("t")), factors), "t")


def bar_layouts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", (1 + F.floor("value") % 60).cast("int").alias("beats"))
    found = e.withColumn("l", fo.bar_layout(F.col("beats").cast("double")))
    return _nine(found.select("event_id", "beats", F.col("l.beats_per_bar").alias("beats_per_bar"), F.col("l.bars").alias("bars"), F.col("l.odd").alias("odd"), F.col("l.plausibility").alias("plausibility")), "plausibility")


def likely_form(spark: SparkSession, d: str) -> DataFrame:
    roles = table(spark, d, "conversations").select(F.col("conv_id").alias("owner"), F.col("turn").alias("seq"), F.translate(F.substring("role", 1, 1), "uas", "ABC").alias("label"))
    return _nine(fo.form_plausibility(roles), "score")


def _grids(spark: SparkSession, d: str) -> DataFrame:
    n = notes(spark, d)
    of = n.select("rec", F.floor(F.col("seq") / 8).alias("block"), (F.col("seq") % 8).cast("int").alias("i"), (60 + F.col("pitch") % 14).alias("p"), "conf")
    return of.groupBy("rec", "block").agg(F.array_sort(F.collect_list(F.struct("i", F.when(F.col("p") < 62, -1).otherwise(F.col("p")).alias("p")))).alias("x"), F.avg("conf").alias("conf")).where(F.size("x") == 8).select("rec", "block", F.transform("x", lambda v: v["p"]).alias("slots"), "conf")


def shifted_similarity(spark: SparkSession, d: str) -> DataFrame:
    a, b = _grids(spark, d).alias("a"), _grids(spark, d).alias("b")
    pairs = a.join(b, (F.col("a.rec") == F.col("b.rec")) & (F.col("a.block") + 1 == F.col("b.block")))
    return _nine(pairs.select(F.col("a.rec").alias("rec"), F.col("a.block").alias("block"), fo.slot_similarity(F.col("a.slots"), F.col("b.slots")).alias("near"), fo.alignment_score(F.col("a.slots"), F.col("b.slots")).alias("aligned")), "near", "aligned")


def reference_pass(spark: SparkSession, d: str) -> DataFrame:
    return _nine(se.reference_pass(_grids(spark, d).withColumn("label", F.when(F.col("block") % 2 == 0, "A").otherwise("B"))), "score")


def _evenly(spark: SparkSession, d: str) -> DataFrame:
    """Notes one after another, one beat apart."""
    return notes(spark, d).select("rec", "seq", "pitch", F.col("seq").cast("double").alias("start"), F.lit(1.0).alias("dur"))


def form_search(spark: SparkSession, d: str) -> DataFrame:
    n = _evenly(spark, d)
    return fo.search_form(n, n.groupBy("rec").agg(F.min("start").alias("first_beat")))


def contour_matches(spark: SparkSession, d: str) -> DataFrame:
    cells = cl.cells(frames(spark, d), F.col("frame") / 16, 16)
    return _nine(fo.contour_matches(fo.contour_blocks(fo.contour_grid(cells), 1.0, per=16)), "similarity")


def _passes(spark: SparkSession, d: str) -> DataFrame:
    return notes(spark, d).select("rec", "seq", "pitch", F.floor(F.col("seq") / 8).alias("block"), ((F.col("seq") % 8) * 0.75 + F.when(F.col("pitch") % 3 == 0, 0.25).otherwise(0.0)).alias("start"), "dur", "conf")


def slot_means(spark: SparkSession, d: str) -> DataFrame:
    return _nine(se.mean_by_slot(_passes(spark, d), "conf", 24), "conf")


def restart_votes(spark: SparkSession, d: str) -> DataFrame:
    return se.restarts(_passes(spark, d), 24)


def consensus_notes(spark: SparkSession, d: str) -> DataFrame:
    p = _passes(spark, d)
    slots = mu.to_slots(p, 24, 4).withColumn("weight", F.lit(1.0))
    return se.slot_notes(mu.vote(slots), se.restarts(p, 24), 24)


def placed_measures(spark: SparkSession, d: str) -> DataFrame:
    n = notes(spark, d).select("rec", "seq", (F.col("seq") * 0.75).alias("start"), F.lit(0.75).alias("dur"))
    layouts = n.select("rec").distinct().select("rec", F.lit(4).alias("beats_per_bar"), F.lit(9).alias("bars"), F.when(F.col("rec") % 3 > 0, (F.col("rec") % 3 + 1).cast("int")).alias("odd"))
    return se.measures(n, layouts).select("rec", "seq", F.col("measure").cast("int").alias("measure"))


def plain_measures(spark: SparkSession, d: str) -> DataFrame:
    return se.plain_sections(notes(spark, d).select("rec", "seq", F.col("beat").alias("start"))).select("rec", "seq", F.col("measure").cast("long").alias("measure"))


def bar_chords(spark: SparkSession, d: str) -> DataFrame:
    bars = notes(spark, d).select("rec", F.floor(F.col("seq") / 4).alias("bar"), (F.col("rec") % 12).cast("int").alias("tonic"), "pitch")
    return se.chord_tones(bars)


def section_scores(spark: SparkSession, d: str) -> DataFrame:
    n = notes(spark, d).select("rec", F.floor(F.col("seq") / 8).alias("block"), (F.col("seq") % 8).alias("i"), "pitch")
    a, b = n.withColumn("block", F.col("block") + 1), n.where("block > 0").select("rec", "block", "i", F.col("pitch").alias("other"))
    gap = F.abs(F.col("pitch") - F.col("other"))
    aligned = b.join(a, ["rec", "block", "i"], "left").groupBy("rec", "block").agg(F.count_if(gap == 0).alias("exact"), F.count_if((gap > 0) & (gap % 12 == 0)).alias("octave"), F.count("*").alias("n_truth"))
    return _nine(se.section_scores(aligned), "pitch", "pitch_class", "octave_rate")


def corpus_score(spark: SparkSession, d: str) -> DataFrame:
    return _nine(se.total_score(section_scores(spark, d)), "pitch", "pitch_class", "octave_rate", "mean_pitch")


def confidence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    value = F.col("value")
    return e.select("event_id", F.round(fn.note_confidence(value / 400, fn.stability(value / 7), fn.timing_score(value / 1000 - 0.2), (value % 10) / 9), 9).alias("confidence"))


def chance_levels(spark: SparkSession, d: str) -> DataFrame:
    catalog = mu.ngrams(mu.intervals(notes(spark, d)), 2)
    heard = mu.ngrams(mu.intervals(ch.walks(spark, 20, 0, 200)), 2)
    return ch.null_baseline(catalog, heard, 20)


def identify_above_chance(spark: SparkSession, d: str) -> DataFrame:
    catalog = stash(mu.ngrams(mu.intervals(notes(spark, d)), 4))
    heard = mu.ngrams(mu.intervals(ch.walks(spark)), 4)
    return ch.identified_above_chance(catalog, catalog, ch.null_baseline(catalog, heard, 40))


def notation_tokens(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", (36 + F.floor("value") % 70).cast("int").alias("midi"), (F.col("event_id") % 15 - 7).cast("int").alias("sharps"), (60 * (1 + F.floor(F.col("value") * 3) % 40)).cast("long").alias("ticks"))
    return e.select("event_id", export.notation_pitch(F.col("midi"), F.col("sharps")).alias("pitch"), export.notation_length(F.col("ticks")).alias("length"))


def tune_texts(spark: SparkSession, d: str) -> DataFrame:
    n = notes(spark, d).select("rec", F.when(F.col("seq") < 16, "A").otherwise("B").alias("section"), F.floor(F.col("seq") / 4).alias("measure"), "seq", F.when(F.col("pitch") % 7 > 0, F.col("pitch")).alias("pitch"), (480 * (1 + F.col("pitch") % 3)).cast("long").alias("dur_tick"))
    tunes = n.select("rec").distinct().select("rec", F.concat(F.lit("tune "), F.col("rec").cast("string")).alias("title"), F.lit("4/4").alias("meter"), F.lit(112.0).alias("tempo"), F.lit("D major").alias("key"), F.lit(2).alias("sharps"), (F.col("rec") % 2 + 1).alias("repeats"))
    return export.tune_text(n, tunes)


ALL = (
    run_median, vibrato, drones, grid_cells, loudest_note, coupling, held_pitch, inferred_meter, folded_beats, bar_layouts, likely_form, shifted_similarity, reference_pass, contour_matches, form_search, slot_means, restart_votes, consensus_notes, placed_measures, plain_measures,
    bar_chords, section_scores, corpus_score, confidence, chance_levels, identify_above_chance, notation_tokens, tune_texts,
)

_PADDED = f"""WITH {_FRAMES}, {_RUNS}, k AS (SELECT *, count(*) OVER (PARTITION BY rec, v, g) AS n, row_number() OVER (PARTITION BY rec, v, g ORDER BY frame) AS i FROM r),
p AS (SELECT *, 0 AS o FROM k UNION ALL SELECT * REPLACE (frame - t.o AS frame) FROM k, range(1, 3) t(o) WHERE v AND n >= 5 AND i = 1 UNION ALL SELECT * REPLACE (frame + t.o AS frame) FROM k, range(1, 3) t(o) WHERE v AND n >= 5 AND i = n),
s AS (SELECT *, {{stat}} OVER (PARTITION BY rec, v, g ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM p)"""
_LAYOUT = """WITH e AS (SELECT event_id, CAST(1 + CAST(floor(value) AS BIGINT) % 60 AS INTEGER) AS beats FROM events),
bw AS (SELECT b, CASE b WHEN 8 THEN 1.0 WHEN 4 THEN 0.5 WHEN 6 THEN 0.45 WHEN 7 THEN 0.35 WHEN 9 THEN 0.35 WHEN 12 THEN 0.3 WHEN 16 THEN 0.25 ELSE 0.12 END::DOUBLE AS w FROM range(0, 80) t(b)),
ow AS (SELECT o, CASE o WHEN 1 THEN 0.3 WHEN 2 THEN 0.95 WHEN 3 THEN 0.7 WHEN 5 THEN 0.35 WHEN 6 THEN 0.55 WHEN 7 THEN 0.25 ELSE 0.2 END::DOUBLE AS w FROM range(0, 9) t(o)),
m AS (SELECT event_id, beats, m, beats // m AS f, beats % m AS r, CASE m WHEN 2 THEN 0.95 ELSE 1.0 END::DOUBLE AS mw FROM e, (VALUES (2), (4)) v(m)),
c AS (SELECT event_id, beats, m, f AS bars, NULL::INTEGER AS odd, bw.w * mw AS p, m * 10 AS o FROM m JOIN bw ON b = f WHERE r = 0
UNION ALL SELECT event_id, beats, m, f + 1, r, greatest(x.w, 0.9::DOUBLE * y.w) * ow.w * mw, m * 10 + 1 FROM m JOIN bw x ON x.b = f + 1 JOIN bw y ON y.b = f JOIN ow ON ow.o = r WHERE r > 0
UNION ALL SELECT event_id, beats, m, f, r + m, bw.w * ow.w * mw, m * 10 + 2 FROM m JOIN bw ON b = f JOIN ow ON ow.o = r + m WHERE r > 0 AND f >= 1),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(p, 12) DESC, o) AS k FROM c WHERE bars BETWEEN 4 AND 12)
SELECT e.event_id, e.beats, k.m AS beats_per_bar, CAST(bars AS INTEGER) AS bars, odd, round(p, 9) AS plausibility FROM e LEFT JOIN k ON k.event_id = e.event_id AND k.k = 1"""
_GRIDS = _NOTES + """, gr AS (SELECT rec, seq // 8 AS block, list(CASE WHEN 60 + pitch % 14 < 62 THEN -1 ELSE 60 + pitch % 14 END ORDER BY seq) AS s, avg(conf) AS conf FROM n GROUP BY ALL HAVING count(*) = 8)"""


def _similar(a: str, b: str, turn: int) -> str:
    """SQL of the slot similarity of two lists of eight, the second turned."""
    at = lambda s: f"{b}[(i - {turn} - {s} + 24) % 8 + 1]"
    same, octave = (" OR ".join(f"({form.format(x=f'{a}[i + 1]', y=at(s))})" for s in (-1, 0, 1)) for form in ("{x} = {y}", "{y} <> -1 AND abs({x} - {y}) % 12 = 0"))
    worth = f"list_sum([CASE WHEN {a}[i + 1] = -1 THEN 0.0::DOUBLE WHEN {same} THEN 1.0::DOUBLE WHEN {octave} THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END FOR i IN range(0, 8)])"
    active = f"list_sum([CASE WHEN {a}[i + 1] <> -1 OR {b}[(i - {turn} + 24) % 8 + 1] <> -1 THEN 1 ELSE 0 END FOR i IN range(0, 8)])"
    return f"coalesce({worth} / nullif({active}, 0), 1.0)"


_ALIGNED = f"greatest({', '.join(_similar('x.s', 'y.s', t) for t in (-2, -1, 0, 1, 2))})"
_PASSES = _NOTES + """, ps AS (SELECT rec, seq // 8 AS block, (seq % 8) * 0.75::DOUBLE + CASE WHEN pitch % 3 = 0 THEN 0.25 ELSE 0.0 END::DOUBLE AS start, dur, conf FROM n)"""
_ABC = """CASE WHEN sharps >= 0 THEN ['C','^C','D','^D','E','F','^F','G','^G','A','^A','B'][midi % 12 + 1] ELSE ['C','_D','D','_E','E','F','_G','G','_A','A','_B','B'][midi % 12 + 1] END"""
_SIGNED = "contains(CASE WHEN sharps >= 0 THEN left('FCGDAEB', sharps) ELSE left('BEADGCF', -sharps) END, right(sp, 1))"
_PITCH = f"""CASE WHEN length(sp) = 2 AND {_SIGNED} THEN '' WHEN length(sp) = 2 THEN left(sp, 1) WHEN {_SIGNED} THEN '=' ELSE '' END
  || CASE WHEN midi // 12 - 1 >= 5 THEN lower(right(sp, 1)) || repeat('''', midi // 12 - 6) ELSE right(sp, 1) || repeat(',', 5 - midi // 12) END"""
_LENGTH = "CASE WHEN ticks = 480 THEN '' WHEN ticks % 480 = 0 THEN CAST(ticks // 480 AS VARCHAR) WHEN 480 % ticks = 0 THEN '/' || (480 // ticks) ELSE (ticks // gcd(ticks, 480)) || '/' || (480 // gcd(ticks, 480)) END"
_SCORED = _NOTES + """, b8 AS (SELECT rec, seq // 8 AS block, seq % 8 AS i, pitch FROM n), al AS (SELECT y.rec, count(*) FILTER (WHERE x.pitch = y.pitch) AS exact, count(*) FILTER (WHERE x.pitch <> y.pitch AND abs(x.pitch - y.pitch) % 12 = 0) AS octave, count(*) AS n_truth
FROM b8 y LEFT JOIN b8 x ON x.rec = y.rec AND x.i = y.i AND x.block + 1 = y.block WHERE y.block > 0 GROUP BY y.rec, y.block),
sc AS (SELECT rec, n_truth, round(exact / n_truth, 9) AS pitch, round((exact + octave) / n_truth, 9) AS pitch_class, round(octave / n_truth, 9) AS octave_rate FROM al)"""

SQL = {
    "run_median": _PADDED.format(stat="quantile_cont(midi, 0.5)") + " SELECT rec, frame, round(CASE WHEN v AND n >= 5 THEN s ELSE midi END, 9) AS midi FROM s WHERE o = 0",
    "vibrato": _PADDED.format(stat="avg(midi)") + " SELECT rec, frame, round(CASE WHEN v AND n >= 5 AND abs(midi - s) < 4 THEN s ELSE midi END, 9) AS midi FROM s WHERE o = 0",
    "drones": f"""WITH {_FRAMES}, q AS (SELECT rec, frame, t.s AS string FROM f, (VALUES (55), (62), (69), (76)) t(s) WHERE abs(midi - t.s) < 0.35), w AS (SELECT *, frame - row_number() OVER (PARTITION BY rec, string ORDER BY frame) AS g FROM q),
st AS (SELECT rec, string, min(frame) AS s, max(frame) + 1 AS e FROM w GROUP BY rec, string, g), cx AS (SELECT st.rec, string, s, e, count(*) AS n, quantile_cont(midi, 0.5) AS m FROM st JOIN f ON f.rec = st.rec AND midi IS NOT NULL AND (frame BETWEEN s - 10 AND s - 1 OR frame BETWEEN e AND e + 9) GROUP BY ALL),
gone AS (SELECT * FROM cx WHERE n >= 5 AND abs(m - string) > 2) SELECT rec, frame, CASE WHEN EXISTS (SELECT 1 FROM gone WHERE gone.rec = f.rec AND f.frame >= gone.s AND f.frame < gone.e) THEN NULL ELSE midi END AS midi FROM f""",
    "grid_cells": f"WITH {_FRAMES} SELECT rec, CAST(floor(frame * 0.01::DOUBLE * 20) AS BIGINT) AS cell, round(quantile_cont(midi, 0.5), 9) AS midi FROM f GROUP BY 1, 2",
    "loudest_note": f"""WITH {_NOTES}, v AS (SELECT rec, seq, pitch, conf, CAST(floor(seq * 0.25::DOUBLE / 0.125) AS BIGINT) AS a, CAST(ceil((seq * 0.25::DOUBLE + dur) / 0.125) AS BIGINT) AS b FROM n WHERE pitch >= 64), x AS (SELECT *, unnest(range(a, greatest(a + 1, b))) AS frame FROM v),
k AS (SELECT *, row_number() OVER (PARTITION BY rec, frame ORDER BY conf DESC, seq) AS k FROM x) SELECT rec, frame, CAST(pitch AS DOUBLE) AS midi, round(conf, 9) AS conf FROM k WHERE k = 1""",
    "coupling": f"""WITH {_FRAMES}, x AS (SELECT rec, CAST(CAST(floor(conf * 500) AS BIGINT) % 3 AS DOUBLE) AS d FROM f WHERE midi IS NOT NULL), c AS (SELECT rec, d, count(*) AS n FROM x GROUP BY ALL), k AS (SELECT *, sum(n) OVER (PARTITION BY rec) AS frames, row_number() OVER (PARTITION BY rec ORDER BY n DESC, d) AS k FROM c)
SELECT rec, CASE WHEN frames >= 20 THEN round(n / frames, 9) END AS coupling, CAST(frames AS BIGINT) AS frames FROM k WHERE k = 1""",
    "held_pitch": f"""WITH {_FRAMES}, b AS (SELECT rec, frame, midi, CAST(round_even(midi / 6, 0) AS BIGINT) AS bin FROM f WHERE midi IS NOT NULL), m AS (SELECT DISTINCT rec, frame, bin + t.k AS bin FROM b, (VALUES (-1), (0), (1)) t(k)),
i AS (SELECT *, frame - row_number() OVER (PARTITION BY rec, bin ORDER BY frame) AS g FROM m), h AS (SELECT *, count(*) OVER (PARTITION BY rec, bin, g) AS n FROM i) SELECT b.rec, b.frame, midi, round(n * 0.01::DOUBLE, 9) AS held FROM b JOIN h ON h.rec = b.rec AND h.frame = b.frame AND h.bin = b.bin""",
    "inferred_meter": f"""WITH {_NOTES}, m AS (SELECT rec, seq % 4 AS phase, avg(conf) AS s FROM n GROUP BY ALL), ph AS (SELECT rec, phase FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY s DESC, phase) AS k FROM m) WHERE k = 1),
q AS (SELECT n.rec, phase, count(*) AS n, coalesce(avg(conf) FILTER (WHERE (seq - phase + 4) % 4 = 0), 0) AS one, coalesce(avg(conf) FILTER (WHERE (seq - phase + 4) % 4 = 2), 0) AS three FROM n JOIN ph ON ph.rec = n.rec GROUP BY ALL),
r AS (SELECT *, CASE WHEN one > 1e-9 THEN three / one ELSE 1.0 END AS ratio FROM q) SELECT rec, CASE WHEN n >= 8 AND ratio > 0.985 THEN 2 ELSE 4 END AS beats_per_bar, CAST(CASE WHEN n < 8 THEN 0 WHEN ratio > 0.985 THEN phase % 2 ELSE phase END AS INTEGER) AS phase,
round(CASE WHEN n >= 8 THEN least(0.75::DOUBLE, abs(ratio - 0.985::DOUBLE) * 3 + 0.25::DOUBLE) ELSE 0.2::DOUBLE END, 9) AS confidence FROM r""",
    "folded_beats": f"""WITH {_NOTES}, x AS (SELECT rec, seq, beat, lead(beat) OVER (PARTITION BY rec ORDER BY seq) AS nxt, pow(2.0, rec % 5 - 2) AS f FROM n), y AS (SELECT *, unnest(CASE WHEN f > 1 AND nxt IS NOT NULL THEN range(0, CAST(f AS BIGINT)) ELSE [0] END) AS k FROM x WHERE f >= 1 OR seq % CAST(1 / f AS BIGINT) = 0)
SELECT rec, CAST(seq * f + k AS BIGINT) AS beat_idx, round(CASE WHEN k > 0 THEN beat + (nxt - beat) * k / f ELSE beat END, 9) AS t FROM y""",
    "bar_layouts": _LAYOUT,
    "likely_form": f"""WITH {_RLE}, t AS (SELECT * FROM (VALUES (1.0, 'AB'), (1.0, 'BA'), (0.5, 'ABC'), (0.5, 'BCA'), (0.5, 'CAB'), (0.35, 'A'), (0.15, 'ABCD'), (0.15, 'BCDA'), (0.15, 'CDAB'), (0.15, 'DABC')) v(w, o)),
l AS (SELECT owner, run, n, translate(label, 'uas', 'ABC') AS label FROM rl), m AS (SELECT owner, w, o, w::DOUBLE * avg(CASE WHEN label = substr(o, CAST((run - 1) % length(o) + 1 AS INTEGER), 1) THEN 1.0 ELSE 0.0 END) AS m FROM l, t GROUP BY owner, w, o), b AS (SELECT owner, max(m) AS m FROM m GROUP BY owner),
k AS (SELECT *, max(run) OVER (PARTITION BY owner) AS runs FROM rl), s AS (SELECT owner, avg(CASE n WHEN 1 THEN 0.35 WHEN 2 THEN 1.0 WHEN 3 THEN 0.5 WHEN 4 THEN 0.15 ELSE 0.10 END::DOUBLE) AS s FROM k WHERE runs <= 2 OR run < runs GROUP BY owner)
SELECT b.owner, round(greatest(0.05::DOUBLE, m * s), 9) AS score FROM b JOIN s ON s.owner = b.owner""",
    "shifted_similarity": f"WITH {_GRIDS} SELECT x.rec, x.block, round({_similar('x.s', 'y.s', 0)}, 9) AS near, round({_ALIGNED}, 9) AS aligned FROM gr x JOIN gr y ON y.rec = x.rec AND y.block = x.block + 1",
    "reference_pass": f"""WITH {_GRIDS}, l AS (SELECT *, CASE WHEN block % 2 = 0 THEN 'A' ELSE 'B' END AS label FROM gr), a AS (SELECT x.rec, x.label, x.block, any_value(x.conf) AS conf, coalesce(avg(CASE WHEN y.block IS NOT NULL THEN {_ALIGNED} END), 1.0) AS alike FROM l x LEFT JOIN l y ON y.rec = x.rec AND y.label = x.label AND y.block <> x.block GROUP BY ALL),
s AS (SELECT *, round(alike * 0.85::DOUBLE + conf * 0.15::DOUBLE, 9) AS score FROM a), k AS (SELECT *, row_number() OVER (PARTITION BY rec, label ORDER BY score DESC, block) AS k FROM s) SELECT rec, label, block, score FROM k WHERE k = 1""",
    "contour_matches": f"""WITH {_FRAMES}, b AS (SELECT rec, frame // 16 AS block, list(midi ORDER BY frame) AS c FROM f GROUP BY ALL HAVING count(*) = 16), p AS (SELECT x.rec, x.block AS i, y.block AS j, list_filter([abs(x.c[k] - y.c[k]) FOR k IN range(1, 17)], lambda g: g IS NOT NULL) AS g FROM b x JOIN b y ON y.rec = x.rec AND x.block < y.block)
SELECT rec, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(CASE WHEN len(g) < 8 THEN 0.0 ELSE len(list_filter(g, lambda v: v < 0.6 OR abs(v - 12) < 0.6)) / len(g) END, 9) AS similarity FROM p""",
    "slot_means": f"WITH {_PASSES}, a AS (SELECT *, greatest(0, CAST(round_even(start * 4, 0) AS INTEGER)) AS i0, CAST(round_even((start + dur) * 4, 0) AS INTEGER) AS ie FROM ps) SELECT rec, CAST(slot AS INTEGER) AS slot, round(avg(conf), 9) AS conf FROM (SELECT rec, conf, unnest(range(i0, least(24, greatest(i0 + 1, ie)))) AS slot FROM a WHERE i0 < 24) GROUP BY ALL",
    "restart_votes": f"WITH {_PASSES}, p AS (SELECT rec, count(DISTINCT block) AS passes FROM ps GROUP BY rec), v AS (SELECT rec, CAST(round_even(start * 4, 0) AS INTEGER) AS slot, count(DISTINCT block) AS votes FROM ps WHERE round_even(start * 4, 0) BETWEEN 0 AND 23 GROUP BY ALL) SELECT v.rec, slot, votes FROM v JOIN p ON p.rec = v.rec WHERE votes >= greatest(1, 0.5 * passes)",
    "placed_measures": f"""WITH {_NOTES}, x AS (SELECT rec, seq, seq * 0.75::DOUBLE AS start, CASE WHEN rec % 3 > 0 THEN rec % 3 + 1 END AS odd FROM n), r AS (SELECT DISTINCT rec, odd FROM x), a AS (SELECT rec, odd, unnest(CASE WHEN odd IS NULL THEN [-1] ELSE range(0, 9) END) AS pos FROM r),
ed AS (SELECT rec, pos, [k * 4 + CASE WHEN pos >= 0 AND k > pos THEN odd - 4 ELSE 0 END FOR k IN range(1, 10)] AS edges FROM a), c AS (SELECT ed.rec, pos, any_value(edges) AS edges, count(*) FILTER (WHERE len(list_filter(edges, lambda v: start + 1e-9 < v AND start + 0.75 - 1e-9 > v)) > 0) AS cost FROM ed JOIN x ON x.rec = ed.rec GROUP BY ed.rec, pos),
b AS (SELECT rec, edges FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY cost, pos) AS k FROM c) WHERE k = 1) SELECT x.rec, seq, CAST(least(9, len(list_filter(edges, lambda v: v <= start + 1e-9)) + 1) AS INTEGER) AS measure FROM x JOIN b ON b.rec = x.rec""",
    "plain_measures": f"WITH {_NOTES} SELECT rec, seq, CAST(floor(beat / 4) - min(floor(beat / 4)) OVER (PARTITION BY rec) + 1 AS BIGINT) AS measure FROM n",
    "bar_chords": f"""WITH {_NOTES}, x AS (SELECT rec, seq // 4 AS bar, (pitch - rec % 12) % 12 AS pc FROM n), c AS (SELECT rec, bar, count(*) FILTER (WHERE pc IN (0, 4, 7)) AS one, count(*) FILTER (WHERE pc IN (5, 9, 0)) AS four, count(*) FILTER (WHERE pc IN (7, 11, 2)) AS five FROM x GROUP BY ALL)
SELECT rec, bar, CASE WHEN one >= four AND one >= five THEN 'I' WHEN four >= five THEN 'IV' ELSE 'V' END AS chord, greatest(one, four, five) AS hits FROM c""",
    "section_scores": f"WITH {_SCORED} SELECT rec, n_truth, pitch, pitch_class, octave_rate FROM sc",
    "corpus_score": f"WITH {_SCORED} SELECT round(sum(pitch * n_truth) / sum(n_truth), 9) AS pitch, round(sum(pitch_class * n_truth) / sum(n_truth), 9) AS pitch_class, round(sum(octave_rate * n_truth) / sum(n_truth), 9) AS octave_rate, round(avg(pitch), 9) AS mean_pitch, count(*) AS sections FROM sc",
    "confidence": "SELECT event_id, round(0.3::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, value / 400)) + 0.2::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - value / 7 / 50)) + 0.15::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - abs(value / 1000 - 0.2::DOUBLE) / 0.25)) + 0.35::DOUBLE * least(1.0::DOUBLE, value % 10 / 9), 9) AS confidence FROM events",
    "notation_tokens": f"""WITH x AS (SELECT event_id, CAST(36 + CAST(floor(value) AS BIGINT) % 70 AS INTEGER) AS midi, CAST(event_id % 15 - 7 AS INTEGER) AS sharps, CAST(60 * (1 + CAST(floor(value * 3) AS BIGINT) % 40) AS BIGINT) AS ticks FROM events),
y AS (SELECT *, {_ABC} AS sp FROM x) SELECT event_id, {_PITCH} AS pitch, {_LENGTH} AS length FROM y""",
    "tune_texts": f"""WITH {_NOTES}, x AS (SELECT rec, seq, pitch AS midi, 2 AS sharps, 480 * (1 + pitch % 3) AS ticks FROM n), y AS (SELECT *, {_ABC} AS sp FROM x), z AS (SELECT rec, seq, CASE WHEN seq < 16 THEN 'A' ELSE 'B' END AS section, seq // 4 AS measure, CASE WHEN midi % 7 = 0 THEN 'z' ELSE {_PITCH} END || {_LENGTH} AS said FROM y),
b AS (SELECT rec, section, measure, string_agg(said, ' ' ORDER BY seq) AS said FROM z GROUP BY ALL), s AS (SELECT rec, section, string_agg(said, '|' ORDER BY measure) AS said FROM b GROUP BY ALL),
t AS (SELECT rec, string_agg('P:' || section || chr(10) || CASE WHEN rec % 2 = 1 THEN '|:' || said || ':|' ELSE '|' || said || '|' END, chr(10) ORDER BY section) AS said FROM s GROUP BY rec)
SELECT rec, concat_ws(chr(10), 'X:1', 'T:tune ' || rec, 'M:4/4', 'L:1/8', 'Q:1/4=112', 'K:D', said) || chr(10) AS text FROM t""",
}
