"""Queries on cutting and joining notes and on files of notes, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames as fr
from ..operators import segments as sg
from ..sources import HOP, TICKS, export, frames, notes
from .sql import _FRAMES, _NOTES, _RUNS


def onset_cuts(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    onsets = f.where("conf > 0.3").select("rec", (F.col("frame") * HOP + 0.004).alias("t"))
    return sg.cut_at_onsets(fr.voiced_runs(f), onsets, HOP, 0.01)


def joined_dropouts(spark: SparkSession, d: str) -> DataFrame:
    n = notes(spark, d).withColumn("start", F.col("seq") * 0.25)
    heard = n.select("rec", "start", (F.col("start") + F.when(F.col("seq") % 5 == 0, 0.125).otherwise(0.225) + F.col("seq") % 3 * 0.01).alias("end"), (60.3 + F.col("pitch") % 2).alias("pitch"), "conf", (F.col("conf") * 20).alias("spread"), F.lit(1.0).alias("voiced"))
    joined = sg.join_dropouts(heard)
    return joined.withColumns({c: F.round(c, 9) for c in joined.columns if c != "rec"})


def absorbed_intruders(spark: SparkSession, d: str) -> DataFrame:
    got = sg.absorb_intruders(notes(spark, d).withColumn("pitch", F.col("pitch") % 5), 0.6)
    return got.withColumn("dur", F.round("dur", 6))


def _timed(spark: SparkSession, d: str) -> DataFrame:
    return notes(spark, d).select("rec", "seq", (F.col("seq") * 480).alias("start_tick"), (240 * (1 + F.col("pitch") % 4)).alias("dur_tick"), F.when(F.col("pitch") % 7 > 0, F.col("pitch")).alias("pitch"))


def midi_files(spark: SparkSession, d: str) -> DataFrame:
    n = _timed(spark, d)
    tunes = n.select("rec").distinct().select("rec", (100 + F.col("rec") % 40).alias("tempo"))
    return export.midi_file(n, tunes).select("rec", F.hex("content").alias("content"))


def musicxml_texts(spark: SparkSession, d: str) -> DataFrame:
    n = _timed(spark, d).withColumns({"section": F.when(F.col("seq") < 16, "A").otherwise("B"), "measure": F.floor(F.col("seq") / 4)})
    tunes = n.select("rec").distinct().select("rec", F.concat(F.lit("tune "), "rec").alias("title"), F.lit(4).alias("beats"), F.lit(2).alias("sharps"), (1 + F.col("rec") % 2).alias("repeats"))
    return export.musicxml_text(n, tunes)


ALL = (onset_cuts, joined_dropouts, absorbed_intruders, midi_files, musicxml_texts)

_DELTA = "||".join([f"CASE WHEN delta >= {1 << 7 * k} THEN printf('%02X', CAST((delta >> {7 * k}) & 127 | 128 AS INTEGER)) ELSE '' END" for k in (3, 2, 1)] + ["printf('%02X', CAST(delta & 127 AS INTEGER))"])

SQL = {
    "onset_cuts": f"""WITH {_FRAMES}, {_RUNS}, s AS (SELECT rec, min(frame) AS s, max(frame) + 1 AS e FROM r WHERE v GROUP BY rec, g), o AS (SELECT rec, frame * 0.01::DOUBLE + 0.004::DOUBLE AS t FROM f WHERE conf > 0.3),
h AS (SELECT s.rec, s, list([CAST(ceil(t / 0.01::DOUBLE) AS BIGINT)] ORDER BY t) AS x FROM s JOIN o ON o.rec = s.rec AND t > s * 0.01::DOUBLE + 0.01::DOUBLE AND t < e * 0.01::DOUBLE - 0.01::DOUBLE WHERE e - s >= 2 GROUP BY ALL),
c AS (SELECT s.rec, s.s, e, list_reduce(coalesce(x, CAST([] AS BIGINT[][])), lambda a, y: CASE WHEN y[1] - a[len(a)] >= 1 AND e - y[1] >= 1 THEN list_concat(a, y) ELSE a END, [s.s]) AS cuts FROM s LEFT JOIN h ON h.rec = s.rec AND h.s = s.s),
p AS (SELECT *, unnest(range(1, len(cuts) + 1)) AS i FROM c) SELECT rec, s AS run_start, cuts[i] AS note_start, coalesce(cuts[i + 1], e) AS note_end FROM p""",
    "absorbed_intruders": f"""WITH {_NOTES}, p AS (SELECT rec, seq, pitch % 5 AS pitch, dur, row_number() OVER w AS nth, count(*) OVER (PARTITION BY rec) AS n, quantile_cont(dur, 0.5) OVER (w ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING EXCLUDE CURRENT ROW) AS m FROM n WINDOW w AS (PARTITION BY rec ORDER BY seq)),
k AS (SELECT *, nth > 1 AND n >= 3 AND dur < 0.6::DOUBLE * m AS short FROM p), l AS (SELECT *, last_value(CASE WHEN NOT short THEN pitch END IGNORE NULLS) OVER (PARTITION BY rec ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS line FROM k),
g AS (SELECT *, sum(CASE WHEN short AND pitch <> line THEN 0 ELSE 1 END) OVER (PARTITION BY rec ORDER BY seq) AS g FROM l) SELECT rec, min(seq) AS seq, CAST(arg_min(pitch, seq) AS INTEGER) AS pitch, round(sum(dur), 6) AS dur FROM g GROUP BY rec, g""",
    "midi_files": f"""WITH {_NOTES}, v AS (SELECT rec, seq * 480 AS a, 240 * (1 + pitch % 4) AS d, pitch FROM n WHERE pitch % 7 > 0), ev AS (SELECT rec, a AS tick, 1 AS sounds, pitch FROM v UNION ALL SELECT rec, a + d, 0, pitch FROM v),
o AS (SELECT *, row_number() OVER w AS nth, CAST(tick - coalesce(lag(tick) OVER w, 0) AS BIGINT) AS delta FROM ev WINDOW w AS (PARTITION BY rec ORDER BY tick, sounds, pitch)),
t AS (SELECT rec, string_agg({_DELTA} || CASE sounds WHEN 1 THEN '90' ELSE '80' END || printf('%02X', pitch) || CASE sounds WHEN 1 THEN '50' ELSE '40' END, '' ORDER BY nth) AS said FROM o GROUP BY rec),
w AS (SELECT u.rec, '00FF5103' || printf('%06X', CAST(round_even(60000000::DOUBLE / (100 + u.rec % 40), 0) AS BIGINT)) || coalesce(said, '') || '00FF2F00' AS track FROM (SELECT DISTINCT rec FROM n) u LEFT JOIN t ON t.rec = u.rec)
SELECT rec, '4D5468640000000600000001{TICKS:04X}4D54726B' || printf('%08X', CAST(length(track) // 2 AS BIGINT)) || track AS content FROM w""",
}
