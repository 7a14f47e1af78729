"""Queries over the chains and reports, and SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import chains
from ..sources import HOP, frames, notes, table
from .sql import _FRAMES, _NOTES


def cleaned_frames(spark: SparkSession, d: str) -> DataFrame:
    got = chains.clean(frames(spark, d), without=())
    return got.select("rec", "frame", F.round("midi", 9).alias("midi"), F.round("conf", 9).alias("conf"))


def segmented_notes(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    # held pitches, so that runs are long enough to be notes
    held = f.withColumn("midi", F.when(F.floor(F.col("frame") / 8) % 5 < 4, 60 + F.floor(F.col("frame") / 24) % 7 + F.col("conf") / 10))
    got = chains.segment(held, HOP, f.where("conf > 0.9").select("rec", (F.col("t") + 0.004).alias("t")), beat_seconds=0.1)
    return got.select("rec", *(F.round(c, 6).alias(c) for c in ("start", "end", "pitch", "conf", "spread", "voiced")))


def bins_to_pitch(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(fn.bin_to_midi(F.col("value")), 9).alias("midi"))


def key_names(spark: SparkSession, d: str) -> DataFrame:
    mode = F.element_at(F.array(*map(F.lit, fn.MODES)), (F.col("n_regionkey") % 4 + 1).cast("int"))
    k = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), (F.col("n_nationkey") % 12).alias("tonic"), mode.alias("mode"))
    k = k.withColumns({"sharps": fn.key_signature(F.col("tonic"), F.col("mode")), "name": fn.key_name(F.col("tonic"), F.col("mode"))}).withColumn("read", fn.parse_key(F.col("name")))
    return k.select("nation", "sharps", "name", F.col("read.tonic").alias("tonic"), F.col("read.mode").alias("mode"))


def beat_strength(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    got = chains.sample_at(f.select("rec", (F.col("frame") * 0.037 - 0.02).alias("t")), f.select("rec", "t", F.col("conf").alias("y")))
    return got.select("rec", F.round("t", 9).alias("t"), F.round("y", 9).alias("strength"))


def pitch_concentration(spark: SparkSession, d: str) -> DataFrame:
    return chains.concentration(notes(spark, d)).select("rec", "rank", "pitch", F.round("share", 9).alias("share"), "n")


def least_sure_notes(spark: SparkSession, d: str) -> DataFrame:
    return chains.least_sure(notes(spark, d)).select("rec", "rank", "seq", "pitch", F.round("conf", 9).alias("conf"))


def line_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Recordings folded to one to eight pitches, by their number, so that lines of all kinds occur."""
    n = notes(spark, d).withColumn("pitch", (55 + F.col("pitch") % (1 + F.col("rec") % 8)).cast("int"))
    forms = n.select("rec").distinct().withColumn("form", F.get(F.array(F.lit("AABB"), F.lit("A"), F.lit(None)), (F.col("rec") % 3).cast("int")))
    return chains.verdict(chains.concentration(n), forms).withColumn("top2", F.round("top2", 9))


def pass_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every 16 notes are a section, every 8 a pass."""
    label, nth = F.chr(65 + F.floor(F.col("seq") / 16) % 3), F.floor(F.col("seq") / 8)
    n = notes(spark, d).select("rec", label.alias("label"), nth.alias("pass"), "seq", (F.col("beat") * 60).alias("start_sec"), F.col("dur").alias("dur_sec"), "conf")
    return chains.pass_spans(n).select("rec", "label", "pass", "n", F.round("conf", 9).alias("conf"), *(F.round(c, 6).alias(c) for c in ("first_sec", "last_sec")))


ALL = (cleaned_frames, segmented_notes, bins_to_pitch, key_names, beat_strength, pitch_concentration, least_sure_notes, line_verdicts, pass_spans)

_LIST = lambda values: "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"

SQL = {
    "bins_to_pitch": "SELECT event_id, round(69 + 12 * log2(55.0::DOUBLE * pow(2, value * 10 / 1200) / 440), 9) AS midi FROM events",
    "key_names": f"""WITH k AS (SELECT n_nationkey AS nation, n_nationkey % 12 AS tonic, n_regionkey % 4 AS m FROM nation),
s AS (SELECT *, {_LIST(fn.MAJOR_SHARPS)}[tonic + 1] - m AS raw, {_LIST(fn.MODES)}[m + 1] AS mode FROM k),
f AS (SELECT *, CASE WHEN raw > 7 THEN raw - 12 WHEN raw < -7 THEN raw + 12 ELSE raw END AS sharps FROM s)
SELECT nation, CAST(sharps AS INTEGER) AS sharps, CASE WHEN sharps < 0 THEN {_LIST(fn.FLAT_NAMES)}[tonic + 1] ELSE {_LIST(fn.SHARP_NAMES)}[tonic + 1] END || ' ' || mode AS name, CAST(tonic AS INTEGER) AS tonic, mode FROM f""",
    "beat_strength": f"""WITH {_FRAMES}, c AS (SELECT rec, frame * 0.01::DOUBLE AS t, conf AS y FROM f), q AS (SELECT DISTINCT rec, frame * 0.037::DOUBLE - 0.02::DOUBLE AS t FROM f),
a AS (SELECT q.rec, q.t, c.t AS pt, c.y AS py FROM q ASOF LEFT JOIN c ON q.rec = c.rec AND q.t >= c.t), b AS (SELECT a.*, c.t AS nt, c.y AS ny FROM a ASOF LEFT JOIN c ON a.rec = c.rec AND a.t <= c.t)
SELECT rec, round(t, 9) AS t, round(CASE WHEN pt IS NULL THEN ny WHEN nt IS NULL OR nt <= pt THEN py ELSE py + (ny - py) * (t - pt) / (nt - pt) END, 9) AS strength FROM b""",
    "pitch_concentration": f"""WITH {_NOTES}, c AS (SELECT rec, pitch, count(*) AS m, min(seq) AS s FROM n GROUP BY rec, pitch),
r AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY m DESC, s) AS rank, sum(m) OVER (PARTITION BY rec) AS n FROM c)
SELECT rec, CAST(rank AS INTEGER) AS rank, pitch, round(m / n, 9) AS share, CAST(n AS BIGINT) AS n FROM r WHERE rank <= 3""",
    "least_sure_notes": f"""WITH {_NOTES}, r AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY conf, seq) AS rank FROM n WHERE conf < 0.7)
SELECT rec, CAST(rank AS INTEGER) AS rank, seq, pitch, round(conf, 9) AS conf FROM r WHERE rank <= 8""",
    "line_verdicts": f"""WITH {_NOTES}, c AS (SELECT rec, 55 + pitch % (1 + rec % 8) AS p, count(*) AS m, min(seq) AS s FROM n GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY m DESC, s) AS rank, sum(m) OVER (PARTITION BY rec) AS n FROM c),
t AS (SELECT rec, sum(m / n) AS top2, string_agg(p::VARCHAR, ' and ' ORDER BY rank) AS ps, [true, false, false][rec % 3 + 1] AS sectioned FROM r WHERE rank <= 2 GROUP BY rec),
k AS (SELECT *, CASE WHEN top2 > 0.7 THEN 'collapsed' WHEN top2 > 0.58 THEN 'concentrated' ELSE 'spread' END AS reading FROM t)
SELECT rec, round(top2, 9) AS top2, reading, CASE WHEN reading = 'collapsed' THEN 'bad' ELSE 'warn' END AS level, sectioned, CASE reading WHEN 'collapsed' THEN 'fell onto ' || ps || ': ' WHEN 'concentrated' THEN 'not yet a melody: ' ELSE 'spread like a tune: ' END
  || CAST(round(top2 * 100) AS INTEGER) || ' % of the notes are two pitches at most (53 % in a tune as played)' || CASE WHEN sectioned THEN '' ELSE '; no sections were found' END AS text FROM k""",
    "pass_spans": f"""WITH {_NOTES} SELECT rec, chr((65 + seq // 16 % 3)::INTEGER) AS label, seq // 8 AS pass, count(*) AS n, round(avg(conf), 9) AS conf, round(arg_min(beat * 60, seq), 6) AS first_sec, round(arg_max(beat * 60 + dur, seq), 6) AS last_sec FROM n GROUP BY ALL""",
}
