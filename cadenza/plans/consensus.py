"""Queries over sections built from their passes, and SQL that states their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import consensus as co
from ..sources import notes
from .sql import _NOTES


def _built(spark: SparkSession, d: str) -> co.Sections:
    """Eight notes to a pass, every second pass of another section; pitches by their place, here and there an octave or a semitone off."""
    n = notes(spark, d).select("rec", "seq", F.floor(F.col("seq") / 8).alias("block"), F.col("seq") % 8, "pitch", "conf").toDF("rec", "seq", "block", "i", "p", "conf")
    label = F.when(F.col("block") % 2 == 0, "A").otherwise("B")
    pitch = 60 + (F.col("i") * 5 + F.col("rec")) % 12 + F.when(F.col("p") % 7 == 0, 12).otherwise(0) + F.when(F.col("p") % 4 == 0, 1).otherwise(0)
    made = n.select("rec", label.alias("label"), "block", "seq", (F.col("i") * 0.75).alias("start"), F.when(F.col("p") % 5 == 0, 0.5).otherwise(0.75).alias("dur"), pitch.alias("pitch"), "conf", (F.col("conf") / 5).alias("error"))
    sections = made.select("rec", "label").distinct().select("rec", "label", F.lit(6.0).alias("beats"), F.lit(4).alias("beats_per_bar"), F.lit(None).cast("int").alias("bars"), F.lit(None).cast("double").alias("odd"))
    return co.build_sections(made, sections)


def _six(c: str) -> Column:
    """To six digits as the SQL's round() does: the number times a million decides, not its decimal digits, where a tie is off by a last bit."""
    return (F.round(F.col(c) * 1e6) / 1e6).alias(c)


def built_sections(spark: SparkSession, d: str) -> DataFrame:
    said = F.array_join(F.transform("alternatives", lambda x: F.concat_ws(":", x["pitch"].cast("string"), F.rint(x["share"] * 1000).cast("int").cast("string"))), ",")
    return _built(spark, d).notes.select("rec", "label", "seq", "pitch", "start", "dur", _six("conf"), _six("agreement"), said.alias("alternatives"), F.col("measure").cast("int").alias("measure"))


def section_reports(spark: SparkSession, d: str) -> DataFrame:
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return _built(spark, d).reports.select("rec", "label", "reason", F.col("passes").cast("long").alias("passes"), joined("used"), joined("excluded"), _six("mean_agreement"), _six("conf"))


ALL = (built_sections, section_reports)


def _similar(turn: int) -> str:
    """SQL of the slot similarity of x.s and y.s, 24 slots, the second turned."""
    at = lambda s: f"y.s[(i - {turn} - {s} + 48) % 24 + 1]"
    same, octave = (" OR ".join(f"({form.format(y=at(s))})" for s in (-1, 0, 1)) for form in ("x.s[i + 1] = {y}", "{y} <> -1 AND abs(x.s[i + 1] - {y}) % 12 = 0"))
    worth = f"list_sum([CASE WHEN x.s[i + 1] = -1 THEN 0.0::DOUBLE WHEN {same} THEN 1.0::DOUBLE WHEN {octave} THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END FOR i IN range(0, 24)])"
    return f"coalesce({worth} / nullif(list_sum([CASE WHEN x.s[i + 1] <> -1 OR {at(0)} <> -1 THEN 1 ELSE 0 END FOR i IN range(0, 24)]), 0), 1.0)"


_BUILT = f"""WITH RECURSIVE {_NOTES}, ps AS (SELECT rec, seq, seq // 8 AS block, CASE WHEN (seq // 8) % 2 = 0 THEN 'A' ELSE 'B' END AS label, (seq % 8) * 0.75::DOUBLE AS start, CASE WHEN pitch % 5 = 0 THEN 0.5 ELSE 0.75 END::DOUBLE AS dur,
  CAST(60 + (seq % 8 * 5 + rec) % 12 + CASE WHEN pitch % 7 = 0 THEN 12 ELSE 0 END + CASE WHEN pitch % 4 = 0 THEN 1 ELSE 0 END AS INTEGER) AS p, conf, conf / 5 AS err FROM n),
sl AS (SELECT *, unnest(range(CAST(start * 4 AS INTEGER), least(24, greatest(CAST(start * 4 AS INTEGER) + 1, CAST(round_even((start + dur) * 4, 0) AS INTEGER))))) AS slot FROM ps),
h AS (SELECT rec, label, block, slot, arg_max(p, seq) AS p FROM sl GROUP BY ALL),
pa AS (SELECT rec, label, block, avg(conf) AS conf FROM ps GROUP BY ALL),
gr AS (SELECT pa.rec, pa.label, pa.block, pa.conf, list(coalesce(h.p, -1) ORDER BY t.slot) AS s FROM pa CROSS JOIN range(0, 24) t(slot) LEFT JOIN h ON h.rec = pa.rec AND h.label = pa.label AND h.block = pa.block AND h.slot = t.slot GROUP BY ALL),
al AS MATERIALIZED (SELECT x.rec, x.label, x.block AS a, y.block AS b, x.conf, greatest({", ".join(map(_similar, range(-2, 3)))}) AS score FROM gr x JOIN gr y ON y.rec = x.rec AND y.label = x.label),
rf AS (SELECT rec, label, a, round(coalesce(avg(score) FILTER (WHERE a <> b), 1.0) * 0.85::DOUBLE + any_value(conf) * 0.15::DOUBLE, 9) AS v, any_value(conf) AS conf FROM al GROUP BY ALL),
se AS (SELECT rec, label, count(*) AS passes, CASE WHEN count(*) < 2 THEN arg_max(a, (conf, -a)) ELSE arg_max(a, (v, -a)) END AS ref FROM rf GROUP BY ALL),
ft AS (SELECT al.rec, al.label, a AS block, passes, ref, al.conf, a = ref OR (passes >= 2 AND round(score, 9) >= 0.55) AS fits FROM al JOIN se ON se.rec = al.rec AND se.label = al.label AND al.b = se.ref),
us AS (SELECT *, CASE WHEN passes < 2 THEN 'single' WHEN count(*) FILTER (WHERE fits) OVER (PARTITION BY rec, label) < 2 THEN 'unaligned' ELSE 'voted' END AS reason FROM ft),
u AS (SELECT *, CASE WHEN reason = 'voted' THEN fits ELSE block = ref END AS used FROM us),
ty AS (SELECT gr.rec, gr.label, t.slot, gr.s[t.slot + 1] AS p, round(sum(greatest(0.05::DOUBLE, gr.conf)), 9) AS w, min(gr.block) AS b FROM gr JOIN u ON u.rec = gr.rec AND u.label = gr.label AND u.block = gr.block AND u.used, range(0, 24) t(slot) GROUP BY ALL),
tc AS (SELECT *, CASE WHEN p = -1 THEN -1 ELSE p % 12 END AS pc, sum(w) OVER (PARTITION BY rec, label, slot) AS total, row_number() OVER (PARTITION BY rec, label, slot ORDER BY w DESC, b) AS k FROM ty),
cw AS (SELECT rec, label, slot, pc, round(sum(w), 9) AS cw, min(b) AS cb, any_value(total) AS total FROM tc GROUP BY ALL),
wc AS (SELECT rec, label, slot, arg_max(pc, (cw, -cb)) AS pc, max(cw) / any_value(total) AS agreement FROM cw GROUP BY ALL),
wp AS (SELECT wc.rec, wc.label, wc.slot, any_value(agreement) AS agreement, arg_max(p, (w, -b)) AS p FROM wc JOIN tc ON tc.rec = wc.rec AND tc.label = wc.label AND tc.slot = wc.slot AND tc.pc = wc.pc GROUP BY ALL),
ot AS (SELECT tc.rec, tc.label, tc.slot, string_agg(tc.p || ':' || CAST(round_even(w / total * 1000, 0) AS INTEGER), ',' ORDER BY k) AS alternatives FROM tc JOIN wp ON wp.rec = tc.rec AND wp.label = tc.label AND wp.slot = tc.slot WHERE k IN (2, 3) AND tc.p <> wp.p AND tc.p <> -1 GROUP BY ALL),
ev AS (SELECT sl.rec, sl.label, slot, avg(sl.conf) AS sal, avg(err) AS err FROM sl JOIN u ON u.rec = sl.rec AND u.label = sl.label AND u.block = sl.block AND u.used GROUP BY ALL),
st AS (SELECT ps.rec, ps.label, CAST(round_even(start * 4, 0) AS INTEGER) AS slot, count(DISTINCT block) >= greatest(1, 0.5 * any_value(passes)) AS starts FROM ps JOIN se ON se.rec = ps.rec AND se.label = ps.label GROUP BY ALL),
al2 AS (SELECT wp.*, coalesce(ev.sal, 0) AS sal, coalesce(ev.err, 0) AS err, coalesce(starts, false) AS starts, coalesce(alternatives, '') AS alternatives FROM wp LEFT JOIN ev ON ev.rec = wp.rec AND ev.label = wp.label AND ev.slot = wp.slot LEFT JOIN st ON st.rec = wp.rec AND st.label = wp.label AND st.slot = wp.slot LEFT JOIN ot ON ot.rec = wp.rec AND ot.label = wp.label AND ot.slot = wp.slot),
fo AS (SELECT rec, label, slot, p, slot AS fr FROM al2 WHERE slot = 0 UNION ALL SELECT x.rec, x.label, x.slot, x.p, CASE WHEN x.p <> fo.p OR x.starts AND x.slot - fo.fr >= 2 THEN x.slot ELSE fo.fr END FROM fo JOIN al2 x ON x.rec = fo.rec AND x.label = fo.label AND x.slot = fo.slot + 1),
ru AS (SELECT fo.rec, fo.label, fr, any_value(fo.p) AS p, count(*) AS m, avg(agreement) AS agreement, avg(sal) AS sal, avg(err) AS err, arg_min(alternatives, fo.slot) AS alternatives FROM fo JOIN al2 ON al2.rec = fo.rec AND al2.label = fo.label AND al2.slot = fo.slot GROUP BY fo.rec, fo.label, fr),
rk AS (SELECT *, p = -1 AND m < 2 AS lift FROM ru),
no AS (SELECT *, m / 4.0::DOUBLE + CASE WHEN lead(lift) OVER w THEN 0.25 ELSE 0 END::DOUBLE AS dur FROM rk WINDOW w AS (PARTITION BY rec, label ORDER BY fr)),
nt AS (SELECT rec, label, row_number() OVER (PARTITION BY rec, label ORDER BY fr) - 1 AS seq, CASE WHEN p <> -1 THEN p END AS pitch, fr / 4.0::DOUBLE AS start, dur, agreement, CASE WHEN p = -1 THEN '' ELSE alternatives END AS alternatives,
  CASE WHEN p = -1 THEN agreement ELSE 0.3::DOUBLE * least(1.0::DOUBLE, sal) + 0.2::DOUBLE * least(1.0::DOUBLE, m / 2.0::DOUBLE) + 0.15::DOUBLE * greatest(0.0::DOUBLE, 1 - err / 0.25::DOUBLE) + 0.35::DOUBLE * agreement END AS conf FROM no WHERE NOT lift),
me AS (SELECT rec, label, count(*) FILTER (WHERE start < 4 AND start + dur > 4) AS four, count(*) FILTER (WHERE start < 2 AND start + dur > 2) AS two FROM nt GROUP BY ALL)"""

SQL = {
    "built_sections": _BUILT + " SELECT nt.rec, nt.label, seq, pitch, start, dur, round(conf, 6) AS conf, round(agreement, 6) AS agreement, alternatives, CASE WHEN start >= CASE WHEN two <= four THEN 2 ELSE 4 END THEN 2 ELSE 1 END AS measure FROM nt JOIN me ON me.rec = nt.rec AND me.label = nt.label",
    "section_reports": _BUILT + """, g AS (SELECT rec, label, any_value(reason) AS reason, count(*) AS passes, string_agg(CAST(block AS VARCHAR), ',' ORDER BY block) FILTER (WHERE used) AS used, coalesce(string_agg(CAST(block AS VARCHAR), ',' ORDER BY block) FILTER (WHERE NOT used AND reason <> 'single'), '') AS excluded FROM u GROUP BY ALL),
a AS (SELECT rec, label, avg(agreement) AS agreed FROM wp GROUP BY ALL), c AS (SELECT rec, label, avg(conf) AS conf FROM nt GROUP BY ALL)
SELECT g.rec, g.label, reason, passes, used, excluded, round(CASE WHEN reason = 'single' THEN 0.0 ELSE agreed END, 6) AS mean_agreement, round(conf, 6) AS conf FROM g JOIN a ON a.rec = g.rec AND a.label = g.label JOIN c ON c.rec = g.rec AND c.label = g.label""",
}
