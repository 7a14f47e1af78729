"""Queries that score two configurations in one job and show them side by side, and SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports as re
from ..operators import scoring as sc
from ..storage import stash
from . import scoring

#: The confidence a note must have to be kept.
CONFIGURATIONS = {"every note": {"least": 0.0}, "confident": {"least": 0.3}}


def _scores(spark: SparkSession, d: str) -> DataFrame:
    by = ("config", "rec")
    each = re.with_configurations(scoring.pairs(spark, d), CONFIGURATIONS)
    kept = each.withColumn("pred", F.filter("pred", lambda x: x["conf"] >= F.col("least")))
    facts = re.with_configurations(scoring.tunes(spark, d), CONFIGURATIONS)
    return stash(sc.transcription_score(sc.align_notes(kept), facts, by))


def config_comparison(spark: SparkSession, d: str) -> DataFrame:
    got = re.comparison(_scores(spark, d), list(CONFIGURATIONS))
    return got.select("metric", *(F.round(F.col(f"`{c}`"), 9).alias(c.replace(" ", "_")) for c in CONFIGURATIONS))


def config_table(spark: SparkSession, d: str) -> DataFrame:
    return re.comparison_table(_scores(spark, d), list(CONFIGURATIONS))


def score_table(spark: SparkSession, d: str) -> DataFrame:
    named = _scores(spark, d).withColumns({"title": F.concat(F.lit("tune "), F.col("rec").cast("string")), "difficulty": F.when(F.col("rec") % 2 == 0, "jam").otherwise("clean")})
    return re.score_table(named)


ALL = (config_comparison, config_table, score_table)

_KEPT = "[x.{0}[i] FOR i IN range(1, len(x.c) + 1) IF x.c[i] >= least]"
_PAIRS = f""", cf AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE), (1, 0.3::DOUBLE)) AS v(cfg, least)),
pr AS (SELECT y.rec * 2 + cfg AS rec, y.block, {", ".join(_KEPT.format(a) + f" AS p{a}" for a in "ptdc")}, y.p AS tp, y.t AS tt, y.d AS td FROM cf, bl x JOIN bl y ON y.rec = x.rec AND y.block = x.block + 1),"""
_SCORES = scoring.BLOCKS + _PAIRS + scoring.MATCHED + scoring.SCORED + f""", sx AS (SELECT r.rec % 2 AS cfg, CASE WHEN r.rec % 2 = 0 THEN 'every note' ELSE 'confident' END AS config, r.rec // 2 AS o, {", ".join(f"r.{c}" for c in sc.ACCURACIES)}, greatest(0, pitch_class - pitch) AS octave_errors,
  o % 3 <> 0 AND o % 2 <> 0 OR o % 6 = 0 AS kr, o % 4 <> 0 AS fr, abs(o + 100.0::DOUBLE - 110) / 110 * 100 AS tempo_error, CASE WHEN ca.rec IS NOT NULL THEN coalesce(au.auc, 0.5) END AS auc, flag_precision, flag_recall, n_wrong, n_flagged FROM r LEFT JOIN ca ON ca.rec = r.rec LEFT JOIN au ON au.rec = r.rec),
me AS (SELECT cfg, config, {", ".join(f"avg({c}) AS {c}" for c in (*sc.ACCURACIES, "octave_errors"))}, avg(kr::INTEGER) AS key_right, avg(fr::INTEGER) AS form_right, avg(auc) AS auc, avg(tempo_error) AS tempo_error, avg(flag_precision) AS flag_precision, avg(flag_recall) AS flag_recall, avg(n_wrong) AS n_wrong, avg(n_flagged) AS n_flagged FROM sx GROUP BY ALL),
lo AS ({" UNION ALL ".join(f"SELECT {i} AS place, cfg, '{m}' AS metric, {m} AS value FROM me" for i, m in enumerate(re.COMPARED))}),
wi AS (SELECT place, metric, max(value) FILTER (WHERE cfg = 0) AS a, max(value) FILTER (WHERE cfg = 1) AS b FROM lo GROUP BY ALL)"""
_fixed = lambda x, digits, width: f"lpad(coalesce({x}::DOUBLE::DECIMAL(18,9)::DECIMAL(18,{digits})::VARCHAR, '-'), {width}, ' ')"
_free = lambda x, digits: f"({x}::DOUBLE::DECIMAL(18,9)::DECIMAL(18,{digits})::VARCHAR)"
_five = " || ".join(_fixed(c, 2, 7) for c in sc.ACCURACIES)

SQL = {
    "config_comparison": _SCORES + " SELECT metric, round(a, 9) AS every_note, round(b, 9) AS confident FROM wi",
    "config_table": _SCORES + f""" SELECT 0 AS line, rpad('metric', 24, ' ') || lpad('every note', 16, ' ') || lpad('confident', 16, ' ') AS text UNION ALL SELECT 1, repeat('-', 56) UNION ALL SELECT place + 2, rpad(metric, 24, ' ') || {_fixed("a", 3, 16)} || {_fixed("b", 3, 16)} FROM wi""",
    "score_table": _SCORES + f""" SELECT config, 2 AS part, o AS rec, rpad('tune ' || o, 22, ' ') || rpad(CASE WHEN o % 2 = 0 THEN 'jam' ELSE 'clean' END, 7, ' ') || {_five} || lpad(CASE WHEN kr THEN 'Y' ELSE 'n' END, 5, ' ') || lpad(CASE WHEN fr THEN 'Y' ELSE 'n' END, 6, ' ') || {_fixed("tempo_error", 1, 8)} AS text FROM sx
UNION ALL SELECT config, 0, NULL, 'tune                  diff     pitch pclass  onset    dur    seq  key  form  tempo%' FROM me UNION ALL SELECT config, p, NULL, repeat('-', 89) FROM me, (SELECT unnest([1, 3]) AS p)
UNION ALL SELECT config, 4, NULL, rpad('MEAN', 29, ' ') || {_five} || {_fixed("key_right", 2, 5)} || {_fixed("form_right", 2, 6)} || {_fixed("tempo_error", 1, 8)} FROM me
UNION ALL SELECT config, 5, NULL, 'confidence: AUC ' || {_free("auc", 3)} || '  flag precision ' || {_free("flag_precision", 2)} || '  flag recall ' || {_free("flag_recall", 2)} || '  (' || {_free("n_flagged", 1)} || ' flagged / ' || {_free("n_wrong", 1)} || ' wrong per tune)' FROM me WHERE auc IS NOT NULL
UNION ALL SELECT config, 6, NULL, 'octave-error rate: ' || {_free("octave_errors", 3)} FROM me""",
}
