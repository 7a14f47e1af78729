"""Queries that write tunes as notation and read them back as they sound, and SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import notation
from .sql import _NOTES
from .tunes import tune_texts


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return tune_texts(spark, d).select(F.lit("events").alias("source"), F.col("rec").alias("tune"), "text")


def sounding_notes(spark: SparkSession, d: str) -> DataFrame:
    """Pitches as a reader hears them: a sign holds to the end of the bar, also where the writer meant another note."""
    got = notation.sounding_notes(_texts(spark, d))
    return got.select(F.col("tune").alias("rec"), "name", F.col("seq").cast("long").alias("seq"), "bar", "pitch", "start_tick", "dur_tick", "measure")


def catalog_tunes(spark: SparkSession, d: str) -> DataFrame:
    bars = F.array_join(F.transform("sections", lambda x: F.concat_ws(":", x["name"], F.coalesce(x["bars"].cast("string"), F.lit("?")))), ",")
    return notation.catalog(_texts(spark, d)).select(F.col("tune").alias("rec"), "title", "key", "meter", bars.alias("sections"), "reason")


ALL = (sounding_notes, catalog_tunes)

_SOUND = f"""WITH {_NOTES}, x AS (SELECT rec, seq, pitch AS midi, 480 * (1 + pitch % 3) AS ticks, seq // 4 AS measure, CASE WHEN seq < 16 THEN 'A' ELSE 'B' END AS name, ['C','^C','D','^D','E','F','^F','G','^G','A','^A','B'][pitch % 12 + 1] AS sp FROM n),
y AS (SELECT *, right(sp, 1) IN ('F', 'C') AS keyed, midi - length(sp) + 1 AS nat FROM x),
z AS (SELECT *, CASE WHEN midi % 7 = 0 THEN NULL WHEN length(sp) = 2 AND NOT keyed THEN 1 WHEN length(sp) = 1 AND keyed THEN 0 END AS sign FROM y),
s AS (SELECT *, last_value(CASE WHEN midi % 7 > 0 THEN sign END IGNORE NULLS) OVER (PARTITION BY rec, name, measure, CASE WHEN midi % 7 > 0 THEN nat END ORDER BY seq) AS held FROM z),
o AS (SELECT rec, name, row_number() OVER w - 1 AS seq, CAST(measure - min(measure) OVER (PARTITION BY rec, name) + 1 AS INTEGER) AS bar, CAST(CASE WHEN midi % 7 > 0 THEN nat + coalesce(held, CASE WHEN keyed THEN 1 ELSE 0 END) END AS INTEGER) AS pitch,
  CAST(coalesce(sum(ticks) OVER (PARTITION BY rec, name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_tick, CAST(ticks AS BIGINT) AS dur_tick FROM s WINDOW w AS (PARTITION BY rec, name ORDER BY seq))"""

SQL = {
    "sounding_notes": _SOUND + " SELECT *, CAST(start_tick // 3840 + 1 AS INTEGER) AS measure FROM o",
    "catalog_tunes": _SOUND + """, t AS (SELECT rec, name, sum(dur_tick) AS ticks, count(pitch) AS sounds FROM o GROUP BY ALL)
SELECT rec, 'tune ' || rec AS title, 'D major' AS key, '4/4' AS meter, string_agg(name || ':' || CASE WHEN ticks % 3840 = 0 THEN CAST(ticks // 3840 AS BIGINT)::VARCHAR ELSE '?' END, ',' ORDER BY name) AS sections,
  CASE WHEN sum(sounds) = 0 THEN 'empty' WHEN count(*) FILTER (WHERE ticks % 3840 <> 0) > 0 THEN 'bars' END AS reason FROM t GROUP BY rec""",
}
