"""Queries that arrange each recording for banjo, and SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arrangement as ar
from ..sources import notes
from .sql import _NOTES

#: Keys and meters that recordings take in turn.
KEYS = ("G major", "A mixolydian", "D major", "C major", "E minor", "B- major", "H major")


def _tunes(spark: SparkSession, d: str) -> DataFrame:
    recs = notes(spark, d).select("rec").distinct()
    key = F.get(F.array(*map(F.lit, KEYS)), (F.col("rec") % len(KEYS)).cast("int"))
    return recs.select("rec", key.alias("key"), F.when(F.col("rec") % 3 == 0, "3/4").otherwise("4/4").alias("meter"), F.when(F.col("rec") % 3 == 0, 3).otherwise(4).alias("beats_per_bar"))


def _part(spark: SparkSession, d: str) -> DataFrame:
    """Notes an eighth apart, put off by up to half a beat; every seventh pitch is a rest."""
    slots = F.when(F.col("rec") % 3 == 0, 6).otherwise(8)
    said = notes(spark, d).select("rec", "seq", F.floor(F.col("seq") / slots).alias("bar"), (F.col("seq") * 480 + F.col("pitch") % 5 * 120).alias("start_tick"), F.when(F.col("pitch") % 7 > 0, F.col("pitch")).alias("pitch"))
    return ar.arrange(said, _tunes(spark, d))


def banjo_part(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d)


def banjo_tab(spark: SparkSession, d: str) -> DataFrame:
    return ar.tablature(_part(spark, d), _tunes(spark, d))


ALL = (banjo_part, banjo_tab)

_PART = f"""WITH {_NOTES}, u AS (SELECT *, {list(KEYS)}[rec % 7 + 1] AS key, [7, 9, 2, 0, 4, 10, 7][rec % 7 + 1] AS root, [0, 2, 0, 5, 0, 3, 0][rec % 7 + 1] AS capo, CASE WHEN rec % 3 = 0 THEN 6 ELSE 8 END AS slots FROM n),
p AS (SELECT rec, seq, key, root, capo, slots, seq // slots AS bar, CASE WHEN pitch % 7 > 0 THEN pitch END AS pitch, CAST(round_even((seq * 480 + pitch % 5 * 120) / 480 - (seq // slots) * slots, 0) AS INTEGER) AS slot FROM u),
w AS (SELECT rec, sh, sum(CASE WHEN f <= 7 THEN 2 WHEN f IS NOT NULL THEN 1 ELSE 0 END) AS worth FROM (SELECT rec, sh, list_min(list_filter([pitch + sh - capo - o FOR o IN [50, 55, 59, 62]], lambda x: x BETWEEN 0 AND 12)) AS f FROM p, (SELECT unnest([-24, -12, 0, 12]) AS sh) WHERE pitch IS NOT NULL) GROUP BY ALL),
s AS (SELECT rec, arg_max(sh, worth * 100 - sh) AS sh FROM w GROUP BY rec),
h AS (SELECT rec, bar, root, capo, slots, any_value(key) AS key, count(*) FILTER (WHERE (pitch - root + 24) % 12 IN (0, 4, 7)) AS h0, count(*) FILTER (WHERE (pitch - root - 5 + 24) % 12 IN (0, 4, 7)) AS h5, count(*) FILTER (WHERE (pitch - root - 7 + 24) % 12 IN (0, 4, 7)) AS h7 FROM p GROUP BY ALL),
c AS (SELECT *, (root + CASE WHEN h0 >= h5 AND h0 >= h7 THEN 0 WHEN h5 >= h7 THEN 5 ELSE 7 END) % 12 AS chord FROM h),
t AS (SELECT rec, bar, slot, arg_min(pitch, seq) AS pitch FROM p WHERE pitch IS NOT NULL GROUP BY ALL),
es AS (SELECT c.*, CAST(g.slot AS INTEGER) AS slot, [[3,2,1,5,3,2,1,5],[1,2,3,5,1,2,3,5],[3,2,5,1,3,2,5,1],[4,2,3,1,4,2,3,1]][bar % 4 + 1][g.slot + 1] AS rolled FROM c, (SELECT unnest(range(8)) AS slot) g WHERE g.slot < slots),
m AS (SELECT es.*, t.pitch + coalesce(s.sh, 0) - es.capo AS want FROM es LEFT JOIN t ON t.rec = es.rec AND t.bar = es.bar AND t.slot = es.slot LEFT JOIN s ON s.rec = es.rec),
k AS (SELECT *, list_filter([want + 12 * o FOR o IN [-5, -4, -3, -2, -1, 0, 1, 2, 3, 4, 5]], lambda x: x BETWEEN 50 AND 74) AS fits FROM m),
v AS (SELECT *, CASE WHEN want < 50 THEN list_min(fits) ELSE list_max(CASE WHEN want BETWEEN 50 AND 74 THEN [want] ELSE fits END) END AS held FROM k),
b AS (SELECT *, CASE WHEN held IS NULL THEN rolled WHEN held >= 62 THEN 1 WHEN held >= 59 THEN 2 WHEN held >= 55 THEN 3 ELSE 4 END AS string FROM v),
q AS (SELECT *, [62, 59, 55, 50, 67][string] AS o FROM b),
part AS (SELECT rec, CAST(bar AS BIGINT) AS bar, slot, string, CAST(CASE WHEN held IS NOT NULL THEN held - o WHEN string = 5 THEN 0 ELSE coalesce(list_min([f FOR f IN range(6) IF (o + capo + f - chord + 24) % 12 IN (0, 4, 7)]), 0) END AS INTEGER) AS fret, o, capo, slots, key, held IS NOT NULL AS melody, ['M', 'I', 'T', 'T', 'T'][string] AS finger FROM q)"""

SQL = {
    "banjo_part": _PART + " SELECT rec, bar, slot, string, fret, o + capo + fret AS pitch, CAST((bar * slots + slot) * 480 AS BIGINT) AS start_tick, CAST(480 AS BIGINT) AS dur_tick, melody, finger FROM part",
    "banjo_tab": _PART + """, ce AS (SELECT rec, bar, capo, key, slots, string_agg(CASE WHEN string = 1 THEN rpad(fret::VARCHAR, 2, ' ') ELSE '--' END || '-', '' ORDER BY slot) || '|' AS s1, string_agg(CASE WHEN string = 2 THEN rpad(fret::VARCHAR, 2, ' ') ELSE '--' END || '-', '' ORDER BY slot) || '|' AS s2,
  string_agg(CASE WHEN string = 3 THEN rpad(fret::VARCHAR, 2, ' ') ELSE '--' END || '-', '' ORDER BY slot) || '|' AS s3, string_agg(CASE WHEN string = 4 THEN rpad(fret::VARCHAR, 2, ' ') ELSE '--' END || '-', '' ORDER BY slot) || '|' AS s4,
  string_agg(CASE WHEN string = 5 THEN rpad(fret::VARCHAR, 2, ' ') ELSE '--' END || '-', '' ORDER BY slot) || '|' AS s5, string_agg(CASE WHEN melody THEN finger ELSE lower(finger) END || '  ', '' ORDER BY slot) || ' ' AS s6 FROM part GROUP BY ALL),
bk AS (SELECT *, (row_number() OVER (PARTITION BY rec ORDER BY bar) - 1) // 4 AS block FROM ce),
li AS (SELECT rec, capo, key, slots, block, 'D|' || string_agg(s1, '' ORDER BY bar) || chr(10) || 'B|' || string_agg(s2, '' ORDER BY bar) || chr(10) || 'G|' || string_agg(s3, '' ORDER BY bar) || chr(10) || 'D|' || string_agg(s4, '' ORDER BY bar) || chr(10) || 'g|' || string_agg(s5, '' ORDER BY bar) || chr(10) || '  ' || string_agg(s6, '' ORDER BY bar) || chr(10) || chr(10) AS text FROM bk GROUP BY ALL)
SELECT rec, 'Banjo arrangement -- ' || key || ', ' || CASE WHEN slots = 6 THEN '3/4' ELSE '4/4' END || ', open-G tuning, capo ' || capo || chr(10) || chr(10) || string_agg(text, '' ORDER BY block) || 'uppercase finger = melody note, lowercase = roll filler' || chr(10) || 'T = thumb, I = index, M = middle' AS text FROM li GROUP BY rec, key, capo, slots""",
}
