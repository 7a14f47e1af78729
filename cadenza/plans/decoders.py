"""Queries over the decoders of a melodic line, and SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decoders as de
from ..sources import frames, table
from .sql import _FRAMES

FRAGMENT_HOP, CANDIDATE_HOP = 0.3, 0.1


def _fragments(spark: SparkSession, d: str) -> DataFrame:
    """Ten frames each, with silences between some; beside each a held pitch that begins three frames later."""
    ten = frames(spark, d).withColumn("g", F.floor(F.col("frame") / 10)).where("g % 5 <> 3")
    lists = ten.groupBy("rec", "g").agg(F.array_sort(F.collect_list(F.struct("frame", F.coalesce("midi", F.lit(60.0)).alias("midi"), "conf"))).alias("x"))
    moving = lists.select("rec", (F.col("g") * 2).alias("frag"), (F.col("g") * 10).alias("start"), F.transform("x", lambda x: x["midi"] % 9 + 66).alias("pitch"), F.transform("x", lambda x: x["conf"]).alias("salience"))
    held = lists.select("rec", (F.col("g") * 2 + 1).alias("frag"), (F.col("g") * 10 + 3).alias("start"), F.transform("x", lambda x: F.lit(69.0)).alias("pitch"), F.transform("x", lambda x: F.lit(0.9)).alias("salience"))
    return moving.unionByName(held)


def melody_of_fragments(spark: SparkSession, d: str) -> DataFrame:
    got = de.decode_fragments(_fragments(spark, d), FRAGMENT_HOP)
    return got.select("rec", "frame", F.round("midi", 9).alias("midi"), F.round("conf", 9).alias("conf"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).where("midi is not null")
    three = F.array(*(F.struct(F.lit(k).cast("long").alias("k"), m.alias("midi"), s.alias("salience")) for k, (m, s) in enumerate(((F.col("midi"), F.col("conf")), (F.lit(62.0), F.lit(0.8)), (F.col("midi") % 12 + 68.25, F.col("conf") * 0.9)))))
    return f.select("rec", "frame", F.explode(three).alias("c")).select("rec", "frame", "c.*")


def melody_of_candidates(spark: SparkSession, d: str) -> DataFrame:
    got = de.decode_candidates(_candidates(spark, d), CANDIDATE_HOP)
    return got.select("rec", "frame", F.round("midi", 9).alias("midi"), F.round("conf", 9).alias("conf"))


def movement_costs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", F.round(de.movement_cost(F.col("value") / 20 - 5), 9).alias("cost"))


ALL = (melody_of_fragments, melody_of_candidates, movement_costs)

_COST = "{c} * greatest(0.0::DOUBLE, ({x}) - 0.4::DOUBLE) + CASE WHEN abs(({x}) - 12) < 1 THEN 1.5 ELSE 0.0 END"
_MOVE = lambda x, c="1.4::DOUBLE": "(" + _COST.format(x=x, c=c) + ")"

SQL = {
    "movement_costs": f"SELECT event_id, round({_MOVE('abs(value / 20 - 5)')}, 9) AS cost FROM events",
    "melody_of_fragments": f"""WITH RECURSIVE {_FRAMES}, g AS (SELECT rec, frame // 10 AS g, list(coalesce(midi, 60) % 9 + 66 ORDER BY frame) AS p, list(conf ORDER BY frame) AS s FROM f WHERE (frame // 10) % 5 <> 3 GROUP BY ALL),
fr AS (SELECT rec, g * 2 AS frag, g * 10 AS st, p, s FROM g UNION ALL SELECT rec, g * 2 + 1, g * 10 + 3, [69.0::DOUBLE FOR x IN p], [0.9::DOUBLE FOR x IN p] FROM g),
m AS (SELECT *, st + len(p) AS en, list_aggregate(p, 'quantile_cont', 0.5) AS mid, CASE WHEN len(p) > 2 THEN list_aggregate(p, 'quantile_cont', 0.9) - list_aggregate(p, 'quantile_cont', 0.1) ELSE 0 END AS spread FROM fr),
l AS (SELECT rec, quantile_cont(mid, 0.1) AS lo, quantile_cont(mid, 0.9) AS hi FROM m GROUP BY rec),
w AS (SELECT m.*, len(p) * 0.3::DOUBLE * (list_avg(s) + 0.8::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, (mid - lo) / greatest(hi - lo, 1e-6)))) * CASE WHEN len(p) * 0.3::DOUBLE > 2.5 AND spread < 0.5 THEN 0.05::DOUBLE ELSE 1.0 END AS val FROM m JOIN l USING (rec)),
a AS (SELECT rec, list(frag ORDER BY st, frag) AS frag, list(st ORDER BY st, frag) AS st, list(en ORDER BY st, frag) AS en, list(mid ORDER BY st, frag) AS mid, list(val ORDER BY st, frag) AS val FROM w GROUP BY rec),
dp AS (SELECT rec, 1 AS i, [val[1]] AS best, [0] AS prev FROM a UNION ALL
  SELECT rec, i + 1, list_append(best, CASE WHEN list_max(c) > v THEN list_max(c) ELSE v END), list_append(prev, CASE WHEN list_max(c) > v THEN list_position(c, list_max(c))::INTEGER ELSE 0 END)
  FROM (SELECT dp.rec, i, best, prev, val[i + 1] AS v, [CASE WHEN st[i + 1] > st[j] AND (st[i + 1] - en[j]) * 0.3::DOUBLE <= 2.0 THEN best[j] - ({_COST.format(x="abs(mid[i + 1] - mid[j])", c="0.35::DOUBLE")} + 0.5::DOUBLE * greatest(0, st[i + 1] - en[j]) * 0.3::DOUBLE) + val[i + 1] ELSE -1e300::DOUBLE END FOR j IN range(1, i + 1)] AS c
    FROM dp JOIN a ON a.rec = dp.rec WHERE i < len(val)) AS steps),
e AS (SELECT dp.rec, best, prev FROM dp JOIN a ON a.rec = dp.rec WHERE i = len(val)),
top AS (SELECT rec, arg_min(i, (-b, fg)) AS i FROM (SELECT e.rec, unnest(range(1, len(best) + 1)) AS i, unnest(best) AS b, unnest(a.frag) AS fg FROM e JOIN a ON a.rec = e.rec) GROUP BY rec),
walk AS (SELECT rec, i, 0 AS k FROM top UNION ALL SELECT walk.rec, e.prev[walk.i], k + 1 FROM walk JOIN e ON e.rec = walk.rec WHERE e.prev[walk.i] > 0),
x AS (SELECT walk.rec, k, w.st + u - 1 AS frame, w.p[u] AS midi, w.s[u] AS conf FROM walk JOIN a ON a.rec = walk.rec JOIN w ON w.rec = walk.rec AND w.frag = a.frag[walk.i], range(1, 11) r(u) WHERE u <= len(w.p)),
o AS (SELECT rec, frame, arg_min(midi, k) AS midi, arg_min(conf, k) AS conf FROM x GROUP BY rec, frame)
SELECT rec, CAST(frame AS BIGINT) AS frame, round(midi, 9) AS midi, round(conf / max(conf) OVER (PARTITION BY rec), 9) AS conf FROM o""",
    "melody_of_candidates": f"""WITH RECURSIVE {_FRAMES}, c AS (SELECT rec, frame, unnest([0, 1, 2]) AS k, unnest([midi, 62.0::DOUBLE, midi % 12 + 68.25::DOUBLE]) AS midi, unnest([conf, 0.8::DOUBLE, conf * 0.9::DOUBLE]) AS sal FROM f WHERE midi IS NOT NULL),
h AS (SELECT rec, min(midi) AS lowest, quantile_cont(midi, 0.1) AS lo, quantile_cont(midi, 0.9) AS hi, quantile_cont(sal, 0.95) AS loud FROM c GROUP BY rec),
b AS (SELECT c.*, lo, hi, loud, CAST(floor((midi - lowest) / 0.5::DOUBLE) AS BIGINT) AS bin FROM c JOIN h USING (rec)),
k AS (SELECT DISTINCT rec, frame, bin + o AS bin FROM b, (VALUES (-1), (0), (1)) t(o)),
i AS (SELECT *, frame - row_number() OVER (PARTITION BY rec, bin ORDER BY frame) AS g FROM k),
p AS (SELECT rec, frame, bin, count(*) OVER (PARTITION BY rec, bin, g) * 0.1::DOUBLE AS held FROM i),
s AS (SELECT b.rec, b.frame, k, midi, sal, ln(1 + greatest(0, sal) / CASE WHEN loud = 0 THEN 1 ELSE loud END * 9) / ln(10.0::DOUBLE) + 0.8::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, (midi - lo) / greatest(hi - lo, 1e-6))) - 2.2::DOUBLE * least(2.0::DOUBLE, held / 2.5::DOUBLE) AS sc FROM b JOIN p ON p.rec = b.rec AND p.frame = b.frame AND p.bin = b.bin),
r AS (SELECT rec, frame, list(midi ORDER BY k) AS m, list(sal ORDER BY k) AS a, list(sc ORDER BY k) AS sc FROM s GROUP BY rec, frame),
u AS (SELECT *, frame - row_number() OVER (PARTITION BY rec ORDER BY frame) AS run FROM r),
v AS (SELECT rec, run, frame, m, sc AS best, [0, 0, 0] AS came FROM u WHERE (rec, frame - 1) NOT IN (SELECT (rec, frame) FROM u) UNION ALL
  SELECT rec, run, frame, m, [list_max(t[q]) + sc[q] FOR q IN [1, 2, 3]], [list_position(t[q], list_max(t[q]))::INTEGER FOR q IN [1, 2, 3]]
  FROM (SELECT u.rec, u.run, u.frame, u.m, u.sc, [[v.best[j] - {_MOVE("abs(u.m[q] - v.m[j])")} FOR j IN [1, 2, 3]] FOR q IN [1, 2, 3]] AS t FROM v JOIN u ON u.rec = v.rec AND u.frame = v.frame + 1) AS steps),
z AS (SELECT rec, run, max(frame) AS frame, arg_max(list_position(best, list_max(best))::INTEGER, frame) AS q FROM v GROUP BY rec, run),
y AS (SELECT rec, frame, q FROM z UNION ALL SELECT y.rec, y.frame - 1, v.came[y.q] FROM y JOIN v ON v.rec = y.rec AND v.frame = y.frame WHERE v.came[y.q] > 0),
o AS (SELECT y.rec, y.frame, u.m[q] AS midi, u.a[q] AS conf FROM y JOIN u ON u.rec = y.rec AND u.frame = y.frame),
n AS (SELECT rec, quantile_cont(conf, 0.5) FILTER (WHERE conf > 0) AS usual, max(conf) AS peak FROM o GROUP BY rec)
SELECT o.rec, CAST(o.frame AS BIGINT) AS frame, round(midi, 9) AS midi, round(conf / CASE WHEN peak > 0 THEN peak ELSE 1 END, 9) AS conf FROM o JOIN n USING (rec) WHERE usual IS NULL OR conf >= 0.35::DOUBLE * usual""",
}
