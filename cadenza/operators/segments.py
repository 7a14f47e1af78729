"""Notes cut at onsets, joined again over dropouts, and short intruders given back to the line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a bucket in which onsets and spans meet.
BUCKET = 1.0


def least_length(beat_seconds: float | None = None, seconds: float = 0.10, beats: float = 0.45) -> float:
    """The shortest part, in seconds, that an onset may cut off: a share of a beat where the tempo is known."""
    return max(seconds, beats * beat_seconds) if beat_seconds else seconds


def cut_at_onsets(spans: DataFrame, onsets: DataFrame, hop: float, least: float) -> DataFrame:
    """spans(rec, run_start, run_end exclusive) cut at onsets(rec, t): rec, run_start, note_start, note_end.

    An onset counts if it is more than `least` seconds inside a span of at least two such parts, and cuts at the next
    frame if that leaves such a part before it, since the last cut, and behind it. Spans and onsets meet by bucket of
    time, so the join is an equal one; spans of a recording don't overlap. Onsets at null and repeated ones change nothing.
    """
    m = max(1, int(least / hop))
    bucket = lambda t: F.floor(t / BUCKET).cast("long")
    begins, ends = F.col("run_start") * hop, F.col("run_end") * hop
    wide = spans.where(F.col("run_end") - F.col("run_start") >= 2 * m).select("rec", "run_start", "run_end", F.explode(F.sequence(bucket(begins), bucket(ends))).alias("bucket"))
    inside = wide.join(onsets.select("rec", "t", bucket(F.col("t")).alias("bucket")), ["rec", "bucket"]).where((F.col("t") > begins + least) & (F.col("t") < ends - least))
    seen = inside.groupBy("rec", "run_start").agg(F.array_sort(F.collect_set(F.ceil(F.col("t") / hop).cast("long"))).alias("at"))
    met = spans.select("rec", F.col("run_start").cast("long").alias("run_start"), F.col("run_end").cast("long").alias("run_end")).join(seen, ["rec", "run_start"], "left")
    none = F.array().cast("array<long>")
    cuts = F.aggregate(F.coalesce("at", none), F.array("run_start"), lambda a, x: F.when((x - F.element_at(a, -1) >= m) & (F.col("run_end") - x >= m), F.concat(a, F.array(x))).otherwise(a))
    parts = F.arrays_zip(cuts.alias("note_start"), F.concat(F.slice(cuts, F.lit(2), F.size(cuts)), F.array("run_end")).alias("note_end"))
    return met.select("rec", "run_start", F.explode(parts).alias("p")).select("rec", "run_start", F.col("p.note_start").alias("note_start"), F.col("p.note_end").alias("note_end"))


def join_dropouts(notes: DataFrame, longest: float = 0.03) -> DataFrame:
    """notes(rec, start, end, pitch, conf, spread, voiced), with neighbours joined that round to one pitch and have a gap of at most `longest` seconds between them; notes without a gap stay apart.

    pitch, conf and voiced are weighted by length, spread is the larger one. A joined pitch may round anew before it meets
    the next note, so stretches of short gaps are folded in order; a longer gap ends a stretch.
    """
    by = Window.partitionBy("rec").orderBy("start", "end", "pitch")
    gap = F.col("start") - F.lag("end").over(by)
    near = F.coalesce((gap > 0) & (gap <= longest), F.lit(False))
    held = notes.withColumn("stretch", F.sum(F.when(near, 0).otherwise(1)).over(by))
    row = ("start", "end", "pitch", "conf", "spread", "voiced")
    stretch = held.groupBy("rec", "stretch").agg(F.array_sort(F.collect_list(F.struct("start", "end", "pitch", *(F.col(c).cast("double").alias(c) for c in row[3:])))).alias("x"))

    def fold(a, n):
        last = F.element_at(a, -1)
        w0, w1 = last["end"] - last["start"], n["end"] - n["start"]
        mean = lambda c: ((last[c] * w0 + n[c] * w1) / (w0 + w1)).alias(c)
        both = F.struct(last["start"].alias("start"), n["end"].alias("end"), mean("pitch"), mean("conf"), F.greatest(last["spread"], n["spread"]).alias("spread"), mean("voiced"))
        return F.when(F.rint(last["pitch"]) == F.rint(n["pitch"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(both))).otherwise(F.concat(a, F.array(n)))

    joined = F.aggregate(F.slice("x", F.lit(2), F.size("x")), F.slice("x", 1, 1), fold)
    return stretch.select("rec", F.explode(joined).alias("n")).select("rec", *(F.col(f"n.{c}").alias(c) for c in row))


def absorb_intruders(notes: DataFrame, ratio: float, around: int = 8) -> DataFrame:
    """notes(rec, seq, pitch, dur) without those far shorter than their neighbours, whose time goes to the note before.

    A note is short if it is below `ratio` times the median of the `around` notes about it, itself left out. A short note
    of the pitch that the line has stays; so the line's pitch is that of the last note which isn't short, or of the
    first. Recordings of fewer than three notes stay as they are.
    """
    by, half = Window.partitionBy("rec").orderBy("seq"), max(1, around // 2)
    near = F.array_sort(F.concat(F.collect_list("dur").over(by.rowsBetween(-half, -1)), F.collect_list("dur").over(by.rowsBetween(1, half))))
    middle = lambda a: (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2
    placed = notes.select("rec", "seq", "pitch", "dur", near.alias("near"), F.row_number().over(by).alias("nth"), F.count("*").over(Window.partitionBy("rec")).alias("n"))
    short = (F.col("nth") > 1) & (F.col("n") >= 3) & (F.col("dur") < ratio * middle(F.col("near")))
    placed = placed.withColumn("short", F.coalesce(short, F.lit(False)))
    line = F.last(F.when(~F.col("short"), F.col("pitch")), True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    kept = placed.withColumn("gone", F.coalesce(F.col("short") & (F.col("pitch") != line), F.lit(False)))
    grouped = kept.withColumn("g", F.sum(F.when(F.col("gone"), 0).otherwise(1)).over(by))
    return grouped.groupBy("rec", "g").agg(F.min("seq").alias("seq"), F.min_by("pitch", "seq").alias("pitch"), F.sum("dur").alias("dur")).drop("g")
