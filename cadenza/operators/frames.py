"""Pitch frames (rec, frame, t, midi, conf): gates, filters, runs and note features. Unvoiced is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _by_frame():
    return Window.partitionBy("rec").orderBy("frame")


def _run_id(flag: Column) -> Column:
    """A number that stays the same through a run of one value of flag."""
    return F.row_number().over(_by_frame()) - F.row_number().over(Window.partitionBy("rec", flag).orderBy("frame"))


def voiced_runs(frames: DataFrame) -> DataFrame:
    """Maximal runs of voiced frames: rec, run_start, run_end (exclusive), n."""
    flagged = frames.withColumn("v", F.col("midi").isNotNull()).withColumn("g", _run_id(F.col("v")))
    return flagged.where("v").groupBy("rec", "g").agg(F.min("frame").alias("run_start"), (F.max("frame") + 1).alias("run_end"), F.count("*").alias("n")).drop("g")


def gate(frames: DataFrame, least_conf: float = 0.05, low: float = 54, high: float = 101) -> DataFrame:
    """Frames of low confidence or out of range become unvoiced."""
    return frames.withColumn("midi", F.when((F.col("conf") >= least_conf) & F.col("midi").between(low, high), F.col("midi")))


def normalize_confidence(frames: DataFrame) -> DataFrame:
    """conf over the 95th percentile of the recording's positive ones, in 0 to 1; 0 if that is tiny."""
    top = F.percentile(F.when(F.col("conf") > 0, F.col("conf")), F.lit(0.95)).over(Window.partitionBy("rec"))
    return frames.withColumn("top", top).withColumn("conf", F.when(F.col("top") > 1e-9, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("conf") / F.col("top")))).otherwise(0.0)).drop("top")


def jump_gate(frames: DataFrame, jump: float = 6.0, gap: int = 3) -> DataFrame:
    """Drops the middle of three voiced frames that leaps away and back. A dropped frame can't make its successor drop, so of neighbouring candidates the 1st, 3rd, ... go."""
    a, c = F.lag("midi").over(_by_frame()), F.lead("midi").over(_by_frame())
    near = (F.col("frame") - F.lag("frame").over(_by_frame()) <= gap) & (F.lead("frame").over(_by_frame()) - F.col("frame") <= gap)
    leap = (F.abs(F.col("midi") - a) > jump) & (F.abs(c - F.col("midi")) > jump) & (F.abs(c - a) < 0.5 * F.abs(F.col("midi") - a))
    voiced = frames.where("midi is not null").withColumn("x", F.coalesce(near & leap, F.lit(False)))
    voiced = voiced.withColumn("g", _run_id(F.col("x")))
    place = F.row_number().over(Window.partitionBy("rec", "x", "g").orderBy("frame"))
    gone = voiced.withColumn("place", place).where("x and place % 2 = 1").select("rec", "frame")
    marked = frames.join(gone.withColumn("gone", F.lit(True)), ["rec", "frame"], "left")
    return marked.withColumn("midi", F.when(F.col("gone").isNull(), F.col("midi"))).drop("gone")


def rolling_median(frames: DataFrame, half: int, name: str = "median") -> DataFrame:
    """Median of midi over 2 * half + 1 frames, nulls left out; beyond the ends the end value counts as often as frames are missing."""
    around = _by_frame().rowsBetween(-half, half)
    whole = Window.partitionBy("rec")
    held = frames.withColumns({"_lo": F.min("frame").over(whole), "_hi": F.max("frame").over(whole)})
    copies = F.sequence(F.when(F.col("frame") == F.col("_lo"), -half).otherwise(0), F.when(F.col("frame") == F.col("_hi"), half).otherwise(0))
    padded = held.withColumn("_o", F.explode(copies)).withColumn("frame", F.col("frame") + F.col("_o"))
    return padded.withColumn(name, F.percentile("midi", F.lit(0.5)).over(around)).where("_o = 0").drop("_o", "_lo", "_hi")


def octave_correction(frames: DataFrame, half: int = 30, near: float = 1.5, passes: int = 2) -> DataFrame:
    """Frames an octave off their surroundings' median move by it, at 0.85 of their confidence."""
    for _ in range(passes):
        d = F.col("midi") - F.col("_m")
        down, up = F.abs(d - 12) < near, F.abs(d + 12) < near
        frames = rolling_median(frames, half, "_m").withColumn("_s", F.when(down, -12.0).when(up, 12.0).otherwise(0.0))
        frames = frames.withColumns({"midi": F.col("midi") + F.col("_s"), "conf": F.when(F.col("_s") != 0, F.col("conf") * 0.85).otherwise(F.col("conf"))}).drop("_m", "_s")
    return frames


def fill_gaps(frames: DataFrame, longest: int = 5, near: float = 1.0) -> DataFrame:
    """Unvoiced runs of up to `longest` frames between pitches at most `near` apart get evenly spaced pitches from one to the other, both ends included, at 0.8 of the lower confidence."""
    flagged = frames.withColumn("v", F.col("midi").isNotNull()).withColumn("g", _run_id(F.col("v")))
    run = Window.partitionBy("rec", "v", "g")
    back, ahead = _by_frame().rowsBetween(Window.unboundedPreceding, -1), _by_frame().rowsBetween(1, Window.unboundedFollowing)
    seen = lambda c: F.when(F.col("v"), F.col(c))
    got = flagged.withColumns({"n": F.count("*").over(run), "i": F.row_number().over(run.orderBy("frame")) - 1, "l": F.last(seen("midi"), True).over(back), "r": F.first(seen("midi"), True).over(ahead), "lc": F.last(seen("conf"), True).over(back), "rc": F.first(seen("conf"), True).over(ahead)})
    fills = ~F.col("v") & (F.col("n") <= longest) & (F.abs(F.col("r") - F.col("l")) <= near)
    step = F.when(F.col("n") > 1, (F.col("r") - F.col("l")) / (F.col("n") - 1)).otherwise(0.0)
    return got.select("rec", "frame", "t", F.when(fills, F.col("l") + F.col("i") * step).otherwise(F.col("midi")).alias("midi"), F.when(fills, 0.8 * F.least("lc", "rc")).otherwise(F.col("conf")).alias("conf"))


def note_features(frames: DataFrame) -> DataFrame:
    """One note for each voiced run: median pitch without the first 12 % of frames if three remain, 90th percentile of its deviation in cents, mean confidence."""
    flagged = frames.withColumn("v", F.col("midi").isNotNull()).withColumn("g", _run_id(F.col("v"))).where("v")
    run = Window.partitionBy("rec", "g")
    placed = flagged.withColumns({"n": F.count("*").over(run), "i": F.row_number().over(run.orderBy("frame")) - 1}).withColumn("skip", F.floor(F.col("n") * 0.12))
    core = placed.withColumn("core", F.when((F.col("n") - F.col("skip") < 3) | (F.col("i") >= F.col("skip")), F.col("midi")))
    core = core.withColumn("pitch", F.percentile("core", F.lit(0.5)).over(run))
    return core.groupBy("rec", "g").agg(F.min("frame").alias("run_start"), (F.max("frame") + 1).alias("run_end"), F.first("pitch").alias("pitch"), (100 * F.percentile(F.abs(F.col("core") - F.col("pitch")), F.lit(0.9))).alias("spread_cents"), F.avg("conf").alias("conf")).drop("g")


def presence(frames: DataFrame) -> DataFrame:
    """Per recording: modal rounded pitch (lowest of ties), its share, interquartile range and voiced fraction."""
    counts = frames.where("midi is not null").groupBy("rec", F.rint("midi").cast("int").alias("p")).agg(F.count("*").alias("n"))
    modal = counts.groupBy("rec").agg(F.max_by("p", F.struct("n", -F.col("p"))).alias("modal_pitch"), (F.max("n") / F.sum("n")).alias("modal_share"))
    whole = frames.groupBy("rec").agg((F.percentile("midi", F.lit(0.75)) - F.percentile("midi", F.lit(0.25))).alias("iqr"), F.avg(F.col("midi").isNotNull().cast("int")).alias("voiced_fraction"))
    return whole.join(modal, "rec", "left")


def lag_similarity(frames: DataFrame, lags: range, tolerance: float = 0.6, least: int = 50) -> DataFrame:
    """For each lag, the share of frames voiced at both ends that agree in pitch or by an octave; lags with fewer than `least` such frames are left out."""
    array = frames.groupBy("rec").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "midi"))), lambda x: x["midi"]).alias("m"))
    each = array.select("rec", "m", F.explode(F.sequence(F.lit(lags.start), F.lit(lags.stop - 1), F.lit(lags.step))).alias("lag")).where(F.size("m") > F.col("lag"))
    pairs = F.zip_with(F.slice("m", F.lit(1), F.size("m") - F.col("lag")), F.slice("m", F.col("lag") + 1, F.size("m") - F.col("lag")), lambda a, b: F.abs(a - b))
    both = F.filter(pairs, lambda d: d.isNotNull())
    agree = F.filter("d", lambda d: (d < tolerance) | (F.abs(d - 12) < tolerance))
    return each.select("rec", "lag", both.alias("d")).where(F.size("d") >= least).select("rec", "lag", (F.size(agree) / F.size("d")).alias("similarity"))


def repetition(similarities: DataFrame) -> DataFrame:
    """The best lag of each recording (the shortest of ties), and how far it is above the median of all lags."""
    best = F.max_by("lag", F.struct("similarity", -F.col("lag")))
    return similarities.groupBy("rec").agg(best.alias("lag"), F.max("similarity").alias("similarity"), F.percentile("similarity", F.lit(0.5)).alias("baseline")).withColumn("excess", F.col("similarity") - F.col("baseline"))
