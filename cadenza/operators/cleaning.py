"""Frames inside voiced runs, on other grids, and of several voices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import _run_id

#: The open strings, as MIDI numbers.
OPEN_STRINGS = (55, 62, 69, 76)


def _smoothed(frames: DataFrame, half: int, stat) -> DataFrame:
    """Adds _s: stat of midi over 2 * half + 1 frames of the same voiced run, whose end values repeat beyond its ends; null in shorter runs."""
    run = Window.partitionBy("rec", "_v", "_g")
    flagged = frames.withColumn("_v", F.col("midi").isNotNull()).withColumn("_g", _run_id(F.col("_v")))
    placed = flagged.withColumns({"_n": F.count("*").over(run), "_i": F.row_number().over(run.orderBy("frame"))})
    wide = F.col("_v") & (F.col("_n") >= 2 * half + 1)
    copies = F.sequence(F.when(wide & (F.col("_i") == 1), -half).otherwise(0), F.when(wide & (F.col("_i") == F.col("_n")), half).otherwise(0))
    padded = placed.withColumn("_o", F.explode(copies)).withColumn("frame", F.col("frame") + F.col("_o"))
    got = padded.withColumn("_s", F.when(wide, stat(F.col("midi")).over(run.orderBy("frame").rowsBetween(-half, half)))).where("_o = 0")
    return got.drop("_v", "_g", "_n", "_i", "_o")


def median_in_runs(frames: DataFrame, half: int = 2) -> DataFrame:
    """The median of 2 * half + 1 frames replaces each pitch of a voiced run at least that long."""
    return _smoothed(frames, half, lambda m: F.percentile(m, F.lit(0.5))).withColumn("midi", F.coalesce("_s", "midi")).drop("_s")


def flatten_vibrato(frames: DataFrame, half: int = 9, depth: float = 0.9) -> DataFrame:
    """The mean of 2 * half + 1 frames replaces pitches less than `depth` away from it, in voiced runs at least that long."""
    near = F.abs(F.col("midi") - F.col("_s")) < depth
    return _smoothed(frames, half, F.avg).withColumn("midi", F.when(near, F.col("_s")).otherwise(F.col("midi"))).drop("_s")


def drop_drones(frames: DataFrame, tolerance: float = 0.35, least: int = 35, around: int = 100, away: float = 2.0) -> DataFrame:
    """Stretches of `least` frames near one open string become unvoiced if the median of `around` frames on both sides, five voiced at least, is over `away` semitones off.

    Each stretch looks up its surroundings by frame number: 2 * around rows, however long the recording is.
    """
    voiced = frames.where("midi is not null").withColumn("string", F.explode(F.array(*map(F.lit, OPEN_STRINGS)))).where(F.abs(F.col("midi") - F.col("string")) < tolerance)
    by = Window.partitionBy("rec", "string").orderBy("frame")
    stretches = voiced.withColumn("g", F.col("frame") - F.row_number().over(by)).groupBy("rec", "string", "g").agg(F.min("frame").alias("s"), (F.max("frame") + 1).alias("e")).where(F.col("e") - F.col("s") >= least)
    sides = F.concat(F.sequence(F.col("s") - around, F.col("s") - 1), F.sequence(F.col("e"), F.col("e") + around - 1))
    near = stretches.select("rec", "string", "s", "e", F.explode(sides).alias("frame")).join(frames.where("midi is not null").select("rec", "frame", "midi"), ["rec", "frame"])
    judged = near.groupBy("rec", "string", "s", "e").agg(F.count("*").alias("n"), F.percentile("midi", F.lit(0.5)).alias("m")).where((F.col("n") >= 5) & (F.abs(F.col("m") - F.col("string")) > away))
    gone = judged.select("rec", F.explode(F.sequence("s", F.col("e") - 1)).alias("frame")).distinct().withColumn("gone", F.lit(True))
    return frames.join(gone, ["rec", "frame"], "left").withColumn("midi", F.when(F.col("gone").isNull(), F.col("midi"))).drop("gone")


def cells(frames: DataFrame, position: Column, per: float) -> DataFrame:
    """Median pitch of each cell of a grid with `per` cells to a unit of position (seconds or beats): rec, cell (absolute), midi."""
    return frames.groupBy("rec", F.floor(position * per).alias("cell")).agg(F.percentile("midi", F.lit(0.5)).alias("midi"))


def loudest(events: DataFrame, hop: float, floor: int = 64) -> DataFrame:
    """events(rec, seq, start, end, pitch, amp) as frames: at each the loudest note of `floor` or higher that sounds, the first of ties."""
    first = F.floor(F.col("start") / hop).cast("long")
    last = F.greatest(first, F.ceil(F.col("end") / hop).cast("long") - 1)
    heard = events.where(F.col("pitch") >= floor).withColumn("frame", F.explode(F.sequence(first, last)))
    return heard.groupBy("rec", "frame").agg(F.max_by("pitch", F.struct("amp", -F.col("seq"))).cast("double").alias("midi"), F.max("amp").alias("conf"))


def bass_coupling(melody: DataFrame, bass: DataFrame, least: int = 500, tolerance: float = 0.6) -> DataFrame:
    """The share of frames voiced in both whose interval is within `tolerance` of the commonest rounded one (the lowest of ties); null with fewer than `least` such frames."""
    both = melody.where("midi is not null").select("rec", "frame", "midi").join(bass.where("midi is not null").select("rec", "frame", F.col("midi").alias("low")), ["rec", "frame"])
    counts = both.groupBy("rec", (F.col("midi") - F.col("low")).alias("d")).agg(F.count("*").alias("n")).withColumn("r", F.rint("d"))
    modes = counts.groupBy("rec", "r").agg(F.sum("n").alias("n")).groupBy("rec").agg(F.max_by("r", F.struct("n", -F.col("r"))).alias("mode"), F.sum("n").alias("frames"))
    share = F.sum(F.when(F.abs(F.col("d") - F.col("mode")) < tolerance, F.col("n")).otherwise(0)) / F.first("frames")
    return counts.join(modes, "rec").groupBy("rec").agg(F.when(F.first("frames") >= least, share).alias("coupling"), F.first("frames").alias("frames"))


def persistence(pitches: DataFrame, hop: float, width: float = 0.5, bins: Column | None = None) -> DataFrame:
    """pitches(rec, frame, midi), several to a frame: for how long, in seconds, frames on both sides have a pitch in the same bin or a neighbouring one. Bins are `width` semitones about its multiples, or as the column bins says."""
    binned = pitches.withColumn("bin", (F.rint(F.col("midi") / width) if bins is None else bins).cast("long"))
    marked = binned.select("rec", "frame", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin")).distinct()
    islands = marked.withColumn("g", F.col("frame") - F.row_number().over(Window.partitionBy("rec", "bin").orderBy("frame")))
    held = islands.withColumn("held", F.count("*").over(Window.partitionBy("rec", "bin", "g")) * F.lit(hop)).select("rec", "frame", "bin", "held")
    return binned.join(held, ["rec", "frame", "bin"]).select("rec", "frame", "midi", "held")


def meter(strengths: DataFrame, phases: DataFrame, same: float = 0.985, least: int = 8) -> DataFrame:
    """strengths(rec, beat_idx, strength) and the best phase of four of each rec: 2/4 if the third beat is about as strong as the first, else 4/4; the default with fewer than `least` beats."""
    place = F.pmod(F.col("beat_idx") - F.col("phase"), F.lit(4))
    mean = lambda k: F.coalesce(F.avg(F.when(place == k, F.col("strength"))), F.lit(0.0))
    by = strengths.join(phases.select("rec", "phase"), "rec").groupBy("rec", "phase").agg(F.count("*").alias("n"), mean(0).alias("one"), mean(2).alias("three"))
    ratio = F.when(F.col("one") > 1e-9, F.col("three") / F.col("one")).otherwise(1.0)
    enough, two = F.col("n") >= least, F.col("ratio") > same
    bar = F.when(enough & two, 2).otherwise(4)
    sure = F.when(enough, F.least(F.lit(0.75), F.abs(F.col("ratio") - same) * 3.0 + 0.25)).otherwise(0.2)
    return by.withColumn("ratio", ratio).select("rec", bar.alias("beats_per_bar"), F.when(enough, F.pmod("phase", bar)).otherwise(0).alias("phase"), sure.alias("confidence"))


def fold_beats(beats: DataFrame, factors: DataFrame) -> DataFrame:
    """beats(rec, beat_idx from 0, t) at factor (1/4 to 4) times their rate: evenly spaced beats come between, or only every second or fourth stays."""
    by = Window.partitionBy("rec").orderBy("beat_idx")
    ahead = beats.join(factors.select("rec", "factor"), "rec").withColumn("next", F.lead("t").over(by))
    more = F.when((F.col("factor") > 1) & F.col("next").isNotNull(), F.col("factor").cast("int") - 1).otherwise(0)
    each = ahead.where((F.col("factor") >= 1) | (F.col("beat_idx") % F.rint(1 / F.col("factor")).cast("long") == 0)).withColumn("k", F.explode(F.sequence(F.lit(0), more)))
    return each.select("rec", F.rint(F.col("beat_idx") * F.col("factor") + F.col("k")).cast("long").alias("beat_idx"), F.coalesce(F.col("t") + (F.col("next") - F.col("t")) * F.col("k") / F.col("factor"), F.col("t")).alias("t"))
