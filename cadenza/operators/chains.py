"""Whole chains from frames to notes, and what is reported of notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import cleaning, frames, kernels, segments

#: The cleaning stages in their order.
STAGES = {
    "gate": frames.gate,
    "jump": frames.jump_gate,
    "octave": frames.octave_correction,
    "median": cleaning.median_in_runs,
    "vibrato": cleaning.flatten_vibrato,
    "drones": cleaning.drop_drones,
    "gaps": frames.fill_gaps,
}


def clean(contour: DataFrame, without: tuple[str, ...] = ("drones",)) -> DataFrame:
    """frames(rec, frame, t, midi, conf) through all cleaning stages but those named."""
    for name, stage in STAGES.items():
        if name not in without:
            contour = stage(contour).select("rec", "frame", "t", "midi", "conf")
    return contour


def span_notes(contour: DataFrame, spans: DataFrame, hop: float, trim: float = 0.12) -> DataFrame:
    """spans(rec, note_start, note_end exclusive), apart, as notes: rec, start, end (seconds), pitch, conf, spread (cents), voiced.

    pitch is the median of the voiced frames without the first `trim` of them where three remain, spread the 90th percentile
    of their deviation. Each frame looks up the last span that began, so a recording is one sorted pass.
    """
    by = Window.partitionBy("rec").orderBy("frame")
    begins = spans.select("rec", F.col("note_start").alias("frame"), "note_start", "note_end")
    held = contour.join(begins, ["rec", "frame"], "left").withColumns({c: F.last(c, True).over(by) for c in ("note_start", "note_end")}).where("frame < note_end")
    note = Window.partitionBy("rec", "note_start")
    heard = F.col("midi").isNotNull()
    placed = held.withColumns({"n": F.count("midi").over(note), "i": F.count("midi").over(note.orderBy("frame")) - 1}).withColumn("skip", F.floor(F.col("n") * trim))
    core = placed.withColumn("core", F.when((F.col("n") - F.col("skip") < 3) | (F.col("i") >= F.col("skip")), F.col("midi")))
    core = core.withColumn("pitch", F.percentile("core", F.lit(0.5)).over(note))
    made = core.groupBy("rec", "note_start", "note_end").agg(F.first("pitch").alias("pitch"), F.avg(F.when(heard, F.col("conf"))).alias("conf"), (100 * F.percentile(F.abs(F.col("core") - F.col("pitch")), F.lit(0.9))).alias("spread"), F.avg(heard.cast("int")).alias("voiced"))
    return made.select("rec", (F.col("note_start") * hop).alias("start"), (F.col("note_end") * hop).alias("end"), "pitch", "conf", "spread", "voiced")


def segment(contour: DataFrame, hop: float, onsets: DataFrame | None = None, beat_seconds: float | None = None, shortest: float = 0.055, voiced: float = 0.55) -> DataFrame:
    """frames(rec, frame, t, midi, conf) as notes: voiced runs, cut where the pitch settles elsewhere and at onsets(rec, t), without short and hardly voiced parts, joined over dropouts."""
    flagged = contour.withColumn("v", F.col("midi").isNotNull()).withColumn("run", frames._run_id(F.col("v"))).where("v")
    spans = kernels.split_runs(flagged.select("rec", "run", "frame", "midi")).select("rec", "note_start", "note_end")
    if onsets is not None:
        cut = segments.cut_at_onsets(spans.toDF("rec", "run_start", "run_end"), onsets, hop, segments.least_length(beat_seconds))
        spans = cut.select("rec", "note_start", "note_end")
    made = span_notes(contour, spans, hop).where((F.round(F.col("end") - F.col("start"), 9) >= shortest) & (F.col("voiced") >= voiced))
    return segments.join_dropouts(made)


def sample_at(times: DataFrame, curve: DataFrame) -> DataFrame:
    """times(rec, t) with y of curve(rec, t, y) at them, on a line between the two neighbouring points; the first and last value hold beyond the ends. A curve has one point for each t; repeated times are one row."""
    both = curve.select("rec", "t", "y", F.lit(False).alias("asked")).unionByName(times.select("rec", "t", F.lit(None).cast("double").alias("y"), F.lit(True).alias("asked")).distinct())
    by = Window.partitionBy("rec").orderBy("t")
    point = F.when(~F.col("asked"), F.struct("t", "y"))
    placed = both.withColumns({"a": F.last(point, True).over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow)), "b": F.first(point, True).over(by.rangeBetween(Window.currentRow, Window.unboundedFollowing))}).where("asked")
    between = F.when(F.col("b.t") > F.col("a.t"), F.col("a.y") + (F.col("b.y") - F.col("a.y")) * (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t")))
    return placed.select("rec", "t", F.coalesce(between, "a.y", "b.y").alias("y"))


def concentration(notes: DataFrame, top: int = 3) -> DataFrame:
    """notes(rec, seq, pitch): the commonest pitches of each recording (of ties, the one heard first) and their shares: rec, rank, pitch, share, n (of all notes)."""
    counts = notes.where("pitch is not null").groupBy("rec", "pitch").agg(F.count("*").alias("m"), F.min("seq").alias("first"))
    whole = Window.partitionBy("rec")
    ranked = counts.withColumns({"rank": F.row_number().over(whole.orderBy(F.desc("m"), "first")), "n": F.sum("m").over(whole)}).where(F.col("rank") <= top)
    return ranked.select("rec", "rank", "pitch", (F.col("m") / F.col("n")).alias("share"), "n")


def least_sure(notes: DataFrame, below: float = 0.7, most: int = 8) -> DataFrame:
    """notes(rec, seq, pitch, conf): of each recording the least sure notes below that confidence, in order, `most` at most; null pitches are rests. A report, so the limit is the point of it."""
    nth = F.row_number().over(Window.partitionBy("rec").orderBy("conf", "seq"))
    return notes.where((F.col("conf") < below) & F.col("pitch").isNotNull()).withColumn("rank", nth).where(F.col("rank") <= most)


#: Shares of the two commonest pitches above which a line has collapsed onto them or is still concentrated, and that of tunes as they are played.
COLLAPSED, CONCENTRATED, USUAL = 0.70, 0.58, 0.53


def verdict(concentrated: DataFrame, forms: DataFrame) -> DataFrame:
    """What the spread of a recording's pitches says of its line: concentration() and forms(rec, form) to rec, top2, reading ("collapsed", "concentrated" or "spread"), level ("bad" or "warn"), sectioned and text.

    No level is good, as nothing is held against a truth here. Without a form, or with one section only, a recording isn't
    sectioned. One without notes has no row; one with a single pitch has collapsed onto it.
    """
    tops = concentrated.where("rank <= 2").groupBy("rec").agg(F.sum("share").alias("top2"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "pitch"))), lambda x: x["pitch"].cast("string")), " and ").alias("pitches"))
    reading = F.when(F.col("top2") > COLLAPSED, "collapsed").when(F.col("top2") > CONCENTRATED, "concentrated").otherwise("spread")
    form = F.coalesce("form", F.lit(""))
    told = tops.join(forms.select("rec", "form"), "rec", "left").select("rec", "top2", "pitches", reading.alias("reading"), (~form.isin("", "A")).alias("sectioned"))
    percent = F.concat(F.round(F.col("top2") * 100).cast("int").cast("string"), F.lit(f" % of the notes are two pitches at most ({USUAL * 100:.0f} % in a tune as played)"))
    said = F.when(F.col("reading") == "collapsed", F.concat(F.lit("fell onto "), "pitches", F.lit(": "), percent)).when(F.col("reading") == "concentrated", F.concat(F.lit("not yet a melody: "), percent)).otherwise(F.concat(F.lit("spread like a tune: "), percent))
    text = F.concat(said, F.when(F.col("sectioned"), "").otherwise("; no sections were found"))
    return told.select("rec", "top2", "reading", F.when(F.col("reading") == "collapsed", "bad").otherwise("warn").alias("level"), "sectioned", text.alias("text"))


def pass_spans(notes: DataFrame, by: tuple[str, ...] = ("rec", "label", "pass")) -> DataFrame:
    """notes(..., seq, start_sec, dur_sec, conf): of each group its notes, their mean confidence, when the first one in order begins and when the last one ends. Nulls in conf don't count."""
    first, last = F.min_by("start_sec", "seq"), F.max_by(F.col("start_sec") + F.col("dur_sec"), F.col("seq"))
    return notes.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.avg("conf"), F.lit(0.0)).alias("conf"), first.alias("first_sec"), last.alias("last_sec"))
