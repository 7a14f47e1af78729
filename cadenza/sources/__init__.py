"""Readers, and views of generic tables as frames, notes and catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOP = 0.01
#: Ticks of a beat; all note lengths of the notation are whole ticks.
TICKS = 960


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as pitch frames: rec, frame (from 0 by event_id), t, midi (null: unvoiced), conf."""
    by = Window.partitionBy("user_id").orderBy("event_id")
    midi = F.when(F.col("event_type") != "error", 55 + F.floor("value") % 46).cast("double")
    got = table(spark, sf_dir, "events").select(F.col("user_id").alias("rec"), (F.row_number().over(by) - 1).cast("long").alias("frame"), midi.alias("midi"), (F.col("value") / 500).alias("conf"))
    return got.select("rec", "frame", (F.col("frame") * HOP).alias("t"), "midi", "conf")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as notes: rec, seq (from 0), pitch, beat (their seconds since the recording's first, by the minute), dur (beats), conf."""
    by = Window.partitionBy("user_id")
    second = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    got = table(spark, sf_dir, "events").withColumn("s", second).where("event_type <> 'error'")
    return got.select(
        F.col("user_id").alias("rec"),
        (F.row_number().over(by.orderBy("s", "event_id")) - 1).cast("long").alias("seq"),
        (55 + F.floor("value") % 46).cast("int").alias("pitch"),
        ((F.col("s") - F.min("s").over(by)) / 60).alias("beat"),
        (F.col("value") / 100).alias("dur"),
        (F.col("value") / 500).alias("conf"),
    )


def read_notation(spark: SparkSession, path: str) -> DataFrame:
    """Text files in the ABC notation as tunes: one row (source, tune, text) for each X: block with a K: line; comments (%) go, directives (%%) stay."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    lines = lines.where(~F.col("text").rlike("^%(?!%)"))
    numbered = lines.withColumn("tune", F.sum(F.col("text").startswith("X:").cast("int")).over(Window.partitionBy("source").orderBy("line")))
    tunes = numbered.where("tune > 0").groupBy("source", "tune").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return tunes.where(F.col("text").rlike("(?m)^K:"))


def notation_fields(tunes: DataFrame) -> DataFrame:
    """tunes(text, ...) with title, key, meter (4/4 if none) and beats_per_bar in quarter notes."""
    field = lambda f: F.nullif(F.trim(F.regexp_extract("text", rf"(?m)^{f}:(.*)$", 1)), F.lit(""))
    meter = F.coalesce(field("M"), F.lit("4/4"))
    meter = F.when(meter == "C", "4/4").when(meter == "C|", "2/2").otherwise(meter)
    beats = F.coalesce(F.try_divide(F.try_to_number(F.split_part(meter, F.lit("/"), F.lit(1)), F.lit("99")) * 4, F.try_to_number(F.split_part(meter, F.lit("/"), F.lit(2)), F.lit("99"))).cast("double"), F.lit(4.0))
    return tunes.withColumns({"title": field("T"), "key": field("K"), "meter": meter, "beats_per_bar": beats})


_NOTE = r"(?:\^\^|\^|__|_|=)?[A-Ga-gz][,']*\d*/*\d*"


def notation_notes(tunes: DataFrame, unit: float = 0.5) -> DataFrame:
    """Notes of tunes(source, tune, text): section, seq, pitch (null: rest), start_tick, dur_tick. Sections end at P: lines or repeat bars; accidentals hold for their note; the key signature is not applied.

    unit is the beats of a length of 1 (an eighth note).
    """
    body = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~x.rlike("^[A-Za-z]:") | x.startswith("P:")), "\n")
    parts = F.when(F.col("text").rlike("(?m)^P:"), F.split(body, r"P:[^\n]*")).otherwise(F.split(body, r":\|"))
    sections = tunes.select("source", "tune", F.posexplode(F.filter(parts, lambda p: F.regexp_count(p, F.lit("[A-Ga-gz]")) > 0)).alias("section", "said"))
    said = F.regexp_replace("said", r'"[^"]*"|!.*?!|\[[A-Z]:[^\]]*\]', "")
    each = sections.select("source", "tune", "section", F.posexplode(F.regexp_extract_all(said, F.lit(_NOTE), F.lit(0))).alias("seq", "x"))
    letter = F.regexp_extract("x", "[A-Ga-gz]", 0)
    step = F.element_at(F.create_map(*(F.lit(v) for kv in {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}.items() for v in kv)), F.upper(letter))
    octave = F.when(letter == F.lower(letter), 12).otherwise(0) + 12 * (F.regexp_count("x", F.lit("'")) - F.regexp_count("x", F.lit(",")))
    bend = F.regexp_count("x", F.lit(r"\^")) - F.regexp_count("x", F.lit("_"))
    top = F.coalesce(F.nullif(F.regexp_extract("x", r"[A-Ga-gz][,']*(\d+)", 1), F.lit("")).cast("double"), F.lit(1.0))
    slashes = F.regexp_count("x", F.lit("/"))
    under = F.coalesce(F.nullif(F.regexp_extract("x", r"/(\d+)", 1), F.lit("")).cast("double"), F.pow(F.lit(2.0), slashes.cast("double")))
    ticks = F.rint(TICKS * unit * top / under).cast("long")
    sized = each.withColumns({"pitch": F.when(letter != "z", 60 + step + octave + bend), "dur_tick": ticks})
    before = Window.partitionBy("source", "tune", "section").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return sized.select("source", "tune", "section", "seq", "pitch", F.coalesce(F.sum("dur_tick").over(before), F.lit(0)).alias("start_tick"), "dur_tick")
