"""Notation read as it sounds: key signature, accidentals of the bar, note lengths, and which tunes a catalog takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as fn
from . import _NOTE, TICKS, notation_fields

#: Steps of the letters above C, the order in which signatures sharpen letters (and, from the end, flatten them), what key fields call the modes, and meters a catalog doesn't take.
STEPS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
SHARPENED = "FCGDAEB"
MODES = {"maj": "major", "ion": "major", "mix": "mixolydian", "dor": "dorian", "min": "minor", "aeo": "minor", "m": "minor"}
OTHER_METERS = ("6/8", "9/8", "12/8", "3/4")


def _looked_up(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def key_of(field: Column) -> Column:
    """A key field such as "AMix", "Bm" or "Eb Dorian" as a name, such as "A mixolydian": the mode by its first letters, major if there is none or it is unknown; D if the field is empty."""
    said = F.coalesce(F.nullif(F.trim(field), F.lit("")), F.lit("D"))
    root = F.upper(F.substring(said, 1, 1))
    sign = F.when(F.substring(said, 2, 1) == "#", "#").when(F.substring(said, 2, 1) == "b", "-").otherwise("")
    rest = F.lower(F.trim(F.substring(said, F.lit(2) + F.length(sign), F.length(said))))
    mode = F.coalesce(_looked_up(MODES, F.substring(rest, 1, 3)), F.when(F.regexp_extract(rest, "^m(?![a-z])", 0) != "", "minor"), F.lit("major"))
    return F.concat(root, sign, F.lit(" "), mode)


def _headed(tunes: DataFrame) -> DataFrame:
    """tunes(source, tune, text) with title, key (a name), meter, beats_per_bar, sharps (negative: flats), unit (beats of a length of 1) and rhythm."""
    field = lambda f: F.nullif(F.trim(F.regexp_extract("text", rf"(?m)^{f}:(.*)$", 1)), F.lit(""))
    read = notation_fields(tunes).withColumn("key", key_of(F.col("key")))
    parsed = fn.parse_key(F.col("key"))
    part = lambda i: F.try_to_number(F.trim(F.split_part(field("L"), F.lit("/"), F.lit(i))), F.lit("999")).cast("double")
    # without a length field a short meter counts in sixteenths
    unit = F.coalesce(F.try_divide(part(1) * 4, part(2)), F.when(F.col("beats_per_bar") < 3, 0.25).otherwise(0.5))
    return read.withColumns({"sharps": fn.key_signature(parsed["tonic"], parsed["mode"]), "unit": unit, "rhythm": F.coalesce(field("R"), F.lit(""))})


def sounding_notes(tunes: DataFrame) -> DataFrame:
    """Notes of tunes(source, tune, text): section (from 0, at P: lines or else repeat bars), name, seq, bar (from 1), pitch (null: rest), start_tick, dur_tick, measure.

    A note without a sign of its own has that of the last one on its letter and octave in the bar, else the key
    signature's. bar counts bar lines, measure the beats since the section began. Tuplets and dotted pairs keep their plain
    lengths, so that catalog() finds their bars wrong; chord names, decorations and other fields don't sound.
    """
    head = _headed(tunes)
    body = F.array_join(F.filter(F.split("text", r"\r?\n"), lambda x: ~x.rlike("^[A-Za-z]:") | x.startswith("P:")), "\n")
    marked = F.col("text").rlike("(?m)^P:")
    parts = F.when(marked, F.split(body, r"P:[^\n]*\n?")).otherwise(F.split(body, r":\|"))
    names = F.when(marked, F.regexp_extract_all(body, F.lit(r"P:[ \t]*([^\n]*)"), F.lit(1)))
    numbered = F.filter(F.transform(parts, lambda p, i: F.struct(p.alias("said"), i.alias("i"))), lambda x: F.regexp_count(F.regexp_replace(x["said"], r'"[^"]*"|!.*?!', ""), F.lit("[A-Ga-gz]")) > 0)
    each = head.select("source", "tune", "sharps", "unit", "beats_per_bar", names.alias("names"), F.posexplode(numbered).alias("section", "x"))
    # before the first P: there is no name
    named = F.coalesce(F.trim(F.get("names", F.col("x.i") - 1)), F.chr((F.col("section") + 65).cast("long")))
    said = F.regexp_replace("x.said", r'"[^"]*"|!.*?!|\[[A-Z]:[^\]]*\]', "")
    tokens = each.select("source", "tune", "sharps", "unit", "beats_per_bar", "section", named.alias("name"), F.posexplode(F.regexp_extract_all(said, F.lit(r"[|\]:]*\|[|\]:]*|" + _NOTE), F.lit(0))).alias("place", "x"))
    whole = Window.partitionBy("source", "tune", "section").orderBy("place")
    letter = F.regexp_extract("x", "[A-Ga-gz]", 0)
    tokens = tokens.withColumns({"letter": letter, "before": F.lag(letter).over(whole)})
    # bar lines next to each other, and one before the first note, are one
    line = (F.col("letter") == "") & (F.coalesce(F.col("before"), F.lit("")) != "")
    tokens = tokens.withColumn("bar", F.sum(line.cast("int")).over(whole) + 1).where("letter <> ''")
    octave = F.when(letter == F.lower(letter), 12).otherwise(0) + 12 * (F.regexp_count("x", F.lit("'")) - F.regexp_count("x", F.lit(",")))
    signs = F.regexp_count("x", F.lit(r"\^")) - F.regexp_count("x", F.lit("_"))
    natural = 60 + _looked_up(STEPS, F.upper(letter)) + octave
    tokens = tokens.withColumns({"natural": F.when(letter != "z", natural), "sign": F.when(F.col("x").rlike("^[=^_]"), signs)})
    held = F.last("sign", True).over(Window.partitionBy("source", "tune", "section", "bar", "natural").orderBy("place"))
    nth = F.instr(F.lit(SHARPENED), F.upper("letter"))
    keyed = F.when(nth <= F.col("sharps"), 1).when(8 - nth <= -F.col("sharps"), -1).otherwise(0)
    top = F.coalesce(F.nullif(F.regexp_extract("x", r"[A-Ga-gz][,']*(\d+)", 1), F.lit("")).cast("double"), F.lit(1.0))
    under = F.coalesce(F.nullif(F.regexp_extract("x", r"/(\d+)", 1), F.lit("")).cast("double"), F.pow(F.lit(2.0), F.regexp_count("x", F.lit("/")).cast("double")))
    sized = tokens.withColumns({"pitch": (F.col("natural") + F.coalesce(held, keyed)).cast("int"), "dur_tick": F.rint(TICKS * F.col("unit") * top / under).cast("long")})
    start = F.coalesce(F.sum("dur_tick").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sized.withColumns({"start_tick": start, "seq": F.row_number().over(whole) - 1})
    measure = (F.floor(F.col("start_tick") / (F.col("beats_per_bar") * TICKS)) + 1).cast("int")
    return placed.select("source", "tune", "section", "name", "seq", F.col("bar").cast("int").alias("bar"), "pitch", "start_tick", "dur_tick", measure.alias("measure"))


def catalog(tunes: DataFrame) -> DataFrame:
    """tunes(source, tune, text) with title, key, meter, rhythm, sections (name, bars) and reason, why a catalog leaves a tune out: null (it doesn't), "meter", "empty" (no notes) or "bars" (a section isn't a whole number of bars, whose bars are then null). A tune left out is a row like any other. Rests count in bars."""
    head = _headed(tunes)
    notes = sounding_notes(tunes)
    totals = notes.groupBy("source", "tune", "section", "name").agg(F.sum("dur_tick").alias("ticks"), F.count("pitch").alias("sounds")).join(head.select("source", "tune", "beats_per_bar"), ["source", "tune"])
    bars = F.col("ticks") / (F.col("beats_per_bar") * TICKS)
    totals = totals.withColumn("bars", F.when(bars == F.floor(bars), bars.cast("int")))
    found = totals.groupBy("source", "tune").agg(F.array_sort(F.collect_list(F.struct("section", "name", "bars"))).alias("sections"), F.sum("sounds").alias("sounds"), F.bool_or(F.col("bars").isNull()).alias("odd"))
    reason = F.when(F.col("meter").isin(*OTHER_METERS), "meter").when(F.coalesce("sounds", F.lit(0)) == 0, "empty").when(F.col("odd"), "bars")
    joined = head.join(found, ["source", "tune"], "left")
    return joined.select("source", "tune", F.coalesce("title", F.lit("Untitled")).alias("title"), "key", "meter", "rhythm", F.transform("sections", lambda x: F.struct(x["name"].alias("name"), x["bars"].alias("bars"))).alias("sections"), reason.alias("reason"))
