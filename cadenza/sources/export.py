"""Writers' forms of tunes, notes and frames, as columns and rows that any Spark sink takes, and a reader for MusicXML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import TICKS

# The twelve pitch classes spelled with sharps and with flats, and the order in which signatures add them.
SHARP = ("C", "^C", "D", "^D", "E", "F", "^F", "G", "^G", "A", "^A", "B")
FLAT = ("C", "_D", "D", "_E", "E", "F", "_G", "G", "_A", "A", "_B", "B")
SHARP_ORDER, FLAT_ORDER = "FCGDAEB", "BEADGCF"


def notation_length(ticks: Column, unit: int = TICKS // 2) -> Column:
    """A length as a multiple of the unit (an eighth note): nothing for one unit, n, /d or n/d in lowest terms."""
    divisors = F.array(*(F.lit(d) for d in range(1, unit + 1) if unit % d == 0))
    common = F.array_max(F.filter(divisors, lambda d: ticks % d == 0))
    top, under = (ticks / common).cast("long"), (F.lit(unit) / common).cast("long")
    return F.when((under == 1) & (top == 1), "").when(under == 1, top.cast("string")).when(top == 1, F.concat(F.lit("/"), under.cast("string"))).otherwise(F.concat_ws("/", top.cast("string"), under.cast("string")))


def notation_pitch(midi: Column, sharps: Column) -> Column:
    """A MIDI number as a pitch of the notation; accidentals stand only where the signature (sharps, or flats below 0) says otherwise, naturals included."""
    pc = F.pmod(midi, F.lit(12)).cast("int")
    spelled = F.when(sharps >= 0, F.get(F.array(*map(F.lit, SHARP)), pc)).otherwise(F.get(F.array(*map(F.lit, FLAT)), pc))
    letter, octave = F.right(spelled, F.lit(1)), (F.floor(midi / 12) - 1).cast("int")
    altered = F.contains(F.when(sharps >= 0, F.substring(F.lit(SHARP_ORDER), F.lit(1), sharps)).otherwise(F.substring(F.lit(FLAT_ORDER), F.lit(1), -sharps)), letter)
    bent = F.length(spelled) == 2
    mark = F.when(bent & altered, "").when(bent, F.left(spelled, F.lit(1))).when(altered, "=").otherwise("")
    name = F.when(octave >= 5, F.concat(F.lower(letter), F.repeat(F.lit("'"), octave - 5))).otherwise(F.concat(letter, F.repeat(F.lit(","), 4 - octave)))
    return F.concat(mark, name)


def _joined(df: DataFrame, keys: list[str], order: str, value: str, sep: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(order, value)))
    return df.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x[value]), sep).alias(value))


def tune_text(notes: DataFrame, tunes: DataFrame) -> DataFrame:
    """notes(rec, section, measure, seq, pitch or null, dur_tick) and tunes(rec, title, meter, tempo, key, sharps, repeats) as one text of the notation each: rec, text.

    Bars keep the length they have; repeated sections stand between repeat bars.
    """
    told = notes.join(tunes.select("rec", "sharps"), "rec")
    token = F.concat(F.when(F.col("pitch").isNull(), "z").otherwise(notation_pitch(F.col("pitch"), F.col("sharps"))), notation_length(F.col("dur_tick")))
    bars = _joined(told.withColumn("said", token), ["rec", "section", "measure"], "seq", "said", " ")
    sections = _joined(bars, ["rec", "section"], "measure", "said", "|").join(tunes.select("rec", "repeats"), "rec")
    twice = F.col("repeats") >= 2
    sections = sections.withColumn("said", F.concat(F.lit("P:"), F.col("section"), F.when(twice, "\n|:").otherwise("\n|"), "said", F.when(twice, ":|").otherwise("|")))
    body = _joined(sections, ["rec"], "section", "said", "\n")
    mode = F.lower(F.substring(F.split_part("key", F.lit(" "), F.lit(2)), 1, 3))
    head = F.concat_ws("\n", F.lit("X:1"), F.concat(F.lit("T:"), F.coalesce("title", F.lit("Untitled"))), F.concat(F.lit("M:"), F.col("meter")), F.lit("L:1/8"), F.concat(F.lit("Q:1/4="), F.rint("tempo").cast("int").cast("string")), F.concat(F.lit("K:"), F.replace(F.split_part("key", F.lit(" "), F.lit(1)), F.lit("-"), F.lit("b")), F.when(mode == "maj", "").otherwise(mode)))
    return body.join(tunes.withColumn("head", head).select("rec", "head"), "rec").select("rec", F.concat("head", F.lit("\n"), "said", F.lit("\n")).alias("text"))


def frame_rows(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Frames of both, side by side as far as both go, as four-digit strings with blanks for unvoiced ones; write them with .write.csv."""
    four = lambda c: F.coalesce(F.format_string("%.4f", c), F.lit(""))
    pitch = lambda c: F.when(c.isNull(), "").otherwise(four(c))
    both = raw.select("rec", "frame", "t", F.col("midi").alias("raw"), "conf").join(clean.select("rec", "frame", F.col("midi").alias("clean")), ["rec", "frame"])
    return both.select("rec", "frame", four(F.col("t")).alias("time"), pitch(F.col("raw")).alias("raw_midi"), pitch(F.col("clean")).alias("clean_midi"), four(F.col("conf")).alias("confidence"))


def note_records(notes: DataFrame, by: str = "rec") -> DataFrame:
    """One JSON record for each recording, with its notes in order of seq."""
    fields = [c for c in notes.columns if c != by]
    held = F.array_sort(F.collect_list(F.struct("seq", *(c for c in fields if c != "seq"))))
    return notes.groupBy(by).agg(held.alias("notes")).select(by, F.to_json(F.struct(by, F.size("notes").alias("n_notes"), "notes")).alias("json"))


_PART = """measure array<struct<attributes:struct<divisions:int>, note:array<struct<rest:string, chord:string, pitch:struct<step:string,alter:int,octave:int>, duration:int>>,
barline:array<struct<repeat:struct<_direction:string>>>>>"""


def read_musicxml(spark: SparkSession, path: str) -> DataFrame:
    """Notes of MusicXML files: source, section (from 0; a new one after each backward repeat), measure (from 1 within it), seq, pitch (null: rest), dur_tick. A chord's further notes are left out; the first part is read as one row."""
    parts = spark.read.format("xml").option("rowTag", "part").schema(_PART).load(path).select(F.col("_metadata.file_path").alias("source"), F.posexplode("measure").alias("at", "m"))
    by = Window.partitionBy("source").orderBy("at")
    ends = F.exists(F.coalesce("m.barline", F.expr("cast(array() as array<struct<repeat:struct<_direction:string>>>)")), lambda b: b["repeat"]["_direction"] == "backward")
    told = parts.withColumn("ends", ends.cast("int")).withColumns({"section": F.coalesce(F.sum("ends").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "divisions": F.last("m.attributes.divisions", True).over(by)})
    told = told.withColumn("measure", F.dense_rank().over(Window.partitionBy("source", "section").orderBy("at")))
    each = told.select("source", "section", "measure", "divisions", F.posexplode("m.note").alias("seq", "n")).where("n.chord is null")
    step = F.element_at(F.create_map(*(F.lit(v) for kv in {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}.items() for v in kv)), F.col("n.pitch.step"))
    pitch = 12 * (F.col("n.pitch.octave") + 1) + step + F.coalesce("n.pitch.alter", F.lit(0))
    return each.select("source", "section", "measure", "seq", F.when(F.col("n.pitch").isNotNull(), pitch).alias("pitch"), F.rint(TICKS * F.col("n.duration") / F.coalesce("divisions", F.lit(1))).cast("long").alias("dur_tick"))


def _two(value: Column) -> Column:
    return F.lpad(F.hex(value.cast("long")), 2, "0")


def _delta(ticks: Column) -> Column:
    """A time difference below 2^28 in seven-bit groups, the highest first, as hexadecimal digits."""
    part = lambda k, more: _two(F.shiftright(ticks, 7 * k).bitwiseAND(F.lit(127)) + more)
    return F.concat(*(F.when(ticks >= 1 << 7 * k, part(k, 128)).otherwise("") for k in (3, 2, 1)), part(0, 0))


def midi_file(notes: DataFrame, tunes: DataFrame) -> DataFrame:
    """notes(rec, start_tick, dur_tick, pitch or null) and tunes(rec, tempo) as one Standard MIDI File of one track each: rec, content (binary).

    Rests make no events. Events stand by time, ends before starts, then by pitch; a tune without notes is an empty track.
    """
    sounding = notes.where("pitch is not null and dur_tick > 0")
    ends = F.array(F.struct((F.col("start_tick") + F.col("dur_tick")).cast("long").alias("at"), F.lit(0).alias("on")), F.struct(F.col("start_tick").cast("long").alias("at"), F.lit(1).alias("on")))
    events = sounding.select("rec", F.col("pitch").cast("int").alias("pitch"), F.explode(ends).alias("e")).select("rec", "e.at", "e.on", "pitch")
    by = Window.partitionBy("rec").orderBy("at", "on", "pitch")
    events = events.withColumns({"nth": F.row_number().over(by), "delta": F.col("at") - F.coalesce(F.lag("at").over(by), F.lit(0))})
    said = F.concat(_delta(F.col("delta")), F.when(F.col("on") == 1, "90").otherwise("80"), _two(F.col("pitch")), F.when(F.col("on") == 1, "50").otherwise("40"))
    tracks = _joined(events.withColumn("said", said), ["rec"], "nth", "said", "")
    tempo = F.concat(F.lit("00FF5103"), F.lpad(F.hex(F.rint(60_000_000 / F.col("tempo")).cast("long")), 6, "0"))
    track = F.concat(tempo, F.coalesce("said", F.lit("")), F.lit("00FF2F00"))
    whole = F.concat(F.lit(f"4D5468640000000600000001{TICKS:04X}4D54726B"), F.lpad(F.hex((F.length("track") / 2).cast("long")), 8, "0"), "track")
    return tunes.join(tracks, "rec", "left").select("rec", track.alias("track")).select("rec", F.unhex(whole).alias("content"))


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def musicxml_text(notes: DataFrame, tunes: DataFrame) -> DataFrame:
    """notes(rec, section, measure, seq, pitch or null, dur_tick) and tunes(rec, title, beats, sharps, repeats) as one MusicXML text each: rec, text.

    Bars keep the length they have, one that differs from `beats` quarters has a meter of its own in quarters or, if it must, sixteenths. A section that is repeated ends in a backward repeat.
    """
    told = notes.join(tunes.select("rec", "sharps"), "rec")
    pc = F.pmod("pitch", F.lit(12)).cast("int")
    name = F.when(F.col("sharps") >= 0, F.get(F.array(*map(F.lit, SHARP)), pc)).otherwise(F.get(F.array(*map(F.lit, FLAT)), pc))
    alter = F.when(F.startswith(name, F.lit("^")), "<alter>1</alter>").when(F.startswith(name, F.lit("_")), "<alter>-1</alter>").otherwise("")
    pitch = F.concat(F.lit("<pitch><step>"), F.right(name, F.lit(1)), F.lit("</step>"), alter, F.lit("<octave>"), (F.floor(F.col("pitch") / 12) - 1).cast("string"), F.lit("</octave></pitch>"))
    note = F.concat(F.lit("<note>"), F.when(F.col("pitch").isNull(), "<rest/>").otherwise(pitch), F.lit("<duration>"), F.col("dur_tick").cast("string"), F.lit("</duration></note>"))
    keys = ["rec", "section", "measure"]
    lengths = told.groupBy(*keys).agg(F.sum("dur_tick").alias("ticks"))
    bars = _joined(told.withColumn("said", note), keys, "seq", "said", "").join(lengths, keys).join(tunes.select("rec", "sharps", "repeats", "beats"), "rec")
    by = Window.partitionBy("rec").orderBy("section", "measure")
    bars = bars.withColumns({"nth": F.row_number().over(by), "last": F.coalesce(F.lead("section").over(by) != F.col("section"), F.lit(True)), "before": F.coalesce(F.lag("ticks").over(by), F.lit(-1))})
    quarters = F.when(F.col("ticks") % TICKS == 0, F.concat(F.lit("<beats>"), (F.col("ticks") / TICKS).cast("int").cast("string"), F.lit("</beats><beat-type>4</beat-type>")))
    meter = F.concat(F.lit("<time>"), F.coalesce(quarters, F.concat(F.lit("<beats>"), F.rint(F.col("ticks") * 4 / TICKS).cast("int").cast("string"), F.lit("</beats><beat-type>16</beat-type>"))), F.lit("</time>"))
    first = F.when(F.col("nth") == 1, F.concat(F.lit(f"<divisions>{TICKS}</divisions><key><fifths>"), F.col("sharps").cast("string"), F.lit("</fifths></key>"))).otherwise("")
    plain = F.concat(F.lit("<time><beats>"), F.col("beats").cast("int").cast("string"), F.lit("</beats><beat-type>4</beat-type></time>"))
    usual = F.col("ticks") == F.col("beats") * TICKS
    changes = F.col("ticks") != F.col("before")
    head = F.concat(first, F.when(usual & changes, plain).when(changes, meter).otherwise(""))
    barline = F.when(F.col("last") & (F.col("repeats") >= 2), '<barline location="right"><repeat direction="backward"/></barline>').otherwise("")
    measure = F.concat(F.lit('<measure number="'), F.col("nth").cast("string"), F.lit('">'), F.when(head != "", F.concat(F.lit("<attributes>"), head, F.lit("</attributes>"))).otherwise(""), "said", barline, F.lit("</measure>"))
    body = _joined(bars.withColumn("said", measure), ["rec"], "nth", "said", "")
    start = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><score-partwise version="4.0"><work><work-title>'), _escaped(F.coalesce("title", F.lit("Untitled"))), F.lit('</work-title></work><part-list><score-part id="P1"><part-name>Melody</part-name></score-part></part-list><part id="P1">'))
    return body.join(tunes.select("rec", start.alias("head")), "rec").select("rec", F.concat("head", "said", F.lit("</part></score-partwise>\n")).alias("text"))
