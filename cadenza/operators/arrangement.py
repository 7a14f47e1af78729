"""A five-string banjo part for a tune: a stream of equal notes in rolls, with the melody on the strings where it falls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..sources import TICKS
from .music import octave_shift

#: Open strings 1 to 5 (the fifth is the drone) with their names and fingers, the string that each roll plays in each slot, semitones of the triad, and the highest frets of melody and of filler.
OPEN = (62, 59, 55, 50, 67)
NAMES = ("D", "B", "G", "D", "g")
FINGERS = ("M", "I", "T", "T", "T")
ROLLS = {
    "forward": (3, 2, 1, 5, 3, 2, 1, 5),
    "backward": (1, 2, 3, 5, 1, 2, 3, 5),
    "forward_reverse": (3, 2, 5, 1, 3, 2, 5, 1),
    "alternating_thumb": (4, 2, 3, 1, 4, 2, 3, 1),
}
TRIAD = (0, 4, 7)
HIGHEST, FILLED = 12, 5
#: Roots of the chords that a bar may have, above the key's: I, IV and V.
CHORDS = (0, 5, 7)


def capo(key: Column) -> Column:
    """The fret that lets a key be played as G: the way up from G to its tonic, 0 if that is more than five frets or the key is unknown."""
    up = F.pmod(F.coalesce(fn.parse_key(key)["tonic"], F.lit(7)) - OPEN[2], F.lit(12)).cast("int")
    return F.when(up <= 5, up).otherwise(0)


def _string(values: tuple, string: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), string - 1)


def fingered(pitch: Column, capo: Column) -> Column:
    """struct(string, fret) of a melody pitch on strings 1 to 4, lowest fret first; a pitch off the neck is moved by octaves onto it."""
    low, high = OPEN[3] + capo, OPEN[0] + capo + HIGHEST
    octaves = F.when(pitch < low, F.ceil((low - pitch) / 12)).when(pitch > high, -F.ceil((pitch - high) / 12)).otherwise(0)
    held = pitch + 12 * octaves.cast("int")
    places = F.array(*(F.struct((held - o - capo).alias("fret"), F.lit(s).alias("string")) for s, o in enumerate(OPEN[:4], 1)))
    best = F.array_min(F.filter(places, lambda x: x["fret"].between(0, HIGHEST)))
    return F.struct(best["string"].alias("string"), best["fret"].alias("fret"))


def arrange(notes: DataFrame, tunes: DataFrame, roll: str = "forward", vary: bool = True, subdivision: int = 2) -> DataFrame:
    """notes(rec, seq, bar from 0, start_tick, pitch, null: rest) and tunes(rec, key, beats_per_bar, and a capo if not the key's) as a part: rec, bar, slot, string, fret, pitch, start_tick, dur_tick, melody, finger.

    Every bar that has a row in notes is filled: a slot goes to the first note that rounds to it, at an octave chosen for the
    whole tune, and else to a chord note on the string of the roll, the drone open. With `vary` each bar takes the next roll.
    A note that rounds to no slot of its bar counts for the bar's chord only; recs without a row in tunes are left out, as is
    a meter that isn't a positive number of beats. Rows equal in rec, bar and seq are told apart by pitch.
    """
    own = F.col("capo") if "capo" in tunes.columns else F.lit(None).cast("int")
    facts = tunes.where("beats_per_bar > 0").select(
        "rec", F.coalesce(own, capo(F.col("key"))).alias("capo"), F.coalesce(fn.parse_key(F.col("key"))["tonic"], F.lit(7)).alias("root"), F.col("beats_per_bar").cast("double").alias("beats")
    )
    played = notes.select("rec", "bar", "seq", "start_tick", "pitch").join(facts, "rec")
    shifts = octave_shift(played.where("pitch is not null"), HIGHEST, "capo").select("rec", "shift")
    slots = F.floor(F.col("beats") * subdivision).cast("int")
    slot = F.rint((F.col("start_tick") / TICKS - F.col("bar") * F.col("beats")) * subdivision).cast("int")
    in_chord = lambda up: F.coalesce(F.pmod(F.col("pitch") - F.col("root") - up, F.lit(12)).isin(*TRIAD), F.lit(False))
    # notes of a slot, then slots of a bar, which are few: no group grows with the notes of a bar
    taken = F.when(F.col("pitch").isNotNull() & slot.between(0, slots - 1), slot)
    of_slot = played.groupBy("rec", "bar", "capo", "root", "beats", taken.alias("slot")).agg(
        F.min_by("pitch", F.struct("seq", "pitch")).alias("pitch"), *(F.count_if(in_chord(c)).alias(f"hits{c}") for c in CHORDS)
    )
    hits = [F.sum(f"hits{c}").alias(f"hits{c}") for c in CHORDS]
    bars = of_slot.groupBy("rec", "bar", "capo", "root", "beats").agg(F.map_from_entries(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "pitch")))).alias("claimed"), *hits)
    # the first of the chords that most notes are in
    most = F.greatest(*(F.col(f"hits{c}") for c in CHORDS))
    chord = F.coalesce(*(F.when(F.col(f"hits{c}") == most, c) for c in CHORDS))
    order = (roll, *(r for r in ROLLS if r != roll)) if vary else (roll,)
    rolls = F.array(*(F.array(*map(F.lit, ROLLS[r])) for r in order))
    each = bars.join(shifts, "rec", "left").select(
        "rec", "bar", "capo", "beats", "claimed", F.coalesce("shift", F.lit(0)).alias("shift"), F.pmod(F.col("root") + chord, F.lit(12)).alias("chord"), F.explode(F.when(slots > 0, F.sequence(F.lit(0), slots - 1))).alias("slot"),
    )
    tune_note = F.try_element_at("claimed", F.col("slot"))
    each = each.withColumns({"melody": tune_note.isNotNull(), "at": fingered(tune_note + F.col("shift"), F.col("capo")), "rolled": F.get(F.get(rolls, F.pmod("bar", F.lit(len(order))).cast("int")), F.col("slot") % 8)})
    bottom = _string(OPEN, F.col("rolled")) + F.col("capo")
    fits = F.filter(F.array(*map(F.lit, range(FILLED + 1))), lambda f: F.pmod(bottom + f - F.col("chord"), F.lit(12)).isin(*TRIAD))
    filler = F.when(F.col("rolled") == 5, 0).otherwise(F.coalesce(F.get(fits, F.lit(0)), F.lit(0)))
    string, fret = F.when(F.col("melody"), F.col("at.string")).otherwise(F.col("rolled")), F.when(F.col("melody"), F.col("at.fret")).otherwise(filler)
    placed = each.select("rec", "bar", "slot", "capo", "beats", "melody", string.alias("string"), fret.alias("fret"))
    start = F.rint((F.col("bar") * F.col("beats") + F.col("slot") / subdivision) * TICKS).cast("long")
    return placed.select(
        "rec", F.col("bar").cast("long").alias("bar"), "slot", "string", "fret", (_string(OPEN, F.col("string")) + F.col("capo") + F.col("fret")).alias("pitch"),
        start.alias("start_tick"), F.lit(TICKS // subdivision).cast("long").alias("dur_tick"), "melody", _string(FINGERS, F.col("string")).alias("finger"),
    )


def melody_share(part: DataFrame) -> DataFrame:
    """The notes of each rec's part and the share of them that is melody."""
    return part.groupBy("rec").agg(F.count("*").alias("n"), F.avg(F.col("melody").cast("int")).alias("share"))


def tablature_lines(part: DataFrame, bars_per_line: int = 4) -> DataFrame:
    """A part as rec, block, lines: five rows of frets, one for each string from the first, and one of fingers, in capitals where the melody is. Bars are counted as they come, so that a missing one leaves no hole."""
    cell = lambda s: F.concat(F.when(F.col("string") == s, F.rpad(F.col("fret").cast("string"), 2, " ")).otherwise("--"), F.lit("-"))
    finger = F.concat(F.when(F.col("melody"), F.col("finger")).otherwise(F.lower("finger")), F.lit("  "))
    cells = F.struct("slot", *(cell(s).alias(f"s{s}") for s in range(1, 6)), finger.alias("s6"))
    bars = part.groupBy("rec", "bar").agg(F.array_sort(F.collect_list(cells)).alias("cells"))
    row = lambda s, end: F.concat(F.array_join(F.transform("cells", lambda x: x[f"s{s}"]), ""), F.lit(end))
    nth = F.row_number().over(Window.partitionBy("rec").orderBy("bar")) - 1
    rows = bars.select("rec", "bar", *(row(s, "|").alias(f"s{s}") for s in range(1, 6)), row(6, " ").alias("s6")).withColumn("block", F.floor(nth / bars_per_line))
    blocks = rows.groupBy("rec", "block").agg(F.array_sort(F.collect_list(F.struct("bar", *(f"s{s}" for s in range(1, 7))))).alias("bars"))
    heads = (*(f"{n}|" for n in NAMES), "  ")
    joined = lambda s: F.array_join(F.transform("bars", lambda x: x[f"s{s}"]), "")
    lines = F.array(*(F.concat(F.lit(h), joined(s)) for s, h in enumerate(heads, 1)))
    return blocks.select("rec", "block", lines.alias("lines"))


def tablature(part: DataFrame, tunes: DataFrame, bars_per_line: int = 4) -> DataFrame:
    """The whole tab of each rec as text: tunes(rec, key, meter, and a capo if not the key's) head it. A tune is one row here; tablature_lines() has a row for each line of bars."""
    blocks = tablature_lines(part, bars_per_line).select("rec", "block", F.concat(F.array_join("lines", "\n"), F.lit("\n\n")).alias("text"))
    texts = blocks.groupBy("rec").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "").alias("body"))
    own = F.col("capo") if "capo" in tunes.columns else F.lit(None).cast("int")
    head = F.concat(F.lit("Banjo arrangement -- "), F.coalesce("key", F.lit("?")), F.lit(", "), F.coalesce("meter", F.lit("?")), F.lit(", open-G tuning, capo "), F.coalesce(own, capo(F.col("key"))).cast("string"), F.lit("\n\n"))
    told = "uppercase finger = melody note, lowercase = roll filler\nT = thumb, I = index, M = middle"
    return texts.join(tunes.select("rec", head.alias("head")), "rec").select("rec", F.concat("head", "body", F.lit(told)).alias("text"))
