"""Scalar functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beats a note can last, in the order that ties go to.
DURATIONS = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0)


def hz_to_midi(hz: Column) -> Column:
    """69 + 12 log2(hz / 440); null where hz is not above 0."""
    return F.when(hz > 0, 69 + 12 * F.log2(hz / 440.0))


def midi_to_hz(midi: Column) -> Column:
    return 440.0 * F.pow(F.lit(2.0), (midi - 69) / 12.0)


def nearest_duration(span: Column) -> Column:
    """The note length nearest to a span of beats (a quarter at least); dotted ones cost 0.04 more, the earlier wins a tie."""
    span = F.greatest(span, F.lit(0.25))
    dotted = {0.75, 1.5, 3.0}
    costs = F.array(*(F.struct((F.abs(span - d) + (0.04 if d in dotted else 0.0)).alias("cost"), F.lit(i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DURATIONS)))
    return F.array_min(costs)["d"]


def stability(spread_cents: Column) -> Column:
    """1 for a steady pitch, 0 from a spread of 50 cents on."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - spread_cents / 50.0))


def sequence_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of two strings with one character for each note; 1 if both are empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def reduced_form(form: Column) -> Column:
    """The shortest unit whose repetition is the form."""
    n = F.length(form)
    unit = F.filter(F.sequence(F.lit(1), n), lambda k: (n % k == 0) & (F.repeat(F.substring(form, F.lit(1), k), (n / k).cast("int")) == form))
    return F.when(n > 0, F.substring(form, F.lit(1), unit[0])).otherwise(form)


def note_confidence(salience: Column, stability: Column, timing: Column, agreement: Column, weights: tuple[float, ...] = (0.30, 0.20, 0.15, 0.35)) -> Column:
    """Weighted mean of four kinds of evidence, each cut to 0 to 1; 0 if the weights are."""
    cut = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    if sum(weights) <= 0:
        return F.lit(0.0)
    total = F.lit(0.0)
    for w, c in zip(weights, (salience, stability, timing, agreement), strict=True):
        total = total + w * cut(c)
    return cut(total / sum(weights))


def timing_score(error: Column, tolerance: float = 0.25) -> Column:
    """1 for a note on the grid, 0 from `tolerance` beats off on."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(error) / max(tolerance, 1e-6)))


def bin_to_midi(place: Column, reference: float = 55.0, cents: float = 10.0) -> Column:
    """A bin of a pitch salience grid, counted from `reference` Hz, as a MIDI number."""
    return 69 + 12 * F.log2(F.lit(reference) * F.pow(F.lit(2.0), place * cents / 1200) / 440)


#: Sharps of the major key on each pitch class (negative: flats), what modes take off, and names.
MAJOR_SHARPS = (0, -5, 2, -3, 4, -1, 6, 1, -4, 3, -2, 5)
MODES = {"major": 0, "mixolydian": -1, "dorian": -2, "minor": -3}
SHARP_NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
FLAT_NAMES = ("C", "D-", "D", "E-", "E", "F", "G-", "G", "A-", "A", "B-", "B")


def key_signature(tonic: Column, mode: Column) -> Column:
    """Sharps (negative: flats) of a mode on a pitch class, those of its major key less what the mode takes off; an unknown mode is major. Within 7 either way."""
    less = F.lit(0)
    for name, by in MODES.items():
        less = F.when(mode == name, by).otherwise(less)
    sharps = F.element_at(F.array(*map(F.lit, MAJOR_SHARPS)), F.pmod(tonic, F.lit(12)).cast("int") + 1) + less
    return F.when(sharps > 7, sharps - 12).when(sharps < -7, sharps + 12).otherwise(sharps)


def key_name(tonic: Column, mode: Column) -> Column:
    """As in "A mixolydian"; with flats where the signature has them."""
    name = lambda names: F.element_at(F.array(*map(F.lit, names)), F.pmod(tonic, F.lit(12)).cast("int") + 1)
    return F.concat_ws(" ", F.when(key_signature(tonic, mode) < 0, name(FLAT_NAMES)).otherwise(name(SHARP_NAMES)), mode)


def parse_key(text: Column) -> Column:
    """struct(tonic, mode) of a name as key_name() gives it; a missing or unknown mode is major, an unknown root gives a null tonic."""
    parts = F.split(F.trim(text), "[ \t]+")
    mode = F.lower(F.get(parts, F.lit(1)))
    place = lambda names: F.nullif(F.array_position(F.array(*map(F.lit, names)), F.get(parts, F.lit(0))), F.lit(0))
    tonic = F.coalesce(place(SHARP_NAMES), place(FLAT_NAMES)) - 1
    return F.struct(tonic.cast("int").alias("tonic"), F.when(mode.isin(*MODES), mode).otherwise("major").alias("mode"))
