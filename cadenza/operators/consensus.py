"""One section out of several passes of it: which passes count, what they agree on, and how sure each note is.

A section has a few hundred slots and some ten passes, whatever the corpus, so what belongs to one section is gathered as
one row; sections are dealt over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..storage import stash
from .form import REST
from .sections import measures

#: Slots of a beat, and the slots that a note has at least before a repeated start ends it.
GRID, LEAST = 4, 2
#: Sections that a task holds as arrays at once, and the slots of passes, or pairs of passes, that it compares at once.
ROWS, CELLS = 256, 1 << 20
KEY = ["rec", "label"]


class Sections(NamedTuple):
    """notes: rec, label, seq, pitch (null: rest), start, dur (beats), conf, agreement, alternatives (pitch, share), measure.
    reports: rec, label, reason, passes, used, excluded, scores (block, score against the reference), mean_agreement, repeats, conf."""

    notes: DataFrame
    reports: DataFrame


def _spans(notes: DataFrame, sections: DataFrame) -> DataFrame:
    """notes with n, the slots of their section, and the slots i0 to i1 (exclusive) that they cover."""
    n = F.greatest(F.lit(1), F.rint(F.col("beats") * GRID).cast("int"))
    met = notes.join(sections.select(*KEY, n.alias("n")), KEY)
    first = F.greatest(F.lit(0), F.rint(F.col("start") * GRID)).cast("int")
    last = F.rint((F.col("start") + F.col("dur")) * GRID).cast("int")
    return met.withColumns({"i0": first, "i1": F.least(F.col("n"), F.greatest(first + 1, last))})


def _flat(column: pa.Array, names: tuple[str, ...]) -> tuple[np.ndarray, list[pa.Array]]:
    """The sizes of a column of lists of structs, and fields of all structs, end to end."""
    held = column.flatten()
    return column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), [pc.struct_field(held, c) for c in names]


def _grids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The notes of a pass, one row of arrays, as its slots."""
    for batch in batches:
        size, (seq, i0, i1, pitch) = _flat(batch.column("x"), ("seq", "i0", "i1", "pitch"))
        i1 = pc.if_else(seq.is_valid(), i1, i0)
        seq, i0, i1, pitch = (x.fill_null(REST).to_numpy(zero_copy_only=False).astype(np.int64) for x in (seq, i0, i1, pitch))
        n = batch.column("n").to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(n)), size)
        order = np.lexsort((seq, row))
        long, first = np.maximum(i1 - i0, 0)[order], ((np.cumsum(n) - n)[row] + i0)[order]
        slots = np.full(n.sum(), REST, np.int32)
        # where an index is repeated the last one holds, so a later note hides an earlier one
        slots[np.arange(long.sum()) + np.repeat(first - np.cumsum(long) + long, long)] = np.repeat(pitch[order], long)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(slots))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*KEY, "block", "conf")), lists], [*KEY, "block", "conf", "slots"])


def pass_grids(notes: DataFrame, sections: DataFrame) -> DataFrame:
    """The slots of each pass (rec, label, block) of a section as an array (REST: silent), and conf, its notes' mean confidence. A later note hides an earlier one."""
    rows = _spans(notes, sections).groupBy(*KEY, "block", "n").agg(F.coalesce(F.avg("conf"), F.lit(0.0)).alias("conf"), F.collect_list(F.struct("seq", "i0", "i1", "pitch")).alias("x"))
    return rows.mapInArrow(_grids, "rec long, label string, block long, conf double, slots array<int>")


def _alike(a: np.ndarray, b: np.ndarray, most: int = 2, slack: int = 1) -> np.ndarray:
    """alignment_score() of many pairs of passes of one length, as (slot, pair). Worths are added in the order of the slots, as SQL does."""
    sounds, active = a != REST, b != REST
    reach = range(-most - slack, most + slack + 1)
    # the worth of each slot of a at each turn of b: the same within `slack` 1, an octave off 0.6
    same, octave = [], []
    for by in reach:
        turned = np.roll(b, by, axis=0)
        same.append(a == turned)
        octave.append((turned != REST) & (np.abs(a - turned) % 12 == 0))
    best = np.zeros(a.shape[1])
    for turn in range(-most, most + 1):
        k = turn - reach.start
        some = range(k - slack, k + slack + 1)
        worth = np.where(np.any([same[s] for s in some], axis=0), 1.0, np.where(np.any([octave[s] for s in some], axis=0), 0.6, 0.0))
        worth[~sounds] = 0.0
        total = reduce(add, worth, np.zeros(a.shape[1]))
        count = (sounds | np.roll(active, turn, axis=0)).sum(0)
        best = np.maximum(best, np.where(count == 0, 1.0, total / np.maximum(count, 1)))
    return best


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each section, one row with its passes (all), alike: of each pass the alignment scores of all passes; none where it isn't to be scored."""
    for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
        size, (slots,) = _flat(batch.column("all"), ("slots",))
        length = slots.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        values, at, first = slots.flatten().to_numpy(zero_copy_only=False), np.cumsum(length) - length, np.cumsum(size) - size
        passes = np.where(batch.column("scored").to_numpy(zero_copy_only=False), size, 0)
        sizes = np.repeat(passes, passes)
        mine = np.arange(len(sizes)) + np.repeat(first - np.cumsum(passes) + passes, passes)
        scores = np.zeros(sizes.sum())
        a = np.repeat(mine, sizes)
        b = np.arange(len(a)) + np.repeat(np.repeat(first, passes) - np.cumsum(sizes) + sizes, sizes)
        for n in np.unique(length):
            some = np.flatnonzero((length[a] == n) & (length[b] == n)) if n else []
            step = max(1, CELLS // int(max(n, 1)))
            for pairs in (some[k : k + step] for k in range(0, len(some), step)):
                x, y = (values[at[side[pairs]] + np.arange(n)[:, None]] for side in (a, b))
                scores[pairs] = _alike(x, y)
        inner = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(scores))
        alike = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(passes)), pa.int32()), inner)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*KEY, "all")), alike], [*KEY, "all", "alike"])


def judged_sections(grids: DataFrame, enabled: bool = True, least: int = 2, alike: float = 0.55, weighted: bool = True) -> DataFrame:
    """grids(rec, label, block, conf, slots) to a row for each section: reason, passes, used and excluded (blocks), scores (block, score against the reference pass) and grids (block, slots, weight) of the used.

    The reference is the pass most like the others (0.85) and surest (0.15), the first of ties. voted: it and all passes that
    align with it by `alike` count, if they are `least`; unaligned: else the reference alone. single: where voting isn't
    enabled or passes are fewer than `least`, the surest pass, and nothing is scored.
    """
    rows = grids.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("block", "conf", F.col("slots").cast("array<int>").alias("slots")))).alias("all"))
    kinds = "array<struct<block: bigint, conf: double, slots: array<int>>>"
    typed = rows.select(F.col("rec").cast("long").alias("rec"), F.col("label").cast("string").alias("label"), F.col("all").cast(kinds).alias("all"))
    scored = F.lit(enabled) & (F.size("all") >= least)
    rows = typed.withColumn("scored", scored).mapInArrow(_compared, f"rec long, label string, all {kinds}, alike array<array<double>>")
    mean = lambda xs: F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)).otherwise(1.0)
    likeness = lambda i: F.filter(F.get("alike", i), lambda _, j: j != i)
    votes = F.transform("all", lambda p, i: F.struct(F.round(mean(likeness(i)) * 0.85 + p["conf"] * 0.15, 9).alias("score"), (-p["block"]).alias("order")))
    surest = F.array_max(F.transform("all", lambda p: F.struct(p["conf"].alias("conf"), (-p["block"]).alias("order"))))["order"]
    single = F.lit(not enabled) | (F.size("all") < least)
    chosen = rows.withColumn("single", single).withColumn("reference", -F.when(F.col("single"), surest).otherwise(F.array_max(votes)["order"]))
    chosen = chosen.withColumn("model", F.array_position(F.transform("all", lambda p: p["block"]), F.col("reference")).cast("int") - 1)
    scored = chosen.withColumn("scores", F.transform("all", lambda p, i: F.struct(p["block"].alias("block"), F.when(~F.col("single"), F.round(F.get(F.get("alike", i), F.col("model")), 9)).alias("score"))))
    fits = F.transform(F.filter("scores", lambda x: (x["block"] == F.col("reference")) | (x["score"] >= alike)), lambda x: x["block"])
    scored = scored.withColumn("fits", fits)
    alone = F.col("single") | (F.size("fits") < least)
    scored = scored.withColumn("used", F.when(alone, F.array("reference")).otherwise(F.col("fits")))
    blocks = F.transform("all", lambda p: p["block"])
    weight = (lambda p: F.greatest(F.lit(0.05), p["conf"])) if weighted else (lambda p: F.lit(1.0))
    return scored.select(
        *KEY, F.when(F.col("single"), "single").when(alone, "unaligned").otherwise("voted").alias("reason"), blocks.alias("passes"), "used",
        F.when(F.col("single"), F.array().cast("array<bigint>")).otherwise(F.array_except(blocks, "used")).alias("excluded"), "scores",
        F.transform(F.filter("all", lambda p: F.array_contains("used", p["block"])), lambda p: F.struct(p["block"].alias("block"), p["slots"].alias("slots"), weight(p).alias("weight"))).alias("grids"),
    )


def vote_slots(passes: DataFrame) -> DataFrame:
    """passes(rec, label, block, slots, weight): by weight the pitch class of each slot (or silence), then its octave, agreement (the class's share) and alternatives, of the three heaviest pitches those after the first that lost. Ties go to what an earlier pass has."""
    each = passes.select(*KEY, "block", "weight", F.posexplode("slots").alias("slot", "pitch"))
    of_class = F.when(F.col("pitch") == REST, REST).otherwise(F.pmod("pitch", F.lit(12)))
    tally = each.groupBy(*KEY, "slot", "pitch").agg(F.round(F.sum("weight"), 9).alias("w"), F.min("block").alias("b")).withColumn("pc", of_class)
    rows = tally.groupBy(*KEY, "slot").agg(F.collect_list(F.struct("pitch", "pc", "w", "b")).alias("t"))
    total = F.aggregate("t", F.lit(0.0), lambda a, x: a + x["w"])
    same = lambda pc: F.filter("t", lambda x: x["pc"] == pc)
    weight = lambda xs: F.round(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x["w"]), 9)
    first = lambda xs: F.array_min(F.transform(xs, lambda x: x["b"]))
    classes = F.array_max(F.transform("t", lambda x: F.struct(weight(same(x["pc"])).alias("w"), (-first(same(x["pc"]))).alias("b"), x["pc"].alias("pc"))))
    won = rows.withColumn("total", total).withColumn("class", classes)
    octave = F.array_max(F.transform(F.filter("t", lambda x: x["pc"] == F.col("class.pc")), lambda x: F.struct(x["w"].alias("w"), (-x["b"]).alias("b"), x["pitch"].alias("pitch"))))["pitch"]
    ranked = F.array_sort(F.transform("t", lambda x: F.struct((-x["w"]).alias("w"), x["b"].alias("b"), x["pitch"].alias("pitch"))))
    others = F.filter(F.slice(ranked, 2, 2), lambda x: x["pitch"] != F.col("pitch"))
    won = won.withColumn("pitch", octave)
    return won.select(*KEY, "slot", "pitch", (F.col("class.w") / F.col("total")).alias("agreement"), F.transform(others, lambda x: F.struct(x["pitch"].alias("pitch"), (-x["w"] / F.col("total")).alias("share"))).alias("alternatives"))


def _notes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A section's slots, one row of arrays, as notes. A note lasts while its pitch does; a repeated start ends it once it has LEAST slots; silence under half a beat lengthens the note before."""
    for batch in batches:
        yield from (_notes_of(batch.slice(k, ROWS)) for k in range(0, batch.num_rows, ROWS))


def _notes_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    size, (pitch, starts, alternatives, *values) = _flat(batch.column("x"), ("pitch", "starts", "alternatives", "agreement", "salience", "error"))
    pitch, starts = (x.to_numpy(zero_copy_only=False) for x in (pitch, starts))
    first, values = np.cumsum(size) - size, np.array([x.to_numpy(zero_copy_only=False) for x in values])
    # one slot of all sections at a time; plain sums in the order of the slots, as SQL has them
    order = np.argsort(-size, kind="stable")
    begin, total, begins = first.copy(), np.zeros((3, len(size))), np.zeros(len(pitch), bool)
    sums = np.zeros((3, len(pitch)))
    for s in range(size.max(initial=0)):
        live = order[: np.searchsorted(-size[order], -s)]  # sections of more than s slots
        at = first[live] + s
        new = np.full(len(at), True) if s == 0 else (pitch[at] != pitch[at - 1]) | starts[at] & (at - begin[live] >= LEAST)
        begin[live], begins[at] = np.where(new, at, begin[live]), new
        sums[:, at] = total[:, live] = np.where(new, 0.0, total[:, live]) + values[:, at]
    at = np.flatnonzero(begins)
    ends = np.append(at[1:], len(pitch))
    slots, section = ends - at, np.searchsorted(np.cumsum(size), at, side="right")
    silent, dur = pitch[at] == REST, slots / GRID
    kept = ~(silent & (dur < 0.5))
    before = np.cumsum(kept) - 1  # of each note the last one kept
    held = np.flatnonzero(kept)
    of = section[held]
    lifts = np.flatnonzero(~kept & (before >= 0))
    lifts = lifts[of[before[lifts]] == section[lifts]]
    made = dur[held]
    np.add.at(made, before[lifts], dur[lifts])
    at, slots, silent = at[held], slots[held], silent[held]
    others = alternatives.take(pa.array(at))
    lengths = others.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = others.flatten()
    heard = (pc.struct_field(flat, "pitch").to_numpy(zero_copy_only=False) != REST) & ~np.repeat(silent, lengths)
    counts = np.bincount(np.repeat(np.arange(len(at)), lengths)[heard], minlength=len(at))
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), flat.filter(pa.array(heard)))
    rank = np.arange(len(at)) - np.searchsorted(of, of)
    keys = [batch.column(c).take(pa.array(of)) for c in KEY]
    means = [pa.array(sums[c, at + slots - 1] / slots) for c in range(3)]
    columns = [*keys, pa.array(rank, pa.int64()), pa.array(pitch[at].astype(np.int32), pa.int32(), mask=silent), pa.array((at - first[of]) / GRID), pa.array(made), pa.array(slots, pa.int64()), *means, lists]
    return pa.RecordBatch.from_arrays(columns, [*KEY, "seq", "pitch", "start", "dur", "slots", "agreement", "salience", "error", "alternatives"])


def _mean(df: DataFrame, order: str, value: str) -> DataFrame:
    """The mean of each section's values, summed in their order, so that reruns agree to the last digit."""
    rows = df.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("x"))
    return rows.select(*KEY, (F.aggregate("x", F.lit(0.0), lambda a, x: a + x) / F.size("x")).alias(value))


def bar_layout_of(sections: DataFrame) -> DataFrame:
    """sections(rec, label, beats, beats_per_bar, and where known bars and odd) with bars and odd: where they aren't known, whole bars, and an odd one for what is left over."""
    full = F.floor(F.col("beats") / F.col("beats_per_bar")).cast("int")
    rest = F.col("beats") - full * F.col("beats_per_bar")
    left = (rest >= 1e-6) & (full > 0)
    known = F.col("bars").isNotNull()
    return sections.select(*KEY, "beats_per_bar", F.when(known, F.col("bars")).otherwise(F.greatest(F.lit(1), full + left.cast("int"))).alias("bars"), F.when(known, F.col("odd")).when(left, rest).alias("odd"))


def build_sections(notes: DataFrame, sections: DataFrame, enabled: bool = True, least: int = 2, alike: float = 0.55, weighted: bool = True, share: float = 0.5) -> Sections:
    """notes(rec, label, block, seq, start, dur, pitch, conf, error), beats from the start of their pass (block), and sections(rec, label, beats, beats_per_bar, bars, odd) to one canonical section each.

    error is how far a note was moved onto the grid, in beats. A note starts anew where `share` of all passes start one. Its
    confidence weighs its salience (the confidence of what was heard there), its length, its timing and the agreement of the
    passes; alternatives are what passes had in its first slot and lost. bars and odd (null: none known) are the barring, of
    which only the order is chosen. Passes without notes don't count. See judged_sections() for the others.
    Recordings' sections are dealt over tasks; five tables are written to the shared folder on the way.
    """
    typed = notes.select(F.col("rec").cast("long").alias("rec"), F.col("label").cast("string").alias("label"), F.col("block").cast("long").alias("block"), F.col("seq").cast("long").alias("seq"), *(F.col(c).cast("double").alias(c) for c in ("start", "dur", "conf", "error")), F.col("pitch").cast("int").alias("pitch"))
    sections = sections.select(F.col("rec").cast("long").alias("rec"), F.col("label").cast("string").alias("label"), F.col("beats").cast("double").alias("beats"), F.col("beats_per_bar").cast("int").alias("beats_per_bar"), F.col("bars").cast("int").alias("bars"), F.col("odd").cast("double").alias("odd"))
    # both are read several times, and what they come from is often a long way
    typed, sections = stash(typed), stash(sections)
    judged = stash(judged_sections(pass_grids(typed, sections), enabled, least, alike, weighted))
    voted = stash(vote_slots(judged.select(*KEY, F.inline("grids"))))

    spans = _spans(typed, sections).join(judged.select(*KEY, "used", F.size("passes").alias("passes")), KEY)
    counted = spans.where(F.array_contains("used", F.col("block")) & (F.col("i0") < F.col("i1"))).withColumn("slot", F.explode(F.sequence("i0", F.col("i1") - 1)))
    evidence = counted.groupBy(*KEY, "slot").agg(F.avg("conf").alias("salience"), F.avg("error").alias("error"))
    begun = spans.select(*KEY, "block", "n", "passes", F.rint(F.col("start") * GRID).cast("int").alias("slot")).where("slot >= 0 and slot < n").distinct()
    begun = begun.groupBy(*KEY, "slot", "passes").agg(F.count("*").alias("votes")).where(F.col("votes") >= F.greatest(F.lit(1.0), share * F.col("passes"))).select(*KEY, "slot", F.lit(True).alias("starts"))

    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    slot = F.struct("slot", "pitch", "agreement", zero("salience"), zero("error"), F.coalesce("starts", F.lit(False)).alias("starts"), "alternatives")
    rows = voted.join(evidence, [*KEY, "slot"], "left").join(begun, [*KEY, "slot"], "left").groupBy(*KEY).agg(F.array_sort(F.collect_list(slot)).alias("x"))
    made = rows.mapInArrow(_notes, "rec long, label string, seq long, pitch int, start double, dur double, slots long, agreement double, salience double, error double, alternatives array<struct<pitch: int, share: double>>")
    sure = F.when(F.col("pitch").isNull(), F.col("agreement")).otherwise(fn.note_confidence(F.col("salience"), F.col("slots") / 2, fn.timing_score(F.col("error")), F.col("agreement")))
    made = stash(made.withColumn("conf", sure).drop("slots", "salience", "error"))
    both = F.struct("rec", "label").alias("rec")
    barred = measures(made.select(both, "seq", "pitch", "start", "dur", "conf", "agreement", "alternatives"), bar_layout_of(sections).select(both, "beats_per_bar", "bars", "odd"))
    barred = barred.select("rec.rec", "rec.label", "seq", "pitch", "start", "dur", "conf", "agreement", "alternatives", "measure")

    agreed, sure = _mean(voted, "slot", "agreement").withColumnRenamed("agreement", "agreed"), _mean(made, "seq", "conf")
    reports = judged.drop("grids").join(agreed, KEY).join(sure, KEY, "left").withColumn("passes", F.size("passes"))
    return Sections(barred, reports.select(*KEY, "reason", "passes", "used", "excluded", "scores", F.when(F.col("reason") == "single", 0.0).otherwise(F.col("agreed")).alias("mean_agreement"), F.when(F.col("passes") >= 2, 2).otherwise(1).alias("repeats"), F.coalesce("conf", F.lit(0.0)).alias("conf")))
