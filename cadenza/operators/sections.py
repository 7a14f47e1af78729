"""Passes of one section: their reference, the notes they agree on, bars, chords, confidence and scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .form import REST, alignment_score


def mean_by_slot(notes: DataFrame, column: str, n: int, grid: int = 4) -> DataFrame:
    """The mean of a column over the notes (rec, block, start, dur) that cover each of n slots, all passes together; slots without notes are left out."""
    first = F.greatest(F.lit(0), F.rint(F.col("start") * grid)).cast("int")
    last = F.least(F.lit(n), F.greatest(first + 1, F.rint((F.col("start") + F.col("dur")) * grid).cast("int")))
    held = notes.withColumns({"i0": first, "i1": last}).where("i0 < i1")
    return held.withColumn("slot", F.explode(F.sequence("i0", F.col("i1") - 1))).groupBy("rec", "slot").agg(F.avg(column).alias(column))


def restarts(notes: DataFrame, n: int, share: float = 0.5, grid: int = 4) -> DataFrame:
    """Slots where a note starts in at least `share` of a recording's passes, and in one."""
    passes = notes.groupBy("rec").agg(F.countDistinct("block").alias("passes"))
    marks = notes.select("rec", "block", F.rint(F.col("start") * grid).cast("int").alias("slot")).where(F.col("slot").between(0, n - 1)).distinct()
    votes = marks.groupBy("rec", "slot").agg(F.count("*").alias("votes"))
    return votes.join(passes, "rec").where(F.col("votes") >= F.greatest(F.lit(1.0), share * F.col("passes"))).select("rec", "slot", "votes")


def reference_pass(passes: DataFrame) -> DataFrame:
    """passes(rec, label, block, slots array, conf): of each label the pass most like the others (0.85) and surest (0.15), the first of ties. Passes of one label in one recording are few; only they meet."""
    a, b = passes.alias("a"), passes.select("rec", "label", "block", "slots").alias("b")
    met = a.join(b, (F.col("a.rec") == F.col("b.rec")) & (F.col("a.label") == F.col("b.label")) & (F.col("a.block") != F.col("b.block")), "left")
    likeness = met.groupBy("a.rec", "a.label", "a.block").agg(F.avg(F.when(F.col("b.block").isNotNull(), alignment_score(F.col("a.slots"), F.col("b.slots")))).alias("alike"), F.first("a.conf").alias("conf"))
    score = F.coalesce(F.col("alike"), F.lit(1.0)) * 0.85 + F.col("conf") * 0.15
    scored = likeness.withColumn("score", F.round(score, 9))
    return scored.groupBy("rec", "label").agg(F.max_by("block", F.struct("score", -F.col("block"))).alias("block"), F.max("score").alias("score"))


def slot_notes(votes: DataFrame, marks: DataFrame, n: int, grid: int = 4, least: int = 2) -> DataFrame:
    """votes(rec, slot, pitch, agreement) and restart marks(rec, slot) as notes: rec, seq, pitch (null: rest), start, dur (beats), agreement.

    A note lasts while its pitch does; a mark splits it once it has `least` slots. Silence of less than half a beat lengthens the note before it.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        pitch, agree, mark = np.full(n, REST), np.zeros(n), np.zeros(n, dtype=bool)
        voted = group[group["pitch"].notna()]
        pitch[voted["slot"]], agree[voted["slot"]] = voted["pitch"].astype(int), voted["agreement"]
        mark[group.loc[group["mark"], "slot"]] = True
        out, at = [], 0
        for s in range(1, n + 1):
            if s < n and pitch[s] == pitch[at] and not (mark[s] and s - at >= least):
                continue
            beats = (s - at) / grid
            if pitch[at] != REST:
                out.append([int(pitch[at]), at / grid, beats, float(agree[at:s].mean())])
            elif beats >= 0.5:
                out.append([None, at / grid, beats, float(agree[at:s].mean())])
            elif out:
                out[-1][2] += beats
            at = s
        made = pd.DataFrame(out, columns=["pitch", "start", "dur", "agreement"])
        made["pitch"] = made["pitch"].astype("Int64")
        made.insert(0, "seq", range(len(made)))
        made.insert(0, "rec", group["rec"].iloc[0])
        return made

    both = votes.select("rec", "slot", "pitch", "agreement").join(marks.select("rec", "slot", F.lit(True).alias("mark")), ["rec", "slot"], "full")
    typed = both.select(F.col("rec").cast("long"), F.col("slot").cast("int"), F.col("pitch").cast("double"), F.col("agreement").cast("double"), F.coalesce("mark", F.lit(False)).alias("mark"))
    return typed.where(F.col("slot").between(0, n - 1)).groupBy("rec").applyInPandas(fold, "rec long, seq long, pitch int, start double, dur double, agreement double")


def measures(notes: DataFrame, layouts: DataFrame) -> DataFrame:
    """notes(rec, seq, start, dur) with measure, from 1, by layouts(rec, beats_per_bar, bars, odd): the odd bar, if any, stands where the fewest notes cross a barline (the first of ties)."""
    each = layouts.withColumn("at", F.explode(F.when(F.col("odd").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("bars") - 1))))
    edge = lambda k: k * F.col("beats_per_bar") + F.when((F.col("at") >= 0) & (k > F.col("at")), F.col("odd") - F.col("beats_per_bar")).otherwise(0)
    each = each.withColumn("edges", F.transform(F.sequence(F.lit(1), F.col("bars")), edge)).select("rec", "at", "edges")
    met = notes.join(each, "rec")
    crossed = F.exists("edges", lambda e: (F.col("start") + 1e-9 < e) & (F.col("start") + F.col("dur") - 1e-9 > e))
    costs = met.groupBy("rec", "at").agg(F.sum(crossed.cast("int")).alias("cost"), F.first("edges").alias("edges"))
    best = costs.groupBy("rec").agg(F.min_by("edges", F.struct("cost", "at")).alias("edges"))
    before = F.size(F.filter("edges", lambda e: e <= F.col("start") + 1e-9))
    return notes.join(best, "rec").withColumn("measure", F.least(before + 1, F.size("edges"))).drop("edges")


def plain_sections(notes: DataFrame, beats_per_bar: int = 4) -> DataFrame:
    """notes(rec, start, ...) in one section: measure from 1 at the first bar that has a note."""
    bar = F.floor(F.col("start") / beats_per_bar)
    return notes.withColumn("measure", bar - F.min(bar).over(Window.partitionBy("rec")) + 1)


def chord_tones(bars: DataFrame) -> DataFrame:
    """bars(rec, bar, tonic, pitch): the chord of I, IV and V with the most notes of the bar, the first of ties."""
    pc = F.pmod(F.col("pitch") - F.col("tonic"), F.lit(12))
    hits = [F.sum(pc.isin(*((root + i) % 12 for i in (0, 4, 7))).cast("int")) for root in (0, 5, 7)]
    counted = bars.groupBy("rec", "bar", "tonic").agg(*(h.alias(c) for h, c in zip(hits, ("one", "four", "five"), strict=True)))
    chord = F.when((F.col("one") >= F.col("four")) & (F.col("one") >= F.col("five")), "I").when(F.col("four") >= F.col("five"), "IV").otherwise("V")
    return counted.select("rec", "bar", chord.alias("chord"), F.greatest("one", "four", "five").alias("hits"))


def section_scores(aligned: DataFrame) -> DataFrame:
    """aligned(rec, exact, octave, n_truth): pitch and pitch-class accuracy, and the rate of octave errors."""
    share = lambda c: c / F.greatest(F.lit(1), F.col("n_truth"))
    return aligned.select("rec", "n_truth", share(F.col("exact")).alias("pitch"), share(F.col("exact") + F.col("octave")).alias("pitch_class"), share(F.col("octave")).alias("octave_rate"))


def total_score(scores: DataFrame) -> DataFrame:
    """Section scores of a corpus, weighted by the notes of the truth, and their plain means."""
    weighted = lambda c: (F.sum(F.col(c) * F.col("n_truth")) / F.nullif(F.sum("n_truth"), F.lit(0))).alias(c)
    return scores.agg(*(weighted(c) for c in ("pitch", "pitch_class", "octave_rate")), F.avg("pitch").alias("mean_pitch"), F.count("*").alias("sections"))


def match_sections(pairs: DataFrame) -> DataFrame:
    """pairs(rec, truth, pred, similarity): in order of truth, each takes the most similar section still free (the first of ties). A recording has a handful of sections."""

    def take(group: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for truth, some in group.sort_values(["truth", "similarity", "pred"], ascending=[True, False, True]).groupby("truth", sort=True):
            free = some[~some["pred"].isin(used)]
            if len(free):
                used.add(free["pred"].iloc[0])
                out.append((group["rec"].iloc[0], truth, free["pred"].iloc[0], free["similarity"].iloc[0]))
        return pd.DataFrame(out, columns=["rec", "truth", "pred", "similarity"])

    return pairs.select(F.col("rec").cast("long"), F.col("truth").cast("string"), F.col("pred").cast("string"), "similarity").groupBy("rec").applyInPandas(take, "rec long, truth string, pred string, similarity double")
