"""One melodic line out of many pitch candidates: a path over fragments, and a path over the candidates of each frame.

Both are best paths, and both are cut where no path can cross or where a matrix can stand for what lies between, so that
one long recording is the work of many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stash
from .cleaning import persistence
from .lines import BestLine


@dataclass(frozen=True)
class LineCosts:
    """What a candidate is worth and what moving on costs.

    salience, height: worth of loudness, and of lying high among the recording's pitches; drone: off for a pitch that is held;
    continuity: for a semitone beyond free; octave: for a leap of about 12. A held pitch counts in units of drone_seconds, and
    a fragment of more than that within still semitones keeps drone_share of its worth. Fragments up to reach seconds apart
    follow each other, at pause for a second. Frames below voiced times the usual loudness are silent.
    """

    salience: float = 1.0
    height: float = 0.8
    drone: float = 2.2
    continuity: float = 1.4
    free: float = 0.4
    octave: float = 1.5
    drone_seconds: float = 2.5
    still: float = 0.5
    drone_share: float = 0.05
    reach: float = 2.0
    pause: float = 0.5
    between: float = 0.25
    voiced: float = 0.35


COSTS = LineCosts()


def movement_cost(semitones: Column, costs: LineCosts = COSTS, scale: float = 1.0) -> Column:
    """What a step of that size costs: free at first, then by the semitone (times scale), and more about an octave."""
    size = F.abs(semitones)
    return costs.continuity * scale * F.greatest(F.lit(0.0), size - costs.free) + costs.octave * (F.abs(size - 12) < 1).cast("int")


def _moved(size: np.ndarray, costs: LineCosts) -> np.ndarray:
    return costs.continuity * np.maximum(0.0, size - costs.free) + costs.octave * (np.abs(size - 12) < 1)


def quantile(values: Column, q: float) -> Column:
    """The q-quantile of an array by interpolation between neighbours; null values don't count, null if there are none."""
    kept = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    at = (F.size(kept) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    below, above = F.get(kept, low), F.get(kept, F.least(low + 1, F.size(kept) - 1))
    return below + (above - below) * (at - low)


def fragment_worth(fragments: DataFrame, hop: float, costs: LineCosts = COSTS) -> DataFrame:
    """fragments(rec, frag, start, pitch array, salience array) with end (exclusive), middle (median pitch) and worth: loudness and height by length, little for a long still one."""
    n = F.size("pitch")
    shaped = fragments.withColumns({"end": F.col("start") + n, "middle": quantile(F.col("pitch"), 0.5), "spread": F.when(n > 2, quantile(F.col("pitch"), 0.9) - quantile(F.col("pitch"), 0.1)).otherwise(0.0)})
    loud = F.when(F.size("salience") > 0, F.aggregate("salience", F.lit(0.0), lambda a, x: a + x) / F.size("salience")).otherwise(0.0)
    limits = shaped.groupBy("rec").agg(F.percentile("middle", F.lit(0.1)).alias("low"), F.percentile("middle", F.lit(0.9)).alias("high"))
    height = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("middle") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-6))))
    seconds = n * F.lit(hop)
    share = F.when((seconds > costs.drone_seconds) & (F.col("spread") < costs.still), costs.drone_share).otherwise(1.0)
    worth = seconds * (costs.salience * loud + costs.height * height) * share
    return shaped.join(limits, "rec").withColumn("worth", worth).drop("low", "high", "spread")


def _best_fragments(hop: float, costs: LineCosts):
    kinds = [("rec", pa.int64()), ("island", pa.int64()), ("frag", pa.int64()), ("place", pa.int64()), ("last", pa.int64()), ("total", pa.float64())]

    def in_reach(before: tuple, fragment: tuple) -> bool:
        return (fragment[1] - before[2]) * hop <= costs.reach

    def cost(before: tuple, fragment: tuple) -> float | None:
        if before[1] >= fragment[1]:
            return None
        leap = abs(fragment[3] - before[3])
        return costs.continuity * costs.between * max(0.0, leap - costs.free) + costs.octave * (abs(leap - 12) < 1) + costs.pause * max(0, fragment[1] - before[2]) * hop

    def told(now: tuple, line: BestLine) -> list[tuple]:
        return [(*now, x[0], place, line.best[1], line.best[0]) for place, x in enumerate(line.items())]

    def rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], [c for c, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by rec, island, start, frag; an island's line is told when the island ends."""
        now, line = None, None
        for batch in batches:
            out: list[tuple] = []
            for rec, island, *fragment, worth in zip(*(batch.column(c).to_pylist() for c in ("rec", "island", "frag", "start", "end", "middle", "worth")), strict=True):
                if (rec, island) != now:
                    out += told(now, line) if now else []
                    now, line = (rec, island), BestLine(in_reach, cost)
                line.add(tuple(fragment), worth, worth, rank=fragment[0])
            yield rows(out)
        if now:
            yield rows(told(now, line))

    return run


def decode_fragments(fragments: DataFrame, hop: float, costs: LineCosts = COSTS) -> DataFrame:
    """fragments(rec, frag, start frame, pitch array, salience array of as many) that may overlap, to the best line through them: rec, frame, midi, conf.

    A fragment is followed by one that starts later, up to costs.reach after its end. No line crosses a longer silence, so a
    recording falls into islands that are decoded apart; the island with the best line gives the recording's (of ties, the
    one whose line ends with the smaller frag). Where chosen fragments overlap the later holds. conf is salience by the
    line's largest. Frames before 0 and fragments without pitches are left out; a null pitch leaves its frame to the fragment before.
    """
    typed = fragments.select(F.col("rec").cast("long").alias("rec"), F.col("frag").cast("long").alias("frag"), F.col("start").cast("long").alias("start"), F.col("pitch").cast("array<double>").alias("pitch"), F.col("salience").cast("array<double>").alias("salience"))
    held = fragment_worth(typed.where(F.exists("pitch", lambda p: p.isNotNull())), hop, costs)
    by = Window.partitionBy("rec").orderBy("start", "frag")
    reached = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(((F.col("start") - reached) * F.lit(hop) > costs.reach).cast("int"), F.lit(1))
    islands = held.withColumn("apart", apart).withColumn("island", F.sum("apart").over(by))
    order = ["rec", "island"]
    dealt = islands.select("rec", "island", "frag", "start", "end", "middle", "worth").repartition(*order).sortWithinPartitions(*order, "start", "frag")
    lines = dealt.mapInArrow(_best_fragments(hop, costs), "rec long, island long, frag long, place long, last long, total double")
    best = F.min_by("island", F.struct(-F.col("total"), "last")).over(Window.partitionBy("rec"))
    chosen = lines.withColumn("best", best).where("island = best").select("rec", "frag", "place")
    spoken = F.when(F.size("salience") >= F.size("pitch"), F.get("salience", F.col("i"))).otherwise(F.aggregate("salience", F.lit(0.0), lambda a, x: a + x) / F.size("salience"))
    each = chosen.join(typed, ["rec", "frag"]).select("rec", "place", "start", "salience", "pitch", F.posexplode("pitch").alias("i", "midi"))
    each = each.select("rec", "place", (F.greatest("start", F.lit(0)) + F.col("i")).alias("frame"), "midi", F.coalesce(spoken, F.lit(0.0)).alias("conf")).where("midi is not null")
    line = each.groupBy("rec", "frame").agg(F.max_by(F.struct("midi", "conf"), "place").alias("x")).select("rec", "frame", "x.midi", "x.conf")
    peak = F.max("conf").over(Window.partitionBy("rec"))
    return line.withColumn("conf", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("conf") / F.when(peak > 0, peak).otherwise(1.0))))


def candidate_scores(candidates: DataFrame, hop: float, costs: LineCosts = COSTS) -> DataFrame:
    """candidates(rec, frame, k, midi, salience) with score: loudness on a log scale and height, less how long the pitch is held."""
    whole = candidates.groupBy("rec").agg(F.min("midi").alias("lowest"), F.percentile("midi", F.lit(0.1)).alias("low"), F.percentile("midi", F.lit(0.9)).alias("high"), F.percentile("salience", F.lit(0.95)).alias("loud"))
    placed = candidates.join(whole, "rec")
    held = persistence(placed, hop, bins=F.floor((F.col("midi") - F.col("lowest")) / 0.5)).select("rec", "frame", "midi", "held").distinct()
    loud = F.when(F.col("loud") == 0, 1.0).otherwise(F.col("loud"))
    strength = F.log1p(F.greatest(F.lit(0.0), F.col("salience")) / loud * 9) / F.log(F.lit(10.0))
    height = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("midi") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-6))))
    drone = F.least(F.lit(2.0), F.col("held") / costs.drone_seconds)
    return placed.join(held, ["rec", "frame", "midi"]).select("rec", "frame", "k", "midi", "salience", (costs.salience * strength + costs.height * height - costs.drone * drone).alias("score"))


def _lattice(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], tuple]]:
    """Of rows sorted by rec, run, block and frame each block: its key, (frame, midi, salience, score) of its frames, and its (entry, leave)."""
    key, rows, ends = None, [], ()
    for batch in batches:
        for rec, run, block, frame, line, entry, leave in zip(*(batch.column(c).to_pylist() for c in ("rec", "run", "block", "frame", "line", "entry", "leave")), strict=True):
            if (rec, run, block) != key:
                if key:
                    yield key, rows, ends
                key, rows, ends = (rec, run, block), [], (entry, leave)
            rows.append((frame, *(np.array([x[c] for x in line]) for c in ("midi", "salience", "score"))))
    if key:
        yield key, rows, ends


def _walk(rows: list, start: np.ndarray, costs: LineCosts) -> tuple[np.ndarray, list[np.ndarray]]:
    """Best scores of the last frame's candidates, from start, those of the first, and for each later frame which candidate comes before. start may have several rows, each a start of its own."""
    score, back = start, []
    for (_, before, _, _), (_, midi, _, own) in zip(rows, rows[1:], strict=False):
        total = score[..., :, None] - _moved(np.abs(midi[None, :] - before[:, None]), costs)
        back.append(total.argmax(-2))
        score = total.max(-2) + own
    return score, back


def _walk_runs(first: np.ndarray, size: np.ndarray, cuts: np.ndarray, midi: np.ndarray, score: np.ndarray, costs: LineCosts) -> np.ndarray:
    """The best line through each of many runs of frames at once, as _walk() finds it: the candidate of each frame. Run r has the frames first[r] and on, size[r] of them; frame f has the candidates from cuts[f] to cuts[f + 1]."""
    most = int(np.diff(cuts).max())
    places = cuts[:-1, None] + np.arange(most)
    none = places >= cuts[1:, None]
    places = np.minimum(places, len(midi) - 1)
    pitch, own = np.where(none, 0.0, midi[places]), np.where(none, -np.inf, score[places])
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    best, came = own[first], np.zeros((len(cuts) - 1, most), int)
    for step in range(1, int(size[0])):
        live = int(np.searchsorted(-size, -step))
        at = first[:live] + step
        total = best[:live, :, None] - _moved(np.abs(pitch[at][:, None, :] - pitch[at - 1][:, :, None]), costs)
        came[at] = total.argmax(1)
        best[:live] = total.max(1) + own[at]
    chosen, k = np.zeros(len(cuts) - 1, int), best.argmax(1)
    for step in range(int(size[0]) - 1, -1, -1):
        live = int(np.searchsorted(-size, -step))
        at = first[:live] + step
        chosen[at] = k[:live]
        k[:live] = came[at, k[:live]]
    return chosen


def decode_candidates(candidates: DataFrame, hop: float, costs: LineCosts = COSTS, block: int = 4096) -> DataFrame:
    """candidates(rec, frame, k from 0, midi, salience), several for each frame, to the best line through them: rec, frame, midi, conf.

    Frames without candidates end a line, so runs of frames are decoded apart. A run of more than `block` frames is cut: of
    each block a matrix says what the best way from each of its first candidates to each of its last is worth, a pass over
    these matrices finds where the best line enters and leaves each block, and the blocks are then walked at once. Of ties
    the smaller k holds. Chosen candidates below costs.voiced times the median of the line's are left out; conf is salience
    by the line's largest. Null pitches aren't candidates. Runs that aren't cut are walked many at once. Two tables are written to
    the shared folder on the way.
    """
    typed = candidates.select(F.col("rec").cast("long").alias("rec"), F.col("frame").cast("long").alias("frame"), F.col("k").cast("long").alias("k"), F.col("midi").cast("double").alias("midi"), F.coalesce(F.col("salience").cast("double"), F.lit(0.0)).alias("salience")).where("midi is not null")
    scored = candidate_scores(typed, hop, costs)
    lattice = scored.groupBy("rec", "frame").agg(F.array_sort(F.collect_list(F.struct("k", "midi", "salience", "score"))).alias("line"))
    by = Window.partitionBy("rec").orderBy("frame")
    lattice = lattice.withColumn("run", F.col("frame") - F.row_number().over(by) + 1)
    whole = Window.partitionBy("rec", "run")
    lattice = lattice.withColumn("block", F.floor((F.col("frame") - F.min("frame").over(whole)) / block)).withColumn("blocks", F.max("block").over(whole) + 1)
    lattice = stash(lattice)
    order = ["rec", "run", "block"]
    columns = "rec long, run long, block long, "

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows, _ in _lattice(batches):
            first, last = rows[0], rows[-1]
            start = np.where(np.eye(len(first[1]), dtype=bool), first[3], -np.inf)
            made = {"gain": _walk(rows, start, costs)[0].ravel().tolist(), "first": first[1].tolist(), "last": last[1].tolist()}
            yield pa.RecordBatch.from_pylist([dict(zip(order, key, strict=True)) | made], pa.schema([*((c, pa.int64()) for c in order), ("gain", pa.list_(pa.float64())), ("first", pa.list_(pa.float64())), ("last", pa.list_(pa.float64()))]))

    def bounds(key: tuple, group: pa.Table) -> pa.Table:
        """Where the best line enters and leaves each block of one run."""
        cells = sorted(group.to_pylist(), key=lambda r: r["block"])
        score, ways = None, []
        for cell in cells:
            first, last = np.array(cell["first"]), np.array(cell["last"])
            gain = np.array(cell["gain"]).reshape(len(first), len(last))
            if score is None:
                enter, came = np.zeros(len(first)), np.full(len(first), -1)
            else:
                total = score[:, None] - _moved(np.abs(first[None, :] - before[:, None]), costs)
                enter, came = total.max(0), total.argmax(0)
            total = enter[:, None] + gain
            ways.append((came, total.argmax(0)))
            score, before = total.max(0), last
        k, found = int(score.argmax()), []
        for cell, (came, entry) in zip(reversed(cells), reversed(ways), strict=True):
            found.append((cell["rec"], cell["run"], cell["block"], int(entry[k]), k))
            k = int(came[entry[k]])
        return pa.table([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], [*order, "entry", "leave"])

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (rec, _, _), rows, (entry, leave) in _lattice(batches):
            start = rows[0][3].copy()
            if entry is not None:
                start[np.arange(len(start)) != entry] = -np.inf
            score, back = _walk(rows, start, costs)
            k, ways = int(score.argmax()) if leave is None else leave, []
            for step in reversed(back):
                ways.append(k)
                k = int(step[k])
            ways = [*ways, k][::-1]
            picked = [(rec, row[0], row[1][k], row[2][k]) for row, k in zip(rows, ways, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*picked, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["rec", "frame", "midi", "conf"])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by rec, run and frame, none of them of a run that is cut: a batch's whole runs are walked together, the last waits for the next batch."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rec, run = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rec", "run"))
            last = int(np.flatnonzero((rec != rec[-1]) | (run != run[-1]))[-1]) + 1 if (rec[0], run[0]) != (rec[-1], run[-1]) else 0
            if held and (last or (held[-1].column("rec")[-1].as_py(), held[-1].column("run")[-1].as_py()) != (rec[0], run[0])):
                yield lines(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            elif last:
                yield lines(pa.Table.from_batches([batch.slice(0, last)]))
            held.append(batch.slice(last))
        if held:
            yield lines(pa.Table.from_batches(held))

    def lines(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        rec, run, frame = (table.column(c).to_numpy() for c in ("rec", "run", "frame"))
        line = table.column("line").combine_chunks()
        cuts = np.append(0, np.cumsum(line.value_lengths().to_numpy(zero_copy_only=False))).astype(int)
        items = line.flatten()
        midi, salience, score = (pc.struct_field(items, c).to_numpy(zero_copy_only=False) for c in ("midi", "salience", "score"))
        first = np.flatnonzero(np.append(True, (rec[1:] != rec[:-1]) | (run[1:] != run[:-1])))
        k = _walk_runs(first, np.diff(np.append(first, len(rec))), cuts, midi, score, costs) + cuts[:-1]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((rec, pa.int64()), (frame, pa.int64()), (midi[k], pa.float64()), (salience[k], pa.float64()))], ["rec", "frame", "midi", "conf"])

    free = {"entry": F.lit(None).cast("long"), "leave": F.lit(None).cast("long")}
    dealt = lambda rows: rows.select(*order, "frame", "line", "entry", "leave").repartition(*order).sortWithinPartitions(*order, "frame")
    long = lattice.where("blocks > 1").withColumns(free)
    gains = dealt(long).mapInArrow(matrices, columns + "gain array<double>, first array<double>, last array<double>")
    ends = gains.groupBy("rec", "run").applyInArrow(bounds, columns + "entry long, leave long")
    cut = long.drop("entry", "leave").join(ends, order)
    told = "rec long, frame long, midi double, conf double"
    whole_runs = lattice.where("blocks = 1").select("rec", "run", "frame", "line").repartition("rec", "run").sortWithinPartitions("rec", "run", "frame").mapInArrow(short, told)
    line = stash(whole_runs.unionByName(dealt(cut.select(*lattice.columns, "entry", "leave")).mapInArrow(walked, told)))
    usual = line.where("conf > 0").groupBy("rec").agg(F.percentile("conf", F.lit(0.5)).alias("usual"))
    peak = line.groupBy("rec").agg(F.max("conf").alias("peak"))
    heard = line.join(peak, "rec").join(usual, "rec", "left").where("usual is null or conf >= " + str(costs.voiced) + " * usual")
    return heard.select("rec", "frame", "midi", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("conf") / F.when(F.col("peak") > 0, F.col("peak")).otherwise(1.0))).alias("conf"))
