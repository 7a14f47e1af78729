"""Sequential algorithms, one group at a time as Arrow batches: a group is a recording, a section or a hypothesis."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lines import BestLine, greedy_labels, separation


class _Level:
    """The pitches of a note so far, of which the last `memory` count, kept sorted."""

    def __init__(self, memory: int, pitch: float):
        self.memory, self.recent, self.ordered = memory, deque([pitch]), [pitch]

    def add(self, pitch: float) -> None:
        self.recent.append(pitch)
        insort(self.ordered, pitch)
        if len(self.recent) > self.memory:
            del self.ordered[bisect_left(self.ordered, self.recent.popleft())]

    def median(self) -> float:
        n = len(self.ordered)
        return (self.ordered[(n - 1) // 2] + self.ordered[n // 2]) / 2


def split_runs(frames: DataFrame, off: float = 0.65, persist: int = 2, memory: int = 64) -> DataFrame:
    """Cuts voiced runs (rec, run, frame, midi) where the pitch leaves the median of the note's last accepted frames by more than `off` for `persist` frames in a row: rec, run, note_start, note_end (exclusive).

    The new note begins with the first of these frames, and its median with the last of them. Runs stream through their
    task frame by frame, so a long one takes no more memory than a short one. Null pitches are left out.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_of, level, away, begin, last = None, None, [], None, None
        for batch in batches:
            out: list[tuple] = []
            for rec, run, frame, midi in zip(*(batch.column(c).to_pylist() for c in ("rec", "run", "frame", "midi")), strict=True):
                if (rec, run) != run_of:
                    if run_of is not None:
                        out.append((*run_of, begin, last + 1))
                    run_of, level, away, begin = (rec, run), _Level(memory, midi), [], frame
                elif abs(midi - level.median()) <= off:
                    level.add(midi)
                    away = []
                else:
                    # with each frame that is away, the one before it, where the note may end
                    away.append((last, frame))
                    if len(away) >= persist:
                        out.append((*run_of, begin, away[0][0] + 1))
                        level, begin, away = _Level(memory, midi), away[0][1], []
                last = frame
            yield _notes(out)
        if run_of is not None:
            yield _notes([(*run_of, begin, last + 1)])

    def _notes(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rec", "run", "note_start", "note_end"])

    typed = frames.select(F.col("rec").cast("long"), F.col("run").cast("long"), F.col("frame").cast("long"), F.col("midi").cast("double")).where("midi is not null")
    return typed.repartition("rec", "run").sortWithinPartitions("rec", "run", "frame").mapInArrow(cut, "rec long, run long, note_start long, note_end long")


def align(pairs: DataFrame) -> DataFrame:
    """pairs(rec, pred, truth), arrays of struct(pitch, beat): the best global alignment's score, its exact, octave and other matches and gaps. A match is worth 2, an octave 0.5, another pitch -1, each less min(2, half the beats apart); a gap costs 1. Ties go to a match, then to a note only in pred."""

    def best(a: list, b: list) -> tuple:
        n, m = len(a), len(b)
        worth = np.zeros((n, m))
        for i in range(n):
            for j in range(m):
                d = abs(a[i]["pitch"] - b[j]["pitch"])
                worth[i, j] = (2.0 if d == 0 else 0.5 if d % 12 == 0 else -1.0) - min(2.0, 0.5 * abs(a[i]["beat"] - b[j]["beat"]))
        s = np.zeros((n + 1, m + 1))
        s[:, 0], s[0, :] = -np.arange(n + 1), -np.arange(m + 1)
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                s[i, j] = max(s[i - 1, j - 1] + worth[i - 1, j - 1], s[i - 1, j] - 1, s[i, j - 1] - 1)
        i, j, exact, octave, other, gaps = n, m, 0, 0, 0, 0
        while i or j:
            if i and j and s[i, j] == s[i - 1, j - 1] + worth[i - 1, j - 1]:
                i, j = i - 1, j - 1
                d = abs(a[i]["pitch"] - b[j]["pitch"])
                exact, octave, other = exact + (d == 0), octave + (d > 0 and d % 12 == 0), other + (d % 12 != 0)
            elif i and s[i, j] == s[i - 1, j] - 1:
                i, gaps = i - 1, gaps + 1
            else:
                j, gaps = j - 1, gaps + 1
        return float(s[n, m]), exact, octave, other, gaps

    def run(batches):
        for batch in batches:
            rows = [best(list(a), list(b)) for a, b in zip(batch["pred"], batch["truth"], strict=True)]
            yield pd.concat([batch[["rec"]].reset_index(drop=True), pd.DataFrame(rows, columns=["score", "exact", "octave", "other", "gaps"])], axis=1)

    return pairs.mapInPandas(run, "rec long, score double, exact long, octave long, other long, gaps long")


@dataclass(frozen=True)
class VoiceCosts:
    """Fixed values, in units of one ordinary note: worth by loudness and length, and what a following note costs."""

    loud: float = 2.0
    ordinary: float = 0.20
    longest: float = 0.60
    step: float = 0.02
    leap_above: float = 5.0
    leap: float = 0.05
    octave: float = 0.40
    octave_from: float = 11.5
    gap: float = 1.00
    overlap: float = 1.50
    restart: float = 0.80


def _voices(back: float, costs: VoiceCosts):
    kinds = [("rec", pa.int64()), ("part", pa.int64()), ("start", pa.float64()), ("end", pa.float64()), ("pitch", pa.int32()), ("worth", pa.float64())]

    def cost(before: tuple, note: tuple) -> float | None:
        if before[0] >= note[0]:
            return None
        far, apart = abs(before[2] - note[2]), note[0] - before[1]
        leap = costs.step * far + costs.leap * max(0.0, far - costs.leap_above) + costs.octave * (far >= costs.octave_from)
        return leap + (costs.gap * apart if apart > 0 else -costs.overlap * apart)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by rec, part, start, end, pitch and amp; a part's line is told when the part ends."""
        now, line = None, None
        for batch in batches:
            out: list[tuple] = []
            for rec, part, *note, amp in zip(*(batch.column(c).to_pylist() for c in ("rec", "part", "start", "end", "pitch", "amp")), strict=True):
                if (rec, part) != now:
                    out += [(*now, *x, line.best[0]) for x in line.items()] if now else []
                    now, line = (rec, part), BestLine(lambda before, note: before[0] >= note[0] - back, cost)
                worth = costs.loud * amp * min(note[1] - note[0], costs.longest) / costs.ordinary
                line.add(tuple(note), worth, worth - costs.restart)
            yield _told(out)
        if now:
            yield _told([(*now, *x, line.best[0]) for x in line.items()])

    def _told(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], [c for c, _ in kinds])

    return run


def select_voice(events: DataFrame, floor: int = 64, back: float = 2.0, costs: VoiceCosts = VoiceCosts()) -> DataFrame:  # noqa: B008
    """events(rec, start, end, pitch, amp): the best single line through the overlapping notes of a recording, of those at `floor` or higher that have a length: rec, start, end, pitch.

    A note is worth its loudness by length; intervals, leaps, octaves, gaps and overlaps cost, and so does a line that
    begins. A note follows one that starts strictly earlier, by `back` seconds at most, so where none does a recording is
    cut: its parts are dealt over tasks and stream through them, and the best part's line is the recording's (the earliest of
    ties).
    """
    by = Window.partitionBy("rec").orderBy("start")
    held = events.select(F.col("rec").cast("long"), F.col("start").cast("double"), F.col("end").cast("double"), F.col("pitch").cast("int"), F.col("amp").cast("double"))
    held = held.where((F.col("pitch") >= floor) & (F.col("end") > F.col("start")))
    parts = held.withColumn("part", F.sum(F.when(F.col("start") - F.lag("start").over(by) <= back, 0).otherwise(1)).over(by))
    dealt = parts.repartition("rec", "part").sortWithinPartitions("rec", "part", "start", "end", "pitch", "amp")
    lines = dealt.mapInArrow(_voices(back, costs), "rec long, part long, start double, end double, pitch int, worth double")
    best = F.min_by("part", F.struct(-F.col("worth"), "part")).over(Window.partitionBy("rec"))
    return lines.withColumn("best", best).where("part = best").select("rec", "start", "end", "pitch")


def leaders(pairs: DataFrame, threshold: float, most: int = 3) -> DataFrame:
    """pairs(rec, i, j, similarity) of a recording's blocks: each block joins the most similar leader at or above the threshold (the later of ties), else leads a group of its own. labels is empty if there are more than `most` groups or fewer than two; quality is the mean similarity within groups less that between them."""

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        n = int(group[["i", "j"]].to_numpy().max()) + 1
        sim = np.eye(n)
        i, j = group["i"].to_numpy(int), group["j"].to_numpy(int)
        sim[i, j] = sim[j, i] = group["similarity"].to_numpy()
        labels, groups = greedy_labels(sim, np.array([threshold]))
        quality = np.subtract(*np.nan_to_num(separation(sim, labels)))[0]
        text = "".join(chr(65 + k) for k in labels[0]) if 2 <= groups[0] <= most else ""
        return pd.DataFrame({"rec": [group["rec"].iloc[0]], "labels": [text], "quality": [float(quality)]})

    return pairs.select(F.col("rec").cast("long"), "i", "j", "similarity").groupBy("rec").applyInPandas(cluster, "rec long, labels string, quality double")
