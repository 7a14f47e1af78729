"""What a transcription got right: notes aligned to those of the truth, and scores of sections, recordings and confidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..storage import stash
from .music import auc

#: Beats that an onset may be off, and the confidence below which a note is flagged.
ONSET, UNSURE = 0.3, 0.7


def _paths(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best alignments of many pairs of one shape, pitches and beats as (pair, place): of all paths, in order, the places in a and b (-1: gap), and the length of each path.

    A match is worth 2, an octave 0.5, another pitch -1, each less min(2, half the beats apart); a gap costs 1. Ties go to a
    match, then to a note only in a. Cells of one antidiagonal don't depend on each other and are filled at once, for all pairs.
    """
    (pairs, n), m = a.shape, b.shape[1]
    apart = np.abs(a[:, :, None] - b[:, None, :])
    worth = np.where(apart == 0, 2.0, np.where(apart % 12 == 0, 0.5, -1.0)) - np.minimum(2.0, 0.5 * np.abs(at[:, :, None] - bt[:, None, :]))
    total, way = np.zeros((pairs, n + 1, m + 1)), np.zeros((pairs, n + 1, m + 1), np.int8)
    total[:, :, 0], total[:, 0, :] = -np.arange(n + 1), -np.arange(m + 1)
    way[:, :, 0], way[:, 0, :] = 1, 2
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        ways = np.stack([total[:, i - 1, j - 1] + worth[:, i - 1, j - 1], total[:, i - 1, j] - 1, total[:, i, j - 1] - 1])
        total[:, i, j], way[:, i, j] = ways.max(0), ways.argmax(0)
    each, i, j = np.arange(pairs), np.full(pairs, n), np.full(pairs, m)
    steps = []
    for _ in range(n + m):
        step, live = way[each, i, j], (i > 0) | (j > 0)
        i, j = i - (live & (step < 2)), j - (live & (step != 1))
        steps.append((live, np.where(step < 2, i, -1), np.where(step != 1, j, -1)))
    live, left, right = (np.array([x[c] for x in steps[::-1]]).reshape(n + m, pairs).T for c in range(3))
    return left[live == 1], right[live == 1], (live == 1).sum(1)


def best_path(pred: list[tuple[int, float]], truth: list[tuple[int, float]]) -> list[tuple[int | None, int | None]]:
    """The best global alignment of two sequences of (pitch, beat) as pairs of places, None for a gap. See align_notes()."""
    (a, at), (b, bt) = (np.array(x, float).reshape(-1, 2).T[:, None, :] for x in (pred, truth))
    left, right, _ = _paths(a, at, b, bt)
    return [(None if i < 0 else i, None if j < 0 else j) for i, j in zip(left.tolist(), right.tolist(), strict=True)]


def align_notes(pairs: DataFrame, cells: int = 2_000_000) -> DataFrame:
    """pairs(..., pred, truth), arrays of structs with pitch and start, with path: an array of (pred, truth), places from 0 in both, null for a gap, in order.

    A match is worth 2, an octave 0.5, another pitch -1, each less min(2, half the beats apart); a gap costs 1. Ties go to a
    match, then to a note only in pred. A pair is one row, and its alignment takes n x m cells, so a pair is a section, not a
    recording. Pairs of one shape are aligned together, up to so many cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([paths(batch) if c == "path" else batch.column(c) for c in batch.schema.names], batch.schema.names)

    def paths(batch: pa.RecordBatch) -> pa.Array:
        sides = []
        for c in ("pred", "truth"):
            column = batch.column(c)
            size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int)
            held = column.flatten()
            sides.append((size, np.cumsum(size) - size, *(pc.struct_field(held, x).to_numpy(zero_copy_only=False).astype(float) for x in ("pitch", "start"))))
        (n, first, a, at), (m, second, b, bt) = sides
        made, order = [], []
        for key in np.unique(np.stack([n, m]), axis=1).T:
            rows = np.flatnonzero((n == key[0]) & (m == key[1]))
            most = max(1, cells // int((key[0] + 1) * (key[1] + 1)))
            for k in range(0, len(rows), most):
                some = rows[k : k + most]
                x, y = first[some][:, None] + np.arange(key[0]), second[some][:, None] + np.arange(key[1])
                made.append(_paths(a[x], at[x], b[y], bt[y]))
                order.append(some)
        left, right, length = (np.concatenate([x[c] for x in made]) if made else np.zeros(0, int) for c in range(3))
        places = [pa.array(x, pa.int32(), mask=x < 0) for x in (left, right)]
        found = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.StructArray.from_arrays(places, ["pred", "truth"]))
        return found.take(pa.array(np.argsort(np.concatenate(order), kind="stable"))) if made else found

    held = pairs.withColumn("path", F.array().cast("array<struct<pred: int, truth: int>>"))
    return held.mapInArrow(run, held.schema)


def _matched() -> Column:
    """The matches of a row's path, as (p, t), the notes of both."""
    both = F.filter("path", lambda x: x["pred"].isNotNull() & x["truth"].isNotNull())
    return F.transform(both, lambda x: F.struct(F.get("pred", x["pred"]).alias("p"), F.get("truth", x["truth"]).alias("t")))


def section_accuracy(aligned: DataFrame, onset: float = ONSET) -> DataFrame:
    """aligned(..., pred, truth, path), notes with pitch, start and dur, with n_truth, n_predicted, n_matched, shares of the truth's notes that are right in pitch, pitch_class, onset and duration, sequence_similarity, insertions and deletions in place of the arrays. Null arrays are empty."""
    met = aligned.withColumns({c: F.coalesce(c, F.array().cast(aligned.schema[c].dataType)) for c in ("pred", "truth")}).withColumn("met", _matched())
    count = lambda test: F.size(F.filter("met", test))
    share = lambda test: count(test) / F.greatest(F.lit(1), F.size("truth"))
    spelled = lambda c: F.array_join(F.transform(c, lambda x: F.chr(x["pitch"].cast("long"))), "")
    gaps = lambda c: F.size(F.filter("path", lambda x: x[c].isNull()))
    same = lambda k: share(lambda x: F.pmod(x["p"]["pitch"] - x["t"]["pitch"], F.lit(k)) == 0)
    return met.withColumns({
        "n_truth": F.size("truth"), "n_predicted": F.size("pred"), "n_matched": F.size("met"),
        "pitch": share(lambda x: x["p"]["pitch"] == x["t"]["pitch"]), "pitch_class": same(12),
        "onset": share(lambda x: F.abs(x["p"]["start"] - x["t"]["start"]) <= onset), "duration": share(lambda x: x["p"]["dur"] == x["t"]["dur"]),
        "sequence_similarity": fn.sequence_similarity(spelled("pred"), spelled("truth")), "insertions": gaps("truth"), "deletions": gaps("pred"),
    }).drop("pred", "truth", "path", "met")


ACCURACIES = ("pitch", "pitch_class", "onset", "duration", "sequence_similarity")


def recording_accuracy(sections: DataFrame, by: tuple[str, ...] = ("rec",)) -> DataFrame:
    """Section scores of each rec (or of each value of the columns `by`) as means weighed by the truth's notes (one at least), octave_errors (right but for the octave) and the number of sections."""
    weight = F.greatest(F.lit(1), F.col("n_truth"))
    means = sections.groupBy(*by).agg(*((F.sum(F.col(c) * weight) / F.sum(weight)).alias(c) for c in ACCURACIES), F.count("*").alias("sections"))
    return means.withColumn("octave_errors", F.greatest(F.lit(0.0), F.col("pitch_class") - F.col("pitch")))


def calibration(aligned: DataFrame, unsure: float = UNSURE, by: tuple[str, ...] = ("rec",)) -> DataFrame:
    """aligned(rec or other columns `by`, pred with conf, truth, path): does confidence tell right from wrong notes? n_notes, n_wrong, n_flagged, mean confidences, precision and recall of the flag, and auc (0.5 if all are right or wrong) of each rec's matched notes."""
    return _calibrated(aligned.select(*by, _told().alias("told")), unsure, by)


def _told() -> Column:
    """The confidence of each matched note, and whether it is wrong."""
    return F.transform(_matched(), lambda x: F.struct(x["p"]["conf"].alias("conf"), (x["p"]["pitch"] != x["t"]["pitch"]).alias("wrong")))


def _calibrated(rows: DataFrame, unsure: float, by: tuple[str, ...]) -> DataFrame:
    each = rows.select(*by, F.inline("told"))
    flagged, zero = F.col("conf") < unsure, lambda c: F.coalesce(c, F.lit(0.0))
    told = each.groupBy(*by).agg(
        F.count("*").alias("n_notes"), F.count_if("wrong").alias("n_wrong"), F.count_if(flagged).alias("n_flagged"), zero(F.avg(F.when(~F.col("wrong"), F.col("conf")))).alias("mean_right"), zero(F.avg(F.when(F.col("wrong"), F.col("conf")))).alias("mean_wrong"),
        zero(F.avg(F.when(flagged, F.col("wrong").cast("int")))).alias("flag_precision"), zero(F.avg(F.when(F.col("wrong"), flagged.cast("int")))).alias("flag_recall"),
    )
    ranked = auc(each.select(F.struct(*by).alias("grp"), F.col("conf").alias("score"), (~F.col("wrong")).alias("positive")))
    return told.join(ranked.select(*(F.col(f"grp.{c}").alias(c) for c in by), "auc"), list(by), "left").withColumn("auc", F.coalesce("auc", F.lit(0.5)))


def same_key(a: Column, b: Column) -> Column:
    """Whether two key names mean one key: flats (b or -) as the sharps they sound like, a missing mode as major."""
    flats = F.create_map(*(F.lit(x) for pair in zip(fn.FLAT_NAMES, fn.SHARP_NAMES, strict=True) if pair[0] != pair[1] for x in pair))

    def plain(key: Column) -> Column:
        parts = F.split(F.trim(key), r"\s+")
        root = F.replace(F.get(parts, F.lit(0)), F.lit("b"), F.lit("-"))
        return F.concat_ws(" ", F.coalesce(F.try_element_at(flats, root), root), F.coalesce(F.lower(F.get(parts, F.lit(1))), F.lit("major")))

    return plain(a) == plain(b)


def tune_facts(tunes: DataFrame, by: tuple[str, ...] = ("rec",)) -> DataFrame:
    """tunes(rec or other columns `by`, key, meter, tempo, form, and true_ of each): key_right, meter_right, form_right (both forms reduced to the unit that repeats) and tempo_error in percent."""
    off = F.abs(F.col("tempo") - F.col("true_tempo")) / F.greatest(F.col("true_tempo"), F.lit(1e-6)) * 100
    unit = lambda c: fn.reduced_form(F.coalesce(c, F.lit("")))
    return tunes.select(*by, same_key(F.col("key"), F.col("true_key")).alias("key_right"), (F.col("meter") == F.col("true_meter")).alias("meter_right"), (unit("form") == unit("true_form")).alias("form_right"), off.alias("tempo_error"))


def transcription_score(aligned: DataFrame, tunes: DataFrame, by: tuple[str, ...] = ("rec",)) -> DataFrame:
    """All scores of each recording: aligned(rec, pred, truth, path), a row for each section of the truth, and tunes as for tune_facts(). With other columns `by`, such as a configuration and the rec, of each of their values. The sections' scores are written to the shared folder, so that pairs are aligned once."""
    sections = stash(section_accuracy(aligned.select(*by, "pred", "truth", "path", _told().alias("told"))))
    return recording_accuracy(sections, by).join(_calibrated(sections, UNSURE, by), list(by), "left").join(tune_facts(tunes, by), list(by), "left")
