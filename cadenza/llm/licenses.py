"""License notices by diagonal voting.

All rolling word grams of every document are hashed and joined to the places of such grams in the templates. A match votes
for the diagonal `document place - template place`. A diagonal on which all grams of a phrase vote is a place where it may
stand word for word. For notices and whole license texts, votes on neighbouring diagonals, which differ by inserted or
missing words, are merged to spans. Every span is verified on the words themselves: a phrase must be equal, and a notice's
longest common subsequence of words with the span must be SHARE of the longer of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .license_texts import NOTICES, PHRASES, WHOLE
from .store import stash

#: Words of a gram in phrases and in notices. Where a fifth of a notice's words are others, a run of three is left.
PHRASE_GRAM, NOTICE_GRAM = 2, 3
#: Words by which merged diagonals may differ, the part of a template's words that makes a span a notice, and the part of the grams which such a span must have that it needs to be verified.
DRIFT, SHARE, VOTES = 2, 0.8, 0.25

TEMPLATES = tuple((True, *x) for x in PHRASES) + tuple((False, *x) for x in NOTICES + WHOLE)


def _template(said: str, exact: bool) -> tuple[list[bytes], np.ndarray]:
    """A template's words and gram hashes."""
    w = tx.words(pa.array([said]), tx.ALNUM)
    return [w.word(i) for i in range(len(w.starts))], tx.grams(w.hashes, PHRASE_GRAM if exact else NOTICE_GRAM).view(np.int64)


def votes_needed(n: int) -> int:
    """Grams that a span needs, of a notice of n words: a part of those that are left when each word that may differ spoils all its grams; one at least."""
    left = n - NOTICE_GRAM + 1 - NOTICE_GRAM * int(n * (1 - SHARE) + 1e-9)
    return max(1, int(VOTES * left))


def _places(spark) -> DataFrame:
    """One row for each gram of each template; a fixed table of some thousand rows."""
    rows = []
    for t, (exact, said, _) in enumerate(TEMPLATES):
        said_words, hashes = _template(said, exact)
        needed = len(hashes) if exact else votes_needed(len(said_words))
        rows += [(int(h), exact, t, len(said_words), needed, at) for at, h in enumerate(hashes)]
    return spark.createDataFrame(rows, "gram long, exact boolean, template int, said int, needed int, at int")


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of words of each text, and the places and hashes of its grams that some template has; the text itself stays only where there are any."""
    known = {k: np.unique(np.concatenate([_template(said, exact)[1] for exact, said, _ in TEMPLATES if exact == (k == PHRASE_GRAM)])) for k in (PHRASE_GRAM, NOTICE_GRAM)}
    for batch in tx.slices(batches):
        w = tx.words(batch.column("text"), tx.ALNUM)
        text, found = w.text_of_word(), []
        for k, those in known.items():
            hashes = tx.grams(w.hashes, k).view(np.int64)
            at = np.flatnonzero(np.isin(hashes, those))
            at = at[text[at] == text[at + k - 1]]
            found.append((at, hashes[at]))
        at, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(at, kind="stable")
        at, hashes = at[order], hashes[order]
        each = np.bincount(text[at], minlength=batch.num_rows)
        made = {
            "n_words": pa.array(w.counts.astype(np.int64)),
            "places": tx.listed((at - w.first[text[at]]).astype(np.int32), each, pa.int32()),
            "hashes": tx.listed(hashes, each, pa.int64()),
            # a null index takes a null
            "text": batch.column("text").take(pa.array(np.arange(batch.num_rows), mask=each == 0)),
        }
        yield pa.RecordBatch.from_arrays([made.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of the longest common subsequence of a with each prefix of b."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], (row[:-1] + 1) * (b == x)))
    return row


def likeness(template: list[bytes], said: list[bytes]) -> float:
    """The longest common subsequence of both, from its first to its last word in `said`, by the longer of that stretch and the template."""
    ids: dict[bytes, int] = {}
    a, b = (np.array([ids.setdefault(x, len(ids)) for x in words], np.int32) for words in (template, said))
    forward = _common(a, b)
    most = int(forward.max(initial=0))
    if not most:
        return 0.0
    end = int(np.flatnonzero(forward == most)[0])
    back = _common(a[::-1], b[:end][::-1])
    return most / max(len(a), int(np.flatnonzero(back == most)[0]))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    templates = [(exact, _template(said, exact)[0], label) for exact, said, label in TEMPLATES]
    names = ["doc_id", "key", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    for batch in tx.slices(batches):
        w, out = tx.words(batch.column("text"), tx.ALNUM), []
        for d, (doc_id, key, spans) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "spans")), strict=True)):
            first, n = int(w.first[d]), int(w.counts[d])
            base, notices, score = {}, set(), 0.0
            for span in spans:
                exact, said, label = templates[span["template"]]
                low, high = max(span["low"], 0), min(span["high"], n)
                here = [w.word(first + i) for i in range(low, high)]
                if exact and here == said:
                    base[low, span["template"]] = label
                elif not exact:
                    share = likeness(said, here)
                    score = max(score, share)
                    notices |= {label} if share >= SHARE else set()
            at, labels = [p for p, _ in base], set(base.values())
            out.append((doc_id, key, len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | notices)), 1.0 if base else score))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * len(kinds), kinds, strict=True)], names)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null text is empty; rows with one doc_id are told apart by their text. score is 1 for a text with a phrase, else the
    largest likeness of a span to its template, 0 without any. Other columns aren't read. A text is split once; it crosses
    the network only if it has grams of a template.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    read = read.withColumns({"key": F.xxhash64("text"), "n_words": F.lit(0).cast("long"), "places": F.array().cast("array<int>"), "hashes": F.array().cast("array<long>")})
    read = stash(read.mapInArrow(_grams, "doc_id long, text string, key long, n_words long, places array<int>, hashes array<long>"))
    grams = read.where(F.size("hashes") > 0).select("doc_id", "key", F.explode(F.arrays_zip("places", "hashes")).alias("x")).select("doc_id", "key", F.col("x.places").alias("place"), F.col("x.hashes").alias("gram"))
    # the templates are a constant of this package, so their size is known
    hits = grams.join(F.broadcast(_places(docs.sparkSession)), "gram").withColumn("diagonal", F.col("place") - F.col("at"))
    votes = hits.groupBy("doc_id", "key", "exact", "template", "said", "needed", "diagonal").agg(F.collect_set("at").alias("at"))

    order = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order), F.lit(DRIFT + 1)) > F.when(F.col("exact"), -1).otherwise(DRIFT)
    votes = votes.withColumn("run", F.sum(far.cast("int")).over(order))
    runs = votes.groupBy("doc_id", "key", "exact", "template", "said", "needed", "run").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("met"))
    runs = runs.where(F.col("met") >= F.col("needed"))
    slack = F.when(F.col("exact"), 0).otherwise(DRIFT)
    spans = runs.groupBy("doc_id", "key").agg(F.collect_list(F.struct("template", (F.col("low") - slack).alias("low"), (F.col("high") + F.col("said") + slack).alias("high"))).alias("spans"))
    texts = read.where(F.size("hashes") > 0).select("doc_id", "key", "text").dropDuplicates(["doc_id", "key"])
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.key") == F.col(f"{b}.key"))
    asked = texts.alias("t").join(spans.alias("s"), same("t", "s")).select("t.doc_id", "t.key", "text", "spans")
    found = asked.mapInArrow(_verify, "doc_id long, key long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    joined = read.select("doc_id", "key", "n_words").alias("d").join(found.alias("f"), same("d", "f"), "left")
    return joined.select("d.doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
