"""Byte-level BPE: texts to token ids and back.

A text is split by a pattern, and each distinct word is encoded once: a fold over its bytes, which Spark's higher-order
functions express, merges the neighbours of lowest rank until no two neighbours are a token. The ranks are a literal of the
plan, spread over small maps by a checksum so that one lookup reads one of them. Bytes are written as the characters of
the same numbers (Latin-1), so that parts are strings.

To bring the ids back to the texts, a block of texts is the numbers of its words in the block's own list of words. The lists
go to the words' tasks, and from there the ids, packed, to the block's task; the words of a text never cross the network one by one.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx

#: Small maps that the ranks are spread over.
MAPS = 1 << 15
#: Bytes of texts in a block. Bytes of the longest word that is folded, which takes steps by length squared; longer ones are merged with a heap, alike.
BLOCK, FOLDED = 16 << 20, 64
#: Bytes of texts whose words are numbered at once, on their way into a block.
PART = 2 << 20
#: Words whose ids are packed at once, and those that one array pass puts together.
WORDS, PASS = 1 << 18, 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base64 and its rank, which is its id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


#: The letters and numbers that Unicode 14, 15 and 16 added. Java 17 stops at 13, the library for these rank files doesn't.
NEWER = {
    r"\p{L}": "870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 1C89-1C8A 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7CD A7D0-A7D1 A7D3 A7D5-A7DC A7F2-A7F4 10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC 105C0-105F3 10780-10785 10787-107B0 107B2-107BA 10D4A-10D65 10D6F-10D85 10EC2-10EC4 10F70-10F81 11071-11072 11075 1123F-11240 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11740-11746 11AB0-11ABF 11BC0-11BE0 11F02 11F04-11F10 11F12-11F33 12F90-12FF0 1342F 13441-13446 13460-143FA 16100-1611D 16A70-16ABE 16D40-16D6C 18CFF 1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB 1E5D0-1E5ED 1E5F0 1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF",
    r"\p{N}": "10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9 1D2C0-1D2D3 1E4F0-1E4F9 1E5F1-1E5FA",
}


def java_pattern(pattern: str) -> str:
    r"""The pattern with \s as all Unicode white space and with newer letters and numbers, as in the library that the rank files are for."""
    out, inside = ["(?U)"], False
    for part in re.findall(r"\\p\{[LN]\}|\\.|.", pattern, re.DOTALL):
        if part in NEWER:
            ranges = "".join(re.sub("[0-9A-F]+", lambda m: rf"\x{{{m[0]}}}", x) for x in NEWER[part].split())
            # characters below all of them are told by one comparison
            part = rf"{part}[\x{{870}}-\x{{323AF}}&&[{ranges}]]"
            out.append(part if inside else f"[{part}]")
        else:
            inside = part == "[" or inside and part != "]"
            out.append(part)
    return "".join(out)


def rank_table(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal: an array of small maps from parts (Latin-1 strings) to ranks."""
    maps: list[dict[str, int]] = [{} for _ in range(MAPS)]
    for token, rank in ranks.items():
        part = token.decode("latin-1")
        maps[zlib.crc32(part.encode()) % MAPS][part] = rank
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def rank(table: Column, part: Column) -> Column:
    """The rank of a part, null for what is no token."""
    return F.try_element_at(F.get(table, (F.crc32(part) % MAPS).cast("int")), part)


def _let(value: Column, use) -> Column:
    """use(value) with value computed once; a lambda computes an expression at each place that names it."""
    return F.get(F.transform(F.array(value), use), 0)


def folded(word: Column, table: Column) -> Column:
    """The ids of a word (a string column of Latin-1 bytes, not empty). State of the fold: parts p, and ranks r of each part with the next, null for no token and for the last part."""

    def merged_at(t: Column, p: Column, r: Column, i: Column, made: Column) -> Column:
        left, right = rank(t, F.concat(F.get(p, i - 2), made)), rank(t, F.concat(made, F.get(p, i + 1)))
        after = F.slice(r, i + 2, F.size(r))
        return F.struct(
            F.concat(F.slice(p, 1, i - 1), F.array(made), F.slice(p, i + 2, F.size(p))).alias("p"),
            F.when(i > 1, F.concat(F.slice(r, 1, i - 2), F.array(left, right), after)).otherwise(F.concat(F.array(right), after)).alias("r"),
        )

    def step(t: Column, state: Column) -> Column:
        p, r = state["p"], state["r"]
        at = lambda i: _let(F.concat(F.get(p, i - 1), F.get(p, i)), lambda made: merged_at(t, p, r, i, made))
        return _let(F.array_min(r), lambda least: F.when(least.isNull(), state).otherwise(_let(F.array_position(r, least).cast("int"), at)))

    def ids(t: Column) -> Column:
        first = _let(F.split(word, ""), lambda p: F.struct(p.alias("p"), F.transform(p, lambda x, i: rank(t, F.concat(x, F.get(p, i + 1)))).alias("r")))
        return F.transform(F.aggregate(F.sequence(F.lit(1), F.length(word)), first, lambda state, _: step(t, state))["p"], lambda x: rank(t, x))

    return _let(table, ids)


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word, lowest rank first and the first of equals, in time by its length and the log of it."""
    ends = list(range(1, len(word) + 1))  # the end of the part that begins at i; 0: none begins there
    before = list(range(-1, len(word) - 1))
    end = lambda i: ends[ends[i]] if ends[i] < len(word) else None
    pair = lambda i: ranks.get(word[i : end(i)]) if end(i) else None
    heap = [(r, i, i + 2) for i in range(len(word) - 1) if (r := pair(i)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not ends[i] or end(i) != stop:
            continue
        ends[ends[i]] = 0
        ends[i] = stop
        if stop < len(word):
            before[stop] = i
        for at in (before[i], i):
            if at >= 0 and (r := pair(at)) is not None:
                heapq.heappush(heap, (r, at, end(at)))
    found, i = [], 0
    while i < len(word):
        found.append(ranks[word[i : ends[i]]])
        i = ends[i]
    return found


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, pa.Array]]:
    """Of each block: a digest of all it holds, its doc_ids, the words in each text, the number of each word, and the words that have the numbers, commonest first.

    A part of a block is held as numbers of its own distinct words; its batch is let go, as batches are several times the text.
    """

    def encoded(part: pa.RecordBatch) -> tuple:
        lists = part.column("words")
        coded = lists.flatten().dictionary_encode()
        doc_ids = part.column("doc_id").take(pa.array(np.arange(part.num_rows)))  # a copy; a slice holds its batch
        return doc_ids, pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary

    def closed() -> tuple:
        doc_ids, counts, parts, lists = zip(*held, strict=True)
        held.clear()
        coded = pa.chunked_array(lists).combine_chunks().dictionary_encode()
        of_part = coded.indices.to_numpy(zero_copy_only=False)
        starts = np.cumsum([len(x) for x in lists]) - [len(x) for x in lists]
        numbers, words = np.concatenate([of_part[start:][x] for start, x in zip(starts, parts, strict=True)]), coded.dictionary
        del parts, lists
        order = np.argsort(-np.bincount(numbers, minlength=len(words)), kind="stable")
        of = np.empty(len(order), np.int32)
        of[order] = np.arange(len(order), dtype=np.int32)
        numbers, words, counts = of[numbers], words.take(pa.array(order)), np.concatenate(counts)
        digest = hashlib.blake2b(digest_size=8)
        for x in (counts, numbers, *tx.buffer(words)):
            digest.update(np.ascontiguousarray(x))
        return int.from_bytes(digest.digest(), "little", signed=True), pa.concat_arrays(doc_ids), counts, numbers, words

    held, size = [], 0
    for batch in batches:
        for start, stop in tx.cuts(batch.column("bytes").to_numpy(), min(PART, BLOCK)):
            part = batch.slice(start, stop - start)
            more = pc.sum(part.column("bytes")).as_py()
            if held and size + more > BLOCK:
                yield closed()
                size = 0
            held.append(encoded(part))
            size += more
    if held:
        yield closed()


def _packed(numbers: np.ndarray) -> bytes:
    """The bytes of same weight together: common words have small numbers, so the upper ones are mostly zero."""
    return pa.compress(b"".join((numbers >> shift).astype(np.uint8).tobytes() for shift in (0, 8, 16, 24)), "zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    out = planes[0].astype(np.int32)
    for plane, shift in zip(planes[1:], (8, 16, 24), strict=True):
        if plane.any():
            out |= plane.astype(np.int32) << shift
    return out


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, _, _, _, words in _blocks(batches):
        at = np.flatnonzero(pc.binary_length(words).to_numpy() <= FOLDED).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array(at), words.take(pa.array(at))], ["block", "at", "word"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, doc_ids, counts, numbers, words in _blocks(batches):
        at = np.flatnonzero(pc.binary_length(words).to_numpy() > FOLDED).astype(np.int32)
        one = lambda x: tx.listed(x, np.array([len(x)]), x.type if isinstance(x, pa.Array) else None)
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([len(words)], pa.int32()), one(doc_ids), one(counts), pa.array([_packed(numbers)], pa.binary()), one(at), one(words.take(pa.array(at)))], ["block", "n", "doc_id", "counts", "numbers", "long_at", "long"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of words, a row each, as a row for each block: how many words and ids, and, packed, their places in the block's list as steps, the number of ids of each, and the ids."""

    def closed() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        block, at, lists = table.column("block").to_numpy(), table.column("at").to_numpy(), table.column("ids").combine_chunks()
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((at, block))
        block, at, starts, size = block[order], at[order], (np.cumsum(size) - size)[order], size[order]
        ends = np.cumsum(size)
        ids = lists.flatten().to_numpy(zero_copy_only=False)[np.arange(size.sum()) + np.repeat(starts - ends + size, size)]
        first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        rows = []
        for i, j in zip(first, np.append(first[1:], len(block)), strict=True):
            some = ids[ends[i] - size[i] : ends[j - 1]]
            rows.append((block[i], j - i, len(some), _packed(np.concatenate([np.diff(at[i:j], prepend=0), size[i:j], some]).astype(np.int32))))
        kinds = {"block": pa.int64(), "words": pa.int64(), "n_ids": pa.int64(), "packed": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= WORDS:
            yield closed()
            held, n = [], 0
    if held:
        yield closed()


def _encoded(ranks: dict[bytes, int], finish=None):
    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        """The ids of a block's texts; equal blocks meet here, each as a row of texts, and their words with them."""
        parts: tuple[list, list, list] = ([], [], [])
        for row in words.to_pylist():
            some = _unpacked(row["packed"], 2 * row["words"] + row["n_ids"])
            for out, x in zip(parts, np.split(some, [row["words"], 2 * row["words"]]), strict=True):
                out.append(x)
        empty = [np.zeros(0, np.int32)]
        at, size, ids = np.concatenate([*map(np.cumsum, parts[0]), *empty]).astype(np.int64), np.concatenate(parts[1] + empty), np.concatenate(parts[2] + empty)
        rows = texts.to_pylist()
        made = []
        for row in rows:
            held: list = [None] * row["n"]
            for k, word in zip(row["long_at"], row["long"], strict=True):
                held[k] = np.array(merged(word.encode(), ranks), np.int32)
            lengths, starts = np.zeros(row["n"], np.int64), np.zeros(row["n"], np.int64)
            lengths[at], starts[at] = size, np.cumsum(size, dtype=np.int64) - size
            flat = [ids]
            base = len(flat[0])
            for k in row["long_at"]:
                lengths[k], starts[k] = len(held[k]), base
                flat.append(held[k])
                base += len(held[k])
            if row["n"] and not lengths.all():
                raise RuntimeError("the texts were not the same when read again; encode a written table")
            whole, counts = np.concatenate(flat), np.array(row["counts"], np.int64)
            numbers, first = _unpacked(row["numbers"], int(counts.sum())), 0
            for start, stop in tx.cuts(counts, PASS):
                some = numbers[first : first + int(counts[start:stop].sum())]
                first += len(some)
                each = lengths[some]
                ends = np.cumsum(each)
                found = whole[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[some] - ends + each, each)]
                of_text = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts[start:stop])])]
                made.append(pa.RecordBatch.from_arrays([pa.array(row["doc_id"][start:stop], pa.int64()), tx.listed(found.astype(np.int32), np.diff(of_text), pa.int32())], ["doc_id", "ids"]))
                if finish:
                    made[-1] = finish(made[-1])
        if not made:
            none = pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.list_(pa.int32()))], ["doc_id", "ids"])
            made = [finish(none) if finish else none]
        return pa.Table.from_batches(made)

    return run


def _encode(docs: DataFrame, pattern: str, ranks: dict[bytes, int], together, schema: str) -> DataFrame:
    """A block's packed texts and words as `together` puts them together."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("bytes"), F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0)).alias("words"))
    words = split.mapInArrow(_words, "block long, at int, word string")
    same = Window.partitionBy("word").orderBy("block", "at")
    latin = F.decode(F.col("word").cast("binary"), "ISO-8859-1")
    ids = F.when(F.col("nth") == 1, folded(latin, rank_table(ranks)))
    coded = words.withColumn("nth", F.row_number().over(same)).withColumn("ids", ids)
    coded = coded.select("block", "at", F.last("ids", ignorenulls=True).over(same.rowsBetween(Window.unboundedPreceding, 0)).alias("ids"))
    coded = coded.mapInArrow(_gathered, "block long, words long, n_ids long, packed binary")
    texts = split.mapInArrow(_texts, "block long, n int, doc_id array<long>, counts array<long>, numbers binary, long_at array<int>, long array<string>")
    return texts.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(together, schema)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """docs(doc_id, text) to doc_id, ids (array of int), a row for each row. A null or empty text has no ids.

    docs is read twice and must give the same texts in the same order, as the files of a table do; if it doesn't, the job
    ends with an error. Special tokens are ordinary text. Other columns aren't read.
    """
    return _encode(docs, pattern, ranks, _encoded(ranks), "doc_id long, ids array<int>")


def _pieces(ranks: dict[bytes, int]) -> list[bytes]:
    """The bytes of each id; of an unknown one none."""
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    return pieces


def decode(coded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """coded(ids, ...) with bytes, the tokens' bytes one after the other; null ids are none. A column bytes is replaced."""
    pieces = _pieces(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = pa.array((b"".join(map(pieces.__getitem__, ids or ())) for ids in (x.as_py() if x.is_valid else None for x in batch.column("ids"))), pa.binary())
            yield pa.RecordBatch.from_arrays([said if c == "bytes" else batch.column(c) for c in batch.schema.names], batch.schema.names)

    held = coded.withColumn("bytes", F.lit(b""))
    return held.mapInArrow(run, held.schema)


class _Joined:
    """Byte strings end to end, so that those with given numbers are joined by array passes."""

    def __init__(self, strings: list[bytes]):
        self.lengths = np.array([len(x) for x in strings] or [0], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def __call__(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all numbers, one after the other, and where each ends, from a 0."""
        each = self.lengths[numbers]
        ends = np.concatenate([[0], np.cumsum(each)])
        return self.data[np.arange(ends[-1]) + np.repeat(self.starts[numbers] - ends[:-1], each)], ends


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(pieces: list[bytes]):
    tables: list[_Joined] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not tables:  # once in a task
            tables.extend((_Joined([b" %d" % i for i in range(len(pieces))]), _Joined(pieces)))
        lists = batch.column("ids")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, first, made = lists.flatten().to_numpy(zero_copy_only=False), 0, ([], [])
        for start, stop in tx.cuts(counts, PASS):
            inside = np.concatenate([[0], np.cumsum(counts[start:stop])])
            some = flat[first : first + inside[-1]]
            first += inside[-1]
            for out, table, skip in zip(made, tables, (1, 0), strict=True):
                data, ends = table(some)
                at = ends[inside]
                out += [hashlib.sha256(data[a + skip * (b > a) : b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), *(pa.array(x, pa.string()) for x in made)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(coded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """coded(doc_id, ids) to doc_id, n_tokens, ids_sha256 (of the ids in decimal, joined by a space) and decoded_sha256 (of the bytes that the ids stand for)."""
    digest = _digests(_pieces(ranks))
    return coded.select("doc_id", "ids").mapInArrow(lambda batches: map(digest, batches), DIGESTS)


def encoded_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """digests(encode(docs, ...)), with a text's ids digested in the task that puts them together: one Python worker a core instead of two, and no ids pass between them."""
    return _encode(docs, pattern, ranks, _encoded(ranks, _digests(_pieces(ranks))), DIGESTS)
