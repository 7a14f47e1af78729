"""The prefix trie, the source divergence and the byte-level BPE against brute force, a public library and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from cadenza.llm import byte_bpe, divergence, prefix_trie, registry


def trie_by_hand(rows):
    """rows (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()), (role, text)))
    own = {c: [said for _, said in sorted(x)] for c, x in own.items()}
    convs = {c: own.get(c - c % 20, [])[: zlib.crc32(str(c).encode()) % 4] + x[zlib.crc32(str(c).encode()) % 4 :] for c, x in own.items()}
    members = defaultdict(list)
    for c, said in convs.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    out = set()
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        ends = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(k)))
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        out.add((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], sum(not kids[x] for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


TURNS = "conv_id long, turn long, role string, text string"
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversations(seed):
    """Copies, shared beginnings, ties, nulls, repeated rows, absent heads, and one conversation with a third of all rows."""
    rng = random.Random(seed)
    rows = [(None, 1, "user", "of none"), (7, None, "user", "before"), (7, None, None, None), (7, 0, "user", "a tie"), (7, 0, "assistant", "a tie"), (7, 0, "assistant", "a tie"), (45, 1, "user", "its head is absent")]
    for c in rng.sample([x for x in range(140) if x not in (7, 45, 40)], 50):
        rows += [(c, t, ("user", "assistant")[t % 2], f"say {rng.choice('ab')}  {rng.choice('ab') * (t > 2)}") for t in range(rng.randint(1, 6))]
    return rows + [(20 * 5 + 1000, t, "user", f"line {t % 7}") for t in range(len(rows) // 2)]


@pytest.mark.parametrize("block", [3, 1024])
def test_trie_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = conversations(block)
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("clash") for c in ("depth", "owner", "a", "n", "part", "row")})).collect()
    assert {tuple(r[c] for c in NODE) for r in got} == trie_by_hand(rows) and len(got) == len(set(got))


def test_trie_edges(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).columns == list(NODE)
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).count() == 0
    short = [(2, 0, None, None), (1101, 0, "user", "left out")]
    got = {tuple(r[c] for c in NODE) for r in prefix_trie.prefix_trie(spark.createDataFrame(short, TURNS)).collect()}
    assert got == trie_by_hand(short)


def test_ids_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    ids = [1, 2, 3, 4, 7, 8, 9, 30, 31, 32]
    got = prefix_trie.ended(spark.createDataFrame([(1, 2, i) for i in ids] + [(1, 3, 5)], "owner long, depth long, conv_id long")).collect()
    assert {r.depth: r.ends_sha256 for r in got} == {2: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 3: hashlib.sha256(b"5").hexdigest()}


def divergence_by_hand(rows):
    """rows (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    count, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        count[lang, source].update(terms)
        seen[lang].update(set(terms))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= 3]
        n_of = {s: {t: count[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(n_of[s][t] for s in sources) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: share(n_of[s]) for s in sources}, share(whole)
        for s in sources:
            pairs = sorted((-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in sources - {s})
            terms = sorted((-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if n_of[s][t] and p[s][t] > q[t])[: divergence.TOP]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, -value, k) for k, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


def divergence_rows(seed):
    """One source with a third of all rows, groups without terms, languages of one source, ties, nulls."""
    rng = random.Random(seed)
    words = [a + b for a in "abcdé" for b in "xyzß本"]
    rows = [(None, None, None), ("en", "silent", "123 --"), ("en", "rare", "once upon"), ("one", "alone", "solo solo"), ("one", "alone", "Solo"), ("one", "alone", "solo"), ("none", "a", ""), ("none", "b", None), ("en", None, "Ax aX")]
    for k in range(150):
        rows.append((rng.choice(["en", "de"]), "hot" if k % 3 == 0 else f"s{rng.randint(0, 6)}", " ".join(rng.choice(words[: rng.randint(2, 25)]) for _ in range(rng.randint(1, 60)))))
    return rows


@pytest.mark.parametrize(("shard", "rounds"), [(1 << 16, 256), (4, 2)])
def test_divergence_by_brute_force(spark, monkeypatch, shard, rounds):
    monkeypatch.setattr(divergence, "SHARD", shard)
    monkeypatch.setattr(divergence, "ROUNDS", rounds)
    rows = divergence_rows(shard)
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({c: F.lit("clash") for c in ("term", "n", "at", "slot", "value", "rank")})
    assert sorted(tuple(r) for r in divergence.divergence(docs).select("lang", "source", "part", "item", "value", "rank").collect()) == divergence_by_hand(rows)


def test_terms_are_counted_in_small_slices(monkeypatch):
    """Counting takes a small multiple of some MB of text, however much a batch has; what it hands on sums to the counts of all texts."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(3, 9))) for _ in range(5000)]
    rows = [("en" if k % 3 else "de", f"s{k % 7}", " ".join(rng.choices(words, k=300))) for k in range(3500)]
    n, docs = Counter(), Counter()
    for lang, source, text in rows:
        n.update((lang, source, t) for t in text.split())
        docs.update((lang, source, t) for t in set(text.split()))
    schema = pa.schema({"lang": pa.string(), "source": pa.string(), "text": pa.string()})
    whole = pa.record_batch([list(c) for c in zip(*rows, strict=True)], schema)
    assert whole.nbytes > 7 << 20
    tracemalloc.start()
    for _ in divergence._counted(iter([whole])):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 << 20
    none = pa.record_batch([["en"] * 3, ["s0", "x", "y"], ["", None, "1 2"]], schema)
    for held, out in ((1 << 19, 1 << 15), (30_000, 999)):
        monkeypatch.setattr(divergence, "HELD", held)
        monkeypatch.setattr(divergence, "OUT", out)
        got, got_docs = Counter(), Counter()
        for batch in divergence._counted(iter([none, *(whole.slice(i, 70) for i in range(0, 3500, 70)), none])):
            assert batch.num_rows <= out
            for *key, x, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got[tuple(key)] += x
                got_docs[tuple(key)] += d
        assert got == n and got_docs == docs
    assert not list(divergence._counted(iter([]))) and not sum(b.num_rows for b in divergence._counted(iter([none])))


def test_divergence_of_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_shares_of_huge_counts():
    import numpy as np

    n = np.array([0, 5, (1 << 62) - 1])
    assert divergence.scaled(n, 1 << 62).tolist() == [1 + 10**9 * (int(x) + 1) // (1 << 62) for x in n]


def test_each_two_slots_meet_once(spark):
    for n in (1, 2, 5, 8):
        pairs = spark.range(n).selectExpr("cast(id as int) a").crossJoin(spark.range(n).selectExpr("cast(id as int) b")).where("a <> b")
        round_of, visits = divergence.meeting(F.col("a"), F.col("b"), F.lit(n))
        got = [tuple(r) for r in pairs.select("a", "b", round_of, visits).where(visits).collect()]
        assert len({frozenset(x[:2]) for x in got}) == len(got) == n * (n - 1) // 2
        assert all(len({s for x in got if x[2] == k for s in x[:2]}) == 2 * sum(x[2] == k for x in got) for k in range(n))


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("block", [2000, 32 << 20])
def test_bpe_as_the_library(spark, tmp_path, monkeypatch, ranks, library, block):
    monkeypatch.setattr(byte_bpe, "BLOCK", block)
    monkeypatch.setattr(byte_bpe, "WORDS", 50)
    rng = random.Random(4)
    texts = [None, "", " ", "\n\n  x", "it's we'LL 12345 <|endoftext|>", "x" * 3000, "ab" * 400, "=" * 700, "a\u0085b c　d\x1cx", "日本語é😀👩‍👩‍👧", "\u0000\x7f" * 50, "é" * 90]
    for _ in range(120):
        texts.append("".join(rng.choice(["the ", "un", "ing", " ", "\n", "é", "ß", "😀", "本", "'s", "9", "-", chr(rng.randint(32, 0x2FFF))]) for _ in range(rng.randint(1, 120))))
    rows = [(None if k == 5 else k // 2, t) for k, t in enumerate(texts)] + [(500, "again")] * 3
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("ids", "words", "block", "at", "bytes")}).repartition(3).write.parquet(f"{tmp_path}/docs")
    got = byte_bpe.decode(byte_bpe.encode(spark.read.parquet(f"{tmp_path}/docs"), ranks, public_tokenizers.PATTERN), ranks).collect()
    want = sorted((i is not None, i or 0, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, list(r.ids), bytes(r.bytes)) for r in got) == want


def test_long_words_merge_as_short_ones(ranks, library):
    rng = random.Random(5)
    for _ in range(300):
        word = "".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 200)))
        assert byte_bpe.merged(word.encode(), ranks) == library.encode_ordinary(word)


def test_bpe_of_nothing(spark, ranks):
    assert byte_bpe.encode(spark.createDataFrame([], "doc_id long, text string"), ranks, public_tokenizers.PATTERN).count() == 0


def test_bpe_query(spark, library):
    at = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    got = registry.op13_byte_bpe(spark, at).collect()
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_ids_of_words_travel_packed(monkeypatch):
    """Rows of words come out as few rows of their blocks, from which all ids are read back, also where a task packs them in parts."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(6)
    rows = [(b, at, [rng.randint(0, 50_000) for _ in range(rng.randint(1, 9))]) for b in (-5, 3, 8) for at in rng.sample(range(70_000), 400)]
    rng.shuffle(rows)
    batches = [pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows[i : i + 70], strict=True), (pa.int64(), pa.int32(), pa.list_(pa.int32())), strict=True)], ["block", "at", "ids"]) for i in range(0, 1200, 70)]
    for words, most in ((1 << 19, 3), (200, 18)):
        monkeypatch.setattr(byte_bpe, "WORDS", words)
        out = [r for b in byte_bpe._gathered(iter(batches)) for r in b.to_pylist()]
        got = []
        for r in out:
            at, size, ids = np.split(byte_bpe._unpacked(r["packed"], 2 * r["words"] + r["n_ids"]), [r["words"], 2 * r["words"]])
            ends = np.cumsum(size)
            got += [(r["block"], a, ids[e - s : e].tolist()) for a, s, e in zip(np.cumsum(at).tolist(), size, ends, strict=True)]
        assert sorted(got) == sorted(rows) and len(out) <= most
    assert sum(len(r["packed"]) for r in out) < 16 * len(rows)


def test_a_block_holds_numbers_of_words(tmp_path, monkeypatch):
    """While a block fills, the batches that it was made of are let go; its words, their numbers and its texts are all there, however it is cut into parts."""
    import pyarrow as pa

    said = [f"{k:03d}" * 20 for k in range(40)]
    rng = random.Random(7)
    texts = [[rng.choice(said) for _ in range(rng.randint(0, 400))] for _ in range(400)]
    before, most = pa.total_allocated_bytes(), []
    schema = pa.schema({"doc_id": pa.int64(), "bytes": pa.int64(), "words": pa.list_(pa.string())})
    with pa.OSFile(f"{tmp_path}/docs", "wb") as file, pa.ipc.new_stream(file, schema) as out:
        for i in range(0, 400, 40):
            out.write_batch(pa.record_batch([[None if k == 3 else i + k for k in range(40)], [sum(map(len, x)) for x in texts[i : i + 40]], texts[i : i + 40]], schema))

    def batches():
        with pa.OSFile(f"{tmp_path}/docs") as file:
            for batch in pa.ipc.open_stream(file):
                most.append(pa.total_allocated_bytes() - before)
                yield batch

    size = sum(len(w) for x in texts for w in x)
    for part, block in ((2 << 20, 1 << 30), (9000, 1 << 30), (9000, 700_000)):
        monkeypatch.setattr(byte_bpe, "PART", part)
        monkeypatch.setattr(byte_bpe, "BLOCK", block)
        got, ids, n = [], [], 0
        for _, doc_ids, counts, numbers, words in byte_bpe._blocks(batches()):
            flat, words, n = iter(numbers.tolist()), words.to_pylist(), n + 1
            got += [[words[next(flat)] for _ in range(c)] for c in counts.tolist()]
            ids += doc_ids.to_pylist()
            assert len(set(words)) == len(words) and next(flat, None) is None
        assert got == texts and ids == [None if k % 40 == 3 else k for k in range(400)]
        assert n == 1 if block > size else n > 3
    assert max(most[:10]) < size / 2


def test_bpe_in_small_passes(spark, tmp_path, monkeypatch, ranks, library):
    monkeypatch.setattr(byte_bpe, "PASS", 7)
    monkeypatch.setattr(byte_bpe, "PART", 100)
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(["token", "ization", "é", "本x", "12345", "=" * 70]) for _ in range(rng.randint(0, 30)))) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    want = {k: library.encode_ordinary(t) for k, t in rows}
    want = {k: (len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for (k, t), x in zip(rows, want.values(), strict=True)}
    for found in (byte_bpe.digests(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks), byte_bpe.encoded_digests(docs, ranks, public_tokenizers.PATTERN)):
        assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == want
    plan = byte_bpe.encoded_digests(docs, ranks, public_tokenizers.PATTERN)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 3  # none stands behind the one that puts ids together
