"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cadenza.llm import chat, components, decontaminate, fingerprints, learn, licenses, minhash, mixing, quality, secret_scan, store, suffixes, toxicity

ROWS = [(1, None, None), (2, "", "a"), (3, "   \n", "a"), (4, "word", "b"), (5, "word", "b"), (5, "word", "b"), (None, "a text without an id", None), (None, None, "a"), (7, "é😀 " * 3000, "b"), (8, "x" * 40_000, "a"), (9, " ".join(f"t{i % 900}" for i in range(30_000)), "b")]
SCHEMA = "doc_id long, text string, source string"
BENCH = [(1, "one two three"), (None, "word"), (2, None), (3, "")]


@pytest.fixture(scope="module")
def docs(spark):
    clash = {c: F.lit("clash") for c in ("rep", "key", "at", "u", "v", "size", "target", "copies", "score", "secrets", "n_words", "bucket", "component")}
    return spark.createDataFrame(ROWS, SCHEMA).withColumns(clash)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 0, 1), (None, 1, 1), (7, None, None), (9, 1, 0)], "doc_id long, quality int, toxic int")


def test_suffixes(docs):
    got = {r.doc_id: r for r in suffixes.repeated_passages(docs).collect()}
    assert set(got) == {7, 9} and got[9].n_words == got[9].n_repeated == 30_000


def test_fingerprints(docs):
    got = fingerprints.edited_fingerprints(docs, 3).collect()
    assert len(got) == len(ROWS) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id in (4, 5)}) == 1


def test_one_document_follows_itself(spark):
    got = fingerprints.edited_fingerprints(spark.createDataFrame([(1, "abcde")], "doc_id long, text string")).head()
    assert got.near_next == 1.0 and got.n_chars == 5


def test_leaks(spark, docs):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = decontaminate.find_leaks(docs, bench).collect()
    assert len(got) == len(ROWS) and all(not r.hit_words for r in got) and got[0].size == "clash"
    assert all(not r.hit_items for r in decontaminate.find_leaks(docs, bench.limit(0)).collect())
    short = spark.createDataFrame([(1, "Zero ONE two three. one two three"), (2, "two three")], "doc_id long, text string")
    assert {r.doc_id: (list(r.hit_words), list(r.hit_items)) for r in decontaminate.find_leaks(short, bench).collect()} == {1: ([1, 2, 3, 4, 5, 6], ["1"]), 2: ([], [])}


def test_secrets(docs):
    got = secret_scan.find_secrets(docs).collect()
    assert len(got) == len(ROWS) and all(not r.secrets for r in got if r.doc_id not in (8,))
    assert len(secret_scan.redact(docs).collect()) == len(ROWS)


def test_mixing(docs):
    mixed = mixing.mix(docs)
    got = mixed.collect()
    assert len(got) == len(ROWS) and {c for c in ("key", "score") if c not in mixed.columns} == set()
    for source in {r.source for r in got}:
        rows = [r for r in got if r.source == source]
        assert sum(r["size"] for r in rows) == rows[0].source_size and rows[0].target <= 2 * rows[0].source_size
        assert all(0 <= r.copies <= 2 for r in rows)
    assert sorted(map(repr, got)) == sorted(map(repr, mixed.collect()))


def test_mix_comes_near_its_targets(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 5).alias("source"))
    for r in mixing.mix(docs).groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("taken")).collect():
        assert abs(r.taken - r.target) <= 0.02 * r.target


def test_minhash(docs):
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[5].component_id == 4 and not by[5].kept and by[2].component_id == 2 and by[3].n_shingles == 0
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)


def test_one_id_with_two_texts_joins_their_groups(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = spark.createDataFrame([(1, a), (5, a), (5, b), (9, b)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(rows).collect()} == {1: 1, 5: 1, 9: 1}


def _shuffle_files(spark):
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    found = set()
    while held.hasNext():
        found.add(held.next().getName())
    return {x for x in found if x.startswith("shuffle_")}


def _tables(spark):
    return set(Path(store.shared_folder(spark).removeprefix("file://")).glob("stash-*"))


def test_what_was_shuffled_for_a_table_goes_with_its_writing(spark):
    before, was = _shuffle_files(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    rows = spark.range(20_000).select(F.col("id"), (F.col("id") % 5_000).alias("k"))
    kept = store.stash(store.salted(rows, rows.groupBy("k").agg(F.count("*").alias("n")), ["k"]))
    for _ in range(20):  # files are deleted in the background
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.5)
    assert not left and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == was
    assert kept.count() == 20_000 and kept.agg(F.sum("n")).head()[0] == 80_000


def test_minhash_leaves_no_signatures_nor_sets_on_disk(spark):
    """The tables that stay are what the result reads: some bytes a document, where a signature alone has 512."""
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: F.hash(i, F.col("id") - F.col("id") % 2))).alias("text"))
    before = _tables(spark)
    found = minhash.near_duplicates(docs)
    assert sum(f.stat().st_size for t in _tables(spark) - before for f in t.rglob("*.parquet")) < 300 * 2_000
    assert {(r.doc_id, r.component_id) for r in found.collect()} == {(i, i - i % 2) for i in range(2_000)}


def test_a_stage_of_the_pipeline_goes_when_the_next_is_written(spark, monkeypatch, tmp_path):
    rows = [(i, "text", "en", "s", 4) for i in range(10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(i), lambda _, docs, __, i=i: docs.where(F.col("doc_id") != i)) for i in range(5)])
    before = _tables(spark)
    mixed = corpus_pipeline.run(spark, str(tmp_path))
    assert len(_tables(spark) - before) == 1 and sorted(r.doc_id for r in mixed.collect()) == [5, 6, 7, 8, 9]


def test_pipeline_keeps_one_of_repeated_rows(spark):
    """With ids that repeat and without ids; rows are counted, as a dict by doc_id would hide the copies."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(100)) for x in "abcd")
    rows = [(2, a), (2, a), (2, a + " more"), (None, a), (None, b), (None, b), (None, b + " more"), (5, c), (5, c), (5, d), (9, d), (3, c + " more"), (None, None), (None, None), (7, ""), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    of = {a: "a", b: "b", c: "c", d: "d", None: None, "": ""}
    told = sorted(((r.doc_id, of.get(r.text, of.get((r.text or "").removesuffix(" more")))) for r in got.collect()), key=repr)
    assert told == sorted([(2, "a"), (None, "b"), (3, "c"), (5, "d"), (None, None), (7, "")], key=repr) and got.columns == docs.columns


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(40, 30), (30, 40), (7, 7), (50, None)], "u long, v long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 21), 0), 40: 30}


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers(docs, labels, module):
    got = module.classified(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert len(module.classified(docs, labels.limit(0)).collect()) == len(ROWS)


def test_licenses(docs):
    got = licenses.scan_licenses(docs).collect()
    assert len(got) == len(ROWS) and all(r.n_base == 0 and r.labels == "" and r.score == 0 for r in got)


def test_chat_round_trip(spark):
    said = "</s>[INST] \\l \\\\ <|turn|><|says|>x<|end|> <<SYS>> [[INST] <<s> |>| \r\n"
    assert chat.unescape(chat.escape(said)) == said and not any(c in chat.escape(said) for c in chat.CONTROL)
    rows = spark.createDataFrame([(1, 0, "user", said), (1, 1, "assistant", said), (1, 1, "assistant", said), (1, None, None, None), (None, 0, "assistant", "")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.records_of(rows)).collect()}
    assert got[1].n_turns == 4 and got[1].loss_chars == 2 * len(said) and got[None].n_turns == 1


def test_chat_records_of_any_kind(spark):
    records = [
        (1, 0, None), (1, 1, "no json"), (1, 2, "[1]"), (1, 3, '{"messages": null}'), (1, 4, '{"messages": ["a", {"role": "user", "content": "q"}]}'), (1, 5, "[" * 5000),
        (2, 0, '{"id": 7, "messages": [{"role": "bot", "name": "x", "content": [{"type": "text", "text": "q"}, {"type": "text", "text": "!"}]}]}'),
        (3, 0, '{"role": "gpt", "text": "stays"}'), (4, 0, '{"conversations": [{"from": "gpt", "value": "a"}]}'),
    ]
    got = {r.conv_id: r for r in chat.digests(spark.createDataFrame(records, "conv_id long, place long, record string")).collect()}
    assert (got[1].n_turns, got[1].n_unmapped) == (1, 5) and [got[i].n_unmapped for i in (2, 3, 4)] == [0, 0, 0]
    assert [got[i].loss_chars for i in (2, 3, 4)] == [0, 0, 1]
    rows = {(r.conv_id, r.place): r for r in chat.format_records(spark.createDataFrame(records, "conv_id long, place long, record string")).collect()}
    assert rows[1, 0].layout is None and rows[1, 3].layout is not None and "bot" in rows[2, 0].formatted and "q!" in rows[2, 0].formatted and "gpt" in rows[3, 0].formatted


def test_chat_layouts(spark):
    records = [
        (1, 0, '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}'),
        (2, 0, '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}'),
        (3, 0, '{"prompt": "q", "completion": "a"}'),
        (4, 0, '{"instruction": "q", "input": "", "output": "a"}'),
        (5, 0, '{"unknown": {"x": 1}}'),
    ]
    rows = chat.format_records(spark.createDataFrame(records, "conv_id long, place long, record string")).collect()
    told = {}
    for r in rows:
        told.setdefault(r.conv_id, []).append(r.formatted)
    assert len({tuple(told[i]) for i in range(1, 5)}) == 1 and told[5] == [None]
    assert len({r.layout for r in rows}) == 5


def test_empty_tables(spark, docs, labels):
    none, bench = docs.limit(0), spark.createDataFrame(BENCH, "item_id long, text string")
    made = [suffixes.repeated_passages(none), fingerprints.edited_fingerprints(none), decontaminate.find_leaks(none, bench), secret_scan.find_secrets(none), mixing.mix(none), minhash.near_duplicates(none), toxicity.classified(none, labels), quality.classified(none, labels), licenses.scan_licenses(none)]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert all(df.count() == 0 for df in [*made, chat.digests(chat.records_of(empty))])


def test_a_very_long_token_takes_no_quadratic_time(spark):
    import random
    import string
    import time

    rng = random.Random(1)
    blob = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(60_000))
    began = time.time()
    got = secret_scan.find_secrets(spark.createDataFrame([(1, blob)], "doc_id long, text string")).head()
    assert [(s.kind, s.start, s.end) for s in got.secrets] == [("random", 0, 60_000)] and time.time() - began < 60


def test_rows_that_share_an_id_add_one_text_to_the_sample(spark):
    shared = spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    known = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, y int")
    rows, _ = learn.sample(shared.union(spark.createDataFrame([(2, None), (2, None), (9, "x")], "doc_id long, text string")), known, "y", 1, 1, 10)
    assert sorted((r.doc_id, r.y, r.text == "") for r in rows.collect()) == [(1, 0, False), (2, 1, True)]


def test_mix_of_sparse_and_null_ids(spark):
    """Windows stay small and reruns agree, texts included, whatever the ids are."""
    docs = spark.range(2000).select(F.when(F.col("id") % 3 > 0, F.xxhash64("id")).alias("doc_id"), F.concat(F.lit("w "), F.col("id")).alias("text"), F.lit("s").alias("source"))
    runs = [sorted((repr(r.doc_id), r.text, r.copies) for r in mixing.mix(d, share=0.5).collect()) for d in (docs, docs.repartition(7))]
    assert runs[0] == runs[1] and abs(sum(c for *_, c in runs[0]) - 1000) <= 1


def test_salted_join(spark):
    from cadenza.llm.store import salted

    rows = spark.createDataFrame([(1, i) for i in range(500)] + [(i, i) for i in range(2, 60)] + [(None, 1)], "k long, v long")
    side = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (99, "d"), (None, "e")], "k long, s string")
    for how in ("inner", "left"):
        same = lambda df: sorted(map(repr, df.select("k", "v", "s").collect()))
        assert same(salted(rows, side, ["k"], how)) == same(rows.join(side, "k", how))


def test_scratch_deletes_what_was_stashed(spark):
    from cadenza.llm import store

    with store.scratch(spark):
        kept = store.stash(spark.range(3))
        path = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert os.path.isdir(path)
    assert not os.path.exists(path)


STAGED = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "w " * 20_000, "en", "a", 40_000), (4, "same words here", "en", "b", 15), (5, "same words here", "en", "b", 15), (5, "same words here", "en", "b", 15), (None, "same words here", None, "b", 15), (6, "token=abcdefgh12345678", "de", None, 22)]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_any_rows(spark, name, tmp_path):
    """Nulls, empty and long texts, repeated rows, an empty table and a clashing column."""
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(STAGED, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in ("score", "size", "secrets", "link", "component_id", "copies", "hit_words")})
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, str(tmp_path))
    rows = got.collect()
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert got.columns[:5] == list(corpus_pipeline.COLUMNS) and all(c in got.columns for c in corpus_pipeline.COLUMNS)
    if name in ("decontamination", "secrets"):
        assert len(rows) == len(STAGED)
    if name == "near_dedup":
        assert sorted(r.doc_id for r in rows) == [1, 2, 3, 4, 6]
    if name == "secrets":
        assert [r.text for r in rows if r.doc_id == 6] == ["[SECRET]"]


def test_chat_records_of_any_depth_and_half_pairs(spark):
    deep = '{"x": ' * 10_000 + "1" + "}" * 10_000
    lists = "[" * 3_000 + '"in"' + "]" * 3_000
    rows = [(1, 1, '{"role": "user", "text": "half \\ud800 and \\\\ud800", "meta": ' + '{"x": ' * 700 + "1" + "}" * 700 + "}"), (1, 2, '{"role": "assistant", "content": ' + lists + "}"), (2, 1, deep), (3, 1, '{"role": "assistant", "text": "\\udfff"}'), (4, 1, '{"\\ud800": 1}'), (5, None, '{"role": "user", "text": "b"}'), (5, None, '{"role": "user", "text": "a"}')]
    records = spark.createDataFrame(rows, "conv_id long, place long, record string")
    got = chat.format_records(records).collect()
    said = {(r.conv_id, r.place): r.formatted for r in got}
    assert len(got) == len(rows) and "half \\ud800 and \\\\ud800" in said[1, 1] and chat.unescape(said[1, 1]).count("\ud800") == 1
    assert said[2, 1] is None and said[4, 1] is None
    digests = {r.conv_id: r for r in chat.digests(records).collect()}
    assert digests[3].loss_chars == 1 and digests[2].n_unmapped == 1 and len(digests) == 5
    assert chat.format_records(spark.createDataFrame([(1, 1, '{"\\ud800": 1}')], "conv_id long, place long, record string"), {}).count() == 1


def test_chat_escapes_are_exact():
    for text in ("\ud800", "\\ud800", "\\\\ud800", "<s>\udfff[INST]", "\\l\\u0041", "a\ud83d\ud83d"):
        assert chat.unescape(chat.escape(text)) == text and "\ud800" not in chat.escape(text)
        chat.escape(text).encode()
