"""A trie of conversations that share their first turns.

Every prefix of a conversation has a digest, and the smallest conversation with a digest owns that node. Who owns a prefix
owns all longer ones of its own, so the first owned depth is found by binary search: in each round all open conversations
probe one depth in one join against the digests' minima. What a conversation owns is a chain of nodes; a chain hangs below
the node at which its conversation stops being another's. Sums over subtrees go from chain to chain, lowest first, and then
along each chain. Turns of one conversation are ranked, digested and summed in blocks, so that a conversation with a large
part of all turns is many tasks' work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import salted, stash

#: Conversations that may lend their first turns to each other, and the most turns that are lent, less one.
FAMILY, LENT = 20, 4
#: Turns of a block of running sums, and ids of one piece of a list of ids (a power of two).
BLOCK, PIECE = 1024, 4096
_EMPTY = hashlib.sha256(b"").hexdigest()


def running(rows: DataFrame, key: str, at: str, columns: list[str], fold: Callable[[str], Column], plus: Callable[[Column, Column], Column], down: bool = False) -> DataFrame:
    """rows with columns replaced by their running fold over each key's rows by `at` (from the last one if down), which is unique in a key: first within blocks of BLOCK, then plus what the blocks before come to. rows is read twice."""
    rows = rows.withColumn("_block", F.floor(F.col(at) / BLOCK))
    order = F.desc if down else F.asc
    carried = rows.groupBy(key, "_block").agg(*(fold(c).alias(f"_{c}") for c in columns))
    earlier = Window.partitionBy(key).orderBy(order("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.withColumns({f"_{c}": fold(f"_{c}").over(earlier) for c in columns}).where(F.col(f"_{columns[0]}").isNotNull())
    inside = Window.partitionBy(key, "_block").orderBy(order(at)).rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumns({c: fold(c).over(inside) for c in columns})
    joined = within.join(carried, [key, "_block"], "left")
    return joined.withColumns({c: plus(F.col(c), F.coalesce(f"_{c}", F.lit(0))) for c in columns}).drop("_block", *(f"_{c}" for c in columns))


def ranked_turns(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) to conv_id, place (from 1), said (a hash of role and text), words. Rows without conv_id are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    words = F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")
    said = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said.alias("said"), words.alias("words")).where("conv_id is not null")
    # equal rows need not meet in one range: any order of theirs is the same
    turns = turns.withColumn("spread", F.monotonically_increasing_id())
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("said").asc(), F.col("spread").asc()]
    turns = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    turns = stash(turns.select("conv_id", "said", "words", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")))
    # of each partition only the first and the last conversation can go on elsewhere
    pieces = turns.groupBy("conv_id", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    split = stash(pieces.withColumn("before", before).where("before is not null").select("conv_id", "part", "before"))
    first = F.min("row").over(Window.partitionBy("conv_id", "part"))
    ranked = turns.withColumn("place", F.col("row") - first + 1).join(F.broadcast(split), ["conv_id", "part"], "left")
    return ranked.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "said", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n) of every conversation, and (conv_id, depth, said, words) of the turns it is rebuilt from: the first ones of its family's head, then its own after as many."""
    lengths = stash(turns.groupBy("conv_id").agg(F.max("place").alias("own")))
    convs = lengths.withColumns({"head": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": F.crc32(F.col("conv_id").cast("string")) % LENT})
    heads = lengths.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("head"), F.col("own").alias("had"))
    convs = convs.join(heads, "head", "left").withColumn("lent", F.least("h", F.coalesce("had", F.lit(0))))
    convs = stash(convs.select("conv_id", "head", "h", "lent", (F.col("lent") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("n")))
    shifts = convs.where("h > 0").select("conv_id", "h", (F.col("h") - F.col("lent")).alias("back"))
    kept = salted(turns, shifts, ["conv_id"], "left", lengths.withColumnRenamed("own", "n")).where("place > coalesce(h, 0)")
    kept = kept.select("conv_id", (F.col("place") - F.coalesce("back", F.lit(0))).alias("depth"), "said", "words")
    lent = turns.where((F.col("place") < LENT) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "head")
    lent = lent.join(convs.select("conv_id", "head", "lent"), "head").where("place <= lent").select("conv_id", F.col("place").alias("depth"), "said", "words")
    return convs.select("conv_id", "n"), kept.unionByName(lent)


def first_owned(convs: DataFrame, prefixes: DataFrame, shared: DataFrame) -> DataFrame:
    """(conv_id, n, first): the first depth of which a conversation is the owner, n + 1 if of none. shared(a, b, owner): the digests that several have."""
    open_ = stash(convs.where("n > 0").select("conv_id", "n", F.lit(1).cast("long").alias("low"), (F.col("n") + 1).alias("high")))
    done = [convs.where("n = 0").select("conv_id", "n", F.lit(1).cast("long").alias("first"))]
    while not open_.isEmpty():
        probes = open_.withColumn("depth", F.floor((F.col("low") + F.col("high")) / 2))
        probes = stash(probes.join(prefixes.select("conv_id", "depth", "a", "b"), ["conv_id", "depth"]))
        met = salted(probes, shared, ["a", "b"], "left")
        owned = F.coalesce(F.col("owner") == F.col("conv_id"), F.lit(True))
        now = stash(met.select("conv_id", "n", F.when(owned, F.col("low")).otherwise(F.col("depth") + 1).alias("low"), F.when(owned, F.col("depth")).otherwise(F.col("high")).alias("high")))
        done.append(now.where("low >= high").select("conv_id", "n", F.col("low").alias("first")))
        open_ = now.where("low < high")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return stash(found)


def _joined_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each (owner, depth) of rows sorted by it and piece: the hash of all pieces, comma-joined."""
    now, state, out = None, None, []

    def rows() -> pa.RecordBatch:
        owner, depth, digest = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(depth, pa.int64()), pa.array(digest, pa.string())], ["owner", "depth", "ends_sha256"])

    for batch in batches:
        for owner, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "ids")), strict=True):
            if now == (owner, depth):
                state.update(b",")
            else:
                out += [(*now, state.hexdigest())] if now else []
                now, state = (owner, depth), hashlib.sha256()
            state.update(ids.encode())
        yield rows()
        out = []
    if now:
        out = [(*now, state.hexdigest())]
        yield rows()


def ended(ends: DataFrame) -> DataFrame:
    """ends(owner, depth, conv_id), ids distinct: ends_sha256 of each node's ids, ascending. Ids become strings of PIECE at most where they are, and one hash state reads a node's strings in order."""
    pieces = ends.groupBy("owner", "depth", F.shiftright("conv_id", PIECE.bit_length() - 1).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    return pieces.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "piece").select("owner", "depth", "ids").mapInArrow(_joined_digests, "owner long, depth long, ends_sha256 string")


def _subtrees(chains: DataFrame) -> DataFrame:
    """chains(conv_id, up, at, leaf, tokens) to (conv_id, up, at, leaves, tokens) with what hangs below each chain, itself included. A round takes all chains that wait for no other."""
    below = chains.groupBy(F.col("up").alias("conv_id")).agg(F.count("*").alias("waits"))
    open_ = stash(chains.withColumnRenamed("leaf", "leaves").join(below, "conv_id", "left").withColumn("waits", F.coalesce("waits", F.lit(0))))
    done = None
    while not open_.isEmpty():
        ready = open_.where("waits = 0").drop("waits")
        done = ready if done is None else done.unionByName(ready)
        came = ready.groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("l"), F.sum("tokens").alias("t"), F.count("*").alias("c"))
        rest = open_.where("waits > 0").join(came, "conv_id", "left").na.fill(0, ["l", "t", "c"])
        open_ = stash(rest.select("conv_id", "up", "at", (F.col("leaves") + F.col("l")).alias("leaves"), (F.col("tokens") + F.col("t")).alias("tokens"), (F.col("waits") - F.col("c")).alias("waits")))
    return chains.select("conv_id", "up", "at", F.col("leaf").alias("leaves"), "tokens") if done is None else stash(done)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the rebuilt conversations' prefixes: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns stand by turn, null first, equal ones by a hash of role and text; null role and text are empty. Rows without
    conv_id belong to no conversation. Without conversations there is no node, not even a root. Digests have 120 bits.
    Other columns aren't read.
    """
    turns = stash(ranked_turns(conversations))
    convs, of_turns = rebuilt(turns)
    mark = F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("said")))
    half = lambda at: F.conv(F.substring(mark, at, 15), 16, 10).cast("long")
    marks = stash(of_turns.select("conv_id", "depth", "words", half(1).alias("a"), half(16).alias("b")))
    prefixes = stash(running(marks, "conv_id", "depth", ["a", "b"], F.bit_xor, Column.bitwiseXOR))
    nodes = stash(prefixes.groupBy("a", "b").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.min("depth").alias("depth"), F.min("words").alias("words")))
    owned = first_owned(convs, prefixes, nodes.where("n_convs > 1").select("a", "b", "owner"))

    root = convs.agg(F.min("conv_id"), F.count("*")).head()
    if root[0] is None:
        return convs.selectExpr("conv_id", "0L depth", "0L parent_conv_id", "0L n_convs", "0L n_children", "0L n_leaves", "0L saved_tokens", "'' ends_sha256").where("false")
    top = F.lit(root[0]).cast("long")
    # the node above a chain, or for a conversation that owns none the node at which it ends
    above = stash(owned.where("first > 1").withColumn("depth", F.col("first") - 1).join(prefixes.select("conv_id", "depth", "a", "b"), ["conv_id", "depth"]))
    above = salted(above, nodes.select("a", "b", "owner"), ["a", "b"]).select("conv_id", F.col("owner").alias("up"))
    placed = stash(owned.join(above, "conv_id", "left").select("conv_id", "n", "first", F.coalesce("up", top).alias("up")))
    ends = placed.select(F.when(F.col("first") > F.col("n"), F.col("up")).otherwise(F.col("conv_id")).alias("owner"), F.col("n").alias("depth"), "conv_id")

    nodes = nodes.select("owner", "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("tokens"))
    nodes = stash(nodes.unionByName(convs.sparkSession.range(1).select(top.alias("owner"), F.lit(0).cast("long").alias("depth"), F.lit(root[1]).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("tokens"))))
    # the root is the start of its owner's chain
    chains = placed.where((F.col("first") <= F.col("n")) & (F.col("conv_id") != top)).select("conv_id", "up", (F.col("first") - 1).alias("at"), "n")
    chains = stash(chains.unionByName(placed.where(F.col("conv_id") == top).select("conv_id", F.lit(None).cast("long").alias("up"), F.lit(-1).cast("long").alias("at"), "n")))
    hung = stash(chains.where("up is not null").groupBy(F.col("up").alias("owner"), F.col("at").alias("depth")).agg(F.count("*").alias("hung")))
    tips = chains.select(F.col("conv_id").alias("owner"), F.col("n").alias("depth")).join(hung, ["owner", "depth"], "left").select(F.col("owner").alias("conv_id"), F.col("hung").isNull().cast("long").alias("leaf"))
    own = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.sum("tokens").alias("tokens"))
    below = _subtrees(stash(chains.join(tips, "conv_id").join(own, "conv_id").select("conv_id", "up", "at", "leaf", "tokens")))

    came = below.where("up is not null").groupBy(F.col("up").alias("owner"), F.col("at").alias("depth")).agg(F.count("*").alias("came"), F.sum("leaves").alias("leaves"), F.sum("tokens").alias("more"))
    starts = chains.select(F.col("conv_id").alias("owner"), (F.col("at") + 1).alias("depth"), "up")
    last = chains.join(tips, "conv_id").select(F.col("conv_id").alias("owner"), F.col("n").alias("depth"), "leaf")
    on = ["owner", "depth"]
    full = nodes.join(came, on, "left").join(starts, on, "left").join(last, on, "left").join(ended(ends), on, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    full = stash(full.select(
        *on, "n_convs", F.when(F.col("depth") > 0, F.coalesce("up", "owner")).alias("parent_conv_id"), (zero("came") + F.col("leaf").isNull().cast("long")).alias("n_children"),
        (zero("leaf") + zero("leaves")).alias("n_leaves"), (F.col("tokens") + zero("more")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    ))
    summed = running(full, "owner", "depth", ["n_leaves", "saved_tokens"], F.sum, lambda a, b: a + b, down=True)
    return summed.select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
