"""Conversation prefix trie by partition refinement.

``trie`` starts with all conversations in one class. A round finds, for each active class, the first turn at which its
members differ or one of them has ended; the turns before it are the class's nodes, and at it the class splits by the
turn's (role, text). Equal conversations count as one with copies, so a class of copies only is a single: it retires at
once, and its tail is emitted as a chain. Rounds are as many as the most branchings on a path, not as many as turns. Folding
goes back over the rounds: leaves and saved tokens of a class are its own and those of the classes that it split into.

No class is gathered: whether its members agree at a turn is told by counts, minima and maxima of the turn's hash, which
are aggregated before they are shuffled. Ordinals of turns and sums along chains go over ranges of rows (see
``almanac.operators.ordered``), so a conversation may be of any length. The ids of equal conversations are joined in
blocks of BLOCK_IDS consecutive numbers, and a task hashes the blocks of a node one after the other.

Turns are told apart by two 64-bit hashes of role and text.

Edge cases: null roles and texts count as empty, null turns come first, turns with one number in order of role and text;
rows without a conv_id belong to no conversation and are left out; repeated rows are turns of their own; no
conversation gives no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import drop_tables, materialize
from almanac.operators.ordered import ordinals, running_sums

#: Conversation ids that are joined into one text before hashing, at most: 2 to this power.
BLOCK_BITS = 16
BLOCK_IDS = 1 << BLOCK_BITS
#: Every how many conversations are a family of ``rebuilt``, and the turns that a member takes from its head.
FAMILY, SHARED = 20, 4

_WORDS = r"[^\x20\x09-\x0D]+"


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, ordinal (from 1), hashes k1, k2 and words of each turn of ``conversations`` (conv_id, turn, role, text)."""
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    hashes = [F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "role").alias("k2")]
    turns = turns.select("conv_id", "turn", "role", "text", *hashes, F.regexp_count("text", F.lit(_WORDS)).cast("long").alias("words"))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    return ordinals(turns, ["conv_id"], order).select("conv_id", "ordinal", "k1", "k2", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of their family's head: turns (conv_id, depth, k1, k2, words) and lengths.

    A conversation c takes the first h = crc32(c) % SHARED turns of c - c % FAMILY, and its own after its first h.
    """
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).alias("h")
    convs = own.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("head"), h)
    heads = own.select(F.col("conv_id").alias("head"), F.col("own").alias("held"))
    convs = convs.join(heads, "head", "left").withColumn("taken", F.least("h", F.coalesce("held", F.lit(0))))
    first = turns.filter(F.col("ordinal") < SHARED).withColumnRenamed("conv_id", "head")
    first = convs.join(first, "head").filter("ordinal <= taken").select("conv_id", F.col("ordinal").alias("depth"), "k1", "k2", "words")
    rest = convs.select("conv_id", "h", "taken").join(turns, "conv_id").filter("ordinal > h")
    rest = rest.select("conv_id", (F.col("taken") + F.col("ordinal") - F.col("h")).alias("depth"), "k1", "k2", "words")
    length = (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")
    return first.unionByName(rest), convs.select("conv_id", length)


def _ends(copies: DataFrame) -> DataFrame:
    """rep, ends_sha256: the hash of the ids of the conversations that are copies of each; ``copies``: length, x1, x2, conv_id."""
    group = ["length", "x1", "x2"]
    block = F.shiftright("conv_id", BLOCK_BITS).alias("block")
    ids = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",")  # at most BLOCK_IDS of them
    blocks = copies.groupBy(*group, block).agg(ids.alias("ids"), F.min("conv_id").alias("least"))
    groups = blocks.groupBy(*group).agg(F.min("least").alias("rep"), F.count(F.lit(1)).alias("blocks"))
    blocks = blocks.join(groups, group)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for rep, ids in zip(batch.column("rep").to_pylist(), batch.column("ids").to_pylist()):
                if rep == now:
                    digest.update(b"," + ids.encode())
                    continue
                if digest:
                    done.append((now, digest.hexdigest()))
                now, digest = rep, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string())], names=["rep", "ends_sha256"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()], pa.string())], names=["rep", "ends_sha256"])

    long = blocks.filter("blocks > 1").select("rep", "block", "ids").repartition("rep").sortWithinPartitions("rep", "block").select("rep", "ids")
    short = blocks.filter("blocks = 1").select("rep", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    return short.unionByName(long.mapInArrow(hashes, "rep long, ends_sha256 string"))


def _sizes(members: DataFrame, *by: str | Column) -> DataFrame:
    """Classes of ``members``: least id, members, conversations, and the member that ends first."""
    first = F.min_by("conv_id", "length").alias("short")
    return members.groupBy(*by).agg(F.min("conv_id").alias("id"), F.count(F.lit(1)).alias("n"), F.sum("copies").alias("convs"), F.min("length").alias("least"), first)


def _refined(reps: DataFrame, turns: DataFrame) -> DataFrame:
    """The chains of the trie: id, top, bottom, convs, ended, up, up_top and level.

    A chain is the nodes of depths top to bottom of class ``id``; ``ended`` is the member that ends at its bottom, and
    (up, up_top) the chain below which it hangs, one level higher.
    """
    spark = reps.sparkSession
    named = "id long, top long, n long, convs long, least long, short long, up long, up_top long"
    root = _sizes(reps).first()  # one row of five numbers
    classes = spark.createDataFrame([(root["id"], 0, root["n"], root["convs"], root["least"], root["short"], None, None)] if root["n"] else [], named)
    chains = [classes.filter("n = 1").select("id", "top", F.col("least").alias("bottom"), "convs", F.col("short").alias("ended"), "up", "up_top", F.lit(0).alias("level"))]
    written: list[DataFrame] = []
    state = materialize(reps.join(turns.drop("words"), "conv_id").withColumn("id", F.lit(root["id"])), "trie-state")
    level, active = 0, root["n"] > 1
    while active:
        at = state.groupBy("id", "depth").agg(F.count(F.lit(1)).alias("here"), *[f(k).alias(f"{f.__name__}_{k}") for k in ("k1", "k2") for f in (F.min, F.max)])
        differ = at.join(classes.select("id", "n"), "id").filter("here < n OR min_k1 <> max_k1 OR min_k2 <> max_k2")
        split = materialize(classes.join(differ.groupBy("id").agg(F.min("depth").alias("split")), "id"), "trie-split")
        ended = F.when(F.col("least") == F.col("split") - 1, F.col("short")).alias("ended")
        chains.append(split.select("id", "top", (F.col("split") - 1).alias("bottom"), "convs", ended, "up", "up_top", F.lit(level).alias("level")))
        rest = state.join(split.select("id", "top", "split"), "id").filter("depth >= split").withColumnsRenamed({"id": "up", "top": "up_top"})
        kids = materialize(_sizes(rest.filter("depth = split"), "up", "up_top", "split", "k1", "k2"), "trie-kids")
        level += 1
        single = kids.filter("n = 1").select("id", F.col("split").alias("top"), F.col("least").alias("bottom"), "convs", F.col("short").alias("ended"), "up", "up_top")
        chains.append(single.withColumn("level", F.lit(level)))
        many = kids.filter("n > 1")
        classes = many.select("id", F.col("split").alias("top"), "n", "convs", "least", "short", "up", "up_top")
        moved = rest.filter("depth = split").join(many.select("id", "up", "k1", "k2"), ["up", "k1", "k2"]).select("conv_id", "id")
        left = rest.filter("depth > split").join(moved, "conv_id").select("conv_id", "copies", "length", "depth", "k1", "k2", "id")
        before, state = state, materialize(left, "trie-state")
        written += [split, kids]
        drop_tables(before)
        active = bool(many.limit(1).count())
    found = chains[0]
    for part in chains[1:]:
        found = found.unionByName(part)
    found = materialize(found, "trie-chains")
    drop_tables(state, *written)
    return found


def _folded(chains: DataFrame, own: DataFrame) -> DataFrame:
    """id, top, leaves, saved and children of each chain, from the lowest level up; ``own``: the tokens that a chain saves."""
    deepest = chains.agg(F.max("level")).first()[0]
    zero, levels, below = F.lit(0).cast("long"), [], None
    chains = chains.select("id", "top", "up", "up_top", "level").join(own, ["id", "top"], "left")
    for level in reversed(range((deepest if deepest is not None else -1) + 1)):
        done = chains.filter(F.col("level") == level)
        done = done.join(below, ["id", "top"], "left") if below is not None else done.withColumns({x: F.lit(None).cast("long") for x in ("leaves", "saved", "children")})
        saved = (F.coalesce("own", zero) + F.coalesce("saved", zero)).alias("saved")
        done = done.select("id", "top", "up", "up_top", F.coalesce("leaves", F.lit(1).cast("long")).alias("leaves"), saved, F.coalesce("children", zero).alias("children"))
        levels.append(materialize(done, "trie-fold"))
        below = levels[-1].groupBy(F.col("up").alias("id"), F.col("up_top").alias("top")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count(F.lit(1)).alias("children"))
    folded = levels[0] if levels else chains.select("id", "top", "up", "up_top", *[zero.alias(x) for x in ("leaves", "saved", "children")])
    for part in levels[1:]:
        folded = folded.unionByName(part)
    return folded.drop("up", "up_top")


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: conv_id, depth, k1, k2, words; ``lengths``: conv_id, length, of those without turns too.
    """
    turns = materialize(turns, "trie-turns")
    x1, x2 = F.bit_xor(F.xxhash64("depth", "k1", "k2")), F.bit_xor(F.xxhash64(F.lit(1), "k2", "depth", "k1"))
    signs = turns.groupBy("conv_id").agg(x1.alias("x1"), x2.alias("x2"))
    zero = F.lit(0).cast("long")
    copies = materialize(lengths.join(signs, "conv_id", "left").select("conv_id", "length", F.coalesce("x1", zero).alias("x1"), F.coalesce("x2", zero).alias("x2")), "trie-copies")
    reps = copies.groupBy("length", "x1", "x2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    reps = materialize(reps.select("conv_id", "copies", "length"), "trie-reps")
    known = turns.join(reps.select("conv_id"), "conv_id")
    chains = _refined(reps, known)

    spans = chains.select("id", "top", "bottom", "convs")
    path = known.select(F.col("conv_id").alias("id"), "depth", "words").join(spans, "id").filter("depth BETWEEN top AND bottom")
    path = path.unionByName(spans.filter("top = 0").withColumns({"depth": zero, "words": zero}))
    path = path.withColumn("own", F.when(F.col("depth") > 0, (F.col("convs") - 1) * F.col("words")).otherwise(0)).drop("words")
    shared = path.filter("convs > 1").select("id", "top", "depth", "own")
    shared = running_sums(shared, ["id", "top"], [F.col("depth").desc()], {"from_here": F.col("own")})  # of this node and those below it
    folded = _folded(chains, shared.groupBy("id", "top").agg(F.sum("own").alias("own")))
    nodes = path.join(shared.select("id", "top", "depth", "from_here"), ["id", "top", "depth"], "left")
    nodes = nodes.join(folded.join(chains.select("id", "top", "up", "ended"), ["id", "top"]).join(shared.groupBy("id", "top").agg(F.sum("own").alias("all")), ["id", "top"], "left"), ["id", "top"])
    nodes = nodes.join(_ends(copies).withColumnRenamed("rep", "ended"), "ended", "left")
    at_bottom = F.col("depth") == F.col("bottom")
    return nodes.select(
        F.col("id").alias("conv_id"),
        "depth",
        F.when(F.col("depth") == F.col("top"), F.col("up")).otherwise(F.col("id")).alias("parent_conv_id"),
        F.col("convs").alias("n_convs"),
        F.when(at_bottom, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") - F.coalesce("all", zero) + F.coalesce("from_here", zero)).alias("saved_tokens"),
        F.coalesce(F.when(at_bottom, F.col("ends_sha256")), F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of ``conversations`` (conv_id, turn, role, text), rebuilt by families."""
    return trie(*rebuilt(materialize(hashed_turns(conversations), "trie-ordinals")))
