"""Ranked lexical search by TPUT, three phases with one uniform threshold, over term-partitioned postings.

``postings`` keeps the lists of the query terms: a term belongs to one of BUCKETS, and a row holds the part of a
bucket's lists that a chunk of documents makes, so the list of a term that every document has lies in many rows and no
task ever needs a list whole.

1. Each list gives its HEADS best entries; what an item's documents sum to in them makes its k-th best a lower bound.
2. The bound divided by the number of the item's lists is a threshold; every list gives all entries that reach it. Each
   chunk sums them for each item; the k-th best sum of all chunks is a better lower bound. A document stays a candidate
   if its sum, with the most that the lists where it has not been seen can add, reaches that bound.
3. The exact scores of the candidates are looked up in all lists, and the first k are returned.

Items are taken in blocks of BLOCK_BYTES of text, so what is sent to tasks (terms, weights, thresholds) has a bound that
does not depend on the corpus; heads are at most HEADS a term.

Edge cases: null and word-less texts are in no list, and do not count in N; an item without known terms has no rows;
repeated documents and repeated items are ranked each on its own; a null doc_id comes after others of equal score; an
empty corpus or benchmark gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import drop_tables, materialize, query_blocks
from almanac.llm.packed import squeeze, unsqueeze
from almanac.llm.words import word_slices, words_of

TOP = 10
#: Entries of each list that phase 1 reads.
HEADS = 64
BUCKETS = 16
#: Words of a chunk's documents, beyond its last document, and documents of a chunk.
CHUNK_WORDS = 1 << 20
CHUNK_DOCS = 1 << 13
SLICE_BYTES = 1 << 20
#: Item texts that are searched for together.
BLOCK_BYTES = 1 << 20
TEXT_ROWS = 256

#: bucket -1 is the chunk's own row: its documents' ids and lengths.
_LISTS = "bucket int, chunk long, terms array<int>, counts array<long>, docs binary, tf binary, lengths binary, ids array<{kind}>, n_docs long, n_words long"


def postings(docs: DataFrame, terms: list[bytes], chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """The lists of ``terms`` (a term is named by its place) in ``docs`` (doc_id, text), a row for each bucket and chunk."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(terms, 1)}
        chunk, id_kind = TaskContext.get().partitionId() << 32, None
        ids: list = []
        lengths: list[int] = []
        keys: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            key, tf = np.unique(np.concatenate([np.empty(0, np.int64), *keys]), return_counts=True)
            term, doc = key >> 32, key & 0xFFFFFFFF
            sizes = squeeze(np.array(lengths), "<u8")
            rows = [(-1, chunk, [], [], None, None, sizes, ids, sum(x > 0 for x in lengths), sum(lengths))]
            for bucket in range(BUCKETS):
                on = np.flatnonzero(term % BUCKETS == bucket)
                if len(on):
                    held, counts = np.unique(term[on], return_counts=True)
                    rows.append((bucket, chunk, held, counts, squeeze(doc[on], "<u4"), squeeze(tf[on], "<u4"), sizes, None, 0, 0))
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.list_(id_kind), pa.int64(), pa.int64()]
            arrays = [pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _LISTS.split(", ")])

        words_held = 0
        for whole in batches:
            for at in range(0, whole.num_rows, TEXT_ROWS):
                batch = whole.slice(at, TEXT_ROWS)
                id_kind = batch.column("doc_id").type
                for key, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    n = 0
                    for words in word_slices(raw, SLICE_BYTES):
                        n += len(words)
                        found = np.array(list(filter(None, map(number.get, words))), np.int64)
                        if len(found):
                            keys.append(((found - 1) << 32) | len(ids))
                    ids.append(key)
                    lengths.append(n)
                    words_held += n
                    if words_held >= chunk_words or len(ids) >= CHUNK_DOCS:
                        yield flush()
                        chunk, words_held = chunk + 1, 0
                        ids, lengths, keys = [], [], []
        if ids:
            yield flush()

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(lists, _LISTS.format(kind=kind))


class Scores:
    """What a posting adds to a score, in whole numbers."""

    def __init__(self, n: int, words: int, df: dict[int, int]):
        self.n, self.words = n, words
        most = max(df, default=-1) + 1
        self.weight = np.zeros(most, np.int64)
        for term, held in df.items():
            self.weight[term] = math.floor(1000 * math.log((2 * n + 2) / (2 * held + 1)))

    def of(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        m = 25 + (75 * length * self.n) // max(self.words, 1)
        return self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _opened(batch: pa.RecordBatch, k: int, scores: Scores) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """term, document (place in its chunk) and what it adds, of a row of lists; by term, then by document."""
    get = lambda c: batch.column(c)[k].as_py()
    term = np.repeat(np.array(get("terms"), np.int64), np.array(get("counts"), np.int64))
    doc, tf = unsqueeze(get("docs"), "<u4").astype(np.int64), unsqueeze(get("tf"), "<u4").astype(np.int64)
    return term, doc, scores.of(term, tf, unsqueeze(get("lengths"), "<u8").astype(np.int64)[doc])


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names.split())


def _heads(scores: Scores, most: int):
    """The best entries of each list in what a task reads."""

    def best(parts: list[tuple]) -> tuple:
        term, chunk, doc, adds = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((-adds, term))
        term = term[order]
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        keep = np.arange(len(term)) - np.repeat(first, np.diff(np.append(first, len(term)))) < most
        order = order[keep]
        return term[keep], chunk[order], doc[order], adds[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for k in range(batch.num_rows):
                term, doc, adds = _opened(batch, k, scores)
                held.append(best([(term, np.full(len(term), batch.column("chunk")[k].as_py()), doc, adds)]))
                if sum(len(x[0]) for x in held) > 1 << 20:
                    held = [best(held)]
        if held:
            yield _batch("term chunk doc adds", *best(held))

    return run


class _Items:
    """Items of a block as (term, times) lists, and their thresholds."""

    def __init__(self, lists: list[list[tuple[int, int]]], bounds: dict[int, int]):
        self.lists, self.bounds = lists, [bounds.get(i, 0) for i in range(len(lists))]
        self.least = [max(1, -(-b // max(1, len(x)))) for b, x in zip(self.bounds, lists)]  # the threshold, rounded up

    def terms(self, size: int) -> np.ndarray:
        """For each term the least that an entry must add to reach the threshold of some item."""
        need = np.full(size, np.iinfo(np.int64).max)
        for least, pairs in zip(self.least, self.lists):
            for term, times in pairs:
                need[term] = min(need[term], -(-least // times))
        return need


def _above(scores: Scores, need: np.ndarray):
    """Of each row of lists the entries that reach their term's need, packed for their chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                term, doc, adds = _opened(batch, k, scores)
                on = adds >= need[term]
                arrays = [pa.array([batch.column("chunk")[k].as_py()], pa.int64()), *[pa.array([squeeze(x[on], "<u8")], pa.binary()) for x in (term, doc, adds)]]
                yield pa.RecordBatch.from_arrays(arrays, names=["chunk", "term", "doc", "adds"])

    return run


def _gathered(rows: pa.Table) -> pa.Table:
    """A chunk's entries in one row, by term."""
    term, doc, adds = (np.concatenate([unsqueeze(x, "<u8") for x in rows.column(c).to_pylist()]) for c in ("term", "doc", "adds"))
    order = np.argsort(term, kind="stable")
    return pa.table({"chunk": rows.column("chunk").slice(0, 1), **{n: [squeeze(x[order], "<u8")] for n, x in (("term", term), ("doc", doc), ("adds", adds))}})


def _sums(items: _Items, batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each item with entries in a chunk: its documents, what they sum to, and what they can reach."""
    term, doc, adds = (unsqueeze(batch.column(c)[k].as_py(), "<u8").astype(np.int64) for c in ("term", "doc", "adds"))
    held, starts = np.unique(term, return_index=True)
    place = dict(zip(held.tolist(), zip(starts.tolist(), np.append(starts[1:], len(term)).tolist())))
    size = int(doc.max()) + 1 if len(doc) else 0
    for item, (pairs, least) in enumerate(zip(items.lists, items.least)):
        total, seen = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for t, times in pairs:
            if t in place:
                a, b = place[t]
                x, d = adds[a:b] * times, doc[a:b]
                on = x >= least
                total[d[on]] += x[on]
                seen[d[on]] += 1
        here = np.flatnonzero(total)
        if len(here):
            yield item, here, total[here], (total + (len(pairs) - seen) * (least - 1))[here]


def _best_sums(items: _Items, top: int):
    """Of each chunk the ``top`` best sums of each item: the best of all chunks are a lower bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = [(item, np.partition(total, -top)[-top:] if len(total) > top else total) for item, _, total, _ in _sums(items, batch, k)]
                yield _batch("item total", np.repeat([i for i, _ in found], [len(x) for _, x in found]).astype(np.int64), np.concatenate([np.empty(0, np.int64), *(x for _, x in found)]))

    return run


def _candidates(items: _Items, bounds: dict[int, int]):
    """Documents that can reach the lower bound of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = [(item, here[reach >= bounds.get(item, 0)]) for item, here, _, reach in _sums(items, batch, k)]
                item = np.repeat([i for i, _ in found], [len(x) for _, x in found]).astype(np.int64)
                doc = np.concatenate([np.empty(0, np.int64), *(x for _, x in found)])
                yield _batch("chunk item doc", np.full(len(item), batch.column("chunk")[k].as_py()), item, doc)

    return run


def _looked_up(scores: Scores, items: _Items):
    """What a row of lists adds to each candidate of its chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk = batch.column("chunk")[k].as_py()
                item, wanted = (np.array(batch.column(c)[k].values, np.int64) for c in ("items", "wanted"))
                term, doc, adds = _opened(batch, k, scores)
                first = dict(zip(*(x.tolist() for x in np.unique(term, return_index=True))))
                count = dict(zip(batch.column("terms")[k].as_py(), batch.column("counts")[k].as_py()))
                total = np.zeros(len(item), np.int64)
                order = np.argsort(item, kind="stable")
                own, starts = np.unique(item[order], return_index=True)
                for i, at in zip(own.tolist(), np.split(order, starts[1:])):
                    for t, times in items.lists[i]:
                        if t in first:
                            a, b = first[t], first[t] + count[t]
                            place = np.minimum(np.searchsorted(doc[a:b], wanted[at]), b - a - 1)
                            total[at] += np.where(doc[a:b][place] == wanted[at], adds[a:b][place], 0) * times
                yield _batch("item chunk doc adds", item, np.full(len(item), chunk), wanted, total)

    return run


def _block(docs: DataFrame, rows: list, top: int) -> DataFrame:
    """item (its place in the block), rank, doc_id and score of the first documents of each item."""
    spark = docs.sparkSession
    texts = [Counter(words_of(bytes(x["text"]) if x["text"] is not None else None)) for x in rows]
    terms = sorted({w for x in texts for w in x})
    number = {w: i for i, w in enumerate(terms)}
    held = materialize(postings(docs, terms), "postings")
    own, lists = held.filter("bucket < 0"), held.filter("bucket >= 0").drop("ids")
    n, words = own.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    df = lists.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df"))
    df = {x["terms"]: x["df"] for x in df.collect()}  # a row a term of the block
    scores = Scores(n, words, df)
    pairs = [sorted((number[w], k) for w, k in x.items() if number[w] in df) for x in texts]

    # phase 1: heads of lists, lower bounds
    best = Window.partitionBy("term").orderBy(F.col("adds").desc())
    heads = lists.mapInArrow(_heads(scores, HEADS), "term long, chunk long, doc long, adds long")
    heads = heads.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= HEADS)
    uses = spark.createDataFrame([(i, t, k) for i, x in enumerate(pairs) for t, k in x], "item long, term long, times long")
    sums = heads.join(F.broadcast(uses), "term").groupBy("item", "chunk", "doc").agg(F.sum(F.col("adds") * F.col("times")).alias("total"))
    kth = Window.partitionBy("item").orderBy(F.col("total").desc())
    sums = sums.withColumn("place", F.row_number().over(kth)).filter(F.col("place") == top)
    items = _Items(pairs, {x["item"]: x["total"] for x in sums.collect()})  # a row an item of the block

    # phase 2: all entries that reach the thresholds
    need = items.terms(len(scores.weight))
    packed = "chunk long, term binary, doc binary, adds binary"
    above = materialize(lists.mapInArrow(_above(scores, need), packed).groupBy("chunk").applyInArrow(_gathered, packed), "entries")
    sums = above.mapInArrow(_best_sums(items, top), "item long, total long").withColumn("place", F.row_number().over(kth)).filter(F.col("place") == top)
    bounds = {x["item"]: max(x["total"], items.bounds[x["item"]]) for x in sums.collect()}  # a row an item of the block
    kept = above.mapInArrow(_candidates(items, bounds), "chunk long, item long, doc long")

    # phase 3: exact scores of the candidates
    wanted = kept.groupBy("chunk").agg(F.collect_list(F.struct("item", "doc")).alias("x"))  # bounded by the block and a chunk
    wanted = wanted.select("chunk", F.col("x.item").alias("items"), F.col("x.doc").alias("wanted"))
    exact = lists.join(wanted, "chunk").mapInArrow(_looked_up(scores, items), "item long, chunk long, doc long, adds long")
    exact = exact.groupBy("item", "chunk", "doc").agg(F.sum("adds").alias("score")).filter("score > 0")
    # ties at the k-th place are settled by doc_id, so all of them are kept until then
    exact = exact.withColumn("place", F.rank().over(Window.partitionBy("item").orderBy(F.col("score").desc()))).filter(F.col("place") <= top)
    named = own.join(exact.select("chunk").distinct(), "chunk", "left_semi").select("chunk", F.posexplode("ids").alias("doc", "doc_id"))
    final = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "chunk", "doc")
    found = exact.join(named, ["chunk", "doc"]).withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= top)
    found = materialize(found.select("item", "rank", "doc_id", "score"), "ranks")
    drop_tables(held, above)
    return found


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` best documents (doc_id, text) of each of ``items`` (item_id, text)."""
    spark, shape = docs.sparkSession, items.schema["item_id"]
    rows = items.select("item_id", F.col("text").cast("binary").alias("text"))
    rows = rows.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)) + 1)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"item_id {shape.dataType.simpleString()}, rank int, doc_id {kind}, score long")
    for block in query_blocks(rows, "size", BLOCK_BYTES):
        names = spark.createDataFrame([(i, x["item_id"]) for i, x in enumerate(block)], f"item long, item_id {shape.dataType.simpleString()}")
        ranked = _block(docs, block, top)
        found = found.unionByName(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return found
