"""Benchmark decontamination: an FM-index for each shard of the corpus, searched for every window of a benchmark.

``build_index`` cuts a corpus, partition by partition, into shards of about SHARD_WORDS words, each row of the result
one shard's index; it knows nothing of any benchmark and can be kept as a table. ``search`` takes the benchmark's
windows in blocks of BLOCK_BYTES, finds each window's suffixes in each shard by backward search on wavelet ranks,
locates all of them by sampled suffix positions, and merges the places into removal spans. Nothing is grouped: copies
and passages that many documents share cost what they occupy.

A text of more than SLICE_BYTES is indexed in pieces that overlap by LONGEST - 1 words, so no occurrence of up to
LONGEST words is lost and a worker holds one slice at a time; pieces of a row meet again in ``removal_spans``.

Edge cases: null, empty and word-less texts have no words, no spans and no items; items without words have no windows;
equal rows give equal results, each row its own; equal item ids count once, and a null item id marks words but is not
listed; an empty corpus gives an empty result, an empty benchmark no spans; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import drop_tables, materialize, query_blocks
from almanac.llm.fm_index import FmIndex, build
from almanac.llm.words import word_slices, words_of

#: Words of a window.
WIDTH = 10
#: Words of a shard, beyond the last slice that it takes.
SHARD_WORDS = 1 << 19
SLICE_BYTES = 1 << 20
#: The longest phrase that an index finds across the pieces of a long text, in words.
LONGEST = 64
#: Texts of the benchmark that are searched for together.
BLOCK_BYTES = 4 << 20
#: Texts taken out of an Arrow batch together.
TEXT_ROWS = 256
#: Occurrences that are located together.
LOCATE_ROWS = 1 << 20

_COLUMNS = ["words", "counts", "bits", "marks", "places"]


def build_index(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row a shard of ``docs`` (doc_id, text): its pieces (row, doc_id, offset, words, words not in an earlier piece) and index."""
    kind = docs.schema["doc_id"].dataType
    shape = f"rows array<long>, ids array<{kind.simpleString()}>, offsets array<long>, sizes array<long>, fresh array<long>"
    shape += "".join(f", {c} binary" for c in _COLUMNS)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, id_kind = TaskContext.get().partitionId() << 40, None
        known: defaultdict = defaultdict()
        known.default_factory = known.__len__
        pieces: list[tuple] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            columns = [list(x) for x in zip(*pieces)]
            made = build(np.concatenate(held), np.array(columns[3]), list(known))
            arrays = [pa.array([columns[0]], pa.list_(pa.int64())), pa.array([columns[1]], pa.list_(id_kind))]
            arrays += [pa.array([x], pa.list_(pa.int64())) for x in columns[2:]]
            arrays += [pa.array([made[c]], pa.binary()) for c in _COLUMNS]
            known.clear(), pieces.clear(), held.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["rows", "ids", "offsets", "sizes", "fresh", *_COLUMNS])

        total = 0
        for whole in batches:
            for at in range(0, whole.num_rows, TEXT_ROWS):
                batch = whole.slice(at, TEXT_ROWS)
                id_kind = batch.column("doc_id").type
                for key, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    seen, tail = 0, []
                    for words in word_slices(raw, SLICE_BYTES):
                        n, words = len(words), tail + words
                        pieces.append((row, key, seen - len(tail), len(words), n))
                        held.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                        seen, tail, total = seen + n, words[len(words) - LONGEST + 1 :] if len(words) >= LONGEST else words, total + len(words)
                        if total >= shard_words:
                            total = 0
                            yield flush()
                    row += 1
        if pieces:
            yield flush()

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(shards, shape)


class Windows:
    """The distinct windows of a block of items, as numbers of their words, and the items of each window."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], width: int = WIDTH):
        if not 0 < width <= LONGEST:
            raise ValueError(f"a window has 1 to {LONGEST} words")
        found: dict[tuple, set] = defaultdict(set)
        for k, (_, raw) in enumerate(items):
            words = words_of(raw)
            for i in range(max(1, len(words) - width + 1) if words else 0):
                found[tuple(words[i : i + width])].add(k)
        self.names = [name for name, _ in items]
        number = {w: i for i, w in enumerate(sorted({w for x in found for w in x}))}
        self.words = list(number)
        self.lengths = np.array([len(x) for x in found], np.int64)
        self.phrases = np.zeros((len(found), width), np.int64)
        for i, x in enumerate(found):
            self.phrases[i, width - len(x) :] = [number[w] for w in x]
        sizes = np.array([len(x) for x in found.values()], np.int64)
        self.owner_starts = np.cumsum(sizes) - sizes
        self.owner_sizes = sizes
        self.owners = np.array([k for x in found.values() for k in sorted(x)], np.int64)


def _expanded(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def search_shard(index: FmIndex, windows: Windows) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[list[str]]]:
    """For each piece its merged spans, as first words and ends, and the names of the items whose windows it holds."""
    pieces = len(index.sizes)
    symbols = np.array([index.symbols.get(w, 0) for w in windows.words] or [0], np.int64)
    low, high = index.find(symbols[windows.phrases] if len(windows.lengths) else windows.phrases, windows.lengths)
    hit = np.flatnonzero(high > low)
    ends = np.cumsum((high - low)[hit])
    edge, pairs = np.zeros(index.n + 1, np.int64), [np.empty(0, np.int64)]
    at = 0
    while at < len(hit):  # a window's places are never divided, but windows are
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LOCATE_ROWS, "right")))
        some = hit[at:to]
        sizes = (high - low)[some]
        place = index.locate(_expanded(low[some], sizes))
        window = np.repeat(some, sizes)
        edge += np.bincount(place, minlength=index.n + 1)
        edge -= np.bincount(place + windows.lengths[window], minlength=index.n + 1)
        piece = np.searchsorted(index.starts, place, "right") - 1
        key = np.unique(piece * len(windows.lengths) + window)
        piece, window = key // len(windows.lengths), key % len(windows.lengths)
        many = windows.owner_sizes[window]
        pairs.append(np.unique(np.repeat(piece, many) * len(windows.names) + windows.owners[_expanded(windows.owner_starts[window], many)]))
        at = to
    covered = np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=0)
    first, end = np.flatnonzero(covered > 0), np.flatnonzero(covered < 0)  # separators are never covered
    piece = np.searchsorted(index.starts, first, "right") - 1
    cuts = np.searchsorted(piece, np.arange(pieces + 1))
    spans = [(first[a:b] - s, end[a:b] - s) for a, b, s in zip(cuts[:-1], cuts[1:], index.starts)]
    names: list[list[str]] = [[] for _ in range(pieces)]
    for x in np.unique(np.concatenate(pairs)).tolist():
        name = windows.names[x % len(windows.names)]
        if name is not None:
            names[x // len(windows.names)].append(name)
    return spans, names


def search(index: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """For each piece of ``index`` and block of ``items`` (item_id, text): row, doc_id, n_words, starts, ends and items.

    Places are words of the whole text. Pieces without a place are there too, for their words.
    """
    kind = index.schema["ids"].dataType.elementType.simpleString()
    shape = f"row long, doc_id {kind}, n_words long, starts array<long>, ends array<long>, items array<string>"

    def searched(windows: Windows, counted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    get = lambda c: batch.column(c)[k].as_py()
                    offsets = np.array(get("offsets"), np.int64)
                    spans, names = search_shard(FmIndex(np.array(get("sizes")), *(get(c) for c in _COLUMNS)), windows)
                    fresh = get("fresh") if counted else [0] * len(offsets)
                    ids = batch.column("ids")[k].values
                    longs = pa.list_(pa.int64())
                    starts, ends = (pa.array([x[j] + o for x, o in zip(spans, offsets)], longs) for j in (0, 1))
                    arrays = [pa.array(get("rows"), pa.int64()), ids, pa.array(fresh, pa.int64()), starts, ends, pa.array(names, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "n_words", "starts", "ends", "items"])

        return run

    rows = items.select(F.col("item_id").cast("string").alias("name"), F.col("text").cast("binary").alias("text"))
    rows = rows.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)) + 1)
    found = None
    for block in query_blocks(rows, "size", BLOCK_BYTES):
        windows = Windows([(x["name"], bytes(x["text"]) if x["text"] is not None else None) for x in block], width)
        part = index.mapInArrow(searched(windows, found is None), shape)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else index.mapInArrow(searched(Windows([], width), True), shape)


#: Spans (start, end), in order, with those that touch or overlap made one.
_MERGE = """aggregate(spans, cast(array() AS array<struct<start: bigint, end: bigint>>), (a, s) -> CASE
    WHEN size(a) = 0 OR s.start > element_at(a, -1).end THEN array_append(a, s)
    WHEN s.end <= element_at(a, -1).end THEN a
    ELSE array_append(slice(a, 1, size(a) - 1), named_struct('start', element_at(a, -1).start, 'end', s.end)) END)"""


def removal_spans(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, spans (start, end in words, disjoint and ascending) and items of each row of ``docs``.

    The index is written, so that each block of items reads it, and dropped once the places are written.
    """
    index = materialize(build_index(docs), "fm-index")
    found = materialize(search(index, items, width), "places")
    drop_tables(index)
    pair = F.transform(F.arrays_zip("starts", "ends"), lambda x: F.struct(x["starts"].alias("start"), x["ends"].alias("end"))).alias("spans")
    found = found.select("row", "doc_id", "n_words", pair, "items")
    gathered = found.groupBy("row").agg(
        F.any_value("doc_id").alias("doc_id"),
        F.sum("n_words").alias("n_words"),
        F.count(F.lit(1)).alias("parts"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),  # bounded by the pieces of one text
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    spans = F.when(F.col("parts") == 1, F.col("spans")).otherwise(F.expr(_MERGE))
    return gathered.select("doc_id", "n_words", spans.alias("spans"), "items")


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row of ``docs``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = removal_spans(docs, items, width).withColumn("n_hit", hit)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
