"""Token counts: Arrow batches encoded by the tokenizer's library, of which only lengths come back.

Texts are dealt into work batches balanced by UTF-8 bytes, which go on from one Arrow batch to the next; long texts are
cut at safe boundaries first, so one very long text neither swells a batch nor holds the whole encoding in memory.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); special strings inside a text count as the library
counts them by default; repeated rows repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.units import UnitCache, spaced_units, split_long

#: Bytes of text that a work batch holds, and characters beyond which a text is cut.
BATCH_BYTES = 4 << 20
LONG_CHARS = 1 << 20


@functools.lru_cache(maxsize=4)
def _counter(path: str):
    """(texts -> token counts, whether texts may be cut at safe boundaries); one for each worker process and file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], False
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    lengths = lambda texts: [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    pre = spec.get("pre_tokenizer") or {}
    plain = not spec.get("normalizer") and not any(x["lstrip"] or x["rstrip"] or " " in x["content"] for x in spec["added_tokens"])
    if not (plain and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")):
        return lengths, False
    after = UnitCache(lambda units: lengths([" " + x for x in units]))

    def count(texts: list[str]) -> list[int]:
        cut = [spaced_units(x) for x in texts]
        firsts = lengths([x[0] for x in cut])
        return [n + sum(x) for n, x in zip(firsts, after.lookup([x[1:] for x in cut]))]

    return count, True


class _Work:
    """Pieces of texts gathered up to BATCH_BYTES, whatever Arrow batches they come in, and the counts of their rows."""

    def __init__(self, count, splits: bool):
        self.count, self.splits = count, splits
        self.open: list[tuple[pa.RecordBatch, list[int]]] = []  # batches with a piece that is not counted yet
        self.places: list[tuple[list[int], int]] = []
        self.pieces: list[str] = []
        self.size = 0

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts = [0] * batch.num_rows
        self.open.append((batch, counts))
        for i, (text, size) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            long = self.splits and len(text) > LONG_CHARS
            for piece in split_long(text, LONG_CHARS) if long else (text,):
                self.places.append((counts, i))
                self.pieces.append(piece)
                self.size += len(piece.encode()) if long else size
                if self.size >= BATCH_BYTES:
                    self.work()
        if not self.pieces:
            yield from self.done()
        elif len(self.open) > 1 and self.places[0][0] is counts:
            yield from self.done(keep=1)

    def work(self) -> None:
        for (counts, i), n in zip(self.places, self.count(self.pieces)):
            counts[i] += n
        self.places, self.pieces, self.size = [], [], 0

    def done(self, keep: int = 0) -> Iterator[pa.RecordBatch]:
        """Batches whose pieces are all counted."""
        ready, self.open = self.open[: len(self.open) - keep], self.open[len(self.open) - keep :]
        for batch, counts in ready:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        work = _Work(*_counter(path))
        for batch in batches:
            yield from work.add(batch)
        if work.pieces:
            work.work()
        yield from work.done()

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(run, f"doc_id {kind.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
