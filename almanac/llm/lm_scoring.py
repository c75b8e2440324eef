"""LM scoring by deleted interpolation of bigram, unigram and uniform estimates.

P(w | h) = a2(b) c(h w) / c(h) + a1(b) c(w) / N + a0(b) / (V + 1), where b is the bucket (power of two) of the context's
count. The weights of each bucket are learned by expectation-maximisation on one of the ten parts of the corpus, EM_PART,
by counts from which that part's own are deleted; scores then use the counts of all nine training parts. The part that
is held out (HELD_PART) gives neither counts nor weights.

Counting and looking up take one exchange. Each task cuts its documents into chunks of CHUNK_TOKENS tokens and sends,
for each range of hashed keys, the chunk's distinct unigrams and bigrams with its training counts, as packed arrays;
the range's task adds them up and answers each chunk with the totals, in the chunk's order. A frequent key is sent
once a chunk, so no range is hot. Chunks and ranges grow with the square root of the corpus. Documents are then scored chunk by chunk from their token places and the totals.
Keys are hashes: of 64 bits for words, of SPARE_BITS more than the corpus
size needs for bigrams. What reaches the driver is N, V and a histogram for EM of a fixed number of cells.

Edge cases: a null or empty text is the end token alone; a null doc_id trains; without training documents base and
model are uniform in effect; without documents in EM_PART the weights are DEFAULT_WEIGHTS; repeated rows repeat and
count each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import materialize
from almanac.llm.packed import chunk_plan, range_edges, squeeze, squeeze_sorted, unsqueeze, unsqueeze_sorted
from almanac.llm.words import word_hashes

#: The least tokens of a chunk and of a range of keys, and bytes of text that bring about one token.
CHUNK_TOKENS = 1 << 19
RANGE_TOKENS = 1 << 21
TOKEN_BYTES = 6
#: Bigram keys have this many bits more than the count of the text's bytes, so that they meet alike at every size.
SPARE_BITS = 22
BUCKETS = 32
#: Weights of bigram, unigram and uniform estimates before EM, and in buckets that EM_PART has no tokens of.
DEFAULT_WEIGHTS = (0.5, 0.45, 0.05)
EM_ROUNDS = 40
#: Parts of the corpus, by crc32 of the id modulo 10: scored only, and learned weights from.
HELD_PART, EM_PART = 0, 1
#: Steps an octave of the estimates that EM sees: tokens of one cell count as its mean.
CELL_STEPS = 4

_END = xxhash.xxh3_64_intdigest(b" end ")
_START = xxhash.xxh3_64_intdigest(b" start ")
# un, bn: counts of the unigrams u and bigrams b; uf, bf: those of EM_PART; tokens and distinct: numbers that the driver adds up
_SHAPE = "dest int, chunk string, part int, u binary, b binary, un binary, bn binary, uf binary, bf binary, ids array<string>, sizes binary, fold int, tokens long, distinct long"
_NAMES = [x.split()[0] for x in _SHAPE.split(", ")]


def _mix(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = context * np.uint64(0x9E3779B97F4A7C15) + word
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def _bigrams(places: np.ndarray, keys: np.ndarray, starts: np.ndarray, bits: int) -> np.ndarray:
    """The bigram key of each token: of its context and itself."""
    words = keys[places[:-1]]
    context = np.empty_like(words)
    context[1:] = words[:-1]
    context[starts] = keys[places[-1]]
    return _mix(context, words) >> np.uint64(64 - bits)


def _chunk_rows(ids: list, texts: list[list[int]], fold: int, name: str, ranges: int, bits: int):
    """The rows that a chunk sends: one for each range of keys that it uses, and one with its tokens' places."""
    sizes = np.array([len(x) for x in texts], np.int64)
    words = np.fromiter((h for x in texts for h in x), np.uint64, int(sizes.sum()))
    u_keys, u_at = np.unique(np.append(words, np.uint64(_START)), return_inverse=True)
    b_keys, b_counts = np.unique(_bigrams(u_at, u_keys, np.cumsum(sizes) - sizes, bits), return_counts=True)
    train = int(fold != HELD_PART)
    u_counts = np.bincount(u_at[:-1], minlength=len(u_keys)) * train
    u_counts[u_at[-1]] = len(ids) * train  # how many texts the start precedes
    b_counts = b_counts * train
    name = f"{name}-{xxhash.xxh3_64_hexdigest(words.tobytes())}"
    u_cut = np.concatenate([[0], np.searchsorted(u_keys, range_edges(ranges)), [len(u_keys)]])
    b_cut = np.concatenate([[0], np.searchsorted(b_keys, range_edges(ranges, bits)), [len(b_keys)]])
    rows = []
    for p in range(ranges):
        u, b = slice(u_cut[p], u_cut[p + 1]), slice(b_cut[p], b_cut[p + 1])
        if u.start < u.stop or b.start < b.stop:
            rows.append((p, name, p, squeeze_sorted(u_keys[u]), squeeze_sorted(b_keys[b]), squeeze(u_counts[u], "<u8"), squeeze(b_counts[b], "<u8"), None, None, None, None, fold, None, None))
    dest = ranges + xxhash.xxh3_64_intdigest(name.encode()) % ranges
    rows.append((dest, name, -1, squeeze(u_at, "<u4"), squeeze_sorted(u_keys), None, None, None, None, ids, sizes.astype("<i8").tobytes(), fold, len(words), None))
    return rows


def _sender(chunk_tokens: int, ranges: int, bits: int):
    kinds = [pa.int32(), pa.string(), pa.int32(), *[pa.binary()] * 6, pa.list_(pa.string()), pa.binary(), pa.int32(), pa.int64(), pa.int64()]

    def send(batches):
        task = TaskContext.get().partitionId()
        opened: dict[int, tuple[list, list]] = {}
        count, size = 0, {}

        def flush(fold: int):
            nonlocal count
            rows = _chunk_rows(*opened.pop(fold), fold, f"{task}-{count}", ranges, bits)
            count, size[fold] = count + 1, 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_NAMES)

        for batch in batches:
            for key, text, fold in zip(*(c.to_pylist() for c in batch.columns)):
                words = word_hashes((text or "").encode().lower().split())
                words.append(_END)
                if size.get(fold) and size[fold] + len(words) > chunk_tokens:
                    yield flush(fold)
                ids, texts = opened.setdefault(fold, ([], []))
                ids.append(key)
                texts.append(words)
                size[fold] = size.get(fold, 0) + len(words)
        for fold in sorted(opened):
            yield flush(fold)

    return send


def _answers(rows: pa.Table) -> pa.Table:
    """For a range of keys: each chunk's totals, those of EM_PART for its chunks, and how many words of the range training saw."""
    if rows.column("part")[0].as_py() < 0:
        return rows
    folds, distinct, out = np.array(rows.column("fold")), 0, {}
    for keys, counts, own in (("u", "un", "uf"), ("b", "bn", "bf")):
        parts = [unsqueeze_sorted(x) for x in rows.column(keys).to_pylist()]
        sent = [unsqueeze(x, "<u8") for x in rows.column(counts).to_pylist()]
        unique, at = np.unique(np.concatenate(parts), return_inverse=True)
        cuts = np.cumsum([len(x) for x in parts])[:-1]
        totals = np.bincount(at, np.concatenate(sent), len(unique)).astype(np.int64)
        if keys == "u":
            distinct = int(np.count_nonzero(totals[unique != _START]))
        places = np.split(at, cuts)
        out[counts] = [squeeze(totals[x], "<u8") for x in places]
        learns = [i for i, f in enumerate(folds) if f == EM_PART]
        out[own] = [None] * len(parts)
        if learns:
            held = np.bincount(np.concatenate([places[i] for i in learns]), np.concatenate([sent[i] for i in learns]), len(unique)).astype(np.int64)
            for i in learns:
                out[own][i] = squeeze(held[places[i]], "<u8")
    out |= {"u": [None] * len(folds), "b": [None] * len(folds)}
    columns = {k: pa.array(v, pa.binary()) for k, v in out.items()} | {"distinct": pa.array([distinct] + [0] * (len(folds) - 1), pa.int64())}
    for name, found in columns.items():
        rows = rows.set_column(rows.schema.get_field_index(name), name, found)
    return rows


class _Chunk:
    """A chunk's tokens with the training counts of each: word, context, bigram."""

    def __init__(self, rows: pa.Table, bits: int, deleted: bool = False):
        ranked = np.argsort(np.array(rows.column("part")), kind="stable")  # the chunk's own row has the part -1
        get = lambda name: rows.column(name).take(pa.array(ranked)).to_pylist()

        def answers(total: str, own: str) -> np.ndarray:
            n = np.concatenate([np.empty(0, np.int64), *(unsqueeze(x, "<u8").astype(np.int64) for x in get(total)[1:])])
            return n - np.concatenate([unsqueeze(x, "<u8").astype(np.int64) for x in get(own)[1:]]) if deleted else n

        u, b = answers("un", "uf"), answers("bn", "bf")
        places, keys = unsqueeze(get("u")[0], "<u4"), unsqueeze_sorted(get("b")[0])
        self.ids, self.fold = get("ids")[0], get("fold")[0]
        self.sizes = np.frombuffer(get("sizes")[0], "<i8")
        self.starts = np.cumsum(self.sizes) - self.sizes
        n_b, at = np.unique(_bigrams(places, keys, self.starts, bits), return_inverse=True)
        if (len(u), len(b)) != (len(keys), len(n_b)):
            raise RuntimeError(f"chunk {get('chunk')[0]}: answers for {len(u)}, {len(b)} of {len(keys)}, {len(n_b)} keys")
        self.word = u[places[:-1]]
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[self.starts] = u[places[-1]]
        self.pair = b[at]

    def estimates(self, n: int):
        """(bucket, bigram estimate, unigram estimate) of each token."""
        bucket = np.minimum(np.frexp(self.context.astype(np.float64))[1], BUCKETS - 1)
        return bucket, self.pair / np.maximum(self.context, 1), self.word / max(n, 1)


def learn_weights(cells: np.ndarray, distinct: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """BUCKETS x 3 mixture weights by EM; cells: rows of (bucket, tokens, mean bigram and mean unigram estimate)."""
    weights = np.tile(np.array(DEFAULT_WEIGHTS), (BUCKETS, 1))
    if not len(cells):
        return weights
    bucket, n = cells[:, 0].astype(int), cells[:, 1]
    p = np.stack([cells[:, 2], cells[:, 3], np.full(len(cells), 1 / (distinct + 1))], 1)
    for _ in range(rounds):
        share = weights[bucket] * p
        share *= (n / share.sum(1))[:, None]
        total = np.stack([np.bincount(bucket, share[:, k], BUCKETS) for k in range(3)], 1)
        seen = total.sum(1) > 0
        # a little of the uniform estimate stays, so that no token is impossible
        weights[seen] = np.maximum(total[seen] / total[seen].sum(1, keepdims=True), (0, 0, 1e-6))
        weights /= weights.sum(1, keepdims=True)
    return weights


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType
    key = F.col("doc_id").cast("string")
    fold = F.coalesce(F.crc32(key.cast("binary")) % 10, F.lit(2)).cast("int")  # rows without an id only train
    fold = F.when(fold.isin(HELD_PART, EM_PART), fold).otherwise(2).alias("fold")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunk, ranges = chunk_plan(size // TOKEN_BYTES, CHUNK_TOKENS, RANGE_TOKENS)
    bits = min(64, int(size).bit_length() + SPARE_BITS)
    sent = docs.select(key.alias("doc_id"), "text", fold).mapInArrow(_sender(chunk, ranges, bits), _SHAPE)
    known = materialize(sent.groupBy("dest").applyInArrow(_answers, _SHAPE), "ngrams")
    sums = known.agg(F.sum(F.when(F.col("fold") != HELD_PART, F.col("tokens"))), F.sum(F.when(F.col("fold") == EM_PART, F.col("tokens"))), F.sum("distinct")).first()
    n, n_em, distinct = (x or 0 for x in sums)

    def cells(rows: pa.Table) -> pa.Table:
        bucket, p2, p1 = _Chunk(rows, bits, deleted=True).estimates(n - n_em)
        level = lambda p: np.where(p > 0, np.rint(CELL_STEPS * np.log2(np.maximum(p, 1e-30))), -999).astype(np.int64)
        names = np.stack([bucket.astype(np.int64), level(p2), level(p1)], 1)
        unique, at, many = np.unique(names, axis=0, return_inverse=True, return_counts=True)
        made = [*unique.T, many, np.bincount(at.ravel(), p2), np.bincount(at.ravel(), p1)]
        return pa.Table.from_arrays([pa.array(x) for x in made], names=["bucket", "l2", "l1", "n", "p2", "p1"])

    packed = ["chunk", "part", "u", "b", "un", "bn", "ids", "sizes", "fold"]
    found = known.filter(F.col("fold") == EM_PART).select(*packed, "uf", "bf").groupBy("chunk").applyInArrow(cells, "bucket long, l2 long, l1 long, n long, p2 double, p1 double")
    found = found.groupBy("bucket", "l2", "l1").agg(F.sum("n").alias("n"), (F.sum("p2") / F.sum("n")).alias("p2"), (F.sum("p1") / F.sum("n")).alias("p1"))
    got = sorted(tuple(x) for x in found.select("bucket", "n", "p2", "p1").collect())
    weights = learn_weights(np.array(got, np.float64).reshape(-1, 4), distinct)

    def score(rows: pa.Table) -> pa.Table:
        chunk = _Chunk(rows, bits)
        bucket, p2, p1 = chunk.estimates(n)
        w = weights[bucket]
        model = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (distinct + 1))
        base = np.log10((chunk.word + 0.1) / (n + 0.1 * (distinct + 1)))
        total = lambda x: pa.array(np.add.reduceat(x, chunk.starts))
        docs = len(chunk.ids)
        columns = {
            "doc_id": pa.array(chunk.ids, pa.string()),
            "held_out": pa.array([chunk.fold == HELD_PART] * docs),
            "n_tokens": pa.array(chunk.sizes, pa.int64()),
            "n_known": total((chunk.word > 0).astype(np.int64)),
            "train_tokens": pa.array([n] * docs, pa.int64()),
            "base_score": total(base),
            "score": total(model),
        }
        return pa.table(columns)

    schema = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = known.select(*packed).groupBy("chunk").applyInArrow(score, schema)
    return scored.withColumn("doc_id", F.col("doc_id").cast(kind))
