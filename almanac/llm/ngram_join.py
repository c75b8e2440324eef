"""N-gram Jaccard join: connected components of documents whose shingle sets are similar, exactly.

Adaptive multi-match prefixes. Shingles are ordered by corpus frequency, rarest first. Two sets of Jaccard similarity t
share at least ceil(t n) shingles of either one's n; so with prefixes of n - ceil(t n) + l shingles they share at least
l. Each document picks the l (1 to MAX_MATCHES) whose longer prefix promises fewer candidates, and a pair is verified
only if its prefixes share min(l, l') shingles.

1. One pass hashes each text's shingles. A task cuts its documents into chunks and sends each chunk's distinct shingles,
   with the number of its sets that hold them, to ranges of the hash space, packed; which sets hold them stays with
   the chunk's own row, so a shingle of many sets costs a range one entry a chunk. A range answers with the shingles
   that two or more sets hold, and in how many they are.
2. Each chunk picks its sets' prefixes. Shingles of one set only come first in them and are never sent on; the position
   of the first shared one is kept.
3. Every prefix shingle names one hub, the set in which it comes earliest, and links its other sets to it. Around a
   common origin of many near copies that is the origin: the family collapses in about as many checks as it has members.
4. A shingle whose sets are in one component by then is done. For the others, sets of different components are paired,
   those of a shingle's largest component only with the rest. No link between different texts is lost.

A pair of either step passes four filters before it is verified: lengths; positions, since sets whose first common
shingle stands at places p and q share at most min(n - p, n' - q); the min(l, l') shared prefix shingles; and then the
shingles of both texts, exactly. Step 4 costs what passes the first two: a family whose members are many, near, but
not within the threshold of each other, and without rare shingles of their own, is compared member by member.

Sets are named by 64-bit hashes, as are shingles. Texts to verify are fetched by doc_id and text hash, by a join that
broadcasts these keys up to BROADCAST_BYTES and shuffles beyond. Chunks and ranges grow with the square root of the
input, so that the rows sent, one for each chunk and range, hold about as many shingles at every size.

Edge cases: null, empty and word-less texts have no shingles and are linked with nothing; texts of fewer than five
words are one shingle; equal sets share a class; a null doc_id is grouped like others but never names a component;
repeated rows repeat; an empty table gives an empty result; other columns are ignored. ``keep_first`` goes by sets, so
null and repeated ids lose no text that is a copy of none.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import SLICE_ROWS, TEXT_BATCH_BYTES, by_slices, drop_tables, materialize
from almanac.llm.components import connected_components
from almanac.llm.packed import chunk_plan, range_edges, squeeze, squeeze_sorted, unsqueeze, unsqueeze_sorted
from almanac.llm.words import word_hashes

WIDTH = 5
PERCENT = 75
MAX_MATCHES = 4
#: Hubs that a set is compared with in step 3; step 4 covers what this leaves.
HUBS = 3
#: The least shingles of a chunk and of a range, and bytes of text that bring about one.
CHUNK_SHINGLES = 1 << 19
RANGE_SHINGLES = 1 << 21
SHINGLE_BYTES = 6
#: Shingles of a range that are sorted together.
SLICE_SHINGLES = 1 << 18
#: Keys of texts up to this size are broadcast.
BROADCAST_BYTES = 16 << 20


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = np.array(word_hashes((text or "").encode().lower().split()), np.uint64)
    n = len(words)
    if not n:
        return words
    width = min(WIDTH, n)
    with np.errstate(over="ignore"):
        h = words[: n - width + 1] + np.uint64(width)
        for k in range(1, width):
            h = h * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            h = h + words[k : n - width + 1 + k]
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def _set_id(found: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64)))


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    common = len(a) + len(b) - len(np.union1d(a, b))
    return common > 0 and 100 * common >= percent * (len(a) + len(b) - common)


# Frequencies and prefixes

_SENT_SHAPE = "dest int, chunk string, part int, keys binary, counts binary, owners binary, docs array<{kind}>, sizes array<long>, sets array<long>, texts array<long>"
_SENT = [x.split()[0] for x in _SENT_SHAPE.split(", ")]
_PROFILE = [("doc_id", None), ("t", pa.int64()), ("n", pa.int64()), ("s", pa.int64()), ("l", pa.int32()), ("at", pa.int64()), ("prefix", pa.list_(pa.int64()))]


def prefix(freq: np.ndarray, n: int, percent: int = PERCENT) -> tuple[int, int]:
    """How many shared shingles the adaptive prefix of a set of ``n`` holds, and the matches l that it supports.

    ``freq``: ascending numbers of sets that hold each of its shared shingles; its other shingles come before them.
    """
    base = n + percent * n // -100 + 1
    most = min(MAX_MATCHES, n - base + 1)
    held = np.clip(base + np.arange(most) - (n - len(freq)), 0, len(freq))
    meets = np.append(0, np.cumsum(freq - 1))[held]  # other sets that the prefix meets; l matches thin them
    step = np.arange(most)
    matches = int(np.argmin(meets / (step + 1) ** 2 + step))
    return int(held[matches]), matches + 1


def _sender(chunk_shingles: int, ranges: int, kind):
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(kind), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    edges = range_edges(ranges)
    chunk_docs = chunk_shingles // 128

    def rows_of(ids: list, sets: list[np.ndarray], texts: list[int], name: str):
        names = [_set_id(x) if len(x) else None for x in sets]
        first: dict[int, int] = {}
        for i, s in enumerate(names):
            if s is not None:
                first.setdefault(s, i)
        own = list(first.values())
        tokens = np.concatenate([np.empty(0, np.uint64), *(sets[i] for i in own)])
        owner = np.repeat(np.array(own, np.uint32), [len(sets[i]) for i in own])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        lead = np.flatnonzero(np.concatenate([np.ones(min(1, len(tokens)), bool), tokens[1:] != tokens[:-1]]))
        keys, counts = tokens[lead], np.diff(np.append(lead, len(tokens)))
        name = f"{name}-{xxhash.xxh3_64_hexdigest(tokens.tobytes())}"
        cut = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
        rows = [(p, name, p, squeeze_sorted(keys[lo:hi]), squeeze(counts[lo:hi], "<u4"), None, None, None, None, None) for p, (lo, hi) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if lo < hi]
        dest = ranges + xxhash.xxh3_64_intdigest(name.encode()) % ranges
        rows.append((dest, name, -1, None, squeeze(counts, "<u4"), squeeze(owner, "<u4"), ids, [len(x) for x in sets], [x or 0 for x in names], texts))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_SENT)

    def send(batches):
        task, count, size, ids, sets, texts = TaskContext.get().partitionId(), 0, 0, [], [], []
        for batch in batches:
            rows = (row for lo in range(0, batch.num_rows, SLICE_ROWS) for row in zip(*(c.to_pylist() for c in batch.slice(lo, SLICE_ROWS).columns)))
            for key, text, name in rows:
                found = shingles(text)
                if ids and (size + len(found) > chunk_shingles or len(ids) == chunk_docs):
                    yield rows_of(ids, sets, texts, f"{task}-{count}")
                    count, size, ids, sets, texts = count + 1, 0, [], [], []
                ids.append(key)
                sets.append(found)
                texts.append(name)
                size += len(found)
        if ids:
            yield rows_of(ids, sets, texts, f"{task}-{count}")

    return send


def _slices(parts: list[np.ndarray]):
    """Where each of the sorted ``parts`` begins and ends in each of a few slices of their common key range."""
    lo, hi = min(int(x[0]) for x in parts), max(int(x[-1]) for x in parts)
    many = 1 + sum(map(len, parts)) // SLICE_SHINGLES
    edges = np.array([lo + (hi - lo) * k // many for k in range(1, many)], np.uint64)
    ends = [[0, *np.searchsorted(x, edges).tolist(), len(x)] for x in parts]
    for k in range(many):
        yield [(x[k], x[k + 1]) for x in ends]


def _answers(rows: pa.Table) -> pa.Table:
    """For a range of shingles: which of each chunk's are in two or more sets, and in how many."""
    if rows.column("part")[0].as_py() < 0:
        return rows
    parts = [unsqueeze_sorted(x) for x in rows.column("keys").to_pylist()]
    counts = [unsqueeze(x, "<u4") for x in rows.column("counts").to_pylist()]
    shared, totals = [[] for _ in parts], [[] for _ in parts]
    for cut in _slices(parts):  # a slice of the keys at a time bounds what sorting them takes
        unique, at = np.unique(np.concatenate([x[lo:hi] for x, (lo, hi) in zip(parts, cut)]), return_inverse=True)
        total = np.bincount(at, np.concatenate([x[lo:hi] for x, (lo, hi) in zip(counts, cut)]), len(unique)).astype(np.int64)[at]
        end = 0
        for i, (lo, hi) in enumerate(cut):
            own, end = total[end : end + hi - lo], end + hi - lo
            found = np.flatnonzero(own > 1)
            shared[i].append(found + lo)
            totals[i].append(own[found])
    keys, freqs, places = [], [], []
    for own, at, total in zip(parts, map(np.concatenate, shared), map(np.concatenate, totals)):
        keys.append(squeeze_sorted(own[at]))
        freqs.append(squeeze(total, "<u8"))
        places.append(len(own).to_bytes(8, "little") + squeeze_sorted(at.astype(np.uint64)))
    for name, found in (("keys", keys), ("counts", freqs), ("owners", places)):
        rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array(found, pa.binary()))
    return rows


def _prefixes(rows: pa.Table) -> pa.Table:
    """The profile of every document of a chunk; the prefix of a set stands with its first document."""
    part = np.array(rows.column("part"))
    ranked = np.argsort(part, kind="stable")  # the chunk's own row has the part -1
    get = lambda name: rows.column(name).take(pa.array(ranked))
    own = {k: get(k)[0].as_py() for k in ("chunk", "sizes", "sets")}
    packed, owners = get("counts").to_pylist(), get("owners").to_pylist()
    counts, owner = unsqueeze(packed[0], "<u4").astype(np.int64), unsqueeze(owners[0], "<u4").astype(np.int64)
    shift, keys, freqs, places = 0, [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for k, f, p in zip(get("keys").to_pylist()[1:], packed[1:], owners[1:]):
        keys.append(unsqueeze_sorted(k))
        freqs.append(unsqueeze(f, "<u8"))
        places.append(unsqueeze_sorted(p[8:]).astype(np.int64) + shift)
        shift += int.from_bytes(p[:8], "little")
    if part[ranked[0]] >= 0 or shift != len(counts):
        raise RuntimeError(f"chunk {own['chunk']}: answers for {shift} of {len(counts)} shingles")
    keys, freqs, places = np.concatenate(keys), np.concatenate(freqs).astype(np.int64), np.concatenate(places)
    times = counts[places]
    start = (np.cumsum(counts) - counts)[places]
    entry = np.repeat(start - (np.cumsum(times) - times), times) + np.arange(times.sum())
    owner, keys, freqs = owner[entry], np.repeat(keys, times), np.repeat(freqs, times)
    order = np.lexsort((keys, freqs, owner))  # rarest first in each set
    owner, keys, freqs = owner[order], keys[order], freqs[order]
    sizes, docs = own["sizes"], len(own["sizes"])
    matches, at, held = [None] * docs, [None] * docs, [None] * docs
    cut = np.flatnonzero(np.concatenate([np.ones(min(1, len(owner)), bool), owner[1:] != owner[:-1]])).tolist() + [len(owner)]
    for lo, hi in zip(cut[:-1], cut[1:]):
        i = int(owner[lo])
        many, least = prefix(freqs[lo:hi], sizes[i])
        if many:
            matches[i], at[i], held[i] = least, sizes[i] - (hi - lo), keys[lo : lo + many].view(np.int64)
    names = [s if n else None for s, n in zip(own["sets"], sizes)]
    columns = [get("docs")[0].values, get("texts")[0].values, sizes, names, matches, at, held]
    return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, (_, k) in zip(columns, _PROFILE)], names=[x for x, _ in _PROFILE])


def _profiles(docs: DataFrame) -> DataFrame:
    """For every document: its text's hash t, the size n and name s of its set, and of one document of each set in a
    chunk the matches l, the shared shingles of the prefix, and where the first of them stands."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunk, ranges = chunk_plan(size // SHINGLE_BYTES, CHUNK_SHINGLES, RANGE_SHINGLES)
    shape = _SENT_SHAPE.format(kind=kind.simpleString())
    sent = docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(_sender(chunk, ranges, to_arrow_type(kind)), shape)
    known = sent.groupBy("dest").applyInArrow(_answers, shape)
    found = known.groupBy("chunk").applyInArrow(_prefixes, f"doc_id {kind.simpleString()}, t long, n long, s long, l int, at long, prefix array<long>")
    return materialize(found, "profiles", batch_bytes=TEXT_BATCH_BYTES)


# Candidates and their verification

_FITS = f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)"
_REACHES = f"{100 + PERCENT} * least(n_a - p_a, n_b - p_b) >= {PERCENT} * (n_a + n_b)"


def _entries(nodes: DataFrame, *more: str) -> DataFrame:
    """(token, s, n, p) of every prefix shingle, p being its position in its set."""
    found = nodes.filter("prefix is not null").select("s", "n", "at", *more, F.posexplode("prefix").alias("step", "token"))
    return found.select("token", "s", "n", (F.col("at") + F.col("step")).alias("p"), *more)


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (a, b) of sets that share min(l, l') prefix shingles and whose similarity reaches the threshold."""
    side = lambda k: nodes.filter("prefix is not null").select(F.col("s").alias(k), F.col("l").alias(f"l_{k}"), F.col("prefix").alias(f"prefix_{k}"))
    matched = F.size(F.array_intersect("prefix_a", "prefix_b")) >= F.least("l_a", "l_b")
    pairs = materialize(pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").filter(matched).select("a", "b"), "pairs")
    ends = pairs.select(F.col("a").alias("s")).unionByName(pairs.select(F.col("b").alias("s"))).distinct()
    wanted = materialize(nodes.join(ends, "s", "left_semi").select(F.col("first.doc_id").alias("key"), F.col("first.t").alias("name")), "wanted")
    size = wanted.agg(F.sum(F.coalesce(F.octet_length(F.col("key").cast("string")), F.lit(0)) + 16)).first()[0] or 0
    ids = F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted
    here = docs["doc_id"].eqNullSafe(ids["key"]) & (F.xxhash64(docs["text"]) == ids["name"])
    texts = docs.join(ids, here, "left_semi").select("text")

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = [x for x in map(shingles, part.column(0).to_pylist()) if len(x)]
        return pa.RecordBatch.from_arrays([pa.array([_set_id(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["s", "members"])

    sets = texts.mapInArrow(lambda batches: by_slices(batches, make), "s long, members binary").dropDuplicates(["s"])
    sets = materialize(sets, "sets", batch_bytes=TEXT_BATCH_BYTES)
    loaded = pairs.join(sets.select(F.col("s").alias("b"), F.col("members").alias("right")), "b").join(sets.select(F.col("s").alias("a"), F.col("members").alias("left")), "a")

    def check(batches):
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = [similar(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in zip(left, right)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    links = materialize(loaded.select("a", "b", "left", "right").mapInArrow(check, "a long, b long"), "links", batch_bytes=TEXT_BATCH_BYTES)
    drop_tables(pairs, wanted, sets)
    return links


def _stars(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of the hub of a prefix shingle and another of its sets: for each b the HUBS that it meets most often."""
    entries = _entries(nodes)
    order = F.struct(F.expr("(n - p) / n").alias("reach"), F.xxhash64("s").alias("x"), "s", "n", "p")
    hubs = entries.groupBy("token").agg(F.max(order).alias("hub"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    stars = entries.join(hubs, "token").filter("s <> hub.s").selectExpr("hub.s AS a", "s AS b", "hub.n AS n_a", "hub.p AS p_a", "n AS n_b", "p AS p_b")
    stars = stars.filter(_FITS).filter(_REACHES).groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"))
    best = Window.partitionBy("b").orderBy(F.desc("k"), "a")
    return stars.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= HUBS).select("a", "b")


def _contended(nodes: DataFrame) -> DataFrame:
    """The entries of shingles that two components or more hold, with the component that holds each most often.

    Entries that come too late in their set for any partner of their shingle are left out.
    """
    entries = _entries(nodes, "component")
    held = entries.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least"))
    tokens = held.groupBy("token").agg(F.max(F.struct("k", "component")).alias("most"), F.min("least").alias("least"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    rows = entries.join(tokens.select("token", F.col("most.component").alias("major"), "least"), "token")
    return rows.filter(f"{100 + PERCENT} * (n - p) >= {PERCENT} * (n + greatest(least, {PERCENT} * n / 100))").drop("least")


def _rest(entries: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of different components that meet in a shingle, one of them outside its largest component."""
    side = lambda rows, k: rows.select("token", "major", *[F.col(c).alias(f"{c}_{k}") for c in ("s", "component", "n", "p")]).withColumnRenamed("major", f"major_{k}")
    minor = side(entries.filter("component <> major"), "a")
    met = minor.join(side(entries, "b"), "token").filter("component_a <> component_b AND (component_b = major_b OR s_a < s_b)")
    return met.filter(_FITS).filter(_REACHES).select(F.col("s_a").alias("a"), F.col("s_b").alias("b")).distinct()


def _components(docs: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The profile of every row of ``docs``; (s, first, component) of every set, components named by sets; and written
    tables to drop once both have been read.

    ``first`` orders and names the first row of a set: by doc_id, null last, then by text hash.
    """
    docs = docs.select("doc_id", "text")
    profiles = _profiles(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "t")).alias("first")
    kept = [F.first(c, ignorenulls=True).alias(c) for c in ("n", "l", "at", "prefix")]
    nodes = materialize(profiles.filter("s is not null").groupBy("s").agg(first, *kept), "nodes")

    def labelled(rows: DataFrame, components: DataFrame) -> DataFrame:
        joined = rows.join(components.select(F.col("node").alias("component"), F.col("component").alias("smaller")), "component", "left")
        return joined.withColumn("component", F.coalesce("smaller", "component")).drop("smaller")

    links = _verified(docs, nodes, _stars(nodes))
    stars = connected_components(links)
    named = labelled(nodes.withColumn("component", F.col("s")), stars)
    entries = materialize(_contended(named), "contended")
    more = _verified(docs, nodes, _rest(entries))
    ends = [stars.select(F.col("node").alias(k), F.col("component").alias(f"c_{k}")) for k in "ab"]
    more_links = more.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    merged = connected_components(more_links)
    drop_tables(links, entries, more)
    return profiles, labelled(named, merged).select("s", "first", "component"), [profiles, nodes, stars, merged]


def similarity_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs`` (doc_id, text)."""
    profiles, names, tables = _components(docs)
    smallest = names.groupBy("component").agg(F.min("first.doc_id").alias("component_id"))
    named = names.join(smallest, "component").select("s", "component_id")
    found = profiles.select("doc_id", "n", "s").join(named, "s", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    found = materialize(found, "classes")
    drop_tables(*tables)
    return found


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that no earlier row of their component precedes.

    Rows come in the order of doc_id, null last, then of the text's hash; of rows equal in both, one stays: that of the
    smallest hash of all columns. Rows without shingles are near copies of nothing, and all stay. Columns of ``docs``
    may have any names.
    """
    profiles, names, tables = _components(docs)
    survivors = names.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("kept_id"), F.col("first.t").alias("kept_t"), F.lit(True).alias("stays"))
    rows = profiles.filter("s is not null").groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("k"))
    rows = rows.join(survivors, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("t") == F.col("kept_t")), "left")
    # only keys that go or repeat are looked up: up to BROADCAST_BYTES of them, texts need no exchange
    mark = uuid.uuid4().hex  # no column of docs has these names
    key, name, stays = f"key_{mark}", f"name_{mark}", f"stays_{mark}"
    special = rows.filter("k > 1 OR stays IS NULL").select(F.col("doc_id").alias(key), F.col("t").alias(name), F.col("stays").isNotNull().alias(stays))
    special = materialize(special, "repeats")
    drop_tables(*tables)
    size = special.agg(F.sum(F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0)) + 17)).first()[0] or 0
    look = F.broadcast if size <= BROADCAST_BYTES else lambda x: x
    same = docs["doc_id"].eqNullSafe(F.col(key)) & (F.xxhash64(docs["text"]) == F.col(name))
    out = docs.join(look(special), same, "left_anti")
    repeated = special.filter(stays)
    if repeated.limit(1).count():
        hashed = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
        whole = F.min_by(F.struct(*[docs[c] for c in docs.columns]), F.xxhash64(*[docs[c] for c in hashed])).alias("row")
        out = out.unionByName(docs.join(look(repeated), same).groupBy(key, name).agg(whole).select("row.*"))
    return out
