"""op11, op12 and op13 against plain Python on small tables with nulls, ties, repeats and very long texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from almanac.llm import decontamination, fm_index, prefix_trie, ranked_search

GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VOCABULARY = "the of and river stone light Cloud GARDEN under over é中 ü9".split()


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in GAP.split(lowered) if w]


def sentence(r, n, vocabulary=VOCABULARY):
    return "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n", "-", "\x7f"]) for _ in range(n))


def test_index_finds_every_occurrence():
    r = random.Random(1)
    for _ in range(60):
        many = r.randint(1, 6)
        seqs = [[r.randrange(many) for _ in range(r.choice([0, 1, 5, 30, 60]))] for _ in range(r.randint(1, 6))]
        seqs += [list(seqs[0])] * r.choice([0, 3])
        sizes = np.array([len(x) for x in seqs])
        columns = fm_index.build(np.array([x for q in seqs for x in q], np.int32), sizes, [b"w%d" % i for i in range(many)])
        index = fm_index.FmIndex(sizes, **columns)
        phrases = []
        for _ in range(20):
            q = r.choice(seqs)
            at = r.randrange(len(q)) if q else 0
            phrases.append(q[at : at + r.randint(1, 10)] if q and r.random() < 0.7 else [r.randrange(many) for _ in range(r.randint(1, 10))])
        table = np.zeros((20, 10), np.int64)
        for row, p in zip(table, phrases):
            row[10 - len(p) :] = np.array(p) + 1
        low, high = index.find(table, np.array([len(p) for p in phrases]))
        for p, a, b in zip(phrases, low, high):
            want = [int(s) + k for s, q in zip(index.starts, seqs) for k in range(len(q) - len(p) + 1) if q[k : k + len(p)] == p]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def contaminated(rows, items, width=10):
    windows = defaultdict(set)
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i : i + width])].add(name)
    sizes = {len(x) for x in windows}
    out = Counter()
    for key, text in rows:
        w = words(text)
        hit, names = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    names |= {str(x) for x in found if x is not None}
        out[(key, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))] += 1
    return out


@pytest.fixture(scope="module")
def passages():
    r = random.Random(2)
    many = [f"w{k}" for k in range(60)]
    items = [(k, sentence(r, n, many)) for k, n in enumerate([30, 12, 10, 9, 3, 40, 11])]
    return items + [(7, None), (8, ""), (9, "..."), (None, sentence(r, 14, many)), (3, sentence(r, 13, many)), (5, items[5][1]), (11, items[0][1])]


@pytest.fixture(scope="module")
def corpus(passages):
    r = random.Random(3)
    many = [f"w{k}" for k in range(60)]
    texts = [None, "", "!?\n", "x" * 9000, "one"]
    for _ in range(60):
        parts = [sentence(r, r.randrange(40), many)]
        for _ in range(r.choice([0, 0, 1, 1, 3])):
            w = words(r.choice(passages)[1])
            at = r.randrange(len(w) + 1)
            parts += [" ".join(w[at : at + r.choice([5, 9, 10, 11, 25])]), sentence(r, r.randrange(30), many)]
        texts.append(" ".join(parts))
    # a text of several slices, with passages on both sides of and across the cuts
    long = [f"u{k % 977}" for k in range(500_000)]
    for at in (0, 170_000, 176_700, 176_750, 349_990, 499_960):
        long[at : at + 30] = words(passages[0][1])
    raw = " ".join(long)
    for cut in (decontamination.SLICE_BYTES, 2 * decontamination.SLICE_BYTES + 5):
        at = raw.rindex(" ", 0, cut - 40)
        raw = raw[:at] + " " + " ".join(words(passages[5][1])) + raw[at:]
    texts += [raw, texts[-1], texts[-1]]
    ids = [None if k == 7 else 1_000 + k for k in range(len(texts))]
    return list(zip(ids, texts)) + [(ids[10], texts[10])]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(*x, 5, "a") for x in corpus], "doc_id long, text string, item_id long, row string").repartition(3)


@pytest.fixture(scope="module")
def benchmark(spark, passages):
    return spark.createDataFrame([(*x, "t") for x in passages], "item_id long, text string, items string").repartition(2)


def test_contamination(docs, benchmark, corpus, passages):
    got = Counter(tuple(x) for x in decontamination.contamination(docs, benchmark).collect())
    assert got == contaminated(corpus, passages)


def test_removal_spans_are_disjoint_and_blocks_of_items_agree(docs, benchmark, monkeypatch):
    whole = {(x.doc_id, x.n_words, tuple(map(tuple, x.spans)), tuple(x["items"])) for x in decontamination.removal_spans(docs, benchmark).collect()}
    assert all(a[1] < b[0] for _, _, spans, _ in whole for a, b in zip(spans, spans[1:]))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 100)
    parts = {(x.doc_id, x.n_words, tuple(map(tuple, x.spans)), tuple(x["items"])) for x in decontamination.removal_spans(docs, benchmark).collect()}
    assert parts == whole


def test_contamination_of_small_shards(docs, benchmark, corpus, passages, monkeypatch):
    monkeypatch.setattr(decontamination, "LOCATE_ROWS", 3)
    index = decontamination.build_index(docs, shard_words=50)
    found = decontamination.search(index, benchmark)
    want = sum((Counter({k[0]: n * k[1]}) for k, n in contaminated(corpus, passages).items()), Counter())
    got = Counter()
    for x in found.collect():
        got[x.doc_id] += x.n_words
    assert +got == +want


def test_empty_tables(spark, docs, benchmark):
    none, no_items = docs.limit(0), benchmark.limit(0)
    assert decontamination.contamination(none, benchmark).count() == 0
    assert decontamination.contamination(docs, no_items).filter("contaminated OR n_items > 0").count() == 0
    assert ranked_search.rank_documents(none, benchmark).count() == 0
    assert ranked_search.rank_documents(docs, no_items).count() == 0
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.conversation_trie(empty).count() == 0


def ranked(rows, items, top=10):
    lists = [Counter(words(text)) for _, text in rows]
    n, total = sum(bool(x) for x in lists), sum(x.total() for x in lists)
    df = Counter(t for x in lists for t in x)
    out = Counter()
    for name, text in items:
        query, found = Counter(words(text)), []
        for (key, _), held in zip(rows, lists):
            length, score = held.total(), 0
            for t, times in query.items():
                if held[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += times * w * ((1_000_000_000 * held[t]) // (1000 * held[t] + 8 * (25 + (75 * length * n) // total)))
            if score > 0:
                found.append((-score, key is None, key or 0))
        for rank, (score, none, key) in enumerate(sorted(found)[:top], 1):
            out[(name, rank, None if none else key, -score)] += 1
    return out


def test_ranks(docs, benchmark, corpus, passages):
    assert Counter(tuple(x) for x in ranked_search.rank_documents(docs, benchmark).collect()) == ranked(corpus, passages)


@pytest.mark.parametrize("chunk", [3, 1000])
def test_ranks_of_many_chunks_heads_and_blocks(spark, monkeypatch, chunk):
    r = random.Random(4)
    skewed = [f"t{min(int(r.expovariate(0.05)), 90)}" for _ in range(4000)]
    texts = [" ".join(r.choice(skewed) for _ in range(r.randrange(1, 60))) for _ in range(300)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, texts[0]) for k in range(40)]  # forty copies tie
    items = [(k, " ".join(r.choice(skewed) for _ in range(n))) for k, n in enumerate([1, 2, 5, 20, 60])] + [(9, texts[0])]
    monkeypatch.setattr(ranked_search, "CHUNK_DOCS", chunk)
    monkeypatch.setattr(ranked_search, "HEADS", 12)
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ranked_search.rank_documents(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(tuple(x) for x in got.collect()) == ranked(rows, items)


def nodes_of(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids, leaves, saved = Counter(x[:-1] for x in members if x), Counter(), Counter()
    for node, convs in members.items():
        cost = (len(convs) - 1) * len([w for w in re.split(rb"[\x20\x09-\x0D]+", node[-1][1]) if w]) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += cost
            leaves[node[:d]] += not kids[node]
    out = Counter()
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(whole[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out[(min(convs), len(node), parent, len(convs), kids[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_trie(spark, seed):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(200), 90):
        script = [("user", "hello  there"), ("assistant", "a\tb c"), ("user", "bye"), ("assistant", None), (None, "x")]
        for turn in range(r.choice([1, 2, 3, 5, 9])):
            role, text = script[turn % 5] if r.random() < 0.85 else (r.choice(["user", ""]), sentence(r, r.randrange(4)))
            rows.append((c, r.choice([None, 0]) if turn == 0 else turn, role, text))
    rows += rows[:5] + [(None, 0, "user", "lost"), (rows[0][0], None, None, None)]
    rows += [(c, t, "user", f"same {t}") for c in range(400, 520) for t in range(30)]  # copies, through many blocks of ids
    long = [(c, t, "user", f"line {t if t != 390 else c}") for c in (601, 602, 603) for t in range(400)]
    frame = spark.createDataFrame([(*x, 1) for x in rows + long], "conv_id long, turn long, role string, text string, depth long").repartition(5)
    got = Counter(tuple(x) for x in prefix_trie.conversation_trie(frame).collect())
    assert got == nodes_of(rows + long)


def test_ids_of_copies_are_hashed_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 3)
    rows = [(c, 0, "user", "all alike") for c in range(-40, 300)] + [(500, 0, "user", "other")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = prefix_trie.hashed_turns(frame).withColumnRenamed("ordinal", "depth")
    root, = prefix_trie.trie(turns, turns.groupBy("conv_id").agg({"depth": "max"}).toDF("conv_id", "length")).filter("depth = 1 AND n_convs > 1").collect()
    assert root["n_convs"] == 340
    assert root["ends_sha256"] == hashlib.sha256(",".join(map(str, range(-40, 300))).encode()).hexdigest()
