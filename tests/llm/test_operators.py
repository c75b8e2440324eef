"""Small cases of each operator against brute force, with nulls, empty and repeated rows and clashing columns."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

pt = pytest.importorskip("public_tokenizers")

from almanac.llm import byte_bpe, jpeg, license_scan, lm_scoring, ngram_join, packing, quality_classifier, quality_rules, sharding, token_counts  # noqa: E402

WORDS = "the of and river stone light cloud garden under over small quick never always window paper".split()


def _rows():
    r = random.Random(5)
    base = [r.choice(WORDS) for _ in range(120)]
    near = base[:60] + ["changed"] + base[61:]
    texts = [None, "", " \n ", "one two", " ".join(base), " ".join(base), " ".join(near), "Released under the MIT License.\nline\nline", "x" * 5000, "é中🙂 <|endoftext|> a  b\n"]
    return [(i, t, "en", float(i), "clash") for i, t in enumerate(texts)] + [(4, " ".join(base), "en", 0.0, "again")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), "doc_id long, text string, lang string, score double, shard string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int")


def _text(t):
    return t or ""


def test_jpeg_round_trip_fast_and_bitwise():
    for n in (64, 640, 6400):
        payload = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()
        media = jpeg.encode_bytes(payload)
        image = jpeg.Decoder(media)
        assert image.payload() == payload
        tables = [jpeg.even_table(False), jpeg.even_table(True)]
        try:
            for t in tables:
                t.even = False  # bit by bit
            slow = jpeg.Decoder(media)
        finally:
            for t in tables:
                t.even = True
        assert slow.payload() == payload and (slow.rgb() == image.rgb()).all()
        assert image.rgb().shape == (image.height, image.width, 3)


def test_inverse_transform_of_a_constant_block():
    assert np.abs(jpeg._basis()[0] / (1 << jpeg._SHIFT) - 0.125).max() < 1e-3


def test_media_digests(docs):
    for r in jpeg.media_digests(docs).collect():
        assert r.payload_bytes % 64 == 0 and r.payload_bytes >= max(64, r.n_bytes)


def test_bpe_equals_library(docs):
    tiktoken = pytest.importorskip("tiktoken")
    path = pt.path("byte_bpe_50k.tiktoken")
    codec = byte_bpe.Codec(path, pt.PATTERN)
    own = tiktoken.Encoding("own", pat_str=pt.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    r = random.Random(1)
    texts = ["".join(r.choice("ab  \n\t'sé中🙂19-_.,") for _ in range(r.randint(0, 80))) for _ in range(300)] + ["z" * 700]
    for text, ids in zip(texts, codec.encode_batch(texts)):
        assert ids == np.array(own.encode_ordinary(text), "<u4").tobytes() and codec.decode(ids) == text.encode()
    assert byte_bpe.round_trip(docs, path, pt.PATTERN).count() == len(_rows())


def test_token_counts_equal_library(docs):
    from tokenizers import Tokenizer

    path = pt.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    want = Counter((i, len(own.encode(_text(t), add_special_tokens=False).ids)) for i, t, *_ in _rows())
    assert Counter((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(docs, path).collect()) == want


def test_packing_is_gapless_and_tight(docs):
    rows = packing.pack_documents(docs, pt.path("word_bpe_49k.json")).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    r = random.Random(3)
    lengths = [r.randint(1, 2048) for _ in range(800)]
    packed = packing.pack_lengths(lengths)
    assert sorted(i for b in packed for i in b) == list(range(800)) and len(packed) <= 1.05 * sum(lengths) / 2048 + 1


def test_local_search_empties_a_bin():
    lengths = [6, 3, 5, 4, 2]
    assert len(packing.local_search([[0, 1], [2, 3], [4]], lengths, 10)) == 2


def test_license_scan(docs):
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert got[7].base_labels == "mit" and got[7].n_base == 1 and got[7].first_word == 3 and got[7].score == 1.0
    assert got[0].n_words == 0 and got[0].labels == "" and got[0].first_word is None and got[0].score == 0.0
    assert got[8].n_words == 1


def test_license_scan_gives_no_label_of_another_license(spark):
    by, terms = "This work is licensed under ", "This program is free software: you can redistribute it and/or modify it under the terms of the "
    want = {
        by + "the GNU General Public License, version 3.": "gpl,gpl-3.0",
        by + "the GNU General Public License, version 2.": "gpl",
        by + "the GNU Affero General Public License, version 3.": "agpl-3.0",
        "Licensed under the GNU Lesser General Public License, version 3.": "lgpl",
        terms + "GNU General Public License": "gpl",
        terms + "GNU Affero General Public License": "",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
        "Licensed under CC BY-SA 4.0.": "cc-by,cc-by-sa",
        "Licensed under CC BY 4.0.": "cc-by",
        by + "a Creative Commons Attribution 4.0 International License": "cc-by",
        by + "a Creative Commons Attribution-ShareAlike 4.0 International License": "",
        "Licensed under the Apache License, Version 2.0.": "apache,apache-2.0",
        "Licensed under the Educational Community License, Version 2.0.": "",
        "Released under the MIT License.": "mit",
        "Released under the ISC License.": "",
        by + "the GNU General Public License, version 3. " + "x " * 15 + "Licensed under the GNU Lesser General Public License.": "gpl,gpl-3.0,lgpl",
    }
    rows = [(1000 * k + pad, "pad " * pad + text) for k, text in enumerate(want) for pad in (0, 1, 20, 23, 24, 40, 47)]
    got = {r.doc_id: r.labels for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (text, labels) in enumerate(want.items()):
        assert {got[1000 * k + pad] for pad in (0, 1, 20, 23, 24, 40, 47)} == {labels}, text


def test_sharding_moves_rows_only_to_the_new_shard(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    rows = sharding.shard_documents(docs, 24).collect()
    later = {r.doc_id: r.shard for r in sharding.shard_documents(docs, 25).collect()}
    assert all(r.grown_shard == later[r.doc_id] and r.grown_shard in (r.shard, 24) for r in rows)
    for s in range(24):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.text_crc32 == zlib.crc32(str(r.doc_id).encode()) for r in rows)


def test_similarity_classes(docs):
    got = {r.doc_id: r for r in ngram_join.similarity_classes(docs).collect()}
    words = {i: _text(t).lower().encode().split() for i, t, *_ in _rows()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    for i, s in sets.items():
        assert got[i].n_shingles == len(s)
        linked = [j for j, o in sets.items() if s and o and 100 * len(s & o) >= 75 * len(s | o)]
        assert got[i].component_id == min([i, *linked])
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in got.values()})


def test_keep_first_keeps_texts_of_null_and_repeated_ids(spark):
    r = random.Random(8)
    long = [" ".join(r.choice(WORDS) for _ in range(60)) for _ in range(6)]
    rows = [(None, long[0], "a"), (None, long[1], "b"), (None, long[1], "c"), (None, long[2] + " new", "d"), (None, None, "e"), (None, "", "f"), (None, "", "g")]
    rows += [(7, long[2], "h"), (7, long[3], "i"), (7, long[3], "i"), (9, long[4], "j"), (8, long[4], "k"), (8, long[5], "l"), (5, "", "m"), (5, "", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t string")
    kept = ngram_join.keep_first(docs)
    got = Counter((x.doc_id, x.text) for x in kept.collect())
    want = [(None, long[0]), (None, long[1]), (None, None), (None, ""), (None, ""), (7, long[2]), (7, long[3]), (8, long[4]), (8, long[5]), (5, ""), (5, "")]
    assert kept.columns == docs.columns and got == Counter(want)
    many = [(None, " ".join(f"w{i}x{k}" for k in range(9))) for i in range(40)]
    assert ngram_join.keep_first(spark.createDataFrame(many, "doc_id long, text string")).count() == 40


def _classes(rows):
    """n_shingles and smallest reachable id of every row (key, text) by comparing all pairs."""
    words = [_text(t).lower().encode().split() for _, t in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    ids = {g: [k for (k, _), h in zip(rows, group) if h == g and k is not None] for g in set(group)}
    return [(k, len(s), min(ids[g]) if s and ids[g] else k) for (k, _), s, g in zip(rows, sets, group)]


def test_similarity_classes_of_families_near_the_threshold(spark):
    """Edited copies of an origin, copies of copies in a chain, shared passages, and null ids beside ids above 2 ** 53."""
    r = random.Random(11)
    word = lambda: f"{r.choice(WORDS)}{r.randrange(10**6)}"
    origin, passage = [word() for _ in range(90)], [word() for _ in range(60)]
    texts = []
    for edits in [*range(9), *range(9), 3, 4, 4, 5, 5, 5]:
        copy = list(origin)
        for at in r.sample(range(90), edits):
            copy[at] = word()
        texts.append(copy)
    for _ in range(14):  # each a little further from the one before
        copy = list(texts[-1])
        copy[r.randrange(len(copy))] = word()
        texts.append(copy[r.randrange(2) :])
    for extra in (8, 10, 12, 14, 16, 18, 20, 22, 30):
        texts.append(passage + [word() for _ in range(extra)])
    small = [f"slot{k}" for k in range(3)]
    for _ in range(30):  # slots of a form, filled from few words
        copy = list(passage[:40])
        for at in (5, 15, 25, 35):
            copy[at] = r.choice(small)
        texts.append(copy)
    top = 1 << 60
    rows = [(None if k % 7 == 3 else top + 2 * k + 1, " ".join(x)) for k, x in enumerate(texts)] + [(None, None), (None, ""), (top, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.similarity_classes(docs).collect())
    assert got == Counter(_classes(rows))


def test_keep_first_with_clashing_names_and_large_ids(spark):
    top, same = 1 << 60, " ".join(WORDS)
    rows = [(None, same, 1, "x"), (top + 1, same, 2, "y"), (top + 3, "a b c", 3, "z"), (top + 3, "a b c", 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id int, stays string")
    got = sorted((x.doc_id, x.text, x.kept_id, x.stays) for x in ngram_join.keep_first(docs).collect())
    assert got == [(top + 1, same, 2, "y"), (top + 3, "a b c", 3, "z")]


def test_prefixes_hold_the_matches_of_similar_pairs():
    """A pair that reaches the threshold shares min(l, l') prefix shingles, by any frequencies."""
    r = np.random.default_rng(2)
    for _ in range(300):
        a = np.unique(r.integers(0, 1 << 62, r.integers(1, 200)))
        b = np.unique(np.concatenate([a[: int(len(a) * r.uniform(0.7, 1))], r.integers(0, 1 << 62, r.integers(0, 60))]))
        if len(b) and ngram_join.similar(a, b):
            freq = {int(x): int(f) for x, f in zip(np.union1d(a, b), r.zipf(1.5, len(np.union1d(a, b))).clip(2, 10**6))}
            picked, least = [], []
            for x in (a, b):
                order = sorted(map(int, x), key=lambda k: (freq[k], k))
                many, matches = ngram_join.prefix(np.array([freq[k] for k in order]), len(order))
                picked.append(set(order[:many]))
                least.append(matches)
            assert len(picked[0] & picked[1]) >= min(least)


def test_lm_base_score(docs):
    rows = lm_scoring.score_documents(docs).collect()
    tokens = [(i, _text(t).lower().encode().split() + [None]) for i, t, *_ in _rows()]
    c = Counter(w for i, ws in tokens if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((i, len(ws), round(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in tokens)
    assert sorted((r.doc_id, r.n_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.train_tokens == n and r.score < 0 for r in rows)


def test_quality_rules(docs, labels):
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs, labels).collect()}
    assert got[0].base_failed and not got[0].kept and got[7].n_dup_lines == 1
    assert quality_rules.repeated_words(b"a b c d a b c".split()) == 6
    assert abs(quality_rules.binomial_tail(2, 10, 0.3) - 0.3827827864) < 1e-9
    assert quality_rules.keep_good(docs, labels).columns == docs.columns


def test_quality_classifier(docs, labels):
    rows = quality_classifier.score_documents(docs, labels).collect()
    assert len(rows) == len(_rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert quality_classifier.keep_good(docs, labels, 0.0).count() == len(_rows())
    assert quality_classifier.score_documents(docs, labels.filter("false")).filter("score <> 0.5").count() == 0


def test_labels_without_rows_take_no_place(spark):
    docs = spark.createDataFrame([(i, f"{WORDS[i % 16]} text {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.range(20_000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    assert len(quality_classifier.fit_model(docs, labels, 8).labels) == 8
    assert quality_classifier.keep_good(docs, labels.filter("doc_id >= 40"), 0.7).count() == 40
    assert quality_classifier.keep_good(docs, labels.filter("false"), 0.7).count() == 40


def test_empty_tables(docs, labels):
    none = docs.filter("doc_id < 0")
    for made in (
        jpeg.media_digests(none),
        byte_bpe.round_trip(none, pt.path("byte_bpe_50k.tiktoken"), pt.PATTERN),
        license_scan.scan_licenses(none),
        packing.pack_documents(none, pt.path("word_bpe_49k.json")),
        token_counts.count_tokens(none, pt.path("byte_bpe_50k.json")),
        sharding.shard_documents(none),
        quality_rules.apply_rules(none, labels),
        quality_classifier.score_documents(none, labels),
        lm_scoring.score_documents(none),
        ngram_join.similarity_classes(none),
    ):
        assert made.count() == 0
