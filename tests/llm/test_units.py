"""Units of texts for the word-end tokenizer: what they encode to, and how many are looked up."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

pt = pytest.importorskip("public_tokenizers")

from almanac.llm import packing, units  # noqa: E402

ODD = [*"abcABxyz", "'", "'s", "'LL", " ", "  ", "\n", "\t", ".", ",", ". ", ", ", ".\n", "|", "<|", "|>", "&", "*", "-", "7", "½", "é", "É", "é", "ß", "İ", "ı", "Σ", "σ", "ǅ", "ƻ", "÷", "×", "ɏ", "漢", "ا", "\x00", "😀"]
ODD += ["<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>"]


@pytest.fixture
def pieces(spark, monkeypatch):
    """The function of ``tokenized_pieces`` over texts, called here: (doc_id, start, length, checksum) rows."""
    docs = spark.createDataFrame([(0, "")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, function, schema: function)
    run = packing.tokenized_pieces(docs, pt.path("word_bpe_49k.json"))

    def found(texts):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
        return [x for b in run(iter([batch])) for x in zip(*(b.column(k).to_pylist() for k in ("doc_id", "start", "length", "ids_crc32")))]

    return found


def _want(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(pt.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    for key, text in enumerate(texts):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for start in range(0, len(ids), 2048):
            part = ids[start : start + 2048]
            yield key, start, len(part), zlib.crc32(part.tobytes())


def test_special_strings_only_as_they_are_written(pieces):
    texts = ["a <|ENDOFTEXT|> b", "A<|endoftext|>b. <|endoftext|>", "<|StartOfText|>", "x <| y |> Z. <|Endoftext|>"]
    assert pieces(texts) == list(_want(texts))


def test_odd_texts_and_full_pieces_against_the_library(pieces):
    r = random.Random(7)
    texts = ["".join(r.choice(ODD) for _ in range(r.randrange(30))) for _ in range(3000)]
    texts += [f"a{c}b, {c}.{c}1 {c}'s ({c}*" for c in map(chr, range(0x20, 0x260))]
    texts += [None, "", " ", "the " * 2047, "the " * 2048, "the " * 4096]  # the separator ends a piece, or is one
    assert pieces(texts) == list(_want(texts))


def test_each_distinct_unit_is_looked_up_once(pieces, monkeypatch):
    asked = []
    lookup = units.UnitCache.lookup
    monkeypatch.setattr(units.UnitCache, "lookup", lambda self, texts: asked.extend(u for x in texts for u in x) or lookup(self, texts))
    texts = ["one two, three. two one (four) "] * 200
    assert pieces(texts) == list(_want(texts)) and sorted(asked) == sorted({"one", "two", ",", "three", ".", "(four)", ""})


def test_words_with_symbols_go_through_the_model_alone(monkeypatch):
    whole = []
    make = packing._tokenizer

    class Counted:
        def __init__(self, spec):
            self.made = make(spec)
            self.model = self.made.model

        def encode_batch_fast(self, texts, **options):
            whole.extend(texts)
            return self.made.encode_batch_fast(texts, **options)

    monkeypatch.setattr(packing, "_tokenizer", Counted)
    packing._word_ids.cache_clear()
    try:
        found = packing._word_ids(pt.path("word_bpe_49k.json")).encode(["end.", "été***", "(1995)", "a-b", "don't"])
    finally:
        packing._word_ids.cache_clear()
    assert whole == ["|", "don't"] and all(found)
