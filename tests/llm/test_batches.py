"""What the workers hold of texts at once: Arrow batches of bounded bytes, slices of bounded rows."""

import numpy as np
import pyarrow as pa
import pytest

pt = pytest.importorskip("public_tokenizers")

from almanac.llm import common, packing, quality_classifier, quality_rules  # noqa: E402


def test_batches_of_a_written_table_are_bounded(spark):
    def largest(batches):
        yield pa.RecordBatch.from_arrays([pa.array([max(b.nbytes for b in batches)])], names=["bytes"])

    texts = spark.range(4000).selectExpr("id", "repeat('word ', 200) AS text").coalesce(1)
    before = spark.conf.get(common._BATCH_BYTES)
    found = common.materialize(texts.mapInArrow(largest, "bytes long"), "largest", batch_bytes=1 << 16)
    assert found.first().bytes < 1 << 17 and found.count() == 1
    assert spark.conf.get(common._BATCH_BYTES) == before


def test_slices_hold_every_row_once():
    batches = [pa.RecordBatch.from_pydict({"x": list(range(lo, hi))}) for lo, hi in ((0, 600), (600, 600), (600, 601))]
    got = list(common.by_slices(iter(batches), lambda part: part))
    assert [b.num_rows for b in got] == [256, 256, 88, 1]
    assert [x for b in got for x in b.column(0).to_pylist()] == list(range(601))


@pytest.fixture
def kept(spark, monkeypatch):
    """The function that a stage runs in its workers, called here on one batch of 1,000 rows."""
    docs = spark.createDataFrame([(0, "", "en")], "doc_id long, text string, lang string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, function, schema: function)
    texts = [" ".join(f"w{i}n{k}" for k in range(i % 100)) for i in range(1000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": texts, "lang": ["en"] * 1000})
    return lambda keep_good: list(keep_good(docs)(iter([batch])))


def test_quality_rules_send_back_few_texts_at_once(kept, monkeypatch):
    for name, found in (("materialize", None), ("calibrate", {}), ("drop_tables", None)):
        monkeypatch.setattr(quality_rules, name, lambda *a, found=found, **b: found)
    got = kept(lambda docs: quality_rules.keep_good(docs, None))
    assert max(b.num_rows for b in got) <= common.SLICE_ROWS
    assert [x for b in got for x in b.column(0).to_pylist()] == [i for i in range(1000) if i % 100 >= 50]


def test_quality_classifier_sends_back_few_texts_at_once(kept, monkeypatch):
    model = quality_classifier.Model.fit(quality_classifier.text_counts(["a b c", "d e f"]), np.array([1.0, 1.0]))
    monkeypatch.setattr(quality_classifier, "fit_model", lambda docs, labels: model)
    got = kept(lambda docs: quality_classifier.keep_good(docs, None, 0.5))
    assert max(b.num_rows for b in got) <= common.SLICE_ROWS
    assert [x for b in got for x in b.column(0).to_pylist()] == list(range(1000))


def test_encoding_keeps_nothing_of_the_vocabulary():
    encode = packing._word_ids(pt.path("word_bpe_49k.json")).encode
    assert not any(isinstance(x.cell_contents, dict) for x in encode.__closure__)
