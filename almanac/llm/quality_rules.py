"""Quality rules with risk-controlled thresholds.

Fixed base rules reject first. Beyond them, each rule (a measure and cutoffs from lenient to strict) is calibrated for
each stratum (language) on labelled documents: a cutoff is certified when the exact binomial test refutes, at the
corrected level, that it rejects ALPHA / rules of the stratum's good documents or more. Cutoffs are tested in order
and testing stops at the first that fails (fixed sequence); levels are divided by the number of strata and rules
(Bonferroni). With probability 1 - DELTA no stratum loses more than ALPHA of its good documents to all rules together.
Among certified cutoffs the one that best separates labelled bad from good documents is used; where none is
certified, or none rejects bad documents, the rule does not apply.

Edge cases: a null or empty text has no words and fails the base rules; a null language is a stratum of its own; a
document labelled more than once counts with its largest label; strata without enough labels get no cutoffs; repeated
rows repeat; an empty table gives an empty result; extra columns are ignored by ``apply_rules`` and kept by ``keep_good``.
"""

from __future__ import annotations

import math
import operator
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import TEXT_BATCH_BYTES, by_slices, drop_tables, materialize

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Share of a stratum's good documents that all rules together may reject, and the chance that a bound fails.
ALPHA, DELTA = 0.05, 0.05

#: measure -> cutoffs, lenient to strict; a document whose measure exceeds the cutoff is rejected.
RULES = {
    "symbols_per_word": [1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15],
    "repeat_share": [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15],
    "dup_line_share": [0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25],
    "adjacent_share": [0.5, 0.4, 0.3, 0.2, 0.1, 0.05],
    "upper_share": [0.9, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2],
}
_MEASURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "adjacent_share": ("n_adjacent", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_adjacent", "n_upper"]

_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))


def text_counts(text: str | None) -> tuple[int, ...]:
    """The COUNTS of one text; words are runs without ASCII white space, lines end at line feeds."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0,) * len(COUNTS)
    space = len(raw) - sum(map(len, words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        n,
        len(text) - space,
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(map(operator.eq, words, words[1:])),
        len(raw) - len(raw.translate(None, _UPPER)),
    )


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """How many of ``words`` lie in some window of ``width`` words that occurs twice or more."""
    windows = list(zip(*(words[i:] for i in range(width))))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    covered, until = 0, 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            covered += i + width - max(i, until)
            until = i + width
    return covered


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def count_documents(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the COUNTS of every row of ``docs`` (doc_id, text and, if it has one, lang)."""
    stratum = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        columns = zip(*map(text_counts, part.column(2).to_pylist()))
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x, pa.int64()) for x in columns)], names=["doc_id", "stratum", *COUNTS])

    schema = f"doc_id {kind}, stratum string, " + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select("doc_id", stratum.alias("stratum"), "text").mapInArrow(lambda batches: by_slices(batches, count), schema)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), exactly summed in logarithms."""
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def choose_cutoff(cutoffs: list[float], good: int, rejected_good: list[int], rejected_bad: list[int], alpha: float, level: float) -> float | None:
    """The certified cutoff with the largest lead of bad over good rejections; the more lenient of equal ones."""
    best, chosen = 0, None
    for cutoff, k, bad in zip(cutoffs, rejected_good, rejected_bad):
        if k >= alpha * good or binomial_tail(k, good, alpha) > level:
            break
        if bad - 10 * k > best:
            best, chosen = bad - 10 * k, cutoff
    return chosen


def calibrate(counted: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, dict[str, float]]:
    """stratum -> measure -> cutoff. Only one row of sums for each stratum with enough labels reaches the driver."""
    marks = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    share = alpha / len(RULES)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    known = counted.filter(~failed).join(marks, "doc_id")
    sums = [F.count_if("good").alias("n_good")]
    for rule, cutoffs in RULES.items():
        over, under = _MEASURES[rule]
        for i, cutoff in enumerate(cutoffs):
            hit = F.col(over) > F.col(under) * F.lit(cutoff)
            sums += [F.count_if(hit & F.col("good")).alias(f"{rule}_good_{i}"), F.count_if(hit & ~F.col("good")).alias(f"{rule}_bad_{i}")]
    # below so many good documents not even a cutoff that rejects none of them can be certified
    least = math.log(delta / len(RULES)) / math.log1p(-share)
    rows = known.groupBy("stratum").agg(*sums).filter(F.col("n_good") >= least).collect()
    level = delta / max(1, len(rows) * len(RULES))
    found: dict[str, dict[str, float]] = {}
    for row in rows:
        for rule, cutoffs in RULES.items():
            hits = lambda kind: [row[f"{rule}_{kind}_{i}"] for i in range(len(cutoffs))]  # noqa: B023, E731
            cutoff = choose_cutoff(cutoffs, row["n_good"], hits("good"), hits("bad"), share, level)
            if cutoff is not None:
                found.setdefault(row["stratum"], {})[rule] = cutoff
    return found


def _rejected(cutoffs: dict[str, dict[str, float]]):
    """A column: whether a calibrated rule of the row's stratum rejects it."""
    out = F.lit(False)
    for stratum, rules in sorted(cutoffs.items()):
        hit = F.lit(False)
        for rule, cutoff in rules.items():
            over, under = _MEASURES[rule]
            hit = hit | (F.col(over) > F.col(under) * F.lit(cutoff))
        out = out | ((F.col("stratum") == stratum) & hit)
    return out


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept for every row."""
    counted = materialize(count_documents(docs), "counts", batch_bytes=TEXT_BATCH_BYTES)
    cutoffs = calibrate(counted, labels)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.select("doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & ~_rejected(cutoffs)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that neither base nor calibrated rules reject."""
    counted = materialize(count_documents(docs), "counts", batch_bytes=TEXT_BATCH_BYTES)
    cutoffs = calibrate(counted, labels)
    drop_tables(counted)
    text_at = docs.columns.index("text")
    lang_at = docs.columns.index("lang") if "lang" in docs.columns else None

    def good(text, stratum) -> bool:
        counts = dict(zip(COUNTS, text_counts(text)))
        if base_fails(counts["n_words"], counts["n_repeat_words"]):
            return False
        rules = cutoffs.get(stratum or "", {})
        return not any(counts[_MEASURES[r][0]] > counts[_MEASURES[r][1]] * c for r, c in rules.items())

    def keep(part: pa.RecordBatch) -> pa.RecordBatch:
        strata = pc.cast(part.column(lang_at), pa.string()).to_pylist() if lang_at is not None else [""] * part.num_rows
        return part.filter(pa.array(list(map(good, part.column(text_at).to_pylist(), strata)), pa.bool_()))

    return docs.mapInArrow(lambda batches: by_slices(batches, keep), docs.schema)
