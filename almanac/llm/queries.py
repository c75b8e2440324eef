"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from almanac.llm import byte_bpe, decontamination, jpeg, license_scan, lm_scoring, ngram_join, packing, prefix_trie, quality_classifier, quality_rules, ranked_search, sharding, token_counts
from almanac.llm.common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_digests(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"), _pattern())


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op11_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_tput_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [f for name, f in globals().items() if name.startswith("op") and callable(f)]
    return {f.__name__: f for f in found}


#: Components by plain comparison of all pairs that share a shingle.
_OP4 = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::UBIGINT[] WHEN len(ws) < 5 THEN [hash(array_to_string(ws, ' '))] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: hash(array_to_string(ws[i:i + 4], ' ')))) END AS sh FROM w),
    e AS (SELECT doc_id, unnest(sh) AS t FROM s),
    i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    l AS (SELECT i.a, i.b FROM i JOIN s x ON x.doc_id = i.a JOIN s y ON y.doc_id = i.b WHERE 100 * n >= 75 * (len(x.sh) + len(y.sh) - n)),
    d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id AS node, doc_id AS other FROM s UNION SELECT r.node, d.b FROM r JOIN d ON d.a = r.other)
    SELECT s.doc_id, len(s.sh) AS n_shingles, c.component_id FROM s JOIN (SELECT node, min(other) AS component_id FROM r GROUP BY node) c ON c.node = s.doc_id"""




def _op7() -> str:
    """The counts, the exact bounds and the verdicts of the quality rules."""
    from almanac.llm.quality_rules import _MEASURES, ALPHA, DELTA, RULES

    space = r"[\x20\x09-\x0D]"
    cutoffs = ", ".join(f"('{rule}', {i}, {c}::DOUBLE)" for rule, cs in RULES.items() for i, c in enumerate(cs))
    share = " ".join(f"WHEN '{rule}' THEN {over} > {under} * r.cutoff" for rule, (over, under) in _MEASURES.items())
    n, alpha = len(RULES), ALPHA / len(RULES)
    return rf"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
    w AS MATERIALIZED (SELECT *, list_filter(string_split_regex(text, '{space}+'), lambda x: x <> '') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
    g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: hash(ws[i], ws[i + 1], ws[i + 2]))) AS x FROM w),
    h AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS k FROM g) WHERE k > 1),
    q AS (SELECT doc_id, count(DISTINCT i) AS n FROM h GROUP BY doc_id),
    c AS MATERIALIZED (SELECT w.doc_id, w.stratum, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
      len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(q.n, 0) AS n_repeat_words, len(ls) AS n_lines, len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_adjacent, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
      FROM w LEFT JOIN q ON q.doc_id = w.doc_id),
    f AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
    m AS (SELECT doc_id, max(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
    r AS (SELECT * FROM (VALUES {cutoffs}) t(rule, i, cutoff)),
    k AS (SELECT f.stratum, r.rule, r.i, r.cutoff, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE good AND CASE r.rule {share} END) AS hits, count(*) FILTER (WHERE NOT good AND CASE r.rule {share} END) AS bad
      FROM f JOIN m ON m.doc_id = f.doc_id CROSS JOIN r WHERE NOT base_failed GROUP BY f.stratum, r.rule, r.i, r.cutoff),
    e AS (SELECT * FROM k WHERE n >= ln({DELTA / n}::DOUBLE) / ln(1 - {alpha}::DOUBLE)),
    b AS (SELECT e.*, hits < {alpha}::DOUBLE * n AND (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({alpha}::DOUBLE) + (n - j) * ln(1 - {alpha}::DOUBLE))) FROM (SELECT unnest(range(0, hits + 1)) AS j)) <= {DELTA}::DOUBLE / ((SELECT count(DISTINCT stratum) FROM e) * {n}) AS good FROM e),
    o AS (SELECT *, bool_and(good) OVER (PARTITION BY stratum, rule ORDER BY i) AS certified FROM b),
    u AS (SELECT stratum, rule, cutoff FROM (SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY bad - 10 * hits DESC, i) AS first FROM o WHERE certified AND bad - 10 * hits > 0) WHERE first = 1),
    x AS (SELECT DISTINCT f.doc_id FROM f JOIN u r ON r.stratum = f.stratum WHERE CASE r.rule {share} END)
    SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND x.doc_id IS NULL AS kept FROM f LEFT JOIN x ON x.doc_id = f.doc_id"""


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Windows of documents met with windows of items, by equality of their words.
_OP11 = rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
    b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS ws FROM benchmark),
    i AS MATERIALIZED (SELECT DISTINCT item, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 10 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 8), lambda k: array_to_string(ws[k:k + 9], ' ')) END) AS x FROM b),
    n AS (SELECT DISTINCT len(x) - len(replace(x, ' ', '')) + 1 AS width FROM i),
    w AS (SELECT r, n.width, unnest(range(1, len(ws) - n.width + 2)) AS k, unnest(list_transform(range(1, len(ws) - n.width + 2), lambda k: array_to_string(ws[k:k + n.width - 1], ' '))) AS x FROM d, n),
    m AS MATERIALIZED (SELECT w.r, w.k, w.width, i.item FROM w JOIN i ON i.x = w.x),
    h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + width)) AS p FROM (SELECT DISTINCT r, k, width FROM m)) GROUP BY r),
    o AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM m GROUP BY r)
    SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN o ON o.r = d.r"""


#: The scores of all documents that hold a term of an item.
_OP12 = rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
    c AS (SELECT count(*) FILTER (WHERE len(ws) > 0) AS n, sum(len(ws))::BIGINT AS l FROM d),
    p AS MATERIALIZED (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ws) AS t FROM d) GROUP BY r, t),
    w AS (SELECT t, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY t, n),
    b AS (SELECT i, item_id, t, count(*) AS q FROM (SELECT row_number() OVER () AS i, item_id, unnest({_WORDS}) AS t FROM benchmark) GROUP BY i, item_id, t),
    s AS (SELECT b.i, b.item_id, p.r, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len(ws) * n) // l))))::BIGINT AS score FROM b JOIN p ON p.t = b.t JOIN w ON w.t = b.t JOIN d ON d.r = p.r, c GROUP BY b.i, b.item_id, p.r)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN d ON d.r = s.r WHERE score > 0) WHERE rank <= 10"""

#: Nodes by whole prefixes; CRC-32 by its table of 256 entries.
_OP13 = r"""WITH RECURSIVE k(i, v, step) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1 FROM k WHERE step < 8),
    tab AS (SELECT list(v ORDER BY i) AS vs FROM k WHERE step = 8),
    t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS o, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    o AS MATERIALIZED (SELECT conv_id, list(sha256(length(role) || ':' || role || text) ORDER BY o) AS ks, list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY o) AS ns FROM t GROUP BY conv_id),
    h AS (SELECT o.*, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b: xor(a >> 8, vs[xor(a & 255, b) + 1]), 4294967295), 4294967295) % 4 AS h FROM o, tab),
    r AS MATERIALIZED (SELECT h.conv_id, list_concat(coalesce(b.ks[1:h.h], []), h.ks[h.h + 1:]) AS ks, list_concat(coalesce(b.ns[1:h.h], []), h.ns[h.h + 1:]) AS ns FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20),
    p AS (SELECT conv_id, len(ks) AS long, unnest(range(0, len(ks) + 1)) AS depth, unnest(list_transform(range(0, len(ks) + 1), lambda d: array_to_string(ks[1:d], ''))) AS path, unnest(list_transform(range(0, len(ks) + 1), lambda d: CASE WHEN d > 0 THEN ns[d] ELSE 0 END)) AS words FROM r),
    n AS MATERIALIZED (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE long = depth), '') AS ends FROM p GROUP BY depth, path),
    c AS (SELECT n.depth, n.path, count(x.depth) AS n_children FROM n LEFT JOIN n x ON x.depth = n.depth + 1 AND left(x.path, 64 * n.depth) = n.path GROUP BY n.depth, n.path),
    a AS (SELECT depth AS d, path AS q, unnest(range(0, depth + 1)) AS depth FROM n),
    s AS (SELECT a.depth, left(a.q, 64 * a.depth) AS path, count(*) FILTER (WHERE c.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.words) AS saved FROM a JOIN n m ON m.depth = a.d AND m.path = a.q JOIN c ON c.depth = a.d AND c.path = a.q GROUP BY a.depth, left(a.q, 64 * a.depth))
    SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, c.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
    FROM n JOIN c ON c.depth = n.depth AND c.path = n.path JOIN s ON s.depth = n.depth AND s.path = n.path LEFT JOIN n u ON u.depth = n.depth - 1 AND u.path = left(n.path, 64 * (n.depth - 1))"""


def oracle_sql() -> dict[str, str]:
    """The others need checksums, tokenizers, images or trained models; tests compare them with plain Python."""
    return {"op4_ngram_jaccard_join": _OP4, "op7_quality_rules": _op7(), "op11_fm_decontamination": _OP11, "op12_tput_search": _OP12, "op13_prefix_trie": _OP13}
