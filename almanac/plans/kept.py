"""Queries through structures that are kept between them: a search index, clustered vectors, recomputed results."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from almanac.functions.stemming import STOP_WORDS
from almanac.operators import changes, index, listing, nearest, search
from almanac.operators.lineage import shared_folder
from almanac.plans import more, third
from almanac.plans.model import NOW
from almanac.plans.queries import _GRAMS, _SQL, _query, _t

#: What this session has built, by kind and tables: tests and benchmarks ask more than once.
_built: dict[tuple[str, str, str], object] = {}


def _kept(spark, sf_dir: str, name: str, build):
    """What ``build`` makes of a folder of this session for the tables of ``sf_dir``, made once."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _built:
        _built[at] = build(f"{shared_folder(spark)}/almanac-{name}-{hashlib.sha256(repr(at).encode()).hexdigest()[:16]}-{uuid.uuid4().hex[:8]}")
    return _built[at]


def _documents(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.split_part("text", F.lit("."), F.lit(1)).alias("title"), F.col("lang").alias("tags"), F.col("text").alias("description"), F.col("source").alias("venue"), F.col("n_chars").alias("next_start"))


def document_index(spark, sf_dir) -> index.SearchIndex:
    def build(path):
        made = index.SearchIndex(spark, path, "doc_id")
        made.refresh(_documents(spark, sf_dir), listing.search_fingerprint())
        return made

    return _kept(spark, sf_dir, "document-index", build)


def listing_index(spark, sf_dir) -> index.SearchIndex:
    def build(path):
        made = index.SearchIndex(spark, path, "id", stemmed=True)
        events, venues = third._all(spark, sf_dir, "events", "venues")
        made.refresh(listing.search_texts(events, venues), listing.search_fingerprint())
        return made

    return _kept(spark, sf_dir, "listing-index", build)


_WORDS_OF = r"list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '' AND NOT list_contains(stop, w))"


@_query(f"""WITH d AS (SELECT doc_id, split_part(text, '.', 1) AS title, lang AS tags, text AS description, source AS venue, [{", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)}] AS stop FROM documents),
    p AS (SELECT 'w' AS kind, doc_id, unnest(list_distinct(list_concat(list_concat({_WORDS_OF.format("title")}, {_WORDS_OF.format("tags")}), {_WORDS_OF.format("description")}))) AS term FROM d
      UNION ALL SELECT 't', doc_id, unnest({_GRAMS.format("coalesce(title, '')")}) FROM d UNION ALL SELECT 'v', doc_id, unnest({_GRAMS.format("coalesce(venue, '')")}) FROM d)
    SELECT kind, count(DISTINCT term) AS terms, count(*) AS postings FROM p GROUP BY kind""")
def search_index(spark, sf_dir):
    lists = document_index(spark, sf_dir).lists(None)
    return lists.groupBy("kind").agg(F.count_distinct("term").alias("terms"), F.count(F.lit(1)).alias("postings"))


@_query(_SQL["hybrid_search"])
def indexed_hybrid_search(spark, sf_dir):
    rows = _documents(spark, sf_dir).join(_t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    found = search.search(rows, "doc_id", "river or license", [1.0] + [0.0] * 63, [F.col("tags") == "en"], index=document_index(spark, sf_dir))
    return found.select("doc_id", F.round("score", 9).alias("score"), "next_start")


@_query(_SQL["search_request"])
def indexed_request(spark, sf_dir):
    tables = third._all(spark, sf_dir, "events", "instances", "venues")
    found = listing.search_listings(*tables, listing.Request(q="free gears"), NOW, index=listing_index(spark, sf_dir))
    return found.select("id", F.round("score", 9).alias("score"), "next_start")


def document_vectors(spark, sf_dir) -> nearest.Vectors:
    def build(path):
        made = nearest.Vectors(spark, path, "vec_id")
        made.build(_t(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
        return made

    return _kept(spark, sf_dir, "vectors", build)


@_query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, row_number() OVER (ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], q), vec_id) AS rank FROM embeddings, q ORDER BY rank LIMIT 50""")
def nearest_vectors(spark, sf_dir):
    query = _t(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()  # one stated query vector
    found = document_vectors(spark, sf_dir).top([float(x) for x in query[0]] if query else [], search.VECTOR_TOP)
    return found.select("vec_id", F.col("rank").cast("long").alias("rank"))


@_query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN upper(p_name) ELSE p_name END AS title, length(CASE WHEN p_size % 5 = 0 THEN upper(p_name) ELSE p_name END) AS size, CASE WHEN p_size % 7 = 0 THEN 1 WHEN p_size % 5 = 0 OR p_size % 4 = 0 THEN 2 ELSE 1 END AS run
    FROM part WHERE p_size % 3 <> 0""")
def recomputed_titles(spark, sf_dir):
    """Results of a first run over some parts, and of a second after some titles changed, some parts came and some went."""
    part = _t(spark, sf_dir, "part")
    kept = changes.Kept(f"{shared_folder(spark)}/almanac-titles-{uuid.uuid4().hex}", "p_partkey")
    work = lambda run: lambda rows: rows.select("p_partkey", F.length("title").alias("size"), F.lit(run).alias("run"), "title")
    first = part.filter("p_size % 7 = 0 OR p_size % 4 <> 0").select("p_partkey", F.when(F.expr("p_size % 5 = 0 AND p_size % 7 = 0"), F.upper("p_name")).otherwise(F.col("p_name")).alias("title"))
    kept.refresh(first, F.xxhash64("title"), work(1))
    then = part.filter("p_size % 3 <> 0").select("p_partkey", F.when(F.expr("p_size % 5 = 0"), F.upper("p_name")).otherwise(F.col("p_name")).alias("title"))
    kept.refresh(then, F.xxhash64("title"), work(2))
    return kept.current(spark).select("p_partkey", "title", "size", "run")
