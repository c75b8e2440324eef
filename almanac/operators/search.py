"""Hybrid search: weighted words and trigram similarity, vectors, reciprocal rank fusion.

Words are those of ``lexemes``: lower case, without stop words and, if asked for, as English stems, with their places and
weights. A table that is searched often keeps them in a column ``lexemes``; else they are made in the query.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from itertools import combinations
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.scoring import cosine_distance
from almanac.functions.stemming import STOP_WORDS, stem, stems
from almanac.functions.text import set_similarity, text_grams, trigrams
from almanac.operators import core, ordered
from almanac.operators.core import reciprocal_rank_fusion
from almanac.operators.lineage import cut

if TYPE_CHECKING:
    from almanac.operators.index import SearchIndex
    from almanac.operators.nearest import Vectors

# Weights of title, tags and description; limits and weights of the similarities; the limit of squares; the
# places of a word that count.
WEIGHTS = {"title": 1.0, "tags": 0.4, "description": 0.2}
TITLE_FLOOR, VENUE_FLOOR = 0.3, 0.4
TITLE_SHARE, VENUE_SHARE = 0.5, 0.3
SQUARES = 1.64493406685
MAX_PLACES = 256
NO_PAIR = 1e-20
VECTOR_TOP = 50

Query = list[list[tuple[bool, list[tuple[str, int]]]]]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _placed(columns: dict[str, Column], keep: Callable[[Column], Column], stemmed: bool, raw: bool = False) -> Column:
    """Structs (w, p, v), and ``raw`` words if asked for, of the words that ``keep`` accepts; places go on from column to column."""

    def of(text: Column) -> Column:
        def own(found: Column) -> Column:
            placed = F.transform(found, lambda w, i: F.struct(w.alias("w"), (i + 1).alias("p"), w.alias("raw")))
            return F.struct(F.size(found).alias("n"), F.filter(placed, keep).alias("k"))

        if not stemmed:
            return _let(words(text), own)
        both = F.zip_with(words(text), stems(words(text)), lambda w, x: F.struct(x.alias("w"), w.alias("raw")))
        placed = F.transform(both, lambda x, i: F.struct(x["w"].alias("w"), (i + 1).alias("p"), x["raw"].alias("raw")))
        return _let(placed, lambda found: F.struct(F.size(found).alias("n"), F.filter(found, keep).alias("k")))

    names = [k for k in WEIGHTS if k in columns]

    def joined(fields: Column) -> Column:
        parts, shift = [], F.lit(0)
        for name in names:
            parts.append(_shifted(fields[name]["k"], shift, WEIGHTS[name], raw))
            shift = shift + fields[name]["n"]
        return F.concat(*parts)

    return _let(F.struct(*[of(columns[k]).alias(k) for k in names]), joined)


def _shifted(found: Column, shift: Column, weight: float, raw: bool) -> Column:
    more = lambda x: [x["raw"].alias("raw")] if raw else []
    return F.transform(found, lambda x: F.struct(x["w"].alias("w"), (x["p"] + shift).alias("p"), F.lit(weight).alias("v"), *more(x)))


def lexemes(columns: dict[str, Column], stemmed: bool = False) -> Column:
    """Structs (w, p, v): words, places and weights of the columns that WEIGHTS names, without stop words."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return _placed(columns, lambda x: ~F.array_contains(stop, x["raw"]), stemmed)


def exploded(rows: DataFrame, key: str, stemmed: bool = False) -> DataFrame:
    """(key, w, p, v): the ``lexemes`` of ``rows`` as rows; stop words are left out by one lookup a word, not by a walk."""
    found = _placed({k: F.col(k) for k in WEIGHTS}, lambda x: F.lit(True), stemmed, raw=True)
    return rows.select(key, F.explode(found).alias("x")).filter(~F.col("x.raw").isin(*STOP_WORDS)).select(key, "x.w", "x.p", "x.v")


def parse(query: str, stemmed: bool = False) -> Query:
    """Alternatives of (wanted, words in a row with their places): quotes bind a phrase, ``or`` parts alternatives, ``-``
    denies; stop words are left out."""
    out: Query = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query.lower()):
        if word == "or" and not minus:
            out.append([])
            continue
        row = re.findall(r"[^\W_]+", phrase or word)
        found = [(stem(w) if stemmed else w, i) for i, w in enumerate(row) if w not in STOP_WORDS]
        if found:
            out[-1].append((not minus, found))
    return [x for x in out if x]


def _meets(hits: Column, query: Query) -> Column:
    def row(found: list[tuple[str, int]]) -> Column:
        (first, at), rest = found[0], found[1:]
        if not rest:
            return F.exists(hits, lambda x: x["w"] == first)
        follows = lambda x: reduce(lambda a, b: a & b, [F.exists(hits, lambda y: (y["w"] == w) & (y["p"] == x["p"] + (i - at))) for w, i in rest])  # noqa: B023, E731
        return F.exists(hits, lambda x: (x["w"] == first) & follows(x))

    each = [reduce(lambda a, b: a & b, [row(found) if wanted else ~row(found) for wanted, found in terms]) for terms in query]
    return reduce(lambda a, b: a | b, each, F.lit(False))


def _terms(query: Query) -> list[str]:
    return sorted({w for terms in query for _, found in terms for w, _ in found})


def _rank(hits: Column, query: Query) -> Column:
    """Of alternatives, or one word: the mean over all words of their weights over the squares of their order, over
    SQUARES. Of words that are all wanted: how near pairs of them stand, by their weights."""
    terms = _terms(query)
    if not terms:
        return F.lit(0.0)
    of = lambda w: F.slice(F.filter(hits, lambda x: x["w"] == w), 1, MAX_PLACES)
    if len(query) > 1 or len(terms) == 1:
        total = lambda w: F.aggregate(F.transform(of(w), lambda x, i: x["v"] / ((i + 1) * (i + 1))), F.lit(0.0), lambda s, v: s + v) / SQUARES
        return reduce(lambda a, b: a + b, map(total, terms)) / len(terms)

    def near(x: Column, y: Column) -> Column:
        far = F.abs(x["p"] - y["p"])
        reach = F.when(far > 100, 1e-30).otherwise(1.0 / (1.005 + 0.05 * F.exp(far / 1.5 - 2)))
        return F.sqrt(x["v"] * y["v"] * reach)

    pairs = [F.flatten(F.transform(of(a), lambda x: F.transform(F.filter(of(b), lambda y: y["p"] != x["p"]), lambda y: near(x, y)))) for a, b in combinations(terms, 2)]  # noqa: B023
    return _let(F.concat(*pairs), lambda found: F.when(F.size(found) == 0, NO_PAIR).otherwise(1.0 - F.aggregate(found, F.lit(1.0), lambda s, v: s * (1.0 - v))))


def _hits(columns: dict[str, Column], query: Query, stemmed: bool, kept: Column | None = None) -> Column:
    """The words of the query that the columns hold, out of ``kept`` lexemes if there are some.

    Without stems, texts that hold none of them as a string are not taken apart.
    """
    terms = _terms(query)
    wanted = lambda x: x["w"].isin(terms)
    none = F.array().cast("array<struct<w:string,p:int,v:double>>")
    if not terms:
        return none
    if kept is not None:
        return F.filter(kept, wanted)
    found = _placed(columns, wanted, stemmed)
    if stemmed:
        return found
    held = reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(t)) for c in columns.values() for t in terms])
    return F.when(held, found).otherwise(none)


def matches(text: Column, query: str, stemmed: bool = False) -> Column:
    """Whether the words of ``text`` meet ``query``; one without words meets nothing."""
    parsed = parse(query, stemmed)
    return _let(_hits({"title": text}, parsed, stemmed), lambda hits: _meets(hits, parsed))


def word_rank(columns: dict[str, Column], query: str, stemmed: bool = False) -> Column:
    parsed = parse(query, stemmed)
    return _let(_hits(columns, parsed, stemmed), lambda hits: _rank(hits, parsed))


def passes(similarity: Column, floor: float) -> Column:
    """Whether a similarity, in single precision, is above a floor in double precision: 3 / 10 is above 0.3, and 2 / 5 above 0.4."""
    return similarity.cast("float").cast("double") > F.lit(floor)


def text_leg(rows: DataFrame, key: str, query: str, stemmed: bool = False) -> DataFrame:
    """(key, _score) of ``rows`` (key, title, tags, description, venue, and lexemes if kept) that meet the query or resemble it."""
    parsed = parse(query, stemmed)
    hits = _hits({k: F.col(k) for k in WEIGHTS}, parsed, stemmed, F.col("lexemes") if "lexemes" in rows.columns else None)
    grams = F.array(*map(F.lit, text_grams(query))) if text_grams(query) else F.array().cast("array<string>")
    alike = lambda c: set_similarity(trigrams(F.coalesce(c, F.lit(""))), grams)
    found = F.struct(_let(hits, lambda x: F.struct(_meets(x, parsed).alias("meets"), _rank(x, parsed).alias("rank"))).alias("x"), alike("title").alias("t"), alike("venue").alias("v"))
    good = F.filter(F.array(found), lambda f: f["x"]["meets"] | passes(f["t"], TITLE_FLOOR) | passes(f["v"], VENUE_FLOOR))
    # made in a generator, so that nothing is evaluated again for the filter
    scores = F.transform(good, lambda f: f["x"]["rank"] + TITLE_SHARE * f["t"] + VENUE_SHARE * f["v"])
    return rows.select(key, F.explode(scores).alias("_score"))


def vector_leg(rows: DataFrame, key: str, embedding: str, vector: list[float]) -> DataFrame:
    """(key, rank) of the VECTOR_TOP nearest; rows without a vector come last, and may fill the list."""
    far = rows.select(key, cosine_distance(F.col(embedding), F.array(*map(F.lit, vector))).alias("_far"))
    near = far.orderBy(F.asc_nulls_last("_far"), key).limit(VECTOR_TOP)
    return near.select(key, F.row_number().over(Window.orderBy(F.asc_nulls_last("_far"), key)).alias("rank"))


def _text_ranks(found: DataFrame, key: str, limit: int, near: DataFrame | None) -> DataFrame:
    """The ranks (key, rank) that can matter: those of the first ``limit`` rows and of the rows of the vector leg.

    A row of the text leg alone that comes after ``limit`` others is beaten by all of them. The vector leg's rows, of
    which there are VECTOR_TOP at most, are broadcast as one array; each row counts for the first of them that it does
    not come after, and running sums of these counts are their ranks.
    """
    order = [F.desc("_score"), F.col(key)]
    ranks = found.orderBy(*order).limit(limit).select(key, F.row_number().over(Window.orderBy(*order)).alias("rank"))
    if near is None:
        return ranks
    place = F.struct((-F.col("_score")).alias("s"), F.col(key).alias("k"))
    few = found.join(F.broadcast(near.select(key)), key).agg(F.sort_array(F.collect_list(place)).alias("few"))
    before = F.size(F.filter("few", lambda f: f < F.col("_place")))
    counted = found.select(place.alias("_place")).join(F.broadcast(few)).select(before.alias("_n")).groupBy("_n").agg(F.count(F.lit(1)).alias("k"))
    sums = counted.withColumn("rank", F.sum("k").over(Window.orderBy("_n"))).select("_n", "rank")  # at most VECTOR_TOP + 1 rows
    named = few.select(F.posexplode("few").alias("_n", "f")).select("_n", F.col("f.k").alias(key))
    return ranks.unionByName(named.join(sums, "_n").select(key, F.col("rank").cast("int").alias("rank"))).groupBy(key).agg(F.min("rank").alias("rank"))


def search(rows: DataFrame, key: str, query: str = "", vector: list[float] | None = None, facets: list[Column] | None = None, limit: int = 50, stemmed: bool = False, index: SearchIndex | None = None, nearest: Vectors | None = None) -> DataFrame:
    """(key, score, next_start), best first, of ``rows`` (key, title, tags, description, venue, next_start, embedding).

    With neither text nor vector the order is that of ``next_start``. With an ``index`` of these rows, or of more, texts
    are not read; with ``nearest``, which must hold just these rows, vectors are not.
    """
    base = rows.filter(reduce(lambda a, b: a & b, facets or [], F.lit(True)))
    legs = []
    if vector is not None:
        near = nearest.top(vector, VECTOR_TOP) if nearest is not None and not facets else vector_leg(base, key, "embedding", vector)
        legs.append(rows.sparkSession.createDataFrame(near.collect(), near.schema))  # VECTOR_TOP rows, read three times
    if query.strip():
        found = text_leg(base, key, query, stemmed) if index is None else index.text_leg(query).join(base.select(key), key, "left_semi")
        if legs:
            found = cut(found)  # keys and scores, read three times
        legs.append(_text_ranks(found, key, limit, legs[0] if legs else None))
    scored = base.select(key, "next_start")
    scored = scored.join(reciprocal_rank_fusion(legs, key), key) if legs else scored.withColumn("score", F.lit(0.0))
    return scored.select(key, "score", "next_start").orderBy(F.desc("score"), "next_start", key).limit(limit)


def next_similar(rows: DataFrame, key: str, text: str, block: str, floor: float, most: int = 5) -> DataFrame:
    """(a, b, similarity): for each row the ``most`` later ones (b > a) of its block with the most similar texts, of equals those with the smallest keys.

    Of the rows of one text only the next ``most`` after a can count: their ordinals follow from how many come up to a. So a row
    meets ``most`` rows for each similar text, however many have it, and no task has all rows of a text.
    """
    named = rows.select(F.col(block).alias("k"), F.col(text).alias("t"), F.col(key).alias("id")).filter("k IS NOT NULL AND t IS NOT NULL")
    near = core.similar_texts(named.select("k", "t"), floor, block="k")
    both = near.unionByName(near.filter("ta <> tb").select("k", F.col("tb").alias("ta"), F.col("ta").alias("tb"), "similarity"))
    asks = named.withColumnRenamed("t", "ta").join(both, ["k", "ta"]).select("k", F.col("tb").alias("t"), "id", "similarity", F.lit(0).alias("held"))
    held = named.select("k", "t", "id", F.lit(None).cast("double").alias("similarity"), F.lit(1).alias("held"))
    placed = cut(ordered.running_sums(asks.unionByName(held), ["k", "t"], [F.asc("id"), F.desc("held")], {"upto": F.col("held")}))
    after = placed.filter("held = 0").select("k", "t", F.col("id").alias("a"), "similarity", F.explode(F.sequence(F.col("upto") + 1, F.col("upto") + most)).alias("upto"))
    met = after.join(placed.filter("held = 1").select("k", "t", "upto", F.col("id").alias("b")), ["k", "t", "upto"]).select("a", "b", "similarity")
    return core.first_per_key(met, ["a"], [F.desc("similarity"), F.asc("b")], most).drop("place")


def accept_ladder(candidates: DataFrame, key: str, choice: str, accepted: Column, most: int = 5) -> DataFrame:
    """The first accepted of the ``most`` candidates (similarity) nearest to each key."""
    order = Window.partitionBy(key).orderBy(F.desc("similarity"), choice)
    top = candidates.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).filter(accepted)
    return top.groupBy(key).agg(F.min_by(choice, "_n").alias(choice))
