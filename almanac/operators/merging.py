"""Merging of listings: candidates, decisions in score order, and the rewritten tables.

Tables are snapshots: ``events`` (id, slug, title, normalized_title, venue_id, canonical_url, created_at, locked, and any
other fields), ``instances`` (event_id, start_at, ...), ``links`` (event_id, source_id, is_canonical, ...), ``sources``
(id, key, adapter_type), ``venues`` (id, normalized_name), ``reviews`` (event_a, event_b, status, ...).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions import scoring, timefn
from almanac.functions.names import adapter_rank, fixed4
from almanac.functions.text import trigram_similarity
from almanac.operators import core
from almanac.operators.lineage import cut
from almanac.operators.resolution import linked_groups

TITLE_FLOOR = 0.3
#: Groups of linked pairs up to this many are decided in one task each; larger ones in rounds over whole tables.
GROUP_PAIRS = 1_000_000
#: Starts in a part of a day, and venue names up to which the similarities of all are looked up.
CELL, VENUE_NAMES = 4096, 512


def _signals(pairs: DataFrame, events: DataFrame, venues: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with venue_affinity and url_match."""
    named = events.join(venues.select(F.col("id").alias("venue_id"), "normalized_name"), "venue_id", "left")
    side = lambda k: named.select(F.col("id").alias(k), F.col("venue_id").alias(f"_v{k}"), F.col("normalized_name").alias(f"_n{k}"), F.col("canonical_url").alias(f"_u{k}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    affinity = scoring.venue_affinity(F.col("_va"), F.col("_vb"), F.when(F.col("_na").isNotNull() & F.col("_nb").isNotNull(), trigram_similarity(F.col("_na"), F.col("_nb"))))
    return rows.select(*pairs.columns, affinity.alias("venue_affinity"), F.coalesce(F.col("_ua") == F.col("_ub"), F.lit(False)).alias("url_match"))


def _starts(instances: DataFrame) -> DataFrame:
    at = F.col("start_at")
    return instances.select("event_id", timefn.local_day(at).alias("day"), F.when(~timefn.is_midnight(at), F.unix_micros(at.cast("timestamp"))).alias("at"))


def _rounded(similarity: Column, digits: int | None) -> Column:
    return similarity if digits is None else F.round(similarity, digits)


def _like_names(venues: DataFrame, digits: int | None) -> tuple[DataFrame, DataFrame | None]:
    """``venues`` with a name index ``_name``, and the similarity of any two names by their indices.

    A table of all pairs of names is made for ``VENUE_NAMES`` names at most, and is so small for any number of venues.
    With more names ``_name`` is the name itself and there is no table.
    """
    names = venues.filter("normalized_name IS NOT NULL").select("normalized_name").distinct()
    if names.limit(VENUE_NAMES + 1).count() > VENUE_NAMES:
        return venues.select(F.col("id").alias("venue_id"), F.col("normalized_name").alias("_name")), None
    known = cut(names.select("normalized_name", F.row_number().over(Window.orderBy("normalized_name")).cast("long").alias("_name")))
    one, two = (known.select(F.col("_name").alias(f"_{x}"), F.col("normalized_name").alias(f"_t{x}")) for x in "xy")
    like = one.crossJoin(two).select((F.col("_x") * 2 * VENUE_NAMES + F.col("_y")).alias("_names"), _rounded(trigram_similarity(F.col("_tx"), F.col("_ty")), digits).alias("_like"))
    return venues.join(known, "normalized_name", "left").select(F.col("id").alias("venue_id"), "_name"), like


def _bit(value: Column, bits: int = 64) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(value, F.lit(bits)).cast("int"))


def _cells(starts: DataFrame, events: DataFrame, links: DataFrame, places: DataFrame, reviews: DataFrame, digits: int | None) -> DataFrame:
    """(day, i, j, left, right): the starts of a day in parts of some ``CELL``, each part beside itself and each later one.

    ``left`` has (near, rows) for each title of part i, ``right`` a map of the rows of each title of part j. So a start is
    copied once for each part of its day, not for each start or similar title that it meets.
    """
    number = F.unix_date("day")
    days = starts.groupBy("event_id").agg(F.bit_or(_bit(number)).alias("d64"), F.bit_or(_bit(number, 61)).alias("d61"), (F.count(F.lit(1)) == F.count_distinct("day")).alias("once"))
    sources = links.groupBy("event_id").agg(F.array_sort(F.collect_set("source_id")).alias("sources"), F.coalesce(F.bit_or(_bit(F.xxhash64("source_id"))), F.lit(0)).alias("source_bits"))
    seen = reviews.groupBy(F.col("event_a").alias("event_id")).agg(F.bit_or(_bit(F.xxhash64("event_b"))).alias("reviewed"))
    of = events.select(F.col("id").alias("event_id"), F.col("normalized_title").alias("title"), F.col("venue_id"), F.col("canonical_url").alias("url")).join(places, "venue_id", "left")
    of = of.join(days, "event_id").join(sources, "event_id", "left").join(seen, "event_id", "left")
    no = F.lit(0).cast("long")
    columns = {"sources": F.coalesce("sources", F.array().cast(sources.schema["sources"].dataType)), "source_bits": F.coalesce("source_bits", no), "reviewed": F.coalesce("reviewed", no)}
    rows = starts.join(of.withColumns(columns), "event_id")
    parts = starts.groupBy("day").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("parts"))
    rows = rows.join(parts, "day").withColumn("part", F.pmod(F.xxhash64("event_id"), "parts").cast("int")).repartition("day", "part")
    row = F.struct(F.col("event_id").alias("id"), "at", "d64", "d61", "once", "source_bits", "reviewed", _bit(F.xxhash64("event_id")).alias("bit"), "venue_id", "_name", "url", "sources")
    groups = rows.groupBy("day", "parts", "part", "title").agg(F.collect_list(row).alias("rows"))
    near = core.similar_texts(events.select(F.col("normalized_title").alias("t")), TITLE_FLOOR)
    both = near.unionByName(near.filter("ta <> tb").select(F.col("tb").alias("ta"), F.col("ta").alias("tb"), "similarity"))
    lists = both.groupBy(F.col("ta").alias("title")).agg(F.collect_list(F.struct(F.col("tb").alias("title"), _rounded(F.col("similarity"), digits).alias("similarity"))).alias("near"))
    left = groups.join(lists, "title").groupBy("day", "parts", "part").agg(F.collect_list(F.struct("near", "rows")).alias("left"))
    right = groups.filter("title IS NOT NULL").groupBy("day", "part").agg(F.map_from_entries(F.collect_list(F.struct("title", "rows"))).alias("right"))
    left = left.select("day", F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j"), "left")
    right = right.select("day", F.explode(F.sequence(F.lit(0), "part")).alias("i"), F.col("part").alias("j"), "right")
    return left.join(right, ["day", "i", "j"])


def candidates(events: DataFrame, instances: DataFrame, links: DataFrame, venues: DataFrame, reviews: DataFrame, as_of: datetime, digits: int | None = None) -> DataFrame:
    """(a, b, title_similarity, venue_affinity, minutes, url_match) of listings of one local day with similar titles.

    Similar titles are found first, among distinct ones; starts then meet in cells of a day. Minutes are those between
    the nearest starts, of which none is at midnight, the placeholder of an unknown time.

    Pairs are not shuffled but for those that may meet more than once, or may have been reviewed: bits of an event's
    days and reviews tell of all others that they do not. With ``digits`` both similarities are rounded, before there
    are pairs.
    """
    recent = instances.filter(F.col("start_at") >= F.lit(as_of).cast("timestamp_ntz") - F.expr("INTERVAL 1 DAY"))
    places, like = _like_names(venues, digits)
    groups = _cells(_starts(recent), events, links, places, reviews, digits).select("day", (F.col("i") == F.col("j")).alias("own"), F.explode("left").alias("g"), "right")
    titles = groups.select("day", "own", F.col("g.rows").alias("rows"), F.explode("g.near").alias("n"), "right")
    titles = titles.select("day", "own", F.col("n.similarity").alias("title_similarity"), "rows", F.col("right")[F.col("n.title")].alias("found"))
    rows = titles.select("day", "own", "title_similarity", F.explode("rows").alias("x"), "found")
    x, y = lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}")
    met = rows.select("day", "own", "title_similarity", "x", F.explode("found").alias("y")).filter(F.when(F.col("own"), x("id") < y("id")).otherwise(x("id") != y("id")))
    both = lambda c: x(c).bitwiseAND(y(c))
    met = met.filter((both("source_bits") == 0) | ~F.arrays_overlap(x("sources"), y("sources")))
    number = F.unix_date("day")
    once = x("once") & y("once") & ((both("d64") == _bit(number)) | (both("d61") == _bit(number, 61)))
    unseen = (x("reviewed").bitwiseAND(y("bit")) == 0) & (y("reviewed").bitwiseAND(x("bit")) == 0)
    names = [] if like is None else [(x("_name") * 2 * VENUE_NAMES + y("_name")).alias("_names")]
    alike = _rounded(trigram_similarity(x("_name"), y("_name")), digits).alias("_like") if like is None else None
    apart = F.abs(x("at") - y("at"))
    pairs = met.select(F.least(x("id"), y("id")).alias("a"), F.greatest(x("id"), y("id")).alias("b"), "title_similarity", (x("venue_id") == y("venue_id")).alias("_same"), *([alike] if like is None else names), apart.alias("_apart"), F.coalesce(x("url") == y("url"), F.lit(False)).alias("url_match"), (once & unseen).alias("_plain"))
    if like is not None:
        pairs = pairs.join(F.broadcast(like), "_names", "left")  # VENUE_NAMES squared rows at most
    affinity = F.when(F.col("_same"), 1.0).otherwise(F.coalesce("_like", F.lit(scoring.UNKNOWN_AFFINITY))).alias("venue_affinity")
    pairs = pairs.select("a", "b", "title_similarity", affinity, "_apart", "url_match", "_plain")
    keys = ["a", "b", "title_similarity", "venue_affinity", "url_match"]
    again = pairs.filter("NOT _plain").groupBy("a", "b").agg(*[F.first(c).alias(c) for c in keys[2:]], F.min("_apart").alias("_apart"))
    again = again.join(reviews.select(F.col("event_a").alias("a"), F.col("event_b").alias("b")), ["a", "b"], "left_anti")
    every = pairs.filter("_plain").select(*keys, "_apart").unionByName(again.select(*keys, "_apart"))
    return every.select("a", "b", "title_similarity", "venue_affinity", (F.col("_apart") / 60_000_000.0).alias("minutes"), "url_match")


def scored(pairs: DataFrame) -> DataFrame:
    """``candidates`` with score and kind: merge, same-show, queue or ignore."""
    score = scoring.pair_score(F.col("title_similarity"), F.col("venue_affinity"), F.col("minutes"), F.col("url_match"))
    rows = pairs.withColumn("score", score)
    verdict = scoring.verdict(F.col("score"))
    show = scoring.same_show(F.col("venue_affinity"), F.col("minutes"))
    return rows.withColumn("kind", F.when(verdict == "merge", "merge").when(verdict == "review", F.when(show, "same-show").otherwise("queue")).otherwise("ignore"))


def provenance(events: DataFrame, links: DataFrame, sources: DataFrame, owned: Sequence[str]) -> DataFrame:
    """(id, created_at, rank, key, owned) by the best link of each listing; of links of one rank, that of the first key."""
    of = links.join(sources.select(F.col("id").alias("source_id"), "key", adapter_rank(F.col("adapter_type")).alias("rank")), "source_id")
    best = of.groupBy(F.col("event_id").alias("id")).agg(F.min(F.struct((-F.col("rank")).alias("r"), "key")).alias("best"))
    named = best.select("id", (-F.col("best.r")).alias("rank"), F.col("best.key").alias("key"), F.col("best.key").isin(list(owned)).alias("owned"))
    return events.select("id", "created_at").join(named, "id")


_DECIDED = "a {id}, b {id}, score double, kind string, survivor {id}, absorbed {id}, step long"


def _decide_group(rows: pd.DataFrame) -> pd.DataFrame:
    """The loop over one group of linked pairs, best first; what a merge absorbs meets no later pair."""
    rows = rows.sort_values(["score", "a", "b"], ascending=[False, True, True], kind="stable")
    state: dict = {}
    for x in rows.itertuples(index=False):
        state.setdefault(x.a, (x.rank_a, x.key_a, x.owned_a, x.created_a))
        state.setdefault(x.b, (x.rank_b, x.key_b, x.owned_b, x.created_b))
    gone, out = set(), []
    for x in rows.itertuples(index=False):
        if x.a in gone or x.b in gone or x.kind == "ignore":
            continue
        if x.kind == "queue":
            out.append((x.a, x.b, x.score, x.kind, None, None, len(out)))
            continue
        (rank_a, key_a, owned_a, made_a), (rank_b, key_b, owned_b, made_b) = state[x.a], state[x.b]
        first = rank_a > rank_b if rank_a != rank_b else made_a <= made_b
        if x.kind == "same-show" and owned_a != owned_b:
            first = owned_a
        stays, goes = (x.a, x.b) if first else (x.b, x.a)
        gone.add(goes)
        links = sorted([(-rank_a, key_a, owned_a), (-rank_b, key_b, owned_b)])[0]  # the survivor has both ones' links now
        state[stays] = (-links[0], links[1], links[2], state[stays][3])
        out.append((x.a, x.b, x.score, x.kind, stays, goes, len(out)))
    return pd.DataFrame(out, columns=["a", "b", "score", "kind", "survivor", "absorbed", "step"]).astype({"survivor": object, "absorbed": object})


def _decide_rounds(pairs: DataFrame, state: DataFrame) -> DataFrame:
    """As ``_decide_group`` for groups of any size: each round decides the pairs that come first at both their ends."""
    order = F.struct((-F.col("score")).alias("s"), F.col("a").alias("x"), F.col("b").alias("y"))
    left, state, done = cut(pairs.filter("kind <> 'ignore'").select("a", "b", "score", "kind")), cut(state), None
    turn = 0
    while left.limit(1).count():
        ranked = left.withColumn("_order", order)
        ends = ranked.select(F.explode(F.array("a", "b")).alias("_end"), "_order").groupBy("_end").agg(F.min("_order").alias("_first"))
        of = lambda c: ends.select(F.col("_end").alias(c), F.col("_first").alias(f"_f{c}"))  # noqa: B023, E731
        who = lambda c: state.select(F.col("id").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in ("rank", "key", "owned", "created_at")])  # noqa: B023, E731
        ready = ranked.join(of("a"), "a").join(of("b"), "b").filter("_order = _fa AND _order = _fb").join(who("a"), "a").join(who("b"), "b")
        by_rank = scoring.first_survives(F.col("rank_a"), F.col("rank_b"), F.col("created_at_a"), F.col("created_at_b"))
        first = F.when(F.col("kind") == "same-show", scoring.first_survives_same_show(F.col("owned_a"), F.col("owned_b"), by_rank)).otherwise(by_rank)
        merges = F.col("kind") != "queue"
        best = F.least(*[F.struct((-F.col(f"rank_{c}")).alias("r"), F.col(f"key_{c}").alias("k"), F.col(f"owned_{c}").alias("o")) for c in "ab"])
        taken = ready.withColumns({"survivor": F.when(merges, F.when(first, F.col("a")).otherwise(F.col("b"))), "absorbed": F.when(merges, F.when(first, F.col("b")).otherwise(F.col("a"))), "_best": best, "step": F.lit(turn).cast("long")})
        taken = cut(taken.select("a", "b", "score", "kind", "survivor", "absorbed", "step", "_best"))
        done = taken.drop("_best") if done is None else done.unionByName(taken.drop("_best"))
        now = taken.filter("survivor IS NOT NULL").select(F.col("survivor").alias("id"), "_best")
        state = cut(state.join(now, "id", "left").select("id", "created_at", *[F.coalesce(new, old).alias(old) for new, old in ((-F.col("_best.r"), "rank"), (F.col("_best.k"), "key"), (F.col("_best.o"), "owned"))]))
        gone = taken.filter("absorbed IS NOT NULL").select(F.col("absorbed").alias("_gone"))
        left = left.join(taken.select("a", "b"), ["a", "b"], "left_anti")
        left = cut(left.join(gone, F.col("a") == F.col("_gone"), "left_anti").join(gone, F.col("b") == F.col("_gone"), "left_anti"))
        turn += 1
    return done if done is not None else pairs.sparkSession.createDataFrame([], _DECIDED.format(id=pairs.schema["a"].dataType.simpleString()))


def decide(pairs: DataFrame, state: DataFrame) -> DataFrame:
    """(a, b, score, kind, survivor, absorbed, step) of the pairs that a loop in score order takes.

    ``pairs``: a, b, score, kind; ``state``: as ``provenance``. A pair with an absorbed end is passed over; a survivor
    may absorb more, and has its links and theirs from then on. Queued pairs absorb nothing, so the loop does without
    them: one is taken if it comes before the pairs that absorb its ends. ``step`` orders the merges of one group of
    linked pairs; queued pairs have none.
    """
    pairs = cut(pairs.filter("kind <> 'ignore'").select("a", "b", "score", "kind"))
    active = cut(pairs.filter("kind <> 'queue'"))
    groups = linked_groups(active)
    sized = active.join(groups.withColumnRenamed("node", "a"), "a")
    many = sized.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    sized = cut(sized.join(many, "component"))
    who = lambda c: state.select(F.col("id").alias(c), *[F.col(k).alias(f"{n}_{c}") for k, n in (("rank", "rank"), ("key", "key"), ("owned", "owned"), ("created_at", "created"))])
    small = sized.filter(F.col("_n") <= GROUP_PAIRS).join(who("a"), "a").join(who("b"), "b")
    shape = _DECIDED.format(id=pairs.schema["a"].dataType.simpleString())
    found = small.groupBy("component").applyInPandas(_decide_group, shape)
    large = sized.filter(F.col("_n") > GROUP_PAIRS)
    found = cut(found.unionByName(_decide_rounds(large, state)) if large.limit(1).count() else found)
    order = F.struct((-F.col("score")).alias("s"), F.col("a").alias("x"), F.col("b").alias("y"))
    ends = state.select("id").join(found.select(F.col("absorbed").alias("id"), order.alias("_gone")), "id", "left")
    queue = pairs.filter("kind = 'queue'").select("a", "b", "score")
    for end in "ab":
        queue = queue.join(ends.withColumnRenamed("id", end), end).filter(F.col("_gone").isNull() | (order < F.col("_gone"))).select("a", "b", "score")
    none = F.lit(None).cast(pairs.schema["a"].dataType)
    return found.unionByName(queue.select("a", "b", "score", F.lit("queue").alias("kind"), none.alias("survivor"), none.alias("absorbed"), F.lit(None).cast("long").alias("step")))


def merge_paths(merges: DataFrame, locks: DataFrame) -> DataFrame:
    """(id, root, path, time_locked, venue_locked) of every absorbed listing.

    ``merges``: survivor, absorbed, step; ``locks``: id, locked. ``path`` has the steps from the root down, so that
    paths in ascending order are the order in which listings of a family reached the root. A lock of any survivor
    on the way holds. Chains are followed by doubling to any length; merges in a circle raise.
    """
    held = lambda name: F.coalesce(F.array_contains("locked", name), F.lit(False))
    up = merges.join(locks.select(F.col("id").alias("survivor"), held("time").alias("time_locked"), held("venue").alias("venue_locked")), "survivor", "left")
    open_ = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    paths = cut(up.select(F.col("absorbed").alias("id"), F.col("survivor").alias("root"), F.array("step").alias("path"), open_("time_locked"), open_("venue_locked")))
    turns = merges.count().bit_length() + 1  # in as many doublings every chain is followed, unless it is a circle
    while True:
        above = paths.select(F.col("id").alias("root"), F.col("root").alias("_r"), F.col("path").alias("_p"), F.col("time_locked").alias("_t"), F.col("venue_locked").alias("_v"))
        longer = paths.join(above, "root", "left")
        if not longer.filter("_r IS NOT NULL").limit(1).count():
            return paths
        if not turns:
            raise ValueError("merges go in a circle")
        turns -= 1
        no = F.lit(False)
        paths = cut(longer.select("id", F.coalesce("_r", "root").alias("root"), F.when(F.col("_r").isNotNull(), F.concat("_p", "path")).otherwise(F.col("path")).alias("path"), (F.col("time_locked") | F.coalesce("_t", no)).alias("time_locked"), (F.col("venue_locked") | F.coalesce("_v", no)).alias("venue_locked")))


def _own(paths: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with root, path (empty for rows of listings that no other absorbed) and locks of their listing."""
    joined = rows.join(paths.withColumnRenamed("id", key), key, "left")
    no = F.lit(False)
    return joined.withColumns({"root": F.coalesce("root", key), "path": F.coalesce("path", F.array().cast("array<bigint>")), "time_locked": F.coalesce("time_locked", no), "venue_locked": F.coalesce("venue_locked", no)})


def merged_instances(instances: DataFrame, paths: DataFrame) -> DataFrame:
    """Instances under their roots: of those that start together the one that was there first; none pass a time lock."""
    rows = _own(paths, instances, "event_id").filter("NOT time_locked")
    others = [c for c in instances.columns if c not in ("event_id", "start_at")]
    kept = rows.groupBy("root", "start_at").agg(F.min_by(F.struct(F.lit(0).alias("_"), *others), "path").alias("x"))
    return kept.select(F.col("root").alias("event_id"), "start_at", *[F.col(f"x.{c}").alias(c) for c in others]).select(*instances.columns)


def merged_events(events: DataFrame, paths: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Listings that stay; their nulls among ``fields`` and venue_id are filled from what they absorbed, in order."""
    rows = _own(paths, events, "id")
    families = rows.join(paths.select("root").distinct(), "root", "left_semi")
    filled = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (~F.col("venue_locked") if c == "venue_id" else F.lit(True)), F.col("path"))).alias(f"_{c}")
    fill = families.groupBy("root").agg(*[filled(c) for c in (*fields, "venue_id")]).withColumnRenamed("root", "id")
    stay = events.join(paths.select("id"), "id", "left_anti").join(fill, "id", "left")
    return stay.select(*[F.coalesce(c, f"_{c}").alias(c) if c in (*fields, "venue_id") else F.col(c) for c in events.columns])


def merged_links(links: DataFrame, paths: DataFrame) -> DataFrame:
    """Links under their roots; those that moved are not canonical."""
    rows = _own(paths, links, "event_id")
    changed = {"event_id": F.col("root"), "is_canonical": F.col("is_canonical") & (F.size("path") == 0)}
    return rows.select(*[changed.get(c, F.col(c)).alias(c) for c in links.columns])


def merged_receipts(receipts: DataFrame, merges: DataFrame, events: DataFrame, paths: DataFrame) -> DataFrame:
    """(event_id, merged_slug, merged_title, score, decided_by): earlier receipts follow their listing, new ones join."""
    old = _own(paths, receipts, "event_id").select(F.col("root").alias("event_id"), "merged_slug", "merged_title", "score", "decided_by")
    named = events.select(F.col("id").alias("absorbed"), F.col("slug").alias("merged_slug"), F.col("title").alias("merged_title"))
    new = merges.join(named, "absorbed").join(paths.select(F.col("id").alias("absorbed"), "root"), "absorbed")
    return old.unionByName(new.select(F.col("root").alias("event_id"), "merged_slug", "merged_title", fixed4(F.col("score")).alias("score"), "decided_by"))


def merged_reviews(reviews: DataFrame, paths: DataFrame) -> DataFrame:
    """Reviews of which no end was absorbed."""
    gone = paths.select(F.col("id").alias("_gone"))
    return reviews.join(gone, F.col("event_a") == F.col("_gone"), "left_anti").join(gone, F.col("event_b") == F.col("_gone"), "left_anti")


def queued_reviews(reviews: DataFrame, decided: DataFrame, unseen: bool = False) -> DataFrame:
    """``reviews`` (event_a, event_b, score, status) with the queued pairs that it lacks.

    Pairs of ``candidates`` of the same reviews are ``unseen``: it lacks them all, and they need not be shuffled to find it.
    """
    new = decided.filter("kind = 'queue'").select(F.col("a").alias("event_a"), F.col("b").alias("event_b"), fixed4(F.col("score")).alias("score"), F.lit("pending").alias("status"))
    reviews = reviews.select("event_a", "event_b", "score", "status")
    return reviews.unionByName(new) if unseen else core.insert_if_absent(reviews, new, ["event_a", "event_b"])


def backlog(reviews: DataFrame, events: DataFrame, instances: DataFrame, venues: DataFrame) -> DataFrame:
    """Pending reviews as pairs for ``decide``: same-show by what the tables hold now, else ignored."""
    pending = reviews.filter("status = 'pending'").select(F.col("event_a").alias("a"), F.col("event_b").alias("b"), F.col("score").cast("double").alias("score"))
    starts = _starts(instances).filter("at IS NOT NULL")
    side = lambda k: starts.select(F.col("event_id").alias(k), "day", F.col("at").alias(f"at_{k}"))
    met = pending.select("a", "b").join(side("a"), "a").join(side("b"), ["b", "day"])
    minutes = met.groupBy("a", "b").agg((F.min(F.abs(F.col("at_a") - F.col("at_b"))) / 60_000_000.0).alias("minutes"))
    rows = _signals(pending.join(minutes, ["a", "b"], "left"), events, venues)
    show = scoring.same_show(F.col("venue_affinity"), F.col("minutes"))
    return rows.withColumn("kind", F.when(show, "same-show").otherwise("ignore"))


def decide_reviews(reviews: DataFrame, decisions: DataFrame, events: DataFrame) -> DataFrame:
    """(id, verdict, survivor, outcome) of ``decisions`` (id, verdict, survivor), one an id, on ``reviews``.

    Outcomes: ``missing`` (no pending review), ``corrupt`` (no score), ``foreign`` (the survivor is no end of the pair), ``gone``
    (an end is no longer there), ``approved`` and ``rejected``.
    """
    rows = decisions.select("id", "verdict", "survivor").join(reviews.select("id", "event_a", "event_b", "status", F.col("score").try_cast("double").alias("score")), "id", "left")
    live = lambda k: events.select(F.col("id").alias(k), F.lit(True).alias(f"_{k}"))
    rows = rows.join(live("event_a"), "event_a", "left").join(live("event_b"), "event_b", "left")
    ends = F.col("survivor").isNull() | (F.col("survivor") == F.col("event_a")) | (F.col("survivor") == F.col("event_b"))
    outcome = F.when(F.coalesce(F.col("status") != "pending", F.lit(True)), "missing").when(F.col("verdict") == "rejected", "rejected").when(F.col("score").isNull(), "corrupt")
    outcome = outcome.when(~ends, "foreign").when(F.col("_event_a").isNull() | F.col("_event_b").isNull(), "gone").otherwise("approved")
    return rows.select("id", "verdict", "survivor", outcome.alias("outcome"))


def moved_picks(picks: DataFrame, merges: DataFrame, paths: DataFrame) -> DataFrame:
    """Picks of absorbed listings follow a merge decided by review, and go with one decided by score."""
    how = merges.select(F.col("absorbed").alias("event_id"), "decided_by")
    rows = _own(paths, picks, "event_id").join(how, "event_id", "left").filter("decided_by IS NULL OR decided_by = 'review'")
    changed: dict[str, Column] = {"event_id": F.col("root")}
    return rows.select(*[changed.get(c, F.col(c)).alias(c) for c in picks.columns])
