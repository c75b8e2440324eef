"""Batches of normalized records onto stored tables, retention, guarded updates and source health.

``records``: source_id, source_key, source_event_id, ordinal, title, description, url, image, status, is_free, venue_name,
address, lat, lng, start_at, end_at. Functions take snapshots and give snapshots.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.names import content_hash, normalize_name, venue_slug
from almanac.functions.text import slugify
from almanac.operators.core import first_per_key, insert_if_absent
from almanac.operators.mutations import unless_locked

# Days that instances and superseded payloads are kept; rows of one prune; minutes of a claim; lockable fields.
INSTANCE_DAYS, PAYLOAD_DAYS = 90, 30
PRUNE_HOURS, PRUNE_ROWS = 24, 500
CLAIM_MINUTES = 15
LOCKABLE = ("title", "status", "venue", "time")
MONDAY = 2


def landed(stored: DataFrame, new: DataFrame, as_of: datetime) -> DataFrame:
    """``stored`` (source_id, source_event_id, content_hash, payload, extracted_at) with the payloads of ``new`` (source_id,
    source_event_id, payload) that it lacks, by their canonical text; a payload that comes twice lands once."""
    hashed = new.withColumn("content_hash", content_hash(F.col("payload"))).withColumn("extracted_at", F.lit(as_of).cast(stored.schema["extracted_at"].dataType))
    keys = ["source_id", "source_event_id", "content_hash"]
    once = hashed.groupBy(*keys).agg(F.min("payload").alias("payload"), F.min("extracted_at").alias("extracted_at"))
    return insert_if_absent(stored, once, keys)


def resolved_venues(records: DataFrame, venues: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(normalized_name, venue_id) of all names in ``records``, and the venues that they add.

    An alias wins over a venue of that name; a name that neither has becomes a venue, with the place of its first record.
    New ids are derived from names, so that a batch run twice adds nothing.
    """
    named = records.filter("venue_name IS NOT NULL").withColumn("normalized_name", normalize_name(F.col("venue_name")))
    names = first_per_key(named, ["normalized_name"], [F.asc("ordinal"), F.asc("source_id"), F.asc("source_event_id")]).drop("place")
    known = names.join(aliases.select("normalized_name", F.col("venue_id").alias("_alias")), "normalized_name", "left").join(venues.select("normalized_name", F.col("id").alias("_own")), "normalized_name", "left")
    minted = F.concat(F.lit("venue-"), F.substring(F.sha2(F.col("normalized_name"), 256), 1, 24))
    found = known.withColumn("venue_id", F.coalesce("_alias", "_own", minted))
    new = found.filter("_alias IS NULL AND _own IS NULL").select(F.col("venue_id").alias("id"), F.trim("venue_name").alias("name"), "normalized_name", "address", "lat", "lng", venue_slug(F.col("normalized_name")).alias("slug"))
    return found.select("normalized_name", "venue_id"), new


_FIELDS = ("title", "description", "url", "image", "status", "is_free", "venue_id")
_LOCKS = {"title": "title", "status": "status", "venue_id": "venue"}


def persist(records: DataFrame, events: DataFrame, links: DataFrame, instances: DataFrame, names: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``events`` (id, slug, locked, title, normalized_title, description, url, image, status, is_free, venue_id), ``links``
    (source_id, source_event_id, event_id, is_canonical, last_seen_at) and ``instances`` (event_id, start_at, end_at, status,
    source_id) after ``records``, whose venues ``names`` gives.

    A record of a known link updates its listing only through a canonical link, field by field: missing values and
    locked fields keep the old, except that a record without a venue name takes the venue away. Any link has been seen. Others become listings with a canonical link. An instance of the
    same start is replaced; where an id comes once in the batch, the source's other starts of that listing go. A time
    lock keeps instances as they are. Of several records of one id, the last one's fields count.
    """
    key = ["source_id", "source_event_id"]
    rows = records.withColumn("normalized_name", normalize_name(F.col("venue_name"))).join(names, "normalized_name", "left")
    rows = rows.join(links.select(*key, F.col("event_id").alias("_event"), F.col("is_canonical").alias("_canonical")), key, "left")
    minted = F.concat(F.lit("event-"), F.substring(F.sha2(F.concat_ws(":", "source_key", "source_event_id"), 256), 1, 24))
    rows = rows.withColumn("event_id", F.coalesce("_event", minted)).withColumn("_times", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    last = first_per_key(rows, key, [F.desc("ordinal")]).drop("place")

    # a listing is updated by its canonical link; one created here by the record that created it
    own = last.filter("_event IS NULL OR _canonical").select(F.col("event_id").alias("id"), "source_key", "source_event_id", *[F.col(c).alias(f"_{c}") for c in _FIELDS])
    own = first_per_key(own, ["id"], [F.desc("source_event_id")]).drop("place")
    both = events.join(own, "id", "full")
    stored = F.col("slug").isNotNull()
    values: dict[str, Column] = {}
    for c in _FIELDS:
        value = F.when(F.col("source_key").isNotNull(), F.col("_venue_id")).otherwise(F.col(c)) if c == "venue_id" else F.coalesce(f"_{c}", c)
        values[c] = F.when(stored, unless_locked("locked", _LOCKS[c], F.col(c), value)).otherwise(value) if c in _LOCKS else value
    values["normalized_title"] = normalize_name(values["title"])
    values["slug"] = F.coalesce("slug", slugify(F.col("_title"), F.concat_ws(":", "source_key", "source_event_id")))
    values["locked"] = F.coalesce("locked", F.array().cast("array<string>"))
    new_events = both.select(*[values.get(c, F.col(c)).alias(c) for c in events.columns])

    seen = last.select(*key, F.col("event_id").alias("_to"))
    all_links = links.join(seen, key, "full")
    stamp = F.lit(as_of).cast(links.schema["last_seen_at"].dataType)
    changed = {"event_id": F.coalesce("event_id", "_to"), "is_canonical": F.coalesce("is_canonical", F.lit(True)), "last_seen_at": F.when(F.col("_to").isNotNull(), stamp).otherwise(F.col("last_seen_at"))}
    new_links = all_links.select(*[changed.get(c, F.col(c)).alias(c) for c in links.columns])

    locked = events.filter(F.array_contains("locked", "time")).select(F.col("id").alias("event_id"))
    timed = rows.join(locked, "event_id", "left_anti")
    fresh = first_per_key(timed.select("event_id", "start_at", "end_at", "status", "source_id", "ordinal"), ["event_id", "start_at"], [F.desc("ordinal"), F.desc("source_id")]).select(*instances.columns)
    single = timed.filter("_times = 1").groupBy("event_id", "source_id").agg(F.collect_set("start_at").alias("_kept"))
    kept = instances.join(fresh.select("event_id", "start_at"), ["event_id", "start_at"], "left_anti").join(single, ["event_id", "source_id"], "left").filter("_kept IS NULL OR array_contains(_kept, start_at)")
    return new_events, new_links, kept.select(*instances.columns).unionByName(fresh)


def retained(events: DataFrame, instances: DataFrame, children: dict[str, DataFrame], payloads: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame, dict[str, DataFrame], DataFrame]:
    """What stays after retention: recent instances; listings that have one, and their rows in ``children`` (event_id); and
    payloads (source_id, source_event_id, extracted_at) that are the newest of their id or recent."""
    now = F.lit(as_of).cast("timestamp_ntz")
    recent = instances.filter(F.col("start_at") >= now - F.expr(f"INTERVAL {INSTANCE_DAYS} DAYS"))
    live = events.join(recent.select(F.col("event_id").alias("id")), "id", "left_semi")
    ids = live.select(F.col("id").alias("event_id"))
    newest = F.max("extracted_at").over(Window.partitionBy("source_id", "source_event_id"))
    kept = payloads.withColumn("_newest", newest).filter((F.col("extracted_at") == F.col("_newest")) | (F.col("extracted_at") >= now - F.expr(f"INTERVAL {PAYLOAD_DAYS} DAYS"))).drop("_newest")
    return live, recent, {k: v.join(ids, "event_id", "left_semi") for k, v in children.items()}, kept


def without_source(instances: DataFrame, gone: DataFrame) -> DataFrame:
    """Instances of removed sources (source_id) stay, without their source."""
    marked = instances.join(gone.select("source_id", F.lit(True).alias("_gone")), "source_id", "left")
    return marked.withColumn("source_id", F.when(F.col("_gone").isNull(), F.col("source_id"))).select(*instances.columns)


def guarded_update(stored: DataFrame, changes: DataFrame, key: str, guard: Column) -> tuple[DataFrame, DataFrame]:
    """``stored`` with ``changes`` (key and new values; one row a key) where ``guard`` of the stored row holds, and (key) of
    the rows that changed."""
    fields = [c for c in changes.columns if c != key]
    hit = stored.filter(guard).select(key).join(changes, key)
    new = hit.select(key, *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_hit"))
    rows = stored.join(new, key, "left")
    return rows.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in stored.columns]), hit.select(key)


def edited(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``old`` after an edit to ``new`` (key, fields), each changed field locked; and (key, field, old, new) of each change.

    Rows that only one side has are no edits: ``added_removed`` of the mutations module lists them.
    """
    from almanac.operators.mutations import field_diffs

    diffs = field_diffs(old, new, key, fields)
    locks = diffs.groupBy(key).agg(F.array_sort(F.collect_set("field")).alias("_changed"))
    values = new.select(key, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_edit"))
    rows = old.join(values, key, "left").join(locks, key, "left")
    changed: dict[str, Column] = {f: F.when(F.col("_edit"), F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}
    changed["locked"] = F.when(F.col("_changed").isNull(), F.col("locked")).otherwise(F.array_sort(F.array_union("locked", "_changed")))
    return rows.select(*[changed.get(c, F.col(c)).alias(c) for c in old.columns]), diffs


def unlocked(events: DataFrame, wanted: DataFrame) -> DataFrame:
    """``events`` without the locks that ``wanted`` (id, field) names."""
    gone = wanted.groupBy("id").agg(F.collect_set("field").alias("_gone"))
    rows = events.join(gone, "id", "left")
    return rows.withColumn("locked", F.when(F.col("_gone").isNull(), F.col("locked")).otherwise(F.array_except("locked", "_gone"))).select(*events.columns)


def retimed(instances: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``instances`` after ``moves`` (event_id, start_at, new_start), and the moves that were refused.

    A move onto a start that the listing already has, or onto another move's, is refused.
    """
    at = ["event_id", "start_at"]
    twice = F.count(F.lit(1)).over(Window.partitionBy("event_id", "new_start"))
    there = instances.select("event_id", F.col("start_at").alias("new_start"), F.lit(True).alias("_there"))
    ruled = moves.join(instances.select(*at), at, "left_semi").withColumn("_n", twice).join(there, ["event_id", "new_start"], "left")
    refused = ruled.filter("_there OR _n > 1").select(*moves.columns)
    good = ruled.filter("_there IS NULL AND _n = 1").select(*at, "new_start")
    rows = instances.join(good, at, "left").withColumn("start_at", F.coalesce("new_start", "start_at"))
    return rows.select(*instances.columns), refused


def suggested_titles(events: DataFrame, answers: DataFrame) -> DataFrame:
    """``events`` after ``answers`` (id, apply) to their title_suggestion: applied ones become locked titles, all are cleared."""
    rows = events.join(answers.select("id", F.col("apply").alias("_apply")), "id", "left")
    take = F.coalesce(F.col("_apply"), F.lit(False)) & F.col("title_suggestion").isNotNull()
    title = F.when(take, F.col("title_suggestion")).otherwise(F.col("title"))
    changed = {
        "title": title,
        "normalized_title": normalize_name(title),
        "locked": F.when(take, F.array_sort(F.array_union("locked", F.array(F.lit("title"))))).otherwise(F.col("locked")),
        "title_suggestion": F.when(F.col("_apply").isNull(), F.col("title_suggestion")),
    }
    return rows.select(*[changed.get(c, F.col(c)).alias(c) for c in events.columns])


def picks_after(picks: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``picks`` (id, week_of, sort_order, ...) after ``changes`` (the same columns, and action: put or remove), and those refused.

    A week begins on a Monday: another day is refused.
    """
    wrong = (F.col("action") == "put") & (F.coalesce(F.dayofweek("week_of"), F.lit(0)) != MONDAY)
    good = changes.filter(~wrong)
    put = good.filter("action = 'put'").select(*picks.columns)
    return picks.join(good.select("id"), "id", "left_anti").unionByName(put), changes.filter(wrong)


def pruned(attempts: DataFrame, as_of: datetime, rows: int = PRUNE_ROWS) -> DataFrame:
    """``attempts`` (id, created_at) without the oldest ``rows`` of those past their time."""
    old = attempts.filter(F.col("created_at") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {PRUNE_HOURS} HOURS"))
    return attempts.join(old.orderBy("created_at", "id").limit(rows).select("id"), "id", "left_anti")


def stuck_claims(reviews: DataFrame, as_of: datetime) -> DataFrame:
    """Reviews that were approved more than a quarter of an hour ago and are still there."""
    return reviews.filter((F.col("status") == "approved") & (F.col("resolved_at") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {CLAIM_MINUTES} MINUTES")))


def source_health(sources: DataFrame, runs: DataFrame, as_of: datetime) -> DataFrame:
    """``sources`` (id, status, error, failures, fetched, published, skipped, attempted_at, fetched_at) after ``runs`` (id,
    fetched, published, skipped, error), one a source.

    A run fails by an error, which keeps the counts, or when it published nothing of what it fetched.
    """
    new = runs.select("id", *[F.col(c).alias(f"_{c}") for c in ("fetched", "published", "skipped", "error")], F.lit(True).alias("_run"))
    rows = sources.join(new, "id", "left")
    crashed = F.col("_error").isNotNull()
    none = (F.col("_fetched") > 0) & (F.col("_published") == 0)
    failed = crashed | F.coalesce(none, F.lit(False))
    ran = lambda value, c: F.when(F.col("_run"), value).otherwise(F.col(c))
    stamp = F.lit(as_of).cast(sources.schema["attempted_at"].dataType)
    count = lambda c: F.when(F.col("_run") & ~crashed, F.col(f"_{c}")).otherwise(F.col(c))
    changed = {
        "status": ran(F.when(failed, "failing").otherwise("ok"), "status"),
        "error": ran(F.when(crashed, F.col("_error")).when(failed, "nothing of what was fetched could be used"), "error"),
        "failures": ran(F.when(failed, F.col("failures") + 1).otherwise(0), "failures"),
        **{c: count(c) for c in ("fetched", "published", "skipped")},
        "attempted_at": ran(stamp, "attempted_at"),
        "fetched_at": F.when(F.col("_run") & ~failed, stamp).otherwise(F.col("fetched_at")),
    }
    return rows.select(*[changed.get(c, F.col(c)).alias(c) for c in sources.columns])


def due_sources(sources: DataFrame, cadence: str, as_of: datetime) -> DataFrame:
    """Sources (config, failures, attempted_at) to fetch: those of the cadence (weekly runs take all) that do not back off."""
    from almanac.functions.scoring import backoff_hours

    own = F.coalesce(F.get_json_object("config", "$.cadence"), F.lit("daily"))
    daily = F.when(own == "weekly", "weekly").otherwise("daily") == "daily"
    wait = F.timestamp_micros((backoff_hours(F.col("failures")) * 3_600_000_000).cast("long") + F.unix_micros(F.col("attempted_at").cast("timestamp")))
    waits = (F.col("failures") >= 3) & F.coalesce(wait > F.lit(as_of).cast("timestamp"), F.lit(False))
    return sources.filter(~waits & (F.lit(cadence == "weekly") | daily))
