"""Pairs made without shuffling them: against plain loops, in small cells and lists."""

import random
import re
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from almanac.functions.text import text_grams
from almanac.operators import core, merging, search, venues

AS_OF = datetime(2026, 7, 8, 12)


def _like(x, y):
    a, b = set(text_grams(x)), set(text_grams(y))
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(6)
    titles = ["jazz night", "jazz nights", "night of jazz", "blues brunch", "blues"]
    events = [(i, r.choice(titles), r.choice([None, 0, 1, 2]), r.choice([None, "u", "v"])) for i in range(60)]
    # some start on several days, some twice a day, some at midnight in Chicago
    hours = [0, 1, 2, 26, 27, 50]
    instances = list({(r.randrange(60), datetime(2026, 7, 9, 5) + timedelta(hours=r.choice(hours))) for _ in range(220)})
    links = [(i, r.randrange(4)) for i in range(58) for _ in range(2)]
    venues = [(0, "red hall"), (1, "red halls"), (2, None)]
    reviews = [tuple(sorted(r.sample(range(60), 2))) for _ in range(200)]
    shapes = ("id long, normalized_title string, venue_id long, canonical_url string", "event_id long, start_at timestamp_ntz", "event_id long, source_id long", "id long, normalized_name string", "event_a long, event_b long")
    rows = (events, instances, links, venues, reviews)
    return rows, [spark.createDataFrame(x, s) for x, s in zip(rows, shapes)]


def _wanted(events, instances, links, venues, reviews):
    of, names, sources = {e[0]: e for e in events}, dict(venues), {}
    for e, s in links:
        sources.setdefault(e, set()).add(s)
    met = {}
    for a, at in instances:
        for b, to in instances:
            local = at - timedelta(hours=5), to - timedelta(hours=5)
            if a < b and local[0].date() == local[1].date():
                known = all(x.hour for x in local)
                met.setdefault((a, b), []).append(abs((at - to).total_seconds()) / 60 if known else None)
    for (a, b), minutes in met.items():
        (_, ta, va, ua), (_, tb, vb, ub) = of[a], of[b]
        if _like(ta, tb) < 0.3 or sources.get(a, set()) & sources.get(b, set()) or (a, b) in reviews:
            continue
        affinity = 1.0 if va is not None and va == vb else _like(names[va], names[vb]) if names.get(va) and names.get(vb) else 0.5
        yield a, b, round(_like(ta, tb), 6), round(affinity, 6), min((m for m in minutes if m is not None), default=None), ua is not None and ua == ub


@pytest.mark.parametrize("cell, names", [(7, 512), (4096, 1)])
def test_candidates_equal_the_loop(spark, tables, monkeypatch, cell, names):
    monkeypatch.setattr(merging, "CELL", cell)
    monkeypatch.setattr(merging, "VENUE_NAMES", names)
    rows, frames = tables
    found = merging.candidates(*frames, AS_OF, 6)
    got = [(x.a, x.b, x.title_similarity, x.venue_affinity, x.minutes, x.url_match) for x in found.collect()]
    want = sorted(_wanted(*rows), key=str)
    assert len(want) > 200 and sorted(got, key=str) == want


def test_candidates_shuffle_only_pairs_that_may_meet_again(spark, tables, monkeypatch):
    monkeypatch.setattr(merging, "CELL", 7)
    plan = merging.candidates(*tables[1], AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(a#\d+L?, b#", plan)) <= 2 and "hashpartitioning(b#" not in plan


def test_queued_pairs_are_decided_beside_the_loop(spark, monkeypatch):
    """A queued pair is kept up to the merge that absorbs an end of it, and is in no group that the loop takes."""
    seen = []
    monkeypatch.setattr(merging, "linked_groups", lambda pairs, f=merging.linked_groups: seen.append(pairs.count()) or f(pairs))
    pairs = spark.createDataFrame([(1, 2, 0.9, "queue"), (1, 2, 0.8, "merge"), (2, 3, 0.7, "queue"), (1, 3, 0.6, "queue"), (4, 1, 0.5, "queue")], "a long, b long, score double, kind string")
    state = spark.createDataFrame([(i, i, 1, "k", False) for i in (1, 2, 3)], "id long, created_at long, rank int, key string, owned boolean")
    got = {(x.a, x.b, x.score, x.kind, x.survivor, x.absorbed) for x in merging.decide(pairs, state).collect()}
    assert got == {(1, 2, 0.9, "queue", None, None), (1, 2, 0.8, "merge", 1, 2), (1, 3, 0.6, "queue", None, None)}
    assert seen == [1]


def test_similar_pairs_by_lists(spark, monkeypatch):
    """Keys of one text in lists of three: each pair once, and the similarity rounded once for each pair of texts."""
    monkeypatch.setattr(core, "LIST", 3)
    r = random.Random(9)
    rows = [(i, r.choice(["red ring", "red rings", "old bolt", ""]), r.choice("xyz")) for i in range(80)]
    found = core.similar_pairs(spark.createDataFrame(rows, "id long, t string, k string"), "id", "t", "k", 0.3, digits=6)
    want = sorted((a, b, round(_like(s, t), 6)) for a, s, k in rows for b, t, m in rows if a < b and k == m and s and t and _like(s, t) >= 0.3)
    assert len(want) > 100 and sorted((x.a, x.b, x.similarity) for x in found.collect()) == want


def test_venue_pairs_by_lists(spark, monkeypatch):
    """Venues of one address and name are in lists: names are compared once for them, and null names and entries count."""
    monkeypatch.setattr(core, "LIST", 2)
    compared = []
    monkeypatch.setattr(venues, "trigram_similarity", lambda a, b: compared.append((a, b)) or F.lit(0.5))
    r = random.Random(3)
    rows = [(i, r.choice(["red hall", "old hall", None]), r.choice(["1 n Oak st", "1 s oak rd", "2 n elm st", "oak st", None]), r.choice([None, "r1", "r2"])) for i in range(60)]
    frame = spark.createDataFrame(rows, "id long, normalized_name string, address string, registry_id string")
    suggestions, aliases = spark.createDataFrame([(5, 3), (8, 9)], "keep_id long, absorb_id long"), spark.createDataFrame([("blue hall",)], "normalized_name string")
    got = sorted((x.a, x.b) for x in venues.address_pairs(frame, suggestions, aliases).collect())
    place = {i: (t.split()[0], t.split()[2].lower()) for i, _, t, _ in rows if t and t[0].isdigit()}
    entry = {i: e for i, _, _, e in rows}
    want = sorted((a, b) for a in place for b in place if a < b and place[a] == place[b] and (entry[a] == entry[b] or None in (entry[a], entry[b])) and (a, b) not in ((3, 5), (8, 9)))
    assert len(want) > 50 and got == want and "normalized_name_x" in str(compared)


def test_registry_matches_take_five_entries_of_a_name(spark):
    """A venue meets the five best entries of its name, not all that have a similar one."""
    registry = spark.createDataFrame([(f"{i:03}", "Red Hall" if i % 2 else "red halls", "9 main st", None, None) for i in range(40)], "id string, name string, address string, lon double, lat double")
    places = spark.createDataFrame([(i, "red hall" if i % 3 else "red halls", "1 main st") for i in range(30)], "id long, normalized_name string, address string")
    found = venues.registry_matches(places, registry)
    got = {x.id: (x.registry_id, x.similarity) for x in found.collect()}
    assert got == {i: ("001" if i % 3 else "000", 1.0) for i in range(30)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"row_number\(\) windowspecdefinition\((\w+)#", plan)
    assert {"ta", "tb"} <= set(windows) and "id" not in windows  # none is of a venue


def test_page_headings_keep_entities(spark, tmp_path):
    from almanac.plans import queries

    pages = [(1, "<h1 class=x> A &quot;B&quot; &amp; C&amp</h1>"), (2, "<h1><b>x</b></h1><h1>y</h1>"), (3, "<p>none</p>"), (4, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {x.page_id: x.heading for x in queries.queries()["page_headings"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == dict(con.execute(queries.oracle_sql()["page_headings"]).fetchall())


def test_seen_pairs_need_no_anti_join(spark, tmp_path, monkeypatch):
    from almanac.plans import queries

    monkeypatch.setattr(core, "LIST", 3)
    r = random.Random(5)
    spark.createDataFrame([(i, r.choice("ab"), r.choice(["x", "y", None])) for i in range(60)], "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    found = queries.queries()["anti_either_orientation"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["anti_either_orientation"]).fetchall()
    assert len(want) > 100 and sorted(tuple(x) for x in found.collect()) == sorted(want)
    assert "Anti" not in found._jdf.queryExecution().executedPlan().toString()


def test_ladder_meets_the_next_rows_only(spark):
    """As the first five of all pairs, also where a text's rows lie before those of a similar one."""
    r = random.Random(7)
    rows = [(i, r.choice(["red ring", "ring red", "red rings", "old bolt", "red rind"] if i < 50 else ["red ring", "old bolt"]), r.choice("xy")) for i in range(90)]
    found = search.next_similar(spark.createDataFrame(rows, "id long, t string, k string"), "id", "t", "k", 0.4, 5)
    want = []
    for a, s, k in rows:
        after = sorted((-_like(s, t), b) for b, t, m in rows if a < b and k == m and _like(s, t) >= 0.4)
        want += [(a, b, round(-x, 9)) for x, b in after[:5]]
    assert len(want) > 200 and sorted((x.a, x.b, round(x.similarity, 9)) for x in found.collect()) == sorted(want)
