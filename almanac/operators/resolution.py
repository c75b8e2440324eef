"""Entity resolution: pairs of one local day, exclusions, and greedy merging in score order."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions import timefn
from almanac.operators.lineage import cut
from almanac.operators.ordered import ordinals, running


def same_day_pairs(rows: DataFrame, key: str, ts: str, block: Sequence[str], most: float) -> DataFrame:
    """(a, b, minutes apart) of rows that share ``block`` and the local day and lie ``most`` minutes apart at most; a < b.

    A band join: time is cut in buckets of ``most`` minutes, and each row meets its own and the next bucket's only. So
    a block's rows meet as many as lie within twice the band, however many the block has, and no task has a whole block.
    """
    width = max(1, int(most * 60_000_000))
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    base = rows.select(*block, timefn.local_day(F.col(ts)).alias("_day"), F.col(key).alias("_id"), at.alias("_at"), F.floor(at / width).alias("_own"))
    early = base.withColumnsRenamed({"_id": "_i", "_at": "_from"}).withColumn("_bucket", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    late = base.select(*block, "_day", F.col("_own").alias("_bucket"), F.col("_id").alias("_j"), F.col("_at").alias("_to"))
    after = (F.col("_from") < F.col("_to")) | ((F.col("_from") == F.col("_to")) & (F.col("_i") < F.col("_j")))
    pairs = early.join(late, [*block, "_day", "_bucket"]).filter(after & (F.col("_to") - F.col("_from") <= width))
    pairs = pairs.filter("_i <> _j")
    return pairs.select(*block, F.least("_i", "_j").alias("a"), F.greatest("_i", "_j").alias("b"), ((F.col("_to") - F.col("_from")) / 60_000_000.0).alias("minutes"))


def without_shared_source(pairs: DataFrame, links: DataFrame, item: str, source: str) -> DataFrame:
    """Pairs (a, b) whose ends no source links both to. Only sources of the pairs' own ends are joined."""
    of = lambda c: links.select(F.col(item).alias(c), F.col(source).alias("_source"))
    shared = pairs.join(of("a"), "a").join(of("b"), ["b", "_source"]).select("a", "b").distinct()
    return pairs.join(shared, ["a", "b"], "left_anti")


def without_reviewed(pairs: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Pairs (a, b) not in ``reviewed`` (x, y) in either order: one equi anti join on the ordered pair."""
    seen = reviewed.select(F.least("x", "y").alias("_lo"), F.greatest("x", "y").alias("_hi"))
    return pairs.join(seen, (F.least("a", "b") == F.col("_lo")) & (F.greatest("a", "b") == F.col("_hi")), "left_anti")


def nearest_delta(rows: DataFrame, keys: Sequence[str], ts: str, one: Column, other: Column) -> DataFrame:
    """Per key, the fewest minutes between a row of ``one`` and a row of ``other``, by neighbours in time, not pairs.

    Of the nearest two, the later has the earlier as the last of its kind before it. A key's rows lie in many ranges of
    time, and each range gets the last of both kinds of those before it.
    """
    marked = rows.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"), one.alias("_one"), other.alias("_other"))
    last = {"_last_one": F.when(F.col("_one"), F.col("_at")), "_last_other": F.when(F.col("_other"), F.col("_at"))}
    seen = running(marked.filter("_at IS NOT NULL AND (_one OR _other)"), keys, [F.col("_at").asc()], last, "max")
    gap = F.least(F.when(F.col("_one"), F.col("_at") - F.col("_last_other")), F.when(F.col("_other"), F.col("_at") - F.col("_last_one")))
    near = seen.withColumn("_gap", gap).filter("_gap IS NOT NULL")
    return near.groupBy(*keys).agg((F.min("_gap") / 60_000_000.0).alias("minutes"))


def linked_groups(pairs: DataFrame) -> DataFrame:
    """(node, component) for the ends of ``pairs`` (a, b); a component is named by its smallest node.

    Labels fall to the smallest of a node's neighbours, then to their label's own label, so that chains take a
    logarithmic number of rounds.
    """
    edges = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "node"))
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_near"))
        lower = labels.join(near, "node").select("node", F.least("component", "_near").alias("_c"), F.col("component").alias("_old"))
        jump = labels.select(F.col("node").alias("_c"), F.col("component").alias("_up"))
        moved = cut(lower.join(jump, "_c", "left").select("node", F.least("_c", F.coalesce("_up", "_c")).alias("component"), "_old"))
        labels = moved.select("node", "component")
        if not moved.filter("component <> _old").limit(1).count():
            return labels


#: Groups of linked pairs up to this many are merged in one task each; larger ones in rounds over whole tables.
GROUP_PAIRS = 1_000_000


def greedy_merge(pairs: DataFrame) -> DataFrame:
    """(survivor, absorbed) as if ``pairs`` (a, b, score) were taken by score descending, then a, then b.

    ``a`` survives and ``b`` is absorbed, unless an earlier merge absorbed either. Pairs that no chain links do not
    matter to each other: each linked group is taken through the loop on its own.
    """
    pairs = cut(pairs.select("a", "b", "score").distinct())
    named = pairs.join(linked_groups(pairs).withColumnRenamed("node", "a"), "a")
    sizes = named.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    named = cut(named.join(sizes, "component"))

    def loop(rows: pd.DataFrame) -> pd.DataFrame:
        gone, out = set(), []
        for x in rows.sort_values(["score", "a", "b"], ascending=[False, True, True]).itertuples(index=False):
            if x.a not in gone and x.b not in gone:
                gone.add(x.b)
                out.append((x.a, x.b))
        return pd.DataFrame(out, columns=["survivor", "absorbed"])

    kind = pairs.schema["a"].dataType.simpleString()
    found = named.filter(F.col("_n") <= GROUP_PAIRS).groupBy("component").applyInPandas(loop, f"survivor {kind}, absorbed {kind}")
    large = named.filter(F.col("_n") > GROUP_PAIRS)
    return found.unionByName(_merge_rounds(large)) if large.limit(1).count() else found


def _settled(state: DataFrame) -> DataFrame:
    """``state`` (n, u, su, v, sv, x) with x where its terms give it; two equal terms become one."""
    true = (F.col("u").isNull() & F.col("su")) | (F.col("v").isNull() & F.col("sv"))
    none = F.col("u").isNull() & F.col("v").isNull()
    same = F.coalesce(F.col("u") == F.col("v"), F.lit(False))
    x = F.coalesce("x", F.when(true, True).when(none, False).when(same & (F.col("su") != F.col("sv")), True))
    twice = same & (F.col("su") == F.col("sv"))
    return state.select("n", "u", "su", F.when(~twice, F.col("v")).alias("v"), (F.col("sv") & ~twice).alias("sv"), x.alias("x"))


def _merge_rounds(pairs: DataFrame) -> DataFrame:
    """As ``greedy_merge`` for groups of any size.

    A node is gone once a pair that absorbs it is taken. Whether it is gone after such a pair is ``gone before OR NOT the
    other end gone before``: a formula over at most two earlier pairs. Formulas of one pair are links, and are followed by
    doubling, so chains of any length take a logarithm of rounds; those of two are settled once one of them decides
    it. No node's pairs are gathered: the last pair before each is a running maximum over ranges.
    """
    ranked = ordinals(pairs.select("a", "b", "score"), [], [F.desc("score"), F.asc("a"), F.asc("b")], "n")
    ranked = cut(ranked)
    # at an end, the pair asks at 2 n who absorbed it before, and at 2 n + 1 it may absorb b itself
    ask = lambda end: ranked.select(F.col(end).alias("_node"), (2 * F.col("n")).alias("_at"), F.lit(None).cast("long").alias("_by"), "n", F.lit(end).alias("_end"))
    does = ranked.select(F.col("b").alias("_node"), (2 * F.col("n") + 1).alias("_at"), F.col("n").alias("_by"), "n", F.lit("").alias("_end"))
    seen = running(ask("a").unionByName(ask("b")).unionByName(does), ["_node"], [F.asc("_at")], {"_last": F.col("_by")}, "max").filter("_end <> ''")
    of = lambda end: seen.filter(F.col("_end") == end).select("n", F.col("_last").alias(f"_{end}"))
    links = cut(ranked.select("n").join(of("a"), "n").join(of("b"), "n"))  # n, _a, _b: the pairs that may have absorbed its ends
    # x of a pair, whether b is gone after it, is one of two terms (t, s): x of pair t equals s; without t, s itself
    state = links.select("n", F.col("_b").alias("u"), F.col("_b").isNotNull().alias("su"), F.col("_a").alias("v"), F.col("_a").isNull().alias("sv"))
    state = cut(_settled(state.withColumn("x", F.lit(None).cast("boolean"))))
    while state.filter("x IS NULL").limit(1).count():
        only_v = F.col("u").isNull() & ~F.col("su")
        only_u = F.col("v").isNull() & ~F.col("sv")
        to, same = F.when(only_v, F.col("v")).when(only_u, F.col("u")), F.when(only_v, F.col("sv")).when(only_u, F.col("su"))
        known = state.select(F.col("n").alias("_k"), F.col("x").alias("_x"), to.alias("_to"), same.alias("_same"))
        for t in "uv":
            s = f"s{t}"
            state = state.join(known, F.col(t) == F.col("_k"), "left").withColumns({
                s: F.when(F.col(t).isNull(), F.col(s)).when(F.col("_x").isNotNull(), F.col("_x") == F.col(s)).when(F.col("_to").isNotNull(), F.col("_same") == F.col(s)).otherwise(F.col(s)),
                t: F.when(F.col("_x").isNull(), F.coalesce("_to", t)),
            }).drop("_k", "_x", "_to", "_same")
        state = cut(_settled(state))
    gone = state.select("n", "x")
    before = lambda end: gone.select(F.col("n").alias(f"_{end}"), F.col("x").alias(f"_x{end}"))
    taken = links.join(before("a"), "_a", "left").join(before("b"), "_b", "left").filter("NOT coalesce(_xa, false) AND NOT coalesce(_xb, false)")
    return ranked.join(taken.select("n"), "n").select(F.col("a").alias("survivor"), F.col("b").alias("absorbed"))
