"""Queries of the relational operators over the driver's tables, each with SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanac.functions import scoring, text, timefn
from almanac.operators import core

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_GRAMS = r"""list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''),
    lambda w: list_transform(range(1, len(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"""


@_query(
    f"""WITH g AS (SELECT p_partkey, p_brand, p_name, {_GRAMS.format('p_name')} AS g FROM part),
    s AS (SELECT a.p_partkey AS a, b.p_partkey AS b, len(list_intersect(a.g, b.g)) AS i, len(a.g) AS na, len(b.g) AS nb
      FROM g a JOIN g b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey)
    SELECT a, b, round(i::DOUBLE / (na + nb - i), 6) AS similarity FROM s WHERE i::DOUBLE / (na + nb - i) >= 0.3"""
)
def trigram_pairs_blocked(spark, sf_dir):
    return core.similar_pairs(_t(spark, sf_dir, "part"), "p_partkey", "p_name", "p_brand", 0.3, digits=6)


@_query("""SELECT o_custkey AS custkey, min(o_orderdate) AS next_start, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY o_custkey""")
def min_start_per_key(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return rows.groupBy(F.col("o_custkey").alias("custkey")).agg(F.min("o_orderdate").alias("next_start"), F.count(F.lit(1)).alias("n"))


@_query("""SELECT n_name AS neighborhood, count(DISTINCT c_custkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def neighborhood_distinct_counts(spark, sf_dir):
    buyers = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    counts = buyers.groupBy("c_nationkey").agg(F.count_distinct("c_custkey").alias("n"))
    return counts.join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("neighborhood"), "n")


@_query("""SELECT n_name AS name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name""")
def dim_counts_left(spark, sf_dir):
    counts = _t(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    rows = _t(spark, sf_dir, "nation").join(counts, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return rows.select(F.col("n_name").alias("name"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@_query("""SELECT n_name AS name, count(DISTINCT s_suppkey) AS suppliers, count(DISTINCT c_custkey) AS customers FROM nation
    LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name""")
def dual_distinct_fanout(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count_distinct("s_suppkey").alias("suppliers"))
    c = _t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count_distinct("c_custkey").alias("customers"))
    rows = _t(spark, sf_dir, "nation").join(s, "n_nationkey", "left").join(c, "n_nationkey", "left")
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias(x)
    return rows.select(F.col("n_name").alias("name"), zero("suppliers"), zero("customers"))


@_query("""SELECT p_name AS name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1""")
def dup_groups_having(spark, sf_dir):
    return _t(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@_query("""SELECT c.c_custkey AS custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P' AND o.o_totalprice > 200000)""")
def orphan_anti(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'P' AND o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, sf_dir, "customer").join(orders, "c_custkey", "left_anti").select(F.col("c_custkey").alias("custkey"))


@_query("""SELECT event_id FROM events e WHERE EXISTS (SELECT 1 FROM events n WHERE n.user_id = e.user_id AND n.event_type = e.event_type AND n.ts > e.ts)""")
def superseded_semi(spark, sf_dir):
    newest = F.max("ts").over(Window.partitionBy("user_id", "event_type"))
    return _t(spark, sf_dir, "events").withColumn("newest", newest).filter("newest > ts").select("event_id")


@_query("""SELECT DISTINCT CAST(timezone('America/Chicago', timezone('UTC', ts)) AS DATE) AS day FROM events""")
def distinct_days(spark, sf_dir):
    return _t(spark, sf_dir, "events").select(timefn.local_day(F.col("ts")).alias("day")).distinct()


@_query("""SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type""")
def percentile_nearest_rank(spark, sf_dir):
    return core.nearest_rank(_t(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


@_query("""SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders) WHERE place <= 3""")
def top3_per_key(spark, sf_dir):
    rows = core.first_per_key(_t(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")], 3)
    return rows.select("o_custkey", "o_orderkey", F.col("place").cast("long").alias("place"))


@_query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING) AS n FROM events""")
def trailing_60m_throttle(spark, sf_dir):
    return core.trailing_count(_t(spark, sf_dir, "events"), "user_id", "ts", 60, "n").select("event_id", "n")


@_query("""SELECT * FROM (SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 60) WHERE o_orderpriority = '1-URGENT'""")
def limit_then_filter(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority").orderBy("o_orderdate", "o_orderkey").limit(60)
    return rows.filter("o_orderpriority = '1-URGENT'")


@_query("""SELECT event_id, h >= 5 AND h < 12 AS morning, CASE WHEN h >= 5 AND h < 12 THEN 'morning' WHEN h >= 12 AND h < 17 THEN 'afternoon' WHEN h >= 17 AND h < 21 THEN 'evening' WHEN h >= 21 OR h < 3 THEN 'night' END AS tod
    FROM (SELECT event_id, hour(timezone('America/Chicago', timezone('UTC', ts))) AS h FROM events)""")
def time_of_day_bucket(spark, sf_dir):
    tod = timefn.time_of_day(F.col("ts"))
    return _t(spark, sf_dir, "events").select("event_id", F.coalesce(tod == "morning", F.lit(False)).alias("morning"), tod.alias("tod"))


@_query("""SELECT event_id, CAST(date_trunc('week', timezone('America/Chicago', timezone('UTC', ts))) AS DATE) AS monday FROM events""")
def week_monday(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", timefn.week_monday(F.col("ts")).alias("monday"))


@_query("""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
    d AS (SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 9) AS distance FROM embeddings, q)
    SELECT vec_id, distance, row_number() OVER (ORDER BY distance, vec_id) AS place FROM d ORDER BY place LIMIT 50""")
def vector_top50(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    query = rows.filter("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)  # one stated query vector
    near = rows.join(F.broadcast(query)).select("vec_id", F.round(scoring.cosine_distance(F.col("embedding"), F.col("q")), 9).alias("distance"))
    near = near.orderBy(F.asc_nulls_last("distance"), "vec_id").limit(50)
    return near.select("vec_id", "distance", F.row_number().over(Window.orderBy(F.asc_nulls_last("distance"), "vec_id")).cast("long").alias("place"))


@_query("""WITH a AS (SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS r FROM events ORDER BY r LIMIT 50),
    b AS (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS r FROM events ORDER BY r LIMIT 50)
    SELECT coalesce(a.event_id, b.event_id) AS event_id, round(coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0), 9) AS score FROM a FULL JOIN b ON a.event_id = b.event_id""")
def rrf_fuse(spark, sf_dir):
    rows = _t(spark, sf_dir, "events")

    def leg(order):
        top = rows.orderBy(order, "event_id").limit(50)
        return top.select("event_id", F.row_number().over(Window.orderBy(order, "event_id")).alias("rank"))

    fused = core.reciprocal_rank_fusion([leg(F.desc("value")), leg(F.desc("ts"))], "event_id")
    return fused.select("event_id", F.round("score", 9).alias("score"))


@_query(r"""SELECT p_partkey, regexp_replace(substring(replace(trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ', '-'), 1, 60), '^-+|-+$', '', 'g')
    || '-' || substring(sha256(p_partkey::VARCHAR), 1, 8) AS slug FROM part""")
def slugify(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", text.slugify(F.col("p_name"), F.col("p_partkey").cast("string")).alias("slug"))


@_query("""SELECT doc_id, sha256(source || chr(10) || coalesce(text, '<none>')) AS fingerprint FROM documents""")
def content_fingerprint(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.content_fingerprint(F.col("source"), F.col("text")).alias("fingerprint"))


@_query("""SELECT s_suppkey, f AS failures, CASE WHEN f < 3 THEN 0.0::DOUBLE ELSE least(24.0::DOUBLE * power(2.0::DOUBLE, f - 3), 168.0::DOUBLE) END AS hours FROM (SELECT s_suppkey, s_suppkey % 9 AS f FROM supplier)""")
def backoff_due(spark, sf_dir):
    rows = _t(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 9).alias("failures"))
    return rows.select("s_suppkey", "failures", scoring.backoff_hours(F.col("failures")).alias("hours"))


@_query("""SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2""")
def json_flatten(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return _t(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@_query("""SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, count(*) AS turns FROM conversations GROUP BY conv_id""")
def nested_relation(spark, sf_dir):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    rows = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t"), F.count(F.lit(1)).alias("turns"))
    return rows.select("conv_id", F.concat_ws(">", F.col("t.role")).alias("roles"), "turns")


@_query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS place FROM documents) WHERE place = 1""")
def dedupe_keep_first(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@_query("""WITH s AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0),
    n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'X' END AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 1)
    SELECT coalesce(n.o_orderkey, s.o_orderkey) AS o_orderkey, coalesce(n.o_orderstatus, s.o_orderstatus) AS o_orderstatus, coalesce(n.o_totalprice, s.o_totalprice) AS o_totalprice
    FROM n FULL JOIN s ON n.o_orderkey = s.o_orderkey""")
def upsert_merge(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    stored, new = rows.filter("o_orderkey % 3 <> 0"), rows.filter("o_orderkey % 3 <> 1")
    new = new.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return core.upsert(stored, new, ["o_orderkey"])


@_query("""SELECT o_orderkey, CAST(d AS DATE) AS day FROM (SELECT o_orderkey, unnest(range(CAST(o_orderdate AS DATE)::TIMESTAMP, CAST(o_orderdate AS DATE)::TIMESTAMP + INTERVAL 1 DAY * (1 + o_orderkey % 4), INTERVAL 1 DAY)) AS d FROM orders)""")
def day_range_expand(spark, sf_dir):
    first = F.to_date("o_orderdate")
    last = F.date_add(first, (F.col("o_orderkey") % 4).cast("int"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.sequence(first, last)).alias("day"))


@_query("""SELECT quality, toxic, count(*) AS n, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS clean FROM labels GROUP BY quality, toxic""")
def judge_counts(spark, sf_dir):
    return _t(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("quality = 1 AND toxic = 0")).alias("clean"))


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)
