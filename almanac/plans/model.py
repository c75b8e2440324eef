"""Tables of listings made from the driver's tables, by text that Spark and DuckDB both run."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

AS_OF = datetime(2001, 5, 15, 12, 0)
NOW = AS_OF.replace(tzinfo=timezone.utc)
STAMP = "TIMESTAMP '2001-05-15 12:00:00'"
OWNED = ("source-2", "source-3")

TABLES = {
    "sources": """SELECT r_regionkey AS id, concat('source-', r_regionkey) AS key, CASE r_regionkey WHEN 0 THEN 'api' WHEN 1 THEN 'ical' WHEN 2 THEN 'html' WHEN 3 THEN 'firecrawl' ELSE 'rss' END AS adapter_type,
        CASE r_regionkey WHEN 1 THEN 'failing' WHEN 2 THEN 'unknown' ELSE 'ok' END AS status, r_regionkey * 2 AS failures,
        concat(chr(123), '"cadence": "', CASE WHEN r_regionkey % 2 = 0 THEN 'daily' ELSE 'weekly' END, '"', chr(125)) AS config,
        TIMESTAMP '2001-05-14 12:00:00' - INTERVAL 1 DAY * r_regionkey AS attempted_at FROM {region}""",
    "venues": """SELECT s_suppkey AS id, upper(concat(p_name, CASE s_suppkey % 3 WHEN 0 THEN ' hall' WHEN 1 THEN ' theater' ELSE ' stage' END)) AS name,
        concat(p_name, CASE s_suppkey % 3 WHEN 0 THEN ' hall' WHEN 1 THEN ' theater' ELSE ' stage' END) AS normalized_name,
        CASE WHEN s_suppkey % 5 <> 0 THEN concat(s_suppkey % 6 + 1, ' n ', CASE s_suppkey % 4 WHEN 0 THEN 'Oak' WHEN 1 THEN 'oak' WHEN 2 THEN 'elm' ELSE 'main' END, ' st') END AS address,
        CASE WHEN s_suppkey % 8 <> 0 THEN concat('hood-', s_nationkey % 9) END AS neighborhood, CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_suppkey % 40 AS STRING) END AS registry_id,
        CASE WHEN s_suppkey % 3 <> 1 THEN 43 + CAST(s_suppkey AS DOUBLE) / 1000 END AS lat, CASE WHEN s_suppkey % 3 <> 2 THEN -88 + CAST(s_suppkey AS DOUBLE) / 1000 END AS lng,
        CASE WHEN s_suppkey % 3 = 0 THEN concat('v-', s_suppkey) END AS slug FROM {supplier} JOIN {part} ON p_partkey = s_suppkey""",
    "events": """SELECT p_partkey AS id, concat('l-', p_partkey) AS slug, concat(p_name, CASE p_size % 4 WHEN 0 THEN ' live' WHEN 1 THEN ' night' WHEN 2 THEN '' ELSE ' with friends' END) AS title,
        concat(p_name, CASE p_size % 4 WHEN 0 THEN ' live' WHEN 1 THEN ' night' WHEN 2 THEN '' ELSE ' with friends' END) AS normalized_title, CASE WHEN p_size % 6 <> 0 THEN p_partkey % 50 END AS venue_id,
        CASE WHEN p_size % 5 <> 0 THEN lower(p_type) END AS category, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_free, CASE WHEN p_size % 4 <> 0 THEN p_retailprice END AS price_min,
        p_size % 11 = 0 AS is_station, CASE WHEN p_size % 7 <> 0 THEN concat('https://x/', p_partkey % 40) END AS canonical_url, CASE WHEN p_size % 4 = 1 THEN concat('about ', p_name) END AS description,
        p_partkey % 17 AS created_at, split(CASE p_size % 9 WHEN 0 THEN 'time' WHEN 1 THEN 'venue,title' ELSE 'status' END, ',') AS locked, split(concat(lower(p_brand), ',', lower(p_type)), ',') AS vibe_tags,
        split(CASE p_size % 10 WHEN 0 THEN '21-plus' WHEN 1 THEN 'family-friendly' ELSE 'none' END, ',') AS audience_tags FROM {part}""",
    "instances": """SELECT event_id, start_at, min(source_id) AS source_id FROM (SELECT l_partkey AS event_id, l_shipdate + INTERVAL 1 HOUR * (l_linenumber + 3) AS start_at, l_suppkey % 5 AS source_id FROM {lineitem}) t
        GROUP BY event_id, start_at""",
    "links": """SELECT p_partkey AS event_id, p_partkey % 5 AS source_id, concat('e', p_partkey) AS source_event_id, true AS is_canonical FROM {part}
        UNION ALL SELECT p_partkey AS event_id, (p_partkey + 2) % 5 AS source_id, concat('f', p_partkey) AS source_event_id, false AS is_canonical FROM {part} WHERE p_partkey % 7 = 0""",
    "reviews": """SELECT p_partkey AS id, p_partkey AS event_a, p_partkey + 4 AS event_b, CASE WHEN p_size % 5 = 0 THEN 'broken' ELSE '0.6000' END AS score, CASE p_partkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE 'rejected' END AS status,
        TIMESTAMP '2001-05-15 11:30:00' + INTERVAL 1 MINUTE * p_size AS resolved_at FROM {part} WHERE p_partkey % 4 = 0""",
    "picks": """SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN DATE '2001-05-07' ELSE DATE '2001-05-14' END AS week_of, p_size AS sort_order, p_partkey AS event_id, concat('c', p_size) AS curator FROM {part} WHERE p_partkey % 20 = 0""",
    "registry": """SELECT CAST(p_partkey AS STRING) AS id, concat(upper(p_name), CASE p_partkey % 3 WHEN 0 THEN ' HALL' WHEN 1 THEN ' Theatre' ELSE ' club' END) AS name, concat(p_partkey % 6 + 1, ' n main st') AS address,
        -88 + CAST(p_partkey AS DOUBLE) / 1000 AS lon, 43 + CAST(p_partkey AS DOUBLE) / 1000 AS lat FROM {part}""",
    "suggestions": "SELECT s_suppkey AS keep_id, s_suppkey - 3 AS absorb_id FROM {supplier} WHERE s_suppkey % 6 = 0",
    "aliases": "SELECT concat(p_name, ' stage') AS normalized_name, s_suppkey + 1 AS venue_id FROM {supplier} JOIN {part} ON p_partkey = s_suppkey WHERE s_suppkey % 3 = 2 AND s_suppkey % 5 = 0",
    "merges": """SELECT p_partkey AS absorbed, CASE p_partkey % 10 WHEN 5 THEN p_partkey - 5 WHEN 6 THEN p_partkey - 1 WHEN 7 THEN p_partkey - 2 ELSE p_partkey - p_partkey % 10 END AS survivor,
        CASE p_partkey % 10 WHEN 6 THEN 1 WHEN 7 THEN 2 WHEN 5 THEN 9 ELSE p_partkey % 10 END AS step, 0.81234 AS score, CASE WHEN p_partkey % 4 = 0 THEN 'review' ELSE 'auto' END AS decided_by FROM {part} WHERE p_partkey % 10 IN (1, 2, 5, 6, 7)""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    needed = set(re.findall(r"\{(\w+)\}", TABLES[name]))
    return spark.sql(TABLES[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in needed})


def ctes(*names: str) -> str:
    """The tables as common table expressions, ready for more of them."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({re.sub(r'[{}]', '', TABLES[n])})" for n in names)
