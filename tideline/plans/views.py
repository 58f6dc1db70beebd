"""Task, event and interruption tables derived from the order and event tables, for queries and for their SQL.

Each view is one SELECT in the common part of the two dialects; what differs is filled in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import merged_if_large, spread_by

SPARK = {
    "k": "CAST(get_json_object(props, '$.k') AS BIGINT)",
    "us": "unix_micros(CAST({0} AS TIMESTAMP))",
    "ts": "timestamp_micros(CAST({0} AS BIGINT))",
    "stamp": "CAST({0} AS TIMESTAMP)",
}
DUCK = {
    "k": "CAST(json_extract_string(props, '$.k') AS BIGINT)",
    "us": "epoch_us({0})",
    "ts": "make_timestamp(CAST({0} AS BIGINT))",
    "stamp": "CAST({0} AS TIMESTAMP)",
}
AS_OF_EVENTS, AS_OF_TASKS = "2024-01-31 00:00:00", "2001-08-02 00:00:00"
MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000


def bodies(d: dict[str, str]) -> dict[str, tuple[list[str], str]]:
    """name: (tables that it reads, SELECT over them)."""
    us, ts, stamp = (lambda x, m=m: d[m].format(x) for m in ("us", "ts", "stamp"))
    ev = f"(SELECT event_id, {stamp('ts')} AS ts, user_id, event_type, value, {d['k']} AS k FROM {{events}}) AS ev"
    kind = "CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'started' WHEN 'click' THEN 'resumed' WHEN 'error' THEN 'paused' ELSE CASE WHEN k % 3 = 0 THEN 'forgotten' WHEN k % 10 = 1 THEN 'cancelled' ELSE 'completed' END END"
    types = "CASE k % 8 WHEN 0 THEN 'phone' WHEN 1 THEN 'social_media' WHEN 2 THEN 'message' WHEN 3 THEN 'call' WHEN 4 THEN 'search' WHEN 5 THEN 'person' WHEN 6 THEN 'food' ELSE 'other' END"
    start = f"{us('ts')} + k * {MINUTE}"
    created = f"{us('o_orderdate')} + (o_orderkey % 24) * {HOUR} + (o_orderkey % 60) * {MINUTE}"
    return {
        "task_events": (["events"], f"SELECT event_id AS id, user_id, user_id * 4 + k % 4 AS task_id, k % 5 AS location_id, {kind} AS event_type, ts AS event_time FROM {ev}"),
        # every 17th event once more, upper-cased, and every 19th as it is
        "dirty_events": (["events"], f"SELECT event_id * 3 AS id, user_id, user_id * 4 + k % 4 AS task_id, {kind} AS event_type, ts AS event_time FROM {ev} UNION ALL SELECT event_id * 3 + 1, user_id, user_id * 4 + k % 4, upper({kind}), ts FROM {ev} WHERE k % 17 = 0 UNION ALL SELECT event_id * 3 + 2, user_id, user_id * 4 + k % 4, {kind}, CASE WHEN k = 95 THEN NULL ELSE ts END FROM {ev} WHERE k % 19 = 0"),
        "interruptions": (["events"], f"SELECT event_id AS id, user_id, CASE WHEN k % 7 = 0 THEN NULL ELSE user_id * 4 + k % 4 END AS task_id, k % 5 AS location_id, {types} AS interruption_type, {ts(start)} AS start_time, CASE WHEN k % 13 = 0 THEN NULL ELSE {ts(f'{start} + CAST(floor(value * 6) AS BIGINT) * 1000000')} END AS end_time, CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(floor(value * 6) AS BIGINT) END AS duration_seconds FROM {ev} WHERE event_type IN ('view', 'click') AND k >= 30"),
        "context_events": (["events"], f"SELECT event_id AS id, user_id, user_id * 4 + k % 4 AS task_id, k % 6 AS task_category, k % 5 AS context, ts, CASE event_type WHEN 'view' THEN 'START' WHEN 'click' THEN CASE WHEN k < 20 THEN 'PAUSE' ELSE 'RESUME' END WHEN 'error' THEN 'INTERRUPTION' WHEN 'signup' THEN 'TASK_SWITCH' ELSE 'COMPLETE' END AS event_type FROM {ev}"),
        "tasks": (["orders", "lineitem", "part"], f"""SELECT task_id, user_id, priority, category, location_id, status, {ts('c')} AS created_at, {ts('s')} AS started_at,
          CASE WHEN status = 'completed' THEN {ts(f'coalesce(s, c) + (1 + user_id % 20) * {HOUR}')} END AS completed_at,
          CASE WHEN task_id % 5 >= 3 THEN {ts(f'c + (task_id % 72) * {HOUR}')} END AS deadline_at,
          CASE WHEN status = 'forgotten' THEN {ts(f'c + (2 + user_id % 9) * {DAY}')} END AS forgotten_at, CASE WHEN status = 'cancelled' THEN {ts(f'c + (1 + user_id % 48) * {HOUR}')} END AS cancelled_at
          FROM (SELECT o_orderkey AS task_id, o_custkey AS user_id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, coalesce(category, 'general') AS category, CAST(o_orderkey % 5 AS INT) AS location_id,
            CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'forgotten' ELSE CASE WHEN o_orderkey % 4 = 0 THEN 'cancelled' ELSE 'started' END END AS status,
            {created} AS c, CASE WHEN o_orderkey % 8 <> 0 THEN {created} + (o_orderkey % 48) * {HOUR} END AS s
            FROM {{orders}} AS o LEFT JOIN (SELECT l_orderkey, min(p_type) AS category FROM {{lineitem}} AS l JOIN {{part}} AS p ON l_partkey = p_partkey GROUP BY l_orderkey) AS x ON o_orderkey = l_orderkey) AS t"""),
        "locations": (["region"], "SELECT r_regionkey AS id, r_name AS label, CASE r_regionkey WHEN 0 THEN 'HOME' WHEN 1 THEN 'WORK' WHEN 2 THEN 'GYM' WHEN 3 THEN 'COMMUTE' ELSE 'STUDY' END AS location_type FROM {region}"),
        "visits": (["lineitem", "part", "orders"], f"SELECT DISTINCT l_orderkey AS basket_id, o_custkey AS user_id, {us('o_orderdate')} // 1000000 AS t, o_orderpriority AS context, concat('kind ', p_size % 5) AS item FROM {{lineitem}} AS l JOIN {{part}} AS p ON l_partkey = p_partkey JOIN {{orders}} AS o ON l_orderkey = o_orderkey" if d is DUCK else f"SELECT DISTINCT l_orderkey AS basket_id, o_custkey AS user_id, {us('o_orderdate')} DIV 1000000 AS t, o_orderpriority AS context, concat('kind ', p_size % 5) AS item FROM {{lineitem}} AS l JOIN {{part}} AS p ON l_partkey = p_partkey JOIN {{orders}} AS o ON l_orderkey = o_orderkey"),
        "baskets": (["lineitem", "part", "orders"], "SELECT DISTINCT l_orderkey AS basket_id, o_orderpriority AS context, p_brand AS item FROM {lineitem} AS l JOIN {part} AS p ON l_partkey = p_partkey JOIN {orders} AS o ON l_orderkey = o_orderkey"),
    }


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, body = bodies(SPARK)[name]
    found = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    if name in ("baskets", "visits"):  # a join takes the partitions of its side with most, so line items are spread likewise
        found |= {t: merged_if_large(spread_by(found[t], key, of=found["lineitem"]), of=found[t]) for t, key in (("part", "p_partkey"), ("orders", "o_orderkey"))}
    return spark.sql(body, **found)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the named views in front."""
    parts = [f"{n} AS ({body.format(**{t: t for t in tables})})" for n in names for tables, body in [bodies(DUCK)[n]]]
    sql = sql.strip()
    if sql.startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + sql[15:]
    return "WITH " + ", ".join(parts) + (", " + sql[5:] if sql[:5].upper() == "WITH " else " " + sql)
