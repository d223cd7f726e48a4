"""Queries over the star-schema tables: each applies operators of this engine and has a plain-SQL twin.

Keys leave as upper-case hexadecimal text, amounts as rounded decimals, so that two engines can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestwell.functions.codecs import I64Key, I64Value, StringPair, U64, Utf8
from nestwell.operators import expiry, integrity, journal, merge, ordered, tree, writes
from nestwell.operators.ordered import Bound
from nestwell.session import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
#: A moment within the events' span, in milliseconds: 2024-01-15 00:00 UTC.
NOW_MS = 1_705_276_800_000
WEEK_MS = 7 * 86_400_000


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def _orders(spark, d) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"))


_ORDERS = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice::DECIMAL(18,2) AS o_totalprice FROM orders)"


@query(f"SELECT printf('%016X', o_orderkey) AS key, o_orderkey, o_custkey, o_totalprice FROM {_ORDERS} WHERE o_orderkey >= 100 AND o_orderkey < 200")
def typed_range(spark, d):
    rows = ordered.key_range(_orders(spark, d), "o_orderkey", Bound(100), Bound(200, False))
    return rows.select(F.hex(U64().encode(F.col("o_orderkey"))).alias("key"), "o_orderkey", "o_custkey", "o_totalprice")


@query(f"SELECT * FROM {_ORDERS} WHERE o_orderkey = 4242")
def point_get(spark, d):
    return ordered.point(_orders(spark, d), "o_orderkey", 4242)


@query(f"SELECT w.pos, w.o_orderkey::BIGINT AS o_orderkey, o_custkey, o_totalprice FROM (VALUES (0, 5), (1, 99999999), (2, 77), (3, 5)) AS w(pos, o_orderkey) LEFT JOIN {_ORDERS} USING (o_orderkey)")
def multi_get(spark, d):
    want = spark.createDataFrame([(0, 5), (1, 99999999), (2, 77), (3, 5)], "pos int, o_orderkey bigint")
    return ordered.multi_get(_orders(spark, d), "o_orderkey", want).select("pos", "o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT count(*) > 0 AS found FROM orders WHERE o_orderkey = 77")
def contains_key(spark, d):
    return ordered.point(_orders(spark, d), "o_orderkey", 77).limit(1).agg((F.count("*") > 0).alias("found"))


@query("SELECT c_name, c_custkey FROM customer WHERE c_name >= coalesce((SELECT max(c_name) FROM customer WHERE c_name <= 'Customer#000000777x'), (SELECT min(c_name) FROM customer)) ORDER BY c_name LIMIT 5")
def seek_predecessor(spark, d):
    return ordered.seek_parked(table(spark, d, "customer").select("c_name", "c_custkey"), "c_name", "Customer#000000777x").limit(5)


@query(f"SELECT * FROM {_ORDERS} WHERE o_orderkey >= 14000 ORDER BY o_orderkey LIMIT 20")
def lower_bound_seek(spark, d):
    return ordered.seek_lower(_orders(spark, d), "o_orderkey", 14000).limit(20)


@query("SELECT c_name, c_custkey, c_mktsegment FROM customer WHERE starts_with(c_name, 'Customer#0000007')")
def prefix_scan(spark, d):
    return ordered.prefix_scan(table(spark, d, "customer").select("c_name", "c_custkey", "c_mktsegment"), "c_name", "Customer#0000007")


@query("SELECT hex(encode(c_name)) AS key, c_custkey FROM customer WHERE starts_with(c_name, 'Customer#00000012')")
def prefix_scan_binary(spark, d):
    rows = table(spark, d, "customer").select(Utf8().encode(F.col("c_name")).alias("k"), "c_custkey")
    return ordered.prefix_scan(rows, "k", b"Customer#00000012").select(F.hex("k").alias("key"), "c_custkey")


@query(f"SELECT * FROM {_ORDERS} WHERE o_orderkey >= 500 AND o_orderkey < 900 ORDER BY o_orderkey DESC LIMIT 10")
def range_rev_limit(spark, d):
    return ordered.key_range(_orders(spark, d), "o_orderkey", Bound(500), Bound(900, False), reverse=True).limit(10)


@query("SELECT o_orderkey, 'open' AS bounds FROM orders WHERE o_orderkey > 10 AND o_orderkey < 15 UNION ALL SELECT o_orderkey, 'closed' FROM orders WHERE o_orderkey >= 10 AND o_orderkey <= 15 UNION ALL SELECT o_orderkey, 'below' FROM orders WHERE o_orderkey <= 3")
def range_bounds(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    part = lambda name, low, high: ordered.key_range(o, "o_orderkey", low, high).select("o_orderkey", F.lit(name).alias("bounds"))
    return part("open", Bound(10, False), Bound(15, False)).unionByName(part("closed", Bound(10), Bound(15))).unionByName(part("below", None, Bound(3)))


@query("SELECT c_name, c_custkey FROM customer WHERE c_name > 'Customer#000000100' ORDER BY c_name LIMIT 26")
def page_after(spark, d):
    return ordered.page_after(table(spark, d, "customer").select("c_name", "c_custkey"), "c_name", "Customer#000000100", 25)


@query(f"SELECT min(o_orderkey) AS first_key, arg_min(o_totalprice, o_orderkey) AS first_value, max(o_orderkey) AS last_key, arg_max(o_totalprice, o_orderkey) AS last_value FROM {_ORDERS}")
def first_last(spark, d):
    return ordered.ends(_orders(spark, d), "o_orderkey", "o_totalprice")


@query("SELECT printf('%016X', o_orderkey) AS key, o_orderkey FROM orders")
def u64_key(spark, d):
    o = table(spark, d, "orders").select(U64().encode(F.col("o_orderkey")).alias("k"))
    return o.select(F.hex("k").alias("key"), U64().decode(F.col("k")).cast("bigint").alias("o_orderkey"))


@query("SELECT printf('%016X', (x::HUGEINT + 9223372036854775808)::UBIGINT) AS key, x AS n FROM (SELECT o_orderkey - 7000 AS x FROM orders)")
def i64_key(spark, d):
    o = table(spark, d, "orders").select(I64Key().encode(F.col("o_orderkey") - 7000).alias("k"))
    return o.select(F.hex("k").alias("key"), I64Key().decode(F.col("k")).alias("n"))


@query("SELECT printf('%016X', CASE WHEN x < 0 THEN (x::HUGEINT + 18446744073709551616)::UBIGINT ELSE x::UBIGINT END) AS value, x AS n FROM (SELECT o_orderkey - 7000 AS x FROM orders)")
def i64_value(spark, d):
    o = table(spark, d, "orders").select(I64Value().encode(F.col("o_orderkey") - 7000).alias("k"))
    return o.select(F.hex("k").alias("value"), I64Value().decode(F.col("k")).alias("n"))


@query("SELECT hex(encode(c_name)) AS key, c_name FROM customer")
def string_key(spark, d):
    c = table(spark, d, "customer").select(Utf8().encode(F.col("c_name")).alias("k"))
    return c.select(F.hex("k").alias("key"), Utf8().decode(F.col("k")).alias("c_name"))


@query("SELECT hex(encode(c_mktsegment)) || '0000' || hex(encode(c_name)) || '0000' AS key, c_mktsegment AS a, c_name AS b FROM customer")
def pair_key(spark, d):
    pair = F.struct(F.col("c_mktsegment").alias("a"), F.col("c_name").alias("b"))
    c = table(spark, d, "customer").select(StringPair().encode(pair).alias("k")).select(F.hex("k").alias("key"), StringPair().decode(F.col("k")).alias("p"))
    return c.select("key", "p.a", "p.b")


def _events(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.round("value", 4).cast("decimal(18,4)").alias("value"))


_EVENTS = "(SELECT event_id, user_id, event_type, epoch_us(ts) AS us, round(value, 4)::DECIMAL(18,4) AS value FROM events)"
_TTL = f"(SELECT event_type AS path, event_id AS key, epoch_us(ts) // 1000 + {WEEK_MS} AS expires_at_ms FROM events)"


def _deadlines(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("path"), F.col("event_id").alias("key"), (expiry.deadline_ms(F.col("ts")) + WEEK_MS).alias("expires_at_ms"))


@query(f"SELECT * FROM {_TTL}")
def ttl_deadline_ms(spark, d):
    return _deadlines(spark, d)


@query(f"SELECT path, count(*) AS stored, count(*) FILTER (WHERE expires_at_ms > {NOW_MS}) AS live FROM {_TTL} GROUP BY path")
def len_live_vs_raw(spark, d):
    return _deadlines(spark, d).groupBy("path").agg(F.count("*").alias("stored"), F.count_if(expiry.is_live("expires_at_ms", NOW_MS)).alias("live"))


@query(f"SELECT event_type AS path, event_id AS key, value FROM {_EVENTS} e WHERE NOT EXISTS (SELECT 1 FROM {_TTL} t WHERE t.path = e.event_type AND t.key = e.event_id AND t.expires_at_ms <= {NOW_MS})")
def live_scan(spark, d):
    e = _events(spark, d).select(F.col("event_type").alias("path"), F.col("event_id").alias("key"), "value")
    return expiry.live(e, _deadlines(spark, d), ["path", "key"], NOW_MS)


@query(f"SELECT path, key, expires_at_ms FROM {_TTL} WHERE expires_at_ms <= {NOW_MS} ORDER BY path, expires_at_ms, key LIMIT 25")
def purge_topk(spark, d):
    return expiry.due(_deadlines(spark, d), ["path", "expires_at_ms", "key"], NOW_MS, 25)


@query(f"SELECT path, key, expires_at_ms FROM {_TTL} WHERE NOT (path = 'click' AND key % 3 = 0)")
def clear_ttl(spark, d):
    t = _deadlines(spark, d)
    return expiry.clear(t, t.where("path = 'click' and key % 3 = 0"), ["path", "key"])


@query(f"SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS r FROM {_EVENTS}) WHERE r = 1")
def lww_put(spark, d):
    return writes.last_write_wins(_events(spark, d), ["user_id"], ["us", "event_id"], ["event_type", "value"])


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT o_orderkey + 100000000, o_custkey, 'X' FROM orders WHERE o_orderkey % 5 = 0")
def bulk_upsert(spark, d):
    base = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    changed = base.where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("X"))
    return writes.upsert(base, changed.unionByName(changed.withColumn("o_orderkey", F.col("o_orderkey") + 100000000)), ["o_orderkey"])


@query("SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL")
def bulk_upsert_lineitem(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return writes.last_write_wins(rows, ["l_orderkey", "l_linenumber"], ["l_partkey"], ["l_partkey"])


@query("SELECT count(*) AS removed FROM orders WHERE o_orderkey % 7 = 0")
def remove_many(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    twice = o.where("o_orderkey % 7 = 0")
    return writes.removed_count(o, twice.union(twice), ["o_orderkey"])


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderkey >= 100 AND o_orderkey < 9000)")
def delete_range(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return o.where(~ordered.within("o_orderkey", Bound(100), Bound(9000, False)))


@query("SELECT c_name FROM customer WHERE NOT starts_with(c_name, 'Customer#0000001')")
def delete_prefix(spark, d):
    return table(spark, d, "customer").select("c_name").where(~ordered.has_prefix("c_name", "Customer#0000001"))


@query("SELECT o_orderkey, o_custkey % 2 = 0 AS applied, o_orderstatus AS observed, CASE WHEN o_custkey % 2 = 0 THEN 'Z' ELSE o_orderstatus END AS current FROM orders UNION ALL SELECT o_orderkey + 500000000, true, NULL, 'N' FROM orders")
def compare_exchange(spark, d):
    base = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    some = base.select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderstatus")).otherwise("?").alias("expected"), F.lit("Z").alias("new"))
    fresh = base.select((F.col("o_orderkey") + 500000000).alias("o_orderkey"), F.lit(None).cast("string").alias("expected"), F.lit("N").alias("new"))
    return writes.compare_exchange(base, some.unionByName(fresh), ["o_orderkey"], "o_orderstatus", "expected", "new")


@query("SELECT k AS o_orderkey, o.o_orderkey IS NULL AS applied, o_orderstatus AS observed, coalesce(o_orderstatus, 'N') AS current FROM (SELECT o_orderkey * 2 AS k FROM orders) w LEFT JOIN orders o ON o.o_orderkey = w.k")
def put_if_absent(spark, d):
    base = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    wanted = base.select((F.col("o_orderkey") * 2).alias("o_orderkey"), F.lit("N").alias("new"))
    return writes.put_if_absent(base, wanted, ["o_orderkey"], "o_orderstatus", "new")


@query("SELECT o_orderkey, coalesce(o_orderstatus = 'F', false) AS applied, o_orderstatus AS observed, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS current FROM orders")
def delete_if_value(spark, d):
    base = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    wanted = base.select("o_orderkey", F.lit("F").alias("expected"))
    return writes.delete_if_value(base, wanted, ["o_orderkey"], "o_orderstatus", "expected")


@query(f"SELECT user_id, sum(value)::DECIMAL(28,4) AS value FROM {_EVENTS} GROUP BY user_id")
def fetch_add(spark, d):
    return writes.fetch_add(_events(spark, d), "user_id", "value").withColumn("value", F.col("value").cast("decimal(28,4)"))


@query(f"SELECT event_id, user_id, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DECIMAL(28,4) AS previous FROM {_EVENTS}")
def fetch_add_previous(spark, d):
    rows = writes.fetch_add_previous(_events(spark, d), "user_id", ["us", "event_id"], "value")
    return rows.select("event_id", "user_id", F.col("previous").cast("decimal(28,4)").alias("previous"))


@query("SELECT count(*) AS inserted, coalesce(bool_and(ok), true) AS ordered FROM (SELECT coalesce(lag(event_id) OVER (ORDER BY ts, event_id) < event_id, true) AS ok FROM events)")
def insert_ordered_by_time(spark, d):
    return writes.insert_ordered(table(spark, d, "events").select("ts", F.col("event_id").alias("id"), "event_id"), "event_id", ["ts", "id"])


@query("SELECT count(*) AS inserted, true AS ordered FROM orders")
def insert_ordered_by_key(spark, d):
    return writes.insert_ordered(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", ["o_orderkey"])


@query("SELECT event_type, sum(rose)::BIGINT AS next_int FROM (SELECT event_type, CASE WHEN here AND NOT coalesce(lag(here) OVER (PARTITION BY event_type, user_id ORDER BY us, event_id), false) THEN 1 ELSE 0 END AS rose FROM (SELECT *, event_id % 4 <> 0 AS here FROM " + _EVENTS + ")) GROUP BY event_type")
def next_int(spark, d):
    return writes.appearances(_events(spark, d), ["event_type"], "user_id", ["us", "event_id"], F.col("event_id") % 4 != 0)


_LINKS = f"(SELECT user_id, us, event_id, event_type AS v, lag(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id) AS e FROM {_EVENTS})"


@query(f"""WITH RECURSIVE ops AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n, CASE WHEN event_id % 5 = 0 THEN 'stale' ELSE e END AS e, v FROM {_LINKS}),
 run(user_id, n, value, applied) AS (SELECT DISTINCT user_id, 0::BIGINT, NULL::VARCHAR, 0::BIGINT FROM ops
 UNION ALL SELECT r.user_id, o.n, CASE WHEN r.value IS NOT DISTINCT FROM o.e THEN o.v ELSE r.value END, r.applied + CASE WHEN r.value IS NOT DISTINCT FROM o.e THEN 1 ELSE 0 END FROM run r JOIN ops o ON o.user_id = r.user_id AND o.n = r.n + 1)
 SELECT user_id, arg_max(value, n) FILTER (value IS NOT NULL AND true) AS value, max(applied) AS applied FROM run GROUP BY user_id""")
def cas_chain(spark, d):
    """Chains whose links expect what the one before wanted to write, and every fifth something else: failed links leave later ones without their match."""
    from pyspark.sql import Window as W

    e = _events(spark, d)
    w = W.partitionBy("user_id").orderBy("us", "event_id")
    expected = F.when(F.col("event_id") % 5 == 0, "stale").otherwise(F.lag("event_type").over(w))
    ops = e.select("user_id", "us", "event_id", expected.alias("expected"), F.col("event_type").alias("new"))
    none = spark.createDataFrame([], "user_id bigint, value string")
    return writes.fold_conditional(none, ops, ["user_id"], ["us", "event_id"], "value").select("user_id", "value", F.col("applied").cast("bigint").alias("applied"))


def _tree(spark, d) -> DataFrame:
    """Regions hold nations, nations hold customers: buckets and values as entries."""
    r, n, c = (table(spark, d, t) for t in ("region", "nation", "customer"))
    bucket = lambda rows, path, key, count: rows.select(path.alias("path"), key.cast("binary").alias("key"), F.lit("bucket").alias("kind"), F.lit(None).cast("binary").alias("value"), count.cast("bigint").alias("next_int"))
    hexed = lambda c: F.lower(F.hex(F.encode(c, "UTF-8")))
    per_nation = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("k"))
    per_region = n.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("k"))
    regions = bucket(r.join(per_region, "r_regionkey", "left"), F.lit(""), F.col("r_name"), F.coalesce("k", F.lit(0)))
    nr = n.join(r, n.n_regionkey == r.r_regionkey)
    nations = bucket(nr.join(per_nation, "n_nationkey", "left"), F.concat(hexed(F.col("r_name")), F.lit("/")), F.col("n_name"), F.coalesce("k", F.lit(0)))
    cn = c.join(nr, c.c_nationkey == nr.n_nationkey)
    customers = cn.select(F.concat(hexed(F.col("r_name")), F.lit("/"), hexed(F.col("n_name")), F.lit("/")).alias("path"), F.col("c_name").cast("binary").alias("key"), F.lit("kv").alias("kind"), F.col("c_mktsegment").cast("binary").alias("value"), F.lit(None).cast("bigint").alias("next_int"))
    return regions.unionByName(nations).unionByName(customers)


_TREE = """(SELECT '' AS path, r_name AS key, 'bucket' AS kind, NULL AS value, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS next_int FROM region
 UNION ALL SELECT lower(hex(encode(r_name))) || '/', n_name, 'bucket', NULL, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT lower(hex(encode(r_name))) || '/' || lower(hex(encode(n_name))) || '/', c_name, 'kv', c_mktsegment, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _plain(rows: DataFrame) -> DataFrame:
    return rows.select("path", F.col("key").cast("string").alias("key"), "kind", F.col("value").cast("string").alias("value"), "next_int")


@query(f"SELECT * FROM {_TREE}")
def bucket_tree(spark, d):
    return _plain(tree.depth_first(_tree(spark, d)))


@query(f"SELECT key, next_int FROM {_TREE} WHERE path = lower(hex(encode('ASIA'))) || '/' AND kind = 'bucket'")
def bucket_children(spark, d):
    return tree.children(_tree(spark, d), tree.path_of([b"ASIA"]), "bucket").select(F.col("key").cast("string").alias("key"), "next_int")


@query(f"SELECT path, key, kind FROM {_TREE} WHERE NOT starts_with(path, lower(hex(encode('EUROPE'))) || '/') AND NOT (path = '' AND key = 'EUROPE')")
def delete_bucket(spark, d):
    rows = tree.without_subtree(_tree(spark, d), tree.path_of([b"EUROPE"])).where("not (path = '' and key = cast('EUROPE' as binary))")
    return _plain(rows).select("path", "key", "kind")


@query("SELECT invariant, path, key FROM (VALUES ('unique_key', 'a', 'b')) AS v(invariant, path, key) WHERE false")
def verify_tree(spark, d):
    v = integrity.violations(_tree(spark, d))
    return v.select("invariant", "path", F.col("key").cast("string").alias("key"))


@query(f"SELECT 'parent_exists' AS invariant, path, NULL::VARCHAR AS key FROM (SELECT DISTINCT path FROM {_TREE} WHERE kind = 'kv' AND starts_with(path, lower(hex(encode('ASIA'))) || '/'))")
def verify_broken_tree(spark, d):
    """A region without its nations' rows and its own: everything below hangs in the air."""
    rows = _tree(spark, d).where("not (kind = 'bucket' and (path = '41534941/' or key = cast('ASIA' as binary)))")
    return integrity.violations(rows).select("invariant", "path", F.col("key").cast("string").alias("key"))


def _side(spark, d, step: int, shift: int) -> DataFrame:
    o = table(spark, d, "orders").where(F.col("o_orderkey") % step == 0)
    key = U64().encode(F.col("o_orderkey"))
    value = F.encode(F.concat(F.lit("v"), ((F.col("o_orderkey") * shift) % 4).cast("string")), "UTF-8")
    ttl = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") * 1000 + F.when(F.col("o_orderkey") % 10 == 0, 0).otherwise(shift))
    return o.select(F.lit("").alias("path"), key.alias("key"), F.lit("kv").alias("kind"), value.alias("value"), F.lit(None).cast("bigint").alias("next_int"), ttl.cast("bigint").alias("ttl"))


def _merge_sql(policy: str) -> str:
    side = lambda step, shift: f"(SELECT o_orderkey AS k, 'v' || ((o_orderkey * {shift}) % 4)::VARCHAR AS v, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey * 1000 + CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE {shift} END END AS t FROM orders WHERE o_orderkey % {step} = 0)"
    same = "s.v IS NOT DISTINCT FROM d.v AND s.t IS NOT DISTINCT FROM d.t"
    over = policy == "overwrite"
    return f"""SELECT printf('%016X', coalesce(s.k, d.k)) AS key,
        CASE WHEN s.k IS NULL THEN 'keep' WHEN d.k IS NULL THEN 'insert' WHEN {same} THEN 'same' ELSE '{"update" if over else "skip"}' END AS action,
        CASE WHEN s.k IS NULL THEN d.v WHEN d.k IS NULL THEN s.v ELSE {"s.v" if over else "d.v"} END AS value,
        CASE WHEN s.k IS NULL THEN d.t WHEN d.k IS NULL THEN s.t ELSE {"s.t" if over else "d.t"} END AS ttl
        FROM {side(3, 3)} s FULL OUTER JOIN {side(2, 1)} d ON s.k = d.k"""


def _merge(spark, d, policy: merge.ConflictPolicy) -> DataFrame:
    planned = merge.plan(_side(spark, d, 2, 1), _side(spark, d, 3, 3), policy)
    return planned.select(F.hex("key").alias("key"), "action", F.col("value").cast("string").alias("value"), "ttl")


@query(_merge_sql("overwrite"))
def merge_overwrite(spark, d):
    return _merge(spark, d, merge.ConflictPolicy.OVERWRITE)


@query(_merge_sql("keep"))
def merge_keep(spark, d):
    return _merge(spark, d, merge.ConflictPolicy.KEEP_EXISTING)


@query(f"SELECT count(*) FILTER (action = 'insert') AS inserted, count(*) FILTER (action = 'update') AS updated, count(*) FILTER (action = 'same') AS unchanged, 0::BIGINT AS skipped, 0::BIGINT AS buckets_created, 0::BIGINT AS buckets_merged, 0::BIGINT AS type_conflicts_resolved FROM ({_merge_sql('overwrite')})")
def merge_report(spark, d):
    return merge.report(merge.plan(_side(spark, d, 2, 1), _side(spark, d, 3, 3), merge.ConflictPolicy.OVERWRITE))


@query(f"SELECT min(lower(key)) || '/' AS first_at FROM ({_merge_sql('keep')}) WHERE action = 'skip'")
def merge_first_conflict(spark, d):
    return merge.first_conflict(merge.plan(_side(spark, d, 2, 1), _side(spark, d, 3, 3), merge.ConflictPolicy.ERROR)).withColumnRenamed("at", "first_at")


def _tree_ttl(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ttl", F.lit(None).cast("bigint"))


@query("""WITH s AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS plain, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS k FROM nation)
 SELECT sum(plain)::BIGINT AS inserted, 0::BIGINT AS updated, (SELECT coalesce(sum(k), 0)::BIGINT FROM s WHERE plain = 0) AS unchanged, 0::BIGINT AS skipped, 0::BIGINT AS buckets_created,
 (5 + sum(1 - plain))::BIGINT AS buckets_merged, sum(plain)::BIGINT AS type_conflicts_resolved FROM s""")
def merge_tree_report(spark, d):
    """Every other nation is a plain value in the source: its bucket in the destination goes with all it holds."""
    mine = _tree(spark, d)
    even = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").cast("binary").alias("key"))
    nations = mine.where(tree.depth() == 1)
    gone = nations.join(even, "key", "left_semi")
    as_value = gone.select("path", "key", F.lit("kv").alias("kind"), F.lit("x").cast("binary").alias("value"), F.lit(None).cast("bigint").alias("next_int"))
    below = mine.join(gone.select(tree.child_path().alias("path")), "path", "left_anti").join(gone.select("path", "key"), ["path", "key"], "left_anti")
    return merge.report(merge.plan(_tree_ttl(mine), _tree_ttl(below.unionByName(as_value)), merge.ConflictPolicy.OVERWRITE))


def _journal(spark, d) -> tuple[DataFrame, DataFrame]:
    """Ten events make a transaction; every seventh transaction is empty."""
    e = table(spark, d, "events").select((F.col("event_id") / 10).cast("bigint").alias("tx_id"), (F.col("event_id") % 10).alias("seq"), F.col("event_type").alias("bucket_path"), F.col("user_id").alias("key"), F.when(F.col("event_id") % 4 == 0, "delete").otherwise("put").alias("op"))
    changes = e.where("tx_id % 7 <> 0")
    headers = e.groupBy("tx_id").agg(F.lit(False).alias("truncated"), F.sum((F.col("tx_id") % 7 != 0).cast("bigint")).alias("n_changes"))
    return headers, changes


_CHANGES = "(SELECT event_id // 10 AS tx_id, event_id % 10 AS seq, event_type AS bucket_path, user_id AS key, CASE WHEN event_id % 4 = 0 THEN 'delete' ELSE 'put' END AS op FROM events)"


@query(f"SELECT h.tx_id, c.seq, c.bucket_path, c.key, c.op FROM (SELECT DISTINCT tx_id FROM {_CHANGES} WHERE tx_id > 20 ORDER BY tx_id LIMIT 30) h LEFT JOIN {_CHANGES} c ON c.tx_id = h.tx_id AND c.tx_id % 7 <> 0 AND c.op = 'delete'")
def journal_replay(spark, d):
    headers, changes = _journal(spark, d)
    return journal.replay(headers, changes, 20, 30, F.col("op") == "delete").select("tx_id", "seq", "bucket_path", "key", "op")


@query(f"SELECT DISTINCT tx_id FROM {_CHANGES} ORDER BY tx_id DESC LIMIT 15")
def journal_retention(spark, d):
    return journal.retained(_journal(spark, d)[0], 15).select("tx_id")


@query(f"SELECT min(tx_id) AS oldest, max(tx_id) AS newest, 6 < min(tx_id) AS gap FROM (SELECT DISTINCT tx_id FROM {_CHANGES} ORDER BY tx_id DESC LIMIT 15)")
def journal_gap(spark, d):
    return journal.gap(journal.retained(_journal(spark, d)[0], 15), 5)


def queries() -> dict[str, Query]:
    from nestwell.plans import stores  # noqa: F401  (adds the queries that go through committed stores)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from nestwell.plans import stores  # noqa: F401

    return dict(_SQL)
