"""The registered queries of the engine's own operators over the driver tables, and the SQL they are held against.

The tables are not logs, so each operator runs on a table of the same shape: conversations for turns,
events for timed rows, documents for copies, lineitem for billed rows, region to orders for the hierarchy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import columns as C
from tallyloom.operators import intervals, rollup, search, sequences, tables
from tallyloom.sources import logs

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with the SQL for the same rows."""

    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c) -> F.Column:
    return F.round(c * 100).cast("long")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").withColumn("ms", C.millis(F.col("ts")))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as intervals: from the order to its last shipment."""
    ship = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    return _table(spark, sf_dir, "orders").join(ship, "o_orderkey").withColumn("t0", C.millis(F.col("o_orderdate"))).withColumn("t1", C.millis(F.col("shipped")))


_ORDERS = "o AS (SELECT orders.*, shipped, epoch_ms(o_orderdate) AS t0, epoch_ms(shipped) AS t1 FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"


# Turns and ordered rows


@query("""WITH t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS turn_idx FROM conversations)
SELECT conv_id, CAST(turn_idx AS BIGINT) AS turn_idx, role AS kind, count(*) AS n FROM t GROUP BY ALL""")
def turn_partition(spark, sf_dir):
    own = sequences.turns(_table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user")
    return own.groupBy("conv_id", "turn_idx", F.col("role").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH o AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS at_ms FROM events WHERE event_type = 'signup'),
r AS (SELECT *, max(at_ms) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS "start" FROM o)
SELECT user_id, event_id, "start", lead("start") OVER (PARTITION BY user_id ORDER BY event_id) AS "end", at_ms < "start" AS clamped FROM r""")
def turn_bounds(spark, sf_dir):
    own = _events(spark, sf_dir).where("event_type = 'signup'").select("user_id", "event_id", F.col("ms").alias("at"))
    return sequences.turn_windows(own, "user_id", "at", "event_id").select("user_id", "event_id", "start", "end", "clamped")


@query("""SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2""")
def keep_last_dedupe(spark, sf_dir):
    own = _table(spark, sf_dir, "events").select("user_id", C.day(F.col("ts")).alias("day"), "event_id", "event_type", "value", F.col("event_id").alias("seq"))
    return sequences.keep_last(own, ["user_id", "day"], "seq").drop("seq")


@query("""WITH c AS (SELECT text, source, min(doc_id) AS seen FROM documents GROUP BY 1, 2),
g AS (SELECT text, count(*) AS n FROM c GROUP BY 1 HAVING count(*) > 1),
k AS (SELECT c.*, row_number() OVER (PARTITION BY text ORDER BY seen, source) AS rk, count(*) OVER (PARTITION BY text, seen) AS ties FROM c)
SELECT md5(k.text) AS text_md5, k.source AS canonical, g.n AS n_places, CASE WHEN ties = 1 THEN 'ii' ELSE 'iii' END AS clause FROM k JOIN g ON g.text = k.text WHERE rk = 1""")
def canonical_copy(spark, sf_dir):
    own = _table(spark, sf_dir, "documents").select(F.md5("text").alias("text_md5"), "source", "doc_id")
    return sequences.canonical(own, "text_md5", "source", F.lit(False), "doc_id")


@query("""WITH d AS (SELECT DISTINCT text, source FROM documents) SELECT x.source AS a, y.source AS b, count(*) AS n_shared FROM d x JOIN d y ON x.text = y.text AND x.source < y.source GROUP BY 1, 2""")
def fork_partners(spark, sf_dir):
    return sequences.partners(_table(spark, sf_dir, "documents").select(F.md5("text").alias("k"), "source"), "k", "source")


_PAIRS = """s AS (SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN 1 ELSE -1 END AS d FROM events WHERE event_type IN ('click', 'purchase')),
b AS (SELECT *, sum(d) OVER w AS c FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
h AS (SELECT *, c - d - least(0, coalesce(min(c) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS held FROM b),
k AS (SELECT *, CASE WHEN d = 1 THEN 'open' WHEN held > 0 THEN 'close' ELSE 'stray' END AS kind FROM h),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY event_id) AS k FROM k),
p AS (SELECT o.user_id, o.k, o.event_id AS open_seq, c.event_id AS close_seq FROM n o LEFT JOIN n c ON c.user_id = o.user_id AND c.k = o.k AND c.kind = 'close' WHERE o.kind = 'open'
UNION ALL SELECT user_id, NULL, NULL, event_id FROM n WHERE kind = 'stray')"""


def _pairs(spark, sf_dir):
    return sequences.fifo_pairs(_table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "click", F.col("event_type") == "purchase")


@query(f"WITH {_PAIRS} SELECT * FROM p WHERE open_seq IS NOT NULL AND close_seq IS NOT NULL")
def fifo_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).where("open_seq is not null and close_seq is not null")


@query(f"WITH {_PAIRS} SELECT user_id, count(*) FILTER (close_seq IS NULL) AS uses_open, count(*) FILTER (open_seq IS NULL) AS results_stray FROM p GROUP BY 1")
def unmatched_sides(spark, sf_dir):
    return _pairs(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("close_seq").isNull()).alias("uses_open"), F.count_if(F.col("open_seq").isNull()).alias("results_stray"))


@query("""WITH s AS (SELECT user_id, ts, max(event_id) AS opener FROM events WHERE event_type = 'signup' GROUP BY 1, 2)
SELECT e.event_id, e.user_id, s.opener FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.ts >= s.ts""")
def asof_turn(spark, sf_dir):
    own = _events(spark, sf_dir)
    rows = own.where("event_type = 'error'").select("event_id", "user_id", "ms")
    marks = own.where("event_type = 'signup'").groupBy("user_id", "ms").agg(F.max("event_id").alias("opener"))
    return sequences.asof(rows, marks, ["user_id"], "ms", "opener", "opener").select("event_id", "user_id", "opener")


@query("""SELECT user_id, arg_max(event_type, event_id) AS event_type, count(event_type) AS n_event_type, arg_max(nullif(value, 0), event_id) FILTER (nullif(value, 0) IS NOT NULL) AS value, count(nullif(value, 0)) AS n_value FROM events GROUP BY 1""")
def latest_value_count(spark, sf_dir):
    own = _table(spark, sf_dir, "events").withColumn("value", F.nullif("value", F.lit(0.0)))
    return sequences.latest(own, ["user_id"], "event_id", ["event_type", "value"])


@query("""WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS up FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
n AS (SELECT id FROM e UNION SELECT up FROM e), r AS (SELECT id AS root, id, CAST(0 AS BIGINT) AS depth FROM n WHERE id NOT IN (SELECT id FROM e)
UNION ALL SELECT r.root, e.id, r.depth + 1 FROM r JOIN e ON e.up = r.id) SELECT id, root, depth, false AS cyclic FROM r""")
def lineage_depth(spark, sf_dir):
    own = _table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("up"))
    own = own.union(_table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey")))
    return sequences.lineage(own, "id", "up")


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS d FROM events GROUP BY 1, 2), g AS (SELECT *, lag(d) OVER (PARTITION BY user_id ORDER BY d) AS p FROM d)
SELECT user_id, strftime(p, '%Y-%m-%d') AS after_day, strftime(d, '%Y-%m-%d') AS before_day, CAST(d - p - 1 AS BIGINT) AS missing FROM g WHERE d - p > 1""")
def gap_separators(spark, sf_dir):
    days = _table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("d")).distinct().withColumn("i", F.unix_date("d"))
    gaps = intervals.empty_stretches(days, ["user_id"], "i", 2)
    text = lambda c: F.date_format(F.date_from_unix_date(c), "yyyy-MM-dd")
    return gaps.select("user_id", text("t0").alias("after_day"), text("t1").alias("before_day"), (F.col("t1") - F.col("t0") - 1).cast("long").alias("missing"))


# Money and hierarchy

_RATES = [("A", None, "1995-06-30", 20000, 100000), ("A", "1995-07-01", None, 30000, 150000), ("N", None, None, 10000, 50000)]
_RATES_SQL = "rates(k, f, t, i, o) AS (VALUES ('A', NULL, DATE '1995-06-30', 20000, 100000), ('A', DATE '1995-07-01', NULL, 30000, 150000), ('N', NULL, NULL, 10000, 50000))"


def _rates(spark: SparkSession) -> DataFrame:
    own = spark.createDataFrame(_RATES, "key string, valid_from string, valid_to string, input_u long, output_u long")
    return own.withColumns({c: F.to_date(c) for c in ("valid_from", "valid_to")})


@query(f"""WITH {_RATES_SQL} SELECT l_returnflag AS model, strftime(l_shipdate, '%Y') AS year, count(*) AS requests, count(*) FILTER (k IS NULL) AS unpriced,
CAST(sum(CAST(l_quantity AS BIGINT) * i + CAST(l_linenumber AS BIGINT) * o) AS BIGINT) AS tcu
FROM lineitem LEFT JOIN rates ON k = l_returnflag AND (f IS NULL OR CAST(l_shipdate AS DATE) >= f) AND (t IS NULL OR CAST(l_shipdate AS DATE) <= t) GROUP BY 1, 2""")
def priced_ledger(spark, sf_dir):
    own = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_quantity").cast("long").alias("q"), F.col("l_linenumber").cast("long").alias("n"), "l_shipdate")
    priced = intervals.in_effect(own, _rates(spark), "model", F.to_date("l_shipdate"))
    tcu = F.col("q") * F.col("input_u") + F.col("n") * F.col("output_u")
    return priced.groupBy("model", F.date_format("l_shipdate", "yyyy").alias("year")).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("input_u").isNull()).alias("unpriced"), F.sum(tcu).alias("tcu"))


_LEVELS = ["region", "nation", "customer"]
_SCOPE = """b AS (SELECT r_name AS region, n_name AS nation, c_custkey AS customer, CAST(round(o_totalprice * 100) AS BIGINT) AS cents
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""


def _scoped(spark, sf_dir) -> DataFrame:
    """Orders under region, nation and customer, pre-aggregated by customer before the dimension joins."""
    own = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.count(F.lit(1)).alias("n"), F.sum(_cents(F.col("o_totalprice"))).alias("cents"))
    own = own.join(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), "c_nationkey"), "customer")
    own = own.join(_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"), "n_regionkey"), "c_nationkey")
    own = own.join(_table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region")), "n_regionkey")
    return rollup.by_scope(own, _LEVELS, {"requests": F.sum("n").cast("long"), "cents": F.sum("cents").cast("long")})


@query(f"""WITH {_SCOPE} SELECT CASE GROUPING(region, nation, customer) WHEN 7 THEN 'store' WHEN 3 THEN 'region' WHEN 1 THEN 'nation' ELSE 'customer' END AS scope,
region, nation, customer, count(*) AS requests, CAST(sum(cents) AS BIGINT) AS cents FROM b GROUP BY GROUPING SETS ((), (region), (region, nation), (region, nation, customer))""")
def cost_by_scope(spark, sf_dir):
    return _scoped(spark, sf_dir)


@query(f"""WITH {_SCOPE} SELECT 'store' AS scope, CAST(1 AS BIGINT) AS parents, CAST(0 AS BIGINT) AS broken
UNION ALL SELECT 'region', count(DISTINCT region), 0 FROM b UNION ALL SELECT 'nation', count(DISTINCT (region, nation)), 0 FROM b""")
def parent_equals_children(spark, sf_dir):
    return rollup.children_sum(_scoped(spark, sf_dir), _LEVELS, "cents")


@query("""SELECT l_returnflag, strftime(l_shipdate, '%Y-%m-%d') AS day, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2, 3""")
def partial_ledger(spark, sf_dir):
    own = _table(spark, sf_dir, "lineitem").withColumn("day", C.day(F.col("l_shipdate"))).withColumn("q", F.col("l_quantity").cast("long"))
    return rollup.partial(own, ["l_returnflag", "day", "l_linestatus"], ["q"])


@query(f"""WITH {_RATES_SQL} SELECT l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT) * i) AS BIGINT) AS tcu_direct, CAST(sum(CAST(l_quantity AS BIGINT) * i) AS BIGINT) AS tcu_partial, true AS same
FROM lineitem JOIN rates ON k = l_returnflag AND (f IS NULL OR CAST(l_shipdate AS DATE) >= f) AND (t IS NULL OR CAST(l_shipdate AS DATE) <= t) GROUP BY 1""")
def partial_vs_direct(spark, sf_dir):
    """Rates applied to the kept partial sums give what rates applied to every row give."""
    own = _table(spark, sf_dir, "lineitem").withColumn("day", F.to_date("l_shipdate")).withColumn("q", F.col("l_quantity").cast("long"))
    cost = lambda df: intervals.in_effect(df, _rates(spark), "l_returnflag", F.col("day")).where("input_u is not null").groupBy("l_returnflag").agg(F.sum(F.col("q") * F.col("input_u")).alias("tcu"))
    both = tables.reconcile(cost(own.select("l_returnflag", "day", "q")), cost(rollup.partial(own, ["l_returnflag", "day"], ["q"])), ["l_returnflag"], ["tcu"])
    return both.select("l_returnflag", F.col("a_tcu").alias("tcu_direct"), F.col("b_tcu").alias("tcu_partial"), "same")


@query("""WITH a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O') GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.n IS NOT NULL AS in_left, b.n IS NOT NULL AS in_right, a.n AS a_n, b.n AS b_n, a.n IS NOT NULL AND b.n IS NOT NULL AND a.n = b.n AS same FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""")
def ab_session_diff(spark, sf_dir):
    """Open orders by customer as the orders say and as their line items say, compared key by key: they don't agree everywhere."""
    orders = _table(spark, sf_dir, "orders")
    a = orders.where("o_orderstatus <> 'F'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    open_ = _table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey"))
    b = orders.join(open_, "o_orderkey", "left_semi").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return tables.reconcile(a, b, ["o_custkey"], ["n"])


@query("SELECT r.region, r.nation, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, round(sum(CAST(round(o_totalprice * 100) AS BIGINT)) / (SELECT sum(CAST(round(o_totalprice * 100) AS BIGINT)) FROM orders), 4) AS share FROM orders JOIN customer ON c_custkey = o_custkey JOIN (SELECT n_nationkey, n_name AS nation, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey) r ON n_nationkey = c_nationkey GROUP BY 1, 2".replace("SELECT r.region, r.nation", "SELECT r.nation").replace("GROUP BY 1, 2", "GROUP BY 1"))
def contribution_share(spark, sf_dir):
    return tables.shares(_scoped(spark, sf_dir).where("scope = 'nation'"), "nation", "cents").select("nation", "cents", "share")


@query("""WITH n AS (SELECT n_name AS nation, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY n DESC, nation) AS rk FROM n) SELECT CASE WHEN rk <= 12 THEN nation ELSE 'other' END AS nation, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1""")
def top_palette(spark, sf_dir):
    own = _scoped(spark, sf_dir).where("scope = 'nation'").select("nation", F.col("requests").alias("n"))
    return tables.top_with_overflow(own, "nation", "n", 12)


@query("SELECT l_returnflag, arg_max(l_orderkey, (l_quantity, -l_orderkey, -l_linenumber)) AS l_orderkey, arg_max(l_linenumber, (l_quantity, -l_orderkey, -l_linenumber)) AS l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1")
def evidence_top1(spark, sf_dir):
    """The row with the most, the first of equals."""
    order = F.struct(F.col("l_quantity"), -F.col("l_orderkey"), -F.col("l_linenumber"))
    best = F.max_by(F.struct("l_orderkey", "l_linenumber", "l_quantity"), order)
    return _table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(best.alias("b")).select("l_returnflag", "b.*")


# Time


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def day_bands(spark, sf_dir):
    own = _table(spark, sf_dir, "events")
    return own.groupBy(C.day(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(_cents(F.col("value"))).alias("cents"), F.countDistinct("user_id").alias("users"))


@query("""SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2""")
def month_rollup(spark, sf_dir):
    own = _table(spark, sf_dir, "events")
    return own.groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query(f"""WITH {_ORDERS}, d AS (SELECT unnest(generate_series(CAST(o_orderdate AS DATE)::TIMESTAMP, CAST(shipped AS DATE)::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM o WHERE CAST(shipped AS DATE) >= CAST(o_orderdate AS DATE))
SELECT strftime(d, '%Y-%m-%d') AS day, count(*) AS n FROM d GROUP BY 1""")
def turn_days_touched(spark, sf_dir):
    return intervals.days_touched(_orders(spark, sf_dir), "o_orderdate", "shipped")


@query(f"""WITH {_ORDERS}, e AS (SELECT o_orderpriority AS p, unnest([t0, t1]) AS t0, unnest([1, -1]) AS d FROM o WHERE t1 > t0), s AS (SELECT p, t0, sum(d) AS d FROM e GROUP BY 1, 2),
l AS (SELECT p, t0, lead(t0) OVER (PARTITION BY p ORDER BY t0) AS t1, sum(d) OVER (PARTITION BY p ORDER BY t0) AS level FROM s)
SELECT p AS o_orderpriority, t0, t1, CAST(level AS BIGINT) AS level FROM l WHERE level > 0""")
def occupancy(spark, sf_dir):
    return intervals.occupancy(_orders(spark, sf_dir), ["o_orderpriority"], "t0", "t1")


@query(f"""WITH {_ORDERS}, w AS (SELECT o_custkey, t0, t1, max(t1) OVER (PARTITION BY o_custkey ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o WHERE t1 >= t0)
SELECT o_custkey, CAST(sum(CASE WHEN reach IS NULL THEN t1 - t0 ELSE greatest(0, t1 - greatest(t0, reach)) END) AS BIGINT) AS active, max(t1) - min(t0) AS span, count(*) FILTER (reach IS NULL OR t0 > reach) AS n_islands FROM w GROUP BY 1""")
def active_union(spark, sf_dir):
    return intervals.union_length(_orders(spark, sf_dir), ["o_custkey"], "t0", "t1")


@query("""WITH g AS (SELECT event_type, lag(epoch_us(ts) // 1000) OVER (PARTITION BY event_type ORDER BY epoch_us(ts)) AS t0, epoch_us(ts) // 1000 AS t1 FROM events) SELECT * FROM g WHERE t1 - t0 >= 3600000""")
def empty_stretches(spark, sf_dir):
    return intervals.empty_stretches(_events(spark, sf_dir), ["event_type"], "ms", 3_600_000)


@query("""SELECT event_type, CAST(floor((epoch_us(ts) // 1000 - 1704067200000) / 21600000) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1, 2""")
def pixel_bins(spark, sf_dir):
    return intervals.bins(_events(spark, sf_dir), ["event_type"], "ms", 1_704_067_200_000, 21_600_000)


@query("""WITH f AS (SELECT CAST(floor((epoch_us(ts) // 1000 - 1704067200000) / 1000) AS BIGINT) AS b FROM events), k AS (SELECT min(k) AS k FROM (SELECT k, count(DISTINCT b >> k) AS n FROM (SELECT DISTINCT b FROM f), (SELECT unnest(range(63)) AS k) GROUP BY 1) WHERE n <= 40)
SELECT b >> k AS bin, count(*) AS n, CAST(1000 AS BIGINT) << k AS width FROM f, k GROUP BY 1, 3""")
def fitting_bins(spark, sf_dir):
    """Columns of the least doubled second of which there are at most 40."""
    own, width = intervals.fitting_bins(_events(spark, sf_dir), "ms", 1_704_067_200_000, 1_000, 40)
    return own.withColumn("width", F.lit(width).cast("long"))


# Joins and sets


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_lost(spark, sf_dir):
    return _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_known(spark, sf_dir):
    return _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""WITH s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1), c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1)
SELECT k AS nation, s.n IS NOT NULL AS in_left, c.n IS NOT NULL AS in_right, s.n AS a_n, c.n AS b_n, s.n IS NOT NULL AND c.n IS NOT NULL AND s.n = c.n AS same FROM s FULL JOIN c USING (k)""")
def reconcile_full_outer(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    c = _table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    return tables.reconcile(s, c, ["nation"], ["n"])


@query("""WITH o AS (SELECT user_id AS k, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS a, count(*) AS b FROM events GROUP BY 1)
SELECT k AS user_id, CASE WHEN a = 0 THEN 'new' ELSE 'changed' END AS change FROM o WHERE a <> b""")
def session_changes(spark, sf_dir):
    """Users whose rows differ between two readings of a growing log, by fingerprint."""
    own = _events(spark, sf_dir)
    mark = lambda df: df.groupBy("user_id").agg(F.concat_ws(":", F.count(F.lit(1)), F.max("event_id"), F.bit_xor(F.xxhash64("event_id", "ms"))).alias("mark"))
    return tables.changes(mark(own.where(F.col("ms") < 1_705_363_200_000)), mark(own), "user_id", "mark")


# Table algebra


@query("""SELECT p_partkey, nullif(p_size, 1) AS size, p_name FROM part ORDER BY size DESC NULLS LAST, p_partkey LIMIT 50 OFFSET 50""")
def unknown_last_sort_page(spark, sf_dir):
    own = _table(spark, sf_dir, "part").select("p_partkey", F.nullif("p_size", F.lit(1)).alias("size"), "p_name")
    return tables.page(own, [("size", True)], "p_partkey", index=1, size=50)


@query("""SELECT event_type, user_id % 7 AS slot, CASE WHEN count(*) = count(v) THEN coalesce(CAST(sum(v) AS BIGINT), 0) END AS total, count(*) AS n FROM (SELECT *, nullif(CAST(round(value * 100) AS BIGINT) % 1000, 0) AS v FROM events) GROUP BY 1, 2""")
def null_poison_sum(spark, sf_dir):
    own = _table(spark, sf_dir, "events").withColumn("v", F.nullif(_cents(F.col("value")) % 1000, F.lit(0)))
    return own.groupBy("event_type", (F.col("user_id") % 7).alias("slot")).agg(C.poison_sum(F.col("v")).alias("total"), F.count(F.lit(1)).alias("n"))


@query("""SELECT p_brand, count(*) AS n FROM part WHERE split_part(p_type, ' ', 1) IN ('ECONOMY', 'PROMO') OR p_type IN ('ECONOMY', 'PROMO') GROUP BY 1""")
def kind_prefix_filter(spark, sf_dir):
    return tables.kind_filter(_table(spark, sf_dir, "part"), "p_type", ["ECONOMY", "PROMO"], " ").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_type), 'an')")
def text_filter(spark, sf_dir):
    return tables.text_filter(_table(spark, sf_dir, "part"), ["p_name", "p_type"], "AN").select("p_partkey", "p_name", "p_type")


@query("""SELECT quality AS value, count(*) AS n, (SELECT count(quality) FROM documents LEFT JOIN labels USING (doc_id)) AS recorded, (SELECT count(*) - count(quality) FROM documents LEFT JOIN labels USING (doc_id)) AS not_recorded
FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1""")
def census_not_recorded(spark, sf_dir):
    own = _table(spark, sf_dir, "documents").select("doc_id").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    return tables.census(own, "quality")


@query("""WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type IN ('error', 'purchase')), d AS (SELECT DISTINCT event_type, day, user_id FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY event_type, day ORDER BY user_id) AS rk FROM d),
s AS (SELECT event_type, day, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY CAST(user_id AS VARCHAR)) FILTER (rk <= 25) AS sources, count(*) AS n_sources FROM k GROUP BY 1, 2)
SELECT e.event_type, e.day, count(*) AS n, arg_min(props, event_id) AS first_message, any_value(s.sources) AS sources, any_value(s.n_sources) AS n_sources FROM e JOIN s ON s.event_type = e.event_type AND s.day = e.day GROUP BY 1, 2""")
def problem_fold(spark, sf_dir):
    own = _table(spark, sf_dir, "events").where("event_type in ('error', 'purchase')").withColumn("day", C.day(F.col("ts")))
    return tables.fold_problems(own, "event_type", "day", "user_id", "props", "event_id")


@query("""SELECT user_id, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'purchase') AS n_purchase, count(*) AS n FROM events GROUP BY 1""")
def files_ledger_pivot(spark, sf_dir):
    own = _table(spark, sf_dir, "events")
    return own.groupBy("user_id").agg(*(F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in ("view", "click", "purchase")), F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'debt' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'building' END, CASE WHEN n IS NULL THEN 'idle' END, CASE WHEN n >= 20 THEN 'busy' END) AS badges
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def badges(spark, sf_dir):
    n = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    own = _table(spark, sf_dir, "customer").join(n, "c_custkey", "left")
    recorded = {"debt": F.col("c_acctbal") < 0, "building": F.col("c_mktsegment") == "BUILDING", "idle": F.col("n").isNull(), "busy": F.col("n") >= 20}
    return own.select("c_custkey", F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(b)) for b, c in recorded.items()))), ",").alias("badges"))


# Text and search


@query("""SELECT doc_id, CAST(instr(lower(text), 'license') AS BIGINT) AS hit FROM documents WHERE contains(lower(text), 'license')""")
def find_substring(spark, sf_dir):
    return search.substring(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "License").select("doc_id", "hit")


@query("""SELECT doc_id, regexp_extract(text, '[0-9]{2,3}\\.[0-9]+\\.[0-9]+', 0) AS hit, false AS truncated FROM documents WHERE regexp_matches(text, '[0-9]{2,3}\\.[0-9]+\\.[0-9]+')""")
def find_regex(spark, sf_dir):
    return search.pattern(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", r"[0-9]{2,3}\.[0-9]+\.[0-9]+").select("doc_id", "hit", "truncated")


@query("""SELECT doc_id, CAST(instr(lower(nfc_normalize(text)), 'ción') AS BIGINT) AS hit FROM documents WHERE contains(lower(nfc_normalize(text)), 'ción')""")
def find_nfc(spark, sf_dir):
    return search.substring(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "ción", normalise=True).select("doc_id", "hit")


@query("""SELECT source, doc_id FROM documents WHERE contains(lower(text), 'that') AND (source, doc_id) > ('src10', 400) ORDER BY source, doc_id LIMIT 25""")
def find_resume_cursor(spark, sf_dir):
    found = search.substring(_table(spark, sf_dir, "documents").select("source", "doc_id", "text"), "text", "that").select("source", "doc_id")
    return search.resume(found, ["source", "doc_id"], ["src10", 400], 25)


@query("""SELECT doc_id, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 220) AS head FROM documents""")
def head_220(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", C.head(F.col("text")).alias("head"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS units, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
def utf16_length(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", C.utf16_length(F.col("text")).alias("units"), F.octet_length("text").cast("long").alias("bytes"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, false AS k_null, true AS absent_absent FROM events""")
def json_absent_null(spark, sf_dir):
    """A recorded null and a missing key told apart."""
    v = F.try_parse_json("props")
    at = lambda p: F.try_variant_get(v, p, "variant")
    own = _table(spark, sf_dir, "events")
    return own.select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.is_variant_null(at("$.k")).alias("k_null"), at("$.absent").isNull().alias("absent_absent"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'fable-5' WHEN 1 THEN 'haiku-4-5' WHEN 2 THEN 'haiku-3-' || (user_id % 10) WHEN 3 THEN 'opus-3' ELSE 'opus-4-' || (user_id % 10) END AS key FROM events""")
def model_key(spark, sf_dir):
    """Names as logs have them, with dates, versions and suffixes of the events' own numbers, as rate keys."""
    k, d, v = F.col("event_id") % 5, F.date_format("ts", "yyyyMMdd"), (F.col("user_id") % 10).cast("string")
    raw = F.when(k == 0, "claude-fable-5").when(k == 1, F.concat(F.lit("claude-haiku-4-5-"), d)).when(k == 2, F.concat(F.lit("claude-3-"), v, F.lit("-haiku-"), d)).when(k == 3, F.concat(F.lit("claude-3-opus-"), d)).otherwise(F.concat(F.lit("opus-4-"), v, F.lit("[1m]")))
    return _table(spark, sf_dir, "events").select("event_id", C.model_key(raw).alias("key"))


@query("""WITH e AS (SELECT page_id, length(base64(encode(html))) AS n, octet_length(encode(html)) AS d FROM pages)
SELECT page_id, CAST(CASE WHEN n >= 500 THEN 11 ELSE n + 11 END AS BIGINT) AS rest, CASE WHEN n >= 500 THEN 'data' END AS key, CAST(CASE WHEN n >= 500 THEN n END AS INTEGER) AS length, CAST(CASE WHEN n >= 500 THEN d END AS BIGINT) AS bytes FROM e""")
def heavy_strip(spark, sf_dir):
    """Pages as encoded values of a line: what is taken out, its length and its bytes, and how long the line is without it."""
    line = F.concat(F.lit('{"data":"'), F.regexp_replace(F.base64(F.encode("html", "UTF-8")), "[\\r\\n]", ""), F.lit('"}'))
    own = _table(spark, sf_dir, "pages").select("page_id", line.alias("line"))
    b = F.get(logs.heavy(F.col("line")), F.lit(0))
    return own.select("page_id", F.length(logs.strip_heavy(F.col("line"))).cast("long").alias("rest"), b["key"].alias("key"), b["length"].alias("length"), b["bytes"].alias("bytes"))


# Streams


from tallyloom.streaming import batches, upsert  # noqa: E402  (registers below use what stands above)


@query("""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_tumbling(spark, sf_dir):
    return batches.tumbling(spark, f"{sf_dir}/events.parquet")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts) >= 1800000 THEN 1 ELSE 0 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, epoch_us(min(ts)) // 1000 AS t0, count(*) AS n FROM s GROUP BY user_id, s""")
def stream_session(spark, sf_dir):
    return batches.sessions(spark, f"{sf_dir}/events.parquet")


@query("""SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS ts FROM events) GROUP BY 1, 2, 3""")
def stream_dedupe(spark, sf_dir):
    return batches.deduplicated(spark, f"{sf_dir}/events.parquet")


@query("""WITH m AS (SELECT max(ts) - INTERVAL 2 HOUR AS w FROM events), o AS (SELECT * FROM events WHERE event_id % 97 <> 5), b AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS h, event_type FROM o)
SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n FROM b WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM o) GROUP BY 1, 2""")
def stream_closed_windows(spark, sf_dir):
    """Four batches in order of time, then rows of the first days again: those are behind the watermark and change nothing."""
    own = _table(spark, sf_dir, "events").withColumn("day", F.dayofmonth("ts"))
    ontime = own.where("event_id % 97 <> 5")
    parts = [ontime.where(F.col("day").between(a, b)).drop("day") for a, b in ((1, 8), (9, 16), (17, 24), (25, 31))]
    late = own.where("event_id % 97 = 5 and day < 20").drop("day")
    return batches.closed_windows(spark, batches.arrivals(spark, [*parts, late]))


@query("""SELECT user_id, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events WHERE CASE WHEN user_id % 3 = 0 THEN event_id % 2 = 0 WHEN user_id % 7 = 0 THEN false ELSE true END GROUP BY 1""")
def stream_upsert(spark, sf_dir):
    """All users, then some users told anew, then some withdrawn: what a later batch says of a user replaces what was known."""
    own = _table(spark, sf_dir, "events").select("event_id", "user_id", _cents(F.col("value")).alias("cents"))
    folder = batches.arrivals(spark, [own, own.where("user_id % 3 = 0 and event_id % 2 = 0"), own.where("user_id % 3 <> 0 and user_id % 7 = 0").withColumn("cents", F.lit(None).cast("long"))])
    table = f"{folder}-table"
    fold = lambda df: df.where("cents is not null").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
    upsert.replace_by_key(batches.arriving(spark, folder), "user_id", fold, table, f"{folder}-state").awaitTermination()
    return upsert.current(spark, table, "user_id").select("user_id", "n", "cents")


@query(f"""WITH {_ORDERS}, e AS (SELECT o_custkey, unnest([t0, t1]) AS t, unnest([1, -1]) AS d FROM o WHERE t1 > t0), s AS (SELECT o_custkey, t, sum(d) AS d FROM e GROUP BY 1, 2), l AS (SELECT o_custkey, sum(d) OVER (PARTITION BY o_custkey ORDER BY t) AS level FROM s)
SELECT o_custkey, CAST(max(level) AS BIGINT) AS most, coalesce(any_value(p), 0) AS points FROM l LEFT JOIN (SELECT o_custkey AS k, count(*) AS p FROM o WHERE t1 = t0 GROUP BY 1) ON k = o_custkey GROUP BY 1""")
def concurrency(spark, sf_dir):
    return intervals.concurrency(_orders(spark, sf_dir), ["o_custkey"], "t0", "t1")


@query("""WITH g AS (SELECT user_id, lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts) AS t0, epoch_us(ts) // 1000 AS t1 FROM events), w AS (SELECT user_id, max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000) AS w FROM events GROUP BY 1)
SELECT g.user_id, t0, t1 FROM g JOIN w ON w.user_id = g.user_id WHERE t0 IS NOT NULL AND 20 * (t1 - t0) >= w""")
def wide_gaps(spark, sf_dir):
    return intervals.wide_gaps(_events(spark, sf_dir), ["user_id"], "ms", 0.05)


from tallyloom.plans import growing, log_queries, run_queries  # noqa: E402, F401  (register the queries over logs)
