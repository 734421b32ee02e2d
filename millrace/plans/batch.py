"""Batch queries over the supplied tables, each with its DuckDB SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from millrace.functions.text import normalised, url_host, url_path
from millrace.operators import aggregates, joins, merge, quality, sets, texts, windows
from millrace.plans.registry import query
from millrace.session import scratch_path
from millrace.sources.schemas import SCHEMAS
from millrace.sources.tables import read_table, table, write_partitioned
from millrace.sources.versions import read_versioned, write_version


@query("read_orders", "SELECT * FROM orders")
def read_orders(spark, folder):
    return table(spark, folder, "orders")


@query("write_partitioned_orders", "SELECT * FROM orders")
def write_partitioned_orders(spark, folder):
    path = scratch_path(spark, "orders")
    write_partitioned(table(spark, folder, "orders"), path, "o_orderpriority")
    return read_table(spark, path, SCHEMAS["orders"])


@query(
    "conform_orders",
    """SELECT o_orderkey, try_cast(o_orderpriority AS INTEGER) AS o_orderpriority, CAST(o_custkey AS VARCHAR) AS o_custkey,
       CAST(NULL AS DOUBLE) AS o_discount FROM orders""",
)
def conform_orders(spark, folder):
    """Names in another case are found, a missing column is null, and so is what does not cast."""
    orders = table(spark, folder, "orders").withColumnRenamed("o_orderkey", "O_ORDERKEY")
    return quality.conform(orders, "o_orderkey bigint, o_orderpriority int, o_custkey string, o_discount double")


@query(
    "parse_event_payload",
    """WITH e AS (SELECT event_id, CASE event_id % 10 WHEN 0 THEN left(props, length(props) - 1) WHEN 1 THEN '  '
                          WHEN 2 THEN NULL WHEN 3 THEN '{"k": "x"}' ELSE props END AS p FROM events)
SELECT event_id, CASE WHEN event_id % 10 > 3 THEN CAST(json_extract_string(p, '$.k') AS INTEGER) END AS k,
       CASE WHEN event_id % 10 IN (0, 1, 3) THEN p END AS _corrupt
FROM e""",
)
def parse_event_payload(spark, folder):
    """Broken, blank and null payloads, and one of a wrong type, are planted by a rule on the id."""
    n, props = F.col("event_id") % 10, F.col("props")
    payload = F.when(n == 0, F.expr("left(props, length(props) - 1)")).when(n == 1, "  ").when(n == 3, '{"k": "x"}').when(n > 3, props)
    events = table(spark, folder, "events").select("event_id", payload.alias("props"))
    return quality.parse_payload(events, "props", "k int")


def _lines_with_orders(spark, folder):
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    kept = lines.select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
    return joins.join_facts(kept, orders.select("o_orderkey", "o_orderdate"), {"l_orderkey": "o_orderkey"})


def _line_rules():
    return {"ships_after_order": F.col("l_shipdate") >= F.col("o_orderdate"), "quantity": F.col("l_quantity") <= 49}


_LINES = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@query(
    "accepted_lines",
    f"SELECT l_orderkey, l_linenumber, l_quantity {_LINES} WHERE l_shipdate >= o_orderdate AND l_quantity <= 49",
)
def accepted_lines(spark, folder):
    good = quality.accepted(_lines_with_orders(spark, folder), _line_rules())
    return good.select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "quarantined_lines",
    f"""SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_shipdate < o_orderdate THEN 'ships_after_order' END,
       CASE WHEN l_quantity > 49 THEN 'quantity' END) AS errors {_LINES}
WHERE NOT (l_shipdate >= o_orderdate AND l_quantity <= 49)""",
)
def quarantined_lines(spark, folder):
    bad = quality.quarantined(_lines_with_orders(spark, folder), _line_rules())
    return bad.select("l_orderkey", "l_linenumber", F.array_join("_errors", ",").alias("errors"))


_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query(
    "profile_orders",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls,"
        f" count(DISTINCT {c}) AS distinct_values, CAST(min({c}) AS VARCHAR) AS lowest,"
        f" CAST(max({c}) AS VARCHAR) AS highest FROM orders"
        for c in _ORDER_COLUMNS
    ),
)
def profile_orders(spark, folder):
    return quality.profile(table(spark, folder, "orders"))


@query("orders_without_lines", "SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orders_without_lines(spark, folder):
    return quality.orphans(table(spark, folder, "orders"), table(spark, folder, "lineitem"), {"o_orderkey": "l_orderkey"})


def _order_sides(spark, folder):
    """Two overlapping lists of (customer, status) with copies."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderstatus", "o_totalprice")
    kept = ["o_custkey", "o_orderstatus"]
    return orders.where("o_totalprice < 300000").select(*kept), orders.where("o_totalprice > 150000").select(*kept)


_A = "SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice < 300000"
_B = "SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 150000"


@query(
    "reconcile_orders",
    f"""SELECT o_custkey, o_orderstatus, CASE WHEN d > 0 THEN 'a' ELSE 'b' END AS side, CAST(abs(d) AS BIGINT) AS extra
FROM (SELECT o_custkey, o_orderstatus, sum(x) AS d FROM (SELECT *, 1 AS x FROM ({_A}) UNION ALL SELECT *, -1 FROM ({_B}))
      GROUP BY ALL) WHERE d <> 0""",
)
def reconcile_orders(spark, folder):
    return quality.reconcile(*_order_sides(spark, folder))


@query(
    "duplicate_line_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def duplicate_line_keys(spark, folder):
    return quality.duplicate_keys(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "normalised_part_names",
    r"SELECT p_partkey, trim(regexp_replace(lower(p_name), '\s+', ' ', 'g')) AS name FROM part",
)
def normalised_part_names(spark, folder):
    return table(spark, folder, "part").select("p_partkey", normalised(F.col("p_name")).alias("name"))


@query(
    "canonical_page_urls",
    r"""SELECT page_id, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), '^(www|m)\.', '') AS host,
       regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages""",
)
def canonical_page_urls(spark, folder):
    url = F.col("url")
    return table(spark, folder, "pages").select("page_id", url_host(url).alias("host"), url_path(url).alias("path"))


# Words in both engines: runs of other characters than these.
_WORDS = f"regexp_extract_all(text, '{texts.WORD}')"
_PERSONAL = "|".join(f"({p})" for p in texts.PERSONAL.values())


@query(
    "redacted_documents",
    f"""WITH h AS (SELECT doc_id, string_split_regex(text, '{_PERSONAL}') AS gap, regexp_extract_all(text, '{_PERSONAL}', 1) AS e,
                  regexp_extract_all(text, '{_PERSONAL}', 2) AS i FROM documents)
SELECT doc_id, list_reduce(list_prepend('', list_transform(range(1, len(gap) + 1), lambda k: gap[k] || CASE WHEN k = len(gap) THEN ''
         WHEN e[k] <> '' THEN '<EMAIL>' ELSE '<IPV4>' END)), lambda a, b: a || b) AS redacted,
       CAST(len(list_filter(e, lambda x: x <> '')) AS BIGINT) AS n_email, CAST(len(list_filter(i, lambda x: x <> '')) AS BIGINT) AS n_ipv4
FROM h""",
)
def redacted_documents(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return texts.redact(docs, "text").drop("text")


@query(
    "document_signals",
    rf"""WITH d AS (SELECT doc_id, text, {_WORDS} AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\r\f]')) AS l
                FROM documents),
r AS (SELECT doc_id, max(n) AS longest FROM (
        SELECT doc_id, g, count(*) AS n FROM (
          SELECT doc_id, k - row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS g, line
          FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS k FROM d)) GROUP BY doc_id, line, g) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x))) / nullif(len(w), 0) AS mean_word_length,
       (length(text) - length(regexp_replace(text, '{texts.SYMBOL}', '', 'g'))) / nullif(length(text), 0) AS symbol_share,
       len(l) AS n_lines, (len(l) - len(list_distinct(l))) / nullif(len(l), 0) AS repeated_line_share,
       coalesce(longest, 0) AS longest_run
FROM d LEFT JOIN r USING (doc_id)""",
)
def document_signals(spark, folder):
    return texts.quality_signals(table(spark, folder, "documents").select("doc_id", "text"), "text").drop("text")


@query(
    "document_chunks",
    f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(0, CAST(ceil(greatest(len(w) - 200, 0) / 150) AS BIGINT) + 1)) AS chunk FROM d WHERE len(w) > 0),
t AS (SELECT *, array_to_string(w[chunk * 150 + 1:chunk * 150 + 200], ' ') AS text FROM c)
SELECT doc_id, chunk, md5(doc_id || ':' || chunk || ':' || text) AS chunk_id, chunk * 150 AS first_word,
       least(chunk * 150 + 200, len(w)) - 1 AS last_word, text FROM t""",
)
def document_chunks(spark, folder):
    return texts.chunk(table(spark, folder, "documents"), "doc_id", "text", 200, 50)


_GRAMS = f"""(SELECT doc_id, array_to_string(w[k:k + 2], ' ') AS gram FROM (
  SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM (SELECT doc_id, {_WORDS} AS w FROM documents)))"""


@query("document_ngrams", f"SELECT doc_id, gram, count(*) AS n FROM {_GRAMS} GROUP BY ALL")
def document_ngrams(spark, folder):
    return texts.ngrams(table(spark, folder, "documents"), "doc_id", "text", 3)


@query("ngram_counts", f"SELECT gram, count(*) AS occurrences, count(DISTINCT doc_id) AS texts FROM {_GRAMS} GROUP BY gram")
def ngram_counts(spark, folder):
    return texts.ngram_counts(table(spark, folder, "documents"), "text", 3)


@query(
    "enrich_customers",
    """SELECT c_custkey, c_nationkey, n_name, r_name FROM customer
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def enrich_customers(spark, folder):
    out = joins.enrich(table(spark, folder, "customer"), table(spark, folder, "nation"), {"c_nationkey": "n_nationkey"})
    out = joins.enrich(out, table(spark, folder, "region"), {"n_regionkey": "r_regionkey"})
    return out.select("c_custkey", "c_nationkey", "n_name", "r_name")


@query(
    "join_inner_revenue",
    """SELECT o_custkey, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey""",
)
def join_inner_revenue(spark, folder):
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    joined = joins.join_facts(lines, orders, {"l_orderkey": "o_orderkey"})
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return aggregates.summarise(joined, "o_custkey", F.count(F.lit(1)).alias("lines"), F.round(revenue, 2).alias("revenue"))


@query(
    "join_left_orders",
    "SELECT o_orderkey, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey",
)
def join_left_orders(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    orders = table(spark, folder, "orders").select("o_orderkey")
    return joins.join_facts(orders, lines, {"o_orderkey": "l_orderkey"}, "left").drop("l_orderkey")


@query(
    "join_full_orders_customers",
    "SELECT o_orderkey, c_custkey FROM orders FULL JOIN customer ON o_custkey = c_custkey",
)
def join_full_orders_customers(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, folder, "customer").select("c_custkey")
    return joins.join_facts(orders, customers, {"o_custkey": "c_custkey"}, "full").drop("o_custkey")


_DAILY = "SELECT user_id AS {0}_user, CAST(ts AS DATE) AS {0}_day, count(*) AS {0}s FROM events WHERE event_type = '{0}' GROUP BY ALL"


@query(
    "join_full_user_days",
    f"""SELECT * FROM ({_DAILY.format("view")}) v FULL JOIN ({_DAILY.format("purchase")}) p
ON view_user = purchase_user AND view_day = purchase_day""",
)
def join_full_user_days(spark, folder):
    """Days on which a user viewed or bought: many on either side have no partner."""
    events = table(spark, folder, "events").select("user_id", "event_type", F.col("ts").cast("date").alias("day"))
    sides = [
        events.where(F.col("event_type") == kind).groupBy(F.col("user_id").alias(f"{kind}_user"), F.col("day").alias(f"{kind}_day"))
        .agg(F.count(F.lit(1)).alias(f"{kind}s"))
        for kind in ("view", "purchase")
    ]
    return joins.join_facts(*sides, {"view_user": "purchase_user", "view_day": "purchase_day"}, "full")


@query("customers_with_orders", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def customers_with_orders(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_name")
    return joins.keep_known(customers, table(spark, folder, "orders"), {"c_custkey": "o_custkey"})


@query(
    "asof_purchase_view",
    """SELECT p.event_id, p.user_id, p.ts, v.event_id AS view_id
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""",
)
def asof_purchase_view(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type")
    left = events.where("event_type = 'purchase'").drop("event_type")
    right = events.where("event_type = 'view'")
    return joins.asof(left, right, "user_id", "ts", {"event_id": "view_id"}, "event_id", "event_id")


@query(
    "views_before_purchase",
    """SELECT v.event_id, p.event_id AS p_event_id FROM events v JOIN events p
ON v.user_id = p.user_id AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 1 HOUR
WHERE v.event_type = 'view' AND p.event_type = 'purchase'""",
)
def views_before_purchase(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type")
    views, purchases = events.where("event_type = 'view'"), events.where("event_type = 'purchase'")
    return joins.within(views, purchases, "user_id", "ts", "ts", 3600, "p_").select("event_id", "p_event_id")


@query(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, count(*) AS lines, sum(l_quantity) AS quantity,
       round(sum(l_extendedprice), 2) AS price, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY ALL""",
)
def pricing_summary(spark, folder):
    return aggregates.summarise(
        table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], F.count(F.lit(1)).alias("lines"),
        F.sum("l_quantity").alias("quantity"), F.round(F.sum("l_extendedprice"), 2).alias("price"),
        F.round(F.avg("l_discount"), 6).alias("discount"),
    )


def _levels(spark, folder, **kind):
    lines = table(spark, folder, "lineitem")
    by = ["l_returnflag", "l_linestatus"]
    return aggregates.summarise_levels(lines, by, F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"), **kind)


_LEVELS = "SELECT l_returnflag, l_linestatus, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY "


@query("lines_rollup", _LEVELS + "ROLLUP (l_returnflag, l_linestatus)")
def lines_rollup(spark, folder):
    return _levels(spark, folder)


@query("lines_cube", _LEVELS + "CUBE (l_returnflag, l_linestatus)")
def lines_cube(spark, folder):
    return _levels(spark, folder, kind="cube")


@query("lines_grouping_sets", _LEVELS + "GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def lines_grouping_sets(spark, folder):
    return _levels(spark, folder, sets=[["l_returnflag"], ["l_linestatus"], []])


@query("estimated_users")
def estimated_users(spark, folder):
    return aggregates.distinct_estimate(table(spark, folder, "events"), "event_type", "user_id")


@query(
    "order_price_quantiles",
    """SELECT o_orderpriority, p, round(quantile, 6) AS value FROM (
  SELECT o_orderpriority, unnest([0.1, 0.5, 0.9]) AS p, unnest(quantile_cont(o_totalprice, [0.1, 0.5, 0.9])) AS quantile
  FROM orders GROUP BY o_orderpriority)""".replace("unnest([0.1, 0.5, 0.9]) AS p", "unnest([0.1::DOUBLE, 0.5, 0.9]) AS p"),
)
def order_price_quantiles(spark, folder):
    out = aggregates.quantiles(table(spark, folder, "orders"), "o_orderpriority", "o_totalprice", [0.1, 0.5, 0.9])
    return out.withColumn("value", F.round("value", 6))


@query("estimated_price_quantiles")
def estimated_price_quantiles(spark, folder):
    return aggregates.quantiles_estimate(table(spark, folder, "orders"), "o_orderpriority", "o_totalprice", [0.1, 0.5, 0.9])


@query(
    "latest_valid_event",
    """SELECT event_id, ts, user_id, event_type, value, k FROM (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
WHERE k >= 10 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def latest_valid_event(spark, folder):
    parsed = quality.parse_payload(table(spark, folder, "events"), "props", "k int")
    rules = {"payload": F.col("_corrupt").isNull(), "k": F.col("k") >= 10}
    return windows.latest_per_key(quality.accepted(parsed, rules).drop("_corrupt"), "user_id", ["ts", "event_id"])


@query(
    "user_sessions",
    """WITH m AS (SELECT *, lag(ts) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(CASE WHEN ts <= before + INTERVAL 6 HOUR THEN 0 ELSE 1 END)
        OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM m)
SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS rows,
       max(value) AS highest FROM n GROUP BY user_id, session""",
)
def user_sessions(spark, folder):
    return windows.sessionise(table(spark, folder, "events"), "user_id", "ts", "event_id", 6 * 3600, F.max("value").alias("highest"))


@query(
    "event_type_changes",
    """SELECT event_id, user_id, event_type, previous FROM (
  SELECT *, lag(event_type) OVER w AS previous, row_number() OVER w AS n FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR previous IS DISTINCT FROM event_type""",
)
def event_type_changes(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type")
    return windows.changes(events, "user_id", ["ts", "event_id"], "event_type").drop("ts")


@query(
    "rolling_rows",
    """SELECT event_id, max(value) OVER w AS highest, count(*) OVER w AS n FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 6 PRECEDING)""",
)
def rolling_rows(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", "value")
    wanted = {"highest": lambda w: F.max("value").over(w), "n": lambda w: F.count(F.lit(1)).over(w)}
    return windows.rolling(events, "user_id", ["ts", "event_id"], 7, wanted).select("event_id", "highest", "n")


@query(
    "rolling_day",
    """SELECT user_id, ts, CAST(sum(n) OVER w AS BIGINT) AS rows, round(sum(s) OVER w, 6) AS total, min(lo) OVER w AS lowest,
       max(hi) OVER w AS highest
FROM (SELECT user_id, ts, count(*) AS n, sum(value) AS s, min(value) AS lo, max(value) AS hi FROM events GROUP BY ALL)
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE INTERVAL 1 DAY PRECEDING)""",
)
def rolling_day(spark, folder):
    out = windows.rolling_time(table(spark, folder, "events"), "user_id", "ts", 86_400, "value")
    return out.withColumn("total", F.round("total", 6))


@query(
    "conversation_segments",
    """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS k FROM conversations)
SELECT conv_id, k // 4 AS segment, k // 4 * 4 AS first, CAST(k % 4 AS INTEGER) AS place, turn, role, text FROM t""",
)
def conversation_segments(spark, folder):
    """Turns put together in arrays of four, and laid out flat again."""
    turns = windows.assemble(table(spark, folder, "conversations"), "conv_id", ["turn", "role", "text"], ["turn", "role", "text"], "turns", 4)
    return turns.select("conv_id", "segment", "first", F.posexplode("turns").alias("place", "t")).select("conv_id", "segment", "first", "place", "t.*")


@query(
    "top_orders_per_customer",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3""",
)
def top_orders_per_customer(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return windows.top_k(orders, "o_custkey", [F.desc("o_totalprice"), "o_orderkey"], 3)


@query(
    "stable_order_sample",
    """SELECT o_orderkey, o_custkey FROM orders
WHERE CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 20""",
)
def stable_order_sample(spark, folder):
    return sets.sample_stable(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 20)


@query(
    "stack_events",
    """SELECT event_id, user_id, NULL::DOUBLE AS value FROM events WHERE event_type = 'view'
UNION ALL SELECT event_id, NULL, value FROM events WHERE event_type <> 'view'""",
)
def stack_events(spark, folder):
    events = table(spark, folder, "events")
    views = events.where("event_type = 'view'").select("event_id", "user_id")
    return sets.stack(views, events.where("event_type <> 'view'").select("event_id", "value"))


for _name, _function, _word in (("common", sets.common, "INTERSECT"), ("minus", sets.minus, "EXCEPT")):
    for _copies in (False, True):

        @query(f"orders_{_name}" + "_copies" * _copies, f"({_A}) {_word}{' ALL' * _copies} ({_B})")
        def _set_query(spark, folder, function=_function, copies=_copies):
            return function(*_order_sides(spark, folder), copies)


@query("replayed_events_once", "SELECT event_id AS id, ts, user_id, event_type FROM events")
def replayed_events_once(spark, folder):
    """Every event comes twice, under another id the second time."""
    events = table(spark, folder, "events").select(F.col("event_id").alias("id"), "event_id", "ts", "user_id", "event_type")
    again = events.withColumn("id", F.col("id") + 1_000_000_000)
    return merge.dedupe_exact(sets.stack(events, again), ["event_id", "ts", "user_id", "event_type"], "id").drop("event_id")


@query(
    "upsert_orders",
    """SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 5 = 0 THEN 'C' ELSE o_orderstatus END AS o_orderstatus FROM orders
UNION ALL SELECT o_orderkey + 1000000000, o_custkey, 'N' FROM orders WHERE o_custkey % 7 = 0""",
)
def upsert_orders(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    old = orders.where("o_custkey % 5 = 0").withColumn("version", F.lit(1))
    changes = sets.stack(
        old.withColumn("o_orderstatus", F.lit("X")).withColumn("version", F.lit(0)),
        old.withColumn("o_orderstatus", F.lit("C")),
        orders.where("o_custkey % 7 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000)
        .withColumn("o_orderstatus", F.lit("N")).withColumn("version", F.lit(1)),
    )
    path = scratch_path(spark, "upserted")
    merge.upsert(orders, changes, "o_orderkey", "version").write.parquet(path)
    return spark.read.parquet(path)


@query(
    "upsert_order_partitions",
    """SELECT o_orderkey, o_custkey, 'C' AS o_orderstatus, o_totalprice, o_orderdate,
       CASE WHEN o_custkey % 2 = 0 THEN '3-MEDIUM' ELSE o_orderpriority END AS o_orderpriority
FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
UNION ALL SELECT * FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')""",
)
def upsert_order_partitions(spark, folder):
    """Orders of two priorities change, and half of them move to a third."""
    orders = table(spark, folder, "orders")
    path = scratch_path(spark, "orders")
    write_partitioned(orders, path, "o_orderpriority")
    moved = F.when(F.col("o_custkey") % 2 == 0, "3-MEDIUM").otherwise(F.col("o_orderpriority"))
    changes = orders.where("o_orderpriority in ('1-URGENT', '2-HIGH')").withColumn("o_orderstatus", F.lit("C"))
    changes = changes.withColumn("o_orderpriority", moved)
    merge.upsert_partitions(path, SCHEMAS["orders"], changes, "o_orderkey", "o_orderdate", "o_orderpriority")
    return read_table(spark, path, SCHEMAS["orders"])


@query(
    "upsert_order_versions",
    """SELECT o_orderkey, o_custkey, 'C' AS o_orderstatus, o_totalprice, o_orderdate, '3-MEDIUM' AS o_orderpriority
FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT'""",
)
def upsert_order_versions(spark, folder):
    """All orders of one priority move to another: its partition is empty afterwards."""
    orders = table(spark, folder, "orders")
    path = scratch_path(spark, "orders")
    write_version(orders, path, "o_orderpriority")
    changes = orders.where("o_orderpriority = '1-URGENT'").withColumn("o_orderstatus", F.lit("C"))
    changes = changes.withColumn("o_orderpriority", F.lit("3-MEDIUM"))
    merge.upsert_versioned(path, SCHEMAS["orders"], changes, "o_orderkey", "o_orderdate", "o_orderpriority")
    return read_versioned(spark, path, SCHEMAS["orders"])


@query(
    "event_versions",
    """SELECT user_id, event_id, event_type, value, ts AS valid_from, lead(ts) OVER w AS valid_to,
       lead(event_id) OVER w IS NULL AS current FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def event_versions(spark, folder):
    return windows.history(table(spark, folder, "events").drop("props"), "user_id", "ts", "event_id")


@query("python_rule_events", "SELECT event_id, value FROM events WHERE value > 50")
def python_rule_events(spark, folder):
    rule = quality.python_rule(lambda values: values > 50)
    return quality.accepted(table(spark, folder, "events").select("event_id", "value"), {"value": rule("value")})


@query("python_batches_orders", "SELECT o_orderkey, length(o_orderpriority) AS size FROM orders")
def python_batches_orders(spark, folder):
    def sized(batch):
        import pyarrow.compute as pc

        size = pc.cast(pc.utf8_length(batch.column(1)), pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), size], ["o_orderkey", "size"])

    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return quality.map_batches(orders, sized, "o_orderkey bigint, size bigint")
