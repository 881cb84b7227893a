"""One query an operator over the driver's tables, each with SQL that says the same independently.

Events stand for ordered rows (a user's events are a job's), suppliers and customers for intervals,
orders and documents for ledgers and reports.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce, geometry, validate
from ..operators import boxes, layout, ledger, mapping, numbering, overlay, reports, selection, suggestions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


JOB, ORDER = ["user_id"], ["ts", "event_id"]


def _score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows to number: sign-ups set the number, purchases take several, errors don't count, some views are pickups."""
    t = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        "user_id", "event_id", "ts", F.when(t == "signup", F.floor("value")).cast("int").alias("override"),
        F.when(t == "purchase", F.col("event_id") % 3).cast("int").alias("rest"), (t == "error").alias("excluded"),
        ((t == "view") & (F.col("event_id") % 11 == 0)).alias("pickup"), F.lit(1).alias("start"),
        F.when(t == "click", "1").when(t == "purchase", "2").when((t == "view") & (F.col("event_id") % 5 == 0), "3").alias("kind"),
    )


_SCORE = """e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
  CASE WHEN event_type = 'signup' THEN floor(value)::INT END AS ov, CASE WHEN event_type = 'purchase' THEN event_id % 3 END AS rest,
  event_type = 'error' AS ex, event_type = 'view' AND event_id % 11 = 0 AS pk,
  CASE WHEN event_type = 'click' THEN '1' WHEN event_type = 'purchase' THEN '2' WHEN event_type = 'view' AND event_id % 5 = 0 THEN '3' END AS kind FROM events),
f AS (SELECT *, sum((NOT ex)::INT) OVER (PARTITION BY user_id ORDER BY rn) = 1 AND NOT ex AS opening FROM e)"""
_LABEL = "CASE WHEN f.ex THEN NULL WHEN f.pk THEN CASE WHEN f.opening THEN 0 ELSE {v} - 1 END ELSE coalesce(f.ov, {v}) END"
_NEXT = """CASE WHEN f.ex THEN {v} WHEN f.pk THEN CASE WHEN f.rest > 0 THEN CASE WHEN f.opening THEN 0 ELSE {v} - 1 END + f.rest WHEN f.opening THEN 1 ELSE {v} END
  ELSE coalesce(f.ov, {v}) + CASE WHEN f.rest > 0 THEN f.rest ELSE 1 END END"""
_V0 = "coalesce(f.ov, 1)"


@query(f"""WITH RECURSIVE {_SCORE},
r AS (SELECT user_id, event_id, rn, {_LABEL.format(v=_V0)} AS label, {_NEXT.format(v=_V0)} AS v FROM f WHERE rn = 1
  UNION ALL SELECT f.user_id, f.event_id, f.rn, {_LABEL.format(v="r.v")}, {_NEXT.format(v="r.v")} FROM r JOIN f ON f.user_id = r.user_id AND f.rn = r.rn + 1)
SELECT user_id, event_id, label::BIGINT AS label FROM r""")
def numbering_plain(spark, sf_dir):
    return numbering.numbered(_score(spark, sf_dir), JOB, ORDER).select("user_id", "event_id", "label")


@query(f"""WITH RECURSIVE {_SCORE},
r AS (SELECT user_id, event_id, rn, {_LABEL.format(v=_V0)} AS label, {_NEXT.format(v=_V0)} AS v FROM f WHERE rn = 1
  UNION ALL SELECT f.user_id, f.event_id, f.rn, {_LABEL.format(v="r.v")}, {_NEXT.format(v="r.v")} FROM r JOIN f ON f.user_id = r.user_id AND f.rn = r.rn + 1)
SELECT user_id, arg_min(label, rn) FILTER (WHERE label IS NOT NULL)::BIGINT AS first_label FROM r GROUP BY user_id HAVING count(label) > 0""")
def first_label(spark, sf_dir):
    return numbering.first_labels(numbering.numbered(_score(spark, sf_dir), JOB, ORDER), JOB, ORDER)


# a group is named by the row of its first "1"; found row by row, not by windows
_GROUPS = """k AS (SELECT *, CASE WHEN kind IN ('1', '2') AND NOT ex AND NOT pk THEN kind END AS k FROM f),
s AS (SELECT user_id, rn, k, CASE WHEN k = '1' THEN rn END AS head, k AS state FROM k WHERE rn = 1
  UNION ALL SELECT k.user_id, k.rn, k.k, CASE WHEN k.k = '1' AND s.state = '1' THEN s.head WHEN k.k = '1' THEN k.rn WHEN k.k = '2' AND s.head IS NOT NULL THEN s.head END, k.k
  FROM s JOIN k ON k.user_id = s.user_id AND k.rn = s.rn + 1),
z AS (SELECT user_id, head, count(*) FILTER (WHERE k = '1') AS n1, count(*) FILTER (WHERE k = '2') AS n2 FROM s WHERE head IS NOT NULL GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY head) - 1 AS gid FROM z WHERE n2 > 0),
b AS (SELECT k.*, g.gid, g.n1, g.n2, s.head, CASE WHEN g.gid IS NOT NULL THEN k.rn - g.head - CASE WHEN k.k = '2' THEN g.n1 ELSE 0 END END AS branch
  FROM k JOIN s USING (user_id, rn) LEFT JOIN g ON g.user_id = k.user_id AND g.head = s.head)"""


@query(f"""WITH RECURSIVE {_SCORE}, {_GROUPS}
SELECT user_id, event_id, gid::BIGINT AS group_id, branch::BIGINT AS branch_index, n1::BIGINT AS first_len, n2::BIGINT AS second_len,
  CASE WHEN kind IS NULL THEN NULL WHEN ex THEN 'excluded_from_counting' WHEN k IS NULL AND kind NOT IN ('1', '2') THEN 'invalid_kind' WHEN pk THEN 'pickup_blocked'
    WHEN gid IS NULL THEN CASE WHEN head IS NULL THEN 'orphan_ending2' ELSE 'incomplete_group' END END AS ignored FROM b""")
def ending_groups(spark, sf_dir):
    got = numbering.ending_groups(_score(spark, sf_dir), JOB, ORDER)
    return got.select("user_id", "event_id", "group_id", "branch_index", "first_len", "second_len", "ignored")


_CLOSED = "CASE WHEN r.gid IS NOT NULL AND f.gid IS DISTINCT FROM r.gid THEN greatest(r.v, coalesce(r.n1, r.v), coalesce(r.n2, r.v)) ELSE r.v END"


@query(f"""WITH RECURSIVE {_SCORE}, {_GROUPS},
r AS (SELECT user_id, event_id, 0 AS rn, NULL::BIGINT AS label, coalesce(ov, 1)::BIGINT AS v, NULL::BIGINT AS gid, NULL::BIGINT AS st, NULL::BIGINT AS n1, NULL::BIGINT AS n2 FROM b WHERE rn = 1
  UNION ALL
  SELECT user_id, event_id, rn,
    CASE WHEN ex THEN NULL WHEN pk THEN CASE WHEN opening THEN 0 ELSE c - 1 END WHEN gid IS NOT NULL THEN lab ELSE coalesce(ov, c) END,
    CASE WHEN ex THEN c WHEN pk THEN CASE WHEN rest > 0 THEN CASE WHEN opening THEN 0 ELSE c - 1 END + rest WHEN opening THEN 1 ELSE c END
      WHEN gid IS NOT NULL THEN CASE WHEN k = '1' THEN lab + takes ELSE c END ELSE coalesce(ov, c) + takes END,
    CASE WHEN ex AND same THEN pgid ELSE gid END, st, CASE WHEN gid IS NOT NULL AND k = '1' THEN lab + takes ELSE n1 END, CASE WHEN gid IS NOT NULL AND k = '2' THEN lab + takes ELSE n2 END
  FROM (SELECT *, CASE WHEN k = '1' THEN coalesce(ov, n1, st) ELSE coalesce(ov, n2, st) END AS lab, CASE WHEN rest > 0 THEN rest ELSE 1 END AS takes FROM
    (SELECT f.user_id, f.event_id, f.rn, f.ex, f.pk, f.opening, f.ov, f.rest, f.k, f.gid, r.gid AS pgid, f.gid IS NOT DISTINCT FROM r.gid AS same, {_CLOSED} AS c,
      CASE WHEN f.gid IS NOT DISTINCT FROM r.gid AND f.gid IS NOT NULL THEN r.st WHEN f.gid IS NOT NULL THEN coalesce(f.ov, {_CLOSED}) END AS st,
      CASE WHEN f.gid IS NOT DISTINCT FROM r.gid THEN r.n1 END AS n1, CASE WHEN f.gid IS NOT DISTINCT FROM r.gid THEN r.n2 END AS n2
     FROM r JOIN b AS f ON f.user_id = r.user_id AND f.rn = r.rn + 1)))
SELECT user_id, event_id, label::BIGINT AS label FROM r WHERE rn > 0""")
def numbering_endings(spark, sf_dir):
    return numbering.numbered_with_endings(_score(spark, sf_dir), JOB, ORDER).select("user_id", "event_id", "label")


@query("""WITH s AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'click' THEN '1' ELSE '2' END AS kind FROM events WHERE event_type IN ('click', 'purchase')),
p AS (SELECT *, lag(kind) OVER w AS prev, lead(kind) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
q AS (SELECT *, kind = '2' AND coalesce(prev = '1', false) AS second FROM p)
SELECT user_id, event_id, sum((NOT second)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS pair_no,
  CASE WHEN second THEN 2 ELSE 1 END::INT AS slot, second OR (kind = '1' AND coalesce(nxt = '2', false)) AS is_paired FROM q""")
def ending_pairs(spark, sf_dir):
    starts = _score(spark, sf_dir).filter("kind IN ('1', '2')")
    return numbering.ending_pairs(starts, JOB, ORDER).select("user_id", "event_id", "pair_no", "slot", "is_paired")


@query("""WITH e AS (SELECT *, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS part FROM events)
SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, part ORDER BY ts, event_id) AS carried FROM e""")
def carry_state(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("state", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return numbering.carried(e, JOB, ORDER, "state", F.col("event_type") == "error").select("user_id", "event_id", "carried")


@query("""WITH p AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1 AS parent_index FROM customer),
o AS (SELECT o_orderkey, o_orderdate, p.* FROM orders JOIN p ON o_custkey = c_custkey)
SELECT o_orderkey, parent_index::INT AS parent_index, (row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate, o_orderkey) - 1)::INT AS local_index,
  (row_number() OVER (PARTITION BY c_nationkey ORDER BY parent_index, o_orderdate, o_orderkey) - 1)::INT AS global_index FROM o""")
def reindex_order(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("cust"), "c_acctbal")
    o = read(spark, sf_dir, "orders").join(c.select("nation", F.col("cust")), F.col("o_custkey") == F.col("cust"))
    got = numbering.reindexed(o, c, ["nation"], "cust", ["c_acctbal", "cust"], ["o_orderdate", "o_orderkey"])
    return got.select("o_orderkey", "parent_index", "local_index", "global_index")


@query("""WITH e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'view' THEN -1 WHEN 'error' THEN -2 ELSE 1 END AS d FROM events),
s AS (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM e)
SELECT user_id, event_id, (t - least(0, min(t) OVER (PARTITION BY user_id ORDER BY ts, event_id)))::BIGINT AS counter FROM s""")
def running_counter(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("d", F.expr("CASE event_type WHEN 'view' THEN -1 WHEN 'error' THEN -2 ELSE 1 END").cast("long"))
    return numbering.running_counter(e, JOB, ORDER, "d").select("user_id", "event_id", F.col("counter").cast("long").alias("counter"))


# layout


@query("""WITH s AS (SELECT s_suppkey, s_nationkey, s_acctbal - 100 AS lo, s_acctbal + 100 AS hi, s_suppkey % 4 = 0 AS odd FROM supplier),
c AS (SELECT c_custkey, c_nationkey, c_acctbal - 50 AS l, c_acctbal + 50 AS h FROM customer),
x AS (SELECT c_custkey, s_suppkey, odd, lo, least(h, hi) - greatest(l, lo) + 5 AS overlap, abs((l + h) / 2 - (lo + hi) / 2) AS away FROM c JOIN s ON c_nationkey = s_nationkey),
n AS (SELECT c_custkey, count(*) FILTER (WHERE overlap > 0) AS hits, count(*) FILTER (WHERE overlap > 0 AND NOT odd) AS sound, count(*) FILTER (WHERE NOT odd) AS plain FROM x GROUP BY c_custkey),
y AS (SELECT x.* FROM x JOIN n USING (c_custkey) WHERE CASE WHEN sound > 0 THEN overlap > 0 AND NOT odd WHEN hits = 1 THEN overlap > 0 WHEN plain > 0 THEN NOT odd ELSE true END)
SELECT c_custkey, s_suppkey, round(overlap, 2) AS overlap FROM y QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY overlap DESC, away, lo, s_suppkey) = 1""")
def interval_assign(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("page"), "s_suppkey", (F.col("s_acctbal") - 100).alias("lo"), (F.col("s_acctbal") + 100).alias("hi"), (F.col("s_suppkey") % 4 == 0).alias("odd"))
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("page"), "c_custkey", (F.col("c_acctbal") - 50).alias("l"), (F.col("c_acctbal") + 50).alias("h"))
    got = layout.assign_intervals(c, s, ["page"], "c_custkey", "s_suppkey", "l", "h", "lo", "hi", "odd")
    return got.select("c_custkey", "s_suppkey", F.round("overlap", 2).alias("overlap"))


@query("""WITH m AS (SELECT s_nationkey, median(s_acctbal) AS m FROM supplier WHERE s_acctbal > 0 GROUP BY ALL)
SELECT s_suppkey, round(m, 4) AS median_height, coalesce(s_acctbal > 0 AND s_acctbal < 0.65 * m, false) AS is_short FROM supplier LEFT JOIN m USING (s_nationkey)""")
def short_outliers(spark, sf_dir):
    got = layout.short_outliers(read(spark, sf_dir, "supplier"), ["s_nationkey"], "s_acctbal")
    return got.select("s_suppkey", F.round("median_height", 4).alias("median_height"), "is_short")


@query("""WITH c AS (SELECT n_nationkey, n_regionkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL)
SELECT a.n_nationkey, a.n, CASE WHEN count(b.n) >= 2 THEN median(b.n::DOUBLE) END AS others_median
FROM c a LEFT JOIN c b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey GROUP BY ALL""")
def neighbor_median(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    n = read(spark, sf_dir, "nation").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey", "n_regionkey").agg(F.count("s_suppkey").alias("n"))
    return layout.neighbour_median(n, ["n_regionkey"], "n_nationkey", "n").select("n_nationkey", "n", "others_median")


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
SELECT o_custkey, o_orderpriority, count(*) AS n_later FROM o WHERE rn > 1 AND o_orderpriority <> '' GROUP BY ALL HAVING count(*) >= 2""")
def duplicate_later(spark, sf_dir):
    return layout.repeated_later(read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderpriority")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def empty_parents(spark, sf_dir):
    urgent = read(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    return layout.empty_parents(read(spark, sf_dir, "customer"), urgent, "c_custkey", "o_custkey").select("c_custkey")


@query("""SELECT s_suppkey, (SELECT max(b.s_acctbal) FROM supplier b WHERE b.s_nationkey = a.s_nationkey AND b.s_acctbal < a.s_acctbal) AS prev_at,
  (SELECT min(b.s_acctbal) FROM supplier b WHERE b.s_nationkey = a.s_nationkey AND b.s_acctbal > a.s_acctbal) AS next_at FROM supplier a""")
def prev_next(spark, sf_dir):
    return layout.neighbours(read(spark, sf_dir, "supplier"), ["s_nationkey"], "s_acctbal").select("s_suppkey", "prev_at", "next_at")


@query("""SELECT l_orderkey, min(l_quantity) AS x_left, min(l_extendedprice) AS y_top, max(l_quantity) AS x_right, max(l_extendedprice) AS y_bottom FROM lineitem GROUP BY l_orderkey""")
def bbox(spark, sf_dir):
    return layout.bounding_box(read(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity", "l_extendedprice", "l_quantity", "l_extendedprice")


@query("""WITH m AS (SELECT l_returnflag, median(l_quantity) AS med, count(l_quantity) AS n FROM lineitem GROUP BY ALL),
d AS (SELECT l_returnflag, median(abs(l_quantity - med)) AS mad FROM lineitem JOIN m USING (l_returnflag) GROUP BY ALL)
SELECT l_returnflag, med AS median, n, mad, n >= 6 AND mad <= 13 AND abs(med) <= 30 AS accepted FROM m JOIN d USING (l_returnflag)""")
def mad_gate(spark, sf_dir):
    return layout.deviation_gate(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", 6, 13.0, 30.0)


@query("""WITH RECURSIVE s AS (SELECT s_suppkey AS k, s_nationkey AS p, s_acctbal AS t, s_acctbal + 400 + 10 * (s_suppkey % 30) AS b, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS i FROM supplier),
l AS (SELECT x.p, x.i AS xi, y.i AS yi FROM s x JOIN s y ON x.p = y.p AND least(x.b - x.t, y.b - y.t) >= 0.55 * greatest(x.b - x.t, y.b - y.t)
  AND abs((x.t + x.b - y.t - y.b) / 2) <= 0.45 * greatest(x.b - x.t, y.b - y.t) AND least(x.b, y.b) - greatest(x.t, y.t) >= 0.30 * least(x.b - x.t, y.b - y.t)),
r AS (SELECT p, i AS xi, i AS yi FROM s UNION SELECT r.p, r.xi, l.yi FROM r JOIN l ON l.p = r.p AND l.xi = r.yi),
h AS (SELECT p, xi, min(yi) AS hi FROM r GROUP BY ALL)
SELECT s.k AS s_suppkey, t.k AS row_head FROM h JOIN s ON s.p = h.p AND s.i = h.xi JOIN s t ON t.p = h.p AND t.i = h.hi""")
def connected_rows(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal", (F.col("s_acctbal") + 400 + 10 * (F.col("s_suppkey") % 30)).alias("bottom"))
    return layout.same_row_groups(s, ["s_nationkey"], "s_suppkey", "s_acctbal", "bottom", ["s_acctbal", "s_suppkey"]).select("s_suppkey", "row_head")


# boxes


@query("""WITH b AS (SELECT user_id, (epoch_us(ts) // 1000000) AS x_left, lead((epoch_us(ts) // 1000000)) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts) AS nxt,
  row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts) - 1 AS local_index, (epoch_us(date_trunc('day', ts)::TIMESTAMP) // 1000000) + 86400 AS tail FROM events)
SELECT user_id, x_left, coalesce(nxt, tail) AS x_right, local_index::INT AS local_index FROM b WHERE coalesce(nxt, tail) - x_left >= 600""")
def lead_boxes(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), F.unix_timestamp("ts").alias("at"))
    tail = F.unix_timestamp(F.col("day").cast("timestamp")) + 86400
    return boxes.lead_boxes(e, ["user_id", "day"], "at", tail, 600).select("user_id", "x_left", "x_right", "local_index")


@query("""WITH RECURSIVE e AS (SELECT user_id, (epoch_us(ts) // 1000000)::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events),
r AS (SELECT user_id, t, rn, t AS kept FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.t, e.rn, CASE WHEN e.t - r.kept > 43200 THEN e.t ELSE r.kept END FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT DISTINCT user_id, kept AS kept_at FROM r""")
def greedy_dedupe(spark, sf_dir):
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.unix_timestamp("ts").cast("double")).alias("all"))
    return e.select("user_id", F.explode(boxes.keep_apart(F.col("all"), 43200.0)).alias("kept_at"))


@query("""WITH g AS (SELECT user_id, (epoch_us(ts) // 1000000) - lag((epoch_us(ts) // 1000000)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)
SELECT user_id, median(gap) AS median_gap, count(*) AS n_gaps FROM g WHERE gap > 60 GROUP BY user_id""")
def tail_estimate(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.unix_timestamp("ts").alias("at"))
    return boxes.tail_estimate(e, ["user_id"], "at", 60)


@query("""WITH e AS (SELECT user_id, (epoch_us(ts) // 1000000) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events),
w AS (SELECT a.user_id, a.rn AS window_no, min(b.t) AS first_at, max(b.t) AS last_at, list(b.t ORDER BY b.rn) AS l FROM e a JOIN e b ON a.user_id = b.user_id AND b.rn BETWEEN a.rn AND a.rn + 4 GROUP BY ALL HAVING count(*) = 5),
d AS (SELECT *, round(list_sum(list_transform(range(1, 5), lambda i: abs(l[i + 1] - l[i] - (last_at - first_at) / 4.0::DOUBLE))), 6) AS deviation FROM w)
SELECT user_id, window_no::INT AS window_no, deviation, first_at::DOUBLE AS first_at, last_at::DOUBLE AS last_at FROM d QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY deviation, window_no) = 1""")
def five_window(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.unix_timestamp("ts").alias("at"))
    return boxes.best_window(e, ["user_id"], "at")


@query("""WITH e AS (SELECT user_id, (epoch_us(ts) // 1000000) AS t FROM events),
n AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 86400 THEN 1 ELSE 0 END AS b FROM e),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t) AS session FROM n)
SELECT user_id, session::BIGINT AS session, min(t) AS first_at, max(t) AS last_at, count(*) AS n_points FROM s GROUP BY ALL HAVING count(*) >= 3""")
def gap_sessions(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.unix_timestamp("ts").alias("at"))
    return boxes.gap_sessions(e, ["user_id"], "at", 86400, 3)


@query("""WITH d AS (SELECT event_type, datediff('day', DATE '2020-01-01', ts::DATE) AS day, count(*) AS n FROM events GROUP BY ALL),
i AS (SELECT *, day - row_number() OVER (PARTITION BY event_type ORDER BY day) AS g FROM d WHERE n > (SELECT avg(n) FROM d))
SELECT event_type, min(day)::INT AS first_at, max(day)::INT AS last_at, ((min(day) + max(day)) // 2)::BIGINT AS centre FROM i GROUP BY event_type, g""")
def runs_above(spark, sf_dir):
    d = read(spark, sf_dir, "events").groupBy("event_type", F.datediff(F.to_date("ts"), F.lit("2020-01-01").cast("date")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    mean = d.agg(F.avg("n")).first()[0]
    return boxes.runs_above(d, ["event_type"], "day", "n", mean)


@query("""WITH n AS (SELECT *, n_nationkey * 10.0 AS l, n_nationkey * 10.0 + 100 AS r FROM nation), c AS (SELECT s_nationkey, list(DISTINCT 10.0 * s_nationkey + (s_suppkey % 97) + 1 ORDER BY 10.0 * s_nationkey + (s_suppkey % 97) + 1) AS cuts FROM supplier GROUP BY ALL),
e AS (SELECT n_nationkey, unnest(list_concat([l], coalesce(cuts, []))) AS x_left, l, r, cuts FROM n LEFT JOIN c ON s_nationkey = n_nationkey)
SELECT n_nationkey, (row_number() OVER (PARTITION BY n_nationkey ORDER BY x_left) - 1)::INT AS local_index, x_left::DOUBLE AS x_left, coalesce(lead(x_left) OVER (PARTITION BY n_nationkey ORDER BY x_left), r)::DOUBLE AS x_right FROM e""")
def cut_boxes(spark, sf_dir):
    cut = (F.col("s_nationkey") * 10 + F.col("s_suppkey") % 97 + 1).cast("double")
    c = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_set(cut)).alias("cuts"))
    n = read(spark, sf_dir, "nation").join(c, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    n = n.withColumns({"l": (F.col("n_nationkey") * 10).cast("double"), "r": (F.col("n_nationkey") * 10 + 100).cast("double")})
    return boxes.boxes_from_cuts(n, ["n_nationkey"], "l", "r", "cuts")


# mapping


@query("""WITH c AS (SELECT conv_id, turn, sum((role = 'system')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS page_no, (role = 'user')::INT AS u FROM conversations)
SELECT conv_id, turn, page_no::BIGINT AS page_no, sum(u) OVER (PARTITION BY conv_id, page_no ORDER BY turn)::BIGINT AS row_no FROM c""")
def segmentation(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumns({"sys": F.col("role") == "system", "usr": F.col("role") == "user"})
    return mapping.segmented(c, ["conv_id"], ["turn"], "sys", "usr").select("conv_id", "turn", "page_no", "row_no")


@query("""WITH s AS (SELECT c_nationkey AS p, c_custkey, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)),
t AS (SELECT s_nationkey AS p, s_name, row_number() OVER w - 1 AS j, count(*) OVER (PARTITION BY s_nationkey) AS m FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)),
z AS (SELECT p, max(m) AS m FROM t GROUP BY p)
SELECT c_custkey, i::INT AS slot_no, s_name FROM s JOIN z USING (p) JOIN t ON t.p = s.p AND t.j = CASE WHEN n > 1 THEN round_even(i * (z.m - 1) / (n - 1)::DOUBLE, 0) ELSE 0 END""")
def resample_labels(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("page"), "c_custkey")
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("page"), "s_suppkey", "s_name")
    return mapping.resampled(c, s, ["page"], ["c_custkey"], ["s_suppkey"], "s_name").select("c_custkey", "slot_no", "s_name")


@query("""SELECT p_partkey, l_suppkey FROM (SELECT DISTINCT l_partkey, l_suppkey, l_quantity, l_linenumber FROM lineitem) JOIN part ON p_partkey = l_partkey
QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY abs(l_quantity - p_size), l_linenumber, length(p_name || l_suppkey::VARCHAR) DESC, l_suppkey) = 1""")
def candidate_choice(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name")
    c = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey", "l_quantity", "l_linenumber").distinct()
    c = c.join(p.select("p_partkey", F.col("p_name").alias("name")), "p_partkey").withColumn("len", F.length(F.concat("name", F.col("l_suppkey").cast("string"))))
    return mapping.best_candidate(p, c, ["p_partkey"], "l_suppkey", "l_quantity", "p_size", "l_linenumber", "len").select("p_partkey", "l_suppkey")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def manifest_last_entry(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return mapping.last_entries(e.withColumn("ord", F.col("event_id")), ["user_id", "event_type"], "ord").select("user_id", "event_type", "event_id", "value")


@query("""WITH g AS (SELECT s_nationkey, s_acctbal, lag(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS prev FROM supplier)
SELECT s_nationkey, NOT bool_or(NOT (s_acctbal >= 0 AND s_acctbal + 10 <= 12000) OR coalesce(s_acctbal < prev - 1, false)) AS in_order, count(*) AS n_guides FROM g GROUP BY ALL""")
def guide_order(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").withColumns({"bottom": F.col("s_acctbal") + 10, "height": F.lit(12000.0)})
    return mapping.guides_in_order(s, ["s_nationkey"], "s_suppkey", "s_acctbal", "bottom", "height")


# overlays and edits


@query("""SELECT doc_id, lang AS word, 'base' AS origin FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND source <> 'src1'
UNION ALL SELECT doc_id, quality::VARCHAR AS word, 'overlay' AS origin FROM labels""")
def overlay_merge(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang").alias("word"))
    ruled = spark.createDataFrame([("src1",)], "source string")
    over = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("word"))
    return overlay.overlaid(d, over, "doc_id", pages=ruled, page="source").select("doc_id", "word", "origin")


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(CASE WHEN quality = 1 THEN 'good' END, d.lang) AS lang, quality
FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def document_upsert(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang")
    new = read(spark, sf_dir, "labels").select("doc_id", "quality", F.when(F.col("quality") == 1, "good").alias("lang"))
    return overlay.upserted(d, new, ["doc_id"]).select("doc_id", "lang", "quality")


@query("""SELECT o_orderkey, o_orderstatus AS before_value, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'F' ELSE o_orderstatus END AS after_value FROM orders
WHERE o_orderstatus IS DISTINCT FROM CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'F' ELSE o_orderstatus END""")
def null_safe_diff(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    k = F.col("o_orderkey") % 3
    return overlay.changed(o, o.withColumn("o_orderstatus", F.when(k == 0, None).when(k == 1, "F").otherwise(F.col("o_orderstatus"))), ["o_orderkey"], "o_orderstatus")


@query("""WITH r AS (SELECT item_id + 3 AS id FROM benchmark UNION ALL SELECT doc_id FROM labels WHERE toxic = 0 UNION ALL SELECT doc_id + 7 FROM documents WHERE doc_id % 3 = 0), c AS (SELECT id, count(*) AS n FROM r GROUP BY id)
SELECT (SELECT count(*) FROM c WHERE id NOT IN (SELECT doc_id FROM documents)) AS unknown, (SELECT count(*) FROM c WHERE n > 1) AS duplicate,
  (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT id FROM c)) AS missing, false AS accepted""")
def set_equality(spark, sf_dir):
    want = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    back = read(spark, sf_dir, "benchmark").select((F.col("item_id") + 3).alias("id"))
    back = back.unionByName(read(spark, sf_dir, "labels").filter("toxic = 0").select(F.col("doc_id").alias("id"))).unionByName(want.filter("id % 3 = 0").select((F.col("id") + 7).alias("id")))
    return overlay.key_difference(want, back, "id")


@query("""SELECT a.s_nationkey, a.s_suppkey, b.s_suppkey AS earlier FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND b.s_suppkey < a.s_suppkey
AND (least(a.s_acctbal, b.s_acctbal) + 300 - greatest(a.s_acctbal, b.s_acctbal)) / 300 >= 0.5""")
def strong_overlap(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    rect = lambda c: {"left": F.lit(0.0), "right": F.lit(1.0), "top": c("s_acctbal"), "bottom": c("s_acctbal") + 300}
    return overlay.overlapping_pairs(s, ["s_nationkey"], "s_suppkey", "s_suppkey", lambda a, b: coerce.strongly_overlap(rect(a), rect(b)))


@query("""SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, count(*) AS n_applied FROM events WHERE value BETWEEN 5 AND 1000 AND event_type <> 'error' GROUP BY ALL""")
def edit_last_wins(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    why = F.when(F.col("event_type") == "error", "unsupported_edit_type").when(~F.col("value").between(5, 1000), "value_out_of_range")
    return overlay.last_wins(e, ["user_id", "event_type"], ["ts", "event_id"], "value", why)


_EDITS = """ed AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'set_measure_number' WHEN 'purchase' THEN 'set_rest_measure' WHEN 'click' THEN 'set_ending' WHEN 'view' THEN 'set_system_start' ELSE 'paint' END AS type,
  CASE WHEN event_id % 13 = 0 THEN '' ELSE (event_id % 40)::VARCHAR END AS target_id, CASE WHEN event_type = 'click' THEN (event_id % 4)::VARCHAR WHEN event_id % 17 = 0 THEN 'x' ELSE (floor(value) - 3)::INT::VARCHAR END AS value FROM events)"""


@query(f"""WITH {_EDITS}, m AS (SELECT g AS id, g % 9 = 0 AS ex FROM (SELECT unnest(range(0, 35)) AS g))
SELECT user_id, event_id, CASE WHEN type = 'paint' THEN 'unsupported_edit_type' WHEN type = 'set_system_start' AND (target_id = '' OR try_cast(target_id AS INT) >= 30) THEN 'unknown_system_id'
  WHEN type <> 'set_system_start' AND target_id = '' THEN 'missing_measure_id' WHEN type <> 'set_system_start' AND ex IS NULL THEN 'unknown_measure_id' WHEN type <> 'set_system_start' AND ex THEN 'measure_excluded_from_counting'
  WHEN type IN ('set_system_start', 'set_measure_number') AND try_cast(value AS INT) IS NULL THEN 'invalid_value' WHEN type IN ('set_system_start', 'set_measure_number') AND try_cast(value AS INT) NOT BETWEEN 0 AND 1000000 THEN 'value_out_of_range'
  WHEN type = 'set_rest_measure' AND coalesce(try_cast(value AS INT) < 0, true) THEN 'invalid_measure_count' WHEN type = 'set_ending' AND value NOT IN ('1', '2') THEN 'invalid_ending_value' END AS reject_reason
FROM ed LEFT JOIN m ON m.id::VARCHAR = target_id""")
def edit_reasons(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    kind = F.expr("CASE event_type WHEN 'signup' THEN 'set_measure_number' WHEN 'purchase' THEN 'set_rest_measure' WHEN 'click' THEN 'set_ending' WHEN 'view' THEN 'set_system_start' ELSE 'paint' END")
    value = F.when(F.col("event_type") == "click", (F.col("event_id") % 4).cast("string")).when(F.col("event_id") % 17 == 0, "x").otherwise((F.floor("value") - 3).cast("int").cast("string"))
    e = e.select("user_id", "event_id", kind.alias("type"), F.when(F.col("event_id") % 13 == 0, "").otherwise((F.col("event_id") % 40).cast("string")).alias("target_id"), value.alias("value"))
    users = e.select("user_id").distinct()
    m = users.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(34))).alias("g")).select("user_id", F.col("g").cast("string").alias("measure_id"), (F.col("g") % 9 == 0).alias("excluded"))
    s = users.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(29)).cast("array<string>")).alias("system_id"))
    return overlay.judged_edits(e, m, s, ["user_id"]).select("user_id", "event_id", "reject_reason")


@query("""WITH e AS (SELECT user_id, event_id % 3 AS sys, event_id % 12 AS m, event_type = 'click' AS flag, ts, event_id FROM events WHERE event_type IN ('click', 'error')),
l AS (SELECT user_id, sys, arg_max(m, (ts, event_id)) AS m, max((ts, event_id)) AS at FROM e WHERE flag GROUP BY ALL)
SELECT user_id, sys, m FROM l WHERE NOT EXISTS (SELECT 1 FROM e WHERE NOT flag AND e.user_id = l.user_id AND e.sys = l.sys AND e.m = l.m AND (e.ts, e.event_id) > l.at)""")
def pickup_exclusive(spark, sf_dir):
    e = read(spark, sf_dir, "events").filter("event_type IN ('click', 'error')")
    e = e.select("user_id", (F.col("event_id") % 3).alias("sys"), (F.col("event_id") % 12).alias("m"), (F.col("event_type") == "click").alias("flag"), "ts", "event_id")
    return overlay.exclusive_flags(e, ["user_id", "sys"], "m", ["ts", "event_id"], "flag")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50")
def history_cap(spark, sf_dir):
    return overlay.keep_last(read(spark, sf_dir, "events"), JOB, ORDER, 50).select("user_id", "event_id")


# reports


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(quality = 1, false) AND d.doc_id IS NOT NULL AS success,
  CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'not_expected' WHEN quality <> 1 THEN toxic::VARCHAR END AS failure FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def full_outer_status(spark, sf_dir):
    got = reports.full_status(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id", F.col("quality") == 1, "toxic")
    return got.select("doc_id", "success", "failure")


@query("""SELECT user_id, reason, sum(n)::BIGINT AS n FROM (SELECT user_id, event_type AS reason, 1 AS n FROM events UNION ALL SELECT user_id, 'late', event_id % 3 FROM events) GROUP BY ALL""")
def reason_counts(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.create_map("event_type", F.lit(1).cast("long"), F.lit("late"), F.col("event_id") % 3).alias("reasons"))
    return reports.reason_counts(e, ["user_id"], "reasons")


_CLUE_SQL = {
    "transcription_did_not_complete": "transcription did not complete", "export_failed": "could not export|export failed", "no_mxl_files": "no_mxl|no mxl|no .*mxl",
    "no_parts_or_measures": "parts_or_measures_zero|no parts|no measures", "staff_system_warning": "staff|stave|system", "measure_warning": "measure",
    "timeout_or_killed": "timeout|timed out|killed|137", "crash_or_exception": "exception|traceback|error: process completed with exit code",
}
_SAID_SQL = "text || chr(10) || ['No measures', 'job KILLED', 'no file of mxl', 'Export failed', ''][doc_id % 5 + 1]"


@query("SELECT doc_id, list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower({_SAID_SQL}), '{p}') THEN '{n}' END" for n, p in _CLUE_SQL.items()) + "], lambda x: x IS NOT NULL)) AS clues FROM documents")
def log_clues(spark, sf_dir):
    said = F.element_at(F.array(*(F.lit(x) for x in ("No measures", "job KILLED", "no file of mxl", "Export failed", ""))), (F.col("doc_id") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", reports.clues(F.concat("text", F.lit("\n"), said)).alias("clues"))


@query("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l, CASE WHEN quality = 0 THEN 400 ELSE 80 END AS n FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, (i - 1)::INT AS line_no, l[i] AS line FROM (SELECT doc_id, l, n, unnest(range(1, len(l) + 1)) AS i FROM d) WHERE i > len(l) - n""")
def tail_lines(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return reports.last_lines(d, "text", F.when(F.col("quality") == 0, 400).otherwise(80)).select("doc_id", "line_no", "line")


@query("""WITH a AS (SELECT o_custkey, o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'retry' WHEN 1 THEN 'raster' ELSE 'grid' END AS kind, o_orderstatus = 'F' AS ok FROM orders),
l AS (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM a GROUP BY ALL)
SELECT l.o_custkey, n AS n_attempts, a.ok AS succeeded, a.ok AND kind = 'retry' AND bad AS recovered_on_retry, a.ok AND kind = 'raster' AND bad AS recovered_on_raster, a.ok AND kind = 'grid' AND bad AS recovered_on_grid
FROM l JOIN a ON a.o_custkey = l.o_custkey AND a.o_orderkey = last JOIN (SELECT l.o_custkey, coalesce(bool_or(NOT ok) FILTER (WHERE o_orderkey < last), false) AS bad FROM l JOIN a USING (o_custkey) GROUP BY ALL) b ON b.o_custkey = l.o_custkey""")
def attempt_rollup(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(k == 0, "retry").when(k == 1, "raster").otherwise("grid").alias("kind"), (F.col("o_orderstatus") == "F").alias("success"))
    return reports.attempt_rollup(o, ["o_custkey"], "o_orderkey")


@query("SELECT s_nationkey, CASE WHEN s_acctbal < 0 THEN 'failed' ELSE 'ok' END AS status, array_to_string(list_sort(list(DISTINCT s_suppkey)), ',') AS pages FROM supplier GROUP BY ALL")
def document_report(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").withColumn("status", F.when(F.col("s_acctbal") < 0, "failed").otherwise("ok"))
    got = reports.document_report(s, ["s_nationkey"], "s_suppkey", "status")
    return got.withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


@query("SELECT p_brand, p_name, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice DESC, p_partkey) = 1")
def best_member(spark, sf_dir):
    return reports.best_by(read(spark, sf_dir, "part"), ["p_brand"], "p_name", [F.col("p_size"), F.col("p_retailprice")], "p_partkey")


@query("""WITH c AS (SELECT lang, source, CASE WHEN source = 'src3' AND doc_id % 50 = 7 THEN NULL ELSE n_chars END AS i, n_chars // 10 AS o FROM documents)
SELECT lang, source, sum(coalesce(i, 0))::BIGINT AS tokens_in, sum(o)::BIGINT AS tokens_out, CASE WHEN count(*) FILTER (WHERE i IS NULL) = 0 AND source <> 'src5' THEN round((sum(i) * 1 + sum(o) * 5) / 1000000.0, 6)::DOUBLE END AS cost_usd,
  CASE WHEN count(*) FILTER (WHERE i IS NULL) > 0 THEN 'usage_missing' WHEN source = 'src5' THEN 'rate_unavailable' ELSE 'complete' END AS status FROM c GROUP BY lang, source""")
def cost_rollup(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    rate = lambda n: F.when(F.col("source") != "src5", F.lit(n)).cast("decimal(20,6)")
    calls = d.select("lang", "source", "doc_id", F.when(~((F.col("source") == "src3") & (F.col("doc_id") % 50 == 7)), F.col("n_chars")).alias("i"), F.expr("n_chars DIV 10").alias("o"), rate(1).alias("ri"), rate(5).alias("ro"))
    got = reports.cost_rollup(calls, ["lang", "source"], "doc_id", "i", "o", "ri", "ro")
    return got.withColumn("cost_usd", F.round(F.col("cost_usd").cast("double"), 6))


# scalars


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, regexp_extract('```json' || chr(10) || props || chr(10) || '```', '(?s)(\\{.*\\})', 1) = props AS found FROM events""")
def json_extract(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return e.select("event_id", F.get_json_object(coerce.json_object(fenced), "$.k").alias("k"), (coerce.json_object(fenced) == F.col("props")).alias("found"))


_SQL_WORDS = r"list_filter(regexp_split_to_array(trim(text, ' ' || chr(10) || chr(9)), '\s+'), lambda x: x <> '')"


@query(f"""SELECT doc_id, array_to_string({_SQL_WORDS}[1:8], ' ') AS first_words, CASE WHEN len({_SQL_WORDS}) <= 40 AND lower(array_to_string({_SQL_WORDS}, ' ')) NOT IN ('', 'unknown', 'none', 'null', 'n/a') THEN array_to_string({_SQL_WORDS}, ' ') ELSE 'unclear' END AS bounded,
  CASE WHEN length(text) > 220 THEN text[1:220] || '...' ELSE text END AS cut FROM documents""")
def text_bounds(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", coerce.first_words(t, 8).alias("first_words"), coerce.bounded_words(t, 40, "unclear").alias("bounded"), coerce.bounded_chars(t, 220).alias("cut"))


@query("""SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g') AS slug, sha256(url || '|' || page_id::VARCHAR) AS key FROM pages""")
def slug_keys(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", coerce.slug(F.col("url")).alias("slug"), coerce.stable_key(F.col("url"), F.col("page_id").cast("string")).alias("key"))


@query("""WITH l AS (SELECT l_returnflag, list(l_extendedprice ORDER BY l_extendedprice) AS s FROM lineitem GROUP BY ALL)
SELECT l_returnflag, s[1 + round_even(0.05::DOUBLE * (len(s) - 1), 0)::INT] AS p05, s[1 + round_even(0.95::DOUBLE * (len(s) - 1), 0)::INT] AS p95 FROM l""")
def nearest_rank(spark, sf_dir):
    # ranks by row number: a group's values aren't gathered
    from pyspark.sql import Window

    w = Window.partitionBy("l_returnflag")
    l = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", (F.row_number().over(w.orderBy("l_extendedprice")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    at = lambda p: F.max(F.when(F.col("i") == F.bround((F.col("n") - 1) * F.lit(p)), F.col("l_extendedprice")))
    return l.groupBy("l_returnflag").agg(at(0.05).alias("p05"), at(0.95).alias("p95"))


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS whole, CASE WHEN lower(event_type) IN ('view', 'click') THEN lower(event_type) ELSE 'other' END AS kind, value > 50 AS valid FROM events""")
def coercions(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select(
        "event_id", coerce.to_int(F.get_json_object("props", "$.k")).alias("whole"), coerce.from_vocabulary(F.upper("event_type"), ("view", "click"), "other").alias("kind"),
        coerce.valid_rect(F.lit(0), F.lit(50.0), F.lit(1), F.col("value")).alias("valid"),
    )


# ledgers


@query("""SELECT user_id, event_id, strftime(ts, '%Y-%m') AS month, 500 - sum(1) OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id)::BIGINT AS remaining FROM events""")
def month_reset(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("one", F.lit(1).cast("long"))
    return ledger.month_balance(e, JOB, "ts", ORDER, "one", 500).select("user_id", "event_id", "month", "remaining")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND (epoch_us((SELECT max(ts) FROM events)) // 1000000) - (epoch_us(ts) // 1000000) >= 864000")
def ttl_release(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).first()[0]
    return ledger.expired(e.filter("event_type = 'click'"), "ts", F.lit(now), 864000).select("event_id")


@query("""WITH f AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 20 ORDER BY ts, event_id) = 1),
i AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM f)
SELECT user_id, count(*) AS n_steps, count(*) + count(DISTINCT i // 2) AS n_charges FROM i GROUP BY user_id""")
def charge_once(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("charge", F.col("event_id") % 20)
    return ledger.grouped_charges(ledger.charged_once(e, ["user_id", "charge"], ORDER), JOB, ORDER)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, (epoch_us(ts) // 1000000) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT user_id, event_id, rn, t AS s, 1::BIGINT AS n FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.event_id, e.rn, CASE WHEN e.t - r.s >= 604800 THEN e.t ELSE r.s END, CASE WHEN e.t - r.s >= 604800 THEN 1 ELSE r.n + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT user_id, event_id, s AS window_start, n AS n_in_window, n >= 5 AS blocked FROM r""")
def anchored_limiter(spark, sf_dir):
    got = ledger.anchored_limit(read(spark, sf_dir, "events"), JOB, "ts", ["event_id"], 604800, 5)
    return got.select("user_id", "event_id", "window_start", "n_in_window", "blocked")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END * floor(o_totalprice)::BIGINT AS a FROM orders),
n AS (SELECT *, sum(a) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS net FROM o)
SELECT o_custkey, o_orderkey, greatest(0, net)::BIGINT AS remaining, greatest(0, -net)::BIGINT AS debt FROM n""")
def debt_repay(spark, sf_dir):
    amount = F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1) * F.floor("o_totalprice").cast("long")
    o = read(spark, sf_dir, "orders").withColumn("a", amount)
    return ledger.balance_and_debt(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "a").select("o_custkey", "o_orderkey", "remaining", "debt")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 0 ELSE 1 END AS rank, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate END AS exp FROM orders) WHERE o_totalprice > 1000
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY exp NULLS LAST, rank * 100000000 + o_orderkey) = 1""")
def credit_pick(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumns({"exp": F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate")), "left": F.greatest(F.lit(0.0), F.col("o_totalprice") - 1000)})
    o = o.withColumn("rank", F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1) * 100000000 + F.col("o_orderkey"))
    return ledger.chosen_source(o, ["o_custkey"], "exp", "rank", "left").select("o_custkey", "o_orderkey")


@query("""WITH f AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderkey % 6 ORDER BY o_orderdate, o_orderkey) = 1)
SELECT o_custkey, o_orderkey, 400 AS credits, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))::INT AS grant_no FROM f""")
def subscription_apply(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("txn", F.col("o_orderkey") % 6)
    return ledger.applied_subscriptions(o, ["o_custkey"], "txn", ["o_orderdate", "o_orderkey"], F.lit(400)).select("o_custkey", "o_orderkey", "credits", "grant_no")


@query("SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY ALL")
def status_transitions(spark, sf_dir):
    return ledger.last_status(read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus")


@query("""SELECT c_nationkey, sum(floor(greatest(0, c_acctbal)))::BIGINT AS total, sum(CASE WHEN c_mktsegment = 'BUILDING' THEN floor(greatest(0, c_acctbal)) ELSE 0 END)::BIGINT AS purchased, bool_or(c_acctbal >= 1) AS any_left FROM customer GROUP BY ALL""")
def combined_credits(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumns({"left": F.floor(F.greatest(F.lit(0.0), "c_acctbal")), "kind": F.when(F.col("c_mktsegment") == "BUILDING", "purchased").otherwise("pro")})
    return ledger.combined_credits(c, ["c_nationkey"], "kind", "left")


# suggestions


@query("""WITH s AS (SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'multi_measure_rest' WHEN 'click' THEN 'uncertain' WHEN 'signup' THEN 'pickup' WHEN 'error' THEN 'ending_1' ELSE 'normal' END AS l, event_id % 4 AS n FROM events)
SELECT event_id, CASE WHEN l = 'ending_1' OR (l = 'multi_measure_rest' AND n < 2) THEN 'normal' ELSE l END AS label, CASE WHEN l = 'multi_measure_rest' AND n >= 2 THEN n::INT END AS rest_count, CASE WHEN n = 0 THEN 'high' ELSE 'low' END AS confidence,
  CASE WHEN l = 'uncertain' AND n >= 2 THEN 'multi_measure_rest' END AS maybe_label, CASE WHEN l = 'uncertain' AND n >= 2 THEN n::INT END AS maybe_rest_count, CASE WHEN l = 'pickup' THEN 'incomplete' WHEN l = 'multi_measure_rest' AND n >= 2 THEN 'full' WHEN n = 3 THEN 'full' ELSE 'unclear' END AS completeness, CASE WHEN n = 1 THEN 'common_time' WHEN n = 2 THEN '3/4' END AS time_signature FROM s""")
def suggestion_rules(spark, sf_dir):
    n = F.col("event_id") % 4
    label = F.expr("CASE event_type WHEN 'view' THEN ' Multi_Measure_Rest' WHEN 'click' THEN 'uncertain' WHEN 'signup' THEN 'PICKUP' WHEN 'error' THEN 'ending_1' ELSE 'normal' END")
    s = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("job"), F.col("event_id").alias("measure_id"), label.alias("label"), n.cast("string").alias("rest_count"), F.when(n == 0, "High").otherwise("??").alias("confidence"),
        F.lit("multi_measure_rest").alias("maybe_label"), n.cast("string").alias("maybe_rest_count"), F.when(n == 3, " Full").otherwise("complete").alias("completeness"), F.lit("r").alias("reason"),
        F.when(n == 1, "C").when(n == 2, " 3 / 4").when(n == 3, "3/456").alias("time_signature"),
    )
    got = suggestions.normalised(s)
    return got.select(F.col("measure_id").alias("event_id"), "label", "rest_count", "confidence", "maybe_label", "maybe_rest_count", "completeness", "time_signature")


@query("""WITH e AS (SELECT user_id, event_type, CASE WHEN value > 80 THEN 'high' WHEN value > 40 THEN 'medium' ELSE 'low' END AS c FROM events)
SELECT user_id, event_type, CASE WHEN bool_or(c = 'low') THEN 'low' WHEN bool_or(c = 'medium') THEN 'medium' ELSE 'high' END AS confidence FROM e GROUP BY ALL""")
def pair_confidence(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("confidence", F.when(F.col("value") > 80, "high").when(F.col("value") > 40, "medium").otherwise("low"))
    return suggestions.pair_confidence(e, ["user_id", "event_type"])


@query("SELECT doc_id, quality::VARCHAR AS word FROM labels UNION ALL SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def keyed_merge(spark, sf_dir):
    old = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("word"))
    return suggestions.merged_by_id(old, read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("word")), ["doc_id"])


# validation and geometry


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'missing_row_id' WHEN o_orderkey % 7 = 0 THEN 'invalid_page' WHEN o_orderpriority LIKE '5%' THEN 'invalid_staff_kind'
  WHEN NOT (o_totalprice > 60000) THEN 'invalid_rect' WHEN NOT (c1 > 60000 AND c2 > c1 AND o_totalprice > c2) THEN 'invalid_cuts' END AS reason
FROM (SELECT *, 60000 + (o_orderkey % 9) * 1000.0 AS c1, 60000 + (o_orderkey % 13) * 1500.0 AS c2 FROM orders)""")
def manual_row_reasons(spark, sf_dir):
    k = F.col("o_orderkey")
    cuts = F.array((60000 + (k % 9) * 1000).cast("double"), (60000 + (k % 13) * 1500).cast("double"))
    kind = F.when(F.col("o_orderpriority").startswith("5"), "odd").otherwise("single")
    reason = validate.manual_row_reason(F.when(k % 10 != 0, k.cast("string")), k % 7, kind, F.lit(60000.0), F.lit(0.0), F.col("o_totalprice"), F.lit(1.0), cuts)
    return read(spark, sf_dir, "orders").select("o_orderkey", reason.alias("reason"))


_BOXES = """b AS (SELECT o_custkey, floor(o_totalprice / 1000)::DOUBLE AS l, floor(o_totalprice / 1000)::DOUBLE + o_orderkey % 30 AS r, o_orderkey::VARCHAR AS id FROM orders)"""


@query(f"""WITH RECURSIVE {_BOXES}, f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY l, r, id) AS rn FROM b WHERE l >= 50 AND r <= 400 AND r - l >= 2),
g AS (SELECT o_custkey, rn, id, r AS edge, true AS kept FROM f WHERE rn = 1
  UNION ALL SELECT f.o_custkey, f.rn, f.id, CASE WHEN g.edge <= f.l THEN f.r ELSE g.edge END, g.edge <= f.l FROM g JOIN f ON f.o_custkey = g.o_custkey AND f.rn = g.rn + 1)
SELECT o_custkey, id AS measure_id FROM g WHERE kept""")
def kept_boxes(spark, sf_dir):
    left = F.floor(F.col("o_totalprice") / 1000).cast("double")
    box = F.struct(left.alias("left"), (left + F.col("o_orderkey") % 30).alias("right"), F.col("o_orderkey").cast("string").alias("measure_id"))
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(box).alias("boxes"))
    return o.select("o_custkey", F.explode(validate.kept_boxes(F.col("boxes"), F.lit(50.0), F.lit(400.0))).alias("b")).select("o_custkey", "b.measure_id")


@query(f"""WITH {_BOXES}, s AS (SELECT *, lag(r) OVER (PARTITION BY o_custkey ORDER BY l, r) AS before FROM b)
SELECT o_custkey, CASE WHEN bool_or(NOT (l >= 10 AND r <= 450)) THEN 'box_outside_row' WHEN bool_or(r - l < 2) THEN 'box_too_narrow' WHEN bool_or(before > l) THEN 'overlapping_boxes' END AS reason FROM s GROUP BY ALL""")
def auto_row_reasons(spark, sf_dir):
    left = F.floor(F.col("o_totalprice") / 1000).cast("double")
    box = F.struct(left.alias("left"), (left + F.col("o_orderkey") % 30).alias("right"), F.col("o_orderkey").cast("string").alias("measure_id"))
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(box).alias("boxes"))
    return o.select("o_custkey", validate.auto_row_reason(F.col("boxes"), F.lit(10.0), F.lit(0.0), F.lit(450.0), F.lit(1.0)).alias("reason"))


@query("""WITH s AS (SELECT s_nationkey, s_suppkey, s_acctbal AS t, s_acctbal + 40 AS b FROM supplier),
n AS (SELECT *, (SELECT max(p.t) FROM s p WHERE p.s_nationkey = s.s_nationkey AND p.t < s.t) + 40 AS pb, (SELECT min(p.t) FROM s p WHERE p.s_nationkey = s.s_nationkey AND p.t > s.t) AS nt FROM s)
SELECT s_suppkey, round(t - CASE WHEN pb < t THEN least(100, 0.75 * (t - pb)) ELSE 100 END, 3) AS top, round(b + CASE WHEN nt > b THEN least(100, 0.75 * (nt - b)) ELSE 100 END, 3) AS bottom FROM n""")
def crop_bands(spark, sf_dir):
    s = layout.neighbours(read(spark, sf_dir, "supplier"), ["s_nationkey"], "s_acctbal")
    band = geometry.crop_band(F.col("s_acctbal"), F.col("s_acctbal") + 40, F.col("prev_at") + 40, F.col("next_at"), F.lit(100.0))
    return s.select("s_suppkey", F.round(band["top"], 3).alias("top"), F.round(band["bottom"], 3).alias("bottom"))


@query("""SELECT p_partkey, round(l, 3) AS x_left, round(t, 3) AS y_top, round(l + p_size + 4, 3) AS x_right FROM (SELECT *, greatest(0, least(p_retailprice - p_size / 2.0 - 2, 1500 - p_size - 4)) AS l, greatest(0, least(p_retailprice / 2 - 14, 986)) AS t FROM part)""")
def label_boxes(spark, sf_dir):
    box = geometry.label_box(F.col("p_retailprice"), F.col("p_retailprice") / 2, F.col("p_size"), F.lit(10.0), F.lit(1500.0), F.lit(1000.0))
    return read(spark, sf_dir, "part").select("p_partkey", F.round(box["left"], 3).alias("x_left"), F.round(box["top"], 3).alias("y_top"), F.round(box["right"], 3).alias("x_right"))


@query("""SELECT event_id, event_id % 600 IN (408, 429, 500, 502, 503, 504) OR regexp_matches(event_type || CASE WHEN event_id % 5 = 0 THEN ' Timed out' ELSE '' END, 'Timed out') AS again,
  CASE WHEN event_type <> 'view' THEN 'not_a_pdf' WHEN event_id % 4 = 0 THEN 'empty_file' WHEN event_id % 40 > 25 THEN 'file_too_large' END AS reason, CASE WHEN event_type = 'click' OR event_id % 9 = 0 THEN 'manual' ELSE 'auto' END AS row_source FROM events""")
def request_rules(spark, sf_dir):
    k = F.col("event_id")
    said = F.concat("event_type", F.when(k % 5 == 0, " Timed out").otherwise(""))
    name = F.when(F.col("event_type") == "view", "a.PDF").otherwise("a.png")
    size = F.when(k % 4 == 0, F.lit(0)).otherwise((k % 40) * (1 << 20))
    return read(spark, sf_dir, "events").select(
        "event_id", validate.retryable((k % 600).cast("int"), said).alias("again"), validate.upload_reason(name, F.lit(None).cast("string"), size).alias("reason"),
        validate.row_source(F.when(F.col("event_type") == "click", " Manual"), F.when(k % 9 == 0, "m1"), F.lit("p1_s0")).alias("row_source"),
    )


# selection


@query("""WITH s AS (SELECT s_nationkey, s_suppkey, s_acctbal AS t, s_acctbal + 20 AS b FROM supplier WHERE s_suppkey % 2 = 0), c AS (SELECT s_nationkey, s_acctbal AS ct, s_acctbal + 600 AS cb FROM supplier WHERE s_suppkey % 2 = 1)
SELECT s_suppkey FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.s_nationkey = s.s_nationkey AND (t + b) / 2 BETWEEN ct - 5 AND cb + 5)""")
def uncovered_rows(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.col("s_acctbal").alias("t"))
    items = s.filter("s_suppkey % 2 = 0").withColumn("b", F.col("t") + 20)
    covers = s.filter("s_suppkey % 2 = 1").withColumn("b", F.col("t") + 600)
    return selection.uncovered(items, covers, ["s_nationkey"], "s_suppkey", "t", "b", "t", "b").select("s_suppkey")


@query("""WITH c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS hint FROM customer), s AS (SELECT s_nationkey, s_suppkey AS x, s_acctbal AS t, s_acctbal + 50 * (s_suppkey % 9) AS b FROM supplier),
j AS (SELECT *, hint BETWEEN t - 2 AND b + 2 AS covers FROM c JOIN s ON c_nationkey = s_nationkey AND b > t)
SELECT c_custkey, round(t, 2) AS span_top, round(b, 2) AS span_bottom FROM j QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY coalesce(covers, false) DESC, CASE WHEN covers THEN 0 ELSE coalesce(abs((t + b) / 2 - hint), 0) END, x) = 1""")
def nearest_span(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("p"), "c_custkey", F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal")).alias("hint"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("p"), F.col("s_suppkey").cast("double").alias("x"), F.col("s_acctbal").alias("t"), (F.col("s_acctbal") + 50 * (F.col("s_suppkey") % 9)).alias("b"))
    got = selection.nearest_span(c, s, ["p"], "c_custkey", "hint", "x", "t", "b")
    return got.select("c_custkey", F.round("span_top", 2).alias("span_top"), F.round("span_bottom", 2).alias("span_bottom"))


@query("""WITH f AS (SELECT *, bool_or(event_type = 'signup') OVER (PARTITION BY user_id, ts::DATE) AS has FROM events)
SELECT event_id, CASE WHEN has THEN 1 ELSE 2 END::INT AS tier FROM f WHERE CASE WHEN has THEN event_type = 'signup' ELSE value > 50 END""")
def usable_rows(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return selection.usable_rows(e, ["user_id", "day"], F.col("event_type") == "signup", F.col("value") > 50).select("event_id", "tier")


@query("""WITH RECURSIVE st AS (SELECT c_custkey, c_nationkey AS p, c_acctbal AS x FROM customer), sy AS (SELECT s_nationkey AS p, s_acctbal AS l, s_acctbal + 300 AS r FROM supplier),
g AS (SELECT c_custkey, p, x, 0 AS i FROM st UNION ALL SELECT c_custkey, g.p, coalesce((SELECT min(l) FROM sy WHERE sy.p = g.p AND l < g.x AND g.x < r), g.x), i + 1 FROM g WHERE i < 4)
SELECT c_custkey, x FROM g WHERE i = 4""")
def pushed_starts(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("p"), F.col("c_acctbal").alias("x"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("p"), F.col("s_acctbal").alias("l"), (F.col("s_acctbal") + 300).alias("r"))
    return selection.pushed_left(c, s, ["p"], "c_custkey", "x", "l", "r").select("c_custkey", "x")


@query("""WITH d AS (SELECT user_id, ts FROM events WHERE event_type = 'signup'), r AS (SELECT user_id, event_id, ts AS at FROM events WHERE event_type = 'click')
SELECT d.user_id, epoch_us(d.ts)::BIGINT AS at, (SELECT event_id FROM r WHERE r.user_id = d.user_id AND epoch_us(r.at) // 1000000 >= epoch_us(d.ts) // 1000000 - 3600 ORDER BY r.at, event_id LIMIT 1) AS run FROM d""")
def next_run(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    d = e.filter("event_type = 'signup'").select("user_id", "ts")
    r = e.filter("event_type = 'click'").select("user_id", "event_id", F.col("ts").alias("at"))
    return selection.next_run(d, r, ["user_id"], "ts", "at", "event_id", 3600).select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "run")


@query("""SELECT page_id, CASE WHEN n = 1 THEN b ELSE b || '-' || n::VARCHAR END AS name FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY page_id) AS n FROM (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS b FROM pages))""")
def unique_names(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return selection.unique_names(p, F.regexp_extract("url", "^https?://([^/]+)", 1), ["page_id"]).select("page_id", "name")


@query("""SELECT conv_id, turn, number::INT AS number FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id % 20 ORDER BY conv_id, turn) AS number FROM conversations WHERE length(text) - 10 > 0.6 * 150)""")
def wide_blocks(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumns({"doc": F.col("conv_id") % 20, "l": F.lit(10), "r": F.length("text"), "w": F.lit(150)})
    return selection.wide_blocks(c, ["doc"], "conv_id", "l", "r", "turn", "w").select("conv_id", "turn", "number")


from . import edits as _edit_plans  # noqa: E402, F401  these add their queries
from . import pages as _pages  # noqa: E402, F401
