"""Queries of the operators for pages, names, runs and errors; the SQL states the expected words where it can."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coerce, geometry, validate
from ..operators import boxes, ledger, pages
from .queries import query, read


def _pick(at, *values):
    """One of the values, by a whole number."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (at % len(values) + 1).cast("int"))


@query("""SELECT event_id, [NULL, 'common_time', 'common_time', 'common_time', 'common_time', 'cut_time', 'cut_time', 'cut_time', '12/8', '3/4', NULL, NULL][event_id % 12 + 1] AS meter FROM events""")
def meters(spark, sf_dir):
    said = _pick(F.col("event_id"), "", "C", " Common Time", "common-time", "commonmeter", "Alla Breve", "cuttime", "CUT\n", "12 / 8", "3_/_4", "3/456", "four")
    return read(spark, sf_dir, "events").select("event_id", coerce.meter(said).alias("meter"))


@query("""SELECT event_id, [true, false, true, false, true, false, true, false, true, true, false, true][event_id % 12 + 1] AS again, [true, false, true, false, false, true, true, false, false, false, false, true][event_id % 12 + 1] AS model_again,
  [false, false, false, false, false, true, false, true, false, false, false, false][event_id % 12 + 1] AS overloaded FROM events""")
def error_rules(spark, sf_dir):
    k = F.col("event_id")
    code = _pick(k, 408, 409, 429, 425, 0, 529, 500, 501, 0, 0, 400, 504)
    said = _pick(k, "", "", "", "", "Please TRY AGAIN", "connection lost", "", "Overloaded_Error", "Backend error", "429 Too many requests: not authorized", "On-demand throughput isn't there", "")
    return read(spark, sf_dir, "events").select("event_id", validate.retryable(code, said).alias("again"), validate.model_retryable(code, said).alias("model_again"), validate.overloaded(code, said).alias("overloaded"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN o_orderdate > TIMESTAMP '1995-06-17' WHEN 3 THEN o_orderdate + INTERVAL 10 DAY > TIMESTAMP '1995-06-17'
  WHEN 4 THEN o_orderdate > TIMESTAMP '1995-06-17' ELSE false END AS active FROM orders""")
def subscriptions_active(spark, sf_dir):
    k = F.col("o_orderkey")
    status = _pick(k, "Expired", " inactive", "active", "billing_grace", "billing_retry", "refunded")
    now = F.lit("1995-06-17 00:00:00").cast("timestamp")
    return read(spark, sf_dir, "orders").select("o_orderkey", ledger.subscription_active(status, now, F.col("o_orderdate"), F.expr("o_orderdate + INTERVAL 10 DAYS")).alias("active"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::INT % 9 AS a, l_partkey % 25 AS b, CASE WHEN l_suppkey % 5 > 0 THEN l_suppkey % 12 + 0.5 END AS m FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, m IS NOT NULL AND b > a AND abs(b - m) < abs(a - m) AND NOT b > CASE WHEN m * 1.6 > 3 THEN m * 1.6 ELSE 3 END AS accepted,
  m IS NOT NULL AND a <= CASE WHEN trunc(m * 0.4) > 2 THEN trunc(m * 0.4) ELSE 2 END AS suspect FROM l""")
def second_pass(spark, sf_dir):
    a, b = F.col("l_quantity").cast("int") % 9, F.col("l_partkey") % 25
    m = F.when(F.col("l_suppkey") % 5 > 0, (F.col("l_suppkey") % 12 + 0.5).cast("double"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", boxes.accept_second_pass(a, b, m).alias("accepted"), boxes.under_split(a, m).alias("suspect"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber > 1 AND l_quantity > 5 AND l_quantity - 5 <= 40 AND l_discount > 0 AND 480 * l_discount <= 24 AS fits FROM lineitem""")
def erase_areas(spark, sf_dir):
    wide, high = F.col("l_quantity"), 480 * F.col("l_discount")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", validate.erase_area(F.col("l_linenumber") - 1, F.lit(5.0), F.lit(0.0), wide, high, 40.0, 24.0).alias("fits"))


@query("""WITH p AS (SELECT page_id, url, page_id % 4 AS k FROM pages)
SELECT page_id, CASE k WHEN 0 THEN 'shop' WHEN 1 THEN 'b' END AS bucket, CASE k WHEN 0 THEN 'in/My Score ' || page_id || '.v2.pdf' WHEN 1 THEN 'plain' END AS blob, CASE k WHEN 0 THEN 'My-Score-' || page_id || '.v2' WHEN 1 THEN 'plain' ELSE '' END AS job,
  CASE k WHEN 2 THEN 'manual_sys_row' ELSE 'manual_sys_r-' || page_id END AS system_id, CASE k WHEN 2 THEN 'manual_measure_row_m1' ELSE 'manual_measure_r-' || page_id || '_m' || greatest(0, k - 1) END AS measure_id FROM p""")
def names_of_jobs(spark, sf_dir):
    k, i = F.col("page_id") % 4, F.col("page_id").cast("string")
    uri = F.when(k == 0, F.concat(F.lit(" gs://shop/in/My Score "), i, F.lit(".v2.pdf"))).when(k == 1, "gs://b/plain").when(k == 2, "gs://b/").otherwise(F.col("url"))
    row = F.when(k != 2, F.concat(F.lit(" r "), i))
    got = read(spark, sf_dir, "pages").withColumn("gs", coerce.gs_parts(uri))
    return got.select("page_id", "gs.bucket", "gs.blob", coerce.job_id(uri).alias("job"), coerce.manual_id(row).alias("system_id"), coerce.manual_id(row, (k - 1).cast("int")).alias("measure_id"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN q - b BETWEEN 1 AND 8 AND b < 2 THEN CASE WHEN l_returnflag = 'A' THEN 'medium' ELSE 'high' END ELSE 'low' END AS confidence
FROM (SELECT *, l_quantity::INT AS q, l_linenumber - 1 AS b FROM lineitem)""")
def count_confidence(spark, sf_dir):
    q, b = F.col("l_quantity").cast("int"), F.col("l_linenumber") - 1
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", coerce.fallback_confidence(q, q - b, F.col("l_returnflag") == "A").alias("confidence"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 40)::INT END AS sheet, CASE WHEN doc_id % 3 = 0 THEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) END::INT AS n,
  doc_id % 5 = 0 OR doc_id % 7 = 0 AS clef FROM documents""")
def sheet_fields(spark, sf_dir):
    i = F.col("doc_id")
    name = F.when(i % 3 == 0, F.concat(F.lit(" source-sheet-"), (i % 40).cast("string"), F.lit(" "))).otherwise("source-sheet-x")
    said = F.create_map(F.lit("kind"), F.when(i % 7 == 0, "G_Clef").otherwise("note"), F.lit("other"), F.lit("clef"))
    got = read(spark, sf_dir, "documents").withColumn("f", coerce.sheet_tokens(name, F.col("text")))
    return got.select("doc_id", "f.sheet", "f.n", coerce.looks_like_clef(F.when(i % 5 == 0, "BassClef").otherwise("clefs"), said).alias("clef"))


@query("""SELECT event_id, [true, false, true, false, false][event_id % 5 + 1] AS grid, ['queued', 'running', 'succeeded', 'cancelled', 'failed', 'stale', 'unknown'][event_id % 7 + 1] AS state,
  ['grid_structural_ok', 'omr_missing', 'mxl_missing_after_omr_created', 'mxl_has_no_parts_or_measures', 'mxl_has_no_parts_or_measures', 'timeout', 'unknown_failure', 'ok'][event_id % 8 + 1] AS stage,
  CASE WHEN event_id % 9 = 0 THEN 'medium_staff_line_repair' WHEN event_id % 9 = 1 THEN 'deskew_then_medium_raster' WHEN event_id % 9 = 2 THEN 'crop_or_border_cleanup' WHEN event_id % 8 IN (2, 3, 4) THEN 'medium_raster_cleanup'
    WHEN event_id % 9 = 4 THEN 'retry_or_split_page' ELSE 'inspect_page_manually' END AS next_try FROM events""")
def run_report(spark, sf_dir):
    k = F.col("event_id")
    log = _pick(k, "INFO MetronomeInter lost", "all well", "Could not EXPORT", "texts", "could not export")
    run = validate.run_state(_pick(k, " Waiting", "in_progress", "completed", "COMPLETED", "completed", "stale", ""), _pick(k, "", "", "success", "cancelled", "timed_out", "", ""))
    s = k % 8
    stage = validate.failure_stage(s == 0, s != 1, s != 2, F.when(s == 3, 0).otherwise(2), F.when(s == 4, None).otherwise(5), s == 7, F.when(s == 5, "timeout").otherwise(""))
    clues = lambda at, word: F.when(k % 9 == at, F.array(F.lit(word)))
    image = F.coalesce(clues(0, "staff_lines_broken"), clues(1, "minor_skew"), clues(2, "dark_borders"), F.array().cast("array<string>"))
    logs = F.coalesce(clues(4, "timeout_or_killed"), F.array(F.lit("measure_warning")))
    got = read(spark, sf_dir, "events").withColumns({"stage": stage, "grid": validate.wants_grid(k % 5 < 4, log), "state": run})
    return got.select("event_id", "grid", "state", "stage", validate.next_try(F.col("stage"), logs, image).alias("next_try"))


@query("""WITH m AS (SELECT o_orderkey::VARCHAR AS measure_id, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'manual' ELSE 'auto' END AS source, o_orderstatus = 'F' AS ex FROM orders)
SELECT measure_id FROM m WHERE source = 'auto' AND NOT ex AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)""")
def page_measures(spark, sf_dir):
    k = F.col("o_orderkey")
    m = read(spark, sf_dir, "orders").select(k.cast("string").alias("measure_id"), F.col("o_custkey").alias("page"), F.when(k % 3 == 0, "manual").otherwise("auto").alias("source"), (F.col("o_orderstatus") == "F").alias("excluded"))
    some = read(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("page"))
    return pages.ids_on_pages(pages.candidates(m, ["page", "measure_id"]), some, ["page"], source="auto")


@query("""WITH s AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 > 0 THEN n_nationkey * 10.0 END AS ax, CASE WHEN n_nationkey % 4 > 0 THEN 1.0 END AS atop, 90.0 AS abot, CASE WHEN n_nationkey % 3 = 0 THEN -500.0 END AS l, 8000.0 AS r FROM nation),
m AS (SELECT c_nationkey AS k, c_acctbal AS l, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal + (c_custkey % 3 - 1) * 10 ELSE c_acctbal END AS r, c_custkey % 100 AS t, CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 130 ELSE c_custkey % 100 END AS b FROM customer WHERE c_custkey % 11 > 0),
a AS (SELECT k, min(l) FILTER (WHERE r > l) AS l, max(r) FILTER (WHERE r > l) AS r, min(t) AS t, max(b) FILTER (WHERE b > t) AS b FROM m GROUP BY k),
x AS (SELECT s.k, least(coalesce(a.l, ax), s.l) AS "left", a.r AS mr, ax, s.r, least(a.t, atop) AS top, CASE WHEN atop IS NULL THEN a.b ELSE greatest(a.b, abot) END AS bottom FROM s LEFT JOIN a USING (k))
SELECT k AS n_nationkey, round("left", 4)::DOUBLE AS x_left, round(CASE WHEN "left" IS NULL THEN coalesce(mr, ax + 1) ELSE greatest(coalesce(mr, ax + 1), r) END, 4)::DOUBLE AS x_right, top::DOUBLE AS y_top, bottom::DOUBLE AS y_bottom FROM x
WHERE "left" IS NOT NULL AND bottom > top AND greatest(coalesce(mr, ax + 1), r) > "left\"""")
def system_bounds(spark, sf_dir):
    k, c = F.col("n_nationkey"), F.col("c_custkey")
    s = read(spark, sf_dir, "nation").select(
        "n_nationkey", F.when(k % 5 > 0, k * 10.0).alias("anchor_x"), F.when(k % 4 > 0, F.lit(1.0)).alias("anchor_top"), F.lit(90.0).alias("anchor_bottom"), F.when(k % 3 == 0, F.lit(-500.0)).alias("x_left"),
        F.lit(8000.0).alias("x_right"), F.lit(None).cast("double").alias("y_top"), F.lit(None).cast("double").alias("y_bottom"),
    )
    m = read(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("n_nationkey"), F.when(c % 11 > 0, F.col("c_acctbal")).alias("x_left"), F.when(c % 4 > 0, F.col("c_acctbal") + (c % 3 - 1) * 10).alias("x_right"),
        (c % 100).cast("double").alias("y_top"), F.when(c % 7 > 0, (c % 130).cast("double")).alias("y_bottom"),
    )
    got = pages.visual_bounds(s, m, ["n_nationkey"])
    return got.select("n_nationkey", F.round("left", 4).alias("x_left"), F.round("right", 4).alias("x_right"), F.col("top").alias("y_top"), F.col("bottom").alias("y_bottom"))


@query("""SELECT user_id, least(count(*), 50) AS history_count, 50 AS history_max, coalesce(arg_max(event_type, (ts, event_id)), '') AS last_result, max((ts, event_id))[2]::VARCHAR AS last_trace_id FROM events GROUP BY user_id""")
def trace_summaries(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("result"), F.col("event_id").cast("string").alias("trace_id"))
    return pages.trace_summary(e, ["user_id"], ["ts", "event_id"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 WHEN o_custkey % 2 = 0 AND o_custkey % 10 > 0 THEN o_custkey % 10 END AS page, CASE WHEN o_orderkey % 5 = 0 THEN 'edit_rejected' ELSE o_orderpriority END AS reason FROM orders""")
def rejection_pages(spark, sf_dir):
    k = F.col("o_orderkey")
    r = read(spark, sf_dir, "orders").select("o_orderkey", F.lit(1).alias("job"), (k % 3).alias("page"), F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("measure_id"), F.when(k % 5 > 0, F.col("o_orderpriority")).otherwise(" ").alias("reason"))
    m = read(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.lit(1).alias("job"), F.col("c_custkey").cast("string").alias("measure_id"), (F.col("c_custkey") % 10).alias("page"))
    return pages.rejected_pages(r, m, ["job"]).select("o_orderkey", "page", "reason")


@query("""SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 2 OR row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 2""")
def box_previews(spark, sf_dir):
    return pages.previews(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 2, 2).select("user_id", "event_id")


@query("""SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey""")
def newest_jobs(spark, sf_dir):
    return pages.newest_first(read(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


@query("""WITH w AS (SELECT DISTINCT substr(c_name, 1, 17) AS name FROM customer UNION SELECT s_name FROM supplier), n AS (SELECT substr(c_name, 1, 17) AS name, count(*) AS n FROM customer GROUP BY 1)
SELECT w.name, CASE WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'not_unique' ELSE 'found' END AS match FROM w LEFT JOIN n ON upper(w.name) = upper(n.name)""")
def unique_probe(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.substring("c_name", 1, 17).alias("name"))
    wanted = c.unionByName(read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))).distinct()
    return pages.unique_match(wanted, c.withColumn("name", F.concat(F.lit(" "), F.lower("name"))), "name")


@query("""WITH s AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, list_transform(range(1, s_suppkey % 4 + 1), lambda j: 100.0 * j + s_suppkey % 13) AS bars FROM supplier),
c AS (SELECT *, len(bars) > 1 AND i > 0 AND abs(list_min(bars) - 105) <= 8 AS l FROM s), d AS (SELECT *, len(bars) - l::INT > 1 AND abs(300 - list_max(bars)) <= 8 AS r FROM c)
SELECT s_suppkey, (len(bars) - l::INT - r::INT)::INT AS increment, l AS left_carry, r AS right_carry, (1 + coalesce(sum(len(bars) - l::INT - r::INT) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS counter_before FROM d""")
def bar_carry(spark, sf_dir):
    from pyspark.sql import Window

    k = F.col("s_suppkey")
    some = F.transform(F.sequence(F.lit(1), (k % 4).cast("int")), lambda j: 100.0 * j + k % 13)
    s = read(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_nationkey", (F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1).alias("i"), F.when(k % 4 > 0, some).otherwise(F.array().cast("array<double>")).alias("bars"),
        F.lit(None).cast("double").alias("header"), F.lit(105.0).alias("left"), F.lit(300.0).alias("right"), F.lit(10.0).alias("spacing"),
    )
    got = pages.bar_counts(s, ["s_nationkey"], ["s_suppkey"], "bars", "i", ["header", "left"], "right", "spacing")
    return got.select("s_suppkey", "increment", "left_carry", "right_carry", F.col("counter_before").cast("long").alias("counter_before"))


@query("""WITH g AS (SELECT s_nationkey AS p, s_suppkey AS i, CASE WHEN s_suppkey % 3 > 0 THEN 'primary' WHEN s_suppkey % 2 = 0 THEN 'label_anchor' END AS source, CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal ELSE s_acctbal + 100 END AS t, s_suppkey % 7 = 0 AND s_suppkey % 3 > 0 AS flat FROM supplier),
c AS (SELECT *, CASE WHEN source IS NOT NULL THEN least(greatest(t, 0), 9000) END AS a, CASE WHEN source IS NOT NULL THEN least(greatest(CASE WHEN flat THEN t ELSE t + 50 END, 0), 9000) END AS b FROM g),
v AS (SELECT *, CASE WHEN b > a THEN a END AS top FROM c)
SELECT i AS s_suppkey, source, round(top, 4) AS y_top, CASE WHEN source IS NULL THEN 'missing_system_guide' WHEN top IS NULL THEN 'invalid_system_span'
  WHEN top + 1 < last_value(top IGNORE NULLS) OVER (PARTITION BY p ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'bad_system_vertical_order' END AS warning FROM v""")
def guides_rebuilt(spark, sf_dir):
    k, a = F.col("s_suppkey"), F.col("s_acctbal")
    s = read(spark, sf_dir, "supplier")
    has = k % 3 > 0
    guides = s.select(F.col("s_nationkey").alias("page"), k.alias("i"), F.when(has, F.lit(5.0)).alias("x"), F.when(has, a).alias("top"), F.when(has, F.when(k % 7 == 0, a).otherwise(a + 50)).alias("bottom"))
    labels = s.filter("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("page"), k.alias("i"), F.lit(7.0).alias("x"), (a + 100).alias("top"), (a + 150).alias("bottom"))
    got = pages.rebuilt_guides(guides, labels, ["page"], "i", F.lit(600.0), F.lit(9000.0))
    return got.select(F.col("i").alias("s_suppkey"), "source", F.round("top", 4).alias("y_top"), "warning")


@query("""SELECT p_partkey, round(p_retailprice * 0.3 + p_size, 6) AS page_x, round(p_retailprice, 6) AS pixel_x, CASE WHEN p_size % 3 > 0 THEN (p_retailprice + p_size) / 2 ELSE p_size + 5.0 END AS bar_x,
  CASE WHEN p_size % 3 > 0 THEN 1.0 ELSE 40.0 END AS bar_top, greatest(10, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 60 END - 6)::DOUBLE AS start_x FROM part""")
def page_coordinates(spark, sf_dir):
    x, n = F.col("p_retailprice"), F.col("p_size").cast("double")
    there = geometry.to_page(x, F.lit(2000.0), F.lit(600.0), n)
    bar = geometry.barline(F.when(n % 3 > 0, x), F.lit(9.0), n, F.lit(1.0), n, F.lit(40.0), F.lit(10.0), F.lit(20.0))
    got = read(spark, sf_dir, "part").withColumn("bar", bar)
    return got.select("p_partkey", F.round(there, 6).alias("page_x"), F.round(geometry.to_pixels(there, F.lit(2000.0), F.lit(600.0), n), 6).alias("pixel_x"), F.col("bar.x").alias("bar_x"), F.col("bar.top").alias("bar_top"),
                      geometry.start_left([F.when(n % 2 == 0, n), F.lit(60.0)], F.lit(10.0)).alias("start_x"))


@query("""SELECT event_id, CASE WHEN event_type NOT IN ('view', 'click') THEN 'unknown_product' WHEN event_id % 5 = 0 THEN 'wrong_bundle' WHEN event_id % 7 = 0 THEN 'missing_transaction' WHEN event_id % 3 = 2 THEN 'wrong_environment' END AS reason,
  event_id % 2 = 0 AS is_id FROM events""")
def transaction_rules(spark, sf_dir):
    k = F.col("event_id")
    reason = validate.transaction_reason(F.col("event_type"), ("view", "click"), F.when(k % 5 > 0, "app").otherwise("other"), "app", F.when(k % 7 > 0, "t").otherwise(" "), _pick(k, "Production", "Sandbox", "Xcode"))
    name = F.concat(F.when(k % 2 == 0, "0F8FAD5B").otherwise("0F8FAD5"), F.lit("-d9cb-469f-a165-70867728950e"))
    return read(spark, sf_dir, "events").select("event_id", reason.alias("reason"), validate.is_uuid(name).alias("is_id"))
