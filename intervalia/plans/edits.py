"""Queries of batches of edits: a user's events are the edits of a job of 35 measures in 7 systems of 5 (and one system without any)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import validate
from ..operators import edits
from .queries import query, read

_N = 35


def _state(e):
    """measures and systems of every user."""
    users = e.select(F.col("user_id").alias("job")).distinct()
    g = users.select("job", F.explode(F.sequence(F.lit(0), F.lit(_N - 1))).alias("g"))
    name = lambda letter, at: F.concat(F.lit(letter), at.cast("int").cast("string"))
    measures = g.select("job", "g", name("m", F.col("g")).alias("measure_id"), name("s", F.floor(F.col("g") / 5)).alias("system_id"), (F.col("g") * 10.0).alias("x_left"), (F.col("g") % 9 == 0).alias("excluded"))
    return measures, users.select("job", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("s")).select("job", name("s", F.col("s")).alias("system_id"))


def _edits(e, kind, target, value=None, **more):
    none = {"value": "string", "page": "int", "left": "double", "top": "double", "right": "double", "bottom": "double"}
    given = {**({} if value is None else {"value": value}), **more}
    return e.select(F.col("user_id").alias("job"), F.col("event_id").alias("ord"), kind.alias("type"), target.alias("target_id"), *((given[c] if c in given else F.lit(None)).cast(t).alias(c) for c, t in none.items()))


def _named(at, *names):
    return F.element_at(F.array(*(F.lit(n) for n in names)), (at % len(names) + 1).cast("int"))


@query("""WITH m AS (SELECT user_id, g, g // 5 AS s, g % 9 = 0 AS ex FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range(0, 35)) AS g)),
ed AS (SELECT user_id, event_id AS ord, event_id % 6 AS t, event_id // 7 AS r, CASE WHEN event_id % 6 = 5 THEN event_id % 10 * 5 ELSE event_id % 40 END AS g FROM events),
ok AS (SELECT ed.*, s FROM ed JOIN m USING (user_id, g) WHERE (t = 5 OR NOT ex) AND CASE t WHEN 1 THEN true WHEN 2 THEN r % 4 > 0 WHEN 3 THEN r % 3 < 2 WHEN 4 THEN r % 4 < 3 ELSE r % 1000 >= 3 END),
ev AS (SELECT user_id, g, arg_max({'v': CASE WHEN t <> 1 THEN r % 1000 - 3 END}, ord) FILTER (WHERE t IN (0, 1, 5)) AS o, arg_max({'v': nullif(r % 4 - 1, 0)}, ord) FILTER (WHERE t = 2) AS re,
  arg_max({'v': CASE r % 4 WHEN 0 THEN NULL ELSE (r % 4)::VARCHAR END}, ord) FILTER (WHERE t = 4) AS en FROM ok GROUP BY ALL),
lt AS (SELECT user_id, s, max(ord) AS o, arg_max(g, ord) AS g FROM ok WHERE t = 3 AND r % 3 = 0 GROUP BY ALL), lf AS (SELECT user_id, g, max(ord) AS o FROM ok WHERE t = 3 AND r % 3 = 1 GROUP BY ALL),
f AS (SELECT m.user_id, m.g, CASE WHEN ev.o IS NOT NULL THEN ev.o.v WHEN m.g % 4 = 0 THEN m.g END AS override, ev.re.v AS rest, CASE WHEN en IS NOT NULL THEN en.v WHEN m.g % 8 = 0 THEN '1' END AS ending,
  CASE WHEN lt.o IS NOT NULL THEN lt.g = m.g AND coalesce(lf.o < lt.o, true) ELSE m.g % 12 = 0 AND lf.o IS NULL END AS pickup
  FROM m LEFT JOIN ev USING (user_id, g) LEFT JOIN lt ON lt.user_id = m.user_id AND lt.s = m.s LEFT JOIN lf ON lf.user_id = m.user_id AND lf.g = m.g)
SELECT user_id AS job, 'm' || g AS measure_id, override::INT AS override, rest::INT AS rest, ending, pickup FROM f WHERE override IS NOT NULL OR rest IS NOT NULL OR ending IS NOT NULL OR pickup""")
def marks_edited(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    measures, systems = _state(e)
    i, r = F.col("event_id"), F.floor(F.col("event_id") / 7)
    kind = _named(i, "set_measure_number", "clear_measure_number", "set_rest_measure", "set_pickup_measure", "set_ending", "set_system_start")
    target = F.when(i % 6 == 5, F.concat(F.lit(" s"), (i % 10).cast("string"))).otherwise(F.concat(F.lit("m"), (i % 40).cast("string"), F.lit(" ")))
    value = F.when(i % 6 == 2, (r % 4 - 1).cast("string")).when(i % 6 == 3, _named(r, "true", "False", "x")).when(i % 6 == 4, _named(r, "none", "1", " 2", "3")).otherwise((r % 1000 - 3).cast("string"))
    saved = measures.filter("g % 4 = 0").select("job", "measure_id", F.col("g").alias("override"), F.lit(None).cast("int").alias("rest"), F.when(F.col("g") % 8 == 0, "1").alias("ending"), (F.col("g") % 12 == 0).alias("pickup"))
    ok = edits.judged(_edits(e, kind, target, value), measures, systems).filter("reject_reason IS NULL")
    return edits.marks_after(ok, saved, measures)


@query("""WITH ed AS (SELECT user_id, event_id AS ord, event_id % 3 AS t, event_id % 40 AS g, event_id // 3 % 4 AS page, value, (event_id % 600) * 10 AS top FROM events),
ok AS (SELECT * FROM ed WHERE g < 35 AND (t < 2 OR page > 0 AND value BETWEEN 0 AND 5000 AND top <= 5000)),
ev AS (SELECT user_id, g, arg_max({'v': t = 0}, ord) FILTER (WHERE t < 2) AS h, bool_or(t = 1) AS f, arg_max({'v': CASE WHEN t = 2 THEN {'p': page, 'x': round(value, 3), 'y': top} END}, ord) FILTER (WHERE t > 0) AS p FROM ok GROUP BY ALL),
sv AS (SELECT user_id, g FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range(0, 35)) AS g) WHERE g % 5 = 0),
a AS (SELECT coalesce(ev.user_id, sv.user_id) AS job, coalesce(ev.g, sv.g) AS g, CASE WHEN h IS NOT NULL THEN h.v ELSE coalesce(sv.g % 10 = 0, false) END AS hidden, coalesce(f, false) OR coalesce(sv.g % 10 = 5, false) AS forced,
  CASE WHEN p IS NOT NULL THEN p.v.p WHEN sv.g = 20 THEN 1 END::INT AS page, CASE WHEN p IS NOT NULL THEN p.v.x WHEN sv.g = 20 THEN 7 END::DOUBLE AS left, CASE WHEN p IS NOT NULL THEN p.v.y WHEN sv.g = 20 THEN 8 END::DOUBLE AS top FROM ev FULL JOIN sv USING (user_id, g))
SELECT job, 'm' || g AS measure_id, hidden, forced, page, a.left AS left, top FROM a WHERE hidden OR forced OR page IS NOT NULL""")
def labels_edited(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    measures, systems = _state(e)
    i = F.col("event_id")
    target = F.concat(F.when((i % 3 == 1) & (i % 2 == 0), "m").otherwise("label:m"), (i % 40).cast("string"))
    batch = _edits(e, _named(i, "hide_label", "show_label", "move_label"), target, page=F.floor(i / 3) % 4, left=F.col("value"), top=(i % 600) * 10)
    at = lambda v: F.when(F.col("g") == 20, v)
    saved = measures.filter("g % 5 = 0").select("job", "measure_id", (F.col("g") % 10 == 0).alias("hidden"), (F.col("g") % 10 == 5).alias("forced"), at(1).alias("page"), at(7.0).alias("left"), at(8.0).alias("top"))
    ok = edits.judged(batch, measures, systems).filter("reject_reason IS NULL")
    return edits.label_marks_after(ok, saved)


@query("""SELECT user_id AS job, event_id AS ord, CASE event_id % 7 WHEN 0 THEN CASE WHEN event_id % 40 >= 35 OR event_id % 2 = 0 THEN 'invalid_label_id' END WHEN 1 THEN CASE WHEN event_id % 40 >= 35 THEN 'invalid_measure_id' END
  WHEN 2 THEN CASE WHEN event_id % 40 >= 35 OR event_id % 2 = 0 THEN 'invalid_label_id' WHEN event_id // 3 % 4 = 0 OR value > 5000 THEN 'invalid_label_position' END
  WHEN 3 THEN CASE WHEN event_id // 3 % 4 = 0 OR value = 0 OR event_id % 50 > 48 OR event_id % 50 = 0 OR event_id % 120 > 96 OR event_id % 120 = 0 THEN 'invalid_label_erase_area' END
  WHEN 4 THEN CASE WHEN event_id // 3 % 4 = 0 THEN 'invalid_page' WHEN event_id % 5 = 0 THEN 'invalid_rect' END WHEN 5 THEN CASE WHEN event_id // 3 % 4 = 0 THEN 'invalid_page' WHEN event_id % 5 = 0 THEN 'invalid_rect' END ELSE 'unsupported_edit_type' END AS reject_reason FROM events""")
def label_edit_reasons(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    measures, systems = _state(e)
    i = F.col("event_id")
    kind = F.when(i % 7 < 6, _named(i % 7, "hide_label", "show_label", "move_label", "remove_label_area", "replace_manual_rows_for_page", "replace_auto_rows_for_page"))
    target = F.concat(F.when(i % 2 == 0, "m").otherwise("label:m"), (i % 40).cast("string"))
    top = F.when(i % 7 == 3, F.lit(5.0)).otherwise(i % 10)
    left = F.when(i % 7 == 3, F.lit(3.0)).otherwise(F.col("value"))
    page = F.when((i % 7 == 3) & (F.col("value") == 0), 0).otherwise(F.floor(i / 3) % 4)
    batch = _edits(e, kind, target, page=page, left=left, top=top, right=left + i % 120, bottom=top + i % 50)
    right = F.when(i % 5 == 0, 0.0).otherwise(9.0)
    rows = e.filter("event_id % 7 IN (4, 5)").select(F.col("user_id").alias("job"), i.alias("ord"), F.lit(0).alias("row_no"), validate.manual_row_reason(F.lit("r"), F.lit(1), F.lit("grand"), F.lit(1.0), F.lit(1.0), right, F.lit(9.0), F.array(F.lit(4.0))).alias("reason"))
    return edits.judged(batch, measures, systems, rows).select("job", "ord", "reject_reason")


@query("""WITH ed AS (SELECT user_id, event_id AS ord, event_id % 4 AS page, event_id % 5 / 1000 + event_id % 30 AS l, event_id % 20 AS t, event_id % 30 + 40 AS r, event_id % 20 + 1 + event_id % 60 AS b FROM events),
ok AS (SELECT * FROM ed WHERE page > 0 AND b - t <= 48), sv AS (SELECT DISTINCT user_id, 1 AS page, 3.0 AS l, 13.0 AS t, 43.0 AS r, 17.0 AS b FROM events),
n AS (SELECT user_id, page, round(l, 2) AS rl, t, r, b, arg_min(l, ord) AS l FROM ok GROUP BY user_id, page, rl, t, r, b)
SELECT user_id AS job, page::INT AS page, l::DOUBLE AS left, t::DOUBLE AS top, r::DOUBLE AS right, b::DOUBLE AS bottom FROM (SELECT user_id, page, l, t, r, b FROM n WHERE NOT EXISTS (SELECT 1 FROM sv WHERE sv.user_id = n.user_id AND sv.page = n.page AND sv.l = n.rl AND sv.t = n.t AND sv.r = n.r AND sv.b = n.b)
UNION ALL SELECT * FROM sv)""")
def areas_erased(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    measures, systems = _state(e)
    i = F.col("event_id")
    batch = _edits(e, F.lit("remove_label_area"), F.lit(None).cast("string"), page=i % 4, left=i % 5 / 1000 + i % 30, top=i % 20, right=i % 30 + 40, bottom=i % 20 + 1 + i % 60)
    saved = e.select(F.col("user_id").alias("job")).distinct().select("job", F.lit(1).alias("page"), F.lit(3.0).alias("left"), F.lit(13.0).alias("top"), F.lit(43.0).alias("right"), F.lit(17.0).alias("bottom"))
    ok = edits.judged(batch, measures, systems).filter("reject_reason IS NULL")
    return edits.areas_after(ok, saved)


@query("""WITH ed AS (SELECT user_id, event_id AS ord, event_id // 2 % 5 AS page, event_id % 2 = 0 AS manual FROM events WHERE event_id % 3 = 0), u AS (SELECT DISTINCT user_id FROM events),
la AS (SELECT user_id, manual, page, max(ord) AS ord FROM ed WHERE page > 0 AND ord % 11 > 0 GROUP BY ALL), ol AS (SELECT user_id, g % 2 = 0 AS manual, g AS page FROM u, (SELECT unnest(range(1, 7)) AS g))
SELECT user_id AS job, CASE WHEN manual THEN 'manual' ELSE 'auto' END AS kind, page::INT AS page, 'old-' || page AS row_id FROM ol WHERE NOT EXISTS (SELECT 1 FROM la WHERE la.user_id = ol.user_id AND la.manual = ol.manual AND la.page = ol.page)
UNION ALL SELECT user_id, CASE WHEN manual THEN 'manual' ELSE 'auto' END, page::INT, 'new-' || ord || '-' || k FROM la, (SELECT unnest(range(0, 3)) AS k) WHERE k < ord % 4""")
def rows_replaced(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    measures, systems = _state(e)
    i = F.col("event_id")
    kind = F.when(i % 2 == 0, "replace_manual_rows_for_page").otherwise("replace_auto_rows_for_page")
    batch = _edits(e.filter("event_id % 3 = 0"), kind, F.lit("").cast("string"), page=F.floor(i / 2) % 5)
    row = e.filter("event_id % 3 = 0").select(F.col("user_id").alias("job"), i.alias("ord"), F.posexplode(F.sequence(F.lit(0), F.lit(2))).alias("row_no", "k"))
    payload = row.filter("k < ord % 4 OR ord % 11 = 0").select("job", "ord", "row_no", F.concat_ws("-", F.lit("new"), "ord", "k").alias("row_id"), F.when((F.col("ord") % 11 == 0), "invalid_rect").alias("reason"))
    old = systems.filter("system_id BETWEEN 's1' AND 's6'").select("job", F.substring("system_id", 2, 9).cast("int").alias("page"))
    old = old.select("job", F.when(F.col("page") % 2 == 0, "manual").otherwise("auto").alias("kind"), "page", F.concat_ws("-", F.lit("old"), "page").alias("row_id"))
    ok = edits.judged(batch, measures, systems, payload).filter("reject_reason IS NULL")
    return edits.rows_after(ok, old, payload)
