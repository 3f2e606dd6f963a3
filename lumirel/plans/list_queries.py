"""Queries on lists of images, joins by nearness, frames and windows of time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.spectral import doppler_speed
from ..operators import joins, lists, stencil
from ..sources.images import images, pixels, table
from ..streaming import frames
from .registry import query, r4, s4

IMG = ["image_id", "y", "x", "v"]


@query(
    """WITH {px}, far AS (SELECT * FROM px WHERE abs(pixel_shift) >= 8), s AS (SELECT image_id, avg(v) AS mean, avg(CASE WHEN v >= 60000 THEN 1.0 ELSE 0.0 END) AS burnt FROM far GROUP BY image_id),
r AS (SELECT image_id, row_number() OVER (ORDER BY mean DESC, image_id) AS place, (SELECT count(*) FROM s) AS n FROM s WHERE burnt < 0.125)
SELECT y, x, median(v) AS v FROM far WHERE image_id IN (SELECT image_id FROM r WHERE place <= floor(0.8 * n)) GROUP BY y, x"""
)
def continuum(spark, sf_dir):
    return lists.continuum(pixels(spark, sf_dir))


def _named(spark, sf_dir):
    """Customers as a list of files: names, shifts and an ordinal."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ordinal"), F.col("o_orderpriority").alias("file_name"), F.col("o_orderstatus").alias("dir_name"), (F.col("o_custkey") % 31 - 15).cast("double").alias("pixel_shift"), F.col("o_orderdate").alias("ts")
    )


@query("SELECT o_orderkey AS ordinal FROM orders WHERE o_orderpriority LIKE '1%' AND o_custkey % 31 - 15 >= 3 AND o_orderdate > TIMESTAMP '1995-01-01'")
def filter_list(spark, sf_dir):
    out = lists.filter_list(lists.filter_list(_named(spark, sf_dir), "file-name", "starts-with", "1"), "pixelShift", ">=", 3.0)
    return lists.filter_list(out, "datetime", ">", "1995-01-01 00:00:00").select("ordinal")


@query("SELECT o_orderkey AS ordinal, o_custkey % 31 - 15 AS shift, row_number() OVER (ORDER BY o_custkey % 31 - 15 DESC, o_orderkey) AS place FROM orders QUALIFY place <= 20")
def sort_top(spark, sf_dir):
    top = lists.sort_list(_named(spark, sf_dir), "shift desc").limit(20)
    from pyspark.sql import Window

    return top.select("ordinal", F.col("pixel_shift").cast("long").alias("shift"), F.row_number().over(Window.orderBy(F.desc("pixel_shift"), "ordinal")).cast("long").alias("place"))


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def list_minus(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    building = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return lists.minus(orders, building, ["o_custkey"])


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM orders WHERE o_custkey % 2 = 0")
def list_concat(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k")).unionByName(orders.filter("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("k")))


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_orderkey FROM orders WHERE o_custkey % 2 = 0")
def list_intersect(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k")).intersect(orders.filter("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("k")))


@query("SELECT vec_id AS image_id FROM embeddings WHERE vec_id % 31 - 15 IN (-6, -3, 0, 3, 6)")
def image_range(spark, sf_dir):
    return lists.image_range(images(spark, sf_dir), -6, 6, 3).select("image_id")


@query("WITH {px}, h AS (SELECT image_id, bool_and(v > 22000) AS holds FROM px GROUP BY image_id) SELECT image_id, y, x, CASE WHEN holds THEN v ELSE 65535 - v END AS v FROM px JOIN h USING (image_id)")
def conditional_all_pixels(spark, sf_dir):
    return lists.choose(pixels(spark, sf_dir), F.col("v") > 22000, F.col("v"), 65535 - F.col("v")).select(*IMG)


@query("WITH {px} SELECT image_id, bool_and(v <> 32767) AS holds FROM px GROUP BY image_id")
def ifneq_image(spark, sf_dir):
    return lists.all_pixels(pixels(spark, sf_dir), F.col("v") != 32767)


@query(
    f"""WITH {{px}}, n AS (SELECT *, lead(v) OVER (PARTITION BY grp, y, x ORDER BY image_id) AS nv FROM px)
SELECT image_id, y, x, CAST(s AS INT) AS step, {s4("v + (nv - v) * (CASE WHEN s / 4.0 < 0.5 THEN 2 * (s / 4.0) * (s / 4.0) ELSE 1 - 2 * (1 - s / 4.0) * (1 - s / 4.0) END)")} AS v FROM n, generate_series(1, 3) g(s) WHERE nv IS NOT NULL"""
)
def transition(spark, sf_dir):
    return lists.transition(pixels(spark, sf_dir), 3, easing="ease_in_out").select("image_id", "y", "x", "step", r4(F.col("v")).alias("v"))


_SHARP = """lap AS (SELECT a.image_id, a.grp, sum(b.v * (CASE WHEN dy = 0 THEN -2 ELSE 1 END) * (CASE WHEN dx = 0 THEN -2 ELSE 1 END)) AS r FROM px a, (VALUES (-1), (0), (1)) dy(dy), (VALUES (-1), (0), (1)) dx(dx), px b
  WHERE b.image_id = a.image_id AND b.y = a.y + dy AND b.x = a.x + dx AND a.y BETWEEN 1 AND 6 AND a.x BETWEEN 1 AND 6 GROUP BY a.image_id, a.grp, a.y, a.x), sh AS (SELECT image_id, grp, avg(r * r) AS e FROM lap GROUP BY image_id, grp)"""


@query(f"WITH {{px}}, {_SHARP} SELECT grp, arg_max(image_id, e) AS image_id FROM sh GROUP BY grp")
def stack_ref(spark, sf_dir):
    score = stencil.sharpness(pixels(spark, sf_dir)).join(images(spark, sf_dir).select("image_id", "grp"), "image_id")
    return lists.reference_image(score, "sharpness", "grp")


@query(
    f"""WITH {{px}}, {_SHARP}, k AS (SELECT image_id, grp, exp(-3.0 * e / max(e) OVER (PARTITION BY grp)) AS w, row_number() OVER (PARTITION BY grp ORDER BY e, image_id) AS r, count(*) OVER (PARTITION BY grp) AS n FROM sh)
SELECT px.grp, y, x, {s4("sum(w * v) / sum(w)")} AS v FROM px JOIN k USING (image_id) WHERE r <= ceil(0.5 * n) GROUP BY px.grp, y, x"""
)
def stack_dedis(spark, sf_dir):
    px = pixels(spark, sf_dir)
    errors = stencil.sharpness(px).withColumnRenamed("sharpness", "error").join(images(spark, sf_dir).select("image_id", "grp"), "image_id")
    return lists.stack_best(px, errors, 0.5).withColumn("v", r4(F.col("v")))


@query(
    """WITH q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')
SELECT q.event_id, (SELECT e.event_id FROM events e WHERE e.event_type = 'view' AND e.user_id = q.user_id AND e.ts <= q.ts ORDER BY e.ts DESC, e.event_id DESC LIMIT 1) AS r_event_id FROM q"""
)
def asof_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    bought, seen = (events.filter(F.col("event_type") == t).drop("event_type") for t in ("purchase", "view"))
    return joins.asof(bought, seen, "ts", "ts", ["user_id"], "event_id").select("event_id", "r_event_id")


@query(
    """WITH a AS (SELECT event_id AS a_id, ts AS a_ts FROM events WHERE event_type = 'signup'), b AS (SELECT event_id AS b_id, ts AS b_ts FROM events WHERE event_type = 'error')
SELECT a_id, arg_min(b_id, (abs(epoch_us(a_ts) - epoch_us(b_ts)), b_id)) AS b_id, min(abs(epoch_us(a_ts) - epoch_us(b_ts))) AS gap_us FROM a JOIN b ON abs(epoch_us(a_ts) - epoch_us(b_ts)) <= 3600000000 GROUP BY a_id"""
)
def nearest_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    a = events.filter("event_type = 'signup'").select(F.col("event_id").alias("a_id"), F.col("ts").alias("a_ts"))
    b = events.filter("event_type = 'error'").select(F.col("event_id").alias("b_id"), F.col("ts").alias("b_ts"))
    return joins.nearest_in_time(a, b, "a_ts", "b_ts", "a_id", "b_id", 3600)


@query("SELECT l_orderkey, l_linenumber, s_suppkey FROM lineitem JOIN supplier ON l_extendedprice BETWEEN s_acctbal * 5 AND s_acctbal * 5 + 500")
def range_join_lines(spark, sf_dir):
    windows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") * 5).alias("low"), (F.col("s_acctbal") * 5 + 500).alias("high"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return joins.range_join(lines, windows, F.col("l_extendedprice"), "low", "high", 500.0).select("l_orderkey", "l_linenumber", "s_suppkey")


@query(
    """WITH {px}, p AS (SELECT image_id, image_id * 100 + y * 10 + x AS id, x::DOUBLE AS px, y::DOUBLE AS py FROM px WHERE v > 38000)
SELECT a.id, b.id AS o_id FROM p a JOIN p b ON a.image_id = b.image_id AND (a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) <= 4"""
)
def points_within_radius(spark, sf_dir):
    bright = pixels(spark, sf_dir).filter("v > 38000").select("image_id", (F.col("image_id") * 100 + F.col("y") * 10 + F.col("x")).alias("id"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    return joins.within_radius(bright, bright, 2.0, "image_id").select("id", "o_id")


@query(
    """WITH {px} SELECT a.image_id AS q_id, b.image_id, sum((a.v - b.v) * (a.v - b.v)) AS d2, row_number() OVER (PARTITION BY a.image_id ORDER BY sum((a.v - b.v) * (a.v - b.v)), b.image_id) AS place
FROM px a JOIN px b ON a.y = b.y AND a.x = b.x AND a.image_id <> b.image_id WHERE a.image_id < 5 GROUP BY a.image_id, b.image_id QUALIFY place <= 3"""
)
def knn_images(spark, sf_dir):
    all_images = images(spark, sf_dir)
    return joins.nearest_images(all_images.filter("image_id < 5"), all_images, 3).withColumn("place", F.col("place").cast("long"))


@query(
    """WITH {px} SELECT a.image_id AS q_id, b.image_id, sum((a.v - b.v) * (a.v - b.v)) AS d2, row_number() OVER (PARTITION BY a.image_id ORDER BY sum((a.v - b.v) * (a.v - b.v)), b.image_id) AS place
FROM px a JOIN px b ON a.y = b.y AND a.x = b.x AND a.image_id <> b.image_id WHERE a.image_id % 100 = 0 GROUP BY a.image_id, b.image_id QUALIFY place <= 3"""
)
def knn_all_images(spark, sf_dir):
    """knn_images for every hundredth image of a table, whose number grows with the table."""
    all_images = images(spark, sf_dir)
    return joins.nearest_images(all_images.filter("image_id % 100 = 0"), all_images, 3).withColumn("place", F.col("place").cast("long"))


@query(f"SELECT event_id, {s4('value * 0.0183 / 656.2808 * 299792.458')} AS speed FROM events")
def doppler(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", r4(doppler_speed(F.col("value"), 0.0183, 656.2808)).alias("speed"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS label, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def video_datetime(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("label"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY ALL")
def events_tumbling(spark, sf_dir):
    return frames.tumbling(table(spark, sf_dir, "events"))


@query("WITH s AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR AS start FROM events, generate_series(0, 1) g(k)) SELECT start, count(*) AS n FROM s GROUP BY start")
def events_sliding(spark, sf_dir):
    return frames.sliding(table(spark, sf_dir, "events"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM k GROUP BY user_id, k"""
)
def events_session(spark, sf_dir):
    return frames.sessions(table(spark, sf_dir, "events"))


@query(
    """WITH b AS (SELECT vec_id AS image_id, label AS grp, vec_id % 31 - 15 AS s FROM embeddings) SELECT grp, arg_min(s, (abs(s), image_id)) AS shift, count(DISTINCT s) AS shifts, max(image_id) AS last_image FROM b GROUP BY grp"""
)
def merged_metadata(spark, sf_dir):
    shift = F.col("pixel_shift").cast("long")
    return images(spark, sf_dir).groupBy("grp").agg(F.min_by(shift, F.struct(F.abs("pixel_shift"), "image_id")).alias("shift"), F.countDistinct("pixel_shift").alias("shifts"), F.max("image_id").alias("last_image"))
