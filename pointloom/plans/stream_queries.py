"""Batch forms of the streams, and a composed pipeline, as queries."""

from __future__ import annotations

from ..functions.expr import r6
from ..streaming import metrics as s
from . import query, spec
from .views import LI, points_li, r6 as s6, table


@query("windowed_metrics", f"SELECT time_bucket(INTERVAL 1 hour, ts) AS start, time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour AS \"end\", event_type, count(*) AS n, {s6('avg(value)')} AS avg, max(value) AS max FROM events GROUP BY ALL")
def windowed_metrics(spark, sf):
    return s.windowed(table(spark, sf, "events")).select("start", "end", "event_type", "n", r6("avg").alias("avg"), "max")


@query("event_sessions", """WITH g AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 30 minutes, true)::INT AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 minutes AS "end", count(*) AS n FROM k GROUP BY user_id, s""")
def event_sessions(spark, sf):
    return s.sessions(table(spark, sf, "events"))


_SPEC = [
    {"type": "center_shift"},
    {"type": "point_clip", "box": [-15, -30, 0, 15, 30, 8]},
    {"type": "crop_boundary"},
    {"type": "normalize_color"},
]


@query("composed_pipeline", f"""WITH {LI}, m AS (SELECT *, x - (min(x) OVER w + max(x) OVER w) / 2 AS cx, y - (min(y) OVER w + max(y) OVER w) / 2 AS cy, z - min(z) OVER w AS cz FROM li WINDOW w AS (PARTITION BY scene))
SELECT scene, point_idx, {s6('least(greatest(cx, -15), 15)')} AS x, {s6('least(greatest(cy, -30), 30)')} AS y, {s6('least(greatest(cz, 0), 8)')} AS z, {s6('r / 255')} AS r FROM m WHERE segment NOT IN (0, 1)""")
def composed_pipeline(spark, sf):
    return spec.compose(_SPEC)(points_li(spark, sf)).select("scene", "point_idx", *(r6(c).alias(c) for c in ("x", "y", "z", "r")))
