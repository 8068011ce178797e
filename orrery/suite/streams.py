"""Windows, change logs, conflict-free merges and stateful operators, in their batch form."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import replication as R
from ..registry import query
from ..streaming import stateful, windows
from .common import r6, t


def _aggs():
    return [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")]


@query("window_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def window_tumbling(spark, d):
    return windows.tumbling(t(spark, d, "events"), "ts", "1 hour", ["event_type"], _aggs(), "10 minutes")


@query("window_sliding", "WITH x AS (SELECT *, unnest([0, 1]) AS k FROM events) SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k AS window_start, time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k + INTERVAL 1 HOUR AS window_end, count(*) AS n, round(sum(value), 4) AS total FROM x GROUP BY 1, 2")
def window_sliding(spark, d):
    return windows.sliding(t(spark, d, "events"), "ts", "1 hour", "30 minutes", [], _aggs(), "10 minutes")


@query("window_session", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g) SELECT min(ts) AS window_start, max(ts) + INTERVAL 2 HOUR AS window_end, user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, sid")
def window_session(spark, d):
    return windows.sessions(t(spark, d, "events"), "ts", "2 hours", ["user_id"], _aggs(), "10 minutes")


@query("latest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(spark, d):
    return windows.latest(t(spark, d, "events"), "user_id", "ts", ["event_id", "event_type"])


def _replicas(spark, d):
    return t(spark, d, "events").withColumn("replica", F.col("user_id") % 3)


@query("crdt_g_counter", "SELECT event_type, sum(v)::BIGINT AS value FROM (SELECT event_type, user_id % 3 AS r, max(event_id) AS v FROM events GROUP BY 1, 2) GROUP BY 1")
def crdt_g_counter(spark, d):
    return R.g_counter(_replicas(spark, d), "event_type", "replica", "event_id").select("event_type", F.col("value").cast("bigint").alias("value"))


@query("crdt_lww", "SELECT event_type, arg_max(value, (ts, user_id % 3)) AS value, max(ts) AS ts FROM events GROUP BY 1")
def crdt_lww(spark, d):
    return R.lww(_replicas(spark, d), "event_type", "value", "ts", "replica")


@query("crdt_or_set", "SELECT DISTINCT event_type, user_id FROM events WHERE event_id % 5 <> 0")
def crdt_or_set(spark, d):
    e = t(spark, d, "events")
    return R.or_set(e, e.where("event_id % 5 = 0"), "event_type", "user_id", "event_id")


@query("resolve_conflicts", "SELECT user_id, round(avg(value), 6) AS average, round(max(value), 6) AS most FROM events GROUP BY 1")
def resolve_conflicts(spark, d):
    e = t(spark, d, "events")
    a = R.resolve(e, "user_id", "average").select("user_id", r6("value").alias("average"))
    return a.join(R.resolve(e, "user_id", "max").select("user_id", r6("value").alias("most")), "user_id")


@query("replay_log", "WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS op, arg_max(value, event_id) AS v FROM events GROUP BY 1) SELECT user_id, round(v, 6) AS value FROM l WHERE op <> (SELECT min(event_type) FROM events)")
def replay_log(spark, d):
    e = t(spark, d, "events")
    gone = e.agg(F.min("event_type")).first()[0]
    log = e.select("user_id", F.col("event_id").alias("sequence"), F.when(F.col("event_type") == gone, "delete").otherwise("update").alias("operation"), "value")
    return R.replay(e.select("user_id", "value").limit(0), log, "user_id", ["value"]).select("user_id", r6("value").alias("value"))


@query("log_checksums", "SELECT 0 AS bad")
def log_checksums(spark, d):
    log = R.log_entries(t(spark, d, "events").select(F.col("event_id").alias("sequence"), "event_type", "value"))
    return R.log_valid(log).agg(F.count("*").cast("int").alias("bad"))


@query("vector_deltas", "SELECT count(*) AS n, true AS same FROM embeddings")
def vector_deltas(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", "embedding", F.lead("embedding").over(W.partitionBy("label").orderBy("vec_id")).alias("nxt")).withColumn("nxt", F.coalesce("nxt", "embedding"))
    delta = R.delta_capture(F.col("embedding"), F.col("nxt"))
    back = R.delta_apply(R.delta_apply(F.col("embedding"), delta), R.delta_inverse(delta))
    worst = F.array_max(F.zip_with(back, "embedding", lambda x, y: F.abs(x - y)))
    return e.agg(F.count("*").alias("n"), (F.max(worst) < 1e-9).alias("same"))


@query("drift_zscore", "SELECT event_id, round((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 5) AS z FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)")
def drift_zscore(spark, d):
    return windows.drift(t(spark, d, "events"), "value", ["event_id"], 50, ["event_type"]).select("event_id", F.round("z", 5).alias("z"))


@query("cross_correlation", "WITH m AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS t, event_type AS s, avg(value) AS v FROM events GROUP BY 1, 2) SELECT x.s AS a, y.s AS b, round(corr(x.v, y.v), 5) AS correlation FROM m x JOIN m y ON x.t = y.t AND x.s < y.s GROUP BY 1, 2")
def cross_correlation(spark, d):
    return windows.correlation(t(spark, d, "events"), "ts", "1 hour", "event_type", "value").select("a", "b", F.round("correlation", 5).alias("correlation"))


# Folds over a key's rows: each element is a state, of which the first holds nothing yet.
_DEDUP = """WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT label, vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM e),
l AS (SELECT label, list({'id': vec_id, 'u': list_transform(list_zip(v, list_transform(v, lambda x: n)), lambda p: p[1] / p[2]), 'kept': []::DOUBLE[][], 'best': -1.0::DOUBLE, 'out': []::STRUCT(id BIGINT, duplicate BOOLEAN, similarity DOUBLE)[]} ORDER BY vec_id) AS rows FROM u GROUP BY 1),
f AS (SELECT label, list_reduce(list_prepend({'id': -1::BIGINT, 'u': []::DOUBLE[], 'kept': []::DOUBLE[][], 'best': -1.0::DOUBLE, 'out': []::STRUCT(id BIGINT, duplicate BOOLEAN, similarity DOUBLE)[]}, rows), lambda a, r: {
 'id': r.id, 'u': r.u,
 'kept': CASE WHEN coalesce(list_max(list_transform(a.kept, lambda k: list_inner_product(k, r.u))), -1.0) >= 0.5 THEN a.kept ELSE list_append(a.kept, r.u)[-50:] END,
 'best': -1.0::DOUBLE,
 'out': list_append(a.out, {'id': r.id, 'duplicate': coalesce(list_max(list_transform(a.kept, lambda k: list_inner_product(k, r.u))), -1.0) >= 0.5, 'similarity': coalesce(list_max(list_transform(a.kept, lambda k: list_inner_product(k, r.u))), -1.0)})}) AS s FROM l),
o AS (SELECT label, unnest(s.out) AS x FROM f) SELECT label::VARCHAR AS key, x.id AS id, x.duplicate AS duplicate, round(x.similarity, 6) AS similarity FROM o"""
_GATE = """WITH RECURSIVE e AS (SELECT event_type AS key, event_id AS id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
g AS (SELECT key, 0::BIGINT AS n, 0::BIGINT AS id, 0.0::DOUBLE AS value, 0.0::DOUBLE AS residual, 0.0::DOUBLE AS p, false AS out FROM e GROUP BY 1 UNION ALL
SELECT e.key, e.n, e.id, e.value, abs(e.value - g.p), CASE WHEN abs(e.value - g.p) > 20 THEN 0.7 * g.p + 0.3 * e.value ELSE g.p END, abs(e.value - g.p) > 20 FROM g JOIN e ON e.key = g.key AND e.n = g.n + 1)
SELECT key, id, value, round(residual, 6) AS residual FROM g WHERE out"""
_FORECAST = """WITH l AS (SELECT event_type AS key, list({'l': value::DOUBLE, 't': 0.0::DOUBLE} ORDER BY ts, value) AS rows FROM events GROUP BY 1),
f AS (SELECT key, list_reduce(rows, lambda a, r: {'l': 0.3 * r.l + 0.7 * (a.l + a.t), 't': 0.1 * ((0.3 * r.l + 0.7 * (a.l + a.t)) - a.l) + 0.9 * a.t}) AS s FROM l)
SELECT key, step::BIGINT AS step, round(s.l + s.t * step, 6) AS forecast FROM f, range(1, 4) x(step)"""


@query("similarity_dedup", _DEDUP)
def similarity_dedup(spark, d):
    e = t(spark, d, "embeddings")
    found = stateful.similarity_dedup(e.select(F.col("label").cast("string").alias("key"), F.col("vec_id").alias("id"), F.col("vec_id").alias("ts"), F.col("embedding").alias("vector")), 50, 0.5)
    return found.withColumn("similarity", r6("similarity"))


@query("residual_gate", _GATE)
def residual_gate(spark, d):
    e = t(spark, d, "events")
    return stateful.residual_gate(e.select(F.col("event_type").alias("key"), F.col("event_id").alias("id"), "ts", "value"), 20.0).withColumn("residual", r6("residual"))


@query("trend_forecast", _FORECAST)
def trend_forecast(spark, d):
    return stateful.forecasts(t(spark, d, "events").select(F.col("event_type").alias("key"), "ts", "value"), 3).withColumn("forecast", r6("forecast"))
