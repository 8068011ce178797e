"""Distances, top-k, kNN joins, filters, ranking, sparse and quantized vectors, geometry, distributions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import curved, distributions, geo, quantize, sparse, text, vectors
from ..operators import aggregates, filters, retrieval, search
from ..plans import vector_sql
from ..registry import query
from ..streaming import windows
from .common import query_vector, r6, t

Q0 = "WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
Z = "list_zip(e.v, q.v)"
DIST = {
    "l2": "sqrt(list_sum(list_transform(%s, lambda p: (p[1]-p[2])*(p[1]-p[2]))))" % Z,
    "cosine": "1 - list_inner_product(e.v, q.v) / (sqrt(list_inner_product(e.v, e.v)) * sqrt(list_inner_product(q.v, q.v)))",
    "ip": "-list_inner_product(e.v, q.v)",
    "l1": "list_sum(list_transform(%s, lambda p: abs(p[1]-p[2])))" % Z,
    "chebyshev": "list_max(list_transform(%s, lambda p: abs(p[1]-p[2])))" % Z,
    "canberra": "list_sum(list_transform(%s, lambda p: CASE WHEN abs(p[1])+abs(p[2]) = 0 THEN 0 ELSE abs(p[1]-p[2])/(abs(p[1])+abs(p[2])) END))" % Z,
    "bray_curtis": "list_sum(list_transform(%s, lambda p: abs(p[1]-p[2]))) / list_sum(list_transform(%s, lambda p: abs(p[1])+abs(p[2])))" % (Z, Z),
    "hamming_sign": "list_sum(list_transform(%s, lambda p: CASE WHEN (p[1]<0) <> (p[2]<0) THEN 1 ELSE 0 END))" % Z,
}


def _topk(metric: str):
    def run(spark, d):
        out = search.top_k(t(spark, d, "embeddings"), "embedding", query_vector(spark, d), 10, metric)
        # Adding zero turns a negative zero into zero.
        return out.select("vec_id", "label", (r6(F.col("distance").cast("double")) + 0.0).alias("distance"))

    return run


for _m, _e in DIST.items():
    query(f"topk_{_m}", f"{Q0} SELECT vec_id, label, round(({_e})::DOUBLE, 6) + 0.0 AS distance FROM e, q ORDER BY {_e}, vec_id LIMIT 10")(_topk(_m))


@query("topk_minkowski3", f"{Q0}, d AS (SELECT vec_id, pow(list_sum(list_transform({Z}, lambda p: pow(abs(p[1]-p[2]), 3))), 1.0/3) AS x FROM e, q) SELECT vec_id, round(x, 6) AS distance FROM d ORDER BY x, vec_id LIMIT 10")
def topk_minkowski3(spark, d):
    dist = vectors.minkowski(F.col("embedding"), query_vector(spark, d), 3)
    return t(spark, d, "embeddings").withColumn("x", dist).orderBy("x", "vec_id").limit(10).select("vec_id", r6("x").alias("distance"))


@query("range_l2", f"{Q0} SELECT vec_id, round({DIST['l2']}, 6) AS distance FROM e, q WHERE {DIST['l2']} < 1.3")
def range_l2(spark, d):
    return search.within(t(spark, d, "embeddings"), "embedding", query_vector(spark, d), 1.3).select("vec_id", r6("distance").alias("distance"))


@query("filtered_topk", f"{Q0} SELECT vec_id, label, round({DIST['l2']}, 6) AS distance FROM e, q WHERE label = 1 ORDER BY {DIST['l2']}, vec_id LIMIT 5")
def filtered_topk(spark, d):
    out = search.filtered_top_k(t(spark, d, "embeddings"), "embedding", query_vector(spark, d), 5, F.col("label") == 1)
    return out.select("vec_id", "label", r6("distance").alias("distance"))


@query("post_filtered_topk", f"{Q0}, k AS (SELECT vec_id, label, {DIST['l2']} AS x FROM e, q ORDER BY x, vec_id LIMIT 20) SELECT vec_id, label, round(x, 6) AS distance FROM k WHERE label = 1")
def post_filtered_topk(spark, d):
    out = search.filtered_top_k(t(spark, d, "embeddings"), "embedding", query_vector(spark, d), 20, F.col("label") == 1, "post")
    return out.select("vec_id", "label", r6("distance").alias("distance"))


_KNN = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, {dist} AS x FROM e q JOIN e c ON q.vec_id < 10 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x, id) AS rank FROM s)
SELECT query_id, id, round(x, 6) AS distance, rank::INTEGER AS rank FROM r WHERE rank <= {k}"""
_COS_PAIR = "1 - list_inner_product(q.v, c.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(c.v, c.v)))"
_L2_PAIR = "sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1]-p[2])*(p[1]-p[2]))))"


def _knn(spark, d, k, metric):
    e = t(spark, d, "embeddings")
    return search.knn_join(e.where("vec_id < 10"), e, k, metric)


@query("knn_join_exact", _KNN.format(dist=_COS_PAIR, k=10))
def knn_join_exact(spark, d):
    return _knn(spark, d, 10, "cosine").select("query_id", "id", r6("distance").alias("distance"), "rank")


@query("knn_join_l2_k3", _KNN.format(dist=_L2_PAIR, k=3))
def knn_join_l2_k3(spark, d):
    return _knn(spark, d, 3, "l2").select("query_id", "id", r6("distance").alias("distance"), "rank")


@query("knn_join_all", _KNN.format(dist=_L2_PAIR, k=3).replace("q.vec_id < 10 AND ", ""))
def knn_join_all(spark, d):
    e = t(spark, d, "embeddings")
    return search.knn_join(e, e, 3).select("query_id", "id", r6("distance").alias("distance"), "rank")


@query("similarity_join", f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT q.vec_id AS a, c.vec_id AS b, round({_COS_PAIR}, 6) AS distance FROM e q JOIN e c ON q.vec_id < c.vec_id WHERE {_COS_PAIR} < 0.5")
def similarity_join(spark, d):
    e = t(spark, d, "embeddings")
    return search.similarity_join(e, e, 0.5).select("a", "b", r6("distance").alias("distance"))


@query("recall_of_ivf")
def recall_of_ivf(spark, d):
    """Recall of approximate search (IVF, 8 of 16 lists) against exact, for one query."""
    e = t(spark, d, "embeddings")
    index, c = search.ivf_build(e, 16)
    q = query_vector(spark, d)
    found = search.ivf_search(index, c, q, 10, 8).select(F.lit(0).cast("bigint").alias("query_id"), F.col("vec_id").alias("id"))
    exact = search.top_k(e, "embedding", q, 10).select(F.lit(0).cast("bigint").alias("query_id"), F.col("vec_id").alias("id"))
    return search.recall(found, exact)


@query("soft_topk", f"{Q0}, k AS (SELECT vec_id, list_inner_product(e.v, q.v) / (sqrt(list_inner_product(e.v, e.v)) * sqrt(list_inner_product(q.v, q.v))) AS s FROM e, q ORDER BY 1 - s, vec_id LIMIT 10) SELECT vec_id, round(exp((s - m) / 0.5) / (SELECT sum(exp((s - m) / 0.5)) FROM k, (SELECT max(s) AS m FROM k)), 6) AS weight FROM k, (SELECT max(s) AS m FROM k)")
def soft_topk(spark, d):
    return search.soft_top_k(t(spark, d, "embeddings"), "embedding", query_vector(spark, d), 10, 0.5).select("vec_id", r6("weight").alias("weight"))


@query("mmr_rerank")
def mmr_rerank(spark, d):
    e = t(spark, d, "embeddings")
    near = _knn(spark, d, 30, "cosine").join(e.select(F.col("vec_id").alias("id"), "embedding"), "id")
    return search.mmr(near.withColumn("score", 1 - F.col("distance")), 5, 0.5)


@query("pairwise_l2_sum", f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT round(sum({_L2_PAIR}), 4) AS total, count(*) AS n FROM e q JOIN e c ON q.vec_id < c.vec_id")
def pairwise_l2_sum(spark, d):
    return search.pairwise_total(t(spark, d, "embeddings")).select(F.round("total", 4).alias("total"), "n")


@query("distance_histogram", f"{Q0}, x AS (SELECT {DIST['l2']} AS x FROM e, q WHERE vec_id > 0) SELECT (CASE WHEN x < 1 THEN 0 WHEN x >= 2 THEN 11 ELSE floor((x - 1) * 10) + 1 END)::BIGINT AS bucket, count(*) AS n, round(avg(x), 6) AS mean FROM x GROUP BY 1")
def distance_histogram(spark, d):
    e = t(spark, d, "embeddings").where("vec_id > 0").withColumn("x", vectors.l2(F.col("embedding"), query_vector(spark, d)))
    return aggregates.histogram(e, "x", 1.0, 2.0, 10).select("bucket", "n", r6("mean").alias("mean"))


@query("distance_stats", f"{Q0}, x AS (SELECT {DIST['l2']} AS x FROM e, q WHERE vec_id > 0) SELECT round(min(x),6) AS min, round(max(x),6) AS max, round(avg(x),6) AS mean, round(stddev_samp(x),6) AS std, count(*) AS n FROM x")
def distance_stats(spark, d):
    e = t(spark, d, "embeddings").where("vec_id > 0").withColumn("distance", vectors.l2(F.col("embedding"), query_vector(spark, d)))
    s = aggregates.distance_stats(e)
    return s.select(*[r6(c).alias(c) for c in ("min", "max", "mean", "std")], "n")


_POS = "WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS pos FROM embeddings)"
for _how, _sql in (("sum", "sum(v)"), ("mean", "avg(v)"), ("max", "max(v)")):

    def _vagg(how):
        def run(spark, d):
            return aggregates.vector_aggregate(t(spark, d, "embeddings"), ["label"], "embedding", how).select("label", F.posexplode("vector").alias("pos", "y")).select("label", "pos", r6("y").alias("value"))

        return run

    query(f"vector_{_how}", f"{_POS} SELECT label, pos::INTEGER AS pos, round({_sql}, 6) AS value FROM x GROUP BY label, pos")(_vagg(_how))


@query("vector_norms", "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * 2)), 6) AS doubled FROM embeddings")
def vector_norms(spark, d):
    e = F.col("embedding")
    return t(spark, d, "embeddings").select("vec_id", r6(vectors.norm(e)).alias("norm"), r6(vectors.fold(vectors.scale(e, 2.0))).alias("doubled"))


@query("consecutive_consistency", "WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM embeddings) SELECT label, round(avg(list_inner_product(v, w) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(w, w)))), 6) AS consistency FROM e WHERE w IS NOT NULL GROUP BY label")
def consecutive_consistency(spark, d):
    return aggregates.consistency(t(spark, d, "embeddings"), "embedding", ["vec_id"], ["label"]).select("label", r6("consistency").alias("consistency"))


# --- filters ------------------------------------------------------------------------------------------------------

_K = "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)"
FILTERS = {
    "eq": (("eq", "k", 3), f"coalesce({_K} = 3, false)"), "ne": (("ne", "k", 3), f"coalesce({_K} <> 3, true)"), "ne_missing": (("ne", "nothing", 3), "true"),
    "gt": (("gt", "k", 50), f"coalesce({_K} > 50, false)"), "gte": (("gte", "k", 50), f"coalesce({_K} >= 50, false)"), "lt": (("lt", "k", 5), f"coalesce({_K} < 5, false)"), "lte": (("lte", "k", 5), f"coalesce({_K} <= 5, false)"),
    "range": (("range", "k", 10, 20), f"coalesce({_K} BETWEEN 10 AND 20, false)"), "range_open": (("range_open", "k", 10, 20), f"coalesce({_K} >= 10 AND {_K} < 20, false)"), "in": (("in", "k", [1, 2, 3]), f"coalesce({_K} IN (1,2,3), false)"),
    "exists": (("exists", "k"), f"{_K} IS NOT NULL"), "is_null": (("is_null", "nothing"), "true"), "not_missing": (("not", ("eq", "nothing", 1)), "true"),
    "and_or": (("and", [("gt", "k", 5), ("or", [("lt", "k", 8), ("eq", "k", 42)])]), f"coalesce({_K} > 5, false) AND (coalesce({_K} < 8, false) OR coalesce({_K} = 42, false))"),
}
for _n, (_tree, _where) in FILTERS.items():

    def _f(tree):
        def run(spark, d):
            return filters.where(t(spark, d, "events"), tree, json_column="props").select("event_id", "event_type")

        return run

    query(f"filter_{_n}", f"SELECT event_id, event_type FROM events WHERE {_where}")(_f(_tree))


@query("filter_columns", "SELECT event_id, value FROM events WHERE value >= 10 AND event_type LIKE 'c%' AND NOT coalesce(user_id = 3, false)")
def filter_columns(spark, d):
    return filters.where(t(spark, d, "events"), ("and", [("gte", "value", 10.0), ("like", "event_type", "c%"), ("not", ("eq", "user_id", 3))])).select("event_id", "value")


@query("filter_text_match", "SELECT doc_id FROM documents WHERE list_contains(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> ''), 'license')")
def filter_text_match(spark, d):
    return filters.where(t(spark, d, "documents"), ("text", "text", "license")).select("doc_id")


_GEO = "SELECT event_id AS id, 40.0 + (event_id % 100) / 100.0 AS lat, -74.0 + (event_id % 37) / 37.0 AS lon FROM events"
_HAV = "2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(lat - 40.7128) / 2), 2) + cos(radians(40.7128)) * cos(radians(lat)) * pow(sin(radians(lon + 74.0060) / 2), 2))))"


def _places(spark, d):
    i = F.col("event_id")
    return t(spark, d, "events").select(i.alias("id"), (40.0 + (i % 100) / 100.0).alias("lat"), (-74.0 + (i % 37) / 37.0).alias("lon"))


@query("geo_radius", f"SELECT id, round(({_HAV}) / 1000, 6) AS km FROM ({_GEO}) WHERE {_HAV} <= 20000")
def geo_radius(spark, d):
    p = _places(spark, d).where(geo.within_radius(F.col("lat"), F.col("lon"), 40.7128, -74.0060, 20_000))
    return p.select("id", r6(geo.distance_km(F.lit(40.7128), F.lit(-74.0060), F.col("lat"), F.col("lon"))).alias("km"))


@query("geo_box", f"SELECT id FROM ({_GEO}) WHERE lat BETWEEN 40.2 AND 40.5 AND lon BETWEEN -73.9 AND -73.5")
def geo_box(spark, d):
    return _places(spark, d).where(geo.within_box(F.col("lat"), F.col("lon"), 40.2, -73.9, 40.5, -73.5)).select("id")


@query("membership_include", "SELECT count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def membership_include(spark, d):
    ids = t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return filters.only(t(spark, d, "lineitem"), ids, "l_orderkey").agg(F.count("*").alias("n"))


@query("membership_exclude", "SELECT count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def membership_exclude(spark, d):
    ids = t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return filters.without(t(spark, d, "lineitem"), ids, "l_orderkey").agg(F.count("*").alias("n"))


@query("tenant_isolation", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def tenant_isolation(spark, d):
    return filters.tenant_view(t(spark, d, "customer"), "BUILDING", "c_mktsegment").select("c_custkey", "c_name")


# --- ranking ------------------------------------------------------------------------------------------------------

_TERMS = """regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+')"""
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_STEM = "CASE WHEN len(t) <= 5 THEN t WHEN suffix(t,'ing') THEN t[:-4] WHEN suffix(t,'ed') OR suffix(t,'es') THEN t[:-3] WHEN suffix(t,'s') AND NOT suffix(t,'ss') THEN t[:-2] WHEN suffix(t,'ly') THEN t[:-3] WHEN suffix(t,'tion') THEN t[:-4] ELSE t END"
_BM25 = f"""WITH dt AS (SELECT doc_id, unnest({_TERMS}) AS t FROM documents), d AS (SELECT doc_id, {_STEM} AS term FROM dt WHERE len(t) > 1 AND t NOT IN ({_STOP})),
len_ AS (SELECT documents.doc_id, count(d.term) AS len FROM documents LEFT JOIN d USING (doc_id) GROUP BY 1), st AS (SELECT count(*) AS n, avg(len) AS avg_len FROM len_),
qt AS (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark), q AS (SELECT DISTINCT item_id AS query_id, {_STEM} AS term FROM qt WHERE len(t) > 1 AND t NOT IN ({_STOP})),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT query_id, tf.doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score FROM q JOIN df USING (term) JOIN tf USING (term) JOIN len_ ON tf.doc_id = len_.doc_id, st GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 5"""


@query("bm25_topk", _BM25)
def bm25_topk(spark, d):
    q = t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.bm25(t(spark, d, "documents"), q, 5).select("query_id", "doc_id", r6("score").alias("score"), "rank")


_LISTS = """WITH a AS (SELECT vec_id AS id, row_number() OVER (ORDER BY list_sum(embedding[1:8]::DOUBLE[]) DESC, vec_id) AS rank, list_sum(embedding[1:8]::DOUBLE[]) AS score FROM embeddings),
b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY list_sum(embedding[9:16]::DOUBLE[]) DESC, vec_id) AS rank, list_sum(embedding[9:16]::DOUBLE[]) AS score FROM embeddings), l AS (SELECT * FROM a WHERE rank <= 30), r AS (SELECT * FROM b WHERE rank <= 30)"""


def _lists(spark, d):
    e = t(spark, d, "embeddings")

    def one(lo):
        s = vectors.fold(F.transform(F.slice("embedding", lo, 8), lambda x: x.cast("double")))
        top = e.select(F.lit(0).alias("query_id"), F.col("vec_id").alias("id"), s.alias("score")).orderBy(F.desc("score"), "id").limit(30)
        return top.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")))

    return one(1), one(9)


@query("fusion_rrf", f"{_LISTS} SELECT coalesce(l.id, r.id) AS id, round(coalesce(0.7 / (60 + l.rank), 0) + coalesce(0.3 / (60 + r.rank), 0), 6) AS score FROM l FULL JOIN r ON l.id = r.id")
def fusion_rrf(spark, d):
    a, b = _lists(spark, d)
    return search.rrf(a, b, (0.7, 0.3)).select("id", r6("score").alias("score"))


@query("fusion_linear", f"{_LISTS} SELECT coalesce(l.id, r.id) AS id, round(coalesce(0.6 * l.score, 0) + coalesce(0.4 * r.score, 0) + CASE WHEN l.id IS NOT NULL AND r.id IS NOT NULL THEN 0.1 ELSE 0 END, 6) AS score FROM l FULL JOIN r ON l.id = r.id")
def fusion_linear(spark, d):
    a, b = _lists(spark, d)
    return search.linear_fusion(a, b, (0.6, 0.4), presence=0.1).select("id", r6("score").alias("score"))


@query("norm_minmax", f"{_LISTS} SELECT id, round((score - (SELECT min(score) FROM l)) / ((SELECT max(score) FROM l) - (SELECT min(score) FROM l)), 6) AS score FROM l")
def norm_minmax(spark, d):
    return search.normalized(_lists(spark, d)[0], "score", "minmax").select("id", r6("score").alias("score"))


@query("norm_zscore", f"{_LISTS} SELECT id, round((score - (SELECT avg(score) FROM l)) / (SELECT stddev_pop(score) FROM l), 6) AS score FROM l")
def norm_zscore(spark, d):
    return search.normalized(_lists(spark, d)[0], "score", "zscore").select("id", r6("score").alias("score"))


_ANY = lambda words: " OR ".join(f"contains(lower(text), '{w}')" for w in words)


@query("trend_buckets", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, round(avg(value), 6) AS average, round(max(value), 6) AS best FROM events GROUP BY 1")
def trend_buckets(spark, d):
    b = windows.trend_buckets(t(spark, d, "events"), "ts", "1 day", "value")
    return b.select("start", "n", r6("average").alias("average"), r6("best").alias("best"))


@query("regime_change", "WITH x AS (SELECT event_id, avg(value) OVER n AS a, avg(value) OVER p AS b, var_pop(value) OVER n / count(value) OVER n + var_pop(value) OVER p / nullif(count(value) OVER p, 0) AS e FROM events WINDOW n AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), p AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 59 PRECEDING AND 10 PRECEDING)) SELECT event_id, round(coalesce(2 / (1 + exp(-1.702 * abs(a - b) / nullif(sqrt(e), 0))) - 1, 0), 5) AS change FROM x")
def regime_change(spark, d):
    return windows.regime_change(t(spark, d, "events"), "value", ["event_id"], 10, 50, ["event_type"]).select("event_id", F.round("change", 5).alias("change"))


@query("query_route", f"SELECT conv_id, turn, CASE WHEN {_ANY(search.TEMPORAL)} THEN 'temporal' WHEN {_ANY(search.GRAPH)} THEN 'graph' WHEN starts_with(text, '\"') AND suffix(text, '\"') THEN 'keyword' WHEN len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) <= 2 THEN 'keyword' ELSE 'hybrid' END AS route FROM conversations")
def query_route(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", search.route(F.col("text")).alias("route"))


@query("hybrid_search", f"{Q0}, n AS (SELECT vec_id, text, {DIST['cosine']} AS x FROM e JOIN documents ON doc_id = vec_id, q ORDER BY x, vec_id LIMIT 30), s AS (SELECT vec_id, 0.7 * (1 - x) + 0.3 * len(list_intersect(['the', 'license', 'of', 'that'], regexp_split_to_array(lower(text), '\\s+'))) / 4 AS score FROM n) SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10")
def hybrid_search(spark, d):
    e = t(spark, d, "embeddings").join(t(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    return search.hybrid(e, "embedding", query_vector(spark, d), "the license of that", "text", 10).select("vec_id", r6("score").alias("score"))


# --- sparse, quantized, curved, distributions ---------------------------------------------------------------------


def _sparse(spark, d):
    """Sparse vectors: components above 0.1, and the query's."""
    e = t(spark, d, "embeddings")
    keep = lambda v: F.filter(F.transform(v, lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("x"))), lambda s: s["x"] > 0.1)
    make = lambda v: sparse.sparse(F.transform(keep(v), lambda s: s["i"]), F.transform(keep(v), lambda s: s["x"]), 64)
    return e.select("vec_id", make(F.col("embedding")).alias("s"), make(vectors.vec(query_vector(spark, d))).alias("q"))


_SP = f"{Q0}, z AS (SELECT vec_id, list_transform({Z}, lambda p: [CASE WHEN p[1] > 0.1 THEN p[1] ELSE 0 END, CASE WHEN p[2] > 0.1 THEN p[2] ELSE 0 END]) AS z FROM e, q), f AS (SELECT vec_id, list_sum(list_transform(z, lambda p: p[1]*p[2])) AS dot, sqrt(list_sum(list_transform(z, lambda p: p[1]*p[1]))) AS na, sqrt(list_sum(list_transform(z, lambda p: p[2]*p[2]))) AS nb, sqrt(list_sum(list_transform(z, lambda p: (p[1]-p[2])*(p[1]-p[2])))) AS l2, list_sum(list_transform(z, lambda p: abs(p[1]-p[2]))) AS l1, len(list_filter(z, lambda p: p[1] > 0)) AS nnz FROM z)"


@query("sparse_distances", f"{_SP} SELECT vec_id, round(dot, 6) AS dot, round(CASE WHEN na * nb = 0 THEN 0 ELSE dot / (na * nb) END, 6) AS cosine, round(l2, 6) AS l2, round(l1, 6) AS l1, nnz::INTEGER AS nnz FROM f")
def sparse_distances(spark, d):
    s, q = F.col("s"), F.col("q")
    return _sparse(spark, d).select("vec_id", r6(sparse.dot(s, q)).alias("dot"), r6(sparse.cosine(s, q)).alias("cosine"), r6(sparse.euclidean(s, q)).alias("l2"), r6(sparse.manhattan(s, q)).alias("l1"), sparse.nnz(s).alias("nnz"))


@query("sparse_topk", f"{_SP} SELECT vec_id, round(dot, 6) AS dot FROM f ORDER BY f.dot DESC, vec_id LIMIT 10")
def sparse_topk(spark, d):
    return _sparse(spark, d).select("vec_id", sparse.dot(F.col("s"), F.col("q")).alias("x")).orderBy(F.desc("x"), "vec_id").limit(10).select("vec_id", r6("x").alias("dot"))


@query("sparse_text_round_trip")
def sparse_text_round_trip(spark, d):
    s = _sparse(spark, d).select("vec_id", "s", sparse.parse(sparse.to_text(F.col("s"))).alias("p"))
    return s.select("vec_id", (F.col("s") == F.col("p")).alias("same"), sparse.to_text(sparse.top_k(F.col("s"), 3)).alias("top"))


_SQ = "WITH b AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_min(embedding)::DOUBLE AS low, (list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE) / 254.0 AS step FROM embeddings), c AS (SELECT vec_id, low, step, v, list_transform(v, lambda x: greatest(-127, least(127, trunc((x - low) / step - 127)))) AS codes FROM b)"


@query("sq8_codes", f"{_SQ} SELECT vec_id, list_sum(codes)::BIGINT AS total, round(low, 6) AS low, round(step, 6) AS step FROM c")
def sq8_codes(spark, d):
    q = t(spark, d, "embeddings").select("vec_id", quantize.sq8(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.aggregate(F.col("q.codes"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), r6("q.low").alias("low"), r6("q.step").alias("step"))


@query("sq8_error", f"{_SQ}, r AS (SELECT vec_id, list_max(list_transform(list_zip(v, codes), lambda p: abs(p[1] - ((p[2] + 127) * step + low)))) / step AS worst FROM c) SELECT count(*) AS n, max(worst) < 1.0001 AS within_step FROM r")
def sq8_error(spark, d):
    q = t(spark, d, "embeddings").select("embedding", quantize.sq8(F.col("embedding")).alias("q"))
    return q.select((vectors.chebyshev(F.col("embedding"), quantize.sq8_decode(F.col("q"))) / F.col("q.step")).alias("worst")).agg(F.count("*").alias("n"), (F.max("worst") < 1.0001).alias("within_step"))


@query("binary_hamming", f"{Q0} SELECT vec_id, list_sum(list_transform({Z}, lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1 ELSE 0 END))::INTEGER AS differing FROM e, q")
def binary_hamming(spark, d):
    return t(spark, d, "embeddings").select("vec_id", quantize.binary_hamming(quantize.binary(F.col("embedding")), quantize.binary(query_vector(spark, d))).cast("int").alias("differing"))


@query("pq_search")
def pq_search(spark, d):
    e = t(spark, d, "embeddings")
    books = quantize.pq_train(e, "embedding", 8, 16)
    table = quantize.pq_table(query_vector(spark, d), books)
    return e.select("vec_id", quantize.pq_distance(quantize.pq_encode(F.col("embedding"), books), table).alias("x")).orderBy("x", "vec_id").limit(10).select("vec_id", r6("x").alias("distance"))


_HALF = f"{Q0}, h AS (SELECT vec_id, list_transform(e.v, lambda x: x * 0.5) AS a, list_transform(q.v, lambda x: x * 0.5) AS b FROM e, q), n AS (SELECT *, list_inner_product(a, a) AS aa, list_inner_product(b, b) AS bb, list_inner_product(a, b) AS ab, list_sum(list_transform(list_zip(a, b), lambda p: (p[1]-p[2])*(p[1]-p[2]))) AS dd FROM h)"


def _half(spark, d):
    return t(spark, d, "embeddings").select("vec_id", vectors.scale(F.col("embedding"), 0.5).alias("a"), vectors.scale(query_vector(spark, d), 0.5).alias("b"))


@query("poincare_distance", f"{_HALF} SELECT vec_id, round(acosh(greatest(1.0, 1 + 2 * dd / ((1 - aa) * (1 - bb)))), 6) AS distance FROM n")
def poincare_distance(spark, d):
    return _half(spark, d).select("vec_id", r6(curved.poincare_distance("a", "b")).alias("distance"))


@query("mobius_add", f"{_HALF} SELECT vec_id, round(list_sum(list_transform(list_zip(a, b), lambda p: ((1 + 2*ab + bb) * p[1] + (1 - aa) * p[2]) / (1 + 2*ab + aa*bb))), 6) AS total FROM n")
def mobius_add(spark, d):
    return _half(spark, d).select("vec_id", r6(vectors.fold(curved.mobius_add("a", "b"))).alias("total"))


# The tangent at a towards b, of unit length, moved along by half the distance: its distance from a is known.
@query("exp_log_round_trip", f"{_HALF} SELECT vec_id, true AS same, round(acosh(greatest(1.0, 1 + 2 * dd / ((1 - aa) * (1 - bb)))) / 2, 5) AS half FROM n WHERE vec_id > 0")
def exp_log_round_trip(spark, d):
    h = _half(spark, d).where("vec_id > 0").withColumn("t", curved.log_map("a", "b"))
    h = h.withColumn("back", curved.exp_map("a", "t")).withColumn("mid", curved.exp_map("a", F.transform("t", lambda x: x / 2)))
    return h.select("vec_id", (vectors.chebyshev(F.col("back"), F.col("b")) < 1e-6).alias("same"), F.round(curved.poincare_distance("a", "mid"), 5).alias("half"))


@query("lorentz_distance", f"{_HALF} SELECT vec_id, round(acosh(greatest(1.0, ((1+aa)/(1-aa)) * ((1+bb)/(1-bb)) - 4 * ab / ((1-aa)*(1-bb)))), 5) AS distance FROM n")
def lorentz_distance(spark, d):
    x = curved.lorentz_distance(curved.poincare_to_lorentz("a"), curved.poincare_to_lorentz("b"))
    return _half(spark, d).select("vec_id", F.round(x, 5).alias("distance"))


@query("spherical_distance", f"{Q0} SELECT vec_id, round(acos(greatest(-1.0, least(1.0, list_inner_product(e.v, q.v) / (sqrt(list_inner_product(e.v, e.v)) * sqrt(list_inner_product(q.v, q.v)))))), 5) AS distance FROM e, q WHERE vec_id > 0")
def spherical_distance(spark, d):
    return t(spark, d, "embeddings").where("vec_id > 0").select("vec_id", F.round(curved.spherical_distance(F.col("embedding"), query_vector(spark, d)), 5).alias("distance"))


_SM = f"{Q0}, m AS (SELECT vec_id, list_transform(e.v, lambda x: exp(x)) AS a, list_transform(q.v, lambda x: exp(x)) AS b FROM e, q), p AS (SELECT vec_id, list_transform(a, lambda x: x / list_sum(a)) AS a, list_transform(b, lambda x: x / list_sum(b)) AS b FROM m)"


def _probs(spark, d):
    return t(spark, d, "embeddings").select("vec_id", vectors.softmax(F.col("embedding")).alias("a"), vectors.softmax(query_vector(spark, d)).alias("b"))


@query("divergences", f"{_SM}, k AS (SELECT vec_id, list_sum(list_transform(list_zip(a, b), lambda p: p[1] * ln(p[1] / p[2]))) AS kl, list_sum(list_transform(list_zip(a, b), lambda p: (p[1] * ln(2 * p[1] / (p[1] + p[2])) + p[2] * ln(2 * p[2] / (p[1] + p[2]))) / 2)) AS js, list_sum(list_transform(list_zip(a, b), lambda p: p[2] * p[2] / p[1])) AS fisher FROM p) SELECT vec_id, round(kl, 6) + 0.0 AS kl, round(js, 6) + 0.0 AS js, round(fisher, 6) AS fisher FROM k")
def divergences(spark, d):
    return _probs(spark, d).select("vec_id", (r6(distributions.kl("a", "b")) + 0.0).alias("kl"), (r6(distributions.jensen_shannon("a", "b")) + 0.0).alias("js"), r6(distributions.fisher("a", "b")).alias("fisher"))


@query("wasserstein_1d", f"{Q0} SELECT vec_id, round(list_sum(list_transform(list_zip(list_sort(e.v), list_sort(q.v)), lambda p: abs(p[1]-p[2]))) / 64, 6) AS distance FROM e, q")
def wasserstein_1d(spark, d):
    return t(spark, d, "embeddings").select("vec_id", r6(distributions.wasserstein(F.transform("embedding", lambda x: x.cast("double")), query_vector(spark, d))).alias("distance"))


_HASHED = "SELECT doc_id, list_transform(range(64), lambda i: ('0x' || md5(i || ':' || md5(coalesce(text, '')))[1:8])::BIGINT::DOUBLE / 4294967295.0 * 2 - 1) AS v FROM documents"


@query("hash_embeddings", f"WITH h AS ({_HASHED}) SELECT doc_id, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first, round(list_sum(v) / sqrt(list_inner_product(v, v)), 6) AS total FROM h")
def hash_embeddings(spark, d):
    h = t(spark, d, "documents").select("doc_id", text.hash_embedding(F.col("text")).alias("v"))
    return h.select("doc_id", r6(F.col("v")[0]).alias("first"), r6(vectors.fold(F.col("v"))).alias("total"))


@query("attention_rerank", f"{Q0}, c AS (SELECT e.vec_id AS id, e.v AS v, q.v AS q, list_inner_product(e.v, q.v) / (sqrt(list_inner_product(e.v, e.v)) * sqrt(list_inner_product(q.v, q.v))) AS sim FROM e, q WHERE e.vec_id > 0 ORDER BY sim DESC, id LIMIT 50), x AS (SELECT *, exp(list_inner_product(v, q) / 8.0) AS a FROM c), s AS (SELECT id, 0.6 * a / sum(a) OVER () + 0.4 * sim AS score FROM x) SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM s QUALIFY rank <= 10")
def attention_rerank(spark, d):
    q = query_vector(spark, d)
    near = search.top_k(t(spark, d, "embeddings").where("vec_id > 0"), "embedding", q, 50, "cosine").select(F.col("vec_id").alias("id"), (1 - F.col("distance")).alias("similarity"), "embedding")
    return search.attention_rerank(near, q, 10).select("id", r6("score").alias("score"), "rank")


@query("model_rerank", f"{Q0}, c AS (SELECT e.vec_id AS id, e.v AS v, {DIST['l2']} AS x FROM e, q WHERE e.vec_id > 0 ORDER BY x, id LIMIT 50) SELECT id, round(v[1], 6) AS score, row_number() OVER (ORDER BY v[1] DESC, id)::INTEGER AS rank FROM c QUALIFY rank <= 10")
def model_rerank(spark, d):
    near = search.top_k(t(spark, d, "embeddings").where("vec_id > 0"), "embedding", query_vector(spark, d), 50).select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("first"))
    return search.model_rerank(near, lambda x: x, ["first"], 10).select("id", r6("score").alias("score"), "rank")


@query("bitmap_combine", "SELECT 'and' AS how, user_id AS position FROM (SELECT user_id FROM events WHERE value > 50 INTERSECT SELECT user_id FROM events WHERE event_type = (SELECT min(event_type) FROM events)) UNION ALL SELECT 'xor', user_id FROM ((SELECT user_id FROM events WHERE value > 90 EXCEPT SELECT user_id FROM events WHERE value < 5) UNION (SELECT user_id FROM events WHERE value < 5 EXCEPT SELECT user_id FROM events WHERE value > 90))")
def bitmap_combine(spark, d):
    e = t(spark, d, "events")
    kind = e.agg(F.min("event_type")).first()[0]
    bits = lambda cond: aggregates.bitmap(e.where(cond), "user_id")
    both = aggregates.bitmap_combine(bits("value > 50"), bits(F.col("event_type") == kind), "and").select(F.lit("and").alias("how"), "position")
    return both.unionByName(aggregates.bitmap_combine(bits("value > 90"), bits("value < 5"), "xor").select(F.lit("xor").alias("how"), "position"))


@query("weighted_cdf", "WITH s AS (SELECT event_type, round(value) AS value, sum(event_id % 7 + 1) AS w FROM events GROUP BY 1, 2) SELECT event_type, value, round(sum(w) OVER (PARTITION BY event_type ORDER BY value) / sum(w) OVER (PARTITION BY event_type), 6) AS cdf FROM s")
def weighted_cdf(spark, d):
    e = t(spark, d, "events").select("event_type", F.round("value").alias("value"), F.expr("event_id % 7 + 1").alias("w"))
    return aggregates.weighted_cdf(e, "value", "w", ["event_type"]).select("event_type", "value", r6("cdf").alias("cdf"))


@query("argsort_by_type", "SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS position, event_id FROM events")
def argsort_by_type(spark, d):
    return aggregates.argsort(t(spark, d, "events"), "value", "event_id", ["event_type"]).withColumn("position", F.col("position").cast("bigint"))


@query("tier_bits", "SELECT user_id, CASE WHEN s >= 512 THEN 8 WHEN s >= 64 THEN 7 ELSE 3 END AS bits FROM (SELECT user_id, count(*) * 1024 // (max(max(event_id)) OVER () - max(event_id) + 1) AS s FROM events GROUP BY 1)")
def tier_bits(spark, d):
    e = t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    now = e.agg(F.max("last")).first()[0]
    return e.select("user_id", aggregates.tier_bits(F.col("n"), F.col("last"), F.lit(now)).alias("bits"))


@query("sql_functions", f"{Q0} SELECT e.vec_id, round(list_inner_product(e.v, q.v), 6) AS dot, round(sqrt(list_inner_product(e.v, e.v)), 6) AS norm, len(e.v)::INTEGER AS dims, round(list_sum(e.v) / len(e.v), 6) AS mean, round(list_max(list_transform(list_zip(e.v, q.v), lambda p: abs(p[1] - p[2]))), 6) AS chebyshev, round(e.v[1] / sqrt(list_inner_product(e.v, e.v)), 6) AS first, round(exp(e.v[1]) / list_sum(list_transform(e.v, lambda x: exp(x))), 6) AS soft FROM e, q")
def sql_functions(spark, d):
    vector_sql.register(spark)
    e = t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).withColumn("q", vectors.vec(query_vector(spark, d)))
    two = {"dot": "vector_dot(v, q)", "norm": "vector_norm(v)", "mean": "vector_avg(v)", "chebyshev": "vector_chebyshev(v, q)", "first": "vector_normalize(v)[0]", "soft": "vector_softmax(v)[0]"}
    return e.selectExpr("vec_id", "vector_dims(v) AS dims", *[f"round({x}, 6) AS {n}" for n, x in two.items()])


@query("sql_table_function", "SELECT vec_id, (pos - 1)::INTEGER AS pos, round(x, 6) AS x FROM (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, 65)) AS pos FROM embeddings)")
def sql_table_function(spark, d):
    vector_sql.register(spark)
    t(spark, d, "embeddings").createOrReplaceTempView("_vectors")
    return spark.sql("SELECT vec_id, r.pos, round(r.x, 6) AS x FROM _vectors, LATERAL vector_rows(CAST(embedding AS ARRAY<DOUBLE>)) AS r")


@query("similar_nodes", f"{Q0}, s AS (SELECT e.vec_id AS id, list_inner_product(e.v, q.v) / (sqrt(list_inner_product(e.v, e.v)) * sqrt(list_inner_product(q.v, q.v))) AS score FROM e, q ORDER BY score DESC, id LIMIT 20) SELECT id, round(score, 6) AS score FROM s WHERE score >= 0.2")
def similar_nodes(spark, d):
    e = t(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    return retrieval.similar(e, query_vector(spark, d), 20, 0.2).select("id", r6("score").alias("score"))


@query("rag_context", f"{Q0}, s AS (SELECT e.vec_id AS id, list_inner_product(e.v, q.v) / (sqrt(list_inner_product(e.v, e.v)) * sqrt(list_inner_product(q.v, q.v))) AS score FROM e, q ORDER BY score DESC, id LIMIT 20) SELECT id, text AS content, round(score, 6) AS score, ceil(length(text) / 4)::BIGINT AS tokens FROM s JOIN documents ON doc_id = id WHERE score >= 0.1")
def rag_context(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    e = t(spark, d, "embeddings").withColumnRenamed("vec_id", "id").join(docs, "id", "left")
    found = retrieval.context(e, query_vector(spark, d), 20, 0.1)
    return found.where("content IS NOT NULL").select("id", "content", r6("score").alias("score"), "tokens")


@query("bloom_members", "SELECT DISTINCT user_id FROM events WHERE value > 50")
def bloom_members(spark, d):
    e = t(spark, d, "events")
    held = e.where("value > 50").select("user_id")
    bits, hashes = retrieval.filter_size(e.count(), 1e-6)
    maybe = retrieval.maybe_in(e.select("user_id").distinct(), "user_id", retrieval.bloom(held, "user_id", bits, hashes), bits, hashes)
    # A filter lets a few others through; an exact look-up of what is left makes the result whole.
    return maybe.join(held.distinct(), "user_id", "left_semi")


@query("entities_found")
def entities_found(spark, d):
    e = t(spark, d, "documents").select("doc_id", text.entities(F.col("text")).alias("e"))
    return e.select("doc_id", "e.*")


@query("k_winners", "WITH x AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS pos FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, pos) AS rn FROM x) SELECT vec_id, sum(pos)::BIGINT AS places FROM r WHERE rn <= 5 GROUP BY vec_id")
def k_winners(spark, d):
    w = F.transform(vectors.k_winners(F.col("embedding"), 5), lambda x, i: F.when(x > 0, i).otherwise(0).cast("bigint"))
    return t(spark, d, "embeddings").select("vec_id", F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("places"))
