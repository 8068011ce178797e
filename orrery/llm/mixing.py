"""Mixing sources to target weights along a curriculum that changes with time.

Each source has a weight schedule over training time 0 to 1. Its integral is the source's cumulative demand for words;
a document's copies supply words one after the other, and the inverse of the demand turns the number of words
supplied before a copy into the time at which it is due. Documents are then sorted by that time over ranges.

A source's words are summed without gathering it in one task: documents are ordered by a hash whose leading bits
form buckets; sums of earlier buckets start each bucket's own running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, docs_of, masked, materialize

#: Leading bits of the order hash that make a bucket.
BUCKET_BITS = 12
#: A catalogue of more sources than this is joined without a broadcast.
BROADCAST_SOURCES = 10_000


def n_words(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> dict[str | None, float]:
    """Words to take from each source. Sources by code point, null last, weigh ``weights``, repeating, and share the
    sum of all sizes; a target stops at ``most`` times its source's size, and what is above is shared by weight again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    left, free = float(sum(sizes.values())), sum(weigh.values())
    # In the order in which sources reach their limit, as the share of a unit of weight grows.
    for s in sorted(names, key=lambda s: most * sizes[s] / weigh[s]):
        if most * sizes[s] * free <= left * weigh[s]:
            out[s] = float(most * sizes[s])
            left, free = left - out[s], free - weigh[s]
        else:
            break
    return {s: out.get(s, left * weigh[s] / free if free else 0.0) for s in names}


def schedule(source_rank: int) -> tuple[float, float]:
    """Weight at the start and at the end of training, linear between. Every second source fades in, others fade out."""
    return (1.0, 0.5) if source_rank % 2 else (0.5, 1.0)


def due(share: Column, start: Column, end: Column) -> Column:
    """Time at which a source has supplied ``share`` (0 to 1) of its demand: the inverse of the integral of its weight."""
    area = (start + end) / 2
    slope = end - start
    return F.when(F.abs(slope) < 1e-12, share).otherwise((F.sqrt(start * start + 2 * slope * area * share) - start) / slope)


def _order_hash(doc_id: Column) -> Column:
    """32 bits of the MD5 of the id in decimal: an order that SQL engines share. A null id counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("bigint")


def demand(sized: DataFrame, carry: list[str], weights=(5, 2, 1), most: int = 3) -> DataFrame:
    """Append to (doc_id, source, size, *carry): source_size, target, full_copies, taken, the words its source supplies
    before it, and the positions of its copies.

    ``sized`` must be cheap to read: it is read twice. The per-source sums, one row a source, come to the driver.
    """
    spark = sized.sparkSession
    keyed = sized.withColumn("_h", _order_hash(F.col("doc_id"))).withColumn("_b", F.shiftright("_h", 32 - BUCKET_BITS))
    sums = keyed.groupBy("source", "_b").agg(F.sum("size").alias("_n"))
    sizes = {r.source: int(r.n) for r in sums.groupBy("source").agg(F.sum("_n").alias("n")).collect()}
    goal = targets(sizes, weights, most)
    rows = [(s, sizes[s], goal[s], *schedule(i)) for i, s in enumerate(goal)]
    plan = spark.createDataFrame(rows, "_source string, source_size bigint, target double, _start double, _end double")
    plan = F.broadcast(plan) if len(rows) <= BROADCAST_SOURCES else plan
    before = F.sum("_n").over(W.partitionBy("source").orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    first = sums.select("source", "_b", F.coalesce(before, F.lit(0)).alias("_before"), F.lit(0).alias("_kind"))
    first = first.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    all_ = keyed.withColumn("_kind", F.lit(1)).unionByName(first, allowMissingColumns=True)
    part = W.partitionBy("source", "_b").orderBy("_kind", "_h", "doc_id", "size")
    back = part.rowsBetween(W.unboundedPreceding, -1)
    head = lambda c: F.first(c).over(part).alias(c)
    run = all_.select(
        "doc_id", "source", "size", *carry, "_kind", head("source_size"), head("target"), head("_start"), head("_end"),
        (F.first("_before").over(part) + F.coalesce(F.sum("size").over(back), F.lit(0))).alias("words_before"),
    ).where("_kind = 1").drop("_kind")
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.expr("cast(round(target) as bigint) div nullif(source_size, 0)"))).otherwise(F.lit(0)).cast("bigint")
    rest = F.round("target").cast("bigint") - whole * F.col("source_size")
    part_taken = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("words_before")))
    copies = F.col("full_copies") + (F.col("taken") > F.col("full_copies") * F.col("size")).cast("bigint")
    supplied = lambda c: (F.col("words_before") + (c - 1) * F.col("source_size")) / F.greatest(F.col("target"), F.lit(1.0))
    at = lambda c: due(F.least(F.lit(1.0), supplied(c)), F.col("_start"), F.col("_end"))
    return (
        run.withColumn("full_copies", whole)
        .withColumn("taken", F.when(whole >= most, whole * F.col("size")).otherwise(whole * F.col("size") + part_taken).cast("bigint"))
        .withColumn("positions", F.when(F.col("taken") > 0, F.transform(F.sequence(F.lit(1).cast("bigint"), F.greatest(F.lit(1), copies)), at)))
        .drop("_start", "_end")
    )


def mix(docs: DataFrame, weights=(5, 2, 1), most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken, position and positions of every document, sorted by position over ranges.

    ``positions`` are those of its copies, a last one in part included; ``position`` is the first; null where nothing is
    taken. Null text: size 0, nothing taken. Null source: a source of its own, last. Repeated rows count each. The order
    within a source is a hash of doc_id, then doc_id and size, so reruns agree; null ids come first of equal hashes. Only
    doc_id, text and source are read. An empty table gives no rows.
    """
    d = docs_of(docs, "doc_id", "source", "text")
    sized, _ = materialize(d.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    out = demand(sized, [], weights, most).withColumn("position", F.col("positions")[0])
    out = out.select("doc_id", "size", "source_size", "target", "taken", "position", "positions")
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id", "size")


def mixed_documents(docs: DataFrame, weights=(5, 2, 1), most: int = 3) -> DataFrame:
    """The documents themselves in training order, a row for each copy, all their columns as they came.

    A last copy of which less than half would be taken is left out. Nulls and repeated rows count as in :func:`mix`, so
    documents without words have no copy. Columns of any names pass through; a missing doc_id, text or source counts as
    null. Of copies due at once, smaller ids come first. An empty table gives no rows.
    """
    d, at = masked(docs, "doc_id", "text", "source")
    cols = [f"_c{i}" for i in range(len(docs.columns))]
    sized = d.select(F.col(at["doc_id"]).cast("bigint").alias("doc_id"), F.col(at["source"]).cast("string").alias("source"), n_words(F.col(at["text"])).alias("size"), *cols)
    got = demand(sized, cols, weights, most)
    part = F.col("taken") - F.col("full_copies") * F.col("size")
    copies = (F.col("full_copies") + F.when((part > 0) & (2 * part >= F.col("size")), 1).otherwise(0)).cast("int")
    each = got.where(copies > 0).select(*cols, "doc_id", F.posexplode(F.slice("positions", F.lit(1), copies)).alias("_copy", "_due"))
    return each.orderBy("_due", "doc_id", "_copy").select(*cols).toDF(*docs.columns)
