"""Best-fit packing planned over a histogram of lengths.

Documents are encoded once and cut into pieces of at most ``capacity`` tokens. The plan sees only how many pieces
have each length: best-fit decreasing over counts, on at most ``capacity`` numbers, however many documents there are.
It hands out runs of slots ("pieces of this length, from this rank to that one, go to these sequences at this offset");
pieces take their slots by their rank within their length.

Ranks come without gathering a length in one task: pieces of a length are dealt to buckets by a hash, each bucket
is ranked alone, and ranks of earlier buckets are added.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import docs_of, gathered, lean, materialize, tune, words_of
from .tokens import REMEMBER, _encode, load_tokenizer, worker_cache

#: Text that is encoded at a time.
GATHER_BYTES = 8 << 20
#: Buckets a length is dealt to.
BUCKETS = 1024
#: A plan of more runs than this is joined without a broadcast.
BROADCAST_RUNS = 200_000


@dataclass(frozen=True)
class Run:
    """Pieces of ``length`` with ranks from ``rank`` up to ``rank + count``: ``each`` of them on end in one sequence,
    from ``offset``, the first in sequence ``seq``."""

    length: int
    rank: int
    count: int
    each: int
    seq: int
    offset: int


def plan(histogram: dict[int, int], capacity: int) -> list[Run]:
    """Best-fit decreasing over counts. Sequences with equal space left and equal history form a group."""
    runs: list[Run] = []
    #: Space left, first sequence, number of sequences; ordered by space left.
    groups: list[tuple[int, int, int]] = []
    next_seq = 0
    for length in sorted((x for x, n in histogram.items() if n and x > 0), reverse=True):
        todo, rank = histogram[length], 0
        while todo:
            i = bisect.bisect_left(groups, (length, -1, -1))
            if i < len(groups):
                space, seq, n = groups.pop(i)
            else:
                space, seq, n = capacity, next_seq, -(-todo // (capacity // length))
                next_seq += n
            each = space // length
            full = min(n, todo // each)
            if full:
                runs.append(Run(length, rank, full * each, each, seq, capacity - space))
                bisect.insort(groups, (space - each * length, seq, full))
                rank, todo = rank + full * each, todo - full * each
            if full < n and todo:
                runs.append(Run(length, rank, todo, todo, seq + full, capacity - space))
                bisect.insort(groups, (space - todo * length, seq + full, 1))
                full, rank, todo = full + 1, rank + todo, 0
            if full < n:
                bisect.insort(groups, (space, seq + full, n - full))
    return runs


def _ids(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Ids between ends as bytes."""
    data, cuts = ids.astype("<u4").tobytes(), (4 * ends).tolist()
    return [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


def _encoded(cache, texts: pa.Array, lower: bool) -> list[np.ndarray]:
    """Ids of each text: those of its words, which are encoded once."""
    words, codes, lens = words_of(texts, lower)
    cache.learn(words)
    values = [cache[w] for w in words]
    size = np.fromiter(map(len, values), np.int64, len(values)) // 4
    known = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(np.frombuffer(b"".join(values), "<u4")))
    ids = known.take(pa.array(codes)).flatten().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(size[codes])])[np.cumsum(lens)]
    return np.split(ids, ends[:-1]) if len(ends) else []


def _pieces(path: str, end_id: int, capacity: int, fold: bool, remember: int, gather: int):
    end = np.array([end_id], "<u4")

    def run(batches):
        cache = worker_cache(path, "ids", _ids, remember)
        for b in gathered(batches, gather):
            texts = pc.fill_null(b.column("text"), "")
            # Where the tokenizer folds case itself; special tokens are told apart by it.
            marked = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False) | (not fold)
            ids: list = [None] * b.num_rows
            for some, lower in ((np.flatnonzero(~marked), True), (np.flatnonzero(marked), False)):
                for i, x in zip(some.tolist(), _encoded(cache, texts.take(pa.array(some)), lower), strict=True):
                    ids[i] = x
            out: list[tuple] = []
            for doc, x in zip(b.column("doc_id").to_pylist(), ids, strict=True):
                x = np.concatenate([x, end])
                for k, at in enumerate(range(0, len(x), capacity)):
                    part = x[at : at + capacity]
                    out.append((doc, k, at, len(part), zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, remember: int = REMEMBER, gather: int = GATHER_BYTES) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece. A tokenizer that drops white space and never joins
    across it may encode word by word; ``tests/llm`` holds this against whole texts."""
    tune(docs.sparkSession)
    d = docs_of(docs, "doc_id", "text")
    fold = _encode(load_tokenizer(tokenizer_path), ["AbC DeF"]) == _encode(load_tokenizer(tokenizer_path), ["abc def"])
    return d.mapInArrow(lean("tokens-ids", _pieces(tokenizer_path, end_id, capacity, fold, remember, gather)), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def assign(cut: DataFrame, capacity: int = 4096) -> DataFrame:
    """Append sequence_id and offset to pieces, which must be a stored table: it is read twice."""
    spark = cut.sparkSession
    salted = cut.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS)))
    sums = salted.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    histogram = {r.length: r.n for r in sums.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs = plan(histogram, capacity)
    before = sums.withColumn("_before", F.sum("_n").over(W.partitionBy("length").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)))
    first = before.select("length", "_b", F.coalesce("_before", F.lit(0)).alias("_before"), F.lit(0).alias("_kind"))
    rows = salted.withColumn("_kind", F.lit(1)).unionByName(first, allowMissingColumns=True)
    w = W.partitionBy("length", "_b").orderBy("_kind", "doc_id", "piece", "ids_crc32", "start")
    ranked = rows.withColumn("_rank", F.row_number().over(w) - 2 + F.first("_before").over(w)).where("_kind = 1")
    table = spark.createDataFrame(
        [(r.length, r.rank, r.rank + r.count, r.each, r.seq, r.offset) for r in runs] or [(0, 0, 0, 1, 0, 0)],
        "_len bigint, _lo bigint, _hi bigint, _each bigint, _seq bigint, _off bigint",
    )
    table = F.broadcast(table) if len(runs) <= BROADCAST_RUNS else table
    within = F.col("_rank") - F.col("_lo")
    return ranked.join(table, (F.col("length") == F.col("_len")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_seq") + F.expr("(_rank - _lo) div _each")).alias("sequence_id"),
        (F.col("_off") + (within % F.col("_each")) * F.col("length")).alias("offset"),
    )


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, remember: int = REMEMBER, gather: int = GATHER_BYTES) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens: a row per piece, with its place.

    Null or empty text is the end token alone. Longer documents are cut into full pieces and a rest. Repeated rows
    are packed each. Only doc_id and text are read; an empty table gives no rows. ``remember`` (pieces a worker keeps in a
    generation) and ``gather`` (bytes of text encoded at a time) trade memory for time; results don't depend on them.
    """
    cut, _ = materialize(pieces(docs, tokenizer_path, capacity, end_id, remember, gather), "pieces")
    return assign(cut, capacity)
