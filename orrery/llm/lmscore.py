"""Cross-entropy difference: documents scored by two matched n-gram models.

The target model is counted over documents of a target set, the background model over all documents. Both share one
vocabulary (every distinct word of the corpus, A-Z folded) and one form: bigrams backed by unigrams, interpolated by
the count of the context. A document's score is the mean over its tokens of the background loss minus the target loss: above zero, it is
more like the target.

Counts cover every token of every document and are kept by key, so the model grows with the corpus. Documents are dealt
out over blocks of about ``BLOCK_BYTES`` by their ids; a block counts its distinct n-grams, these are dealt out over
buckets by ranges of keys and summed there, and each block gets the sums of its own n-grams back, in its own order, and
scores its documents whole. However common an n-gram is, a block hands it out once, so no bucket is hot. A key is a
fingerprint of 48 bits: of 10^9 n-grams, each shares one with a chance of 4 in a million.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_of, lean, materialize, pick, raw, settle, tune, words_of

#: Text of a block, how much of it a task gathers before it hands it out, and n-grams of a bucket.
BLOCK_BYTES, GATHER_BYTES, BUCKET_GRAMS = 4 << 20, 32 << 20, 2 << 20
#: How hard texts are compressed: they travel three times.
TEXT_LEVEL = 9
START = np.uint64(0)
_MULT = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)))
_ONE = np.uint64(1)
#: Bits of a key: the upper 48. What is left out needn't travel.
_KEPT = np.uint64(0xFFFFFFFFFFFF0000)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MULT[2]
    x = (x ^ (x >> np.uint64(27))) * _MULT[3]
    return x ^ (x >> np.uint64(31))


def word_keys(words: np.ndarray) -> np.ndarray:
    """Keys of words by their fingerprints. Only a word's key is odd."""
    return words & _KEPT | _ONE


def context_keys(words: np.ndarray) -> np.ndarray:
    return _mix(words ^ _MULT[1]) & _KEPT


def bigram_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return _mix(_mix(before + _MULT[0]) * _MULT[1] + words) & _KEPT


# --- blocks -----------------------------------------------------------------------------------------------------


_PACKED = "block int, ids array<bigint>, lens binary, texts binary"
_BLOCKS = "block bigint, ids array<bigint>, target binary, lens binary, texts binary, n bigint, n_target bigint"


def _pack(batches):
    """Rows (block, ids, lengths, texts) of a task: texts on end, compressed."""
    held: dict[int, list] = {}
    size = 0

    def rows():
        for block, docs in held.items():
            texts = [t for _, t in docs]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([[i for i, _ in docs]], pa.list_(pa.int64())), pa.array([np.fromiter(map(len, texts), np.int64, len(texts)).tobytes()], pa.binary()), pa.array([_squeeze(b"".join(texts), TEXT_LEVEL)], pa.binary())],
                names=["block", "ids", "lens", "texts"],
            )
        held.clear()

    for b in batches:
        for block, i, t in zip(b.column("block").to_pylist(), b.column("doc_id").to_pylist(), raw(b.column("text")), strict=True):
            held.setdefault(block, []).append((i, t))
            size += len(t)
        if size > GATHER_BYTES:
            yield from rows()
            size = 0
    yield from rows()


def _squeeze(data: bytes, level: int = 1) -> bytes:
    return pa.Codec("zstd", compression_level=level).compress(data, asbytes=True)


def _texts(lens: bytes, data: bytes) -> list[bytes]:
    sizes = np.frombuffer(lens, np.int64)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    whole = pa.decompress(data, decompressed_size=total, codec="zstd", asbytes=True) if total else b""
    return [whole[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def _gather(n_blocks: int):
    """A block's documents with their marks and its numbers of tokens. One of much more than BLOCK_BYTES is cut."""

    def run(packed: pa.Table, target: pa.Table) -> pa.Table:
        wanted = set(target.column("_t").to_pylist())
        out, ids, texts, size = [], [], [], 0

        def row():
            lens = np.fromiter((len(t.split()) for t in texts), np.int64, len(texts))
            mine = np.fromiter((i in wanted for i in ids), bool, len(ids))
            n = np.fromiter(map(len, texts), np.int64, len(texts))
            out.append((block + n_blocks * len(out), list(ids), mine.tobytes(), n.tobytes(), _squeeze(b"".join(texts), TEXT_LEVEL), int(lens.sum()), int(lens[mine].sum())))
            ids.clear()
            texts.clear()

        for block, some, lens, data in zip(*(packed.column(c).to_pylist() for c in ("block", "ids", "lens", "texts")), strict=True):
            for i, t in zip(some, _texts(lens, data), strict=True):
                if ids and size + len(t) > 1.5 * BLOCK_BYTES:
                    row()
                    size = 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if ids:
            row()
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        cols = list(zip(*out, strict=True)) or [()] * len(kinds)
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["block", "ids", "target", "lens", "texts", "n", "n_target"])

    return run


def blocks(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """The documents in blocks, with marks: whether a document is of the target set, ``target_ids`` (doc_id)."""
    d = docs_of(docs, "doc_id", "text")
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = 1 + size // BLOCK_BYTES
    block = lambda *c: F.pmod(F.xxhash64(*c), F.lit(n_blocks)).cast("int").alias("block")
    ids = target_ids.select(F.col("doc_id").alias("_t")).where("_t is not null").distinct().select(block("_t"), "_t")
    # Documents without an id are in no target set, so any block will do.
    d = d.select(F.when(F.col("doc_id").isNull(), block("text")).otherwise(block("doc_id")).alias("block"), "doc_id", "text")
    return d.mapInArrow(lean("lmscore", _pack), _PACKED).groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_gather(n_blocks), _BLOCKS)


# --- counts and scores ------------------------------------------------------------------------------------------


def _planes(x: np.ndarray) -> bytes:
    """Unsigned numbers, small ones in few bytes: first bytes of all, second bytes and so on, compressed."""
    return _squeeze(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()) if len(x) else b""


def _unplanes(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<i8").ravel()


def _distinct(texts: list[bytes]):
    """All distinct keys of texts, sorted; the texts' lengths; and where each token's word, context and bigram are.

    Fingerprints are made of distinct words, and keys of distinct words and pairs of words.
    """
    words, codes, lens = words_of(pa.array(texts, pa.binary()).cast(pa.string(), safe=False), lower=True)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    ids = np.append(ids, START)  # what comes before a text's first word
    codes = codes.astype(np.int64)
    before = np.empty_like(codes)
    before[1:] = codes[:-1]
    before[(np.cumsum(lens) - lens)[lens > 0]] = len(words)
    pairs = before * len(ids) + codes
    some, pair = np.unique(pairs, return_inverse=True)
    found = [(word_keys(ids[:-1]), codes), (context_keys(ids), before), (bigram_keys(ids[some // len(ids)], ids[some % len(ids)]), pair)]
    # START is no context of texts without words.
    used = [k if len(codes) else k[:0] for k, _ in found]
    every, at = np.unique(np.concatenate(used), return_inverse=True)
    parts = np.split(at, np.cumsum(list(map(len, used)))[:-1])
    return every, lens, [x[where] for x, (_, where) in zip(parts, found, strict=True)]


def _cuts(every: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket's keys begin, and the end."""
    first = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(every, first), len(every))


def _count(bits: int):
    """Rows (bucket, block, size, keys, counts in all documents, counts in the target set) of each block."""

    def run(batches):
        for b in batches:
            for block, mine, lens, data in zip(*(b.column(c).to_pylist() for c in ("block", "target", "lens", "texts")), strict=True):
                every, sizes, at = _distinct(_texts(lens, data))
                mine = np.repeat(np.frombuffer(mine, bool), sizes)
                n, n_target = (sum(np.bincount(x, minlength=len(every)) for x in some) for some in (at, [x[mine] for x in at]))
                cuts = _cuts(every, bits).tolist()
                rows = [(k, lo, hi) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if lo < hi]
                for i in range(0, len(rows), 64):
                    part = rows[i : i + 64]
                    packed = lambda x: pa.array([_planes(x[lo:hi]) for _, lo, hi in part], pa.binary())  # noqa: E731, B023
                    steps = pa.array([_planes(np.diff(every[lo:hi], prepend=np.uint64(k << (64 - bits)))) for k, lo, hi in part], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k for k, _, _ in part], pa.int32()), pa.array([block] * len(part), pa.int64()), pa.array([hi - lo for _, lo, hi in part], pa.int64()), steps, packed(n), packed(n_target)],
                        names=["bucket", "block", "size", "keys", "n", "n_target"],
                    )

    return run


def _sum(bits: int):
    """A bucket's sums, handed back to each block in the order of its keys; with the first, how many words it has."""

    def run(t: pa.Table) -> pa.Table:
        bucket, block, sizes = t.column("bucket").to_pylist(), t.column("block").to_pylist(), t.column("size").to_pylist()
        begin = np.uint64(bucket[0] << (64 - bits))
        key = np.concatenate([begin + np.cumsum(_unplanes(x, n).view(np.uint64)) for x, n in zip(t.column("keys").to_pylist(), sizes, strict=True)])
        every, where = np.unique(key, return_inverse=True)
        cuts = np.cumsum(sizes)[:-1]
        sums = []
        for c in ("n", "n_target"):
            one = np.concatenate([_unplanes(x, n) for x, n in zip(t.column(c).to_pylist(), sizes, strict=True)])
            total = np.bincount(where, weights=one).astype(np.int64)
            sums.append(pa.array([_planes(x) for x in np.split(total[where], cuts)], pa.binary()))
        words = [int((every & _ONE).sum()), *[0] * (len(block) - 1)]
        return pa.table([pa.array(bucket, pa.int32()), pa.array(block, pa.int64()), pa.array(sizes, pa.int64()), *sums, pa.array(words, pa.int64())], names=["bucket", "block", "size", "n", "n_target", "words"])

    return run


def sums(blocked: DataFrame, n_tokens: int) -> DataFrame:
    """(bucket, block, size, n, n_target, words): counts of each block's n-grams in the corpus and the target set."""
    bits = max(1, (n_tokens // BUCKET_GRAMS).bit_length())
    each = blocked.select("block", "target", "lens", "texts").mapInArrow(lean("lmscore", _count(bits)), "bucket int, block bigint, size bigint, keys binary, n binary, n_target binary")
    return each.groupBy("bucket").applyInArrow(_sum(bits), "bucket int, block bigint, size bigint, n binary, n_target binary, words bigint")


def _own(doc: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """How often each entry occurs in its own text."""
    _, inverse, n = np.unique(doc * size + at, return_inverse=True, return_counts=True)
    return n[inverse]


def _losses(tables, own, mine, total, vocabulary) -> np.ndarray:
    """Loss of each token in nats. ``tables``: counts of its word, context and bigram; ``own``: those of its own text,
    which are taken out where the model was counted on it (``mine``), so a text's score doesn't tell whether it was in
    the target set."""
    w, c, p = (np.maximum(t - np.where(mine, o, 0), 0).astype(np.float64) for t, o in zip(tables, own, strict=True))
    unigram = (w + 0.5) / (total + 0.5 * vocabulary)
    # The share of the bigram grows with the context's count, by the same rule in both models.
    keep = c / np.maximum(c + np.sqrt(c), 1.0)
    return -np.log(keep * np.minimum(p, c) / np.maximum(c, 1.0) + (1 - keep) * unigram)


_SCORES = "doc_id bigint, n_tokens bigint, background_loss double, target_loss double, score double"


def _score(totals: tuple[int, int], vocabulary: int):
    def run(blocked: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("bucket")
        sizes = found.column("size").to_pylist()
        tables = [np.concatenate([np.zeros(0, np.int64), *map(_unplanes, found.column(c).to_pylist(), sizes)]) for c in ("n", "n_target")]
        (some,), (target,), (lens,), (data,) = (blocked.column(c).to_pylist() for c in ("ids", "target", "lens", "texts"))
        every, lens, at = _distinct(_texts(lens, data))
        if len(every) != len(tables[0]):
            raise RuntimeError(f"{len(tables[0])} sums for a block of {len(every)} n-grams")
        doc, target = np.repeat(np.arange(len(lens)), lens), np.frombuffer(target, bool)
        own = [_own(doc, x, len(every)) for x in at]
        some_tokens = lens > 0
        begin = (np.cumsum(lens) - lens)[some_tokens]
        mean = []
        for table, total, mine in zip(tables, totals, (np.ones(len(lens), bool), target), strict=True):
            loss = _losses([table[x] for x in at], own, np.repeat(mine, lens), np.repeat(np.where(mine, total - lens, total), lens), vocabulary)
            mean.append(np.zeros(len(lens)))
            if len(begin):
                mean[-1][some_tokens] = np.add.reduceat(loss, begin) / lens[some_tokens]
        return pa.table([pa.array(some, pa.int64()), pa.array(lens), *map(pa.array, mean), pa.array(mean[0] - mean[1])], names=["doc_id", "n_tokens", "background_loss", "target_loss", "score"])

    return run


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """doc_id, n_tokens, background_loss, target_loss and score (their difference) of every document, by whole texts.

    Null or empty texts have no tokens and score 0. Repeated rows are counted and scored each. Ids of the target that
    no document has don't matter; with an empty target, all tokens get the unigram floor. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    tune(spark)
    blocked, _ = materialize(blocks(docs, target_ids), "blocks")
    n, n_target = blocked.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_target"), F.lit(0))).first()
    settle(spark)
    summed, _ = materialize(sums(blocked, n), "sums")
    settle(spark)
    vocabulary = summed.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    texts = blocked.select("block", "ids", "target", "lens", "texts")
    return texts.groupBy("block").cogroup(summed.drop("words").groupBy("block")).applyInArrow(_score((n, n_target), vocabulary), _SCORES)


def good_documents(labels: DataFrame) -> DataFrame:
    """Ids of documents labelled of good quality: the target set of the query."""
    return pick(labels, "doc_id", "quality", types={"doc_id": "bigint", "quality": "int"}).where("quality = 1").select("doc_id")
