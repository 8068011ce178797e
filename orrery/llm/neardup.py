"""Near-duplicate documents by b-bit MinHash, with links confirmed on full shingle sets.

1. One pass over the texts: each document's set of word shingles, as 64-bit hashes, gives a fingerprint of the set, its
   MinHash minima hashed by bands, and the low bits of the minima packed into a few words.
2. Documents with equal sets form a class; from here on a class is one node, however many copies it has.
3. Nodes that share a band's key are candidates. Within a bucket, each node is first held against two centres (the
   bucket's smallest and largest node). Bit counts of packed signatures estimate the similarity, corrected for bits
   that agree by chance; pairs well under the threshold are left.
4. A second pass reads the sets of candidate nodes; the pairs are confirmed on full sets; confirmed links are contracted
   to components.
5. Buckets whose nodes are still in different components are gone through again, each node against the most similar
   of some other centres, once: near copies of one text are often nearer to some than to others.
6. Buckets that are still open are searched for links between their components, by blocks of nodes that bring their
   sets: packed signatures choose the pairs, full sets confirm them on the spot, and of the links a forest goes out. So
   texts that are near each other without being links cost time, but no rows. Components are contracted for the last time.

So within a bucket that is one component no pairs are formed, and no link is lost to that: a pair that shares a bucket
is either connected or held against each other. What MinHash itself can miss is a pair that shares no bucket (3e-7 at
a similarity of 0.85, less above) or whose estimate errs by over 4.5 standard deviations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, distinct, docs_of, forget, lean, masked, materialize, tune, words_of

ROWS, BANDS, BITS = 6, 32, 2
K = ROWS * BANDS
LANES = K * BITS // 64
#: Nodes of a bucket, and bytes of their sets, that are held against as many others at a time.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Bits of the filter that spares the second pass most texts, 8 MB. It is used where it has 16 bits a candidate or more;
#: of more candidates, texts are found by a semi-join instead.
FILTER_BITS = 1 << 26

_rng = np.random.default_rng(20240)
_A = (_rng.integers(0, 1 << 32, K, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, K, dtype=np.uint64).astype(np.uint32)
_MIX = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles; of fewer words, of the whole sequence; else empty."""
    words, codes, sizes = words_of(texts, lower=True)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[codes]
    n = max(0, len(h) - width + 1)
    roll = np.zeros(n, np.uint64)
    for j in range(width):
        roll += h[j : j + n] * _MIX[j]
    roll = _mix(roll)
    out, at = [], 0
    for size in sizes.tolist():
        if size >= width:
            out.append(distinct(roll[at : at + size - width + 1]))
        elif size:
            few = b" ".join(words[c] for c in codes[at : at + size].tolist())
            out.append(np.array([xxhash.xxh3_64_intdigest(b"%d " % size + few)], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
        at += size
    return out


def node_of(s: np.ndarray) -> int:
    """A 64-bit fingerprint of a set."""
    both = np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(_mix(s + np.uint64(0x1234567))), len(s)], np.uint64)
    return int(_mix((both * _MIX[:3]).sum(dtype=np.uint64, keepdims=True))[0].astype(np.int64))


def minima(s: np.ndarray) -> np.ndarray:
    """The K minima of a set that isn't empty."""
    h = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(K, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(h), 1024):
        np.minimum(out, (h[None, lo : lo + 1024] * _A[:, None] + _B[:, None]).min(axis=1), out=out)
    return out


def bands_of(m: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, the band's number mixed in."""
    x = m.reshape(BANDS, ROWS).astype(np.uint64)
    return _mix((x * _BAND).sum(axis=1, dtype=np.uint64)).astype(np.int64)


def packed(m: np.ndarray) -> np.ndarray:
    """The low bits of the minima, packed."""
    low = (m & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(LANES, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).astype(np.int64)


_FIELD = np.uint64(0x5555555555555555)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many packed minima agree; the last axis holds the lanes."""
    x = a ^ b
    return K - np.bitwise_count((x | (x >> np.uint64(1))) & _FIELD).sum(axis=-1, dtype=np.int64)


def least_agreeing(similarity: float, sigmas: float = 4.5) -> int:
    """Agreeing minima under which a pair of that similarity hardly ever falls. The expected share is corrected for
    chance: p = s + (1 - s) / 2^BITS."""
    p = similarity + (1 - similarity) / 2**BITS
    return int(np.floor(K * p - sigmas * np.sqrt(K * p * (1 - p))))


def _list(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists."""
    flat = pa.array(values.reshape(-1), pa.int64())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), flat)


def _sketches(width: int):
    def run(batches):
        for b in batches:
            sets = shingle_sets(b.column("text"), width)
            mins = np.array([minima(s) if len(s) else np.zeros(K, np.uint32) for s in sets], np.uint32).reshape(-1, K)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("tag"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                    _list(np.array([packed(m) for m in mins], np.int64).reshape(-1, LANES)),
                    _list(np.array([bands_of(m) for m in mins], np.int64).reshape(-1, BANDS)),
                ],
                names=["doc_id", "tag", "n_shingles", "node", "sig", "bands"],
            )

    return run


def _slot(doc_ids: np.ndarray) -> np.ndarray:
    return (_mix(doc_ids.astype(np.uint64)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _filter_slots(batches):
    """Bytes and bits of the filter that ids set."""
    for b in batches:
        s = distinct(_slot(b.column(0).to_numpy(zero_copy_only=False)))
        yield pa.RecordBatch.from_arrays([pa.array(s // 32768), pa.array(s % 32768)], names=["chunk", "bit"])


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of hashed ids, FILTER_BITS / 8 bytes at most, made by the executors in chunks of 4 KB."""
    rows = ids.mapInArrow(lean("neardup", _filter_slots), "chunk bigint, bit bigint").groupBy("chunk").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        out[r.chunk * 4096 : (r.chunk + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def _read_sets(width: int, bitmap=None):
    def run(batches):
        for b in batches:
            if bitmap:
                slot = _slot(b.column("doc_id").to_numpy(zero_copy_only=False))
                b = b.filter(pa.array((bitmap.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1))
            sets = [s for s in shingle_sets(b.column("text"), width) if len(s)]
            for lo in range(0, len(sets), 200):
                part = sets[lo : lo + 200]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in part], pa.int64()), pa.array([s.tobytes() for s in part], pa.binary())], names=["node", "members"])

    return run


def sets_of(docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """(node, members) of the documents (doc_id, text) whose ids are in ``reps`` (rep): a row a node, however many rows
    are alike. Some nodes that aren't asked for may be among them. ``reps`` must be cheap to read: it is read twice."""
    d = docs.where("doc_id is not null")
    if 16 * reps.count() <= FILTER_BITS:
        run = _read_sets(width, docs.sparkSession.sparkContext.broadcast(id_filter(reps)))
    else:
        run, d = _read_sets(width), d.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    found = d.select("doc_id", "text").mapInArrow(lean("neardup", run), "node bigint, members binary")
    return found.groupBy("node").agg(F.first("members").alias("members"))


def _confirm(percent: int):
    def run(batches):
        for b in batches:
            left = b.column("left").to_pylist()
            right = b.column("right").to_pylist()
            ok = []
            for x, y in zip(left, right, strict=True):
                ok.append(_is_link(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("right"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return both.mapInArrow(lean("neardup", _confirm(percent)), "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each end of a link reaches. ``links`` (a, b) must be a stored table.

    Alternates stars on larger and on smaller neighbours until no edge changes; each round is a stored table.
    """
    spark = links.sparkSession
    edges = links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct()
    old, path, state = edges, None, None
    while True:
        both = old.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(old.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")), F.struct(F.col("m").alias("lo"), "hi"))).alias("e"))
        new, new_path = materialize(small.select("e.lo", "e.hi").where("lo < hi").distinct(), "stars")
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
        if path:
            forget(spark, path)
        if now == state or not now[0]:
            break
        old, path, state = new, new_path, now
    roots = new.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct()
    return new.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(roots)


def _promising(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(node, centre, agree) of pairs (node, centre) whose packed signatures and sizes allow a link."""
    sig = classes.select("node", "sig", "n")
    centre = sig.select(F.col("node").alias("centre"), F.col("sig").alias("csig"), F.col("n").alias("cn"))
    p = pairs.join(sig, "node").join(centre, "centre")
    agree = F.lit(K)
    for i in range(LANES):
        x = F.col("sig")[i].bitwiseXOR(F.col("csig")[i])
        agree = agree - F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    p = p.withColumn("agree", agree).where(F.col("agree") >= least_agreeing(percent / 100)).where(_sizes("n", "cn", percent))
    return p.select("node", "centre", "agree")


def _ordered(node: str, centre: str) -> list:
    return [F.least(node, centre).alias("a"), F.greatest(node, centre).alias("b")]


def _star_pairs(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """At most two pairs a node: with the smallest and the largest nodes of its buckets, of those the most promising."""
    ends = members.select("node", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("lo").alias("centre")), F.struct(F.lit(1).alias("end"), F.col("hi").alias("centre")))).alias("c"))
    pairs = ends.select("node", "c.end", "c.centre").where("node != centre").distinct()
    p = _promising(pairs.select("node", "centre").distinct(), classes, percent).join(pairs, ["node", "centre"])
    sure = F.col("agree") >= least_agreeing(percent / 100, sigmas=-0.5)
    best = F.struct(F.when(sure, 0).otherwise(1), F.when(sure, 0).otherwise(-F.col("agree")), "centre")
    best = p.groupBy("node", "end").agg(F.min(best).alias("best"))
    return best.select(*_ordered("node", "best.centre")).distinct()


#: Other centres of a bucket in a round, rounds at most (the search that follows is whole without them), and links under
#: which a round is the last.
CENTRES, ROUNDS, FEW = 4, 1, 32


def _centre_pairs(members: DataFrame, labels: DataFrame, classes: DataFrame, percent: int, seed: int) -> DataFrame:
    """A pair a node at most: with the most similar of the centres, drawn by a hash, of its open buckets, of those that
    aren't in its component."""
    m = members.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    drawn = [F.min_by(F.struct("node", "label"), F.xxhash64("node", "key", F.lit(seed * CENTRES + r))).alias(f"c{r}") for r in range(CENTRES)]
    open_ = m.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), *drawn).where("l0 != l1")
    met = m.join(open_.select("key", F.array_distinct(F.array(*[f"c{r}" for r in range(CENTRES)])).alias("c")), "key").select("node", "label", F.explode("c").alias("c"))
    pairs = met.where("label != c.label").select("node", F.col("c.node").alias("centre")).distinct()
    best = _promising(pairs, classes, percent).groupBy("node").agg(F.max_by("centre", F.struct("agree", "centre")).alias("centre"))
    return best.select(*_ordered("node", "centre")).distinct()


def _sizes(n: str, m: str, percent: int):
    """Sets of such sizes can reach the threshold."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _is_link(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    if len(s) > len(t):
        s, t = t, s
    at = np.minimum(np.searchsorted(t, s), len(t) - 1)
    both = int((t[at] == s).sum())
    return 100 * both >= percent * (len(s) + len(t) - both)


def _cross(percent: int):
    """Links between nodes of different components within each sorted run of (key, i, j): a forest of them.

    Packed signatures choose the pairs, full sets confirm them. A pair whose components a link of the run has joined
    already is passed over, so a run gives fewer links than it has nodes. A pair that shares several buckets is held
    against each other in that of its first common band only.
    """
    least = least_agreeing(percent / 100)

    def candidates(key, side, label, n, sig, bands):
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        found = [np.empty((3, 0), np.int64)]
        for lo in range(0, len(left), 64):
            part = left[lo : lo + 64]
            agree = agreeing(sig[part][:, None, :], sig[right][None, :, :])
            small, big = np.minimum(n[part][:, None], n[right][None, :]), np.maximum(n[part][:, None], n[right][None, :])
            x, y = np.nonzero((label[part][:, None] != label[right][None, :]) & (agree >= least) & (100 * small >= percent * big))
            agree = agree[x, y]
            x, y = part[x], right[y]
            first = np.argmax(bands[x] == bands[y], axis=1)
            own = (bands[x, first] == key) & ((x < y) | (side[x] != 2))
            found.append(np.stack([x, y, agree])[:, own])
        x, y, agree = np.concatenate(found, axis=1)
        best = np.argsort(-agree, kind="stable")
        return zip(x[best].tolist(), y[best].tolist(), strict=True)

    def links(rows, members):
        labels = rows[:, 5].tolist()
        root = {x: x for x in labels}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for x, y in candidates(rows[0, 0], rows[:, 3], rows[:, 5], rows[:, 6], rows[:, 7 : 7 + LANES].view(np.uint64), rows[:, 7 + LANES :]):
            u, v = find(labels[x]), find(labels[y])
            if u != v and _is_link(np.frombuffer(members[x], np.uint64), np.frombuffer(members[y], np.uint64), percent):
                root[u] = v
                a, b = int(rows[x, 4]), int(rows[y, 4])
                yield min(a, b), max(a, b)

    def run(batches):
        kept, sets, size = [], [], 0

        def work(last):
            nonlocal kept, sets, size
            rows = np.concatenate(kept)
            cuts = [0, *(np.flatnonzero(np.any(rows[1:, :3] != rows[:-1, :3], axis=1)) + 1).tolist(), len(rows)]
            ends = cuts if last else cuts[:-1]
            out = [x for s, e in zip(ends, ends[1:], strict=False) if e - s > 1 for x in links(np.ascontiguousarray(rows[s:e]), sets[s:e])]
            kept, sets = [rows[ends[-1] :]], sets[ends[-1] :]
            size = sum(map(len, sets))
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

        for b in batches:
            wide = [b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in ("sig", "bands")]
            kept.append(np.column_stack([*(b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "i", "j", "side", "node", "label", "n")), *wide]))
            sets += (more := b.column("members").to_pylist())
            size += sum(map(len, more))
            if len(sets) >= 20_000 or size >= 2 * BLOCK_BYTES:
                yield work(False)
        if sets:
            yield work(True)

    return run


def _cross_links(members: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components that share a bucket. Of a bucket's blocks, each two meet in one task."""
    m = members.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    m = m.join(classes.select("node", "n"), "node")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, 8 * F.sum("n") / BLOCK_BYTES)).cast("int")
    open_ = m.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), blocks.alias("blocks")).where("l0 != l1").select("key", "blocks")
    m = m.join(open_, "key").join(classes.select("node", "sig", "bands"), "node").join(sets, "node")
    m = m.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least(F.col("block"), o).alias("i"), F.greatest(F.col("block"), o).alias("j"), F.when(o == F.col("block"), 2).when(F.col("block") < o, 0).otherwise(1).alias("side")),
    )
    wide = ["node", "label", "n", "sig", "bands", "members"]
    m = m.select("key", *wide, F.explode(meets).alias("x")).select("key", "x.i", "x.j", "x.side", *wide)
    return m.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(lean("neardup", _cross(percent)), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """Per document: n_shingles, component_id (the smallest doc_id reachable over links) and kept (it is its own).

    Words are lower-cased in A-Z. Null or empty texts have no shingles and link with nothing. Documents with a null
    doc_id take no links. Repeated rows are alike. Only doc_id and text are read; an empty table gives no rows.
    ``percent`` is the least similarity that links, in percent.
    """
    return _grouped(docs, percent, width).select("doc_id", "n_shingles", "component_id", "kept")


def _grouped(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """What :func:`near_duplicates` gives, with each row's group, a node of its component (null: no shingles), and tag, a hash of its text."""
    spark = docs.sparkSession
    tune(spark)
    d = docs_of(docs, "doc_id", "text")
    tagged = d.withColumn("tag", F.xxhash64("text"))
    sketch, _ = materialize(tagged.mapInArrow(lean("neardup", _sketches(width)), "doc_id bigint, tag bigint, n_shingles bigint, node bigint, sig array<bigint>, bands array<bigint>"), "sketches")
    whole = sketch.where("node is not null and doc_id is not null")
    classes, _ = materialize(whole.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "classes")
    keyed = classes.select("node", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi")
    members, members_path = materialize(keyed.join(buckets, "key"), "members")
    reps, reps_path = materialize(classes.join(members.select("node").distinct(), "node", "left_semi").select("rep"), "representatives")
    sets, sets_path = materialize(sets_of(d, reps, width), "sets")
    links, path = materialize(confirmed(_star_pairs(members, classes, percent), sets, percent), "links")
    labels, labels_path = materialize(components(links), "labels")
    forget(spark, path)

    def link(found: DataFrame) -> int:
        nonlocal labels, labels_path
        more, path = materialize(found, "links")
        if n := more.count():
            as_links = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a != b")
            new, new_path = materialize(components(more.unionByName(as_links)), "labels")
            forget(spark, labels_path)
            labels, labels_path = new, new_path
        forget(spark, path)
        return n

    for seed in range(ROUNDS):
        if link(confirmed(_centre_pairs(members, labels, classes, percent, seed), sets, percent)) < FEW:
            break
    link(_cross_links(members, labels, classes, sets, percent))
    forget(spark, members_path, sets_path, reps_path)
    reps = classes.select("node", "rep").join(labels, "node", "left")
    least = reps.where("label is not null").groupBy("label").agg(F.min("rep").alias("least"))
    ids = reps.join(least, "label", "left").select("node", F.coalesce("label", "node").alias("group"), F.coalesce("least", "rep").alias("least"))
    out = sketch.select("doc_id", "tag", "n_shingles", "node").join(ids, "node", "left")
    component = F.when(F.col("doc_id").isNull() | F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "group", "tag")


def drop_near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """One document of each group of near-duplicates, with all its columns; of rows with one id in one group,
    one row. Rows with one id and texts that aren't linked all stay.

    Documents without words, or with a null id, stay, repeated rows of theirs too. Columns of any names pass through;
    a missing text or doc_id counts as null. An empty table gives no rows.
    """
    found, _ = materialize(_grouped(docs, percent, width), "kept")
    d, at = masked(docs, "doc_id", "text")
    d = d.withColumn("_tag", F.xxhash64(F.col(at["text"]).cast("string"))).withColumn("_id", F.col(at["doc_id"]).cast("bigint"))
    # Equal sets may stand for texts that differ in case or white space: of those, one tag.
    one = found.where("kept and doc_id is not null and group is not null").groupBy("doc_id", "group").agg(F.min("tag").alias("_tag"))
    one = one.select(F.col("doc_id").alias("_id"), "_tag").distinct()
    linked = d.join(one, ["_id", "_tag"], "left_semi").dropDuplicates(["_id", "_tag"])
    bare = F.coalesce(F.regexp_count(F.col(at["text"]).cast("string"), F.lit(WORD)), F.lit(0)) == 0
    rest = d.where(F.col("_id").isNull() | bare)
    cols = [f"_c{i}" for i in range(len(docs.columns))]
    return linked.select(*cols).unionByName(rest.select(*cols)).toDF(*docs.columns)
