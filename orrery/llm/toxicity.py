"""Toxic spans and document scores by a linear-chain conditional random field.

Labels mark documents, the field needs labelled tokens. So tokens of a training sample are labelled first: a token of a
toxic document is toxic if its word, or a character n-gram of it, is found almost only in toxic documents. On these
labelled tokens a field with two states is trained (character n-gram features of the word, transitions); so it also
tags words that it never saw but that are built alike. Forward-backward marginals of every token of every text then
give spans (tokens more likely toxic than not) and a document's score: a logistic function of the expected number of
toxic tokens, their share and the largest marginal, fitted on the training sample.

The sample is bounded by ``Training.sample`` documents and ``Training.sample_bytes`` a label, drawn by a hash; all
documents are scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Recent, docs_of, forget, lean, materialize, pick, raw, tune, words_of

SLOTS = 1 << 17
#: Words whose weights a worker remembers in a generation.
REMEMBER = 200_000
#: Tokens in a chunk of the batched recursion.
CHUNK = 64
STRIP = b".,;:!?\"'()[]{}<>|*#$%&-_/\\"


@dataclass(frozen=True)
class Training:
    """``sample``, ``sample_bytes``: documents of each label to train on, at most, and bytes of text after which no more
    are taken; those taken are used whole. Scores read all texts whole."""

    sample: int = 2000
    sample_bytes: int = 8 << 20
    ratio: float = 20.0
    least_docs: int = 4
    epochs: int = 6
    rate: float = 0.5
    decay: float = 1e-4


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id in decimal divides by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def normal(word: bytes) -> bytes:
    return word.strip(STRIP).lower()


def features(word: bytes) -> list[int]:
    """Slots of a normalised word's features: itself, beginnings, ends and inner character n-grams."""
    w = word.decode("utf-8", "replace").lower()
    names = [f"w={w}", *[f"p{k}={w[:k]}" for k in (3, 4, 5) if len(w) > k], *[f"s{k}={w[-k:]}" for k in (3, 4) if len(w) > k]]
    names += [f"g={w[i : i + 5]}" for i in range(len(w) - 4)]
    return sorted({xxhash.xxh32_intdigest(n) % SLOTS for n in names}) if w else []


# --- the field --------------------------------------------------------------------------------------------------


class Field:
    """Weights of a two-state field: one per feature (for the toxic state), transitions, and the score's function."""

    def __init__(self):
        self.w = np.zeros(SLOTS)
        self.bias = -3.0
        self.trans = np.zeros((2, 2))
        self.score_w = np.array([-3.0, 1.0, 1.0, 1.0])

    def emission(self, word: bytes) -> float:
        f = features(word)
        return self.bias + float(self.w[f].sum()) / np.sqrt(len(f)) if f else self.bias

    def document_score(self, expected: np.ndarray, largest: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = self.inputs(expected, largest, n)
        return 1 / (1 + np.exp(-np.clip(x @ self.score_w, -30, 30)))

    @staticmethod
    def inputs(expected, largest, n) -> np.ndarray:
        return np.column_stack([np.ones(len(n)), np.log1p(expected), np.sqrt(expected / np.maximum(n, 1)), largest])


def marginals(emission: np.ndarray, lens: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Probability of the toxic state of each token; texts' tokens follow each other, ``lens`` a text."""
    fwd, back = forward_backward(emission, lens, trans)
    both = fwd * back
    return both[1] / both.sum(axis=0)


def expected_transitions(emission: np.ndarray, lens: np.ndarray, trans: np.ndarray, fwd: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Expected number of neighbours in states (i, j), from their pairwise marginals."""
    inner = np.ones(len(emission), bool)
    inner[np.cumsum(lens[lens > 0]) - 1] = False
    a = np.flatnonzero(inner)
    e1 = np.exp(np.clip(emission[a + 1], -30, 30))
    out = np.stack([[fwd[i, a] * np.exp(trans[i, j]) * (e1 if j else 1.0) * back[j, a + 1] for j in (0, 1)] for i in (0, 1)])
    return (out / out.sum(axis=(0, 1))).sum(axis=2)


def forward_backward(emission: np.ndarray, lens: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward vectors (own emission in) and backward vectors (own emission out) of each token, each up to a factor.

    Exact, batched: texts are cut into chunks; all chunks' transfer matrices are multiplied up at once,
    chunk by chunk vectors follow from them, and all chunks' inner vectors are computed at once again.
    """
    total = int(lens.sum())
    if not total:
        return np.zeros((2, 0)), np.zeros((2, 0))
    t = np.exp(trans)
    per = -(-lens // CHUNK)
    n_chunks = int(per.sum())
    text_of = np.repeat(np.arange(len(lens)), per)
    first = np.cumsum(per) - per
    nth = np.arange(n_chunks) - first[text_of]
    begin = (np.cumsum(lens) - lens)[text_of] + nth * CHUNK
    size = np.minimum(CHUNK, lens[text_of] - nth * CHUNK)
    cols = np.arange(CHUNK)
    inside = cols[None, :] < size[:, None]
    at = np.where(inside, begin[:, None] + cols[None, :], 0)
    e1 = np.exp(np.clip(emission, -30, 30))[at]  # state 0 has potential 1
    # Transfer matrix of a token: M[i, j] = t[i, j] * e[j]; outside the text the identity.
    m = np.tile(np.eye(2).reshape(4, 1), (1, n_chunks))
    for c in range(CHUNK):
        ok = inside[:, c]
        a, b, p, q = m
        e = e1[:, c]
        new = np.array([a * t[0, 0] + b * t[1, 0], (a * t[0, 1] + b * t[1, 1]) * e, p * t[0, 0] + q * t[1, 0], (p * t[0, 1] + q * t[1, 1]) * e])
        if not c:  # no transition leads into a text
            new = np.where(nth == 0, np.array([a, b * e, p, q * e]), new)
        new /= new.max(axis=0)
        m = np.where(ok, new, m)
    m = m.reshape(2, 2, n_chunks)
    head = np.ones((2, n_chunks))
    tail = np.ones((2, n_chunks))
    most = int(per.max(initial=0))
    for k in range(1, most):
        now = first[per > k] + k
        v = np.einsum("in,ijn->jn", head[:, now - 1], m[:, :, now - 1])
        head[:, now] = v / v.max(axis=0)
        back = first[per > k] + per[per > k] - 1 - k
        v = np.einsum("ijn,jn->in", m[:, :, back + 1], tail[:, back + 1])
        tail[:, back] = v / v.max(axis=0)
    fwd = np.empty((2, n_chunks, CHUNK))
    x, y = head
    for c in range(CHUNK):
        ok = inside[:, c]
        nx, ny = x * t[0, 0] + y * t[1, 0], (x * t[0, 1] + y * t[1, 1]) * e1[:, c]
        if not c:
            nx, ny = np.where(nth == 0, x, nx), np.where(nth == 0, y * e1[:, c], ny)
        s = np.maximum(nx, ny)
        x, y = np.where(ok, nx / s, x), np.where(ok, ny / s, y)
        fwd[0, :, c], fwd[1, :, c] = x, y
    behind = np.empty((2, n_chunks, CHUNK))
    x, y = tail
    for c in range(CHUNK - 1, -1, -1):
        ok = inside[:, c]
        behind[0, :, c], behind[1, :, c] = x, y
        e = e1[:, c]
        nx, ny = t[0, 0] * x + t[0, 1] * e * y, t[1, 0] * x + t[1, 1] * e * y
        s = np.maximum(nx, ny)
        x, y = np.where(ok, nx / s, x), np.where(ok, ny / s, y)
    return fwd[:, inside], behind[:, inside]


def label_tokens(lists: list[list[bytes]], toxic: np.ndarray, training: Training) -> list[np.ndarray]:
    """1 for tokens whose word, or an n-gram or beginning of it, is found almost only in toxic documents."""
    seen: list[dict] = [{}, {}]
    keys: dict[bytes, list[str]] = {}

    def of(w: bytes) -> list[str]:
        if w not in keys:
            s = w.decode("utf-8", "replace")
            keys[w] = [f"w={s}", *[f"p={s[:k]}" for k in (4, 5) if len(s) > k]] if len(s) > 2 else []
        return keys[w]

    for ws, x in zip(lists, toxic, strict=True):
        c = seen[int(x)]
        for k in {k for w in set(ws) for k in of(w)}:
            c[k] = c.get(k, 0) + 1
    n1, n0 = max(1, int(toxic.sum())), max(1, int((toxic == 0).sum()))
    bad = {k for k, n in seen[1].items() if n >= training.least_docs and n / n1 > training.ratio * (seen[0].get(k, 0) + 0.5) / n0}
    judged = {w: any(k in bad for k in ks) for w, ks in keys.items()}
    return [np.fromiter((x and judged[w] for w in ws), bool, len(ws)).astype(np.int8) for ws, x in zip(lists, toxic, strict=True)]


def gradient(emission: np.ndarray, tags: np.ndarray, lens: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Of the log likelihood of the tags: by each token's emission, their sum, and by the transitions."""
    fwd, back = forward_backward(emission, lens, trans)
    both = fwd * back
    g = tags - both[1] / both.sum(axis=0)
    inner = np.ones(len(tags), bool)
    inner[np.cumsum(lens[lens > 0]) - 1] = False
    a = np.flatnonzero(inner)
    seen = np.bincount(2 * tags[a] + tags[a + 1], minlength=4).reshape(2, 2)
    return g, float(g.sum()), seen - expected_transitions(emission, lens, trans, fwd, back)


def train(texts: list[bytes], toxic: np.ndarray, training: Training = Training()) -> Field:
    """A field from labelled texts, on the driver: the sample is bounded."""
    f = Field()
    lists = [[normal(w) for w in t.split()] for t in texts]
    tags = label_tokens(lists, toxic, training)
    vocab: dict[bytes, int] = {}
    ids = [np.fromiter((vocab.setdefault(w, len(vocab)) for w in ws), np.int64, len(ws)) for ws in lists]
    feats = [np.array(features(w), np.int64) for w in vocab]
    sizes = np.array([len(x) for x in feats])
    flat = np.concatenate(feats) if len(feats) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(feats)), sizes)
    scale = 1 / np.sqrt(np.maximum(sizes, 1))
    emit = lambda: f.bias + np.bincount(row, weights=f.w[flat], minlength=len(feats)) * scale
    g2, b2, t2 = np.full(SLOTS, 1e-8), 1e-8, np.full((2, 2), 1e-8)
    order = np.arange(len(lists))
    rng = np.random.default_rng(5)
    for _ in range(training.epochs):
        rng.shuffle(order)
        for lo in range(0, len(order), 64):
            some = [i for i in order[lo : lo + 64] if len(ids[i])]
            if not some:
                continue
            e = emit()
            tok, tag = np.concatenate([ids[i] for i in some]), np.concatenate([tags[i] for i in some])
            lens = np.array([len(ids[i]) for i in some])
            gw, gb, gt = gradient(e[tok], tag, lens, f.trans)
            err = np.bincount(tok, weights=gw, minlength=len(feats)) * scale
            g = np.bincount(flat, weights=err[row], minlength=SLOTS) / len(some) - training.decay * f.w
            g2 += g * g
            f.w += training.rate * g / np.sqrt(g2)
            gb /= len(some)
            b2 += gb * gb
            f.bias += 0.3 * gb / np.sqrt(b2)
            gt = gt / len(some) - 0.01 * f.trans
            t2 += gt * gt
            f.trans += 0.1 * gt / np.sqrt(t2)
    _fit_score(f, lists, toxic)
    return f


def _fit_score(f: Field, lists: list[list[bytes]], toxic: np.ndarray) -> None:
    lens = np.array([len(x) for x in lists])
    cache: dict[bytes, float] = {}
    e = np.array([cache[w] if w in cache else cache.setdefault(w, f.emission(w)) for ws in lists for w in ws])
    expected, largest = _summary(marginals(e, lens, f.trans), lens)
    x = Field.inputs(expected, largest, lens)
    w = f.score_w.copy()
    for _ in range(100):  # Newton steps of a lightly penalised logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (toxic - p) - 0.05 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    f.score_w = w


def _summary(p: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected number of toxic tokens and largest marginal of each text."""
    ends = np.cumsum(lens)
    sums = np.concatenate([[0.0], np.cumsum(p)])
    expected = np.maximum(sums[ends] - sums[ends - lens], 0.0)
    largest = np.zeros(len(lens))
    some = lens > 0
    if some.any():
        largest[some] = np.maximum.reduceat(p, (ends - lens)[some])
    return expected, largest


# --- on tables --------------------------------------------------------------------------------------------------


def fit(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> Field:
    """Train on labelled rows that aren't held out: at most ``training.sample`` a label, by a hash of the id, till they
    have ``training.sample_bytes``. Of several texts under one id, the least by its bytes is taken."""
    spark = docs.sparkSession
    d = docs_of(docs, "doc_id", "text")
    y = pick(labels, "doc_id", "toxic", types={"doc_id": "bigint", "toxic": "int"}).where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    y = y.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = [y.where(F.col("toxic") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(training.sample) for x in (0, 1)]
    drawn = drawn[0].unionByName(drawn[1])
    found, path = materialize(d.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "sample")
    before = F.sum("size").over(W.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, -1))
    sizes = found.select("doc_id", "toxic", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    taken = sizes.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < training.sample_bytes)
    rows = found.join(F.broadcast(taken.select("doc_id")), "doc_id").orderBy("doc_id").select("text", "toxic").toArrow()
    forget(spark, path)
    if not rows.num_rows:
        return Field()
    return train(raw(rows.column("text").combine_chunks()), rows.column("toxic").to_numpy().astype(np.float64), training)


def _score(field):
    def run(batches):
        f = field.value
        known: Recent = Recent(REMEMBER)
        for b in batches:
            texts = raw(b.column("text"))
            words, codes, lens = words_of(b.column("text"))
            known.age()
            known.update({w: f.emission(normal(w)) for w in known.lacking(words)})
            e = np.fromiter(map(known.__getitem__, words), np.float64, len(words))[codes]
            p = marginals(e, lens, f.trans)
            expected, largest = _summary(p, lens)
            score = f.document_score(expected, largest, lens)
            spans = []
            for t, n, hi, end in zip(texts, lens, largest, np.cumsum(lens), strict=True):
                spans.append(_spans(t, p[end - n : end]) if hi >= 0.5 else [])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32)), pa.array(expected, pa.float64()), pa.array(spans, pa.list_(pa.string()))],
                names=["doc_id", "score", "predicted", "expected_tokens", "spans"],
            )

    return run


def _spans(text: bytes, p: np.ndarray) -> list[str]:
    """start:end of toxic words by code point, neighbours joined."""
    out: list[list[int]] = []
    at = chars = 0
    last = -2
    for i, w in enumerate(text.split()):
        j = text.index(w, at)
        if p[i] >= 0.5:
            chars += len(text[at:j].decode("utf-8", "replace"))
            n = len(w.decode("utf-8", "replace"))
            if last == i - 1 and out:
                out[-1][1] = chars + n
            else:
                out.append([chars, chars + n])
            chars += n
            last = i
        else:
            chars += len(text[at : j + len(w)].decode("utf-8", "replace"))
        at = j + len(w)
    return [f"{s}:{e}" for s, e in out]


def toxicity(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> DataFrame:
    """Per document: held_out, score, predicted, expected_tokens, and spans as start:end of code points.

    A null or empty text has no tokens and scores low. Null ids are scored and count as not held out; labels that are
    null or neither 0 nor 1 aren't used; a document labelled twice is toxic if once so. Without labels every score
    is the untrained one. Repeated rows are scored each. Only doc_id and text are read, and of labels doc_id and toxic.
    """
    spark = docs.sparkSession
    tune(spark)
    field = spark.sparkContext.broadcast(fit(docs, labels, training))
    d = docs_of(docs, "doc_id", "text")
    out = d.mapInArrow(lean("toxicity", _score(field)), "doc_id bigint, score double, predicted int, expected_tokens double, spans array<string>")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", "expected_tokens", "spans")
