"""Quality rules by n-gram perplexity.

A character n-gram model with modified Kneser-Ney smoothing is counted by Spark for each language over every
document, kept in sorted hash arrays, and scores each word of each document. Documents whose perplexity leaves
their language's band are rejected, besides those that fail two plain rules (few words, much repetition).

N-grams run over the characters of a word between a start mark and an end mark; so the score of a word is a
function of the word, and equal words of a batch are scored once. What workers hold stays bounded: n-grams that make up
at least ``min_share`` of their language's. The others stay in tables: a document's occurrences of them are listed when it
is scored, and get their probabilities by joins. So every document is scored by the whole model.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Recent, distinct, docs_of, forget, lean, masked, materialize, raw, tune, words_of

ORDER = 4
#: A word has neither of these characters.
START, END = " ", "\n"
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Bytes that don't begin a code point, and white space.
NOT_WORD_CHAR = bytes(range(0x80, 0xC0)) + SPACE
WINDOW = 8
#: Distinct words that are counted at a time, and scores of words that a worker remembers in a generation, of all
#: languages: some 50 MB in two generations.
FOLD, CACHE = 50_000, 200_000
#: Tables of a row a language are broadcast up to so many rows.
BROADCAST_LANGUAGES = 10_000

METRICS = [
    ("n_words", T.LongType()),
    ("word_chars", T.LongType()),
    ("n_symbols", T.LongType()),
    ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()),
    ("log_ppl", T.DoubleType()),
]


@dataclass(frozen=True)
class Rules:
    """Limits of the rules. ``below``, ``above``: how far a language's band reaches from its median log perplexity, in
    robust standard deviations of that side, which are never under ``least_dev``. A document's own noise adds to the
    variance: at ``noise_words`` words, as much as the documents' spread."""

    min_words: int = 20
    max_repeat_pct: int = 30
    min_share: float = 5e-7
    below: float = 3.0
    above: float = 3.0
    least_dev: float = 0.01
    noise_words: int = 100


# --- counting ---------------------------------------------------------------------------------------------------


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of padded words on end, and where each word begins."""
    pad = START * (ORDER - 1)
    text = "".join([f"{pad}{w}{END}" for w in words])
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + ORDER
    return cp, np.concatenate([[0], np.cumsum(lens)])


def _keys(cp: np.ndarray) -> np.ndarray:
    """For each position, a 64-bit hash of the ORDER code points that end there."""
    k = cp.astype(np.uint64)
    out = k.copy()
    for i in range(1, ORDER):
        out[i:] += k[:-i] * _MULT[i]
    return out


_MULT = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def _count(batches):
    """Counts of ORDER-grams of each task's texts, by language: of so many distinct words at a time as FOLD says."""
    words: dict[str, Counter] = {}

    def rows():
        for lang, c in words.items():
            listed = [w.decode("utf-8", "replace") for w in c]
            each = np.fromiter(c.values(), np.int64, len(c))
            for lo in range(0, len(listed), FOLD):
                yield _grams(lang, listed[lo : lo + FOLD], each[lo : lo + FOLD])
        words.clear()

    for b in batches:
        langs = b.column("lang")
        for lang in pc.unique(langs).to_pylist():
            listed, codes, _ = words_of(b.column("text").filter(pc.equal(langs, lang)))
            c = words.setdefault(lang, Counter())
            for w, n in zip(listed, np.bincount(codes, minlength=len(listed)).tolist(), strict=True):
                c[w] += n
        if sum(map(len, words.values())) > 2 * FOLD:
            yield from rows()
    yield from rows()


def _grams(lang: str, words: list[str], n: np.ndarray) -> pa.RecordBatch:
    """Rows (lang, gram, n) of distinct words that occur ``n`` times."""
    cp, at = _points(words)
    inside = np.ones(len(cp), bool)
    for i in range(ORDER - 1):
        inside[at[:-1] + i] = False
    ends = np.flatnonzero(inside)
    each = np.repeat(n, np.diff(at) - (ORDER - 1))
    _, first, inv = np.unique(_keys(cp)[ends], return_index=True, return_inverse=True)
    total = np.bincount(inv, weights=each).astype(np.int64)
    points = np.stack([cp[ends[first] - i] for i in range(ORDER - 1, -1, -1)], axis=1)
    text = points.tobytes().decode("utf-32-le", "surrogatepass")
    grams = [text[i : i + ORDER] for i in range(0, len(text), ORDER)]
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(total)], names=["lang", "gram", "n"])


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each character ORDER-gram occurs in the words of each language's documents."""
    tune(docs.sparkSession)
    d = docs_of(docs, "lang", "text").select(F.coalesce("lang", F.lit("")).alias("lang"), "text")
    return d.mapInArrow(lean("quality", _count), "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, min_share: float) -> Model:
    """An interpolated modified Kneser-Ney model from counts of ORDER-grams, which must be a stored table.

    Lower orders use the number of distinct left neighbours, but for n-grams at a word's start, which have none.
    Spark computes every count, discount, back-off weight and probability, from all n-grams. N-grams with at least
    ``min_share`` of their language's occurrences, at most ``ORDER / min_share`` a language, then come to the driver,
    a language at a time, to be sorted by their hashes. All are in the model's tables, which stay stored until
    ``forget(spark, *model.paths)``.
    """
    spark, paths = counts.sparkSession, []

    def stored(df: DataFrame, name: str) -> DataFrame:
        out, path = materialize(df, name)
        paths.append(path)
        return out

    least = {r.lang: max(1.0, r.n * min_share) for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    up = counts.select("lang", "gram", "n", F.col("n").alias("raw"))
    grams, contexts = {}, {}
    for k in range(ORDER, 0, -1):
        one = lambda j: F.sum(F.when(F.col("n") == j, 1).otherwise(0)).alias(f"n{j}")
        cuts = [(r.lang, least[r.lang], *_discounts(r.n1, r.n2, r.n3, r.n4)) for r in up.groupBy("lang").agg(*map(one, (1, 2, 3, 4))).collect()]
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        cut = spark.createDataFrame(cuts, "lang string, least double, d1 double, d2 double, d3 double")
        t = up.join(F.broadcast(cut) if len(cuts) <= BROADCAST_LANGUAGES else cut, "lang").withColumn("d", d)
        common = (F.col("raw") >= F.col("least")).alias("common")
        grams[k] = stored(t.select("lang", "gram", (F.col("n") - F.col("d")).alias("left"), common), f"left{k}")
        ctx = t.groupBy("lang", F.substring("gram", 1, k - 1).alias("ctx")).agg(F.sum("n").alias("tot"), F.sum("d").alias("d"), F.sum("raw").alias("raw"), F.max("least").alias("least"), F.count("*").alias("v"))
        contexts[k] = stored(ctx.select("lang", "ctx", "tot", (F.col("d") / F.col("tot")).alias("weight"), "v", common), f"contexts{k}")
        if k > 1:
            started = F.substring("gram", 2, 1) == START
            down = up.groupBy("lang", F.substring("gram", 2, k - 1).alias("gram")).agg(F.sum("n").alias("_sum"), F.count("*").alias("_left"), F.sum("raw").alias("raw"), F.max(started).alias("_started"))
            down = down.where(F.col("gram") != START).select("lang", "gram", F.when(F.col("_started"), F.col("_sum")).otherwise(F.col("_left")).alias("n"), "raw")
            up = stored(down, f"grams{k - 1}")
    # Every n-gram has a context and an n-gram of the next lower order; both are as common or commoner.
    flat = F.col("weight") / (F.col("v") + 1)
    p = grams[1].join(contexts[1].select("lang", "tot", flat.alias("flat")), "lang").select("lang", "gram", (F.col("left") / F.col("tot") + F.col("flat")).alias("p"), "common")
    probs = {1: stored(p, "p1")}
    for k in range(2, ORDER + 1):
        g = grams[k].select("lang", "gram", "left", "common", F.substring("gram", 1, k - 1).alias("ctx"), F.substring("gram", 2, k - 1).alias("low"))
        low = probs[k - 1].select("lang", F.col("gram").alias("low"), F.col("p").alias("lower"))
        g = g.join(contexts[k].select("lang", "ctx", "tot", "weight"), ["lang", "ctx"]).join(low, ["lang", "low"])
        probs[k] = stored(g.select("lang", "gram", (F.col("left") / F.col("tot") + F.col("weight") * F.col("lower")).alias("p"), "common"), f"p{k}")
    model = Model({})
    for r in contexts[1].select("lang", flat.alias("flat")).collect():
        orders = []
        for k in range(1, ORDER + 1):
            back = contexts[k + 1].where((F.col("lang") == r.lang) & F.col("common")).select("ctx", "weight").toArrow() if k < ORDER else None
            orders.append((probs[k].where((F.col("lang") == r.lang) & F.col("common")).select("gram", "p").toArrow(), back))
        model.langs[r.lang] = Language.of(r.flat, orders)
    model.tables = {k: (probs[k].drop("common"), contexts[k].select("lang", "ctx", "weight")) for k in probs}
    model.paths = [p for p in paths if p.rsplit("/", 1)[1].startswith(("orrery-p", "orrery-contexts"))]
    forget(spark, *set(paths) - set(model.paths))
    return model


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What to take off counts of 1, 2 and 3 or more, from the numbers of n-grams that occur 1 to 4 times."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    by = lambda j, a, b, usual: min(float(j), max(0.0, j - (j + 1) * y * b / a)) if a and y else usual
    return by(1, n1, n2, 0.5), by(2, n2, n3, 0.75), by(3, n3, n4, 0.9)


# --- scoring ----------------------------------------------------------------------------------------------------


def _log(p: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(p, 1e-12))


def _hashed(k: int, names: pa.ChunkedArray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of n-grams of ``k`` characters, and their values in that order."""
    cp = np.frombuffer("".join(names.to_pylist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, k)
    key = np.zeros(len(cp), np.uint64)
    for i in range(k):
        key += cp[:, k - 1 - i].astype(np.uint64) * _MULT[i]
    order = np.argsort(key)
    return key[order], values[order]


@dataclass
class Language:
    """A language's n-grams in sorted hash arrays: by order, (hashes, log probabilities) and, of those that are a
    context, (hashes, log back-off weights)."""

    unseen: float
    orders: list[tuple]

    @staticmethod
    def of(flat: float, orders: list[tuple[pa.Table, pa.Table | None]]) -> Language:
        none = np.zeros(0, np.uint64), np.zeros(0)
        out = []
        for k, (grams, back) in enumerate(orders, 1):
            pair = lambda t: _hashed(k, t.column(0), _log(t.column(1).to_numpy()))  # noqa: E731, B023
            out.append((pair(grams), none if back is None else pair(back)))
        return Language(float(_log(np.array([flat]))[0]), out)

    def words(self, words: list[str]) -> np.ndarray:
        """Log probability of each word, its end included."""
        cp, at = _points(words)
        wide = cp.astype(np.uint64)
        inside = np.ones(len(cp), bool)
        for i in range(ORDER - 1):
            inside[at[:-1] + i] = False
        ends = np.flatnonzero(inside)
        left, score = ends, np.zeros(len(ends))
        open_ = np.arange(len(ends))

        def key(pos: np.ndarray, k: int) -> np.ndarray:
            out = wide[pos].copy()
            for i in range(1, k):
                out += wide[pos - i] * _MULT[i]
            return out

        def find(t: np.ndarray, keys: np.ndarray):
            if not len(t):
                return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
            i = np.minimum(np.searchsorted(t, keys), len(t) - 1)
            return i, t[i] == keys

        for k in range(ORDER, 0, -1):
            t, logp = self.orders[k - 1][0]
            i, hit = find(t, key(left, k))
            score[open_[hit]] += logp[i[hit]]
            left, open_ = left[~hit], open_[~hit]
            if not len(left):
                break
            if k > 1:
                t, weight = self.orders[k - 2][1]
                i, hit = find(t, key(left - 1, k - 1))
                score[open_[hit]] += weight[i[hit]]
        score[open_] += self.unseen
        return np.add.reduceat(score, at[:-1] - (ORDER - 1) * np.arange(len(words)))


@dataclass
class Model:
    """A model for each language: what is held in memory; by order, tables of all probabilities (lang, gram, p) and
    back-off weights (lang, ctx, weight); and where these tables lie."""

    langs: dict[str, Language]
    tables: dict[int, tuple[DataFrame, DataFrame]] = field(default_factory=dict)
    paths: list[str] = field(default_factory=list)

    def words(self, lang: str, words: list[str]) -> np.ndarray:
        """Log probability of each word by what is held in memory, its end included; of a language without a model, 0."""
        return self.langs[lang].words(words) if lang in self.langs else np.zeros(len(words))

    def look_up(self, grams: DataFrame) -> DataFrame:
        """(lang, gram, units) of distinct ORDER-grams: their log probabilities in the tables, in UNIT-ths."""
        flat = grams.sparkSession.createDataFrame([(la, m.unseen) for la, m in self.langs.items()], "lang string, unseen double")
        log = lambda x: F.log(F.greatest(F.col(x), F.lit(1e-12)))
        g = grams.select("lang", "gram", F.col("gram").alias("_at"), F.lit(0.0).alias("_back"), F.lit(None).cast("double").alias("_log"))
        for k in range(ORDER, 0, -1):
            probs, contexts = self.tables[k]
            g = g.join(probs.select("lang", F.col("gram").alias("_at"), log("p").alias("_p")), ["lang", "_at"], "left")
            g = g.withColumn("_log", F.coalesce("_log", F.col("_back") + F.col("_p"))).drop("_p")
            if k > 1:
                g = g.withColumn("_ctx", F.substring("_at", 1, k - 1)).join(contexts.select("lang", F.col("ctx").alias("_ctx"), log("weight").alias("_w")), ["lang", "_ctx"], "left")
                g = g.select("lang", "gram", F.substring("_at", 2, k - 1).alias("_at"), (F.col("_back") + F.coalesce("_w", F.lit(0.0))).alias("_back"), "_log")
        g = g.join(F.broadcast(flat) if len(self.langs) <= BROADCAST_LANGUAGES else flat, "lang")
        return g.select("lang", "gram", F.round(F.coalesce("_log", F.col("_back") + F.col("unseen")) * UNIT).cast("bigint").alias("units"))


#: Log probabilities are summed as whole numbers of this part of 1, so that their order doesn't matter.
UNIT = 2**32


def _held(top: tuple[np.ndarray, np.ndarray], words: list[str]) -> list:
    """For each word, its log probability by ORDER-grams that are held in memory; where others occur in it, a pair of
    that and these."""
    cp, at = _points(words)
    inside = np.ones(len(cp), bool)
    for i in range(ORDER - 1):
        inside[at[:-1] + i] = False
    ends = np.flatnonzero(inside)
    keys, logp = top
    key = _keys(cp)[ends]
    i = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
    hit = keys[i] == key if len(keys) else np.zeros(len(key), bool)
    each = np.where(hit, logp[i], 0.0) if len(keys) else np.zeros(len(key))
    out = np.add.reduceat(each, at[:-1] - (ORDER - 1) * np.arange(len(words))).tolist()
    miss = ends[~hit]
    text = np.stack([cp[miss - i] for i in range(ORDER - 1, -1, -1)], axis=1).tobytes().decode("utf-32-le", "surrogatepass")
    for n, w in enumerate((np.searchsorted(at, miss, "right") - 1).tolist()):
        if not isinstance(out[w], tuple):
            out[w] = out[w], []
        out[w][1].append(text[n * ORDER : (n + 1) * ORDER])
    return out


def _repeats(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each text of so many words, given as codes on end: how many lie in windows of WINDOW words that occur twice or
    more in it."""
    out = np.zeros(len(sizes), np.int64)
    long_ = np.flatnonzero(sizes > WINDOW)
    if not len(long_):
        return out
    h = codes[np.repeat(sizes > WINDOW, sizes)].astype(np.uint64)
    h = (h + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    ends = np.cumsum(sizes[long_])
    starts = ends - sizes[long_]
    n = len(h) - WINDOW + 1
    roll = np.zeros(n, np.uint64)
    mult = np.uint64(1)
    for j in range(WINDOW):
        roll += (h[j : j + n] ^ (h[j : j + n] >> np.uint64(29))) * mult
        mult = np.uint64(int(mult) * 0x9E3779B97F4A7C15 % 2**64)
    doc = np.repeat(np.arange(len(long_), dtype=np.uint64), sizes[long_])[:n]
    roll ^= (doc + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    valid = np.arange(n) + WINDOW <= np.repeat(ends, sizes[long_])[:n]
    s = np.sort(roll[valid])
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return out
    twice = distinct(twice)
    i = np.minimum(np.searchsorted(twice, roll), len(twice) - 1)
    begin = np.flatnonzero((twice[i] == roll) & valid)
    step = np.zeros(len(h) + 1, np.int64)
    np.add.at(step, begin, 1)
    np.add.at(step, begin + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
    for k, d in enumerate(long_):
        out[d] = int(covered[ends[k]] - covered[starts[k]])
    return out


def _scorer(models: dict, text: str, lang: str):
    """mapInArrow function that appends METRICS, a number of the row and the ORDER-grams that are not held in memory to
    the rows; these still lack in log_ppl. models: broadcast ORDER-grams by language; a worker loads those of the
    languages that it meets."""

    def run(batches):
        caches: dict[str, Recent] = {}
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            texts = raw(b.column(text))
            langs = pc.fill_null(b.column(lang).cast(pa.string()), "")
            rest: list[list[str]] = [[] for _ in range(b.num_rows)]
            n_words, repeats, ppl = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            if sum(map(len, caches.values())) > CACHE:
                for cache in caches.values():
                    cache.age()
            chars = np.fromiter((len(t.translate(None, NOT_WORD_CHAR)) for t in texts), np.int64, len(texts))
            for la in pc.unique(langs).to_pylist():
                mine = np.flatnonzero(pc.equal(langs, la).to_numpy(zero_copy_only=False))
                ws, codes, lens = words_of(b.column(text).take(pa.array(mine)))
                cache = caches.setdefault(la, Recent(0))
                model = models[la].value if la in models else None
                miss = cache.lacking(ws)
                for lo in range(0, len(miss), 20_000):
                    part = miss[lo : lo + 20_000]
                    listed = [w.decode("utf-8", "replace") for w in part]
                    cache.update(zip(part, _held(model, listed) if model else [0.0] * len(part), strict=True))
                n_words[mine], repeats[mine] = lens, _repeats(codes, lens)
                some = lens > 0
                if some.any():
                    known = [cache[w] for w in ws]
                    part = [i for i, v in enumerate(known) if isinstance(v, tuple)]
                    if part:
                        lacks = {i: known[i][1] for i in part}
                        for i in part:
                            known[i] = known[i][0]
                        at = np.flatnonzero(np.isin(codes, part))
                        for d, w in zip(mine[np.searchsorted(np.cumsum(lens), at, "right")].tolist(), codes[at].tolist(), strict=True):
                            rest[d] += lacks[w]
                    each = np.array(known)[codes]
                    ppl[mine[some]] = -np.add.reduceat(each, (np.cumsum(lens) - lens)[some]) / (chars[mine] + lens)[some]
            symbols, dup = [], []
            for t in texts:
                lines = [x for x in t.split(b"\n") if x.strip()]
                symbols.append(len(t) - len(t.translate(None, SYMBOLS)))
                dup.append(len(lines) - len(set(lines)))
            new = [
                pa.array(n_words),
                pa.array(chars),
                pa.array(symbols, pa.int64()),
                pa.array(dup, pa.int64()),
                pa.array(repeats),
                pa.array(ppl),
                pa.array(np.arange(row, row + b.num_rows)),
                pa.array(rest, pa.list_(pa.string())),
            ]
            row += b.num_rows
            keep = [i for i, f in enumerate(b.schema) if f.name != text or run.keep_text]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], *new], names=[*[b.schema.field(i).name for i in keep], *[k for k, _ in METRICS], "_row", "_rest"])

    run.keep_text = True
    return run


def fit(docs: DataFrame, rules: Rules = Rules()) -> Model:
    """The model of all documents, by language."""
    counts, path = materialize(gram_counts(docs), "grams")
    model = kneser_ney(counts, rules.min_share)
    forget(docs.sparkSession, path)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang", keep_text: bool = False) -> DataFrame:
    """Append METRICS to all columns; the text itself only with ``keep_text``."""
    stored, whole, _ = _score(docs, model, text, lang, keep_text)
    return stored.drop("log_ppl", "_rest").join(whole.select("_row", "log_ppl"), "_row").select(*[c for c in stored.columns if c not in ("_row", "_rest")])


def _score(docs: DataFrame, model: Model, text: str, lang: str, keep_text: bool) -> tuple[DataFrame, DataFrame, list[str]]:
    """(a stored table of the rows, which still lacks rare n-grams in log_ppl; a stored table without their other long
    columns but with all n-grams in log_ppl; where both lie). Rows have a number in both, ``_row``."""
    spark = docs.sparkSession
    tune(spark)
    run = _scorer({la: spark.sparkContext.broadcast(m.orders[-1][0]) for la, m in model.langs.items()}, text, lang)
    run.keep_text = keep_text
    fields = [f for f in docs.schema.fields if keep_text or f.name != text]
    new = [*[T.StructField(k, t) for k, t in METRICS], T.StructField("_row", T.LongType()), T.StructField("_rest", T.ArrayType(T.StringType()))]
    stored, path = materialize(docs.mapInArrow(lean("quality", run), T.StructType([*fields, *new])), "quality")
    rare = stored.select("_row", F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.explode("_rest").alias("gram"))
    rare = rare.groupBy("_row", "lang", "gram").agg(F.count("*").alias("_n"))
    looked, looked_path = materialize(model.look_up(rare.select("lang", "gram").distinct()), "rare") if model.langs else (None, None)
    whole = stored.drop("_rest", *([text] if keep_text else []))
    if looked is not None:
        more = rare.join(looked, ["lang", "gram"]).groupBy("_row").agg(F.sum(F.col("_n") * F.col("units")).alias("_units"))
        lacking = F.coalesce(F.col("_units") / UNIT / (F.col("word_chars") + F.col("n_words")), F.lit(0.0))
        whole = whole.join(more, "_row", "left").withColumn("log_ppl", F.col("log_ppl") - lacking).drop("_units")
    whole, whole_path = materialize(whole, "scores")
    if looked_path:
        forget(spark, looked_path)
    return stored, whole, [path, whole_path]


def bands(scored: DataFrame, rules: Rules, lang: str = "lang") -> dict[str, tuple[float, float, float]]:
    """Each language's median log perplexity and robust standard deviations below and above it, over all documents that
    pass the base rules. One row a language comes to the driver."""
    ok = scored.where(~base_failed(rules)).select(F.coalesce(lang, F.lit("")).alias("lang"), "log_ppl")
    rows = ok.groupBy("lang").agg(F.percentile_approx("log_ppl", [0.25, 0.5, 0.75], 10_000).alias("q")).collect()
    dev = lambda x: max(rules.least_dev, x / 0.6745)
    return {r.lang: (r.q[1], dev(r.q[1] - r.q[0]), dev(r.q[2] - r.q[1])) for r in rows}


def base_failed(rules: Rules):
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_pct * F.col("n_words"))


def verdict(scored: DataFrame, by_lang: dict[str, tuple[float, float, float]], rules: Rules, lang: str = "lang") -> DataFrame:
    """Append base_failed, ppl_low, ppl_high and kept. A language without a band (no document passed) keeps all."""
    spark = scored.sparkSession
    rows = [(k, *x) for k, x in by_lang.items()]
    limits = spark.createDataFrame(rows, "_lang string, _mid double, _below double, _above double")
    limits = F.broadcast(limits) if len(rows) <= BROADCAST_LANGUAGES else limits
    wide = F.sqrt(1 + rules.noise_words / F.greatest(F.col("n_words"), F.lit(1)).cast("double"))
    return (
        scored.join(limits, F.coalesce(F.col(lang), F.lit("")) == F.col("_lang"), "left")
        .withColumn("base_failed", base_failed(rules))
        .withColumn("ppl_low", F.col("_mid") - rules.below * F.col("_below") * wide)
        .withColumn("ppl_high", F.col("_mid") + rules.above * F.col("_above") * wide)
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("log_ppl").between(F.col("ppl_low"), F.col("ppl_high")), F.lit(True)))
        .drop("_lang", "_mid", "_below", "_above")
    )


def quality_table(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document: its metrics, ``base_failed`` and ``kept``.

    Null or empty text: no words, so ``base_failed``. Null lang: a language of its own. Repeated rows are judged
    each. Only ``doc_id``, ``text`` and ``lang`` are read; other columns may have any names. An empty table
    gives an empty result.
    """
    model = fit(docs, rules)
    _, scored, paths = _score(docs_of(docs, "doc_id", "lang", "text"), model, "text", "lang", False)
    forget(docs.sparkSession, *model.paths, paths[0])
    out = verdict(scored, bands(scored, rules), rules)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ppl", "ppl_low", "ppl_high", "base_failed", "kept")


def quality_filter(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that :func:`quality_table` keeps, all their columns as they came.

    Null or empty texts go, as they fail the base rules. Null lang: a language of its own. Repeated rows are judged each.
    Columns of any names pass through; a missing text or lang counts as null. An empty table gives an empty result.
    """
    model = fit(docs, rules)
    d, at = masked(docs, "text", "lang")
    text, lang = at["text"], at["lang"]
    stored, scored, _ = _score(d, model, text, lang, keep_text=True)
    forget(docs.sparkSession, *model.paths)
    # Verdicts come from the table without texts; rejected rows, which are fewer than kept ones, meet the texts.
    scored = scored.select("_row", lang, *[k for k, _ in METRICS])
    rejected = verdict(scored, bands(scored, rules, lang), rules, lang).where(~F.coalesce("kept", F.lit(False))).select("_row")
    cols = [f"_c{i}" for i in range(len(docs.columns))]
    return stored.join(rejected, "_row", "left_anti").select(*cols).toDF(*docs.columns)
