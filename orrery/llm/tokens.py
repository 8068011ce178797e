"""Token counts through a digest cache, and encoding by words for other operators.

A text's count depends on its content and the tokenizer alone. So counts are kept in a table under
(tokenizer digest, content digest); a run joins its documents' digests to that table, encodes each distinct
missing text once, appends the new counts and joins again.

Within a text, the tokenizers split at white space before they merge; so equal pieces are encoded once a worker.
``tests/llm`` holds counts and ids against the libraries on whole texts.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Recent, docs_of, lean, materialize, pick, raw, shared_dir, tune, worker_state

#: White space before a word goes with it: byte-level BPE joins a space and the word after it.
_UNITS = re.compile(rb"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
#: White space beyond ASCII, and separators that libraries treat differently: such a text is encoded in one piece.
_ODD = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8d\xa8\xa9\xaf]|\xe2\x81[\x9f\xa0]|\xe3\x80\x80|\xef\xbb\xbf")
#: Pieces a worker remembers in a generation, and the longest of them in bytes: some 90 MB in two generations.
REMEMBER, LONGEST = 300_000, 48
#: Marks that may follow a word. Tokenizers cut between a letter or digit and such a mark, so a word and the marks
#: behind it are encoded apart. Not among them: the apostrophe (contractions) and what special tokens are made of.
_MARKS = b".,;:!?\")]}*#$%&=+-_~^@/\\"
_WORD_END = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def load_tokenizer(path: str):
    """The library's tokenizer for a .json (tokenizers) or .model (sentencepiece) file; one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _encode(tok, texts: list[str]) -> list[list[int]]:
    if hasattr(tok, "encode_batch_fast"):
        return [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    return tok.encode(texts, num_threads=1)


def _text(b: bytes) -> str:
    return b.decode("utf-8", "replace")


class PieceCache(Recent):
    """Pieces of text to what ``make`` gives for their ids, such that values of parts add up. ``make`` gets the ids of
    many pieces on end, and where each one's end.

    Pieces that are new are taken apart into a word and the marks behind it; only new ones of those are encoded, many
    in one call, with a special token between them.
    """

    def __init__(self, tok, make):
        super().__init__(REMEMBER)
        self.tok, self.make, self.once = tok, make, {}
        self.between = next((t for t in ("<|endoftext|>",) if hasattr(tok, "token_to_id") and tok.token_to_id(t) is not None), None)
        self.mark = tok.token_to_id(self.between) if self.between else None

    def learn(self, pieces: Iterable[bytes]) -> None:
        """Encode the pieces that aren't known, together. Long ones are kept only until the next call."""
        self.once.clear()
        self.age()
        parts, new = [], []
        for p in self.lacking(pieces):
            c = p.rstrip(_MARKS)
            if len(c) == len(p) or not c or c[-1] not in _WORD_END:
                new.append(p)
            else:
                parts.append((p, c, p[len(c) :]))
        self._encode(list({*new, *self.lacking({x for _, *two in parts for x in two})}))
        for p, c, marks in parts:
            (self if len(p) <= LONGEST else self.once)[p] = self[c] + self[marks]

    def _encode(self, texts: list[bytes]) -> None:
        """What ``make`` gives for each text; it is kept."""
        plain = [t for t in texts if b"<|" not in t] if self.between else []
        for lo in range(0, len(plain), 4000):
            part = plain[lo : lo + 4000]
            ids = np.array(_encode(self.tok, [self.between.join(map(_text, part))])[0], np.uint32)
            marks = ids == self.mark
            self._keep(part, ids[~marks], np.append(np.flatnonzero(marks) - np.arange(len(part) - 1), len(ids) - len(part) + 1))
        rest = [t for t in texts if b"<|" in t] if self.between else texts
        for lo in range(0, len(rest), 2000):
            part = rest[lo : lo + 2000]
            lists = _encode(self.tok, [_text(t) for t in part])
            self._keep(part, np.array([i for x in lists for i in x], np.uint32), np.cumsum(list(map(len, lists))))

    def _keep(self, texts: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        self.update(zip(texts, self.make(ids, ends), strict=True))
        for t in [t for t in texts if len(t) > LONGEST]:
            self.once[t] = self.pop(t)

    def __missing__(self, piece: bytes):
        return self.once[piece]


def worker_cache(path: str, kind: str, make, remember: int = REMEMBER) -> PieceCache:
    """A cache that its Python worker keeps till another operator uses the worker; ``remember``: pieces in a generation."""
    state = worker_state(f"tokens-{kind}")
    if path not in state:
        state[path] = PieceCache(load_tokenizer(path), make)
    state[path].most = remember
    return state[path]


def count_tokens(path: str, texts: list[bytes]) -> list[int]:
    """Number of tokens of each text."""
    cache = worker_cache(path, "count", lambda ids, ends: np.diff(ends, prepend=0).tolist())
    if path.endswith(".model"):
        return [len(x) for x in _encode(cache.tok, [_text(t) for t in texts])]
    units = [None if _ODD.search(t) else _UNITS.findall(t) for t in texts]
    cache.learn(set().union(*[u for u in units if u]))
    whole = [i for i, u in enumerate(units) if u is None]
    odd = dict(zip(whole, _encode(cache.tok, [_text(texts[i]) for i in whole]), strict=True)) if whole else {}
    return [len(odd[i]) if u is None else sum(map(cache.__getitem__, u)) for i, u in enumerate(units)]


# --- the digest cache -------------------------------------------------------------------------------------------

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens bigint"


def tokenizer_digest(path: str) -> str:
    """Names a tokenizer version: its file's content and how texts are encoded."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"|no special tokens added").hexdigest()


def content_digest(text) -> F.Column:
    """SHA-256 of the normalised content: the text itself, null as empty; byte-level BPE tells all else apart."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _count_rows(path: str):
    def run(batches):
        for b in batches:
            texts = raw(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(count_tokens(path, texts), pa.int64())], names=["digest", "n_tokens"])

    return run


def cached_counts(docs: DataFrame, tokenizer_path: str, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(counts of all distinct contents of ``docs``, the part of them that was missing in ``cache``).

    The second is what to append to the cache; it is already written to the shared folder. A digest that the cache
    holds twice, as after two runs at once, counts once.
    """
    spark = docs.sparkSession
    tune(spark)
    version = tokenizer_digest(tokenizer_path)
    d = docs_of(docs, "text").select(F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", content_digest(F.col("text")))
    distinct = d.dropDuplicates(["digest"])
    known = None
    if cache is not None:
        known = pick(cache, "tokenizer", "digest", "n_tokens").where(F.col("tokenizer") == version).select("digest", "n_tokens").dropDuplicates(["digest"])
        distinct = distinct.join(known, "digest", "left_anti")
    new, _ = materialize(distinct.select("digest", "text").mapInArrow(lean("tokens-count", _count_rows(tokenizer_path)), "digest binary, n_tokens bigint"), "tokens")
    counts = new if known is None else new.unionByName(known)
    return counts, new.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens")


def shared_cache(spark: SparkSession) -> str:
    """Where queries keep their cache: a table in the folder that all machines share."""
    return f"{shared_dir(spark)}/orrery-token-cache"


def append_cache(cache_path: str, new: DataFrame) -> None:
    """Append new counts to a cache table, a folder a tokenizer version; nothing new writes nothing."""
    if not new.isEmpty():
        new.write.mode("append").partitionBy("tokenizer").parquet(cache_path)


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame | None:
    """A cache table as it is now; None where nothing was written yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, cache_path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document.

    With ``cache_path``, counts found there aren't made again and new ones are appended. Null text counts as
    empty. Repeated rows each get a row. Other columns may have any names. An empty table gives no rows.
    """
    cache = read_cache(docs.sparkSession, cache_path) if cache_path else None
    counts, new = cached_counts(docs, tokenizer_path, cache)
    if cache_path:
        append_cache(cache_path, new)
    d = docs_of(docs, "doc_id", "text")
    d = d.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"), content_digest(F.col("text")).alias("digest"))
    return d.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
