"""Text features: tokens, stems, stop words, hashing embeddings, entities, SPARQL and Cypher string functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import bind, fold

#: Words that keyword search ignores.
STOP_WORDS = """
a an the and or but is are was were be been being have has had do does did will would could should may might must shall
can need dare ought used to of in for on with at by from as into through during before after above below between under
again further then once here there when where why how all each few more most other some such no nor not only own same so
than too very s t just don now i me my myself we our ours ourselves you your yours yourself he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these those
""".split()

#: Words that begin a sentence and aren't a name.
STARTERS = "the a an this that these those it i we they he she".split()


def tokens(text: Column) -> Column:
    """Case-folded tokens at white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def matches_token(text: Column, word: str) -> Column:
    return F.array_contains(tokens(text), word.lower())


def stem(word: Column) -> Column:
    """Words of over five letters lose their first fitting end of: ing, ed, es, s (but not of ss), ly; tion becomes t."""
    cut = lambda n: word.substr(F.lit(1), F.length(word) - n)
    ends = lambda e: F.endswith(word, F.lit(e))
    out = F.when(ends("ing"), cut(3)).when(ends("ed") | ends("es"), cut(2)).when(ends("s") & ~ends("ss"), cut(1)).when(ends("ly"), cut(2)).when(ends("tion"), cut(3)).otherwise(word)
    return F.when(F.length(word) > 5, out).otherwise(word)


def words(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text; empty ones at its ends."""
    return F.split(F.lower(text), r"[^a-z0-9]+")


def is_term(word: Column) -> Column:
    """Whether keyword search heeds a word: over one character, no stop word."""
    return (F.length(word) > 1) & ~word.isin(*STOP_WORDS)


def terms(text: Column) -> Column:
    """Terms for keyword search: words that it heeds, stemmed."""
    return F.transform(F.filter(words(text), is_term), stem)


def str_before(s: Column, mark: str) -> Column:
    return F.when(F.instr(s, mark) > 0, F.substring_index(s, mark, 1)).otherwise(F.lit(""))


def str_after(s: Column, mark: str) -> Column:
    at = F.instr(s, mark)
    return F.when(at > 0, s.substr(at + len(mark), F.length(s))).otherwise(F.lit(""))


def substring0(s: Column, start: int, length: int | None = None) -> Column:
    """Cypher's substring, from 0."""
    return s.substr(F.lit(start + 1), F.lit(length) if length is not None else F.length(s))


def entities(text: Column) -> Column:
    """Arrays of distinct urls, emails, mentions and persons, in the order of the text.

    Words are parted at white space and trimmed of ``,.();`` (mail addresses of ``<>`` too). An URL has over ten
    characters; a mention is @ and more; a person is a run of two capitalised words or more, each trimmed of what is
    neither letter nor digit and over one character long, but not a run of two that begins a sentence with a STARTER.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    trim = lambda w, marks: F.regexp_replace(w, f"^[{marks}]+|[{marks}]+$", "")
    plain = F.transform(words, lambda w: trim(w, ",.();"))
    urls = F.filter(plain, lambda w: w.rlike("^https?://") & (F.octet_length(w) > 10))
    emails = F.filter(F.transform(words, lambda w: trim(w, ",.();<>")), lambda w: w.rlike(r"^[\p{L}\p{N}._+-]+@[\p{L}\p{N}-][\p{L}\p{N}.-]*\.[\p{L}\p{N}.-]*[\p{L}\p{N}-]$"))
    mentions = F.filter(plain, lambda w: w.rlike("^@."))
    return F.struct(*[F.array_distinct(x).alias(n) for n, x in (("urls", urls), ("emails", emails), ("mentions", mentions), ("persons", _persons(words)))])


def _persons(words: Column) -> Column:
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    ends = F.transform(words, lambda w: w.rlike(r"[.!?]$"))

    def run(acc: Column, s: Column) -> Column:
        """One word: goes on with the open run, or closes it and perhaps begins another."""
        capital = s["w"].rlike(r"^\p{Lu}") & (F.octet_length(s["w"]) > 1)
        opened = F.size(acc["open"]) > 0
        fresh = F.when(capital, F.array(s["w"])).otherwise(F.array().cast("array<string>"))
        return F.struct(
            F.when(capital & opened, F.concat(acc["open"], F.array(s["w"]))).otherwise(fresh).alias("open"),
            F.when(capital & opened, acc["first"]).otherwise(acc["ended"]).alias("first"),
            s["end"].alias("ended"),
            F.when(capital, acc["out"]).otherwise(_closed(acc)).alias("out"),
        )

    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit(True).alias("first"), F.lit(True).alias("ended"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(F.zip_with(bare, ends, lambda w, e: F.struct(w.alias("w"), e.alias("end"))), start, run, _closed)


def _closed(acc: Column) -> Column:
    starter = acc["first"] & (F.size(acc["open"]) == 2) & F.lower(F.get(acc["open"], F.lit(0))).isin(*STARTERS)
    whole = F.array(F.array_join(acc["open"], " "))
    return F.when((F.size(acc["open"]) > 1) & ~starter, F.concat(acc["out"], whole)).otherwise(acc["out"])


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """A deterministic unit vector of a whole text: each component is a hash of its place and the text, from -1 to 1."""
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))

    def one(h: Column, i: Column) -> Column:
        word = F.substring(F.md5(F.concat_ws(":", i.cast("string"), h).cast("binary")), 1, 8)
        return F.conv(word, 16, 10).cast("double") / F.lit(float(2**32 - 1)) * 2 - 1

    made = bind(digest, lambda h: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: one(h, i)))
    return bind(made, lambda v: bind(F.sqrt(fold(F.transform(v, lambda x: x * x))), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))))


class EmbeddingProvider:
    """What embeds texts: subclass it for a model. This one hashes."""

    name, dims = "hash", 64

    def embed(self, texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), self.dims))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = xxhash.xxh3_64_intdigest(w)
                out[i, h % self.dims] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)


def embed_udf(provider: EmbeddingProvider | None = None):
    """A pandas UDF around a provider: Arrow batches, not rows."""
    p = provider or EmbeddingProvider()

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(p.embed(texts.tolist())))

    return embed
