"""Importers of vectors, triples and financial reports."""

from __future__ import annotations

import io
import json
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import normalize


def read_json_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector, metadata) from an array or lines of objects; metadata is kept as JSON text. What isn't JSON raises.

    Where the first line that isn't blank is a whole object, each line is one, and files are split between tasks.
    """
    first = spark.read.text(path).where(F.trim("value") != "").first()
    many = first is not None
    if many:
        try:
            many = not isinstance(json.loads(first[0]), dict)
        except ValueError:
            pass
    return spark.read.schema("id string, vector array<double>, metadata string").json(path, multiLine=many, mode="FAILFAST")


def read_csv_vectors(spark: SparkSession, path: str, id_column: int = 0, vector_start: int = 1, dimensions: int | None = None, header: bool = True, sep: str = ",") -> DataFrame:
    """(id, vector) from delimited text: an id column and the columns after it; the dimension is read off the file's
    first line if it isn't given. A cell that is no number, or a row of another length, raises. Blank lines don't count."""
    if dimensions is None:
        first = spark.read.text(path).first()
        dimensions = len(first[0].split(sep)) - vector_start if first else 0
    names = [f"c{i}" for i in range(vector_start + dimensions)]
    df = spark.read.csv(path, header=header, sep=sep, schema=", ".join(f"{n} string" for n in names), mode="FAILFAST")
    wrong = lambda n: F.raise_error(F.concat(F.lit("not a number: "), F.coalesce(F.col(n), F.lit("nothing")))).cast("double")
    cells = [F.coalesce(F.trim(n).try_cast("double"), wrong(n)) for n in names[vector_start:]]
    return df.select(F.col(names[id_column]).alias("id"), F.array(*cells).alias("vector"))


def read_npy(spark: SparkSession, path: str, start_id: int = 0, rows_per_batch: int = 4096) -> DataFrame:
    """(id, vector) of two-dimensional float arrays in .npy files, one task a file."""

    def run(batches):
        for pdf in batches:
            for content in pdf.content:
                m = np.load(io.BytesIO(content), allow_pickle=False)
                for lo in range(0, len(m), rows_per_batch):
                    part = m[lo : lo + rows_per_batch].astype(float)
                    yield pd.DataFrame({"id": np.arange(start_id + lo, start_id + lo + len(part)), "vector": list(part)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "id bigint, vector array<double>")


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(g, s, p, o) from N-Triples or N-Quads text; comments and blank lines are left out, other lines that hold no triple
    raise when the result is read."""
    return parse_ntriples(spark.read.text(path))


def parse_ntriples(lines: DataFrame) -> DataFrame:
    term = r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+|\^\^<[^>]*>)?)'
    rx = rf"^\s*{term}\s+(<[^>]*>)\s+{term}\s*(<[^>]*>)?\s*\.\s*$"
    hit = lines.where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    g = F.regexp_extract("value", rx, 4)
    bad = F.raise_error(F.concat(F.lit("not a triple: "), "value")).cast("string")
    subject = F.when(F.col("value").rlike(rx), F.regexp_extract("value", rx, 1)).otherwise(bad)
    return hit.select(F.when(g != "", g).alias("g"), subject.alias("s"), F.regexp_extract("value", rx, 2).alias("p"), F.regexp_extract("value", rx, 3).alias("o"))


def triples_from(df: DataFrame, kind: str, key: str, base: str = "http://example.org/", references: dict[str, str] | None = None) -> DataFrame:
    """(g, s, p, o): one triple a non-key column; columns in ``references`` point at subjects of another kind."""
    refs = references or {}
    s = F.concat(F.lit(f"<{base}{kind}/"), F.col(key).cast("string"), F.lit(">"))
    out = df.select(s.alias("s"), F.lit("<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>").alias("p"), F.lit(f"<{base}{kind.title()}>").alias("o"))
    number = {"int": "integer", "bigint": "integer", "double": "double"}
    for c, t in df.dtypes:
        if c == key:
            continue
        if c in refs:
            o = F.concat(F.lit(f"<{base}{refs[c]}/"), F.col(c).cast("string"), F.lit(">"))
        elif t in number:
            o = F.concat(F.lit('"'), F.col(c).cast("string"), F.lit(f'"^^<http://www.w3.org/2001/XMLSchema#{number[t]}>'))
        else:
            o = F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"'))
        out = out.unionByName(df.where(F.col(c).isNotNull()).select(s.alias("s"), F.lit(f"<{base}{c.split('_', 1)[-1]}>").alias("p"), o.alias("o")))
    return out.select(F.lit(None).cast("string").alias("g"), "s", "p", "o")


def ingest(df: DataFrame, key: list[str], allowed=None, transform=None) -> DataFrame:
    """A batch of records: optional predicate, optional transformer, each key once."""
    df = df.where(allowed) if allowed is not None else df
    df = transform(df) if transform else df
    return df.dropDuplicates(key)


# --- financial reports --------------------------------------------------------------------------------------------

#: Parts of a concept's name that put it in a statement; the first statement that fits counts.
STATEMENTS = {
    "balance_sheet": ["Assets", "Liabilities", "Equity", "Cash", "Inventory", "Receivable", "Payable", "Debt", "Property", "Goodwill"],
    "income_statement": ["Revenue", "Sales", "Cost", "Expense", "Income", "Profit", "Loss", "Earnings", "EBITDA", "Margin"],
    "cash_flow": ["CashFlow", "Operating", "Investing", "Financing", "Depreciation", "Amortization", "CapitalExpenditure"],
}
#: A report whose main period is longer, in days, is an annual one.
ANNUAL_DAYS = 300


def statement_of(concept: Column) -> Column:
    """Which statement a concept belongs to; null if to none."""
    out = F.lit(None).cast("string")
    for name, parts in reversed(STATEMENTS.items()):
        out = F.when(concept.rlike("|".join(parts)), name).otherwise(out)
    return out


def xbrl_facts(reports: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, name, value, unit, context, start, end, statement) of the numeric facts of XBRL documents, one a row.

    A fact is an element that refers to a context; ``end`` is the period's end or instant, ``start`` is null for instants.
    Facts that aren't numbers are left out. A null or empty document has none; one that isn't XML raises.
    """
    kind = dict(reports.dtypes)[key]

    def facts(ident, text: str):
        root = ElementTree.fromstring(text)
        bare = lambda e: e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""
        period = {}
        for c in root.iter():
            if bare(c) == "context":
                at = {bare(e): (e.text or "").strip() for e in c.iter()}
                period[c.get("id")] = (at.get("startDate"), at.get("endDate") or at.get("instant"))
        for e in root.iter():
            ref = e.get("contextRef")
            if ref is not None:
                try:
                    value = float((e.text or "").replace(",", ""))
                except ValueError:
                    continue
                yield (ident, bare(e), value, e.get("unitRef"), ref, *period.get(ref, (None, None)))

    def run(batches):
        for pdf in batches:
            rows = [f for ident, text in zip(pdf[key], pdf[content], strict=True) if text for f in facts(ident, text)]
            yield pd.DataFrame(rows, columns=[key, "name", "value", "unit", "context", "start", "end"])

    found = reports.select(key, content).mapInPandas(run, f"`{key}` {kind}, name string, value double, unit string, context string, start string, end string")
    return found.withColumns({"start": F.col("start").try_cast("date"), "end": F.col("end").try_cast("date"), "statement": statement_of(F.col("name"))})


def statements(facts: DataFrame, key: str, dimensions: int = 64) -> DataFrame:
    """(key, period_end, is_annual, embedding): a row a report. The main period is the longest one, of equals the latest.
    The embedding holds ratios of concepts in that period, or at its end, padded with zeros and scaled to length 1;
    missing totals count as 1, other missing concepts as 0. Of equal facts, the largest value counts."""
    days = F.coalesce(F.datediff("end", "start"), F.lit(0))
    main = facts.where(F.col("end").isNotNull()).groupBy(key).agg(F.max(F.struct(days.alias("days"), "end")).alias("m"))
    f = facts.join(main, key).where(F.col("end") == F.col("m.end")).where(F.col("start").isNull() | (days == F.col("m.days")))
    total = lambda c, missing: F.coalesce(F.max(F.when(F.col("name") == c, F.col("value"))), F.lit(missing)).alias(c)
    wide = f.groupBy(key, F.col("m.end").alias("period_end"), (F.col("m.days") > ANNUAL_DAYS).alias("is_annual")).agg(
        total("Assets", 1.0), total("Liabilities", 0.0), total("StockholdersEquity", 1.0), total("Cash", 0.0), total("Revenue", 1.0), total("NetIncome", 0.0), total("OperatingIncome", 0.0)
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    pairs = [("Liabilities", "Assets"), ("Cash", "Assets"), ("StockholdersEquity", "Assets"), ("NetIncome", "Revenue"), ("OperatingIncome", "Revenue"), ("NetIncome", "StockholdersEquity"), ("NetIncome", "Assets")]
    raw = F.array(*[ratio(F.col(a), F.col(b)) for a, b in pairs], *[F.lit(0.0)] * (dimensions - len(pairs)))
    return wide.select(key, "period_end", "is_annual", normalize(raw).alias("embedding"))
