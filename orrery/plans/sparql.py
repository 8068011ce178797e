"""SPARQL over a table of triples (g, s, p, o), compiled to joins.

A term is one string in N-Triples form: ``<iri>``, ``"text"``, ``"text"@en``, ``"1"^^<type>`` or ``_:b``. A solution sequence is
a DataFrame with a column a variable; joins compare whole terms. Filters see values: a comparison is numeric if both
sides are numbers, else by text; an error or an unbound variable makes a filter false.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import cut
from ..sources import readers
from .tokens import Stream

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
_TOKENS = r"""
 (?P<skip>\s+|\#[^\n]*) | <[^<>\s"{}|^`\\]*> | "(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+|\^\^(?:<[^>]*>|[\w-]*:[\w-]*))? | '(?:[^'\\]|\\.)*'(?:@[A-Za-z-]+|\^\^(?:<[^>]*>|[\w-]*:[\w-]*))?
 | [?$]\w+ | _:\w+ | \d+\.\d+ | \d+ | [A-Za-z_][\w-]*:[\w.-]*\w | [A-Za-z_][\w-]*: | :[\w-]* | [A-Za-z_]\w* | && | \|\| | != | <= | >= | \^ | [{}()\[\].;,*+/?|!=<>-]
"""


# --- terms --------------------------------------------------------------------------------------------------------


def lexical(t: Column) -> Column:
    """The text of a literal, or the IRI without its brackets."""
    lit = F.regexp_extract(t, r'(?s)^"(.*)"(?:@[A-Za-z-]+|\^\^<[^>]*>)?$', 1)
    return F.when(F.startswith(t, F.lit('"')), lit).when(F.startswith(t, F.lit("<")), F.regexp_extract(t, "^<(.*)>$", 1)).otherwise(t)


def number(t: Column) -> Column:
    return F.when(F.startswith(t, F.lit('"')), lexical(t).try_cast("double"))


def is_iri(t: Column) -> Column:
    return F.startswith(t, F.lit("<"))


def is_blank(t: Column) -> Column:
    return F.startswith(t, F.lit("_:"))


def is_literal(t: Column) -> Column:
    return F.startswith(t, F.lit('"'))


def lang(t: Column) -> Column:
    return F.regexp_extract(t, r'"@([A-Za-z-]+)$', 1)


def datatype(t: Column) -> Column:
    d = F.regexp_extract(t, r'"\^\^<([^>]*)>$', 1)
    return F.when(d != "", d).when(lang(t) != "", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString").when(is_literal(t), XSD + "string")


def plain(v: Column) -> Column:
    return F.concat(F.lit('"'), v, F.lit('"'))


def typed(v: Column, kind: str) -> Column:
    return F.concat(F.lit('"'), v.cast("string"), F.lit(f'"^^<{XSD}{kind}>'))


# --- values: a Python wrapper that knows what kind of Column it holds ----------------------------------------------


class Val:
    def __init__(self, kind: str, col: Column):
        self.kind, self.col = kind, col  # term, str, num, bool

    def text(self) -> Column:
        return {"term": lambda: lexical(self.col), "str": lambda: self.col, "num": lambda: _show(self.col), "bool": lambda: self.col.cast("string")}[self.kind]()

    def num(self) -> Column:
        return {"term": lambda: number(self.col), "str": lambda: self.col.try_cast("double"), "num": lambda: self.col, "bool": lambda: self.col.cast("double")}[self.kind]()

    def truth(self) -> Column:
        if self.kind == "bool":
            return self.col
        if self.kind == "num":
            return self.col != 0
        t = self.text()
        n = self.num()
        return F.when(self.col.isNull(), F.lit(None)).when(t == "true", True).when(t == "false", False).when(n.isNotNull(), n != 0).otherwise(F.length(t) > 0)

    def term(self) -> Column:
        return {
            "term": lambda: self.col,
            "str": lambda: plain(self.col),
            "bool": lambda: typed(self.col, "boolean"),
            "num": lambda: F.when(self.col == F.floor(self.col), typed(self.col.cast("bigint"), "integer")).otherwise(typed(self.col, "double")),
        }[self.kind]()


def _show(n: Column) -> Column:
    return F.when(n == F.floor(n), n.cast("bigint").cast("string")).otherwise(n.cast("string"))


def _compare(a: Val, op: str, b: Val) -> Val:
    f = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
    if "bool" in (a.kind, b.kind):
        return Val("bool", f(a.truth(), b.truth()))
    x, y = a.num(), b.num()
    other = f(a.term(), b.term()) if op in ("=", "!=") and a.kind == b.kind == "term" else f(a.text(), b.text())
    if "num" in (a.kind, b.kind):
        return Val("bool", f(x, y))
    return Val("bool", F.when(x.isNotNull() & y.isNotNull(), f(x, y)).otherwise(other))


AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}


class Engine:
    """Queries and updates over ``triples``, a DataFrame (g, s, p, o); ``g`` is null for the default graph."""

    def __init__(self, triples: DataFrame, prefixes: dict[str, str] | None = None):
        self.triples, self.prefixes = triples, dict(prefixes or {})
        self.spark = triples.sparkSession
        self.fresh = 0

    # --- entry ----------------------------------------------------------------------------------------------------

    def query(self, text: str) -> DataFrame:
        """SELECT: a column a variable. ASK: one row ``ask``. CONSTRUCT and DESCRIBE: triples (s, p, o)."""
        self.t = Stream(text, _TOKENS)
        self._prologue()
        if self.t.word() == "SELECT":
            return self._select()
        if self.t.take("ASK"):
            self.t.take("WHERE")
            return self._group().limit(1).agg((F.count("*") > 0).alias("ask"))
        if self.t.take("CONSTRUCT"):
            template = self._template()
            self.t.take("WHERE")
            return self._instantiate(template, self._modifiers(self._group()))
        if self.t.take("DESCRIBE"):
            what = []
            while self.t.peek()[:1] in ("<", "?") or ":" in self.t.peek():
                what.append(self._term())
            if self.t.take("WHERE") or self.t.peek() == "{":
                rows = self._group()
                ids = reduce(DataFrame.unionByName, [rows.select(F.col(w[1:]).alias("s")) if w[0] == "?" else rows.limit(1).select(F.lit(w).alias("s")) for w in what])
            else:
                ids = self.spark.createDataFrame([(w,) for w in what], "s string")
            return self.triples.join(ids.distinct(), "s", "left_semi").select("s", "p", "o").distinct()
        raise SyntaxError(f"unknown query: {self.t.peek()!r}")

    def update(self, text: str) -> Engine:
        """An engine over the changed triples."""
        self.t = Stream(text, _TOKENS)
        out = self
        while not self.t.over():
            self._prologue()
            out = out._one_update(self)
            self.t.take(";")
        return out

    def _one_update(self, reader: Engine) -> Engine:
        t = reader.t
        graph_of = lambda: None if t.take("DEFAULT") else (t.take("GRAPH"), reader._term())[1]
        at = lambda g: F.col("g").isNull() if g is None else F.col("g") == g
        if t.take("INSERT", "DATA"):
            rows = self._instantiate_data(reader._template())
            return Engine(self.triples.unionByName(rows).distinct(), reader.prefixes)
        if t.take("DELETE", "DATA"):
            return Engine(self._minus(self._instantiate_data(reader._template())), reader.prefixes)
        if t.take("CLEAR") or t.take("DROP"):
            t.take("SILENT")
            if t.take("ALL"):
                return Engine(self.triples.limit(0), reader.prefixes)
            if t.take("NAMED"):
                return Engine(self.triples.where(F.col("g").isNull()), reader.prefixes)
            return Engine(self.triples.where(~F.coalesce(at(graph_of()), F.lit(False))), reader.prefixes)
        if t.take("LOAD"):
            silent = t.take("SILENT")
            path = reader._term()[1:-1]
            graph = (t.expect("GRAPH"), reader._term())[1] if t.take("INTO") else None
            try:
                new = readers.read_ntriples(self.spark, path)
            except AnalysisException:  # no such file
                if silent:
                    return self
                raise
            new = new.withColumn("g", F.lit(graph)) if graph else new
            return Engine(self.triples.unionByName(new).distinct(), reader.prefixes)
        if t.take("CREATE"):
            graph_of()
            return self
        for verb in ("COPY", "MOVE", "ADD"):
            if t.take(verb):
                a = graph_of()
                t.expect("TO")
                b = graph_of()
                moved = self.triples.where(at(a)).withColumn("g", F.lit(b).cast("string"))
                keep = self.triples
                if verb != "ADD":
                    keep = keep.where(~F.coalesce(at(b), F.lit(False)))
                if verb == "MOVE":
                    keep = keep.where(~F.coalesce(at(a), F.lit(False)))
                return Engine(keep.unionByName(moved).distinct(), reader.prefixes)
        if t.word() in ("DELETE", "INSERT"):
            gone, new = [], []
            if t.take("DELETE"):
                gone = None if t.take("WHERE") else reader._template()
            if gone is None:
                start = t.i
                gone = reader._template()
                t.i = start
            else:
                if t.take("INSERT"):
                    new = reader._template()
                t.expect("WHERE")
            run = Engine(self.triples, reader.prefixes)
            run.t = t
            rows = run._group()
            out = self._minus(self._instantiate(gone, rows, graph=True)) if gone else self.triples
            if new:
                out = out.unionByName(self._instantiate(new, rows, graph=True)).distinct()
            return Engine(out, reader.prefixes)
        raise SyntaxError(f"unknown update: {t.peek()!r}")

    def _minus(self, rows: DataFrame) -> DataFrame:
        a, b = self.triples.alias("a"), rows.alias("b")
        same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("g", "s", "p", "o")])
        return a.join(b, same, "left_anti")

    # --- templates ------------------------------------------------------------------------------------------------

    def _template(self) -> list[tuple]:
        """[(g, s, p, o)] of a braced block without paths."""
        self.t.expect("{")
        out = []
        while not self.t.take("}"):
            if self.t.take("GRAPH"):
                g = self._term()
                out += [(g, *x[1:]) for x in self._template()]
            else:
                out += [(None, s, p, o) for s, p, o in self._triples()]
            self.t.take(".")
        return out

    def _instantiate(self, template: list[tuple], rows: DataFrame, graph: bool = False) -> DataFrame:
        value = lambda x: F.lit(None).cast("string") if x is None else F.col(x[1:]) if x[0] == "?" else F.lit(x[1] if isinstance(x, tuple) else x)
        parts = [rows.select(value(g).alias("g"), value(s).alias("s"), value(p).alias("p"), value(o).alias("o")) for g, s, p, o in template]
        out = reduce(DataFrame.unionByName, parts).where("s is not null and p is not null and o is not null").distinct()
        return out if graph else out.drop("g")

    def _instantiate_data(self, template: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(template, "g string, s string, p string, o string")

    # --- SELECT ---------------------------------------------------------------------------------------------------

    def _prologue(self) -> None:
        while True:
            if self.t.take("PREFIX"):
                name = self.t.next()
                self.prefixes[name.rstrip(":")] = self.t.next()[1:-1]
            elif self.t.take("BASE"):
                self.t.next()
            else:
                return

    def _select(self) -> DataFrame:
        t = self.t
        t.expect("SELECT")
        distinct = t.take("DISTINCT") or t.take("REDUCED")
        items: list[tuple[str, int | None]] = []
        star = t.take("*")
        while not star and (t.peek()[:1] in ("?", "$") or t.peek() == "("):
            if t.take("("):
                at = t.i
                self._skip_expr()
                t.expect("AS")
                items.append((t.next()[1:], at))
                t.expect(")")
            else:
                items.append((t.next()[1:], None))
        while t.take("FROM"):
            named = t.take("NAMED")
            g = self._term()
            if not named:
                return Engine(self.triples.where(F.col("g") == g).withColumn("g", F.lit(None).cast("string")), self.prefixes)._resume(t, items, star, distinct)
        return self._resume(t, items, star, distinct)

    def _resume(self, t, items, star, distinct) -> DataFrame:
        self.t = t
        t.take("WHERE")
        rows = self._group()
        keys: list[str] = []
        grouped = t.take("GROUP", "BY")
        while grouped and (t.peek()[:1] == "?" or t.peek() == "("):
            if t.take("("):
                v = self._expr(rows)
                name = self._name()
                if t.take("AS"):
                    name = t.next()[1:]
                t.expect(")")
                rows = rows.withColumn(name, v.term())
                keys.append(name)
            else:
                keys.append(t.next()[1:])
        having = None
        if t.take("HAVING"):
            having = t.i
            self._skip_expr()
        aggregated = grouped or any(at is not None and self._has_aggregate(at) for _, at in items)
        if aggregated:
            self.aggs: list[tuple[str, str, Column]] = []
            out_exprs = []
            for name, at in items:
                out_exprs.append((name, self._at(at, rows) if at is not None else Val("term", F.col(name))))
            hv = self._at(having, rows) if having is not None else None
            aggs = [c.alias(n) for n, _, c in self.aggs] or [F.count("*").alias("_n")]
            g = rows.groupBy(*keys).agg(*aggs)
            g = g.where(hv.truth()) if hv is not None else g
            rows = g.select(*[v.term().alias(n) for n, v in out_exprs])
            del self.aggs
            rows = self._order(rows)
        else:
            for name, at in items:
                if at is not None:
                    rows = rows.withColumn(name, self._at(at, rows).term())
            rows = self._order(rows)
            names = [n for n, _ in items] if items else [c for c in rows.columns if not c.startswith("_")]
            rows = rows.select(*[F.col(n) if n in rows.columns else F.lit(None).cast("string").alias(n) for n in names])
        rows = rows.distinct() if distinct else rows
        return self._slice(rows)

    def _modifiers(self, rows: DataFrame) -> DataFrame:
        return self._slice(self._order(rows))

    def _order(self, rows: DataFrame) -> DataFrame:
        t = self.t
        if not t.take("ORDER", "BY"):
            return rows
        keys = []
        while t.word() in ("ASC", "DESC") or t.peek()[:1] == "?" or t.peek() == "(":
            down = t.take("DESC") if t.word() == "DESC" else (t.take("ASC"), False)[1]
            v = self._expr_primary(rows)
            n, s = v.num(), v.text()
            keys += [n.desc_nulls_last(), s.desc()] if down else [n.asc_nulls_last(), s.asc()]
        return rows.orderBy(*keys)

    def _slice(self, rows: DataFrame) -> DataFrame:
        limit = offset = None
        while self.t.word() in ("LIMIT", "OFFSET"):
            if self.t.take("LIMIT"):
                limit = int(self.t.next())
            elif self.t.take("OFFSET"):
                offset = int(self.t.next())
        rows = rows.offset(offset) if offset else rows
        return rows.limit(limit) if limit is not None else rows

    # --- groups ---------------------------------------------------------------------------------------------------

    def _unit(self) -> DataFrame:
        return self.spark.range(1).select()

    def _name(self) -> str:
        self.fresh += 1
        return f"_v{self.fresh}"

    def _group(self, graph: str | None = None) -> DataFrame:
        t = self.t
        t.expect("{")
        if t.word() == "SELECT":
            rows = self._select()
            t.expect("}")
            return rows
        rows: DataFrame | None = None
        filters: list[int] = []
        while not t.take("}"):
            if t.take("FILTER"):
                filters.append(t.i)
                self._skip_filter()
            elif t.take("OPTIONAL"):
                left = rows if rows is not None else self._unit()
                rows = self._optional(left, graph)
            elif t.take("MINUS"):
                right = self._group(graph)
                rows = self._subtract(rows, right)
            elif t.take("BIND"):
                t.expect("(")
                base = rows if rows is not None else self._unit()
                v = self._expr(base)
                t.expect("AS")
                rows = base.withColumn(t.next()[1:], v.term())
                t.expect(")")
            elif t.take("VALUES"):
                rows = self._join(rows, self._values())
            elif t.take("GRAPH"):
                g = self._term()
                rows = self._join(rows, self._group(g))
            elif t.peek() == "{":
                part = self._group(graph)
                while t.take("UNION"):
                    part = part.unionByName(self._group(graph), allowMissingColumns=True)
                rows = self._join(rows, part)
            else:
                for s, p, o in self._triples():
                    rows = self._join(rows, self._pattern(s, p, o, graph))
            t.take(".")
        rows = rows if rows is not None else self._unit()
        end = t.i
        for at in filters:
            t.i = at
            rows = self._filter(rows, graph)
        t.i = end
        return rows

    def _join(self, a: DataFrame | None, b: DataFrame) -> DataFrame:
        if a is None or not a.columns:
            return b
        shared = [c for c in a.columns if c in b.columns]
        return a.join(b, shared) if shared else a.crossJoin(b)

    def _optional(self, left: DataFrame, graph) -> DataFrame:
        """A left join; filters inside the group see both sides."""
        t = self.t
        start = t.i
        self._skip_group()
        end = t.i
        t.i = start
        filters = self._own_filters(start, end)
        t.i = start
        right = self._group_without_filters(graph)
        t.i = end
        shared = [c for c in left.columns if c in right.columns]
        r = right.select(*[F.col(c).alias(f"_r_{c}") for c in right.columns])
        cond = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"_r_{c}") for c in shared], F.lit(True))
        if filters:
            both = [c for c in right.columns if c not in left.columns]
            # Numbered once, in a stored table: both sides of the join below must see the same numbers.
            key = cut(left.withColumn("_row", F.monotonically_increasing_id()))
            hit = key.join(r, cond).select(*left.columns, "_row", *[F.col(f"_r_{c}").alias(c) for c in both])
            for at in filters:
                t.i = at
                hit = self._filter(hit, graph)
            t.i = end
            miss = key.join(hit.select("_row").distinct(), "_row", "left_anti").select(*left.columns)
            return hit.select(*left.columns, *both).unionByName(miss, allowMissingColumns=True)
        j = left.join(r, cond, "left")
        return j.select(*left.columns, *[F.col(f"_r_{c}").alias(c) for c in right.columns if c not in left.columns])

    def _group_without_filters(self, graph) -> DataFrame:
        """As _group, leaving out the group's own filters."""
        start = self.t.i
        self._skip_group()
        end = self.t.i
        drop: list[tuple[int, int]] = []
        for at in self._own_filters(start, end):
            self.t.i = at
            self._skip_filter()
            drop.append((at - 1, self.t.i))
        saved = self.t.items
        items = list(saved)
        for a, b in reversed(drop):
            del items[a:b]
        cutlen = sum(b - a for a, b in drop)
        self.t.items, self.t.i = items, start
        out = self._group(graph)
        self.t.items, self.t.i = saved, self.t.i + cutlen
        return out

    def _own_filters(self, start: int, end: int) -> list[int]:
        depth, out = 0, []
        for i in range(start, end):
            x = self.t.items[i]
            depth += (x == "{") - (x == "}")
            if depth == 1 and x.upper() == "FILTER":
                out.append(i + 1)
        return out

    def _subtract(self, left: DataFrame, right: DataFrame) -> DataFrame:
        shared = [c for c in left.columns if c in right.columns]
        if not shared:
            return left
        # Rows with equal sets of bound variables meet in an equi-join over those that both sides have bound, so there is
        # one anti-join for each pair of such sets, of which few occur.
        bound = lambda df: [[c for c in shared if r[c]] for r in df.select(*[F.col(c).isNotNull().alias(c) for c in shared]).distinct().collect()]
        only = lambda df, names: df.where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() if c in names else F.col(c).isNull() for c in shared]))
        right = right.select(*shared).distinct()
        removed = [(names, only(right, names)) for names in bound(right)]
        parts = []
        for mine in bound(left):
            part = only(left, mine)
            for its, rows in removed:
                if on := [c for c in mine if c in its]:
                    part = part.join(rows.select(*on).distinct(), on, "left_anti").select(*left.columns)
            parts.append(part)
        return reduce(DataFrame.unionByName, parts) if parts else left

    def _values(self) -> DataFrame:
        t = self.t
        many = t.take("(")
        names = []
        while t.peek()[:1] == "?":
            names.append(t.next()[1:])
        if many:
            t.expect(")")
        t.expect("{")
        rows = []
        cell = lambda: None if t.take("UNDEF") else self._term()
        while not t.take("}"):
            if many:
                t.expect("(")
                row = []
                while not t.take(")"):
                    row.append(cell())
                rows.append(tuple(row))
            else:
                rows.append((cell(),))
        return self.spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))

    def _filter(self, rows: DataFrame, graph) -> DataFrame:
        t = self.t
        negated = t.take("NOT")
        if t.take("EXISTS"):
            inner = self._group(graph)
            shared = [c for c in rows.columns if c in inner.columns]
            if not shared:
                return rows if (inner.limit(1).count() > 0) != negated else rows.limit(0)
            return rows.join(inner.select(*shared).distinct(), shared, "left_anti" if negated else "left_semi")
        return rows.where(F.coalesce(self._expr_primary(rows).truth(), F.lit(False)))

    # --- triples and paths ----------------------------------------------------------------------------------------

    def _term(self) -> str:
        x = self.t.next()
        if x == "a":
            return RDF_TYPE
        if x[0] in "?$":
            return "?" + x[1:]
        if x[0] == "<" or x.startswith("_:"):
            return x
        if x[0] in "\"'":
            body, _, rest = x[1:].rpartition(x[0])
            if rest.startswith("^^") and not rest.startswith("^^<"):
                rest = "^^" + self._iri(rest[2:])
            return f'"{body}"{rest}'
        if x[0].isdigit():
            return f'"{x}"^^<{XSD}{"decimal" if "." in x else "integer"}>'
        if x in ("true", "false"):
            return f'"{x}"^^<{XSD}boolean>'
        if ":" in x:
            return self._iri(x)
        raise SyntaxError(f"not a term: {x!r}")

    def _iri(self, x: str) -> str:
        if x.startswith("<"):
            return x
        p, _, n = x.partition(":")
        return f"<{self.prefixes[p]}{n}>"

    def _triples(self) -> list[tuple]:
        s = self._term()
        out = []
        while True:
            p = self._path()
            while True:
                out.append((s, p, self._term()))
                if not self.t.take(","):
                    break
            if not self.t.take(";"):
                return out
            if self.t.peek() in (".", "}"):
                return out

    def _path(self):
        parts = [self._path_seq()]
        while self.t.take("|"):
            parts.append(self._path_seq())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def _path_seq(self):
        parts = [self._path_step()]
        while self.t.take("/"):
            parts.append(self._path_step())
        return parts[0] if len(parts) == 1 else ("seq", parts)

    def _path_step(self):
        if self.t.take("^"):
            return ("inv", self._path_step())
        if self.t.take("!"):
            many = self.t.take("(")
            names = [self._term()]
            while many and self.t.take("|"):
                names.append(self._term())
            if many:
                self.t.expect(")")
            p = ("not", names)
        elif self.t.take("("):
            p = self._path()
            self.t.expect(")")
        else:
            p = self._term()
        if self.t.peek() in ("*", "+", "?") and not (self.t.peek() == "?" and len(self.t.peek()) > 1):
            p = (self.t.next(), p)
        return p

    def _edges(self, path, graph) -> DataFrame:
        """(_s, _o) pairs that a path connects."""
        base = self.triples
        if graph is not None and graph[0] != "?":
            base = base.where(F.col("g") == graph)
        if isinstance(path, str):
            return base.where(F.col("p") == path).select(F.col("s").alias("_s"), F.col("o").alias("_o"))
        kind, arg = path
        if kind == "inv":
            return self._edges(arg, graph).select(F.col("_o").alias("_s"), F.col("_s").alias("_o"))
        if kind == "not":
            return base.where(~F.col("p").isin(*arg)).select(F.col("s").alias("_s"), F.col("o").alias("_o"))
        if kind == "alt":
            return reduce(DataFrame.unionByName, [self._edges(x, graph) for x in arg])
        if kind == "seq":
            out = self._edges(arg[0], graph)
            for x in arg[1:]:
                r = self._edges(x, graph).select(F.col("_s").alias("_m"), F.col("_o").alias("_e"))
                out = out.join(r, F.col("_o") == F.col("_m")).select("_s", F.col("_e").alias("_o"))
            return out
        step = self._edges(arg, graph).distinct()
        nodes = base.select(F.col("s").alias("_s")).unionByName(base.select(F.col("o").alias("_s"))).distinct()
        same = nodes.select("_s", F.col("_s").alias("_o"))
        if kind == "?":
            return step.unionByName(same).distinct()
        closed = self._closure(step)
        return closed.unionByName(same).distinct() if kind == "*" else closed

    def _closure(self, step: DataFrame) -> DataFrame:
        """Pairs connected by one or more steps; each round doubles the reach and is checkpointed."""
        from ..operators.graph import cut

        out, n = cut(step), -1
        while (m := out.count()) != n:
            n = m
            r = out.select(F.col("_s").alias("_m"), F.col("_o").alias("_e"))
            out = cut(out.unionByName(out.join(r, F.col("_o") == F.col("_m")).select("_s", F.col("_e").alias("_o"))).distinct())
        return out

    def _pattern(self, s: str, p, o: str, graph) -> DataFrame:
        if isinstance(p, str):
            rows = self.triples
            named = [("s", s), ("p", p), ("o", o)]
            if graph is not None:
                named.append(("g", graph))
        else:
            rows = self._edges(p, graph)
            named = [("_s", s), ("_o", o)]
        used: dict[str, str] = {}
        for c, x in named:
            if x[0] == "?" or x.startswith("_:"):
                v = x[1:] if x[0] == "?" else "_b" + x[2:]
                if v in used:
                    rows = rows.where(F.col(c) == F.col(used[v]))
                else:
                    used[v] = c
                    if c == "g":
                        rows = rows.where("g is not null")
            else:
                rows = rows.where(F.col(c) == F.lit(x))
        return rows.select(*[F.col(c).alias(v) for v, c in used.items()]) if used else rows.limit(1).select()

    # --- expressions ----------------------------------------------------------------------------------------------

    def _at(self, at: int, rows: DataFrame) -> Val:
        end, self.t.i = self.t.i, at
        v = self._expr(rows)
        self.t.i = end
        return v

    def _skip_expr(self) -> None:
        depth = 0
        while True:
            x = self.t.peek()
            if depth == 0 and (x in ("", ")", "}") or x.upper() in ("AS", "ORDER", "LIMIT", "OFFSET")):
                return
            depth += (x in "({") - (x in ")}") if x else 0
            self.t.next()

    def _skip_filter(self) -> None:
        self.t.take("NOT")
        if self.t.take("EXISTS"):
            self._skip_group()
            return
        if self.t.peek() != "(":
            self.t.next()
        self._skip_balanced("(", ")")

    def _skip_group(self) -> None:
        self._skip_balanced("{", "}")

    def _skip_balanced(self, a: str, b: str) -> None:
        depth = 0
        while True:
            x = self.t.next()
            depth += (x == a) - (x == b)
            if depth == 0:
                return

    def _has_aggregate(self, at: int) -> bool:
        depth = 0
        for x in self.t.items[at:]:
            depth += (x == "(") - (x == ")")
            if depth < 0:
                return False
            if x.upper() in AGGREGATES:
                return True
        return False

    def _expr(self, rows: DataFrame) -> Val:
        v = self._expr_and(rows)
        while self.t.take("||"):
            v = Val("bool", v.truth() | self._expr_and(rows).truth())
        return v

    def _expr_and(self, rows: DataFrame) -> Val:
        v = self._expr_cmp(rows)
        while self.t.take("&&"):
            v = Val("bool", v.truth() & self._expr_cmp(rows).truth())
        return v

    def _expr_cmp(self, rows: DataFrame) -> Val:
        v = self._expr_add(rows)
        op = self.t.peek()
        if op in ("=", "!=", "<", ">", "<=", ">="):
            self.t.next()
            return _compare(v, op, self._expr_add(rows))
        negated = self.t.word() == "NOT" and self.t.word(1) == "IN"
        if negated:
            self.t.next()
        if self.t.take("IN"):
            self.t.expect("(")
            found = F.lit(False)
            while not self.t.take(")"):
                found = found | _compare(v, "=", self._expr(rows)).col
                self.t.take(",")
            return Val("bool", ~found if negated else found)
        return v

    def _expr_add(self, rows: DataFrame) -> Val:
        v = self._expr_mul(rows)
        while self.t.peek() in ("+", "-"):
            op = self.t.next()
            w = self._expr_mul(rows)
            v = Val("num", v.num() + w.num() if op == "+" else v.num() - w.num())
        return v

    def _expr_mul(self, rows: DataFrame) -> Val:
        v = self._expr_unary(rows)
        while self.t.peek() in ("*", "/"):
            op = self.t.next()
            w = self._expr_unary(rows)
            v = Val("num", v.num() * w.num() if op == "*" else F.try_divide(v.num(), w.num()))
        return v

    def _expr_unary(self, rows: DataFrame) -> Val:
        if self.t.take("!"):
            return Val("bool", ~self._expr_unary(rows).truth())
        if self.t.take("-"):
            return Val("num", -self._expr_unary(rows).num())
        return self._expr_primary(rows)

    def _expr_primary(self, rows: DataFrame) -> Val:
        t = self.t
        if t.take("("):
            v = self._expr(rows)
            t.expect(")")
            return v
        x = t.peek()
        if x[:1] in ("?", "$"):
            t.next()
            return Val("term", F.col(x[1:]) if x[1:] in rows.columns else F.lit(None).cast("string"))
        if x[:1].isdigit():
            t.next()
            return Val("num", F.lit(float(x)))
        if x in ("true", "false"):
            t.next()
            return Val("bool", F.lit(x == "true"))
        if t.peek(1) == "(" and x[:1].isalpha() and ":" not in x:
            return self._call(t.next().upper(), rows)
        return Val("term", F.lit(self._term()))

    def _call(self, name: str, rows: DataFrame) -> Val:
        t = self.t
        t.expect("(")
        if name in AGGREGATES:
            return self._aggregate(name, rows)
        args: list[Val] = []
        while not t.take(")"):
            args.append(self._expr(rows))
            t.take(",")
        a = args[0] if args else None
        s = lambda i=0: args[i].text()
        n = lambda i=0: args[i].num()
        moment = lambda: F.to_timestamp(s())
        calls = {
            "BOUND": lambda: Val("bool", a.col.isNotNull()), "STR": lambda: Val("str", s()), "LANG": lambda: Val("str", lang(a.term())), "DATATYPE": lambda: Val("term", F.concat(F.lit("<"), datatype(a.term()), F.lit(">"))),
            "IRI": lambda: Val("term", F.concat(F.lit("<"), s(), F.lit(">"))), "URI": lambda: Val("term", F.concat(F.lit("<"), s(), F.lit(">"))), "BNODE": lambda: Val("term", F.concat(F.lit("_:"), s())),
            "STRDT": lambda: Val("term", F.concat(plain(s()), F.lit("^^"), args[1].term())), "STRLANG": lambda: Val("term", F.concat(plain(s()), F.lit("@"), s(1))),
            "ISIRI": lambda: Val("bool", is_iri(a.term())), "ISURI": lambda: Val("bool", is_iri(a.term())), "ISBLANK": lambda: Val("bool", is_blank(a.term())), "ISLITERAL": lambda: Val("bool", is_literal(a.term())), "ISNUMERIC": lambda: Val("bool", n().isNotNull()),
            "STRLEN": lambda: Val("num", F.length(s()).cast("double")), "UCASE": lambda: Val("str", F.upper(s())), "LCASE": lambda: Val("str", F.lower(s())),
            "SUBSTR": lambda: Val("str", s().substr(n(1).cast("int"), n(2).cast("int") if len(args) > 2 else F.length(s()))),
            "STRSTARTS": lambda: Val("bool", F.startswith(s(), s(1))), "STRENDS": lambda: Val("bool", F.endswith(s(), s(1))), "CONTAINS": lambda: Val("bool", F.contains(s(), s(1))),
            "STRBEFORE": lambda: Val("str", F.when(F.position(s(1), s()) > 0, s().substr(F.lit(1), F.position(s(1), s()) - 1)).otherwise("")),
            "STRAFTER": lambda: Val("str", F.when(F.position(s(1), s()) > 0, s().substr(F.position(s(1), s()) + F.length(s(1)), F.length(s()))).otherwise("")),
            "CONCAT": lambda: Val("str", F.concat(*[x.text() for x in args])), "REPLACE": lambda: Val("str", F.regexp_replace(s(), s(1), s(2))), "ENCODE_FOR_URI": lambda: Val("str", F.regexp_replace(F.url_encode(s()), r"\+", "%20")),
            "REGEX": lambda: Val("bool", F.rlike(s(), F.concat(F.when(F.contains(s(2), F.lit("i")), F.lit("(?i)")).otherwise(F.lit("")), s(1)) if len(args) > 2 else s(1))),
            "ABS": lambda: Val("num", F.abs(n())), "ROUND": lambda: Val("num", F.floor(n() + 0.5).cast("double")), "CEIL": lambda: Val("num", F.ceil(n()).cast("double")), "FLOOR": lambda: Val("num", F.floor(n()).cast("double")), "RAND": lambda: Val("num", F.rand()),
            "NOW": lambda: Val("term", typed(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), "dateTime")),
            "YEAR": lambda: Val("num", F.year(moment()).cast("double")), "MONTH": lambda: Val("num", F.month(moment()).cast("double")), "DAY": lambda: Val("num", F.day(moment()).cast("double")),
            "HOURS": lambda: Val("num", F.hour(moment()).cast("double")), "MINUTES": lambda: Val("num", F.minute(moment()).cast("double")), "SECONDS": lambda: Val("num", F.second(moment()).cast("double")),
            "MD5": lambda: Val("str", F.md5(s().cast("binary"))), "SHA1": lambda: Val("str", F.sha1(s().cast("binary"))), "SHA256": lambda: Val("str", F.sha2(s().cast("binary"), 256)), "SHA512": lambda: Val("str", F.sha2(s().cast("binary"), 512)),
            "IF": lambda: Val("term", F.when(a.truth(), args[1].term()).otherwise(args[2].term())), "COALESCE": lambda: Val("term", F.coalesce(*[x.term() for x in args])),
        }
        if name not in calls:
            raise SyntaxError(f"unknown function: {name}")
        return calls[name]()

    def _aggregate(self, name: str, rows: DataFrame) -> Val:
        t = self.t
        distinct = t.take("DISTINCT")
        v = None if t.take("*") else self._expr(rows)
        sep = " "
        if t.take(";"):
            t.expect("SEPARATOR", "=")
            sep = t.next()[1:-1]
        t.expect(")")
        col = self._name()
        n = v.num() if v else None
        if name == "COUNT":
            c = F.count("*") if v is None else F.count_distinct(v.term()) if distinct else F.count(v.term())
            kind, c = "num", c.cast("double")
        elif name in ("SUM", "AVG"):
            kind, c = "num", (F.sum_distinct(n) if distinct else F.sum(n)) if name == "SUM" else F.avg(n)
        elif name in ("MIN", "MAX"):
            best = F.struct(n.isNull().alias("x"), n.alias("n"), v.text().alias("s"), v.term().alias("t"))
            kind, c = "term", (F.min(best) if name == "MIN" else F.max(best))["t"]
        elif name == "SAMPLE":
            kind, c = "term", F.min(v.term())
        else:
            many = F.collect_set(v.text()) if distinct else F.collect_list(v.text())
            kind, c = "str", F.array_join(F.array_sort(many), sep)
        self.aggs.append((col, kind, c))
        return Val(kind, F.col(col))


def to_results(rows: DataFrame, form: str) -> DataFrame:
    """One text line a row: json, csv, tsv or xml."""
    names = rows.columns
    if form == "json":
        return rows.select(F.to_json(F.struct(*[F.when(F.col(c).isNotNull(), F.struct(F.when(is_iri(F.col(c)), "uri").when(is_blank(F.col(c)), "bnode").otherwise("literal").alias("type"), lexical(F.col(c)).alias("value"))).alias(c) for c in names])).alias("value"))
    if form == "xml":
        cell = lambda c: F.coalesce(F.concat(F.lit(f'<binding name="{c}">'), F.when(is_iri(F.col(c)), F.concat(F.lit("<uri>"), lexical(F.col(c)), F.lit("</uri>"))).otherwise(F.concat(F.lit("<literal>"), F.replace(F.replace(lexical(F.col(c)), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</literal>"))), F.lit("</binding>")), F.lit(""))
        return rows.select(F.concat(F.lit("<result>"), *[cell(c) for c in names], F.lit("</result>")).alias("value"))
    if form == "tsv":
        return rows.select(F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in names]).alias("value"))
    quoted = lambda c: F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return rows.select(F.concat_ws(",", *[F.coalesce(quoted(lexical(F.col(c))), F.lit("")) for c in names]).alias("value"))
