"""Cypher over a property graph, compiled to joins.

A bound node variable ``v`` is the columns ``v.id``, ``v.labels`` and ``v.props`` (dots as ``__`` in column names); a relationship adds
``id``, ``type``, ``src`` and ``dst``. Within one MATCH no relationship is used twice. Aggregates group by the other items of
the same RETURN or WITH. Property values are text in a map; comparisons with numbers are numeric.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import Graph, cut
from .tokens import Stream

_TOKENS = r"""
 (?P<skip>\s+|//[^\n]*) | "(?:[^"\\]|\\.)*" | '(?:[^'\\]|\\.)*' | \d+\.\d+ | \d+ | \.\. | <= | >= | <> | =~ | \+= | -> | <- | [A-Za-z_]\w* | `[^`]+` | \$\w+ | [-+*/%^()\[\]{}:,.|=<>;]
"""
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "COLLECT", "STDEV", "STDEVP", "PERCENTILE", "PERCENTILECONT"}
CLAUSES = {"MATCH", "OPTIONAL", "WHERE", "RETURN", "WITH", "ORDER", "SKIP", "LIMIT", "UNWIND", "CREATE", "MERGE", "SET", "REMOVE", "DELETE", "DETACH", "UNION", "ON", ""}


class Val:
    """A Column with what Cypher knows of it: ``prop`` (text, maybe a number), num, str, bool, list, node, rel or path."""

    def __init__(self, kind: str, col: Column, name: str = "", agg: bool = False):
        self.kind, self.col, self.name, self.agg = kind, col, name, agg

    def num(self) -> Column:
        return self.col.try_cast("double") if self.kind in ("prop", "str") else self.col

    def text(self) -> Column:
        return self.col if self.kind in ("prop", "str") else self.col.cast("string")


def _arith(op: str, a: Val, b: Val) -> Val:
    agg = a.agg or b.agg
    if op == "+" and ("str" in (a.kind, b.kind)):
        return Val("str", F.concat(a.text(), b.text()), agg=agg)
    if op == "+" and "list" in (a.kind, b.kind):
        return Val("list", F.concat(a.col, b.col), agg=agg)
    whole = a.kind == b.kind == "int"
    x, y = (a.col, b.col) if whole else (a.num(), b.num())
    out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y), "%": lambda: F.try_mod(x, y), "^": lambda: F.pow(x, y)}[op]()
    if op == "/" and whole:
        out = F.try_divide(x - F.try_mod(x, y), y).cast("bigint")
    return Val("int" if whole and op != "^" else "num", out, agg=agg)


def _compare(op: str, a: Val, b: Val) -> Column:
    f = {"=": lambda x, y: x == y, "<>": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
    if "num" in (a.kind, b.kind) or "int" in (a.kind, b.kind):
        return f(a.num(), b.num())
    if a.kind == b.kind == "prop":
        return F.when(a.num().isNotNull() & b.num().isNotNull(), f(a.num(), b.num())).otherwise(f(a.col, b.col))
    if a.kind == "prop" and b.kind == "bool":
        return f(a.col.try_cast("boolean"), b.col)
    return f(a.col, b.col)


class Engine:
    """Runs queries over a graph. Mutating clauses give the changed graph in ``graph``.

    ``*`` and ``*2..`` go on until no walk does, or up to ``max_hops`` if given: walks use no edge twice.
    """

    def __init__(self, graph: Graph, params: dict | None = None, max_hops: int | None = None):
        self.graph, self.params, self.max_hops = graph, params or {}, max_hops
        self.spark = graph.nodes.sparkSession

    def query(self, text: str) -> DataFrame | None:
        """The rows of RETURN; None for a query that only changes the graph."""
        self.t = Stream(text, _TOKENS)
        self.rows: DataFrame | None = None
        self.kinds: dict[str, str] = {}
        out = self._single()
        while self.t.take("UNION"):
            all_ = self.t.take("ALL")
            self.rows, self.kinds = None, {}
            out = out.unionByName(self._single())
            out = out if all_ else out.distinct()
        return out

    def _single(self) -> DataFrame | None:
        t = self.t
        self.fresh = 0
        while not t.over() and t.word() != "UNION":
            if t.take(";"):
                continue
            if t.take("OPTIONAL", "MATCH"):
                self._match(optional=True)
            elif t.take("MATCH"):
                self._match()
            elif t.take("UNWIND"):
                v = self._expr()
                t.expect("AS")
                name = t.next()
                self.rows = self._base().withColumn(name, F.explode(v.col))
                self.kinds[name] = "prop" if v.name == "strings" else "num"
            elif t.take("WITH"):
                self._project(final=False)
            elif t.take("RETURN"):
                return self._project(final=True)
            elif t.take("CREATE"):
                self._create()
            elif t.take("MERGE"):
                self._merge()
            elif t.take("SET"):
                self._set()
            elif t.take("REMOVE"):
                self._remove()
            elif t.word() in ("DELETE", "DETACH"):
                self._delete()
            else:
                raise SyntaxError(f"unknown clause: {t.peek()!r}")
        return None

    def _base(self) -> DataFrame:
        return self.rows if self.rows is not None else self.spark.range(1).select(F.lit(1).alias("_unit"))

    # --- patterns -------------------------------------------------------------------------------------------------

    def _anon(self) -> str:
        self.fresh += 1
        return f"_a{self.fresh}"

    def _node(self) -> tuple[str, list[str], dict[str, Val]]:
        t = self.t
        t.expect("(")
        name = t.next() if t.peek() not in (":", "{", ")") else self._anon()
        labels = []
        while t.take(":"):
            labels.append(t.next().strip("`"))
        props = self._props() if t.peek() == "{" else {}
        t.expect(")")
        return name, labels, props

    def _props(self) -> dict[str, Val]:
        t = self.t
        t.expect("{")
        out = {}
        while not t.take("}"):
            k = t.next()
            t.expect(":")
            out[k] = self._expr()
            t.take(",")
        return out

    def _rel(self):
        """(name, types, props, low, high, direction)."""
        t = self.t
        left = t.take("<-") or (t.take("-") and False)
        name, types, props, low, high = self._anon(), [], {}, 1, 1
        if t.take("["):
            if t.peek() not in (":", "*", "{", "]"):
                name = t.next()
            if t.take(":"):
                types.append(t.next().strip("`"))
                while t.take("|"):
                    t.take(":")
                    types.append(t.next().strip("`"))
            if t.take("*"):
                low, high = 1, self.max_hops
                if t.peek().isdigit():
                    low = high = int(t.next())
                if t.take(".."):
                    high = int(t.next()) if t.peek().isdigit() else self.max_hops
            if t.peek() == "{":
                props = self._props()
            t.expect("]")
        right = t.take("->")
        if not right:
            t.expect("-")
        return name, types, props, low, high, "in" if left else "out" if right else "both"

    def _pattern(self) -> list:
        """[node, rel, node, ...] with a path's name in front if it has one."""
        t = self.t
        path = None
        if t.peek(1) == "=" and t.peek().isidentifier():
            path = t.next()
            t.expect("=")
        items = [self._node()]
        while t.peek() in ("-", "<-"):
            items.append(self._rel())
            if isinstance(items[-1], tuple) and t.peek() == "(":
                items.append(self._node())
        return [path, items]

    def _node_rows(self, name: str, labels: list[str], props: dict[str, Val]) -> DataFrame:
        n = self.graph.by_label(*labels) if labels else self.graph.nodes
        for k, v in props.items():
            n = n.where(_compare("=", Val("prop", F.col("props")[k]), v))
        return n.select(F.col("id").alias(f"{name}__id"), F.col("labels").alias(f"{name}__labels"), F.col("props").alias(f"{name}__props"))

    def _join_node(self, rows: DataFrame | None, node) -> DataFrame:
        name, labels, props = node
        if name in self.kinds and rows is not None and f"{name}__id" in rows.columns:
            if labels:
                rows = rows.where(F.size(F.array_intersect(f"{name}__labels", F.array(*map(F.lit, labels)))) == len(labels))
            for k, v in props.items():
                rows = rows.where(_compare("=", Val("prop", F.col(f"{name}__props")[k]), v))
            return rows
        self.kinds[name] = "node"
        n = self._node_rows(name, labels, props)
        return n if rows is None else rows.crossJoin(n)

    def _walk(self, rows: DataFrame | None, pattern, used: list[str]) -> DataFrame:
        path, items = pattern
        rows = self._join_node(rows, items[0])
        at = items[0][0]
        ids = [F.col(f"{at}__id")]
        hops: list[Column] = []
        edges_cols: list[Column] = []
        for i in range(1, len(items), 2):
            name, types, props, low, high, direction = items[i]
            to = items[i + 1]
            known = to[0] in self.kinds and f"{to[0]}__id" in rows.columns
            if (low, high) == (1, 1):
                e = self.graph.edges if not types else self.graph.by_type(*types)
                has = "props" in e.columns
                e = e.select("id", "src", "dst", "type", *(["props"] if has else []), *(["weight"] if "weight" in e.columns else []))
                for k, v in props.items():
                    e = e.where(_compare("=", Val("prop", F.col("props")[k]) if has and k != "weight" else Val("num", F.col(k)), v))
                cols = [F.col(c).alias(f"{name}__{c}") for c in e.columns]
                out = e.select(F.col("src").alias("_from"), F.col("dst").alias("_to"), *cols)
                back = e.select(F.col("dst").alias("_from"), F.col("src").alias("_to"), *cols)
                s = {"out": lambda: out, "in": lambda: back, "both": lambda: out.unionByName(back.where("_from != _to"))}[direction]()
                self.kinds[name] = "rel"
                rows = rows.join(s, F.col(f"{at}__id") == F.col("_from"))
                for u in used:
                    rows = rows.where(F.col(f"{name}__id") != F.col(u))
                used.append(f"{name}__id")
                hops.append(F.lit(1))
                edges_cols.append(F.array(f"{name}__id"))
            else:
                w = self.graph.walks(rows.select(F.col(f"{at}__id").alias("id")).distinct(), low, high, direction, types or None)
                self.kinds[name] = "list"
                rows = rows.join(w.select(F.col("start").alias("_from"), F.col("end").alias("_to"), F.col("edges").alias(name), F.col("hops").alias(f"{name}__hops")), F.col(f"{at}__id") == F.col("_from"))
                hops.append(F.col(f"{name}__hops"))
                edges_cols.append(F.col(name))
            if known:
                rows = rows.where(F.col("_to") == F.col(f"{to[0]}__id")).drop("_from", "_to")
                rows = self._join_node(rows, to)
            else:
                n = self._node_rows(*to)
                self.kinds[to[0]] = "node"
                rows = rows.join(n, F.col("_to") == F.col(f"{to[0]}__id")).drop("_from", "_to")
            at = to[0]
            ids.append(F.col(f"{at}__id"))
        if path:
            self.kinds[path] = "path"
            total = reduce(lambda a, b: a + b, hops, F.lit(0))
            rows = rows.withColumn(path, F.struct(F.array(*ids).alias("nodes"), (F.concat(*edges_cols) if edges_cols else F.array().cast("array<string>")).alias("relationships"), total.alias("length")))
        return rows

    def _match(self, optional: bool = False) -> None:
        before, kinds = self.rows, dict(self.kinds)
        patterns = [self._pattern()]
        while self.t.take(","):
            patterns.append(self._pattern())
        start = self.t.i
        if optional and before is not None:
            # Numbered once, in a stored table: both sides of the join below must see the same numbers.
            key = cut(before.withColumn("_row", F.monotonically_increasing_id()))
            rows: DataFrame | None = key
        else:
            rows = before
        used: list[str] = []
        for p in patterns:
            rows = self._walk(rows, p, used)
        self.rows = rows
        if self.t.take("WHERE"):
            self.rows = self._where(self.rows)
        if optional and before is not None:
            new = [c for c in self.rows.columns if c not in before.columns and c != "_row"]
            hit = self.rows.select("_row", *new)
            self.rows = key.join(hit, "_row", "left").drop("_row")
        del kinds, start

    def _where(self, rows: DataFrame) -> DataFrame:
        """Filter by an expression; pattern predicates are semi or anti joins."""
        t = self.t
        while True:
            negated = t.word() == "NOT" and t.peek(1) == "(" and self._is_pattern(1)
            if negated or (t.peek() == "(" and self._is_pattern(0)):
                t.take("NOT")
                rows = self._exists(rows, negated)
            else:
                stop = t.i
                v = self._expr_or() if not self._and_pattern(stop) else self._expr_xor()
                rows = rows.where(F.coalesce(v.col, F.lit(False)))
            if not t.take("AND"):
                return rows

    def _is_pattern(self, ahead: int) -> bool:
        """Whether a parenthesis here starts a pattern: it closes before a dash and another pattern element."""
        depth, i = 0, ahead
        while self.t.peek(i):
            x = self.t.peek(i)
            depth += (x == "(") - (x == ")")
            if depth == 0:
                return self.t.peek(i + 1) in ("-", "<-") and self.t.peek(i + 2) in ("[", "-", "->", "(") or (self.t.peek(i + 1) == "-" and self.t.peek(i + 2) == "->")
            i += 1
        return False

    def _and_pattern(self, at: int) -> bool:
        """Whether a pattern predicate follows behind AND in this condition."""
        i, depth = 0, 0
        while (x := self.t.peek(i)) and x.upper() not in CLAUSES:
            depth += (x in "([{") - (x in ")]}")
            if depth == 0 and x.upper() == "AND":
                j = i + 1 + (self.t.word(i + 1) == "NOT")
                if self.t.peek(j) == "(" and self._is_pattern(j):
                    return True
            i += 1
        return False

    def _exists(self, rows: DataFrame, negated: bool) -> DataFrame:
        kinds = dict(self.kinds)
        pattern = self._pattern()
        names = [x[0] for x in pattern[1][::2] if x[0] in kinds]
        saved, self.kinds = self.kinds, {}
        inner = self._walk(None, pattern, [])
        self.kinds = saved
        keys = [f"{n}__id" for n in names]
        return rows.join(inner.select(*keys).distinct(), keys, "left_anti" if negated else "left_semi")

    # --- projection -----------------------------------------------------------------------------------------------

    def _project(self, final: bool) -> DataFrame:
        t = self.t
        distinct = t.take("DISTINCT")
        rows = self._base()
        self.rows = rows
        items: list[tuple[str, Val]] = []
        if t.take("*"):
            items = [(k, self._variable(k)) for k in self.kinds if not k.startswith("_")]
            t.take(",")
        while t.word() not in CLAUSES:
            start = t.i
            v = self._expr()
            name = t.next() if t.take("AS") else "".join(x if x.isalnum() or x in "._()*" else x for x in t.items[start : t.i]).replace(".", "_") if t.i - start > 1 else t.items[start]
            items.append((name.strip("`"), v))
            if not t.take(","):
                break
        cols: list[Column] = []
        kinds: dict[str, str] = {}
        for name, v in items:
            kinds[name] = v.kind
            if v.kind in ("node", "rel") and not final:
                cols += [F.col(f"{v.name}__{c}").alias(f"{name}__{c}") for c in ("id", "labels", "props", "src", "dst", "type", "weight") if f"{v.name}__{c}" in rows.columns]
            elif v.kind in ("node", "rel"):
                cols.append(F.col(f"{v.name}__id").alias(name))
            elif not v.agg:
                cols.append(v.col.alias(name))
        aggs = [v.col.alias(name) for name, v in items if v.agg]
        if aggs:
            keys = [c for c in cols]
            out = rows.groupBy(*keys).agg(*aggs) if keys else rows.agg(*aggs)
            if final:
                out = out.select(*[n for n, _ in items])
        else:
            out = rows.select(*cols, *([F.col(c).alias(f"_old_{c}") for c in rows.columns] if t.word() == "ORDER" and not distinct else []))
        out = out.distinct() if distinct else out
        hidden, self.rows, old_kinds = rows, out, self.kinds
        self.kinds = kinds | ({k: v for k, v in old_kinds.items() if k not in kinds} if t.word() == "ORDER" else {})
        if t.take("ORDER", "BY"):
            keys = []
            while True:
                v = self._expr()
                c = v.col
                k = [F.coalesce(v.num(), F.lit(None)), c] if v.kind == "prop" else [c]
                down = t.take("DESC") or t.take("DESCENDING")
                if not down:
                    t.take("ASC") or t.take("ASCENDING")
                keys += [x.desc() if down else x.asc() for x in k]
                if not t.take(","):
                    break
            out = out.orderBy(*keys)
        if t.take("SKIP"):
            out = out.offset(int(t.next()))
        if t.take("LIMIT"):
            out = out.limit(int(t.next()))
        out = out.select(*[F.col(f"`{c}`") for c in out.columns if not c.startswith("_old_")])
        self.rows, self.kinds = out, kinds
        if not final and t.take("WHERE"):
            self.rows = self._where(out)
        del hidden
        return self.rows

    # --- expressions ----------------------------------------------------------------------------------------------

    def _expr(self) -> Val:
        return self._expr_or()

    def _expr_or(self) -> Val:
        v = self._expr_xor()
        while True:
            if self.t.take("AND"):
                v = Val("bool", v.col & self._expr_xor().col, agg=v.agg)
            elif self.t.take("OR"):
                w = self._expr_or()
                v = Val("bool", v.col | w.col, agg=v.agg)
            else:
                return v

    def _expr_xor(self) -> Val:
        v = self._expr_not()
        while self.t.take("XOR"):
            w = self._expr_not()
            v = Val("bool", (v.col | w.col) & ~(v.col & w.col))
        return v

    def _expr_not(self) -> Val:
        if self.t.take("NOT"):
            return Val("bool", ~self._expr_not().col)
        return self._expr_cmp()

    def _expr_cmp(self) -> Val:
        t = self.t
        v = self._expr_add()
        while True:
            op = t.peek()
            if op in ("=", "<>", "<", ">", "<=", ">="):
                t.next()
                w = self._expr_add()
                v = Val("bool", _compare(op, v, w), agg=v.agg or w.agg)
            elif op == "=~":
                t.next()
                v = Val("bool", F.rlike(v.text(), F.concat(F.lit("^(?:"), self._expr_add().col, F.lit(")$"))))
            elif t.take("STARTS", "WITH"):
                v = Val("bool", F.startswith(v.text(), self._expr_add().col))
            elif t.take("ENDS", "WITH"):
                v = Val("bool", F.endswith(v.text(), self._expr_add().col))
            elif t.take("CONTAINS"):
                v = Val("bool", F.contains(v.text(), self._expr_add().col))
            elif t.take("IN"):
                w = self._expr_add()
                v = Val("bool", F.array_contains(w.col, v.num() if w.name == "numbers" else v.col))
            elif t.take("IS", "NOT", "NULL"):
                v = Val("bool", v.col.isNotNull())
            elif t.take("IS", "NULL"):
                v = Val("bool", v.col.isNull())
            else:
                return v

    def _expr_add(self) -> Val:
        v = self._expr_mul()
        while self.t.peek() in ("+", "-"):
            v = _arith(self.t.next(), v, self._expr_mul())
        return v

    def _expr_mul(self) -> Val:
        v = self._expr_pow()
        while self.t.peek() in ("*", "/", "%"):
            v = _arith(self.t.next(), v, self._expr_pow())
        return v

    def _expr_pow(self) -> Val:
        v = self._unary()
        while self.t.take("^"):
            v = _arith("^", v, self._unary())
        return v

    def _unary(self) -> Val:
        if self.t.take("-"):
            v = self._unary()
            return Val("int" if v.kind == "int" else "num", -v.num(), agg=v.agg)
        v = self._primary()
        while self.t.peek() in (".", "["):
            if self.t.take("."):
                v = self._property(v, self.t.next())
            else:
                self.t.expect("[")
                i = self._expr()
                self.t.expect("]")
                v = Val("num" if v.name == "numbers" else "prop", F.get(v.col, i.col.cast("int")))
        return v

    def _property(self, v: Val, key: str) -> Val:
        if v.kind == "node":
            return Val("prop", F.col(f"{v.name}__props")[key])
        if v.kind == "rel":
            if f"{v.name}__{key}" in self.rows.columns:
                return Val("num" if key == "weight" else "str", F.col(f"{v.name}__{key}"))
            return Val("prop", F.col(f"{v.name}__props")[key])
        return Val("prop", v.col[key])

    def _variable(self, name: str) -> Val:
        kind = self.kinds.get(name)
        if kind in ("node", "rel"):
            return Val(kind, F.col(f"{name}__id"), name)
        if kind is None:
            raise SyntaxError(f"unknown variable: {name}")
        return Val(kind, F.col(f"`{name}`"), name if kind == "path" else "")

    def _primary(self) -> Val:
        t = self.t
        if t.take("("):
            v = self._expr()
            t.expect(")")
            return v
        x = t.next()
        if x == "[":
            items = []
            while not t.take("]"):
                items.append(self._expr())
                t.take(",")
            numbers = all(i.kind in ("int", "num") for i in items)
            return Val("list", F.array(*[i.num() if numbers else i.col for i in items]), "numbers" if numbers else "strings")
        if x[0] in "\"'":
            return Val("str", F.lit(x[1:-1].replace("\\'", "'").replace('\\"', '"')))
        if x.isdigit():
            return Val("int", F.lit(int(x)).cast("bigint"))
        if x[0].isdigit():
            return Val("num", F.lit(float(x)))
        if x[0] == "$":
            p = self.params[x[1:]]
            return Val("bool" if isinstance(p, bool) else "int" if isinstance(p, int) else "num" if isinstance(p, float) else "str", F.lit(p))
        u = x.upper()
        if u in ("TRUE", "FALSE"):
            return Val("bool", F.lit(u == "TRUE"))
        if u == "NULL":
            return Val("prop", F.lit(None).cast("string"))
        if u == "CASE":
            return self._case()
        if t.peek() == "(":
            return self._call(u)
        return self._variable(x.strip("`"))

    def _case(self) -> Val:
        t = self.t
        subject = None if t.word() == "WHEN" else self._expr()
        out, kind = None, "prop"
        while t.take("WHEN"):
            c = self._expr()
            cond = _compare("=", subject, c) if subject else c.col
            t.expect("THEN")
            v = self._expr()
            kind = v.kind
            out = F.when(cond, v.col) if out is None else out.when(cond, v.col)
        if t.take("ELSE"):
            out = out.otherwise(self._expr().col)
        t.expect("END")
        return Val(kind, out)

    def _call(self, name: str) -> Val:
        t = self.t
        t.expect("(")
        if name in AGGREGATES:
            distinct = t.take("DISTINCT")
            if name == "COUNT" and t.take("*"):
                t.expect(")")
                return Val("int", F.count("*"), agg=True)
            v = self._expr()
            p = self._expr() if t.take(",") else None
            t.expect(")")
            c, n = v.col, v.num()
            out = {
                "COUNT": lambda: F.count_distinct(c) if distinct else F.count(c), "SUM": lambda: F.sum_distinct(n) if distinct else F.sum(n), "AVG": lambda: F.avg(n),
                "MIN": lambda: F.min(n) if v.kind in ("num", "int", "prop") else F.min(c), "MAX": lambda: F.max(n) if v.kind in ("num", "int", "prop") else F.max(c),
                "COLLECT": lambda: F.array_sort(F.collect_set(c) if distinct else F.collect_list(c)), "STDEV": lambda: F.stddev_samp(n), "STDEVP": lambda: F.stddev_pop(n),
                "PERCENTILE": lambda: F.percentile(n, p.col), "PERCENTILECONT": lambda: F.percentile(n, p.col),
            }[name]()
            return Val("int" if name == "COUNT" else "list" if name == "COLLECT" else "num", out, agg=True)
        if name == "EXISTS" and self.t.peek() == "(":
            raise SyntaxError("exists() takes a property; patterns are predicates of their own")
        args: list[Val] = []
        while not t.take(")"):
            args.append(self._expr())
            t.take(",")
        a = args[0] if args else None
        num = lambda f: Val("num", f(a.num()))
        string = lambda f: Val("str", f(a.text()))
        calls = {
            "ID": lambda: Val("prop", a.col), "LABELS": lambda: Val("list", F.col(f"{a.name}__labels"), "strings"), "TYPE": lambda: Val("str", F.col(f"{a.name}__type")), "KEYS": lambda: Val("list", F.array_sort(F.map_keys(F.col(f"{a.name}__props"))), "strings"),
            "PROPERTIES": lambda: Val("list", F.col(f"{a.name}__props")), "NODES": lambda: Val("list", a.col["nodes"], "strings"), "RELATIONSHIPS": lambda: Val("list", a.col["relationships"], "strings"),
            "LENGTH": lambda: Val("int", a.col["length"]) if a.kind == "path" else Val("int", F.length(a.text())), "SIZE": lambda: Val("int", F.size(a.col)) if a.kind == "list" else Val("int", F.length(a.text())),
            "HEAD": lambda: Val("prop", F.get(a.col, F.lit(0))), "LAST": lambda: Val("prop", F.get(a.col, F.size(a.col) - 1)), "TAIL": lambda: Val("list", F.slice(a.col, F.lit(2), F.greatest(F.size(a.col) - 1, F.lit(0))), a.name),
            "RANGE": lambda: Val("list", F.sequence(args[0].col, args[1].col, *[x.col for x in args[2:]]), "numbers"), "COALESCE": lambda: Val(a.kind, F.coalesce(*[x.col for x in args])),
            "ABS": lambda: num(F.abs), "CEIL": lambda: num(F.ceil), "FLOOR": lambda: num(F.floor), "ROUND": lambda: num(lambda x: F.floor(x + 0.5)), "SQRT": lambda: num(F.sqrt), "SIGN": lambda: num(F.signum),
            "TOUPPER": lambda: string(F.upper), "TOLOWER": lambda: string(F.lower), "TRIM": lambda: string(F.trim), "LTRIM": lambda: string(F.ltrim), "RTRIM": lambda: string(F.rtrim), "REVERSE": lambda: string(F.reverse),
            "REPLACE": lambda: Val("str", F.replace(a.text(), args[1].col, args[2].col)), "SPLIT": lambda: Val("list", F.split(a.text(), args[1].col), "strings"),
            "SUBSTRING": lambda: Val("str", a.text().substr(args[1].col.cast("int") + 1, args[2].col.cast("int") if len(args) > 2 else F.length(a.text()))),
            "LEFT": lambda: Val("str", a.text().substr(F.lit(1), args[1].col.cast("int"))), "RIGHT": lambda: Val("str", F.right(a.text(), args[1].col.cast("int"))),
            "TOINTEGER": lambda: Val("int", F.floor(a.num()).cast("bigint")), "TOFLOAT": lambda: Val("num", a.num()), "TOSTRING": lambda: Val("str", a.text()), "TIMESTAMP": lambda: Val("int", F.unix_millis(F.current_timestamp())), "EXISTS": lambda: Val("bool", a.col.isNotNull()),
        }
        if name not in calls:
            raise SyntaxError(f"unknown function: {name}")
        return calls[name]()

    # --- changes --------------------------------------------------------------------------------------------------

    def _props_map(self, props: dict[str, Val]) -> Column:
        pairs = [x for k, v in props.items() for x in (F.lit(k), v.col.cast("string"))]
        return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")

    def _new_id(self, name: str, props: dict[str, Val]) -> Column:
        if "id" in props:
            return props["id"].col.cast("string")
        return F.concat(F.lit(f"{name}-"), F.uuid())

    def _create(self) -> None:
        from ..operators.graph import cut

        patterns = [self._pattern()]
        while self.t.take(","):
            patterns.append(self._pattern())
        rows = self._base()
        for _, items in patterns:
            for name, labels, props in items[::2]:
                if name not in self.kinds:
                    self.kinds[name] = "node"
                    rows = rows.withColumn(f"{name}__id", self._new_id(name, props)).withColumn(f"{name}__labels", F.array(*map(F.lit, labels)).cast("array<string>")).withColumn(f"{name}__props", self._props_map(props))
                    rows = cut(rows)
                    self.graph = self.graph.with_nodes(rows.select(F.col(f"{name}__id").alias("id"), F.col(f"{name}__labels").alias("labels"), F.col(f"{name}__props").alias("props")))
            for i in range(1, len(items), 2):
                name, types, props, _, _, direction = items[i]
                a, b = items[i - 1][0], items[i + 1][0]
                a, b = (b, a) if direction == "in" else (a, b)
                e = rows.select(F.concat_ws("|", f"{a}__id", F.lit(types[0]), f"{b}__id").alias("id"), F.col(f"{a}__id").alias("src"), F.col(f"{b}__id").alias("dst"), F.lit(types[0]).alias("type"), (props["weight"].num() if "weight" in props else F.lit(None)).cast("double").alias("weight"))
                if "props" in self.graph.edges.columns:
                    e = e.withColumn("props", self._props_map(props))
                self.graph = self.graph.with_edges(e)
        self.rows = rows

    def _merge(self) -> None:
        """One node or one relationship between bound nodes: found or created."""
        pattern = self._pattern()
        items = pattern[1]
        if len(items) > 1:
            a, rel, b = items[0][0], items[1], items[2][0]
            e = self.graph.by_type(rel[1][0]).select(F.col("src").alias(f"{a}__id"), F.col("dst").alias(f"{b}__id"))
            miss = self.rows.join(e, [f"{a}__id", f"{b}__id"], "left_anti")
            new = miss.select(F.concat_ws("|", f"{a}__id", F.lit(rel[1][0]), f"{b}__id").alias("id"), F.col(f"{a}__id").alias("src"), F.col(f"{b}__id").alias("dst"), F.lit(rel[1][0]).alias("type"), F.lit(None).cast("double").alias("weight"))
            self.graph = self.graph.with_edges(new)
            return
        name, labels, props = items[0]
        found = self._node_rows(name, labels, props)
        exists = not found.isEmpty()
        self.kinds[name] = "node"
        create_at = match_at = None
        while self.t.take("ON"):
            which = self.t.next().upper()
            self.t.expect("SET")
            if which == "CREATE":
                create_at = self.t.i
            else:
                match_at = self.t.i
            self._skip_set()
        end = self.t.i
        if exists:
            self.rows = found
        else:
            self.kinds.pop(name)
            self.t.items[self.t.i : self.t.i] = []
            row = self.spark.range(1).select(self._new_id(name, props).alias("id"), F.array(*map(F.lit, labels)).cast("array<string>").alias("labels"), self._props_map(props).alias("props"))
            from ..operators.graph import cut

            row = cut(row)
            self.graph = self.graph.with_nodes(row)
            self.kinds[name] = "node"
            self.rows = row.select(F.col("id").alias(f"{name}__id"), F.col("labels").alias(f"{name}__labels"), F.col("props").alias(f"{name}__props"))
        at = match_at if exists else create_at
        if at is not None:
            self.t.i = at
            self._set()
            self.t.i = end

    def _skip_set(self) -> None:
        while self.t.word() not in CLAUSES:
            self.t.next()

    def _touched(self, name: str) -> Column:
        ids = self.rows.select(F.col(f"{name}__id").alias("id")).where("id is not null").distinct()
        self.graph = Graph(self.graph.nodes.join(ids.withColumn("_hit", F.lit(True)), "id", "left"), self.graph.edges)
        return F.coalesce(F.col("_hit"), F.lit(False))

    def _set(self) -> None:
        while True:
            name = self.t.next()
            if self.t.take(":"):
                label = self.t.next()
                self.graph = self.graph.set_label(self._touched(name), label)
            else:
                self.t.expect(".")
                key = self.t.next()
                self.t.expect("=")
                v = self._expr()
                new = self.rows.select(F.col(f"{name}__id").alias("id"), v.col.cast("string").alias("_value")).distinct()
                n = self.graph.nodes.join(new.withColumn("_hit", F.lit(True)), "id", "left")
                changed = F.map_concat(F.map_filter("props", lambda k, _: k != key), F.create_map(F.lit(key), F.col("_value")))
                self.graph = Graph(n.withColumn("props", F.when(F.col("_hit"), changed).otherwise(F.col("props"))).drop("_value"), self.graph.edges)
            self.graph = Graph(self.graph.nodes.drop("_hit"), self.graph.edges)
            if not self.t.take(","):
                return

    def _remove(self) -> None:
        name = self.t.next()
        if self.t.take(":"):
            label = self.t.next()
            hit = self._touched(name)
            n = self.graph.nodes.withColumn("labels", F.when(hit, F.array_remove("labels", label)).otherwise(F.col("labels")))
            self.graph = Graph(n.drop("_hit"), self.graph.edges)
        else:
            self.t.expect(".")
            key = self.t.next()
            g = self.graph.remove_property(self._touched(name), key) if False else None
            hit = self._touched(name)
            g = self.graph.remove_property(hit, key)
            self.graph = Graph(g.nodes.drop("_hit"), g.edges)

    def _delete(self) -> None:
        detach = self.t.take("DETACH")
        self.t.expect("DELETE")
        while True:
            name = self.t.next()
            if self.kinds.get(name) == "rel":
                gone = self.rows.select(F.col(f"{name}__id").alias("id")).distinct()
                self.graph = Graph(self.graph.nodes, self.graph.edges.join(gone, "id", "left_anti"))
            else:
                hit = self._touched(name)
                g = self.graph.delete_nodes(hit, detach)
                self.graph = Graph(g.nodes.drop("_hit"), g.edges)
            if not self.t.take(","):
                return
