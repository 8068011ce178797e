"""SQL with vector operators: ``<->`` (L2), ``<=>`` (cosine), ``<#>`` (negated dot) and ``<+>`` (L1), and VECTOR(n) columns.

Operators are rewritten to folds over arrays in place (Spark takes no SQL function in ORDER BY); the same functions are
also registered by name. All else is Spark SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_FOLD = "aggregate(zip_with({{a}}, {{b}}, (x, y) -> {}), 0D, (acc, x) -> acc + x)"
_DOT = _FOLD.format("CAST(x AS DOUBLE) * y")
_NORM = "sqrt(aggregate({0}, 0D, (acc, x) -> acc + CAST(x AS DOUBLE) * x))"
_A, _B = _NORM.format("{a}"), _NORM.format("{b}")
#: What each function is, over {a} and {b}.
FUNCTIONS = {
    "vector_l2": f"sqrt({_FOLD.format('(CAST(x AS DOUBLE) - y) * (CAST(x AS DOUBLE) - y)')})",
    "vector_cosine": f"CASE WHEN {_A} = 0 OR {_B} = 0 THEN 1D ELSE 1 - {_DOT} / nullif({_A} * {_B}, 0) END",
    "vector_ip": f"-({_DOT})",
    "vector_l1": _FOLD.format("abs(CAST(x AS DOUBLE) - y)"),
}
_PAIRS = "zip_with({{a}}, {{b}}, (x, y) -> {})"
_EACH = "transform({{a}}, x -> {})"
_POINCARE = f"acosh(greatest(1D, 1 + 2 * {_FOLD.format('(CAST(x AS DOUBLE) - y) * (CAST(x AS DOUBLE) - y)')} / greatest((1 - pow({_A}, 2)) * (1 - pow({_B}, 2)), 1e-10)))"
#: More functions by name: of two vectors (over {a} and {b}) or of one, and what they return.
MORE = {
    "vector_dot": (_DOT, "DOUBLE"),
    "vector_l2_squared": (_FOLD.format("(CAST(x AS DOUBLE) - y) * (CAST(x AS DOUBLE) - y)"), "DOUBLE"),
    "vector_cosine_similarity": (f"CASE WHEN {_A} = 0 OR {_B} = 0 THEN 0D ELSE {_DOT} / nullif({_A} * {_B}, 0) END", "DOUBLE"),
    "vector_chebyshev": ("array_max(zip_with({a}, {b}, (x, y) -> abs(CAST(x AS DOUBLE) - y)))", "DOUBLE"),
    "vector_canberra": (_FOLD.format("CASE WHEN abs(x) + abs(y) = 0 THEN 0D ELSE abs(CAST(x AS DOUBLE) - y) / nullif(abs(x) + abs(y), 0) END"), "DOUBLE"),
    "vector_hamming": (_FOLD.format("CASE WHEN (x > 0) <> (y > 0) THEN 1D ELSE 0D END"), "DOUBLE"),
    "vector_poincare": (_POINCARE, "DOUBLE"),
    "vector_add": (_PAIRS.format("CAST(x AS DOUBLE) + y"), "ARRAY<DOUBLE>"),
    "vector_sub": (_PAIRS.format("CAST(x AS DOUBLE) - y"), "ARRAY<DOUBLE>"),
    "vector_mul": (_PAIRS.format("CAST(x AS DOUBLE) * y"), "ARRAY<DOUBLE>"),
    "vector_norm": (_A, "DOUBLE"),
    "vector_dims": ("size({a})", "INT"),
    "vector_sum": ("aggregate({a}, 0D, (acc, x) -> acc + x)", "DOUBLE"),
    "vector_avg": ("aggregate({a}, 0D, (acc, x) -> acc + x) / nullif(size({a}), 0)", "DOUBLE"),
    "vector_normalize": (f"CASE WHEN {_A} = 0 THEN {{a}} ELSE element_at(transform(array({_A}), n -> transform({{a}}, x -> x / nullif(n, 0))), 1) END", "ARRAY<DOUBLE>"),
    "vector_abs": (_EACH.format("abs(x)"), "ARRAY<DOUBLE>"),
    "vector_neg": (_EACH.format("-x"), "ARRAY<DOUBLE>"),
    "vector_relu": (_EACH.format("greatest(x, 0D)"), "ARRAY<DOUBLE>"),
    "vector_sigmoid": (_EACH.format("1 / (1 + exp(-x))"), "ARRAY<DOUBLE>"),
    "vector_binary": (_EACH.format("CASE WHEN x > 0 THEN 1D ELSE 0D END"), "ARRAY<DOUBLE>"),
    "vector_softmax": ("element_at(transform(array(array_max({a})), m -> element_at(transform(array(transform({a}, x -> exp(x - m))), e -> transform(e, x -> x / aggregate(e, 0D, (acc, y) -> acc + y))), 1)), 1)", "ARRAY<DOUBLE>"),
}
OPERATORS = {"<->": "vector_l2", "<=>": "vector_cosine", "<#>": "vector_ip", "<+>": "vector_l1"}
_OPERAND = r"(?:[A-Za-z_][\w.]*(?:\([^()]*\))?|\[[^\]]*\]|'\[[^\]]*\]'(?:::vector)?|\((?:[^()]|\([^()]*\))*\)|:\w+)"
_INFIX = re.compile(rf"({_OPERAND})\s*(<->|<=>|<#>|<\+>)\s*({_OPERAND})")


def register(spark: SparkSession) -> None:
    """Make the functions known to a session."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {_checked(body, 'a', 'b')}")
    for name, (body, kind) in MORE.items():
        if "{b}" in body:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS {kind} RETURN {_checked(body, 'a', 'b', kind)}")
        else:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>) RETURNS {kind} RETURN {body.format(a='a')}")
    # A table function: a vector's components as rows.
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vector_rows(a ARRAY<DOUBLE>) RETURNS TABLE(pos INT, x DOUBLE) RETURN SELECT pos, col FROM posexplode(a)")


def _checked(body: str, a: str, b: str, kind: str = "DOUBLE") -> str:
    """The expression; vectors of different lengths raise."""
    return f"(CASE WHEN size({a}) <> size({b}) THEN CAST(raise_error('vectors differ in length') AS {kind}) ELSE {body.format(a=a, b=b)} END)"


def _literal(s: str) -> str:
    m = re.fullmatch(r"'?\[([^\]]*)\]'?(?:::vector)?", s)
    return f"from_json('[{m[1].strip()}]', 'array<double>')" if m else s


def rewrite(sql: str) -> str:
    """The statement as Spark SQL. Inside string literals nothing changes, but for vector literals beside an operator."""
    while m := _INFIX.search(sql):
        sql = sql[: m.start()] + _checked(FUNCTIONS[OPERATORS[m[2]]], _literal(m[1]), _literal(m[3])) + sql[m.end() :]
    return sql


class Database:
    """Tables with declared vector dimensions over a session. Types: TEXT, INTEGER, REAL, VECTOR(n), BOOLEAN."""

    KINDS = {"TEXT": "STRING", "INTEGER": "BIGINT", "REAL": "DOUBLE", "BOOLEAN": "BOOLEAN"}

    def __init__(self, spark: SparkSession):
        self.spark, self.dims = spark, {}
        register(spark)

    def execute(self, sql: str) -> DataFrame | None:
        """Run a statement; SELECT gives a DataFrame."""
        sql = sql.strip().rstrip(";")
        if m := re.match(r"(?is)CREATE\s+TABLE\s+(IF\s+NOT\s+EXISTS\s+)?(\w+)\s*\((.*)\)$", sql):
            columns, dims = [], {}
            for part in re.split(r",(?![^(]*\))", m[3]):
                name, kind = re.match(r"\s*(\w+)\s+(\w+(?:\s*\(\s*\d+\s*\))?)", part).groups()
                if v := re.fullmatch(r"(?i)VECTOR\s*\(\s*(\d+)\s*\)", kind):
                    dims[name] = int(v[1])
                    columns.append(f"{name} ARRAY<DOUBLE>")
                else:
                    columns.append(f"{name} {self.KINDS.get(kind.upper(), kind)}")
            self.spark.sql(f"CREATE TABLE {m[1] or ''}{m[2]} ({', '.join(columns)}) USING parquet")
            self.dims[m[2].lower()] = dims
            return None
        if m := re.match(r"(?is)INSERT\s+INTO\s+(\w+)\s*(?:\(([^)]*)\))?\s*VALUES\s*(.*)$", sql):
            table = self.spark.table(m[1])
            names = [c.strip() for c in m[2].split(",")] if m[2] else table.columns
            body = re.sub(r"'?\[[^\]]*\]'?(?:::vector)?", lambda x: _literal(x[0]), m[3])
            rows = self.spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")
            for c, n in self.dims.get(m[1].lower(), {}).items():
                if c in names and rows.where(f"size({c}) <> {n}").limit(1).count():
                    raise ValueError(f"dimension mismatch: {c} has {n} dimensions")
            kinds = dict(table.dtypes)
            rows.selectExpr(*[f"CAST({c} AS {kinds[c]}) AS {c}" if c in names else f"CAST(NULL AS {kinds[c]}) AS {c}" for c in table.columns]).write.insertInto(m[1])
            return None
        if m := re.match(r"(?is)DROP\s+TABLE\s+(?:IF\s+EXISTS\s+)?(\w+)$", sql):
            self.dims.pop(m[1].lower(), None)
            self.spark.sql(sql)
            return None
        return self.spark.sql(rewrite(sql))
