"""Exporters; each writes a directory through Spark, so files come from executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import Graph


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays and maps become JSON text."""
    cols = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def graphml_lines(graph: Graph, min_weight: float | None = None) -> DataFrame:
    """(part, line): header, nodes, edges and footer of a GraphML document, to be written in order of part."""
    spark = graph.nodes.sparkSession
    e = graph.edges if min_weight is None else graph.edges.where(F.coalesce("weight", F.lit(1.0)) >= min_weight)
    head = '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="w" for="edge" attr.name="weight" attr.type="double"/><key id="l" for="node" attr.name="labels" attr.type="string"/><graph edgedefault="directed">'
    ends = spark.createDataFrame([(0, head), (3, "</graph></graphml>")], "part int, line string")
    nodes = graph.nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), _xml(F.col("id").cast("string")), F.lit('"><data key="l">'), _xml(F.array_join("labels", ",")), F.lit("</data></node>")).alias("line"))
    edges = e.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), _xml(F.col("src").cast("string")), F.lit('" target="'), _xml(F.col("dst").cast("string")), F.lit('"><data key="w">'), F.coalesce("weight", F.lit(1.0)).cast("string"), F.lit("</data></edge>")).alias("line"))
    return ends.unionByName(nodes).unionByName(edges)


def dot_lines(graph: Graph, min_weight: float | None = None) -> DataFrame:
    spark = graph.nodes.sparkSession
    e = graph.edges if min_weight is None else graph.edges.where(F.coalesce("weight", F.lit(1.0)) >= min_weight)
    q = lambda c: F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"'))
    ends = spark.createDataFrame([(0, "digraph G {"), (3, "}")], "part int, line string")
    nodes = graph.nodes.select(F.lit(1).alias("part"), F.concat(F.lit("  "), q("id"), F.lit(";")).alias("line"))
    edges = e.select(F.lit(2).alias("part"), F.concat(F.lit("  "), q("src"), F.lit(" -> "), q("dst"), F.lit(' [label="'), F.col("type"), F.lit('"];')).alias("line"))
    return ends.unionByName(nodes).unionByName(edges)


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines in order of their part, over ranges."""
    lines.orderBy("part", "line").select("line").write.mode("overwrite").text(path)
