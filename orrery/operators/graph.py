"""Property graphs as two DataFrames: nodes(id, labels, props) and edges(id, src, dst, type, props, weight).

Bounded hops are joins in one lazy plan; unbounded searches loop over frontiers that are written to the checkpoint folder
each round, so a lost executor costs one round.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder of the session. Where none is set, a folder of this machine, if
    the session runs on it alone; on a cluster that raises."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        given = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not given and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="orrery-"))
    return df.checkpoint()


#: After so many rounds, what was found in each is gathered in one table, so plans stay short.
GATHER = 16


def _rounds(most: int | None):
    """1, 2, 3 and on, up to ``most`` if given."""
    return count(1) if most is None else range(1, most + 1)


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame

    # --- look-ups -------------------------------------------------------------------------------------------------

    def by_label(self, *labels: str, all_: bool = True) -> DataFrame:
        """Nodes that have all (or any) of the labels."""
        want = F.array(*map(F.lit, labels))
        return self.nodes.where(F.size(F.array_intersect("labels", want)) == len(set(labels)) if all_ else F.arrays_overlap("labels", want))

    def by_property(self, key: str, value) -> DataFrame:
        return self.nodes.where(F.coalesce(F.col("props")[key] == F.lit(value), F.lit(False)))

    def by_type(self, *types: str) -> DataFrame:
        return self.edges.where(F.col("type").isin(*types))

    def node(self, id_) -> DataFrame:
        return self.nodes.where(F.col("id") == F.lit(id_))

    def stats(self) -> DataFrame:
        """(kind, name, n): nodes by label and edges by type."""
        a = self.nodes.select(F.lit("label").alias("kind"), F.explode("labels").alias("name")).groupBy("kind", "name").agg(F.count("*").alias("n"))
        b = self.edges.groupBy(F.lit("type").alias("kind"), F.col("type").alias("name")).agg(F.count("*").alias("n"))
        return a.unionByName(b)

    # --- steps ----------------------------------------------------------------------------------------------------

    def steps(self, direction: str = "out", types: list[str] | None = None) -> DataFrame:
        """(src, dst, edge_id, type, weight) as walked: out, in, or both."""
        e = self.edges if not types else self.by_type(*types)
        out = e.select("src", "dst", F.col("id").alias("edge_id"), "type", F.coalesce("weight", F.lit(1.0)).alias("weight"))
        back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_id", "type", "weight")
        return {"out": out, "in": back}.get(direction) if direction != "both" else out.unionByName(back.where("src != dst"))

    def expand(self, rows: DataFrame, column: str, to: str, direction: str = "out", types: list[str] | None = None) -> DataFrame:
        """One hop from a column of node ids."""
        s = self.steps(direction, types).select(F.col("src").alias(column), F.col("dst").alias(to), F.col("edge_id").alias(f"{to}_edge"))
        return rows.join(s, column)

    def neighbours(self, direction: str = "out", types: list[str] | None = None) -> DataFrame:
        return self.steps(direction, types).select(F.col("src").alias("id"), F.col("dst").alias("neighbour")).distinct()

    def degrees(self) -> DataFrame:
        o = self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
        i = self.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
        d = self.nodes.select("id").join(o, "id", "left").join(i, "id", "left").fillna(0)
        return d.withColumn("degree", F.col("out_degree") + F.col("in_degree"))

    def walks(self, starts: DataFrame, low: int, high: int | None, direction: str = "out", types: list[str] | None = None) -> DataFrame:
        """(start, end, hops, path, edges) of walks of low to high hops that use no edge twice, as a union of joins;
        without ``high``, all such walks, a stored table a hop, until no walk goes on."""
        s = self.steps(direction, types)
        row = starts.select(F.col("id").alias("start"), F.col("id").alias("end"), F.lit(0).alias("hops"), F.array("id").alias("path"), F.array().cast(f"array<{dict(self.edges.dtypes)['id']}>").alias("edges"))
        out = row if low == 0 else None
        for h in range(1, high + 1) if high is not None else count(1):
            row = (
                row.join(s, F.col("end") == F.col("src"))
                .where(~F.array_contains("edges", F.col("edge_id")))
                .select("start", F.col("dst").alias("end"), F.lit(h).alias("hops"), F.concat("path", F.array("dst")).alias("path"), F.concat("edges", F.array("edge_id")).alias("edges"))
            )
            if high is None:
                row = cut(row)
            if h >= low:
                out = row if out is None else out.unionByName(row)
            if high is None and row.isEmpty() and out is not None:
                break
        return out

    def simple_paths(self, start, end, max_hops: int, max_paths: int | None = None) -> DataFrame:
        """(path, hops) without repeated nodes, in the order of their nodes; the first ``max_paths`` if asked."""
        s = self.steps("out")
        row = self.node(start).select(F.col("id").alias("at"), F.array("id").alias("path"))
        out = row.where(F.col("at") == F.lit(end))
        for _ in range(max_hops):
            row = row.where(F.col("at") != F.lit(end)).join(s, F.col("at") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
            row = row.select(F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path")).distinct()
            out = out.unionByName(row.where(F.col("at") == F.lit(end)))
        out = out.select("path", (F.size("path") - 1).alias("hops"))
        return out.orderBy("path").limit(max_paths) if max_paths else out

    # --- searches -------------------------------------------------------------------------------------------------

    def bfs(self, start, max_hops: int | None = None, direction: str = "out", types: list[str] | None = None) -> DataFrame:
        """(id, hops) of all nodes that are reached, within ``max_hops`` if given, by frontiers against what was seen."""
        s = self.steps(direction, types).select("src", "dst").distinct()
        seen = self.node(start).select("id", F.lit(0).alias("hops"))
        front = seen
        for h in _rounds(max_hops):
            step = front.join(s, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
            front = cut(step.join(seen, "id", "left_anti").select("id", F.lit(h).alias("hops")))
            if front.isEmpty():
                break
            seen = seen.unionByName(front)
            seen = cut(seen) if h % GATHER == 0 else seen
        return seen

    def shortest_path(self, start, end, max_hops: int | None = None, types: list[str] | None = None) -> DataFrame:
        """(path, hops) of one shortest path by hops, of equals the one with the smallest nodes; start = end: one node."""
        s = self.steps("out", types).select("src", "dst").distinct()
        front = self.node(start).select("id", F.array("id").alias("path"))
        seen = front.select("id")
        for h in _rounds(max_hops):
            hit = front.where(F.col("id") == F.lit(end))
            if not hit.isEmpty():
                break
            step = front.join(s, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
            front = cut(step.groupBy("id").agg(F.min("path").alias("path")).join(seen, "id", "left_anti"))
            if front.isEmpty():
                break
            seen = seen.unionByName(front.select("id"))
            seen = cut(seen) if h % GATHER == 0 else seen
        return front.where(F.col("id") == F.lit(end)).select("path", (F.size("path") - 1).alias("hops"))

    def dfs(self, start, stop: Column | None = None, types: list[str] | None = None) -> DataFrame:
        """(id, position) of a depth-first visit, the smallest node first; it ends behind the first node that ``stop``, a
        condition on id, holds for.

        Such an order can't be found by parts. What is reached is found by rounds; its edges then come to the driver, which
        visits them: use it for a neighbourhood, not for a whole large graph.
        """
        near: dict = {}
        reach = self.bfs(start, types=types).select("id")
        for r in self.steps("out", types).join(reach.select(F.col("id").alias("src")), "src").select("src", "dst").distinct().orderBy("src", F.desc("dst")).toLocalIterator():
            near.setdefault(r.src, []).append(r.dst)
        seen: dict = {}
        todo = [r.id for r in self.node(start).select("id").collect()]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen[x] = len(seen)
                todo += [y for y in near.get(x, []) if y not in seen]
        spark = self.nodes.sparkSession
        out = spark.createDataFrame(list(seen.items()) or [], f"id {dict(self.nodes.dtypes)['id']}, position int")
        if stop is None:
            return out
        last = out.where(stop).agg(F.min("position").alias("last"))
        return out.crossJoin(F.broadcast(last)).where(F.col("last").isNull() | (F.col("position") <= F.col("last"))).drop("last")

    def distances(self, start, types: list[str] | None = None) -> DataFrame:
        """(id, cost, path) of cheapest paths by weight (missing: 1.0), by relaxation until nothing improves. Weights are
        not negative; else this raises."""
        if not self.steps("out", types).where("weight < 0").isEmpty():
            raise ValueError("a weight is negative")
        s = self.steps("out", types).groupBy("src", "dst").agg(F.min("weight").alias("weight"))
        best = self.node(start).select("id", F.lit(0.0).alias("cost"), F.array("id").alias("path"))
        front = best
        while True:
            step = front.join(s, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("cost") + F.col("weight")).alias("cost"), F.concat("path", F.array("dst")).alias("path"))
            step = step.groupBy("id").agg(F.min(F.struct("cost", "path")).alias("n"))
            old = best.select("id", F.col("cost").alias("old"))
            front = cut(step.join(old, "id", "left").where(F.col("old").isNull() | (F.col("n.cost") < F.col("old"))).select("id", "n.cost", "n.path"))
            if front.isEmpty():
                break
            best = cut(best.join(front, "id", "left_anti").unionByName(front))
        return best

    def all_pairs(self) -> DataFrame:
        """(src, dst, cost) of cheapest paths between all pairs, by squaring in the min-plus algebra. For small graphs:
        the result itself has a row a pair."""
        d = self.steps("out").groupBy("src", "dst").agg(F.min("weight").alias("cost"))
        d = d.unionByName(self.nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("cost"))).groupBy("src", "dst").agg(F.min("cost").alias("cost"))
        state = None
        while True:
            r = d.select(F.col("src").alias("mid"), F.col("dst").alias("to"), F.col("cost").alias("more"))
            d = cut(d.join(r, F.col("dst") == F.col("mid")).groupBy("src", F.col("to").alias("dst")).agg(F.min(F.col("cost") + F.col("more")).alias("cost")))
            now = tuple(d.agg(F.count("*"), F.sum("cost")).first())
            if now == state:
                break
            state = now
        return d

    def components(self) -> DataFrame:
        """(id, component): the smallest id that a node is connected with, whatever the direction."""
        both = self.steps("both").select("src", "dst").distinct()
        label = self.nodes.select("id", F.col("id").alias("component"))
        while True:
            near = both.join(label, F.col("dst") == F.col("id")).groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
            step = label.join(near, "id", "left").select("id", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("old"))
            # Pointer jumping: take over what the component's own node has meanwhile.
            jump = step.select(F.col("id").alias("component"), F.col("component").alias("far"))
            step = cut(step.join(jump, "component", "left").select("id", F.least("component", F.coalesce("far", "component")).alias("component"), "old"))
            if step.where("component != old").isEmpty():
                return step.select("id", "component")
            label = step.select("id", "component")

    def pagerank(self, alpha: float = 0.85, rounds: int = 20, epsilon: float | None = 1e-6, seeds: DataFrame | None = None) -> DataFrame:
        """(id, rank), sums to 1. Rank of nodes without outgoing edges, and the rest of alpha, go to the seeds, or to all."""
        n = self.nodes.count() if seeds is None else seeds.select("id").distinct().count()
        start = self.nodes.select("id", F.lit(1.0 / max(n, 1)).alias("base")) if seeds is None else self.nodes.select("id").join(seeds.select("id").distinct().withColumn("base", F.lit(1.0 / max(n, 1))), "id", "left").fillna(0.0)
        out = self.steps("out")
        share = out.groupBy("src").agg(F.sum("weight").alias("total"))
        e = cut(out.join(share, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("w")))
        start = cut(start.join(share.select(F.col("src").alias("id"), F.lit(1).alias("has")), "id", "left"))
        rank = start.select("id", F.col("base").alias("rank"))
        for i in range(rounds):
            got = e.join(rank, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
            lost = start.where("has is null").join(rank, "id").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
            new = start.join(got, F.col("id") == F.col("dst"), "left").select("id", (F.col("base") * ((1 - alpha) + alpha * lost) + alpha * F.coalesce("got", F.lit(0.0))).alias("rank"))
            new = cut(new)
            if epsilon is not None and i % 4 == 3:
                moved = new.join(rank.select("id", F.col("rank").alias("old")), "id").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
                if moved < epsilon:
                    return new
            rank = new
        return rank

    def centrality(self, method: str = "degree") -> DataFrame:
        """(id, centrality): degree (over n - 1), pagerank, or closeness (over what is reached)."""
        n = self.nodes.count()
        if method == "degree":
            return self.degrees().select("id", (F.col("degree") / max(1, n - 1)).alias("centrality"))
        if method == "pagerank":
            return self.pagerank().withColumnRenamed("rank", "centrality")
        if method == "closeness":
            d = self.all_pairs().where("src != dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("m"), F.sum("cost").alias("s"))
            return self.nodes.select("id").join(d, "id", "left").select("id", F.coalesce(F.col("m") * F.col("m") / (F.col("s") * max(1, n - 1)), F.lit(0.0)).alias("centrality"))
        raise ValueError(f"unknown centrality: {method}")

    def topological_order(self) -> DataFrame:
        """(id, level): the longest path from a source; nodes on cycles are left out."""
        e = cut(self.edges.select("src", "dst").distinct())
        left = cut(self.nodes.select("id"))
        out = left.limit(0).withColumn("level", F.lit(0))
        for level in count():
            ready = cut(left.join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_anti"))
            if ready.isEmpty():
                break
            out = out.unionByName(ready.withColumn("level", F.lit(level)))
            out = cut(out) if level % GATHER == GATHER - 1 else out
            left = cut(left.join(ready, "id", "left_anti"))
            e = cut(e.join(ready.select(F.col("id").alias("src")), "src", "left_anti"))
        return out

    # --- changes: a new graph each time ----------------------------------------------------------------------------

    def with_nodes(self, rows: DataFrame) -> Graph:
        return Graph(self.nodes.unionByName(rows, allowMissingColumns=True), self.edges)

    def with_edges(self, rows: DataFrame) -> Graph:
        return Graph(self.nodes, self.edges.unionByName(rows, allowMissingColumns=True))

    def merge_nodes(self, rows: DataFrame, on_create: dict[str, Column] | None = None, on_match: dict[str, Column] | None = None) -> Graph:
        """Add rows whose id is new (with ``on_create`` applied); apply ``on_match`` to nodes that are there."""
        new = rows.join(self.nodes.select("id"), "id", "left_anti").withColumns(on_create or {})
        hit = self.nodes.join(rows.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
        for k, c in (on_match or {}).items():
            hit = hit.withColumn(k, F.when(F.col("_hit"), c).otherwise(F.col(k)))
        return Graph(hit.drop("_hit").unionByName(new, allowMissingColumns=True), self.edges)

    def set_property(self, where: Column, key: str, value) -> Graph:
        p = F.map_concat(F.map_filter("props", lambda k, _: k != key), F.create_map(F.lit(key), F.lit(value).cast("string")))
        return Graph(self.nodes.withColumn("props", F.when(where, p).otherwise(F.col("props"))), self.edges)

    def remove_property(self, where: Column, key: str) -> Graph:
        return Graph(self.nodes.withColumn("props", F.when(where, F.map_filter("props", lambda k, _: k != key)).otherwise(F.col("props"))), self.edges)

    def set_label(self, where: Column, label: str) -> Graph:
        return Graph(self.nodes.withColumn("labels", F.when(where, F.array_union("labels", F.array(F.lit(label)))).otherwise(F.col("labels"))), self.edges)

    def delete_nodes(self, where: Column, detach: bool = False) -> Graph:
        """Without ``detach``, nodes that still have edges raise when the result is read."""
        gone = self.nodes.where(where).select("id")
        ends = self.edges.select(F.col("src").alias("id")).unionByName(self.edges.select(F.col("dst").alias("id")))
        if not detach and not gone.join(ends, "id", "left_semi").isEmpty():
            raise ValueError("nodes to delete still have edges")
        e = self.edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
        return Graph(self.nodes.join(gone, "id", "left_anti"), e.select(*self.edges.columns))

    def delete_edges(self, where: Column) -> Graph:
        return Graph(self.nodes, self.edges.where(~F.coalesce(where, F.lit(False))))


def star_schema(spark: SparkSession, sf_dir: str) -> Graph:
    """A graph of the trade tables: customers place orders, nations lie in regions, and so on. Ids are ``kind:key``."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    kinds = [("region", "Region", "r_regionkey", ["r_name"]), ("nation", "Nation", "n_nationkey", ["n_name"]), ("customer", "Customer", "c_custkey", ["c_name", "c_mktsegment", "c_acctbal"]), ("supplier", "Supplier", "s_suppkey", ["s_name", "s_acctbal"]), ("orders", "Order", "o_orderkey", ["o_orderstatus", "o_totalprice"])]

    def node(name: str, label: str, key: str, props: list[str]) -> DataFrame:
        pairs = [x for p in props for x in (F.lit(p.split("_", 1)[1]), F.col(p).cast("string"))]
        return t(name).select(F.concat_ws(":", F.lit(name), key).alias("id"), F.array(F.lit(label)).alias("labels"), F.create_map(*pairs).alias("props"))

    links = [("nation", "n_nationkey", "region", "n_regionkey", "IN_REGION", None), ("customer", "c_custkey", "nation", "c_nationkey", "IN_NATION", None), ("supplier", "s_suppkey", "nation", "s_nationkey", "IN_NATION", None)]

    def edge(name: str, key: str, other: str, ref: str, kind: str, weight: str | None) -> DataFrame:
        src, dst = F.concat_ws(":", F.lit(name), key), F.concat_ws(":", F.lit(other), ref)
        return t(name).select(F.concat_ws("|", src, dst).alias("id"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), (F.col(weight) if weight else F.lit(None)).cast("double").alias("weight"))

    nodes = node(*kinds[0])
    for k in kinds[1:]:
        nodes = nodes.unionByName(node(*k))
    edges = edge(*links[0])
    for link in links[1:]:
        edges = edges.unionByName(edge(*link))
    placed = t("orders").select(F.concat(F.lit("customer:"), "o_custkey").alias("src"), F.concat(F.lit("orders:"), "o_orderkey").alias("dst"), F.col("o_totalprice").alias("weight"))
    placed = placed.select(F.concat_ws("|", "src", "dst").alias("id"), "src", "dst", F.lit("PLACED").alias("type"), "weight")
    return Graph(nodes, edges.unionByName(placed))


# --- hyperedges ---------------------------------------------------------------------------------------------------


def hyperedge_members(hyperedges: DataFrame) -> DataFrame:
    """(hid, pos, node, role) of hyperedges (id, nodes, roles?)."""
    roles = F.col("roles") if "roles" in hyperedges.columns else F.array().cast("array<string>")
    return hyperedges.select(F.col("id").alias("hid"), F.posexplode("nodes").alias("pos", "node"), roles.alias("_r")).select("hid", "pos", "node", F.get("_r", F.col("pos")).alias("role"))


def hyperedge_match(hyperedges: DataFrame, at: dict[int, DataFrame], arity: int | None = None) -> DataFrame:
    """Hyperedges whose member at each given position is among the given nodes (id)."""
    out = hyperedges if arity is None else hyperedges.where(F.size("nodes") == arity)
    for pos, nodes in at.items():
        out = out.withColumn("_n", F.get("nodes", F.lit(pos))).join(nodes.select(F.col("id").alias("_n")).distinct(), "_n", "left_semi").drop("_n")
    return out


# --- message passing ----------------------------------------------------------------------------------------------


def aggregate_messages(edges: DataFrame, features: DataFrame, how: str = "sum") -> DataFrame:
    """(id, v): element-wise sum, mean or max of the features of the sources of a node's incoming edges, weighted."""
    w = F.coalesce(F.col("weight"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    m = edges.select("src", "dst", w.alias("w")).join(features.select(F.col("id").alias("src"), F.col("v").alias("x")), "src")
    e = m.select(F.col("dst").alias("id"), F.posexplode(F.transform("x", lambda y: y)).alias("pos", "y"), "w")
    agg = {"sum": F.sum(F.col("y") * F.col("w")), "mean": F.avg(F.col("y") * F.col("w")), "max": F.max(F.col("y") * F.col("w"))}[how]
    flat = e.groupBy("id", "pos").agg(agg.alias("y"))
    return flat.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "y"))).alias("p")).select("id", F.transform("p", lambda s: s["y"]).alias("v"))


def _dense(matrix: np.ndarray, bias: np.ndarray | None, relu: bool):
    @F.pandas_udf("array<double>")
    def f(v: pd.Series) -> pd.Series:
        y = np.array(v.tolist(), dtype=float) @ matrix
        y = y + bias if bias is not None else y
        return pd.Series(list(np.maximum(y, 0) if relu else y))

    return f


def _mapped(features: DataFrame, matrix: np.ndarray, name: str) -> DataFrame:
    """(id, name): features through a linear map; null components count as 0. What is linear comes first, so that the
    mapped features travel, which are shorter."""
    v = F.transform("v", lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    return features.where("v is not null").select("id", _dense(matrix, None, False)(v).alias(name))


def gcn_layer(edges: DataFrame, features: DataFrame, weight: np.ndarray, bias: np.ndarray | None = None) -> DataFrame:
    """Sum of neighbours over the root of the in-degree (that side only), a linear map, ReLU. Nodes without incoming
    edges have a zero sum. Edges are read once, and summed before they travel to their node."""
    w = F.coalesce(F.col("weight"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    e = edges.select("src", "dst", w.alias("w")).join(_mapped(features, weight, "y").withColumnRenamed("id", "src"), "src", "left")
    n = weight.shape[1]
    s = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("_deg"), *[F.sum(F.get("y", F.lit(i)) * F.col("w")).alias(f"_s{i}") for i in range(n)])
    add = bias if bias is not None else np.zeros(n)
    out = [F.greatest(F.coalesce(F.col(f"_s{i}") / F.sqrt("_deg"), F.lit(0.0)) + F.lit(float(add[i])), F.lit(0.0)) for i in range(n)]
    return features.select("id").join(s, "id", "left").select("id", F.array(*out).alias("v"))


def sage_layer(edges: DataFrame, features: DataFrame, w_self: np.ndarray, w_near: np.ndarray, samples: int | None = None, seed: int = 42) -> DataFrame:
    """Own features and the mean of (sampled) neighbours through two linear maps, ReLU."""
    e = edges.drop("weight")
    if samples:
        from pyspark.sql import Window as W

        w = W.partitionBy("dst").orderBy(F.xxhash64("src", F.lit(seed)), "src")
        e = e.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= samples).drop("_r")
    n = w_near.shape[1]
    m = e.select("src", "dst").join(_mapped(features, w_near, "y").withColumnRenamed("id", "src"), "src")
    near = m.groupBy(F.col("dst").alias("id")).agg(*[F.avg(F.get("y", F.lit(i))).alias(f"_m{i}") for i in range(n)])
    own = features.select("id", _dense(w_self, None, False)("v").alias("_own"))
    out = [F.greatest(F.get("_own", F.lit(i)) + F.coalesce(F.col(f"_m{i}"), F.lit(0.0)), F.lit(0.0)) for i in range(n)]
    return own.join(near, "id", "left").select("id", F.array(*out).alias("v"))


def message_pass(edges: DataFrame, features: DataFrame, hops: int, how: str = "mean") -> DataFrame:
    """Features after a number of rounds of aggregation; nodes without neighbours keep theirs."""
    f = features
    for _ in range(hops):
        m = aggregate_messages(edges, f, how).select("id", F.col("v").alias("m"))
        f = f.join(m, "id", "left").select("id", F.coalesce("m", "v").alias("v"))
    return f


def semantic_path_score(similarity: Column, hops: Column, weight: float = 0.6) -> Column:
    return weight * similarity + (1 - weight) / (hops + 1)
