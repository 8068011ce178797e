"""Collections, model registry, contracts and plan analysis: thin wrappers over tables and ``explain``."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Collection:
    """A table of vectors of one dimension and metric."""

    name: str
    dimensions: int
    metric: str = "l2"

    def __post_init__(self):
        if not 1 <= self.dimensions <= 100_000:
            raise ValueError("dimensions must be between 1 and 100000")
        if self.metric not in ("l2", "cosine", "ip", "l1"):
            raise ValueError(f"unknown metric: {self.metric}")

    def check(self, df: DataFrame, vector: str = "vector") -> DataFrame:
        """The rows, with an error for each whose vector has another dimension."""
        ok = F.size(vector) == self.dimensions
        return df.withColumn(vector, F.when(ok | F.col(vector).isNull(), F.col(vector)).otherwise(F.raise_error(F.lit(f"{self.name} holds vectors of {self.dimensions} dimensions"))))


@dataclass
class Collections:
    """Named collections over a session's tables; an alias may stand for a name."""

    spark: SparkSession
    items: dict[str, Collection] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)

    def create(self, c: Collection, df: DataFrame) -> None:
        if c.name in self.items:
            raise ValueError(f"there is a collection {c.name}")
        c.check(df).createOrReplaceTempView(c.name)
        self.items[c.name] = c

    def get(self, name: str) -> DataFrame:
        return self.spark.table(self.aliases.get(name, name))

    def alias(self, alias: str, name: str) -> None:
        self.aliases[alias] = name

    def drop(self, name: str) -> None:
        self.items.pop(name)
        self.aliases = {a: n for a, n in self.aliases.items() if n != name}
        self.spark.catalog.dropTempView(name)

    def upsert(self, name: str, rows: DataFrame, key: str = "id") -> None:
        """Rows replace those with their key."""
        old = self.get(name)
        self.items[name].check(old.join(rows.select(key), key, "left_anti").unionByName(rows)).createOrReplaceTempView(name)

    def delete(self, name: str, ids: DataFrame, key: str = "id") -> None:
        self.get(name).join(ids.select(key), key, "left_anti").createOrReplaceTempView(name)

    def stats(self) -> DataFrame:
        rows = [(n, c.dimensions, c.metric, self.get(n).count()) for n, c in self.items.items()]
        return self.spark.createDataFrame(rows, "name string, dimensions int, metric string, n bigint")


def plan_nodes(df: DataFrame) -> DataFrame:
    """(node_id, depth, operator) of a physical plan, from the top."""
    text = df._jdf.queryExecution().executedPlan().toString()
    rows = []
    for i, line in enumerate(x for x in text.splitlines() if x.strip()):
        mark = re.match(r"^([\s:+-]*)(?:\*\(\d+\)\s*)?(\w+)", line)
        if mark:
            rows.append((i, len(mark[1]) // 3, mark[2]))
    return df.sparkSession.createDataFrame(rows, "node_id int, depth int, operator string")


#: What an operator costs, as far as a bottleneck is looked for: shuffles most, then joins, sorts and aggregations.
COST = {"Exchange": 10.0, "SortMergeJoin": 6.0, "ShuffledHashJoin": 5.0, "BroadcastNestedLoopJoin": 9.0, "CartesianProduct": 10.0, "Sort": 4.0, "Window": 4.0, "HashAggregate": 3.0, "SortAggregate": 4.0, "FileScan": 3.0}


def bottlenecks(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Operators whose criticality, their cost against the plan's highest, is over the threshold, with their impact, most
    critical first."""
    cost = F.coalesce(F.create_map(*[x for k, v in COST.items() for x in (F.lit(k), F.lit(v))])[F.col("operator")], F.lit(1.0))
    n = plan_nodes(df).withColumn("cost", cost)
    top = n.agg(F.max("cost").alias("top"))
    return n.crossJoin(F.broadcast(top)).withColumn("score", F.col("cost") / F.col("top")).where(F.col("score") > threshold).withColumn("impact", F.col("cost") * F.col("score")).drop("top").orderBy(F.desc("score"), "node_id")


def contract_met(recall: Column, latency_ms: Column, min_cut: Column, least_recall: float, most_latency_ms: float, least_min_cut: float) -> Column:
    """Whether a measurement keeps to a contract, and what it breaks."""
    broken = F.array_compact(F.array(F.when(recall < least_recall, "recall"), F.when(latency_ms > most_latency_ms, "latency"), F.when(min_cut < least_min_cut, "min_cut")))
    return F.struct((F.size(broken) == 0).alias("valid"), broken.alias("broken"))


def grant_votes(votes: DataFrame, total_stake: float) -> DataFrame:
    """(proposal, choice, weight, share) of weighted votes."""
    return votes.groupBy("proposal", "choice").agg(F.sum("weight").alias("weight")).withColumn("share", F.col("weight") / total_stake)
