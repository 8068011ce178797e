"""Change logs, conflict-free merges, clocks, deltas and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# --- conflict-free types ------------------------------------------------------------------------------------------


def g_counter(events: DataFrame, key: str, replica: str, value: str) -> DataFrame:
    """Per replica the largest count seen, summed: (key, value)."""
    return events.groupBy(key, replica).agg(F.max(value).alias("_v")).groupBy(key).agg(F.sum("_v").alias("value"))


def pn_counter(events: DataFrame, key: str, replica: str, up: str, down: str) -> DataFrame:
    per = events.groupBy(key, replica).agg(F.max(up).alias("_u"), F.max(down).alias("_d"))
    return per.groupBy(key).agg((F.sum("_u") - F.sum("_d")).alias("value"))


def lww(events: DataFrame, key: str, value: str, ts: str, replica: str) -> DataFrame:
    """The latest value a key; of equal times the larger replica wins."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(ts, replica)).alias("value"), F.max(ts).alias("ts"))


def or_set(adds: DataFrame, removes: DataFrame, key: str, element: str, tag: str) -> DataFrame:
    """Elements with an added tag that no removal has seen."""
    return adds.join(removes.select(key, element, tag).distinct(), [key, element, tag], "left_anti").select(key, element).distinct()


def resolve(events: DataFrame, key: str, how: str, value: str = "value", ts: str = "ts", weight: str | None = None) -> DataFrame:
    """One value a key from conflicting writes."""
    v = F.col(value)
    rules = {
        "last": lambda: F.max_by(v, F.struct(F.col(ts), v)), "first": lambda: F.min_by(v, F.struct(F.col(ts), v)), "average": lambda: F.avg(v), "sum": lambda: F.sum(v), "max": lambda: F.max(v), "min": lambda: F.min(v),
        "weighted": lambda: F.sum(v * F.col(weight)) / F.sum(weight), "max_magnitude": lambda: F.max_by(v, F.struct(F.abs(v), v)), "min_magnitude": lambda: F.min_by(v, F.struct(F.abs(v), v)),
    }
    return events.groupBy(key).agg(rules[how]().alias("value"))


def merge_clipped(events: DataFrame, key: str, value: str, low: float, high: float) -> DataFrame:
    return events.groupBy(key).agg(F.greatest(F.lit(low), F.least(F.lit(high), F.sum(value))).alias("value"))


# --- clocks -------------------------------------------------------------------------------------------------------


def clock_order(a: Column, b: Column) -> Column:
    """before, after, equal or concurrent, for vector clocks (maps of counts; missing is 0)."""
    z = F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))))
    le, ge = F.forall(z, lambda d: d <= 0), F.forall(z, lambda d: d >= 0)
    return F.when(le & ge, "equal").when(le, "before").when(ge, "after").otherwise("concurrent")


def clock_merge(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def lamport_receive(own: Column, remote: Column) -> Column:
    """A Lamport clock after a message: one more than the later of both."""
    return F.greatest(own, remote) + 1


_HYBRID = "struct<physical:bigint,logical:bigint,replica:string>"


def _hybrid(physical: Column, logical: Column, replica: Column) -> Column:
    return F.struct(physical.alias("physical"), logical.alias("logical"), replica.alias("replica")).cast(_HYBRID)


def hybrid_now(clock: Column, physical: Column) -> Column:
    """A hybrid clock struct(physical, logical, replica) at a local event: it follows the physical time, or counts on where
    that stands still or runs back. Hybrid clocks are ordered as structs are: by physical, logical, replica."""
    later = physical > clock["physical"]
    return _hybrid(F.when(later, physical).otherwise(clock["physical"]), F.when(later, 0).otherwise(clock["logical"] + 1), clock["replica"])


def hybrid_receive(clock: Column, remote: Column, physical: Column) -> Column:
    """A hybrid clock after a message with ``remote``: the latest of the three times; its count goes on unless the
    physical time is later than both."""
    most = F.greatest(clock["physical"], remote["physical"])
    count = (
        F.when(physical > most, 0)
        .when(clock["physical"] > remote["physical"], clock["logical"] + 1)
        .when(clock["physical"] < remote["physical"], remote["logical"] + 1)
        .otherwise(F.greatest(clock["logical"], remote["logical"]) + 1)
    )
    return _hybrid(F.greatest(most, physical), count, clock["replica"])


# --- vector deltas ------------------------------------------------------------------------------------------------


def delta_capture(old: Column, new: Column, epsilon: float = 0.0) -> Column:
    """struct(idx, dv) array: where and by how much two vectors differ."""
    d = F.zip_with(old, new, lambda x, y: y.cast("double") - x)
    at = F.transform(d, lambda x, i: F.struct(i.alias("idx"), x.alias("dv")))
    return F.filter(at, lambda s: F.abs(s["dv"]) > epsilon)


def delta_apply(v: Column, delta: Column) -> Column:
    m = F.map_from_entries(delta)
    return F.transform(v, lambda x, i: x.cast("double") + F.coalesce(F.try_element_at(m, i), F.lit(0.0)))


def delta_compose(a: Column, b: Column) -> Column:
    m = F.map_zip_with(F.map_from_entries(a), F.map_from_entries(b), lambda k, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))
    return F.filter(F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("idx"), e["value"].alias("dv")))), lambda s: s["dv"] != 0)


def delta_inverse(d: Column) -> Column:
    return F.transform(d, lambda s: F.struct(s["idx"].alias("idx"), (-s["dv"]).alias("dv")))


def fold_deltas(deltas: DataFrame, key: str) -> DataFrame:
    """One delta a key from many (key, delta): summed by position before the shuffle."""
    e = deltas.select(key, F.explode("delta").alias("d")).groupBy(key, F.col("d.idx").alias("idx")).agg(F.sum("d.dv").alias("dv"))
    return e.where("dv != 0").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "dv"))).alias("delta"))


# --- logs ---------------------------------------------------------------------------------------------------------


def log_entries(events: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Change events with a checksum of each entry."""
    body = F.to_json(F.struct(*[c for c in events.columns]))
    return events.withColumn("checksum", F.sha2(body.cast("binary"), 256))


def log_valid(log: DataFrame) -> DataFrame:
    """Entries whose checksum doesn't fit their content."""
    rest = [c for c in log.columns if c != "checksum"]
    return log.where(F.sha2(F.to_json(F.struct(*rest)).cast("binary"), 256) != F.col("checksum"))


def log_since(log: DataFrame, sequence: int) -> DataFrame:
    return log.where(F.col("sequence") > sequence)


def log_truncate(log: DataFrame, before: int) -> DataFrame:
    """The log without entries before a sequence number."""
    return log.where(F.col("sequence") >= before)


def log_range(log: DataFrame, low: int, high: int) -> DataFrame:
    return log.where(F.col("sequence").between(low, high))


def replay(state: DataFrame, log: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A table after its change log: the last operation a key wins; deletes remove."""
    last = log.groupBy(key).agg(F.max_by(F.struct("operation", *columns), "sequence").alias("_l"))
    new = last.where("_l.operation != 'delete'").select(key, *[F.col(f"_l.{c}").alias(c) for c in columns])
    return state.select(key, *columns).join(last.select(key), key, "left_anti").unionByName(new)


class Snapshots:
    """Point-in-time copies of tables, as Parquet directories under a root."""

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def create(self, df: DataFrame, name: str, snapshot_id: str) -> None:
        df.write.mode("errorifexists").parquet(f"{self.root}/{name}/{snapshot_id}")

    def restore(self, name: str, snapshot_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/{snapshot_id}")

    def list(self, name: str) -> list[str]:
        fs, p = self._fs(f"{self.root}/{name}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, name: str, snapshot_id: str) -> None:
        fs, p = self._fs(f"{self.root}/{name}/{snapshot_id}")
        fs.delete(p, True)

    def cleanup(self, name: str, keep: int) -> list[str]:
        gone = self.list(name)[:-keep] if keep else self.list(name)
        for s in gone:
            self.delete(name, s)
        return gone
