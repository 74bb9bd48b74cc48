"""Writes as pure functions from tables to the next version of a table, and a store that swaps versions.

Parquet has no MERGE INTO, so an upsert is one full outer join on the key. A version is
in force once its job has left the _SUCCESS mark, which comes last, and the highest such
version is the table: there is no moment without one, and readers see a version whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class UniqueViolation(ValueError):
    """Nodes to create exist already, or come twice."""


def first_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by an explicit order; rows with a null key are left out."""
    w = Window.partitionBy(*keys).orderBy(*order)
    present = rows.where(" and ".join(f"`{k}` is not null" for k in keys))
    return present.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def last_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return first_rows(rows, keys, [F.col(c).desc() for c in order])


def create(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """CREATE under a unique constraint: appends, or fails if a key exists or comes twice."""
    twice = new.groupBy(*keys).count().where("count > 1").select(*keys)
    clash = twice.union(new.select(*keys).join(old.select(*keys), keys, "left_semi").select(*keys))
    if not clash.isEmpty():
        raise UniqueViolation(f"rows with these {', '.join(keys)} exist")
    return old.unionByName(new)


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """CREATE without a constraint: a second run adds the rows again."""
    return old.unionByName(new)


def merge_first(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """MERGE with ON CREATE only: existing rows stay, of new rows the first of each key is added."""
    fresh = first_rows(new, keys, order).select(*old.columns)
    return old.unionByName(fresh.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def merge_last(old: DataFrame, new: DataFrame, keys: list[str], order: list[str], keep: list[str] = ()) -> DataFrame:
    """MERGE with SET: the last new row of each key replaces all but the `keep` columns of an existing row."""
    n = last_rows(new, keys, order)
    o, m = old.alias("o"), n.alias("n")
    joined = o.join(m, [F.col(f"o.`{k}`") == F.col(f"n.`{k}`") for k in keys], "full_outer")
    has_new = F.col(f"n.`{keys[0]}`").isNotNull()
    has_old = F.col(f"o.`{keys[0]}`").isNotNull()
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.coalesce(F.col(f"n.`{c}`"), F.col(f"o.`{c}`")).alias(c))
        elif c in keep:
            out.append(F.when(has_old, F.col(f"o.`{c}`")).otherwise(F.col(f"n.`{c}`")).alias(c))
        else:
            out.append(F.when(has_new, F.col(f"n.`{c}`")).otherwise(F.col(f"o.`{c}`")).alias(c))
    return joined.select(*out)


def patch(old: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Updates only the columns that a change gives a value; keys without a row are ignored."""
    c = changes.select(*keys, *[F.col(x).alias(f"__{x}") for x in changes.columns if x not in keys])
    joined = old.join(c, keys, "left")
    return joined.select(*[F.coalesce(F.col(f"__{x}"), F.col(x)).alias(x) if f"__{x}" in c.columns else F.col(x) for x in old.columns])


def merge_edges(old: DataFrame | None, pairs: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Each (src, dst) once; an end that is null makes no edge."""
    new = pairs.where(f"`{src}` is not null and `{dst}` is not null").dropDuplicates([src, dst])
    return new if old is None else old.unionByName(new.join(old.select(src, dst), [src, dst], "left_anti").select(*old.columns))


def delete(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys.select(*on).distinct(), on, "left_anti").select(*rows.columns)


def deleted_count(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """How many rows a delete of the keys takes away."""
    return rows.join(keys.select(*on).distinct(), on, "left_semi").agg(F.count("*").alias("deleted"))


def detach_delete(nodes: DataFrame, key: str, edges: list[DataFrame], gone: DataFrame, src: str = "src", dst: str = "dst") -> tuple[DataFrame, list[DataFrame]]:
    """Nodes without those gone, and every edge table without edges at either end of them."""
    ids = gone.select(F.col(gone.columns[0]).alias("__gone")).distinct()
    kept = nodes.join(ids, nodes[key] == ids["__gone"], "left_anti")
    return kept, [e.join(ids, e[src] == ids["__gone"], "left_anti").join(ids, F.col(dst) == ids["__gone"], "left_anti") for e in edges]


def finished(fs, path, letter: str) -> list[int]:
    """Numbers of the folders <letter><number> whose writing job has ended well."""
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path) if s.isDirectory()]
    return [int(n[1:]) for p in names if (n := p.getName())[:1] == letter and n[1:].isdigit() and fs.exists(p.suffix("/_SUCCESS"))]


class VersionedTable:
    """A table in a folder of numbered parquet versions; the highest finished one is in force."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int | None:
        return max(finished(self._fs, self._path(self.path), "v"), default=None)

    def read(self) -> DataFrame:
        v = self.version()
        if v is None:
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(f"{self.path}/v{v}")

    def write(self, df: DataFrame, version: int | None = None) -> int:
        """Writes a version. One that is in force or older is not written again, so a repeated batch does nothing; what a broken write left is overwritten."""
        now = self.version()
        new = (0 if now is None else now + 1) if version is None else version
        if now is not None and new <= now:
            return now
        df.write.mode("overwrite").parquet(f"{self.path}/v{new}")
        return new

    def vacuum(self, keep: int = 2) -> list[int]:
        """Deletes all but the newest `keep` finished versions; returns which."""
        gone = sorted(finished(self._fs, self._path(self.path), "v"))[: -max(1, keep)]
        for v in gone:
            self._fs.delete(self._path(f"{self.path}/v{v}"), True)
        return gone

    def drop(self) -> dict[str, str]:
        self._fs.delete(self._path(self.path), True)
        return {"status": "success", "message": "data dropped"}


class MergeLog:
    """A table that takes batches at the cost of the batch: numbered deltas over a base, merged when it is read.

    Of rows with one key that of the lowest batch is in force, and within a batch the
    first by `order`. A batch that was written before is not written again. compact()
    folds finished deltas into a new version of the base now and then; a base says by
    its number which deltas it holds, so a break at any point loses and doubles nothing.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str]):
        self.spark, self.path, self.keys, self.order = spark, path.rstrip("/"), keys, order
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.base = VersionedTable(spark, f"{self.path}/base")

    def deltas(self) -> list[int]:
        """Finished batches that the base doesn't hold."""
        held = self.base.version()
        return sorted(k for k in finished(self._fs, self._path(self.path), "d") if held is None or k > held)

    def append(self, batch: DataFrame, number: int) -> None:
        held = self.base.version()
        if held is not None and number <= held or self._fs.exists(self._path(f"{self.path}/d{number}/_SUCCESS")):
            return
        first_rows(batch, self.keys, self.order).write.mode("overwrite").parquet(f"{self.path}/d{number}")

    def read(self) -> DataFrame:
        held, parts = self.base.version(), []
        if held is not None:
            parts.append(self.base.read().withColumn("__batch", F.lit(-1).cast("long")))
        parts += [self.spark.read.parquet(f"{self.path}/d{k}").withColumn("__batch", F.lit(k).cast("long")) for k in self.deltas()]
        if not parts:
            raise FileNotFoundError(self.path)
        if len(parts) == 1:
            return parts[0].drop("__batch")
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p, allowMissingColumns=True)
        return first_rows(every, self.keys, ["__batch", *self.order]).drop("__batch")

    def compact(self) -> None:
        new = self.deltas()
        if new:
            self.base.write(self.read(), new[-1])

    def vacuum(self) -> None:
        """Deletes what no new reader needs: older bases and the deltas that the base holds."""
        self.base.vacuum(1)
        held = self.base.version()
        for k in finished(self._fs, self._path(self.path), "d"):
            if held is not None and k <= held:
                self._fs.delete(self._path(f"{self.path}/d{k}"), True)
