"""Range sharding by sampled splitters.

Every record has a weight, its size in bytes, and a point: its key columns and a hash of
the record, written as bytes that sort as the typed values do. A sample of points is
drawn with probability in proportion to weight, its weighted quantiles are the
boundaries, and records go to the range of their point. The ranges' true sizes are then
counted over all records; ranges over the target are subdivided by sampling within them,
so that one hot key spreads over several shards, until none is left that can be cut.

Points and weights are written once and all rounds read those, not the records. The
sample is bounded whatever the size of the data, as rounds mend what it gets wrong; the
boundaries, one a shard, are the only thing on the driver and in the tasks that grows
with it, some tens of bytes each.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxweave.runtime import prepare

TARGET, OVERSAMPLE, SLACK, SAMPLE = 16_000_000, 64, 1.25, 1_000_000
_SIGN = np.uint64(1 << 63)


def _integers(x: np.ndarray) -> list[bytes]:
    raw = (x.astype(np.int64).view(np.uint64) ^ _SIGN).astype(">u8").tobytes()
    return [raw[k : k + 8] for k in range(0, len(raw), 8)]


def _floats(x: np.ndarray) -> list[bytes]:
    x = np.where(np.isnan(x), np.nan, x.astype(np.float64)) + 0.0  # one NaN, above all else, and one zero
    bits = x.view(np.uint64)
    raw = np.where(np.isnan(x), ~np.uint64(0), np.where(bits >> np.uint64(63) == 1, ~bits, bits | _SIGN)).astype(">u8").tobytes()
    return [raw[k : k + 8] for k in range(0, len(raw), 8)]


def ordered(column: pa.Array) -> list[bytes]:
    """Bytes of each value that sort as the values do, nulls first; none is the start of another."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    t, valid = column.type, column.is_valid().to_pylist()
    if pa.types.is_struct(t):
        parts = [ordered(pc.struct_field(column, k)) for k in range(t.num_fields)]
        return [(b"\1" + b"".join(p)) if v else b"\0" for v, *p in zip(valid, *parts)] if parts else [b"\1" if v else b"\0" for v in valid]
    if pa.types.is_floating(t):
        body = _floats(column.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False))
    elif pa.types.is_string(t) or pa.types.is_large_string(t) or pa.types.is_binary(t) or pa.types.is_large_binary(t):
        body = [(v or b"").replace(b"\0", b"\0\xff") + b"\0\0" for v in column.cast(pa.large_binary()).to_pylist()]
    elif pa.types.is_decimal(t):
        body = [(int(v.scaleb(t.scale)) + (1 << 127)).to_bytes(16, "big") for v in column.fill_null(0).to_pylist()]
    elif pa.types.is_boolean(t):
        body = _integers(column.fill_null(False).to_numpy(zero_copy_only=False))
    elif pa.types.is_integer(t) or pa.types.is_date(t) or pa.types.is_timestamp(t) or pa.types.is_duration(t) or pa.types.is_null(t):
        wide = pa.int32() if pa.types.is_date32(t) else pa.int64()
        body = _integers((column if not pa.types.is_null(t) else pa.nulls(len(column), pa.int64())).cast(wide).fill_null(0).to_numpy(zero_copy_only=False))
    else:
        raise TypeError(f"records can't be ordered by a column of {t}")
    return [b"\1" + b if v else b"\0" for b, v in zip(body, valid)]


def _point() -> Callable[..., Column]:
    def point(*cols: pa.Array) -> pa.Array:
        return pa.array([b"".join(p) for p in zip(*map(ordered, cols))], pa.binary())

    return F.arrow_udf(point, "binary")


def _place(bounds: list[bytes]) -> Callable[..., Column]:
    """Number of boundaries at or below the point of the columns."""

    def place(*cols: pa.Array) -> pa.Array:
        return pa.array([bisect_right(bounds, b"".join(p)) for p in zip(*map(ordered, cols))], pa.int32())

    return F.arrow_udf(place, "int")


def _place_point(bounds: list[bytes]) -> Callable[..., Column]:
    return F.arrow_udf(lambda p: pa.array([bisect_right(bounds, x) for x in p.to_pylist()], pa.int32()), "int")


def _quantiles(drawn: DataFrame, within: list[str], parts: Column) -> DataFrame:
    """(p, *within): points at which the running weight of a range passes a multiple of its share."""
    by = Window.partitionBy(*within).orderBy("p", "w") if within else Window.orderBy("p", "w")
    whole = Window.partitionBy(*within) if within else Window.partitionBy()
    run = drawn.withColumn("to", F.sum("w").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("w").over(whole)).withColumn("parts", parts)
    passed = lambda x: F.floor(x * F.col("parts") / F.col("all") + 1e-9)
    return run.where((passed(F.col("to")) > passed(F.col("to") - F.col("w"))) & (passed(F.col("to")) < F.col("parts"))).select(*within, "p").distinct()


def _draw(light: DataFrame, share: Column, seed: int) -> DataFrame:
    """A record is drawn with probability w / share, once at most; one that weighs more than a share is drawn surely and counts by its weight."""
    unit = F.shiftrightunsigned(F.xxhash64("p", "w", F.lit(seed)), 11) / F.lit(float(1 << 53))
    return light.withColumn("share", share).where(unit < F.col("w") / F.col("share")).withColumn("w", F.greatest("w", "share"))


def boundaries(light: DataFrame, target: int, slack: float = SLACK, oversample: int = OVERSAMPLE, sample: int = SAMPLE) -> list[bytes]:
    """Sorted boundaries of points between ranges none of which weighs over slack * target, unless it is of one point.

    light: p, w. At most about `sample` rows are drawn at a time, whatever the number
    of ranges.
    """
    total = light.agg(F.sum("w")).first()[0] or 0.0
    shards = max(1, round(total / target))
    if shards < 2:
        bounds: list[bytes] = []
    else:
        drawn = _draw(light, F.lit(total / min(shards * oversample, max(sample, shards))), 7)
        bounds = sorted(bytes(r["p"]) for r in _quantiles(drawn, [], F.lit(shards)).collect())
    seed = 11
    while True:
        placed = light.withColumn("shard", _place_point(bounds)("p"))
        sized = placed.groupBy("shard").agg(F.sum("w").alias("w"), F.min("p").alias("low"), F.max("p").alias("high"))
        over = {r["shard"]: r for r in sized.where((F.col("w") > slack * target) & (F.col("low") < F.col("high"))).collect()}
        if not over:
            return bounds
        parts = {s: max(2, round(r["w"] / target)) for s, r in over.items()}
        each = max(2.0, min(oversample, sample / sum(parts.values())))
        of = light.sparkSession.createDataFrame([(s, parts[s], float(r["w"] / (parts[s] * each))) for s, r in over.items()], "shard int, parts int, share double")
        within = placed.join(F.broadcast(of), "shard")  # a row for each range that is too large
        drawn = _draw(within.withColumn("given", F.col("share")), F.col("given"), seed)
        new = {s: [] for s in over}
        for r in _quantiles(drawn, ["shard"], F.col("parts")).collect():
            if bytes(r["p"]) > bytes(over[r["shard"]]["low"]):
                new[r["shard"]].append(bytes(r["p"]))
        bounds = sorted({*bounds, *(p for s, ps in new.items() for p in (ps or [bytes(over[s]["high"])]))})
        seed += 1


def shard(docs: DataFrame, keys: list[str], weight: Column | None = None, target: int = TARGET, spread: list[str] | None = None, slack: float = SLACK, oversample: int = OVERSAMPLE, physical: bool = True) -> DataFrame:
    """All rows and columns of docs with `shard`, the number of the row's range.

    Ranges follow the order of the keys as they are typed, numbers by value and strings
    by bytes, nulls first, and within a key a hash of `spread` (all other columns, if
    not given). No range weighs over slack * target but one of a single record or of
    rows that are equal in keys and spread. Null or empty texts weigh 1. Repeated rows
    share a shard. If docs has a column `shard`, the new one is named `shard_1` (and so
    on). An empty table gives an empty result. With `physical`, partition k holds
    shard k and nothing else.
    """
    prepare(docs.sparkSession)
    name = "shard"
    taken, k = {c.lower() for c in docs.columns}, 0
    while name in taken:
        k += 1
        name = f"shard_{k}"
    w = (weight if weight is not None else F.octet_length(F.col("text"))).cast("double")
    x = F.xxhash64(*[F.col(c) for c in (spread or [c for c in docs.columns if c not in keys])])
    point = [*(F.col(c) for c in keys), x]
    light = docs.select(_point()(*point).alias("p"), F.greatest(F.coalesce(w, F.lit(1.0)), F.lit(1.0)).alias("w")).checkpoint()
    bounds = boundaries(light, target, slack, oversample)
    out = docs.withColumn(name, _place(bounds)(*point))
    return out.repartitionById(len(bounds) + 1, F.col(name)) if physical else out
