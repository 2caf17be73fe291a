"""Filling fixed-capacity containers with items.

An item above the capacity is cut into full pieces and a rest; nothing else is divided. From the
global histogram of sizes a dynamic program chooses bucket boundaries that minimise padding (each
item counts as its bucket's boundary). Token-budget batches are then planned on the bucket counts
alone: a batch is opened by the largest bucket with items left, takes as many of that bucket as the
budget allows, and what the budget still holds is topped up from smaller buckets. Repeating the same
batch while counts last keeps the plan short. Items find their place by their rank in their bucket,
which is counted per partition, so no bucket is gathered in one task.

Batches formed strictly inside one bucket can't be well filled where sizes are near the capacity: a
bucket of items above half of it holds one item per container. The top-up is what lets the budget be
used; without ``top_up`` batches stay inside their bucket.

Defined results: a NULL or empty text has no tokens and is left out; repeated keys are items of
their own; an empty table fills no container; a capacity below 1 is an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.scale import materialize


@dataclass(frozen=True)
class FillRules:
    buckets: int = 160
    top_up: bool = True


def bucket_bounds(histogram: np.ndarray, buckets: int) -> np.ndarray:
    """Boundaries (sizes) of at most ``buckets`` buckets with the least total padding, of the exact histogram.

    ``histogram[s]`` is the number of items of size s. With C and W the items and tokens before a size,
    the program is best[k][j] = min over i <= j of best[k-1][i-1] + W_i - s_j C_i, plus s_j C_j+1 - W_j+1.
    The terms in i are lines in s_j whose slopes fall with i while s_j rises, so the least one is found
    on a lower envelope that is walked once: as many steps a round as there are sizes. Whole numbers
    throughout.
    """
    sizes = np.flatnonzero(histogram)
    if len(sizes) <= buckets:
        return sizes
    count = histogram[sizes].astype(np.int64)
    before = [0, *np.cumsum(count).tolist()]
    weight = [0, *np.cumsum(count * sizes).tolist()]
    at, m = sizes.tolist(), len(sizes)
    best = [at[j] * before[j + 1] - weight[j + 1] for j in range(m)]
    came = np.zeros((buckets, m), dtype=np.int32)
    for k in range(1, buckets):
        slopes, heights, starts, head = [], [], [], 0
        now, own = best.copy(), came[k].tolist()
        for j in range(k, m):
            slope, height = -before[j], best[j - 1] + weight[j]
            while len(starts) - head > 1 and (height - heights[-2]) * (slopes[-2] - slopes[-1]) <= (heights[-1] - heights[-2]) * (slopes[-2] - slope):
                slopes.pop(), heights.pop(), starts.pop()
            slopes.append(slope), heights.append(height), starts.append(j)
            x = at[j]
            while len(starts) - head > 1 and slopes[head + 1] * x + heights[head + 1] <= slopes[head] * x + heights[head]:
                head += 1
            now[j] = slopes[head] * x + heights[head] + x * before[j + 1] - weight[j + 1]
            own[j] = starts[head]
        best, came[k] = now, own
    bounds, j, k = [], m - 1, buckets - 1
    while j >= 0:
        bounds.append(at[j])
        if k == 0:
            break
        j, k = (int(came[k, j]) - 1, k - 1) if j >= k else (j, j)
        if len(bounds) > 1 and bounds[-1] == bounds[-2]:
            bounds.pop()
    return np.array(sorted(set(bounds)))


def plan_batches(bounds: np.ndarray, counts: np.ndarray, capacity: int, top_up: bool = True) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repeats, [(bucket, items per container), ...]) until every bucket is empty.

    The plan depends on the bucket counts alone; its length is bounded by the number of buckets
    times the batches in which one can run out.
    """
    left = counts.astype(np.int64).copy()
    plan = []
    for top in range(len(bounds) - 1, -1, -1):
        while left[top] > 0:
            room, batch = capacity, []
            for b in range(top, -1, -1) if top_up else (top,):
                if left[b] <= 0 or bounds[b] > room:
                    continue
                n = int(min(room // bounds[b], left[b]))
                batch.append((b, n))
                room -= n * int(bounds[b])
                if room < bounds[0]:
                    break
            repeats = int(min(left[b] // n for b, n in batch))
            for b, n in batch:
                left[b] -= n * repeats
            plan.append((repeats, batch))
    return plan


def _parts(items: DataFrame, capacity: int) -> DataFrame:
    """One row per part: the item's key, part, size; full pieces first, then the rest."""
    pieces = F.ceil(F.col("tokens") / F.lit(capacity)).cast("int")
    return (
        items.where("tokens > 0")
        .withColumn("part", F.explode(F.sequence(F.lit(0), pieces - 1)))
        .withColumn("size", F.least(F.lit(capacity), F.col("tokens") - F.col("part").cast("bigint") * capacity).cast("int"))
    )


def fill(items: DataFrame, key: str, capacity: int, rules: FillRules = FillRules()) -> DataFrame:
    """Containers for ``items`` (key, tokens): container, key, part, from_token, to_token, size.

    ``items`` should be materialized: it is read twice, for the histogram and for the places.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    spark = items.sparkSession
    parts = _parts(items.select(key, "tokens"), capacity)
    full = parts.where(F.col("size") == capacity)
    rest = parts.where(F.col("size") < capacity)
    got = rest.groupBy("size").agg(F.count("*").alias("n")).toPandas()  # at most `capacity` rows
    exact = np.zeros(capacity + 1, dtype=np.int64)
    exact[got["size"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    at = np.flatnonzero(exact)
    bounds = bucket_bounds(exact, rules.buckets)
    where = np.searchsorted(bounds, np.arange(capacity + 1))
    counts = np.bincount(where[at], weights=exact[at], minlength=len(bounds)).astype(np.int64) if len(at) else np.zeros(0, dtype=np.int64)
    plan = plan_batches(bounds, counts, capacity, rules.top_up)
    # Slots: for each bucket, ranks [first, ...) of a batch lie `n` to a container from container `base`.
    slots: list[list[tuple[int, int, int]]] = [[] for _ in bounds]
    taken, base = [0] * len(bounds), 0
    for repeats, batch in plan:
        for b, n in batch:
            slots[b].append((taken[b], n, base))
            taken[b] += n * repeats
        base += repeats
    tables = [np.array(s, dtype=np.int64).reshape(-1, 3) for s in slots]
    shared = spark.sparkContext.broadcast((where, tables))

    @F.pandas_udf("int")
    def bucket_of(size: pd.Series) -> pd.Series:
        return pd.Series(shared.value[0][size.to_numpy()].astype(np.int32))

    def ranked(rows: DataFrame, column: str) -> DataFrame:
        """Ranks from 0 within ``column``: a count per (split, value) gives each split its offset."""
        split = F.pmod(F.xxhash64(key, "part"), F.lit(splits)).cast("int")
        held = rows.withColumn("_split", split)
        from pyspark.sql import Window as W

        offsets = held.groupBy(column, "_split").agg(F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(W.partitionBy(column).orderBy("_split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        offsets = offsets.select(column, "_split", before.alias("_before"))
        inner = F.row_number().over(W.partitionBy(column, "_split").orderBy(key, "part"))
        return held.withColumn("_inner", inner).join(offsets, [column, "_split"]).withColumn("_rank", F.col("_before") + F.col("_inner") - 1)

    splits = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))

    @F.pandas_udf("bigint")
    def container_of(bucket: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(bucket), dtype=np.int64)
        b, r = bucket.to_numpy(), rank.to_numpy()
        for x in np.unique(b):
            table = shared.value[1][x]
            mine = np.flatnonzero(b == x)
            k = np.searchsorted(table[:, 0], r[mine], side="right") - 1
            out[mine] = table[k, 2] + (r[mine] - table[k, 0]) // table[k, 1]
        return pd.Series(out)

    placed = ranked(rest.withColumn("_bucket", bucket_of("size")), "_bucket").withColumn("container", container_of("_bucket", "_rank"))
    alone = ranked(full.withColumn("_one", F.lit(0)), "_one").withColumn("container", F.col("_rank") + F.lit(base))
    columns = ["container", key, "part", (F.col("part").cast("bigint") * capacity).alias("from_token"), (F.col("part").cast("bigint") * capacity + F.col("size")).alias("to_token"), "size"]
    return placed.select(*columns).unionByName(alone.select(*columns))


def fill_all(items: DataFrame, key: str, containers: DataFrame, rules: FillRules = FillRules()) -> DataFrame:
    """``fill`` for every row of ``containers`` (container_kind, capacity_tokens), a fixed small table."""
    items = materialize(items.select(key, "tokens"), "token-counts")
    out = None
    for row in containers.where("capacity_tokens > 0").orderBy("container_kind").collect():
        one = fill(items, key, int(row["capacity_tokens"]), rules).select(
            F.lit(row["container_kind"]).alias("container_kind"), F.lit(int(row["capacity_tokens"])).alias("capacity_tokens"), "*"
        )
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no container size is given")
    return out


def fill_report(filled: DataFrame) -> DataFrame:
    """container_kind, containers, items, tokens, filled (share of the capacity that is used)."""
    per = filled.groupBy("container_kind", "capacity_tokens", "container").agg(F.sum("size").alias("_t"), F.count("*").alias("_n"))
    return per.groupBy("container_kind", "capacity_tokens").agg(
        F.count("*").alias("containers"), F.sum("_n").alias("items"), F.sum("_t").alias("tokens"), F.max("_t").alias("fullest")
    ).withColumn("filled", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
