"""Near-duplicate records with small edits.

Word sets are compared exactly (shared words / all words >= threshold). Records of one word set are
one class. The classes are dealt into shards such that any two similar classes meet in at least one
shard, and each shard is searched by a signature tree.

* Shards: all words are counted, and those of at least a floor share are known to every task (their
  number is bounded by the floor, not by the data). Words are ordered by share, rarest first; words
  below the floor come before them. Two similar sets share their first common word within each set's
  prefix, their second within the prefix plus one, and so on. A combination of first common words is
  a shard key once the product of its shares is rare; a frequent one is extended by a further word.
  Shares don't change with the size of a collection, so neither does the number of keys. The words
  of a key are limited by the set's size so that it has at most about ``max_keys``; sets whose
  possible partners have another limit take the keys of both. No partner is lost to a frequency.
* Shards are counted exactly. One of more than ``block_rows`` rows is dealt into cells of a window of
  time and a class of sizes: partners lie in the same or in neighbouring ones. Only a cell that is
  still larger becomes pairs of blocks, so no task holds an unbounded group.
* Trees: within a shard, sorted classes are the leaves of a tree whose nodes hold the OR of their
  256-bit word bitmaps and their ranges of size and time. A dual traversal from (root, root) drops
  node pairs whose greatest possible overlap is below the least that the sizes need. All trees of a
  batch are traversed level by level together.
* Surviving pairs of classes are checked on their whole word sets, then expanded to members within
  the time window, bucketed by time and salted by member.

Defined results: NULL id, content or time has no partner; rows of one id count once; ties and
repeated texts are partners of similarity 1; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.operators.components import components
from loamstone.scale import materialize

WORDS = 4  # 64-bit words of a bitmap


@dataclass(frozen=True)
class NearRules:
    threshold: float = 0.8
    min_chars: int = 100
    window_seconds: float = 604800.0
    rare: int = 96
    rare_share: float = 4e-4
    max_words_in_key: int = 4
    max_keys: int = 512
    block_rows: int = 20000
    members_per_salt: int = 4000

    def least_overlap(self, sizes: np.ndarray) -> np.ndarray:
        """The fewest shared words that sets of ``sizes`` words together need."""
        t = self.threshold
        return np.ceil(t / (1 + t) * sizes - 1e-9)


def eligible(records: DataFrame, rules: NearRules) -> DataFrame:
    """id, at, words (sorted 64-bit hashes of the distinct words), cls (128-bit hash of the words)."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    return (
        records.where(
            F.col("id").isNotNull()
            & F.col("timestamp_epoch").isNotNull()
            & (F.coalesce("parent_id", F.lit("")) == "")
            & (F.length("content") >= rules.min_chars)
        )
        .select("id", F.col("timestamp_epoch").alias("at"), F.array_sort(F.transform(words, lambda w: F.xxhash64(w))).alias("words"))
        .where(F.size("words") > 0)
        .withColumn("cls", F.unhex(F.md5(F.concat_ws(",", F.col("words").cast("array<string>")))))
    )


WORDS_OF_FLOOR = 64  # sets longer than this on average raise the floor, so that the words above it stay bounded


@dataclass(frozen=True)
class Shares:
    """Shares of the frequent words among all classes; ``floor`` stands for every other word."""

    names: np.ndarray
    shares: np.ndarray
    rare: float
    floor: float

    def of(self, words: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return np.full(len(words), self.floor)
        at = np.minimum(np.searchsorted(self.names, words), len(self.names) - 1)
        return np.where(self.names[at] == words, self.shares[at], self.floor)


def word_shares(classes: DataFrame, rules: NearRules) -> Shares:
    """The words above the floor, from exact counts: at most WORDS_OF_FLOOR / rare_share of them, whatever the data's size."""
    held = classes.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size("words")), F.lit(0.0)).alias("mean")).first()
    total = max(1, held["n"])
    rare = max(rules.rare / total, rules.rare_share)
    floor = rare * max(1.0, held["mean"] / WORDS_OF_FLOOR)
    counts = classes.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    got = counts.where(F.col("n") > floor * total).orderBy("word").toPandas()
    names = got["word"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(names)
    return Shares(names[order], got["n"].to_numpy(dtype=float)[order] / total, rare, floor)


def _mix(a: int, b: int) -> int:
    x = (a ^ (b + 0x9E3779B97F4A7C15 + ((a << 6) & 0xFFFFFFFFFFFFFFFF) + (a >> 2))) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 29)


def _prefix(n: int, threshold: float) -> int:
    return n - math.ceil(threshold * n - 1e-9) + 1


def _depth(n: int, rules: NearRules) -> int:
    """The most words in a key of a set of n words: combinations stay below ``max_keys``, and partners have as many in common."""
    prefix = _prefix(n, rules.threshold)
    depth = 1
    while depth < rules.max_words_in_key and math.comb(prefix + depth, depth + 1) <= rules.max_keys and depth + 1 <= math.ceil(rules.threshold * n - 1e-9):
        depth += 1
    return depth


@lru_cache(maxsize=100_000)
def depths_of(n: int, rules: NearRules) -> tuple[int, ...]:
    """The limits of all sizes that a partner of a set of n words can have."""
    least, most = max(1, math.ceil(rules.threshold * n - 1e-9)), math.floor(n / rules.threshold + 1e-9)
    if n < 100:
        return tuple(sorted({_depth(m, rules) for m in range(least, most + 1)}))
    return tuple(range(_depth(most, rules), _depth(least, rules) + 1))  # of sizes that large, the larger has the lower limit


def shard_keys(words: np.ndarray, share: np.ndarray, rare: float, rules: NearRules) -> list[int]:
    """The shard keys of one word set; ``share`` holds the words' shares (``Shares.of``)."""
    n = len(words)
    limit = _prefix(n, rules.threshold)
    depths = depths_of(n, rules)
    order = np.lexsort((words, share))[: min(n, limit + depths[-1] - 1)]
    names, shares = words[order].tolist(), share[order].tolist()
    keys: list[int] = []

    def extend(key: int, p: float, at: int, depth: int) -> None:
        for i in range(at, min(limit + depth, n)):
            k = _mix(key, names[i])
            q = p * shares[i]
            if q <= rare:
                keys.append(k)
                continue
            if depth + 1 in depths:
                keys.append(k)
            if depth + 1 < depths[-1]:
                extend(k, q, i + 1, depth + 1)

    extend(0x51ED270B, 1.0, 0, 0)
    return keys


def bitmap(words: np.ndarray) -> np.ndarray:
    bits = (words >> np.uint64(20)) & np.uint64(255)
    out = np.zeros(WORDS, dtype=np.uint64)
    np.bitwise_or.at(out, (bits >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bits & np.uint64(63)))
    return out


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=1).astype(np.int64)


def search_forest(segments: np.ndarray, maps: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray, rules: NearRules, fan: int = 4, step: int = 200_000):
    """Yield (i, j) arrays of rows that share a segment and may be similar, i before j.

    ``segments`` are non-decreasing; each run of equal values is one tree. Node pairs are dropped by
    ranges of size and time and by the greatest overlap that their bitmaps allow.
    """
    n = len(segments)
    if n < 2:
        return
    starts = np.flatnonzero(np.concatenate(([True], segments[1:] != segments[:-1])))
    lengths = np.diff(np.append(starts, n))
    lost = sizes - _bits(maps)  # words that share a bit with another of the row
    levels = [{"maps": maps, "least": sizes, "most": sizes, "low": low, "high": high, "lost": lost}]
    first, count = [starts], [lengths]
    kids: list[np.ndarray] = [np.zeros(0, dtype=np.int64)]
    while count[-1].max() > 1:
        below = levels[-1]
        up = (count[-1] + fan - 1) // fan
        base = np.concatenate(([0], np.cumsum(up)[:-1]))
        within = np.arange(up.sum()) - np.repeat(base, up)
        cuts = np.repeat(first[-1], up) + within * fan
        levels.append(
            {
                "maps": np.bitwise_or.reduceat(below["maps"], cuts, axis=0),
                "least": np.minimum.reduceat(below["least"], cuts),
                "most": np.maximum.reduceat(below["most"], cuts),
                "low": np.minimum.reduceat(below["low"], cuts),
                "high": np.maximum.reduceat(below["high"], cuts),
                "lost": np.maximum.reduceat(below["lost"], cuts),
            }
        )
        kids.append(np.append(cuts, len(below["least"])))
        first.append(base)
        count.append(up)
    height = np.zeros(len(starts), dtype=np.int64)
    for level in range(len(levels)):
        height[(count[level] > 1)] = level + 1
    t, window = rules.threshold, rules.window_seconds

    def keep(level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = levels[level]
        ok = (x["most"][a] >= t * x["least"][b] - 1e-9) & (x["most"][b] >= t * x["least"][a] - 1e-9)
        ok &= (x["low"][a] - x["high"][b] <= window) & (x["low"][b] - x["high"][a] <= window)
        at = np.flatnonzero(ok)
        a, b = a[at], b[at]
        need = rules.least_overlap(x["least"][a] + x["least"][b])
        if level == 0:
            ma, mb = x["maps"][a], x["maps"][b]
            best = np.minimum(x["most"][a] - _bits(ma & ~mb), x["most"][b] - _bits(mb & ~ma))
        else:
            best = _bits(x["maps"][a] & x["maps"][b]) + np.minimum(x["lost"][a], x["lost"][b])
        return at[best >= need]

    def descend(level: int, a: np.ndarray, b: np.ndarray):
        """Pairs of nodes of ``level`` down to pairs of rows."""
        for k in range(0, len(a), step):
            x, y = a[k : k + step], b[k : k + step]
            ok = keep(level, x, y)
            x, y = x[ok], y[ok]
            if not len(x):
                continue
            if level == 0:
                yield x, y
                continue
            cut = kids[level]
            nx, ny = cut[x + 1] - cut[x], cut[y + 1] - cut[y]
            many = nx * ny
            who = np.repeat(np.arange(len(x)), many)
            local = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            i = cut[x][who] + local // ny[who]
            j = cut[y][who] + local % ny[who]
            fit = (i < j) if level == 1 else (i <= j)
            yield from descend(level - 1, i[fit], j[fit])

    for level in range(len(levels) - 1, 0, -1):
        roots = first[level][height == level]
        yield from descend(level, roots, roots)


def _unsigned(words) -> np.ndarray:
    return np.asarray(words, dtype=np.int64).view(np.uint64)


def class_table(rows: DataFrame, rules: NearRules) -> DataFrame:
    """One row per word set: cls, words, low and high time, the windows of time it occurs in, members."""
    return rows.groupBy("cls").agg(
        F.first("words").alias("words"), F.min("at").alias("low"), F.max("at").alias("high"),
        F.collect_set(F.floor(F.col("at") / rules.window_seconds)).alias("windows"), F.count("*").alias("members"),
    )


SHARD = "shard bigint, cls binary, map binary, size int, low double, high double"


def _above(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The values of ``key`` on more than ``most`` rows, with their number of rows."""
    return rows.groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") > most)


def _in_cells(shards: DataFrame, rules: NearRules) -> DataFrame:
    """Rows of large shards, once for each cell of time and size that a partner may be in, too."""
    width = math.log(1 / rules.threshold) + 1e-9  # a little wider, so that partners are never two classes apart
    size_class = F.floor(F.log(F.col("size").cast("double")) / width)
    spread = shards.withColumn("_w", F.explode(F.array_distinct(F.concat("windows", F.transform("windows", lambda w: w + 1)))))
    spread = spread.withColumn("_s", F.explode(F.array(size_class, size_class + 1)))
    return spread.withColumn("shard", F.xxhash64("shard", "_w", "_s")).drop("_w", "_s")


def _in_block_pairs(cells: DataFrame, large: DataFrame, rules: NearRules) -> DataFrame:
    """Rows of cells that are still large, once for each pair of blocks that holds their own."""
    blocks = F.ceil(F.col("_rows") / rules.block_rows)
    spread = cells.join(large, "shard").withColumn("_mine", F.pmod(F.xxhash64("cls"), blocks))
    spread = spread.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    return spread.withColumn("shard", F.xxhash64("shard", F.least("_mine", "_other"), F.greatest("_mine", "_other"))).drop("_rows", "_mine", "_other")


def split_shards(shards: DataFrame, keys: DataFrame, classes: DataFrame, rules: NearRules) -> DataFrame:
    """``shards`` with those of more than ``block_rows`` rows divided; ``keys`` holds the shard of every row."""
    large = materialize(_above(keys, "shard", rules.block_rows), "large-shards")
    if large.isEmpty():
        return shards
    held = shards.join(large.select("shard"), "shard", "left_semi").join(classes.select("cls", "windows"), "cls")
    cells = materialize(_in_cells(held, rules).select(*shards.columns), "cells")
    still = materialize(_above(cells, "shard", rules.block_rows), "large-cells")
    rest = shards.join(large.select("shard"), "shard", "left_anti")
    fit = cells.join(still.select("shard"), "shard", "left_anti")
    return rest.unionByName(fit).unionByName(_in_block_pairs(cells, still, rules))


def candidate_pairs(classes: DataFrame, rules: NearRules) -> DataFrame:
    """Pairs of classes (a, b) that survive the signature trees, each once, a < b."""
    shared = classes.sparkSession.sparkContext.broadcast(word_shares(classes, rules))

    def keys_of(column) -> list[list[int]]:
        if not len(column):
            return []
        known = shared.value
        sets = [_unsigned(row) for row in column]
        shares = np.split(known.of(np.concatenate(sets)), np.cumsum([len(w) for w in sets])[:-1])
        return [shard_keys(w, p, known.rare, rules) for w, p in zip(sets, shares)]

    def only_keys(batches):
        for pdf in batches:
            yield pd.DataFrame({"shard": np.array([k for ks in keys_of(pdf["words"]) for k in ks], dtype=np.uint64).view(np.int64)})

    def deal(batches):
        """A row for every key of a class."""
        for pdf in batches:
            keys = keys_of(pdf["words"])
            row = np.repeat(np.arange(len(pdf)), [len(k) for k in keys])
            maps = np.empty(len(pdf), dtype=object)
            maps[:] = [bitmap(_unsigned(w)).tobytes() for w in pdf["words"]]
            size = pdf["words"].map(len).to_numpy()
            yield pd.DataFrame(
                {
                    "shard": np.array([k for ks in keys for k in ks], dtype=np.uint64).view(np.int64),
                    "cls": pdf["cls"].to_numpy()[row],
                    "map": maps[row],
                    "size": size[row].astype(np.int32),
                    "low": pdf["low"].to_numpy()[row],
                    "high": pdf["high"].to_numpy()[row],
                }
            )

    shards = classes.select("cls", "words", "low", "high").mapInPandas(deal, SHARD)
    keys = classes.select("words").mapInPandas(only_keys, "shard bigint")
    shards = split_shards(shards, keys, classes, rules)

    def search(batches):
        held: list[pd.DataFrame] = []
        rows = 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            last = pdf["shard"].iloc[-1] if len(pdf) else None
            if rows < 100_000:
                continue
            whole = pd.concat(held, ignore_index=True)
            ready = int(np.searchsorted(whole["shard"].to_numpy(), last, side="left"))
            if ready:
                yield from found(whole.iloc[:ready])
            held = [whole.iloc[ready:]]
            rows = len(held[0])
        if rows:
            yield from found(pd.concat(held, ignore_index=True))

    def found(pdf):
        shard = pdf["shard"].to_numpy()
        maps = np.frombuffer(b"".join(pdf["map"]), dtype=np.uint64).reshape(-1, WORDS)
        size = pdf["size"].to_numpy().astype(np.int64)
        order = np.lexsort((maps[:, 0], size, shard))
        cls = pdf["cls"].to_numpy()[order]
        for i, j in search_forest(shard[order], maps[order], size[order], pdf["low"].to_numpy()[order], pdf["high"].to_numpy()[order], rules):
            a, b = cls[i], cls[j]
            swap = np.fromiter((x > y for x, y in zip(a, b)), dtype=bool, count=len(a))
            out = pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b)})
            yield out[out["a"] != out["b"]].drop_duplicates()

    return shards.repartition("shard").sortWithinPartitions("shard").mapInPandas(search, "a binary, b binary").distinct()


def similar_classes(classes: DataFrame, rules: NearRules) -> DataFrame:
    """a, b: pairs of different word sets that reach the threshold, checked on the whole sets."""
    pairs = candidate_pairs(classes, rules)
    left = classes.select(F.col("cls").alias("a"), F.col("words").alias("wa"))
    right = classes.select(F.col("cls").alias("b"), F.col("words").alias("wb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    return both.withColumn("_shared", shared).where(
        F.col("_shared") >= rules.threshold * (F.size("wa") + F.size("wb") - F.col("_shared")) - 1e-9
    ).select("a", "b")


def near_stages(records: DataFrame, rules: NearRules):
    """(members, classes, pairs of similar classes), each written once to the shared folder."""
    rows = eligible(records, rules).dropDuplicates(["id"])
    rows = materialize(rows, "word-sets")
    classes = materialize(class_table(rows, rules), "classes")
    pairs = materialize(similar_classes(classes, rules), "similar-classes")
    return rows.select("cls", "id", "at"), classes, pairs


def near_pairs(records: DataFrame, rules: NearRules = NearRules()) -> DataFrame:
    """id_a < id_b: pairs of records within the time window whose word sets reach the threshold."""
    members, classes, pairs = near_stages(records, rules)
    copies = classes.where("members > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    pairs = pairs.unionByName(copies)
    salts = F.ceil(F.col("members") / rules.members_per_salt).cast("int")
    involved = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    involved = involved.join(classes.select("cls", salts.alias("salts")), "cls")
    bucket = F.floor(F.col("at") / rules.window_seconds)
    placed = members.join(involved, "cls").withColumn("bucket", bucket)
    left = (
        pairs.join(placed.select(F.col("cls").alias("a"), F.col("id").alias("id_x"), F.col("at").alias("at_x"), F.col("bucket").alias("_b")), "a")
        .join(involved.select(F.col("cls").alias("b"), F.col("salts").alias("_s")), "b")
        .withColumn("bucket", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
        .select("a", "b", "id_x", "at_x", "bucket", "salt")
    )
    right = placed.select(F.col("cls").alias("b"), F.col("id").alias("id_y"), F.col("at").alias("at_y"), "bucket", F.pmod(F.xxhash64("id"), "salts").cast("int").alias("salt"))
    met = left.join(right, ["b", "bucket", "salt"]).where(
        (F.abs(F.col("at_x") - F.col("at_y")) <= rules.window_seconds) & ((F.col("a") != F.col("b")) | (F.col("id_x") < F.col("id_y")))
    )
    return met.select(F.least("id_x", "id_y").alias("id_a"), F.greatest("id_x", "id_y").alias("id_b"))


def near_groups(records: DataFrame, rules: NearRules = NearRules()) -> DataFrame:
    """id, group_id (smallest id), newest_id, members for each record that has a partner.

    Members of one class in one half-window bucket are all partners, so each (class, bucket) is one
    node with its range of times; two nodes are linked if their ranges come within the window. No
    pair of members is emitted.
    """
    members, classes, pairs = near_stages(records, rules)
    placed = materialize(members.withColumn("bucket", F.floor(F.col("at") / (rules.window_seconds / 2))), "placed")
    nodes = materialize(
        placed.groupBy("cls", "bucket").agg(
            F.min("id").alias("node"), F.min("at").alias("low"), F.max("at").alias("high"), F.max(F.struct("at", "id")).alias("newest"), F.count("*").alias("n")
        ),
        "nodes",
    )
    both = pairs.unionByName(classes.where("members > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b")))
    left = both.join(nodes.select(F.col("cls").alias("a"), F.col("node").alias("src"), F.col("low").alias("la"), F.col("high").alias("ha"), F.col("bucket").alias("_b")), "a")
    left = left.withColumn("bucket", F.explode(F.sequence(F.col("_b") - 3, F.col("_b") + 3)))
    right = nodes.select(F.col("cls").alias("b"), "bucket", F.col("node").alias("dst"), F.col("low").alias("lb"), F.col("high").alias("hb"))
    edges = left.join(right, ["b", "bucket"]).where(
        (F.col("la") - F.col("hb") <= rules.window_seconds) & (F.col("lb") - F.col("ha") <= rules.window_seconds)
    )
    # Ranges that come near hold a pair within the window: each bucket is half a window wide.
    names = components(edges.where("src <> dst").select("src", "dst"))
    named = nodes.join(names, "node", "left").withColumn("group_id", F.coalesce("component", "node"))
    groups = named.groupBy("group_id").agg(F.max("newest").alias("newest"), F.sum("n").alias("members")).where("members > 1")
    told = named.join(groups.select("group_id", F.col("newest.id").alias("newest_id"), "members"), "group_id").select("cls", "bucket", "group_id", "newest_id", "members")
    return placed.join(told, ["cls", "bucket"]).select("id", "group_id", "newest_id", "members")
