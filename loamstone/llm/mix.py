"""Mixing sources to target weights by Pareto order sampling.

For each mix the total size is the largest at which every source that exists can give its share of
tokens within its cap on repeats. A source's need is first met by whole copies of all its records;
the rest is a sample without replacement. A record's inclusion odds fall with the number of exact
copies of its text, so that each distinct text is about as likely whatever its number of copies
(expected copies of a record are never above the cap). Records are ranked by the Pareto key
u/(1-u) * (1-p)/p, u being a hash of the record's key, and taken in that order until the tokens are
met. The cut is found on histograms of the key in two rounds, so no source is sorted in one task.

Defined results: a source absent from the records can't be met: its share is spread over the mix's
other sources and reported as 0; a source in no mix is left out; NULL and empty texts have no tokens
and are left out; a cap below 1 leaves its source out; repeated keys are one record.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamstone.scale import materialize


@dataclass(frozen=True)
class MixRules:
    seed: int = 20260101
    bins: int = 1024


def plan_mix(targets: list[dict], totals: dict[str, int]) -> list[dict]:
    """Per (mix, source): share, cap, need in tokens, whole copies and the rest to sample."""
    plan = []
    for mix in sorted({t["mix_name"] for t in targets}):
        rows = [t for t in targets if t["mix_name"] == mix]
        there = [t for t in rows if totals.get(t["source"], 0) > 0 and t["max_repeats"] >= 1 and t["target_share"] > 0]
        whole_share = sum(t["target_share"] for t in there)
        size = min((totals[t["source"]] * t["max_repeats"] / (t["target_share"] / whole_share) for t in there), default=0.0)
        for t in rows:
            held = totals.get(t["source"], 0)
            need = size * t["target_share"] / whole_share if t in there else 0.0
            copies = int(need // held) if held else 0
            rest = need - copies * held if held else 0.0
            if held and rest < 1.0:
                rest = 0.0
            if held and rest > held - 1.0:
                copies, rest = copies + 1, 0.0
            plan.append(t | {"tokens_held": held, "need": need, "copies": copies, "rest": rest, "size": size})
    return plan


def inclusion_factor(weights: np.ndarray, tokens: np.ndarray, rest: float) -> float:
    """c with sum(tokens * min(1, c * weight)) = rest; the classes are (weight, tokens of that weight)."""
    order = np.argsort(-weights)
    w, t = weights[order], tokens[order].astype(float)
    certain = 0.0
    for k in range(len(w)):
        c = (rest - certain) / float((w[k:] * t[k:]).sum())
        if c * w[k] <= 1.0:
            return c
        certain += t[k]
    return float(1.0 / w.min())


def _cut(rows: DataFrame, group: list[str], rest: DataFrame, bins: int, rounds: int = 2) -> DataFrame:
    """The rows of each group in order of (q, key) while the tokens before them are below ``rest``.

    q lies in [0, 1). Each round adds up tokens per bin, takes whole bins below the crossing and
    looks into the crossing bin only; what is left of it is a window over a share of bins**-rounds.
    """
    now = rows.withColumn("_low", F.lit(0.0)).withColumn("_before", F.lit(0.0))
    taken = None
    for k in range(1, rounds + 1):
        width = 1.0 / bins**k
        binned = now.withColumn("_bin", F.least(F.floor((F.col("q") - F.col("_low")) / width), F.lit(bins - 1)).cast("int"))
        sums = binned.groupBy(*group, "_bin").agg(F.sum("tokens").cast("double").alias("_t"), F.first("_low").alias("_l"), F.first("_before").alias("_b"))
        running = F.coalesce(F.sum("_t").over(W.partitionBy(*group).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        state = sums.withColumn("_start", F.col("_b") + running).join(rest, group)
        state = state.withColumn("_whole", F.col("_start") + F.col("_t") <= F.col("rest")).withColumn("_open", ~F.col("_whole") & (F.col("_start") < F.col("rest")))
        state = state.where("_whole or _open").select(*group, "_bin", "_start", "_whole", (F.col("_l") + F.col("_bin") * width).alias("_next"))
        met = binned.join(F.broadcast(state), [*group, "_bin"])  # at most groups * bins rows
        done = met.where("_whole").select(*rows.columns)
        taken = done if taken is None else taken.unionByName(done)
        now = met.where(~F.col("_whole")).withColumn("_low", F.col("_next")).withColumn("_before", F.col("_start")).select(*rows.columns, "_low", "_before")
    before = F.coalesce(F.sum("tokens").over(W.partitionBy(*group).orderBy("q", "key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = now.withColumn("_sum", F.col("_before") + before).join(F.broadcast(rest), group)
    # The row that crosses is taken where that comes nearer to the rest.
    last = last.where((F.col("_sum") < F.col("rest")) & (F.col("rest") - F.col("_sum") >= F.col("tokens") / 2))
    return taken.unionByName(last.select(*rows.columns))


def weighted(items: DataFrame) -> DataFrame:
    """key, source, tokens, same (exact copies of the text in the source): ``items`` has key, source, tokens, look."""
    same = items.groupBy("source", "look").agg(F.count("*").alias("same")).where("same > 1")
    return items.join(same, ["source", "look"], "left").select("key", "source", "tokens", F.coalesce("same", F.lit(1)).alias("same"))


def mixed(items: DataFrame, targets: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """mix_name, key, source, tokens, copies: how often each record occurs in each mix (only copies > 0).

    ``items``: key, source, tokens, look (a 128-bit hash of the text); ``targets``: the fixed small table of mixes.

    A mix is as large as its scarcest source allows: the size at which that source, repeated as often as
    it may be, gives exactly its share.
    """
    spark = items.sparkSession
    counted = materialize(items.select("key", "source", "tokens", "look"), "token-counts")  # texts are read and counted once
    rows = materialize(weighted(counted.where("tokens > 0").dropDuplicates(["key"])), "weighted")
    # Of the sources of the targets only; a source of n records has at most sqrt(2 n) different numbers of copies.
    wanted = F.broadcast(targets.select("source").distinct())
    classes = rows.join(wanted, "source", "left_semi").groupBy("source", "same").agg(F.sum("tokens").alias("tokens")).toPandas()
    totals = classes.groupby("source")["tokens"].sum().to_dict()
    plan = plan_mix([r.asDict() for r in targets.dropDuplicates(["mix_name", "source"]).collect()], totals)
    steps = []
    for p in plan:
        factor = 0.0
        if p["rest"] > 0:
            own = classes[classes["source"] == p["source"]]
            factor = float(inclusion_factor(1.0 / own["same"].to_numpy(dtype=float), own["tokens"].to_numpy(dtype=float), p["rest"]))
        steps.append((p["mix_name"], p["source"], p["copies"], float(p["rest"]), factor))
    steps_df = spark.createDataFrame(steps, "mix_name string, source string, whole int, rest double, factor double").where("whole > 0 or rest > 0")
    met = rows.join(F.broadcast(steps_df), "source")
    u = (F.pmod(F.xxhash64("key", "mix_name", F.lit(rules.seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    p = F.least(F.lit(1.0), F.col("factor") / F.col("same"))
    odds = u / (1 - u) * (1 - p) / p
    drawn = met.where("rest > 0").select("mix_name", "source", "key", "tokens", (odds / (1 + odds)).alias("q"))
    rest = steps_df.where("rest > 0").select("mix_name", "source", "rest")
    sample = _cut(drawn, ["mix_name", "source"], rest, rules.bins).select("mix_name", "source", "key", "tokens", F.lit(1).alias("copies"))
    whole = met.where("whole > 0").select("mix_name", "source", "key", "tokens", F.col("whole").alias("copies"))
    return whole.unionByName(sample).groupBy("mix_name", "source", "key", "tokens").agg(F.sum("copies").cast("int").alias("copies")).select(
        "mix_name", "key", "source", "tokens", "copies"
    )


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_name, source, target_share, max_repeats, records, tokens, most_copies, actual_share for every target."""
    per = mix.groupBy("mix_name", "source").agg(
        F.count("*").alias("records"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies")
    )
    all_of = W.partitionBy("mix_name")
    full = targets.join(per, ["mix_name", "source"], "left").fillna(0, ["records", "tokens", "most_copies"])
    return full.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(all_of)), F.lit(0.0)))
