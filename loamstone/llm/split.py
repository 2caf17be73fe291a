"""Splitting oversized items at natural boundaries.

One dynamic program over boundary positions serves two ends. ``best_split`` minimises cut
penalties plus size imbalance under a maximum length and a specified overlap. ``stored_split``
runs the same recurrence with its transitions limited to the pieces that are stored; when no path
reaches the end, the stored split is invalid and the item is split anew.

Defined results: a NULL or empty body has no pieces; a body within the limit is one piece; ties go
to the earlier cut; repeated rows of one id count once; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_TYPE = "array<struct<no:int,start:int,end:int,text:string>>"
PREFIX = r"^\[(user|claude)( [0-9]+/[0-9]+)?\] "
BODY_PREFIX = r"^\[(user|claude)\] "


@dataclass(frozen=True)
class SplitRules:
    """Limits and the penalties of cutting after each kind of boundary."""

    max_chars: int = 400
    overlap: int = 100
    paragraph: float = 0.0
    line: float = 0.15
    sentence: float = 0.3
    space: float = 0.9
    sign: float = 1.2
    inside: float = 6.0
    imbalance: float = 1.0
    per_piece: float = 0.5

    def __post_init__(self):
        if not 0 <= self.overlap < self.max_chars:
            raise ValueError("overlap must be at least 0 and below max_chars")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each BMP character: 1 letter or digit, 2 white space, 3 sentence end, 0 other."""
    table = np.zeros(0x10000, dtype=np.uint8)
    for code in range(0x10000):
        ch = chr(code)
        if ch.isalnum():
            table[code] = 1
        elif ch.isspace():
            table[code] = 2
    for ch in ".!?。！？…":
        table[ord(ch)] = 3
    return table


def _classify(body: str) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = _classes()[np.minimum(codes, 0xFFFF)]
    for at in np.flatnonzero(codes > 0xFFFF):
        kinds[at] = 1 if chr(codes[at]).isalnum() else 0
    return codes, kinds


def boundaries(body: str, rules: SplitRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions after which a cut is allowed, their penalties, and which positions are natural.

    A cut between two letters or digits is allowed only where the ``overlap`` characters before it
    hold no white space.
    """
    n = len(body)
    codes, kinds = _classify(body)
    penalty = np.full(n + 1, np.inf)
    left, right = kinds[:-1], kinds[1:]
    inner = penalty[1:n]
    alnum_both = (left == 1) & (right == 1)
    inner[~alnum_both] = rules.sign
    inner[(left == 2) & (right != 2)] = rules.space
    cjk_end = (codes[:-1] > 0x2FFF) & (left == 3)
    inner[cjk_end & (right != 2)] = rules.sentence
    after = np.flatnonzero((left[1:] == 2) & (left[:-1] == 3) & (right[1:] != 2)) + 1
    inner[after] = rules.sentence
    newline = codes[:-1] == 10
    inner[newline] = rules.line
    inner[np.flatnonzero(newline[1:] & newline[:-1]) + 1] = rules.paragraph
    natural = np.isfinite(penalty)
    spaces = np.concatenate(([0], np.cumsum(kinds == 2)))
    at = np.flatnonzero(alnum_both) + 1
    lonely = at[spaces[at] == spaces[np.maximum(at - rules.overlap, 0)]]
    penalty[lonely] = rules.inside
    penalty[0] = penalty[n] = 0.0
    natural[0] = natural[n] = True
    positions = np.flatnonzero(np.isfinite(penalty))
    return positions, penalty[positions], natural


def piece_starts(ends: np.ndarray, natural: np.ndarray, overlap: int) -> np.ndarray:
    """Where the piece after each end starts: the first natural place in the overlap's earlier half, else the whole overlap back."""
    n = len(natural) - 1
    if not overlap:
        return ends.copy()
    following = np.where(natural, np.arange(n + 1), n + 1)
    following = np.minimum.accumulate(following[::-1])[::-1]
    earliest = np.maximum(ends - overlap, 0)
    start = following[earliest]
    start = np.where(start <= ends - overlap // 2, start, earliest)
    start[ends == 0] = 0
    return start


def best_split(body: str, rules: SplitRules) -> tuple[list[tuple[int, int]], float]:
    """The cheapest pieces as (start, end), and their cost."""
    n = len(body)
    if n == 0:
        return [], 0.0
    if n <= rules.max_chars:
        return [(0, n)], 0.0
    ends, penalty, natural = boundaries(body, rules)
    starts = piece_starts(ends, natural, rules.overlap)
    count = math.ceil((n - rules.overlap) / (rules.max_chars - rules.overlap))
    target = min(rules.max_chars, (n + (count - 1) * rules.overlap) / count)
    m = len(ends)
    cost = np.full(m, np.inf)
    cost[0] = 0.0
    came = np.zeros(m, dtype=np.int64)
    lows = np.searchsorted(starts, ends - rules.max_chars, side="left")
    scale = rules.imbalance / (target * target)
    for j in range(1, m):
        low = lows[j]
        if low >= j:
            continue
        off = ends[j] - target - starts[low:j]
        total = cost[low:j] + (scale * off) * off
        best = int(total.argmin())
        cost[j] = total[best] + penalty[j] + rules.per_piece
        came[j] = low + best
    if not np.isfinite(cost[-1]):
        raise ValueError("no split within the limit")
    pieces, j = [], m - 1
    while j > 0:
        i = int(came[j])
        pieces.append((int(starts[i]), int(ends[j])))
        j = i
    return pieces[::-1], float(cost[-1])


def stored_split(body: str, pieces: list[str], rules: SplitRules) -> list[tuple[int, int]] | None:
    """The recurrence with its transitions limited to the stored ``pieces``; None where no path reaches the end.

    All positions at which a piece can lie are kept, so a body that repeats itself is judged right.
    """
    n, kinds = len(body), None
    reached: dict[int, tuple[tuple[int, int], ...]] = {0: ()}
    for no, piece in enumerate(pieces):
        size, last = len(piece), no == len(pieces) - 1
        if not 1 <= size <= rules.max_chars:
            return None
        forth: dict[int, tuple[tuple[int, int], ...]] = {}
        for end, path in reached.items():
            for start in range(end, max(end - rules.overlap, 0) - 1, -1) if no else (0,):
                stop = start + size
                if stop <= end or stop > n or stop in forth or not body.startswith(piece, start):
                    continue
                if not last and stop < n and body[stop - 1].isalnum() and body[stop].isalnum() and any(ch.isspace() for ch in piece[max(0, size - rules.overlap) :]):
                    continue
                forth[stop] = (*path, (start, stop))
        if not forth:
            return None
        reached = forth
    return list(reached[n]) if pieces and n in reached else None


def _resplit(rules: SplitRules):
    def run(batches):
        for pdf in batches:
            origins, costs, out = [], [], []
            for body, count, ids, stored in zip(pdf["_body"], pdf["chunk_count"], pdf["chunk_ids"], pdf["_stored"]):
                found = None
                if ids is not None and len(ids) and not pd.isna(count) and int(count) == len(ids) and stored is not None:
                    texts: list[str | None] = [None] * len(ids)
                    clash = False
                    for x in stored:
                        if texts[x["no"]] is not None and texts[x["no"]] != x["text"]:
                            clash = True
                        texts[x["no"]] = x["text"]
                    if not clash and all(x is not None for x in texts):
                        found = stored_split(body, texts, rules)
                if found is not None:
                    spans, cost = found, 0.0
                else:
                    spans, cost = best_split(body, rules)
                origins.append("stored" if found is not None else "new")
                costs.append(cost)
                out.append([{"no": k, "start": a, "end": b, "text": body[a:b]} for k, (a, b) in enumerate(spans)])
            yield pd.DataFrame({"id": pdf["id"], "origin": origins, "cost": costs, "pieces": out})

    return run


def oversized(docs: DataFrame, rules: SplitRules) -> DataFrame:
    """The bodies above the limit, one row per id: id, _body, chunk_count, chunk_ids."""
    body = F.regexp_replace("content", BODY_PREFIX, "")
    return (
        docs.select("id", body.alias("_body"), "chunk_count", "chunk_ids")
        .where(F.col("id").isNotNull() & (F.length("_body") > rules.max_chars))
        .dropDuplicates(["id"])
    )


def resplit(docs: DataFrame, records: DataFrame, rules: SplitRules = SplitRules()) -> DataFrame:
    """Every oversized body with its pieces: the stored ones if they are a valid split, else new ones.

    The named pieces are joined to the ids that name them, so a group is never larger than one
    body's own list of ids, whatever a parent_id holds.
    """
    large = oversized(docs, rules)
    named = large.select("id", F.posexplode("chunk_ids").alias("_no", "_piece"))
    held = records.where(F.col("parent_id") != "").select(
        F.col("id").alias("_piece"), F.col("parent_id").alias("_parent"), F.regexp_replace("content", PREFIX, "").alias("_text")
    )
    stored = (
        named.join(held, (named["_piece"] == held["_piece"]) & (named["id"] == held["_parent"]))
        .groupBy("id")
        .agg(F.collect_set(F.struct(F.col("_no").alias("no"), F.col("_text").alias("text"))).alias("_stored"))
    )
    return large.join(stored, "id", "left").mapInPandas(_resplit(rules), f"id string, origin string, cost double, pieces {PIECE_TYPE}")


def split_all(docs: DataFrame, rules: SplitRules = SplitRules()) -> DataFrame:
    """Every oversized body split anew, one row per piece: id, no, piece_start, piece_end, text."""

    def run(batches):
        for pdf in batches:
            rows = [(i, k, a, b, body[a:b]) for i, body in zip(pdf["id"], pdf["_body"]) for k, (a, b) in enumerate(best_split(body, rules)[0])]
            yield pd.DataFrame(rows, columns=["id", "no", "piece_start", "piece_end", "text"])

    return oversized(docs, rules).select("id", "_body").mapInPandas(run, "id string, no int, piece_start int, piece_end int, text string")
