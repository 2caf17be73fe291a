"""The two candidate legs: exact vector top-k and two-field BM25 top-k for batches of searches.

Records are scanned where they lie. Each task scores its records against a bounded block of searches,
keeps its own top k of each search, and only those leave the task. They are ranked in two levels, so
that a task of the first sees a part of a search's rows and the second a fixed number of them. No
pair of record and search is ever a row.

Rows of one id are deliveries of one record, with equal values: scores are taken on the rows as they
lie, and only the few rows that leave a task are told apart by id.

A search sees a record if it is live at the search's time and within the search's closed time range.
Scores are rounded to 9 digits and ties go to the smaller id, so results do not depend on the order
of summation or on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamstone.config import EngineConfig
from loamstone.functions.fields import Terms
from loamstone.scale import materialize, salt_of

BLOCK = 2048
ROWS = 1024
CELLS = 1 << 18
TERMS = 200_000
TINY = 1e-300  # every term of a search adds more than that
SALTS = 64


def blocks_of(searches: DataFrame, columns: list[str], size: int = BLOCK) -> Iterator[list[dict]]:
    """The searches in blocks of at most ``size`` rows; the driver holds one block at a time."""
    block: list[dict] = []
    for row in searches.select(*columns).toLocalIterator():
        block.append(row.asDict())
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def groups_of(blocks: Iterator[list[dict]], most_terms: int) -> Iterator[tuple[list[list[dict]], list[str]]]:
    """Blocks of searches together with their terms, as long as those stay below ``most_terms``; a block is never divided."""
    held: list[list[dict]] = []
    terms: set[str] = set()
    for block in blocks:
        own = {t for q in block for t in q["terms"]}
        if held and len(terms | own) > most_terms:
            yield held, sorted(terms)
            held, terms = [], set()
        held.append(block)
        terms |= own
    if held:
        yield held, sorted(terms)


class _Seen:
    """Which rows a search sees: live at its time, and within its range of times if it has one."""

    def __init__(self, pdf: pd.DataFrame, since: np.ndarray, until: np.ndarray, now: np.ndarray):
        self.at, self.expires = (pdf[name].to_numpy(dtype=float) for name in ("timestamp_epoch", "expires_at"))
        self.since, self.until, self.now = since, until, now
        self.open = ~(np.isfinite(since) | np.isfinite(until))

    def _told(self, at, expires, since, until, now, open_) -> np.ndarray:
        return (np.isnan(expires) | (expires > now)) & (open_ | ((at >= since) & (at <= until)))

    def cells(self, row: np.ndarray, search: np.ndarray) -> np.ndarray:
        return self._told(self.at[row], self.expires[row], self.since[search], self.until[search], self.now[search], self.open[search])

    def matrix(self) -> np.ndarray:
        return self._told(self.at[:, None], self.expires[:, None], self.since, self.until, self.now, self.open)


class _Best:
    """The best k rows of each search seen so far, each id once."""

    def __init__(self, k: np.ndarray):
        self.k, self.least = k, np.full(len(k), -np.inf)
        self.search, self.score, self.name = np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=object)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, scores: np.ndarray, names: np.ndarray, seen: _Seen, floor: float) -> None:
        """Take in the rows of a matrix rows x searches that are seen and score at least ``floor``.

        Once the searches have k rows each, few cells reach their least one: only those are looked at
        further. While many do, the k-th best of these rows bounds each search first.
        """
        least = np.maximum(self.least - 1e-9, floor)  # scores are rounded below
        row, search = np.nonzero(scores >= least[None, :])
        if len(row) > CELLS:
            scores = np.where(seen.matrix(), scores, -np.inf)
            rows, most = len(scores), int(self.k.max(initial=1)) + int(pd.Series(names).duplicated().sum())
            if rows > most:  # a row below a search's k-th best of these has no place
                least = np.maximum(least, np.partition(scores, rows - most, axis=0)[rows - most] - 1e-9)
            row, search = np.nonzero(scores >= least[None, :])
        else:
            inside = seen.cells(row, search)
            row, search = row[inside], search[inside]
        if not len(row):
            return
        self.waiting.append((search, np.round(scores[row, search], 9), names[row]))
        if sum(len(x) for x, _, _ in self.waiting) > max(CELLS, len(self.search)):
            self.settle()

    def settle(self) -> None:
        """Keep the k best of the rows held and waiting; of equal scores, the smaller id."""
        search, score, name = (np.concatenate(x) for x in zip((self.search, self.score, self.name), *self.waiting))
        self.waiting = []
        order = np.lexsort((name.astype(str), -score, search))
        search, score, name = search[order], score[order], name[order]
        new = np.ones(len(search), dtype=bool)
        new[1:] = (search[1:] != search[:-1]) | (name[1:] != name[:-1])
        search, score, name = search[new], score[new], name[new]
        first = np.searchsorted(search, np.arange(len(self.k)))
        place = np.arange(len(search)) - first[search]
        keep = place < self.k[search]
        self.search, self.score, self.name = search[keep], score[keep], name[keep]
        full = np.bincount(self.search, minlength=len(self.k)) >= self.k
        last = np.searchsorted(self.search, np.arange(len(self.k)), side="right") - 1
        self.least = np.where(full & (last >= 0), self.score[np.maximum(last, 0)] if len(self.score) else -np.inf, -np.inf)


def _search_block(records: DataFrame, block: list[dict], scorer: Callable[[pd.DataFrame], np.ndarray], floor: float) -> DataFrame:
    names = np.array([q["query_id"] for q in block], dtype=object)
    k = np.array([q["k"] for q in block], dtype=np.int64)
    number = lambda key, default: np.array([default if q[key] is None else q[key] for q in block], dtype=float)
    since, until, now = number("since_epoch", -np.inf), number("until_epoch", np.inf), number("now_epoch", -np.inf)

    def scan(batches):
        best = _Best(k)
        for pdf in batches:
            for start in range(0, len(pdf), ROWS):
                part = pdf.iloc[start : start + ROWS]
                best.add(scorer(part), part["id"].to_numpy(dtype=object), _Seen(part, since, until, now), floor)
        best.settle()
        yield pd.DataFrame({"query_id": names[best.search], "id": best.name, "score": best.score, "k": k[best.search].astype(np.int32)})

    return records.mapInPandas(scan, "query_id string, id string, score double, k int")


def _ranked(parts: list[DataFrame]) -> DataFrame:
    """The k best of the rows that left the tasks: of a salt's rows first, then of what those leave."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = out.withColumn("_salt", salt_of(F.col("id"), SALTS))
    near = W.partitionBy("query_id", "_salt").orderBy(F.desc("score"), "id")
    # Equal rows are one record found in several tasks: they share a dense rank, and the first stays.
    out = out.withColumn("_place", F.dense_rank().over(near)).withColumn("_again", F.lag("id").over(near))
    out = out.where((F.col("_place") <= F.col("k")) & ~F.coalesce(F.col("_again") == F.col("id"), F.lit(False)))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("leg_rank", place).where("leg_rank <= k").select("query_id", "id", "score", "leg_rank")


EMPTY = "query_id string, id string, score double, leg_rank int"


def knn(records: DataFrame, searches: DataFrame) -> DataFrame:
    """query_id, id, score (cosine similarity), leg_rank of the k nearest records of each search.

    ``records``: id, embedding, timestamp_epoch, expires_at; ``searches``: query_id, qvec, k,
    since_epoch, until_epoch, now_epoch. Records or searches without a vector take no part.
    """
    held = records.where(F.col("id").isNotNull() & F.col("embedding").isNotNull()).select("id", "embedding", "timestamp_epoch", "expires_at")
    parts = []
    for block in blocks_of(searches.where(F.col("qvec").isNotNull()), ["query_id", "qvec", "k", "since_epoch", "until_epoch", "now_epoch"]):
        wanted = np.array([q["qvec"] for q in block], dtype=float)
        wanted /= np.maximum(np.linalg.norm(wanted, axis=1, keepdims=True), 1e-300)

        def scorer(pdf: pd.DataFrame, wanted=wanted) -> np.ndarray:
            vectors = np.array(pdf["embedding"].to_list(), dtype=float)
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            return (vectors / np.maximum(norms, 1e-300)) @ wanted.T

        parts.append(_search_block(held, block, scorer, -1e300))
    return _ranked(parts) if parts else records.sparkSession.createDataFrame([], EMPTY)


POSTINGS = "id string, timestamp_epoch double, expires_at double, long_0 int, long_1 int, terms array<int>, often_0 array<int>, often_1 array<int>"


def _counts(terms: list[list[int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term) as one number in order, how often each occurs, and the number of terms of each row."""
    lengths = np.fromiter(map(len, terms), dtype=np.int64, count=len(terms))
    number = np.fromiter(chain.from_iterable(terms), dtype=np.int64, count=int(lengths.sum()))
    row = np.repeat(np.arange(len(terms)), lengths)
    return *np.unique((row * width + number)[number >= 0], return_counts=True), lengths


def postings(records: DataFrame, vocabulary: list[str]) -> DataFrame:
    """id, times, the lengths of both fields and, for the terms of ``vocabulary`` that occur, how often in each field.

    One row per record; the texts of two deliveries never meet, only these narrow rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, width = Terms(vocabulary), max(1, len(vocabulary))
        for batch in batches:
            told = [terms.of(text) for text in batch.column("content").to_pylist()]
            sides = [_counts([pair[k] for pair in told], width) for k in (0, 1)]
            cells = np.unique(np.concatenate([cell for cell, _, _ in sides]))
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(cells // width, minlength=batch.num_rows)))).astype(np.int32))
            often = []
            for cell, count, _ in sides:
                full = np.zeros(len(cells), dtype=np.int32)
                full[np.searchsorted(cells, cell)] = count
                often.append(pa.ListArray.from_arrays(offsets, pa.array(full)))
            lengths = [pa.array(length.astype(np.int32)) for _, _, length in sides]
            columns = [batch.column(name) for name in ("id", "timestamp_epoch", "expires_at")]
            columns += [*lengths, pa.ListArray.from_arrays(offsets, pa.array((cells % width).astype(np.int32))), *often]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "timestamp_epoch", "expires_at", "long_0", "long_1", "terms", "often_0", "often_1"])

    held = records.where(F.col("id").isNotNull()).select("id", F.col("timestamp_epoch").cast("double"), F.col("expires_at").cast("double"), "content")
    return held.mapInArrow(run, POSTINGS).dropDuplicates(["id"])


def _flat(lists: pd.Series) -> np.ndarray:
    return np.concatenate(lists.to_list()) if len(lists) else np.zeros(0, dtype=np.int64)


def bm25(records: DataFrame, searches: DataFrame, cfg: EngineConfig) -> DataFrame:
    """query_id, id, score, leg_rank of the k best records of each search by two-field BM25.

    ``records``: id, content, timestamp_epoch, expires_at; ``searches``:
    query_id, terms, k, since_epoch, until_epoch, now_epoch. Frequencies and mean lengths are taken
    over all records, before any filter of a search.

    Texts are tokenized once for as many blocks of searches as ask for at most ``TERMS`` terms together,
    or for one block: what is kept of a record are its lengths and those terms. A block's terms come from
    at most ``BLOCK`` searches of ``search_query_max_chars`` characters, so what a task holds is bounded.
    """
    spark = records.sparkSession
    parts = []
    blocks = blocks_of(searches.where(F.size("terms") > 0), ["query_id", "terms", "k", "since_epoch", "until_epoch", "now_epoch"])
    for group, vocabulary in groups_of(blocks, TERMS):
        number = {t: i for i, t in enumerate(vocabulary)}
        held = materialize(postings(records, vocabulary), "postings")
        total, *means = held.agg(F.count("*"), F.avg("long_0"), F.avg("long_1")).first()
        each = held.select(F.explode(F.arrays_zip("terms", "often_0", "often_1")).alias("x")).groupBy(F.col("x.terms").alias("term"))
        found = each.agg(F.count_if(F.col("x.often_0") > 0).alias("df_0"), F.count_if(F.col("x.often_1") > 0).alias("df_1")).collect()  # the group's terms
        idf = np.zeros((2, len(vocabulary)))
        for row in found:
            for k in (0, 1):
                idf[k, row["term"]] = np.log(1 + (total - row[f"df_{k}"] + 0.5) / (row[f"df_{k}"] + 0.5))
        scales = [(weight, float(mean or 0.0)) for weight, mean in zip((cfg.content_weight, cfg.ngram_weight), means)]
        matching = held.where(F.size("terms") > 0)
        parts += [_search_block(matching, block, _bm25_scorer(spark, block, number, idf, scales, cfg), TINY) for block in group]
    return _ranked(parts) if parts else spark.createDataFrame([], EMPTY)


def _bm25_scorer(spark, block: list[dict], number: dict[str, int], idf: np.ndarray, scales: list[tuple[float, float]], cfg: EngineConfig):
    """Scores of rows of ``postings`` for a block of searches: 0 where a row has none of a search's terms."""
    pairs = np.array(sorted({(number[t], j) for j, q in enumerate(block) for t in q["terms"]}), dtype=np.int64)
    starts = np.searchsorted(pairs[:, 0], np.arange(len(number) + 1))
    shared = spark.sparkContext.broadcast((starts, pairs[:, 1], idf))  # the searches of each term, from starts[term] on
    width = len(block)

    def scorer(pdf: pd.DataFrame) -> np.ndarray:
        starts, asking, idf = shared.value
        lists = pdf["terms"]
        row, term = np.repeat(np.arange(len(pdf)), lists.map(len).to_numpy(dtype=np.int64)), _flat(lists)
        weight = np.zeros(len(term))
        for k, (share, mean) in enumerate(scales):
            often = _flat(pdf[f"often_{k}"]).astype(float)
            scale = cfg.bm25_k1 * (1 - cfg.bm25_b + cfg.bm25_b * pdf[f"long_{k}"].to_numpy(dtype=float)[row] / max(mean, 1e-300))
            weight += share * idf[k, term] * often * (cfg.bm25_k1 + 1) / (often + scale)
        many = starts[term + 1] - starts[term]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[term], many)
        cell = np.repeat(row, many) * width + asking[at]
        return np.bincount(cell, weights=np.repeat(weight, many), minlength=len(pdf) * width).reshape(len(pdf), width)

    return scorer
