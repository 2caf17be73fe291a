"""Search results as text blocks of limited size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loamstone.config import EngineConfig
from loamstone.functions import text as T

# The parts of a block.
HEADER = "# Recalled Memory Context"
SOURCE = "Source: working memory of seven days"
NOTICE = "> ⚠️ notice: "
VERSION_LINE = "_If several versions of the same content appear, the one with the newest `saved` time is the current one._"
NO_HITS = "_No memories found._"
WEAK_HEADING = "#### Possibly related (weak matches — may be unrelated)"
CUT_LINE = "_(cut here to keep this block within the context limit.)_"
BETWEEN = "\n\n---\n\n"
LEAST_ROWS = 3


def omitted_line(count: int) -> str:
    return f"_({count} lower-ranked match(es) omitted to keep this block within the context limit.)_"


def sizes(text: str) -> np.ndarray:
    """Size of each character: its UTF-16 units, a line end one more."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return 1 + (codes > 0xFFFF) + (codes == 10)


@F.pandas_udf(StringType())
def _three_digits(score: pd.Series) -> pd.Series:
    """Rounded from the number's exact value; the JVM's formatter rounds its shortest decimal form."""
    return score.map("{:.3f}".format, na_action="ignore")


def row_text() -> Column:
    """A result row: kind, id, turn, score, time and text."""
    tag = F.when(F.col("is_doc"), F.concat(F.lit("[doc×"), F.coalesce("chunk_count", F.lit(0)).cast("string"), F.lit("] "))).otherwise(F.lit(""))
    turn = F.when(F.coalesce("turn_id", F.lit("")) != "", F.concat(F.lit(" turn="), F.col("turn_id"))).otherwise(F.lit(""))
    score = _three_digits(F.col("score"))
    head = F.concat(F.lit("### "), tag, F.lit("["), F.col("id"), F.lit("]"), turn, F.lit(" score="), score, F.lit(" saved="), T.fmt_saved(F.col("timestamp_epoch")))
    return F.concat(head, F.lit("\n"), T.purify(F.coalesce("content", F.lit(""))))


def _size(text: str) -> int:
    return int(sizes(text).sum())


def block(rows: list[str], weak: list[str], limit: int | None = None, head: str = "", tail: str = "") -> str:
    """One search's block of at most ``limit`` (its size plus two), between ``head`` and ``tail``.

    With the running size of the rows the size of every block that shows the first m of them is
    known at once; the greatest m that fits is shown, at least ``LEAST_ROWS``. If none fits, the
    text is cut where the running size of its characters reaches what is left for it.
    """
    n = len(rows)
    below = "\n\n".join(["", WEAK_HEADING, "\n\n".join(weak)]) if weak else ""
    least = min(n, LEAST_ROWS)
    shown = np.arange(least, n + 1)
    running = np.concatenate(([0], np.cumsum([_size(BETWEEN + row) for row in rows], dtype=np.int64)))
    opening = head + (VERSION_LINE + "\n\n" if n else NO_HITS)
    told = ["" if m == n else "\n\n" + omitted_line(n - m) for m in shown.tolist()]
    first = _size(BETWEEN) if n else 0  # the first row has no line before it
    total = running[shown] - first + np.array([_size(line) for line in told]) + _size(opening + below + tail) + 2
    fitting = np.flatnonzero(total <= limit) if limit else np.array([n - least])
    k = int(fitting[-1]) if len(fitting) else 0
    text = opening + BETWEEN.join(rows[: shown[k]]) + told[k] + below
    if len(fitting):
        return text + tail
    end = f"\n\n{CUT_LINE}{tail}"
    kept = int(np.searchsorted(np.cumsum(sizes(text)), limit - _size(end) - 2, side="right"))
    return text[: max(kept, len(head))].rstrip() + end


def block_head(query: Column) -> Column:
    """The heading of a block that a search's text opens, its line ends as spaces."""
    return F.concat(F.lit(f"{HEADER}\n{SOURCE}\nSearch query: "), F.regexp_replace(query, r"\r\n|\n|\r", " "), F.lit("\n\n"))


def block_of_line(line: str, notices: tuple[str, ...] = ()) -> str:
    """A block without rows: notices and one line, the line of no results where nothing else is told."""
    return "\n\n".join([f"{HEADER}\n{SOURCE}", *(NOTICE + text for text in notices), line]) + "\n"


def rendered(results: DataFrame, cfg: EngineConfig) -> DataFrame:
    """query_id, block of every search with results (at most limit + min_results rows each)."""
    limit = cfg.context_max_chars

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        weak = pdf["weak"].astype(bool)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[:1], "block": [block(pdf["_row"][~weak].tolist(), pdf["_row"][weak].tolist(), limit)]})

    return results.select("query_id", "rank", "weak", row_text().alias("_row")).groupBy("query_id").applyInPandas(run, "query_id string, block string")
