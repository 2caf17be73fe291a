"""Text cut off by field limits.

Intact texts are cut artificially to get positives, and a logistic regression on hashed features is
fitted to tell both apart: the closing characters and words, closing punctuation by the kind of
block the text ends in, open brackets, quotes and fences, the shape of the last lines, and the
length's distance to a limit of its source. A limit is a length at which far more distinct texts of
a source lie than at the lengths around it; it is found on all rows. Every record is scored.

The model alone weighs a limit: artificial cuts at limits have the share among all that the peaks of
all rows have among the cut texts, and a whole text that lies at one is an example with the share of
texts that chance puts there.

The model is fitted on a bounded sample (``CutRules.train_docs``, by hash of the key, each cut
``cuts`` times, at no more than ``train_limits`` limits of its source); statistics and scores cover
all rows and whole texts. Rows of the sample that look cut already (unparsable, an open fence) give
no negatives; negatives that a model fitted on the other folds, without a look at limits, finds cut
are dropped before the last fit.

Defined results: a NULL or blank text is not cut (score 0); a NULL layout or source is a value of
its own; repeated keys are scored each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamstone.scale import materialize

@dataclass(frozen=True)
class CutRules:
    train_docs: int = 6000
    train_limits: int = 64
    cuts: int = 3
    bits: int = 18
    rounds: int = 700
    fold_rounds: int = 110
    step: float = 0.35
    l2: float = 2e-6
    prior: float = 0.03
    folds: int = 3
    doubt: float = 0.5
    seed: int = 7


def _class(ch: str) -> str:
    if ch.isdigit():
        return "0"
    if ch.isalpha():
        return "c" if ord(ch) > 0x2FFF else "A" if ch.isupper() else "a"
    return ch


_RUNS = re.compile(r"[^\W\d_]+|\d+|\s+")
_WORD = re.compile(r"\w+")
_NUMBER = re.compile(r"[-+]?\d+(?:\.\d+)?")
# Read from the end backwards, as a search for a run's start would try every position before it.
_B64_END = re.compile(r"\)?={0,2}[A-Za-z0-9+/]{40}")
_B64_RUN = re.compile(r"\)?[A-Za-z0-9+/=]+")
_MARK = re.compile(r"(In|Out) ?\[[^\]\n]*\]:?")
_ENDS = ".!?…。！？"


def _shape(text: str) -> str:
    return _RUNS.sub(lambda m: "0" if m[0][0].isdigit() else " " if m[0][0].isspace() else "c" if ord(m[0][0]) > 0x2FFF else "a", text)


def _bucket(n: int) -> int:
    return n if n < 6 else 6 + int(n).bit_length()


def _last_line_with(body: str, start: str) -> int:
    """Where the last line that begins with ``start`` begins, or -1."""
    at = body.rfind("\n" + start)
    return at + 1 if at >= 0 else 0 if body.startswith(start) else -1


def _last_mark(body: str) -> tuple[int, re.Match | None]:
    """The last line that is a mark of an input or output: where it begins, and the mark."""
    end = len(body)
    while True:
        at = max(body.rfind("\nIn", 0, end), body.rfind("\nOut", 0, end)) + 1
        m = _MARK.match(body, at)
        if m or at == 0:
            return at, m
        end = at - 1


def block_kind(body: str, layout: str) -> tuple[str, int]:
    """The kind of block the text ends in, and where in the text it begins."""
    end = body.rfind("\n") + 1  # the last line
    if layout == "json":
        return "json", end
    if layout == "fenced" or (layout not in ("percent", "inout") and "\n```" in body):
        if (body.count("\n```") + body.startswith("```")) % 2:
            at = _last_line_with(body, "```")
            line = body[at:].split("\n", 1)[0]
            return "open" + line[3:12], min(at + len(line) + 1, len(body))
        return ("closed", end) if body.startswith("```", end) else ("prose", end)
    if layout == "percent":
        cell, out = _last_line_with(body, "# %%"), _last_line_with(body, "# -->")
        at = max(cell, out)
        if at < 0:
            return "far", 0
        after = body.find("\n", at) + 1
        if out > cell:
            return "out", after or at
        kind = "mark" if not after else "prose" if "[markdown]" in body[at:after] else "code"
        return kind, after or at
    at, m = _last_mark(body)
    if not m:
        return "far", 0
    after = body.find("\n", at) + 1
    gap = sum(line == "" for line in body[after:].split("\n")) if after else 0
    return f"{m[1]}{min(gap, 2)}", after or at


CLOSINGS = ("dots", "stop", "open")


def closing(body: str) -> str:
    """How a text closes: with dots, with another end of a sentence, or without any."""
    return "dots" if body.endswith(("...", "…")) else "stop" if body[-1:] in _ENDS else "open"


def limit_features(limit_gap: str, close: str) -> tuple[str, str]:
    return f"lim {limit_gap}", f"limc {limit_gap} {close}"


def features(text: str, layout: str | None, limit_gap: str) -> list[str]:
    """The names of the features of one text; ``limit_gap`` tells its length's distance to a limit."""
    layout = layout or "none"
    body = text.rstrip()
    end_of_line = body.rfind("\n")
    last = body[end_of_line + 1 :]
    before = body[body.rfind("\n", 0, end_of_line) + 1 : end_of_line] if end_of_line >= 0 else ""
    kind, start = block_kind(body, layout)
    block = body[start:]
    if layout == "percent":
        strip = lambda x: x[2:] if x.startswith("# ") else x[1:] if x.startswith("#") else x
        if kind in ("prose", "out", "far"):
            last, before = strip(last), strip(before)
    trimmed = last.strip()
    if trimmed[:2] in ("- ", "* "):
        item = "list"
    elif trimmed.startswith("#"):
        item = "head"
    elif re.match(r"^\w*(Error|Exception)\b", trimmed):
        item = "error"
    elif _B64_END.match(trimmed[-60:][::-1]) and " " not in trimmed[-40:]:
        item = "b64"
    elif trimmed[:4] == "File" or trimmed.startswith("Traceback"):
        item = "trace"
    elif trimmed.startswith("["):
        item = "bracket"
    elif re.match(r"^[-+]?[\d.]+(\s|$)", trimmed):
        item = "table"
    elif before == "" or re.match(r"^[A-ZÀ-ÝА-Я぀-鿿¿¡]", trimmed):
        item = "text"
    else:
        item = "other"
    end = body[-1:]
    group = f"{layout}.{kind}"
    words = _WORD.findall(last[-300:])
    word = words[-1].lower() if words else ""
    complete = end in _ENDS
    classes = "".join(_class(c) for c in body[-6:])
    opened = sum(map(block.count, "([{")) - sum(map(block.count, ")]}")) if kind not in ("prose", "json") else 0
    quotes = (last.count("'") % 2, last.count('"') % 2)
    out = [
        "bias", f"g {group}", f"gi {group} {item}", f"e1 {classes[-1:]} {item} {group}", f"e1i {classes[-1:]} {item}", f"e2 {classes[-2:]} {item}", f"e3 {classes[-3:]} {kind}", f"e6 {classes}",
        f"w {word} {end in _ENDS}", f"wi {word} {item} {classes[-1:]}", f"w2 {' '.join(words[-2:]).lower()} {classes[-1:]}", f"wl {_bucket(len(word))} {item} {complete}",
        f"n {_bucket(len(words))} {item} {complete}", f"o {max(-2, min(2, opened))} {group}", f"oi {max(-2, min(2, opened))} {item}", f"q {quotes} {group} {item}",
        f"s {_shape(last[-30:])} {kind}", f"sl {_shape(last[:60])} {kind}", f"st {_shape(last[:12])} {item} {complete}", f"c {complete} {item} {group}", *limit_features(limit_gap, closing(body)),
    ]
    if item == "text":
        sentence = re.split(r"(?<=[.!?。！？])\s*", last[-400:])
        rest = sentence[-1] or (sentence[-2] if len(sentence) > 1 else "")
        out += [f"sw {_bucket(len(rest.split()))} {complete}", f"sf {(rest.split() or [''])[0].lower()[:12]} {complete}", f"lw {(words[0].lower() if words else '')} {complete}"]
    numbers, others = _NUMBER.findall(last), _NUMBER.findall(before)
    if numbers and item in ("table", "other", "bracket", "text"):
        decimals = [len(x.partition(".")[2]) for x in (numbers[-1], others[-1] if others else "")]
        out += [
            f"t {min(2, abs(len(numbers) - len(others)))} {kind} {item}", f"td {decimals[0]} {decimals[1]} {kind} {item}", f"tl {len(last) == len(before)} {kind} {item}",
            f"ts {_shape(last) == _shape(before)} {kind} {item}", f"tx {len(last) == len(before)} {decimals[0] == decimals[1]} {len(numbers) == len(others)} {item}",
        ]
    if item == "b64":
        run = _B64_RUN.match(body[::-1])
        size = len(run[0].lstrip(")")) if run else 0
        out += [f"b {size % 4} {end} {kind}", f"b4 {size % 4 == 0} {end in '=)'}"]
    if layout == "json":
        try:
            json.loads(body)
            out.append("json whole")
        except (ValueError, RecursionError):
            out.append("json broken")
    return out


def hashed(names: list[str], bits: int) -> np.ndarray:
    mask = (1 << bits) - 1
    return np.fromiter((zlib.crc32(x.encode("utf-8", "surrogatepass")) & mask for x in names), dtype=np.int32, count=len(names))


GAPS = (0, 1, 2, 3, -1, -2)


def limit_gap(chars: int, size: int, limits: dict[str, set[int]]) -> str:
    """How a length lies to limits: at one in characters, or within 3 bytes of one in bytes."""
    if chars in limits.get("c", ()):
        return "c"
    return next((f"b{gap}" for gap in GAPS if size + gap in limits.get("b", ())), "none")


def cell_ends(text: str, layout: str | None) -> list[int]:
    """Positions at which a cell or an output ends inside the text: cut there, a text still looks whole."""
    marks = {"percent": r"\n\n# %%", "inout": r"\n\n(?=In \[|Out\[)", "fenced": r"\n\n(?=```\w)"}.get(layout or "")
    return [m.start() for m in re.finditer(marks, text)] if marks else []


def source_limits(docs: DataFrame, text: str = "text") -> DataFrame:
    """source, unit (c characters, b bytes), size, n, expected: lengths at which far more distinct texts lie than around them.

    Around means the lengths within a twentieth power of two; a peak holds at least 4 texts, three
    times the expected number and six deviations more.
    """
    texts = docs.where(F.col(text).isNotNull()).select(
        F.coalesce("source", F.lit("")).alias("source"), F.xxhash64(text).alias("_h"), F.length(text).alias("c"), F.octet_length(text).alias("b")
    ).distinct()
    long = texts.select("source", F.explode(F.array(F.struct(F.lit("c").alias("unit"), F.col("c").alias("size")), F.struct(F.lit("b").alias("unit"), F.col("b").alias("size")))).alias("x")).select("source", "x.*")
    counts = long.where("size > 20").groupBy("source", "unit", "size").agg(F.count("*").alias("n"))
    counts = counts.withColumn("_bin", F.floor(F.log2("size") * 10).cast("int"))
    density = counts.groupBy("source", "unit", "_bin").agg(F.sum("n").alias("_all"), F.max("n").alias("_most"))
    width = F.pow(F.lit(2.0), (F.col("_bin") + 1) / 10) - F.pow(F.lit(2.0), F.col("_bin") / 10)
    expected = (F.col("_all") - F.col("n")) / width
    return (
        counts.join(density, ["source", "unit", "_bin"])
        .withColumn("_e", expected)
        .where((F.col("n") >= 4) & (F.col("n") >= 3 * F.col("_e")) & (F.col("n") >= F.col("_e") + 6 * F.sqrt(F.col("_e") + 0.25)))
        .select("source", "unit", "size", "n", F.col("_e").alias("expected"))
    )


def with_limits(docs: DataFrame, limits: DataFrame) -> DataFrame:
    """``docs`` with how each text's length lies to its source's limits (gap), and the share of whole texts there.

    Limits are looked up by joins on source and length: a small table is broadcast by its size, and any
    other is joined by sorting.
    """
    chance = F.least(F.lit(1.0), F.greatest(F.col("expected"), F.lit(0.25)) / F.col("n"))
    at = limits.select(F.col("source").alias("_source"), "unit", "size", chance.alias("chance"))
    in_chars = at.where("unit = 'c'").select("_source", F.col("size").alias("_chars"), F.col("chance").alias("_c"))
    near = F.explode(F.array(*(F.struct(F.lit(k).alias("rank"), F.lit(gap).alias("gap")) for k, gap in enumerate(GAPS)))).alias("x")
    in_bytes = at.where("unit = 'b'").select("_source", "size", "chance", near)
    in_bytes = in_bytes.groupBy("_source", (F.col("size") - F.col("x.gap")).alias("_bytes")).agg(F.min(F.struct("x.rank", "x.gap", "chance")).alias("_b"))
    held = docs.withColumn("_source", F.coalesce("source", F.lit(""))).withColumn("_chars", F.length("text")).withColumn("_bytes", F.octet_length("text"))
    held = held.join(in_chars, ["_source", "_chars"], "left").join(in_bytes, ["_source", "_bytes"], "left")
    gap = F.when(F.col("_c").isNotNull(), F.lit("c")).when(F.col("_b").isNotNull(), F.concat(F.lit("b"), F.col("_b.gap").cast("string"))).otherwise(F.lit("none"))
    return held.select(*docs.columns, gap.alias("gap"), F.coalesce("_c", F.col("_b.chance"), F.lit(1.0)).alias("chance"))


def fit(index: list[np.ndarray], label: np.ndarray, rules: CutRules, weight: np.ndarray | None = None, rounds: int | None = None) -> np.ndarray:
    """Logistic regression on binary hashed features, by full-batch AdaGrad."""
    out = np.zeros(1 << rules.bits)
    weight = np.ones(len(index)) if weight is None else weight
    used = np.flatnonzero(weight)
    if not len(used):
        return out
    held, label, weight = [index[i] for i in used], label[used], weight[used]
    lengths = np.array([len(x) for x in held])
    first = np.cumsum(lengths) - lengths
    # Features are numbered as they occur, and each example's and each feature's entries lie together.
    names, column = np.unique(np.concatenate(held), return_inverse=True)
    by_feature = np.argsort(column, kind="stable")
    rows = np.repeat(np.arange(len(held)), lengths)[by_feature]
    starts = np.searchsorted(column[by_feature], np.arange(len(names)))
    w, square = np.zeros(len(names)), np.full(len(names), 1e-8)
    total = max(1.0, weight.sum())
    for _ in range(rounds or rules.rounds):
        z = np.add.reduceat(w[column], first)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * weight
        gradient = np.add.reduceat(error[rows], starts) / total + rules.l2 * w
        square += gradient * gradient
        w -= rules.step * gradient / np.sqrt(square)
    out[names] = w
    return out


def train(docs: DataFrame, key: str, limits: DataFrame, rules: CutRules) -> np.ndarray:
    """Weights fitted on a sample of at most about ``train_docs`` rows; features are made on the executors.

    ``docs``: as ``with_limits`` gives them.
    """
    total = max(1, docs.count())
    share = min(1.0, rules.train_docs / total)
    sample = docs.where(F.pmod(F.xxhash64(F.col(key), F.lit(rules.seed)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    most = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n"), "unit", "size"))
    held = limits.withColumn("_k", most).where(F.col("_k") <= rules.train_limits)
    held = held.groupBy(F.col("source").alias("_source")).agg(F.collect_list(F.struct("unit", "size")).alias("limits"))
    sample = sample.withColumn("_source", F.coalesce("source", F.lit(""))).join(held, "_source", "left")

    def examples(batches):
        for pdf in batches:
            rows: list[tuple[int, float, bytes, bytes, bool, int]] = []

            def add(label: int, weight: float, text: str, layout: str | None, gap: str, fold: int) -> list[str]:
                names = features(text, layout, gap)
                at = {x for close in CLOSINGS for x in limit_features(gap, close)}
                rows.append((label, weight, hashed([x for x in names if x not in at], rules.bits).tobytes(), hashed([x for x in names if x in at], rules.bits).tobytes(), gap != "none", fold))
                return names

            for k, text, layout, limits_here, gap, chance in zip(pdf[key], pdf["text"], pdf["layout"], pdf["limits"], pdf["gap"], pdf["chance"]):
                if text is None or len(text.strip()) < 40:
                    continue
                own: dict[str, set[int]] = {}
                for x in limits_here if limits_here is not None else ():
                    own.setdefault(x["unit"], set()).add(x["size"])
                fold = zlib.crc32(text.encode("utf-8", "surrogatepass")) % rules.folds
                names = add(0, chance, text, layout, gap, fold)
                if "json broken" in names or any(x.startswith("g fenced.open") for x in names):
                    rows.pop()
                draw = random.Random(f"{rules.seed} {k}")
                newline = text.endswith("\n")
                ends = [e for e in cell_ends(text, layout) if e > 40]
                for e in draw.sample(ends, min(2, len(ends))):
                    add(0, 1.0, text[:e], layout, "none", fold)
                for cut in range(rules.cuts):
                    at = draw.randrange(min(40, len(text) // 2), max(41, len(text.rstrip()) - 1))
                    told = "none"
                    fits = [(u, n) for u, sizes in sorted(own.items()) for n in sorted(sizes) if 40 < n < len(text) - 2]
                    if cut == 0 and fits:
                        unit, size = draw.choice(fits)
                        sign = draw.choice(("", "", "...", "…"))
                        if unit == "c":
                            piece = text[: size - len(sign)] + sign
                        else:
                            broken = draw.choice(("ignore", "replace"))
                            piece = text.encode("utf-8", "surrogatepass")[: size - len(sign.encode())].decode("utf-8", broken) + sign
                        told = limit_gap(len(piece), len(piece.encode("utf-8", "surrogatepass")), own)
                    else:
                        piece = text[:at]
                        if newline and draw.random() < 0.5:
                            piece += "\n"
                    if piece.strip():
                        add(1, 1.0, piece, layout, told, fold)
            yield pd.DataFrame(rows, columns=["label", "weight", "index", "limit_index", "near", "fold"])

    got = sample.select(key, "text", "layout", "limits", "gap", "chance").mapInPandas(examples, "label int, weight double, index binary, limit_index binary, near boolean, fold int").toPandas()
    if not len(got):
        return np.zeros(1 << rules.bits)
    got = got.sort_values(["label", "index", "limit_index", "weight"], kind="stable")  # one result whatever order the rows came in
    index = [np.frombuffer(x, dtype=np.int32) for x in got["index"]]
    label, own = got["label"].to_numpy(dtype=float), got["weight"].to_numpy(dtype=float)
    # Cuts at limits weigh among the artificial ones as much as the peaks of all rows tell.
    near = got["near"].to_numpy() & (label == 1)
    excess = limits.agg(F.coalesce(F.sum(F.col("n") - F.col("expected")), F.lit(0.0))).first()[0]
    part = min(0.5, excess / (rules.prior * total))
    if near.any() and part > 0:
        own[near] *= part / (1 - part) * own[(label == 1) & ~near].sum() / own[near].sum()

    def balanced(keep: np.ndarray) -> np.ndarray:
        weight = keep * own
        for value in (0.0, 1.0):
            n = weight[label == value].sum()
            weight[label == value] *= 0.5 * len(label) / max(1.0, n)
        return weight

    # A text that is cut already is no negative. It is judged by a model that has not seen it: copies
    # of a text share its fold.
    fold = got["fold"].to_numpy()
    keep = np.ones(len(label), dtype=bool)
    for k in range(rules.folds):
        w = fit(index, label, rules, balanced(fold != k), rules.fold_rounds)
        for i in np.flatnonzero((fold == k) & (label == 0)):
            keep[i] = w[index[i]].sum() <= rules.doubt
    whole = [np.concatenate((x, np.frombuffer(y, dtype=np.int32))) for x, y in zip(index, got["limit_index"])]
    return fit(whole, label, rules, balanced(keep))


def scored(docs: DataFrame, key: str = "doc_id", rules: CutRules = CutRules()) -> DataFrame:
    """key, source, score (log-odds at the prior rate of cut texts), cut (score > 0) for every row."""
    docs = docs.select(key, "text", F.lower("layout").alias("layout"), "source")
    limits = materialize(source_limits(docs), "limits")
    told = with_limits(docs, limits)
    weights = train(told, key, limits, rules).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    prior = float(np.log(rules.prior / (1 - rules.prior)))

    @F.pandas_udf("double")
    def score(texts: pd.Series, layouts: pd.Series, gaps: pd.Series) -> pd.Series:
        w, out = shared.value, np.full(len(texts), -30.0)
        for i, (text, layout, gap) in enumerate(zip(texts, layouts, gaps)):
            if text is not None and text.strip():
                out[i] = w[hashed(features(text, layout, gap), rules.bits)].sum() + prior
        return pd.Series(out)

    return told.select(key, "source", score("text", "layout", "gap").alias("score")).withColumn("cut", F.col("score") > 0)


def rates(told: DataFrame) -> DataFrame:
    """source, texts, cut_texts, cut_rate."""
    return told.groupBy("source").agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut_texts")).withColumn("cut_rate", F.col("cut_texts") / F.col("texts"))
