"""One consistent form for text that looks the same.

The quick check is the one of composed normalization, taken from the character data: a character is
unstable if its Quick_Check property is No (it is never part of composed text), if it is Maybe (it may
compose with the one before), if it has a combining class or is a mark, or if it has a look of another
character's. A text without unstable characters is returned as it is. Otherwise unstable characters,
those close to each other together, are isolated with the stable character before them as boundary
context: composition never crosses a stable character. Only these segments are normalized, and they
are spliced into the unchanged text.

The form: full- and half-width forms become ordinary ones, accents are composed, look-alike letters
become Latin, kinds of space of one place become one space, invisible characters go (joiners and
variation selectors between pictographs stay, as they show). Letter case, digits, signs, accents,
raised figures and the amount of visible space are kept.

Defined results: NULL stays NULL, the empty text stays empty, the form of a form is itself.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamstone.llm.lookalikes import LOOKALIKES
from loamstone.scale import materialize, salt_of

BLOCK = 4096
GAP = 12  # stable characters that a segment may hold between two unstable ones
_JOINERS = "\u200d\ufe0e\ufe0f"
#: Characters that show nothing though their category doesn't say so: fillers and grapheme joiner.
_BLANK = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"


def _is_pictograph(ch: str) -> bool:
    code = ord(ch)
    return code >= 0x1F000 or 0x2190 <= code <= 0x2BFF or unicodedata.category(ch) == "So"


def _is_invisible(ch: str) -> bool:
    category = unicodedata.category(ch)
    return (
        category == "Cf"
        or (category == "Cc" and ch not in "\t\n\v\f\x85")
        or ch in _BLANK
        or 0xFE00 <= ord(ch) <= 0xFE0F
        or 0xE0100 <= ord(ch) <= 0xE01EF
        or 0x180B <= ord(ch) <= 0x180F
    )


def _is_width_form(ch: str) -> bool:
    return 0xFF01 <= ord(ch) <= 0xFFEE


def _is_roman_numeral(ch: str) -> bool:
    return 0x2160 <= ord(ch) <= 0x217F


def _one(ch: str) -> str:
    """One character with its width form, space and look-alike resolved, composed."""
    if _is_width_form(ch) or _is_roman_numeral(ch):
        ch = unicodedata.normalize("NFKC", ch)
    parts = [" " if unicodedata.category(c) == "Zs" else LOOKALIKES.get(c, c) for c in unicodedata.normalize("NFD", ch)]
    return unicodedata.normalize("NFC", "".join(parts))


class _Forms(dict):
    """Code point to its form, None where it goes; filled as characters are met."""

    def __missing__(self, code: int):
        ch = chr(code)
        if ch in _JOINERS or 0xD800 <= code <= 0xDFFF:
            form = code
        elif _is_invisible(ch):
            form = None
        else:
            one = _one(ch)
            form = code if one == ch else one
        self[code] = form
        return form


_FORMS = _Forms()


@lru_cache(maxsize=1)
def _maybe() -> frozenset[int]:
    """NFC_Quick_Check = Maybe: what composes with a character before it, and conjoining vowels and finals."""
    seconds = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    for code in range(0x30000):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.normalize("NFC", chr(int(parts[0], 16)) + chr(int(parts[1], 16))) == chr(code):
            seconds.add(int(parts[1], 16))
    return frozenset(seconds)


def _is_contextual(code: int) -> bool:
    """Whether a character's form may depend on its neighbours."""
    ch = chr(code)
    return ch in _JOINERS or code in _maybe() or unicodedata.category(ch)[0] == "M" or unicodedata.combining(ch) != 0 or 0x1160 <= code <= 0x11FF


def _is_unstable(code: int) -> bool:
    """The quick check of one character: contextual, or never itself in a form (Quick_Check = No among them)."""
    if 0xD800 <= code <= 0xDFFF or unicodedata.category(chr(code)) in ("Cn", "Co"):
        return False
    return _is_contextual(code) or _FORMS[code] != code


def _class(codes) -> str:
    """A character class of those code points, as ranges."""
    spans: list[list[int]] = []
    for code in codes:
        if spans and spans[-1][1] == code - 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in spans)


@lru_cache(maxsize=1)
def _patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """One unstable character; a segment (unstable ones with the stable one before); contextual ones with the one before."""
    # Characters beyond the basic plane are few and looked at in any case: the classes stay small tables.
    plane = range(0x10000)
    unstable = _class(code for code in plane if _is_unstable(code)) + "\U00010000-\U0010ffff"
    contextual = _class(code for code in plane if not 0xD800 <= code <= 0xDFFF and _is_contextual(code)) + "\U00010000-\U0010ffff"
    # Unstable characters that lie close together share a segment: one normalization for them and what is between.
    segment = re.compile(f"[^{unstable}]?[{unstable}](?:[^{unstable}]{{0,{GAP}}}[{unstable}])*")
    return re.compile(f"[{unstable}]"), segment, re.compile(f"[^{contextual}]?[{contextual}]+")


def _canonical(match: re.Match) -> str:
    """The form of one segment: joiners stay only after a pictograph, marks are composed."""
    shown: list[str] = []
    for ch in match[0]:
        if ch not in _JOINERS or (shown and (_is_pictograph(shown[-1]) or shown[-1] in _JOINERS)):
            shown.append(ch)
    return unicodedata.normalize("NFC", "".join(LOOKALIKES.get(c, c) for c in unicodedata.normalize("NFD", "".join(shown))))


def _segment_form(match: re.Match) -> str:
    """The form of one segment: characters with a form of their own, then those that neighbours change."""
    return _patterns()[2].sub(_canonical, match[0].translate(_FORMS))


def canonical(text: str | None) -> str | None:
    """The one form of ``text``."""
    if text is None or (text.isascii() and text.isprintable()):
        return text
    unstable, segment, _ = _patterns()
    return segment.sub(_segment_form, text) if unstable.search(text) else text


def has_visible(text: str | None) -> bool:
    """Whether any character shows."""
    return text is not None and any(not (ch.isspace() or ch == "⠀" or _is_invisible(ch)) for ch in text)


@F.pandas_udf(T.StringType())
def canonical_udf(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action="ignore")


def with_canonical(rows: DataFrame, column: str = "content", to: str = "canonical") -> DataFrame:
    """``rows`` with the one form of ``column``."""
    return rows.withColumn(to, canonical_udf(F.col(column)))


def looks(rows: DataFrame, key: str, salts: int = 32) -> DataFrame:
    """key, look (128-bit hash of the form), form (128-bit hash of the content), salt of every visible content."""

    def forms(batches):
        for pdf in batches:
            out = []
            for k, text in zip(pdf[key], pdf["content"]):
                if has_visible(text):
                    out.append((k, *(xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in (canonical(text), text))))
            yield pd.DataFrame(out, columns=[key, "look", "form"])

    held = rows.where(F.col(key).isNotNull() & F.col("content").isNotNull()).select(key, "content")
    kind = held.schema[key].dataType.simpleString()
    return held.mapInPandas(forms, f"{key} {kind}, look binary, form binary").withColumn("salt", salt_of(F.col(key), salts))


def same_look_pairs(rows: DataFrame, key: str, salts: int = 32) -> DataFrame:
    """Pairs of rows whose contents are not equal but look the same: {key}_a < {key}_b.

    Distinct contents are paired first, on aggregated rows; then each side's members are joined on
    (content, salt), so copies of one content are spread over all salts and are never paired among
    themselves. The forms of one look are paired in blocks of at most about ``BLOCK`` by ``BLOCK``, so a
    look with very many forms is shared among tasks.
    """
    seen = materialize(looks(rows, key, salts).distinct(), "looks")
    per_salt = seen.groupBy("look", "form", "salt").agg(F.lit(1).alias("_n"))
    forms = per_salt.groupBy("look", "form").agg(F.collect_set("salt").alias("salts"))
    shared = forms.groupBy("look").agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    rival = materialize(forms.join(shared, "look"), "rival-forms")
    blocks = F.ceil(F.col("_n") / BLOCK)
    a = rival.select("look", F.col("form").alias("form_a"), F.col("salts").alias("salts_a"), F.pmod(F.xxhash64("form"), blocks).alias("_a"), F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("_b"))
    b = rival.select("look", F.col("form").alias("form_b"), F.col("salts").alias("salts_b"), F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("_a"), F.pmod(F.xxhash64("form"), blocks).alias("_b"))
    pairs = a.join(b, ["look", "_a", "_b"]).where("form_a < form_b").drop("look", "_a", "_b")
    members = seen.select(F.col(key).alias("_key"), "form", "salt")
    left = pairs.withColumn("salt", F.explode("salts_a")).join(members.withColumnRenamed("form", "form_a"), ["form_a", "salt"]).select("form_b", "salts_b", F.col("_key").alias("_x"))
    both = left.withColumn("salt", F.explode("salts_b")).join(members.withColumnRenamed("form", "form_b"), ["form_b", "salt"]).select("_x", F.col("_key").alias("_y"))
    return both.select(F.least("_x", "_y").alias(f"{key}_a"), F.greatest("_x", "_y").alias(f"{key}_b"))
