"""Text functions as Column expressions; only Unicode normalization leaves the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The scripts that are split into bigrams, as ranges of a Java character class.
CJK = (
    r"\x{0E00}-\x{0E7F}\x{0E80}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}"
    r"\x{3000}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}"
)
# Fixed value: the signs that separate tokens.
SIGNS = ",.<>{}[]\"':;!@#$%^&*()-+=~|\\/?`「」『』【】（）〈〉《》〔〕［］｛｝・、。，．！？；：―─…“”‘’"
# Fixed value: what shows nothing.
INVISIBLE = (
    r"\s\p{Cc}\p{Cf}\p{Zs}\p{Zl}\p{Zp}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}"
    r"\x{115F}\x{1160}\x{3164}\x{FFA0}\x{2800}"
)
SPACES = r"\s\x{1c}-\x{1f}\x{85}\p{Z}"
FENCE = r"```[\s\S]*?(?:```|\z)"
OMITTED = "[code omitted]"
MESSAGE_PREFIX = r"^\[(user|claude)( [0-9]+/[0-9]+)?\] "


def _normalizer(form: str):
    @F.pandas_udf("string")
    def normalized(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t.isascii() else unicodedata.normalize(form, t), na_action="ignore")

    return normalized


def nfkc(text: Column) -> Column:
    return _normalizer("NFKC")(text)


def nfd(text: Column) -> Column:
    return _normalizer("NFD")(text)


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+\\z", "")


def has_visible(text: Column) -> Column:
    return F.coalesce(text.rlike(f"[^{INVISIBLE}]"), F.lit(False))


def purify(text: Column) -> Column:
    """Each code fence, closed or not, replaced by a mark."""
    return F.regexp_replace(text, FENCE, OMITTED)


def signs_to_space(text: Column) -> Column:
    return F.translate(text, SIGNS, " " * len(SIGNS))


def runs(normal: Column) -> Column:
    """Runs of one kind (bigram scripts or others) between spaces and signs, from normalized text."""
    return F.regexp_extract_all(_spaced(normal), F.lit(f"([{CJK}]+|[^{CJK}{SPACES}]+)"), F.lit(1))


# A place where a token begins: a pair of bigram-script characters, a lone one, or a run of others.
# The place is looked at before it is passed, so pairs overlap and one scan of the text gives all tokens.
_TOKEN = f"(?=([{CJK}]{{2}}|(?<![{CJK}])[{CJK}]|[^{CJK}{SPACES}]++))(?:[{CJK}]|[^{CJK}{SPACES}]++)"
_LETTER = r"[\p{L}\p{N}]"
_WORD = (
    f"(?=([{CJK}&&{_LETTER}][{CJK}]|[{CJK}][{CJK}&&{_LETTER}]|(?<![{CJK}])[{CJK}&&{_LETTER}](?![{CJK}])|(?=[^{CJK}{SPACES}]*?[{_LETTER}&&[^{CJK}]])[^{CJK}{SPACES}]++))"
    f"(?:[{CJK}]|[^{CJK}{SPACES}]++)"
)


def _spaced(normal: Column) -> Column:
    return signs_to_space(F.regexp_replace(normal, r"[\x00-\x1f\x7f]", " "))


def bigrams(normal: Column) -> Column:
    """Each run of bigram script as its overlapping pairs, any other run whole, from normalized text."""
    return F.regexp_extract_all(_spaced(normal), F.lit(_TOKEN), F.lit(1))


def tokens(normal: Column) -> Column:
    """Those of ``bigrams`` with a letter or digit."""
    return F.regexp_extract_all(_spaced(normal), F.lit(_WORD), F.lit(1))


def query_terms(of_tokens: Column) -> Column:
    """Tokens without lone bigram-script characters, then without hiragana ones, each only where others remain."""
    long = F.filter(of_tokens, lambda t: ~t.rlike(f"^[{CJK}]\\z"))
    kept = F.when(F.size(long) > 0, long).otherwise(of_tokens)
    content = F.filter(kept, lambda t: ~t.rlike(r"^[\x{3040}-\x{309F}\x{30FC}]+\z"))
    return F.when(F.size(content) > 0, content).otherwise(kept)


def folded(text: Column) -> Column:
    """Without diacritics."""
    return F.regexp_replace(nfd(text), r"\p{Mn}", "")


def ngrams(normal: Column, folded_normal: Column) -> Column:
    """Tokens of normalized text, each word followed by its form without diacritics where that differs.

    ``folded_normal`` is the text without diacritics: its runs line up with the text's own where no
    bigram script is involved, so folding is done once for the whole text. A bigram-script run is
    taken from the text itself.
    """
    own, plain = runs(normal), runs(folded_normal)

    def one(run: Column, other: Column) -> Column:
        extra = ~run.rlike(f"^[{CJK}]") & (F.coalesce(other, run) != run) & (other != "")
        return F.when(extra, F.array(run, other)).otherwise(bigrams(run))

    return F.when(normal == folded_normal, bigrams(normal)).otherwise(F.flatten(F.zip_with(own, plain, one)))


def coverage_tokens(of_tokens: Column) -> Column:
    """The set of lower-cased tokens."""
    return F.array_distinct(F.transform(of_tokens, F.lower))


def sha1_hex(normal: Column) -> Column:
    return F.sha1(F.encode(normal, "UTF-8"))


def guard_key(content: Column, normal: Column, turn_id: Column, is_doc: Column) -> Column:
    """The exact-duplicate guard of a stored text; messages are guarded within their turn."""
    scoped = (F.coalesce(turn_id, F.lit("")) != "") & (content.startswith("[user") | content.startswith("[claude"))
    prefix = F.when(is_doc, F.lit("docsha:")).otherwise(F.lit("mem:sha:"))
    return F.concat(prefix, F.when(scoped, F.concat(turn_id, F.lit(":"))).otherwise(F.lit("")), sha1_hex(normal))


def prefixed(role: Column, body: Column) -> Column:
    return F.when(F.coalesce(role, F.lit("")) != "", F.concat(F.lit("["), role, F.lit("] "), body)).otherwise(body)


def safe_session(session: Column) -> Column:
    return F.substring(F.regexp_replace(session, "[^a-zA-Z0-9_-]", "_"), 1, 64)


def context_size(text: Column) -> Column:
    """UTF-16 units plus line ends."""
    units = F.octet_length(F.encode(text, "UTF-16BE")) / 2
    return (units + F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("int")


def importance(value: Column) -> Column:
    """A number or a numeric string, clamped to 0.5 .. 2; NULL where it is not one or not finite."""
    number = strip(value.cast("string")).try_cast("double")
    finite = ~F.isnan(number) & (F.abs(number) != float("inf"))
    return F.when(finite, F.greatest(F.lit(0.5), F.least(F.lit(2.0), number)))


def fmt_saved(epoch: Column) -> Column:
    at = F.timestamp_seconds(epoch)
    told = F.concat(F.date_format(at, "yyyy-MM-dd HH:mm"), F.lit(" (UTC"), F.date_format(at, "xx"), F.lit(")"))
    return F.coalesce(F.when(~F.isnan(epoch) & (F.abs(epoch) < 2.5e11), told), F.lit("unknown"))


_DAY = r"^\d{4}-\d{2}-\d{2}\z"
_MOMENT = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2})(?::(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?)?(?:([Zz])|([+-]\d{2})(?::?(\d{2}))?)?\z"


def time_bound(text: Column, until: bool = False) -> Column:
    """The epoch of an ISO date or date and time; NULL where there is none or it can't be read.

    A date alone is its first moment, as ``until`` its last. A time without an offset is one of the
    session's zone.
    """
    value = strip(text)
    part = lambda k: F.regexp_extract(value, _MOMENT, k)
    other = lambda k: F.when(part(k) == "", F.lit("00")).otherwise(part(k))
    zone = F.when(part(6) != "", F.lit("+00:00")).when(part(7) != "", F.concat(part(7), F.lit(":"), other(8))).otherwise(F.lit(""))
    fraction = F.substring(F.rpad(part(5), 6, "0"), 1, 6)
    moment = F.concat(part(1), F.lit(" "), part(2), F.lit(":"), other(3), F.lit(":"), other(4), F.lit("."), fraction, zone)
    day = F.concat(value, F.lit(" 23:59:59.999999" if until else " 00:00:00.000000"))
    told = F.when(value.rlike(_DAY), day).when(value.rlike(_MOMENT), moment)
    return F.unix_micros(told.try_cast("timestamp")) / 1e6


def bounds_error(since: Column, until: Column) -> Column:
    """What is wrong with a pair of bounds as texts, or NULL."""
    a, b = time_bound(since), time_bound(until, True)

    def unread(name: str, text: Column, bound: Column) -> Column:
        told = F.concat(F.lit(f"Error: {name} must be an ISO 8601 date or datetime (got '"), text, F.lit("')"))
        return F.when((strip(F.coalesce(text, F.lit(""))) != "") & bound.isNull(), told)

    return F.coalesce(unread("since", since, a), unread("until", until, b), F.when(a > b, F.lit("Error: since is later than until")))


def text_parts(prompt: Column) -> Column:
    """The text parts of a JSON array of typed parts, by lines; any other text unchanged."""
    parts = F.from_json(prompt, "array<struct<type:string,text:string>>", {"mode": "PERMISSIVE"})
    typed = F.coalesce((F.size(parts) > 0) & F.forall(parts, lambda p: p["type"].isNotNull()), F.lit(False))
    joined = F.array_join(F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"]), "\n")
    return F.when(F.ltrim(prompt).startswith("[") & typed, joined).otherwise(prompt)


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hex_modulo(digits: Column, length: int, dim: int) -> Column:
    """The number that ``length`` hex digits tell, modulo ``dim``, seven digits at a time."""
    rest = F.lit(0).cast("bigint")
    for start in range(0, length, 7):
        size = min(7, length - start)
        part = F.conv(F.substring(digits, start + 1, size), 16, 10).cast("bigint")
        rest = (rest * 16**size + part) % dim
    return rest.cast("int")


def hashed_vector(text: Column, dim: int = 16) -> Column:
    """A unit vector of hashed words, the stand-in for an embedding model: NULL without a word.

    A word adds 1 at its MD5 as a number modulo ``dim``, and a half at that number without its last four hex digits.
    """
    if not 1 <= dim < 2**31:
        raise ValueError("a vector has at least one place and fewer than 2**31")
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    places = F.transform(F.transform(words, F.md5), lambda h: F.struct(_hex_modulo(h, 32, dim).alias("whole"), _hex_modulo(h, 28, dim).alias("half")))

    def counted(held: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)),
            lambda i: F.size(F.filter(held, lambda x: x["whole"] == i)) + 0.5 * F.size(F.filter(held, lambda x: x["half"] == i)),
        )

    def unit(counts: Column) -> Column:
        return _once(F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x)), lambda norm: F.transform(counts, lambda x: x / norm))

    return _once(places, lambda held: F.when(F.size(held) > 0, _once(counted(held), unit)))
