"""What callers send, as columns: bytes, payloads, defaults and the texts that are embedded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamstone.functions.text import strip
from loamstone.sources.transcripts import SYSTEM_STARTS


def decoded(data: Column) -> Column:
    """Bytes as text: a leading byte order mark goes, what is no UTF-8 becomes the replacement character."""
    return F.regexp_replace(F.make_valid_utf8(data.cast("string")), "^\\x{FEFF}", "")


def prompt_of(raw: Column) -> Column:
    """The prompt of a payload that is a JSON object; any other text is a prompt itself."""
    parsed = F.try_parse_json(raw)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    return F.when(is_object, F.try_variant_get(parsed, "$.prompt", "string")).otherwise(raw)


def filled(value: Column, *defaults: Column) -> Column:
    """A value, or the first default that isn't blank where the value is; defaults come without spaces around them."""
    shown = lambda c: F.when(strip(F.coalesce(c, F.lit(""))) != "", c)
    return F.coalesce(shown(value), *(strip(shown(d)) for d in defaults))


def is_system_prompt(text: Column) -> Column:
    """Whether a prompt was written by no person: such a text is neither saved nor searched."""
    told = F.lit(False)
    for start in SYSTEM_STARTS:
        told = told | F.ltrim(text).startswith(start)
    return F.coalesce(told, F.lit(False))


def embedding_input(normal: Column, search: bool = False) -> Column:
    """The normalized text as a model of asymmetric search takes it."""
    return F.concat(F.lit("query: " if search else "passage: "), normal)
