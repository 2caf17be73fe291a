"""Duplicates hidden by formatting differences.

A content's canonical form is its letters and digits in order, after composition and case folding.
A content that consists of named fields also has a field form: its sorted (name, value) pairs, each
canonicalized alike, nested objects sorted within. Forms are hashed to 128 bits; equal hashes are
aggregated with map-side combining. Both kinds of form carry a second, independent hash of 64 bits by
which they are grouped too, as a collision check.

Defined results: a NULL content, or one without a letter or digit, has no copies; rows of one id
count once; an owner is compared without case and surrounding spaces, and rows without one are left
out; the smallest id represents its set; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.operators.components import components
from loamstone.scale import materialize, salt_of

MESSAGE = r"^\[(user|claude)( [0-9]+/[0-9]+)?\] "
_ENTRY = re.compile(r"^\s*(?:[-*•]\s+)?([^:=]+?)\s*[:=]\s*(.*?)\s*$", re.DOTALL)
_SEPARATORS = (re.compile(r"[\r\n]+"), re.compile(r"\s*[;]\s*"), re.compile(r"\s*[|]\s*"))
_OTHERS = re.compile(r"[\W_]+")


def plain_form(text: str) -> str:
    """Letters and digits in order, composed and case-folded."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return _OTHERS.sub("", text.casefold())


class _Object(list):
    """The (name, value) pairs of a JSON object, in the order they are written."""


def _json(text: str):
    try:
        return json.loads(text, object_pairs_hook=_Object, strict=False)
    except (ValueError, RecursionError):
        return None


def _told(value) -> str:
    """A field's value as text: an object with its own fields in canonical order, whatever is in it."""
    if isinstance(value, _Object):
        return " ".join(f"{k} {v}" for k, v in sorted((plain_form(k), _told(v)) for k, v in value))
    if isinstance(value, list):
        return " ".join(map(_told, value))
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def named_fields(text: str) -> list[tuple[str, str]] | None:
    """(name, value) pairs of a content that consists of at least two named fields, else None."""
    text = text.strip()
    if text[:1] == "{" and text[-1:] == "}":
        pairs = _json(text)
        if isinstance(pairs, _Object):
            return [(k, _told(v)) for k, v in pairs] if len(pairs) > 1 else None
    if ":" not in text and "=" not in text:
        return None
    for separator in _SEPARATORS:
        entries = [x for x in separator.split(text) if x.strip()]
        if len(entries) < 2:
            continue
        found = [_ENTRY.match(x) for x in entries]
        if all(found):
            return [(m[1], _value(m[2])) for m in found]
    return None


def _value(text: str) -> str:
    """An entry's value, told as JSON tells it where it is an object."""
    held = _json(text) if text[:1] == "{" and text[-1:] == "}" else None
    return _told(held) if isinstance(held, _Object) else text


def field_form(text: str) -> str | None:
    """The sorted, canonicalized fields as one string, or None if the content isn't made of fields."""
    pairs = named_fields(text)
    if pairs is None:
        return None
    done = sorted((plain_form(k), plain_form(v)) for k, v in pairs)
    return "\x1e".join(f"{k}\x1f{v}" for k, v in done) if all(k for k, _ in done) else None


def _hash(form: str, owner: str) -> bytes:
    return xxhash.xxh3_128_digest(f"{owner}\x1d{form}".encode("utf-8", "surrogatepass"))


def _check(form: str) -> int:
    """Second hash, for collision checks."""
    return xxhash.xxh64_intdigest(form.encode("utf-8", "surrogatepass"), seed=0x5EED) - (1 << 63)


def _forms(batches):
    for pdf in batches:
        rows = []
        for i, owner, text in zip(pdf["id"], pdf["_owner"], pdf["content"]):
            plain = plain_form(text)
            if plain:
                fields = field_form(text)
                told = None if fields is None else _hash("\x1c" + fields, owner) + struct.pack("<q", _check("\x1c" + fields))
                rows.append((i, _hash(plain, owner), _check(plain), told, owner))
        yield pd.DataFrame(rows, columns=["id", "plain", "checksum", "fields", "owner"])


def fingerprints(records: DataFrame) -> DataFrame:
    """id, plain hash (128 bits) and its check, fields hash with its own check behind it, and owner of every fact that has an owner."""
    owner = F.lower(F.trim("owner_id"))
    facts = records.where(
        F.col("id").isNotNull()
        & (F.coalesce("parent_id", F.lit("")) == "")
        & (owner != "")
        & ~F.coalesce(F.col("content").rlike(MESSAGE), F.lit(True))
    ).select("id", owner.alias("_owner"), "content")
    return facts.mapInPandas(_forms, "id string, plain binary, checksum bigint, fields binary, owner string")


def copy_members(records: DataFrame, salts: int = 32) -> DataFrame:
    """One row per fact that has copies: id, representative, copies.

    Facts are combined per (form, salt of the id) before any shuffle, then per form; a field hash
    found in a form links the forms that share it. What returns to the facts is one row for each
    (form, salt) that occurs, so a form that holds a third of all rows is spread over all salts.
    """
    prints = materialize(fingerprints(records).withColumn("salt", salt_of(F.col("id"), salts)), "forms")
    per_salt = prints.groupBy("plain", "checksum", "salt").agg(
        F.min("id").alias("_least"), F.countDistinct("id").alias("_n"), F.collect_set("fields").alias("_fields")
    )
    forms = materialize(
        per_salt.groupBy("plain", "checksum").agg(
            F.min("_least").alias("_least"),
            F.sum("_n").alias("_n"),
            F.array_distinct(F.flatten(F.collect_list("_fields"))).alias("_fields"),
            F.collect_set("salt").alias("_salts"),
        ),
        "form-sets",
    )
    label = F.coalesce(F.array_min("_fields"), F.col("plain"))
    rivals = forms.where(F.size("_fields") > 1)
    if not rivals.isEmpty():
        edges = rivals.select(F.explode("_fields").alias("src"), F.array_min("_fields").alias("dst")).where("src <> dst")
        names = components(edges)
        labelled = forms.withColumn("_first", F.array_min("_fields")).join(names.withColumnRenamed("node", "_first"), "_first", "left")
        labelled = labelled.withColumn("label", F.coalesce("component", "_first", "plain"))
    else:
        labelled = forms.withColumn("label", label)
    sets = labelled.groupBy("label").agg(F.min("_least").alias("representative"), F.sum("_n").alias("copies")).where(F.col("copies") > 1)
    spread = labelled.join(sets, "label").select("plain", "checksum", "representative", "copies", F.explode("_salts").alias("salt"))
    return prints.select("id", "plain", "checksum", "salt").join(spread, ["plain", "checksum", "salt"]).select("id", "representative", "copies").distinct()


def collapsed(records: DataFrame, salts: int = 32) -> DataFrame:
    """One row per set of copies: id (the smallest), copies. Facts without copies have copies = 1."""
    prints = fingerprints(records).select("id").distinct()
    members = copy_members(records, salts)
    return (
        prints.join(members, "id", "left")
        .where(F.col("representative").isNull() | (F.col("representative") == F.col("id")))
        .select("id", F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"))
    )
