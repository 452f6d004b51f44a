"""Shape rules for entities.  Each takes the trimmed lower-case word and the plain type
and is false where the entity is to be dropped."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let
from .labels import plain_type
from .text import trim_word


def _digits(word: Column) -> Column:
    return F.length(F.regexp_replace(word, "[^0-9]", ""))


def valid_length(word: Column, kind: Column) -> Column:
    return F.length(word) >= 2


def valid_charmix(word: Column, kind: Column) -> Column:
    mixed = word.rlike("[0-9]") & word.rlike("[a-zA-Z]")
    plain = ~word.contains("@") & ~word.contains(".")
    return ~(mixed & plain) | kind.isin("username", "pass", "driverlicense")


def valid_ip(word: Column, kind: Column) -> Column:
    return (kind != "ip") | word.rlike(r"^[0-9]+\.[0-9]+")


def valid_email(word: Column, kind: Column) -> Column:
    return (kind != "email") | word.contains("@") | word.contains(".")


def valid_phone(word: Column, kind: Column) -> Column:
    whole = ~word.startswith("-") & ~word.endswith("-")
    return (kind != "tel") | (_digits(word).between(7, 15) & whole)


def valid_date(word: Column, kind: Column) -> Column:
    partial = (_digits(word) < 4) | word.endswith("-") | word.endswith("/")
    separated = word.contains("/") | word.contains("-")
    return ~kind.isin("bod", "date") | (~partial & (separated | (_digits(word) >= 6)))


def valid_address(word: Column, kind: Column) -> Column:
    short_number = word.rlike("^[0-9]+$") & (F.length(word) < 5)
    return ~kind.isin("street", "building", "secaddress") | (
        (F.length(word) >= 3) & ~short_number
    )


def valid_ssn(word: Column, kind: Column) -> Column:
    return (kind != "socialnumber") | (F.length(word) >= 9)


RULES = {
    "valid_length": valid_length,
    "valid_charmix": valid_charmix,
    "valid_ip": valid_ip,
    "valid_email": valid_email,
    "valid_phone": valid_phone,
    "valid_date": valid_date,
    "valid_address": valid_address,
    "valid_ssn": valid_ssn,
}


def is_valid(word: Column, kind: Column) -> Column:
    """All rules together, on the entity's word and type as they come."""
    parts = F.struct(F.lower(trim_word(word)).alias("word"), plain_type(kind).alias("kind"))
    return let(
        parts,
        lambda p: reduce(and_, [rule(p["word"], p["kind"]) for rule in RULES.values()]),
    )
