"""Deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evq.functions.text import Col, normalize_space


def fold(c: Col) -> Column:
    return F.lower(normalize_space(c))


def hash_of(*parts: Column) -> Column:
    """sha256 over the parts joined by '|'."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def short_id(prefix: str, digest: Column, length: int) -> Column:
    return F.concat(F.lit(prefix), F.upper(F.substring(digest, 1, length)))


def identity_key(entity: Col, person: Col) -> Column:
    return hash_of(fold(entity), fold(person))


def record_id(entity: Col, person: Col, prefix: str = "FOC_") -> Column:
    return short_id(prefix, identity_key(entity, person), 12)


def evidence_id(url: Col, observed_at: Col, quote: Col) -> Column:
    return short_id("EV_", hash_of(normalize_space(url), normalize_space(observed_at), normalize_space(quote)), 16)


def candidate_id(name: Col, homepage: Col) -> Column:
    return short_id("CAN_", hash_of(fold(name), fold(homepage)), 14)


def hash_number(text: Col) -> Column:
    """The first 60 bits of a sha256 as a non-negative long."""
    digest = F.sha2(text if isinstance(text, Column) else F.col(text), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
