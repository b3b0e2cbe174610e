"""Masks for personal data, one column expression per kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluicework.functions.scalar import strip


def _last_four(value: Column, lead: str, hidden: str) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.when(F.length(digits) >= 4, F.concat(F.lit(lead), F.right(digits, F.lit(4)))).otherwise(F.lit(hidden))


def _email(value: Column) -> Column:
    digest = F.sha2(strip(F.lower(value)), 256)
    return F.concat(F.substring(digest, 1, 16), F.lit("@masked.invalid"))


def _name(value: Column) -> Column:
    words = F.transform(
        F.split(value, r"\s+"),
        lambda w: F.when(F.length(w) > 0, F.concat(F.substring(w, 1, 1), F.lit("***"))).otherwise(F.lit("")),
    )
    return F.array_join(words, " ")


def _ip(value: Column) -> Column:
    parts = F.split(value, r"\.", -1)
    return F.when(
        F.size(parts) == 4, F.concat_ws(".", parts[0], parts[1], F.lit("xxx"), F.lit("xxx"))
    ).otherwise(F.lit("xxx.xxx.xxx.xxx"))


_MASKS = {
    "email": _email,
    "phone": lambda v: _last_four(v, "***-***-", "***-***-****"),
    "ssn": lambda v: _last_four(v, "***-**-", "***-**-****"),
    "credit_card": lambda v: _last_four(v, "****-****-****-", "****-****-****-****"),
    "name": _name,
    "address": lambda v: F.regexp_replace(v, r"^[0-9]+\s*", "*** "),
    "dob": lambda v: F.regexp_replace(v, r"(?s)^(.*?)([0-9]{4})[/-][0-9]{2}[/-][0-9]{2}", "$1$2-**-**"),
    "ip": _ip,
}


def mask(value: Column, kind: str) -> Column:
    """The masked text; NULL and blank values stay as they are."""
    return F.when(value.isNull() | (strip(value) == ""), value).otherwise(_MASKS[kind](value))
