"""Typed identifiers ``PREFIX-body``."""

from __future__ import annotations

import datetime as dt
import re
import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

_PREFIXES: dict[str, str] = {}


def register_prefix(prefix: str, description: str) -> None:
    """Declare a prefix; a second description of the same one is an error."""
    if not re.fullmatch("[A-Z]{2,5}", prefix):
        raise ValueError(f"a prefix has two to five capital letters: {prefix!r}")
    if _PREFIXES.setdefault(prefix, description) != description:
        raise ValueError(f"prefix {prefix} is taken: {_PREFIXES[prefix]}")


def known_prefixes() -> dict[str, str]:
    return dict(sorted(_PREFIXES.items()))


for _prefix, _meaning in (("SEQ", "sequence"), ("LIB", "library"), ("CLN", "clone"), ("SET", "clone set"), ("PLT", "plate"), ("RUN", "run of a step"), ("XFR", "transfer"), ("FIG", "figure"), ("ORD", "order"), ("MDL", "model"), ("RGT", "reagent"), ("LOT", "lot"), ("ART", "artifact")):
    register_prefix(_prefix, _meaning)


def mint(prefix: str, body: str | None = None) -> str:
    if prefix not in _PREFIXES:
        raise KeyError(f"unknown prefix {prefix}")
    return f"{prefix}-{body or secrets.token_hex(5)}"


def mint_stamped(prefix: str, label: str) -> str:
    """prefix, label, UTC time and a random end."""
    stamp = dt.datetime.now(dt.UTC).strftime("%Y%m%dT%H%M%S")
    return mint(prefix, f"{re.sub('[^A-Za-z0-9]+', '', label) or 'x'}-{stamp}-{secrets.token_hex(2)}")


def parse(obj_id: str) -> tuple[str, str]:
    prefix, dash, body = obj_id.partition("-")
    if not dash or not body or prefix not in _PREFIXES:
        raise ValueError(f"no identifier: {obj_id!r}")
    return prefix, body


def content_id(prefix: str, *parts: Column) -> Column:
    """The same parts give the same identifier, so that reading a source again repeats no row."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12))


def prefix_of(obj_id: Column) -> Column:
    """The prefix if it is a known one and a body follows, else null."""
    prefix = F.regexp_extract(obj_id, "^([A-Z]{2,5})-.+$", 1)
    return F.when(prefix.isin(*_PREFIXES), prefix)


def is_a(obj_id: Column, prefix: str) -> Column:
    return F.coalesce(prefix_of(obj_id) == prefix, F.lit(False))
