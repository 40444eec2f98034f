"""String expressions with Python ``str`` semantics where the library needs them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java regex flags: (?U) makes \s and \S Unicode-aware like Python's str.split /
# str.strip; plain trim() only removes ASCII spaces.
_EDGE_SPACE = r"(?U)^\s+|\s+$"
_TOKEN = r"(?U)\S+"


def py_strip(c: Column) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(c, _EDGE_SPACE, "")


def py_token_count(c: Column) -> Column:
    """``len(str.split())``: number of whitespace-separated tokens."""
    return F.regexp_count(c, F.lit(_TOKEN))


def to_clean_text(c: Column, lower: bool = False) -> Column:
    """``fillna('').astype(str).str.strip()`` and optional ``.str.lower()``."""
    out = py_strip(F.coalesce(c.cast("string"), F.lit("")))
    return F.lower(out) if lower else out


def first_match(text: Column, entries: Sequence[tuple[str, str]], case_insensitive: bool = False) -> Column:
    """Value of the first (key, value) entry whose key is a substring of ``text``.

    Written as an ordered ``CASE WHEN`` chain, which short-circuits like the
    Python loop it replaces; ``NULL`` when nothing matches.
    """
    probe = F.lower(text) if case_insensitive else text
    expr = None
    for key, value in entries:
        k = key.lower() if case_insensitive else key
        cond = F.contains(probe, F.lit(k))
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr if expr is not None else F.lit(None).cast("string")


def strip_chars(c: Column, chars: str) -> Column:
    """``str.strip(chars)``: drop any of ``chars`` from both ends."""
    return F.btrim(c, F.lit(chars))


def explode_positions(df, keep, array: Column, pos_name: str, value_name: str):
    """``df.select(*keep, posexplode(array))`` without re-computing ``array``.

    For ``explode``/``posexplode`` Catalyst infers a ``size(array) > 0``
    filter and pushes it below the projections, where an expensive array
    expression (regexes, folds) is inlined and evaluated a second time.  The
    ``_outer`` generator has no inferred filter; its placeholder rows for
    empty arrays (position NULL) are dropped above the generator.
    """
    out = df.select(*keep, F.posexplode_outer(array).alias(pos_name, value_name))
    return out.where(F.col(pos_name).isNotNull())
