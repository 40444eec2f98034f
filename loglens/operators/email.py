"""E-mail header blocks -> rows.

A block runs from ``From:`` through ``Subject:`` to the next blank line, the
next ``From:`` or the end of the text; in each block the first ``From``,
``Sent``, ``To``, ``Cc`` and ``Subject`` lines are read.  ``to``/``cc`` are
split on ``;`` without trimming the pieces; a missing list is ``[]`` and a
missing scalar ``NULL``.  Everything but the HTML-entity decoding is a JVM
regex; ``(?d)`` and ``(?U)`` give Java's ``.``, ``$`` and ``\\s`` the
meaning they have in Python.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglens import defaults
from loglens.functions.text import explode_positions, py_strip

# Java flags: (?s) DOTALL for the block, (?d) so that ``.`` and ``$`` treat
# only ``\n`` as a line end, (?U) for Python's Unicode ``\s``.
BLOCK_PATTERN = "(?s)(?d)" + defaults.EMAIL_BLOCK_PATTERN
# ``\s*`` after the field name crosses line ends (an empty ``Cc:`` line takes
# the next line as its value); ``single_line=True`` stops at the line end.
FIELD_PATTERN = "(?U)(?d)" + defaults.EMAIL_FIELD_PATTERN
FIELD_PATTERN_SINGLE_LINE = "(?U)(?d)" + defaults.EMAIL_FIELD_PATTERN.replace(r":\s*", r":[^\S\n]*")


@F.pandas_udf(T.StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    """Full HTML5 entity table (``html.unescape``), Arrow-batched."""
    return s.map(lambda x: html.unescape(x) if isinstance(x, str) and "&" in x else x)


def _field(block: Column, name: str, single_line: bool) -> Column:
    pat = (FIELD_PATTERN_SINGLE_LINE if single_line else FIELD_PATTERN).format(name=name)
    return py_strip(F.regexp_extract(block, pat, 1))


def header_blocks(df: DataFrame, text_col: str = "body", unescape: bool = True) -> DataFrame:
    """Adds ``block_no`` (0-based) and ``block`` rows, one per header block."""
    text = html_unescape(F.col(text_col)) if unescape else F.col(text_col)
    blocks = F.regexp_extract_all(text, F.lit(BLOCK_PATTERN), 0)
    return explode_positions(df, ["*"], blocks, "block_no", "block")


def extract_headers(df: DataFrame, text_col: str = "body", single_line: bool = False,
                    trim_items: bool = False, unescape: bool = True) -> DataFrame:
    """One row per header block: from, sent, to[], cc[], subject."""
    b = header_blocks(df, text_col, unescape)
    blk = F.col("block")

    def scalar(name):
        return F.when(F.contains(blk, F.lit(name + ":")), _field(blk, name, single_line))

    def items(name):
        parts = F.split(_field(blk, name, single_line), defaults.EMAIL_LIST_SEPARATOR, -1)
        if trim_items:
            parts = F.transform(parts, py_strip)
        return F.when(F.contains(blk, F.lit(name + ":")), parts).otherwise(F.array().cast("array<string>"))

    return b.select(
        *[c for c in df.columns if c != text_col], "block_no",
        scalar("From").alias("from"), scalar("Sent").alias("sent"),
        items("To").alias("to"), items("Cc").alias("cc"), scalar("Subject").alias("subject"),
    )
