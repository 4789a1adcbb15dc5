"""Delimited blocks inside a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.exprs import ColumnLike, _col

# A fenced code block of the R language (fixed pattern); group 1 is the content.
FENCED_BLOCK = r"```[rR]?\s*([\s\S]*?)```"
# A closed HTML paragraph; group 1 is the content.
PARAGRAPH = r"<p>([\s\S]*?)</p>"


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def blocks(text: ColumnLike, pattern: str = FENCED_BLOCK) -> Column:
    """Array of the trimmed first groups of all matches over the whole text."""
    return F.transform(F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(1)), _strip)


def joined_blocks(text: ColumnLike, pattern: str = FENCED_BLOCK) -> Column:
    """All blocks joined by a blank line; the text itself where it holds no block."""
    found = blocks(text, pattern)
    return F.when(F.size(found) == 0, _col(text)).otherwise(F.array_join(found, "\n\n"))


def explode_blocks(df: DataFrame, text: str, pattern: str = FENCED_BLOCK) -> DataFrame:
    """One row per block with its position; texts without a block give no row."""
    return df.select(
        *[c for c in df.columns if c != text],
        F.posexplode(blocks(text, pattern)).alias("pos", "block"),
    )
