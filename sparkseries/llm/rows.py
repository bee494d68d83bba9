"""A key for each row of documents whose ids may be null or shared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_key(id_col: str, text_col: str) -> Column:
    """Id and text digest; only rows with the same id and the same text share one (null is no empty text)."""
    part = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))
    return F.concat_ws(":", part, F.coalesce(F.sha2(F.col(text_col), 256), F.lit("")))
