"""Which rows a fit may learn from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 when divided by 4: such rows are only scored."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def first_by_hash(rows: DataFrame, id_col: str, most: int, seed: int = 3) -> DataFrame:
    """At most that many rows, the same ones in each run."""
    return rows.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(most)
