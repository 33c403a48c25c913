"""An optimizer fence for expensive columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_fence(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows; a later filter on ``columns`` is not pushed below this point.

    A filter pushed below a projection repeats the expressions it needs, which
    for JSON parsing costs more than filtering early saves. The output of a
    generator is not pushed.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*columns))))
