import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
# Names that the operators use inside; a table may have them too.
CLASHES = {"digest": "'x'", "size": "'y'", "n": "-1", "rank": "'z'", "key": "0", "words": "1", "kept": "'no'", "block": "2", "cells": "3", "__pulsegrid_row": "0", "__stage_row": "0"}


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text[, lang[, source]]) rows, with clashing extra columns."""

    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0", 0) for r in rows]
        return spark.createDataFrame(full, DOCS).selectExpr("*", *(f"{v} as {k}" for k, v in CLASHES.items()))

    return make


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture
def prose():
    """Text of ``n`` words, as random as its seed."""
    import random

    def make(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))

    return make


@pytest.fixture
def odd_rows(prose):
    """Nulls, empty, blank and very long texts, ties and repeated rows."""
    return [
        (1, None, None, None), (2, ""), (3, " \t\n "), (4, "One"), (5, "one"), (5, "one"), (6, prose(30_000, 1)),
        (7, "Ä ö\n\nß   é"), (8, prose(40, 2), "de", "s1"), (9, prose(40, 2) + " end", "de", "s1"), (None, "one", "fr", "s2"), (None, None),
    ]
