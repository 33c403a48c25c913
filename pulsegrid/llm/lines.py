"""Line deduplication by a deletion-neighbourhood join.

Two lines are near when one word inserted, deleted or replaced turns one into
the other. Every line emits hashed keys of all its variants with one word left
out, and of itself. Lines with an equal variant at the same place differ in that
word; a line equal to another's variant lacks one word of it. Every member of
such a group is near the group's earliest, so groups are aggregated, never
paired up, and the earliest is verified word by word.

Before that, a line has to share its first or its second half with a different
line, which any two near lines do; lines that share neither emit no variants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import ROW, UPPER, sieve, staged, table, text_or_empty, with_row_id

# Lines with fewer words are kept: they repeat in any text.
LEAST_WORDS = 5
NO_ID = (1 << 63) - 1


GAPS = "\t\n\x0b\x0c\r"


def line_words(line: Column) -> Column:
    """Words of a line, A-Z in lower case. ``lower`` does that to ASCII only lines, and much faster than ``translate``."""
    plain = F.octet_length(line) == F.length(line)
    for gap in GAPS:
        plain = plain & ~F.contains(line, F.lit(gap))
    even = F.when(plain, F.lower(line)).otherwise(F.translate(line, UPPER + GAPS, UPPER.lower() + " " * len(GAPS)))
    return F.array_remove(F.split(even, " "), "")


def _half_keys(words: Column) -> Column:
    """Hashes of the halves a line shares with a line as long, one word shorter or one word longer.

    Of near lines, the shorter has m words; they share the first m/2 (rounded
    down) or the last m - m/2. ``m`` is the line's length or one less.
    """
    n = F.size(words)
    keys = []
    for m in (n, n - 1):
        head = F.floor(m / 2).cast("int")
        keys.append(F.xxhash64(F.lit("head"), m, F.slice(words, F.lit(1), head)))
        keys.append(F.xxhash64(F.lit("tail"), m, F.slice(words, n - (m - head) + 1, m - head)))
    return F.array(*keys)


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", ROW, F.posexplode(F.split(text_or_empty("text"), "\n")).alias("line_no", "line"))


def _digest(words: Column) -> Column:
    return F.unhex(F.md5(F.array_join(words, " ").cast("binary")))


def _variant_keys(marks: Column) -> Column:
    """Keys of a line and of its variants: at 0 that of the line, at i that of the line without its i-th word.

    A key is the xor of a mark per word, a hash of the word and its place.
    ``marks`` has every word's mark at its place and one place before. From one
    variant to the next only two words differ, so a running xor gives all keys.
    """
    none = F.array().cast("array<bigint>")
    without_first = F.aggregate(marks, F.lit(0).cast("long"), lambda a, w: a.bitwiseXOR(w["before"]))

    def step(s: Column, w: Column) -> Column:
        key = s["now"].bitwiseXOR(w["before"])
        return F.struct(key.bitwiseXOR(w["here"]).alias("now"), F.concat(s["keys"], F.array(key)).alias("keys"))

    start = F.struct(without_first.alias("now"), none.alias("keys"))
    return F.aggregate(marks, start, step, lambda s: F.concat(F.array(s["now"]), s["keys"]))


def _shared_keys(keys: DataFrame) -> DataFrame:
    """Rows (key, line, ...) of the keys that several lines have; most keys are one line's own, and need no shuffle."""
    shared = staged(keys.groupBy("key").agg(F.min("line").alias("x"), F.max("line").alias("y")).filter("x <> y").select("key"), "line-shared")
    return staged(sieve(keys, ["key"], shared).join(shared, "key", "left_semi"), "line-shared")


def _near(x: Column, y: Column) -> Column:
    """Whether two word arrays are one word apart."""
    n, m = F.size(x), F.size(y)
    short, long = F.when(n <= m, x).otherwise(y), F.when(n <= m, y).otherwise(x)
    least = F.least(n, m)
    same_place = F.size(F.filter(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: F.element_at(x, i) != F.element_at(y, i)))
    # One word longer: equal up to some place, and shifted by one after it.
    differ = F.filter(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: F.element_at(short, i) != F.element_at(long, i))
    at = F.when(F.size(differ) > 0, F.element_at(differ, 1)).otherwise(least + 1)
    shifted = F.slice(short, at, least - at + 1) == F.slice(long, at + 1, least - at + 1)
    return F.when(n == m, same_place <= 1).otherwise((F.abs(n - m) == 1) & shifted)


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS, text: str = "text") -> DataFrame:
    """One row per line: ``doc_id, line_no, n_words, reason, keep_doc_id, keep_line_no, kept``.

    Lines end at line feeds and count from 0; an empty or null text is one empty
    line. Lines are compared by their words, A-Z in lower case. ``reason`` is
    ``short`` (fewer than ``least_words`` words), ``first``, ``exact`` (the same
    words earlier) or ``near`` (an earlier line is one word away); the last two
    are dropped, and ``keep_doc_id, keep_line_no`` name the earliest such line.
    Earlier is by doc_id, null last, then row, then line. An earlier line that is
    itself dropped still counts, so no chain of near lines survives by its
    middle. Rows that repeat a doc_id count each. Other columns are ignored. An
    empty table gives no rows.
    """
    docs = with_row_id(docs, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text).alias("text"))
    words = F.col("words")
    rows = staged(
        _lines(docs).withColumn("words", line_words(F.col("line"))).select(
            "doc_id", ROW, "line_no", F.size(words).alias("n_words"),
            F.when(F.size(words) >= least_words, _digest(words)).alias("digest"),
            F.when(F.size(words) >= least_words, _half_keys(words)).alias("halves"),
        ),
        "line-rows",
    )
    place = F.struct("doc_id", ROW, "line_no")
    long_rows = rows.filter("digest IS NOT NULL")
    firsts = staged(long_rows.groupBy("digest").agg(F.min(place).alias("first")), "line-firsts")

    # Lines that share a half with a different one, by a hash of their digest.
    halves = long_rows.select(F.explode("halves").alias("half"), F.xxhash64("digest").alias("id"))
    shared = halves.groupBy("half").agg(F.min("id").alias("x"), F.max("id").alias("y")).filter("x <> y").select("half")
    ids = staged(halves.join(shared, "half", "left_semi").select("id").distinct(), "line-candidates")
    candidates = firsts.withColumn("id", F.xxhash64("digest")).join(ids, "id", "left_semi")
    where = staged(candidates.select("digest", "first", F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").alias("line_no")), "line-candidates")

    # Words of the candidates, from one occurrence of each; only documents that have any are cut into lines again.
    spoken = sieve(_lines(sieve(docs, ["doc_id"], where)), ["doc_id", "line_no"], where).select("doc_id", "line_no", line_words(F.col("line")).alias("words"))
    spoken = spoken.withColumn("digest", _digest(words))
    texts = staged(spoken.join(where, ["doc_id", "line_no", "digest"]).dropDuplicates(["digest"]).select("digest", "first", "words"), "line-texts")

    n = F.size("words")
    marks = F.transform("words", lambda w, i: F.struct(F.xxhash64(w, i).alias("here"), F.xxhash64(w, i - 1).alias("before")))
    marked = texts.select("first", F.monotonically_increasing_id().alias("line"), n.alias("n"), marks.alias("marks"))
    keys = staged(marked.select("first", "line", "n", F.posexplode(_variant_keys(F.col("marks"))).alias("gone", "key")), "line-variants")
    keys = _shared_keys(keys)
    replaced = keys.filter("gone > 0").groupBy("key", "gone", "n").agg(F.min("first").alias("other"), F.max("first").alias("last")).filter("other < last")
    by_word = keys.filter("gone > 0").join(replaced.drop("last"), ["key", "gone", "n"]).select("first", "other")
    cut = keys.filter("gone > 0").groupBy("key").agg(F.min("first").alias("other"))
    cut = keys.filter("gone = 0").join(cut, "key").select("key", "first", "other")
    cut = staged(cut, "line-cuts")  # a line, and the earliest of the lines that have one word more
    longer = keys.filter("gone > 0").join(cut.select("key", F.col("first").alias("other")), "key").select("first", "other")
    near = by_word.union(cut.select("first", "other")).union(longer).filter("other < first")
    near = near.groupBy("first").agg(F.min("other").alias("other"))
    both = (
        near.join(texts.select("first", F.col("words").alias("x"), "digest"), "first")
        .join(texts.select(F.col("first").alias("other"), F.col("words").alias("y")), "other")
        .filter(_near(F.col("x"), F.col("y")))
        .select("digest", "other")
    )
    known = firsts.join(both, "digest", "left").select("digest", "first", "other")
    judged = rows.join(known, "digest", "left")
    exact = F.col("first") < place
    keep = F.when(F.col("other").isNotNull() & (F.col("other") < F.col("first")), F.col("other")).when(exact, F.col("first"))
    reason = (
        F.when(F.col("first").isNull(), "short").when(exact, "exact").when(F.col("other").isNotNull(), "near").otherwise("first")
    )
    return judged.withColumns({"keep": keep, "reason": reason}).select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"),
        "line_no",
        "n_words",
        "reason",
        F.nullif("keep.doc_id", F.lit(NO_ID)).alias("keep_doc_id"),
        F.col("keep.line_no").alias("keep_line_no"),
        F.col("reason").isin("short", "first").alias("kept"),
    )


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH d AS (
  SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
), l AS (
  SELECT doc_id, line_no, list_filter(regexp_split_to_array(
    translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM d
), f AS (
  SELECT words, min({'d': doc_id, 'l': line_no}) AS first FROM l WHERE len(words) >= 5 GROUP BY words
), v AS (
  SELECT first, len(words) AS n, i, md5(array_to_string(list_concat(words[1:i - 1], words[i + 1:]), ' ')) AS key
  FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM f)
), w AS (SELECT first, md5(array_to_string(words, ' ')) AS key FROM f),
near AS (
  SELECT a.first, b.first AS other FROM v a JOIN v b USING (key, i, n)
  UNION ALL SELECT a.first, b.first FROM v a JOIN w b USING (key)
  UNION ALL SELECT b.first, a.first FROM v a JOIN w b USING (key)
), o AS (SELECT first, min(other) AS other FROM near WHERE other < first GROUP BY first),
j AS (
  SELECT l.doc_id, CAST(l.line_no AS INT) AS line_no, CAST(len(l.words) AS INT) AS n_words,
         CASE WHEN f.first IS NULL THEN 'short' WHEN f.first < {'d': l.doc_id, 'l': l.line_no} THEN 'exact'
              WHEN o.other IS NOT NULL THEN 'near' ELSE 'first' END AS reason,
         CASE WHEN o.other IS NOT NULL THEN o.other WHEN f.first < {'d': l.doc_id, 'l': l.line_no} THEN f.first END AS keep
  FROM l LEFT JOIN f USING (words) LEFT JOIN o USING (first)
)
SELECT doc_id, line_no, n_words, reason, keep.d AS keep_doc_id, CAST(keep.l AS INT) AS keep_line_no, reason IN ('short', 'first') AS kept FROM j
"""
