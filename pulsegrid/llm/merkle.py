"""Merkle manifest of a dataset with nested-interval labels.

Every node is labelled with the interval of leaf ranks it covers. Parents are
found by containment joins bucketed by level (all nodes of a level lie on a grid
of ``8 ** level`` ranks), and the siblings of a node are what is left of its
parent's interval when its own is taken out. Proofs grow from the root down, so a
join has as many rows as the level it serves and only the last one has all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import UPPER, in_order, lower_ascii, staged, table
from pulsegrid.session import checked_broadcast

# Consecutive nodes under one parent.
FAN = 8
PATH = "array<struct<left:string,right:string>>"


def field_text(value: Column) -> Column:
    """A value with its length in UTF-8 bytes before it, so that no two rows share an encoding; null is '-'."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(text: Column) -> Column:
    """Digest of a document row that has ``text`` as its text."""
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    return F.sha2(F.concat(*(field_text(f) for f in fields)), 256)


@dataclass(frozen=True)
class Manifest:
    """A tree per language, and one over their subroots.

    ``levels`` and ``upper`` are the nodes level by level: ``tree, size`` (its
    leaves), ``lo, hi`` (ranks covered), ``digest`` and, above the leaves,
    ``kids``. ``tree`` is the rank of a tree's first leaf. Leaves keep the columns
    they came with. ``subroots`` has ``lang, tree, lo, digest``; ``root`` is None
    for an empty table.
    """

    levels: list[DataFrame]
    subroots: DataFrame
    upper: list[DataFrame]
    root: str | None


def grow(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The levels over ``nodes`` of trees with at most ``most`` leaves; a tree ends where one node is left."""
    levels, width = [nodes], 1
    while width < most:
        width *= FAN
        bucket = F.floor((F.col("lo") - F.col("tree")) / width).cast("long").alias("bucket")
        kids = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("kids")
        runs = levels[-1].filter(F.col("size") > width // FAN).groupBy("tree", "size", bucket).agg(kids)
        parents = runs.select(
            "tree",
            "size",
            F.col("kids")[0]["lo"].alias("lo"),
            F.element_at("kids", -1)["hi"].alias("hi"),
            F.sha2(F.array_join("kids.digest", ""), 256).alias("digest"),
            "kids",
        )
        levels.append(staged(parents, "merkle-level"))
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """The last node of every tree: ``tree, digest``."""
    found = [level.filter(F.col("size") <= FAN**k).select("tree", "digest") for k, level in enumerate(levels)]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def proofs(levels: list[DataFrame], ends: DataFrame) -> DataFrame:
    """The leaves with ``path``: what stands left and right of them and of each ancestor, level by level.

    ``ends`` has ``tree``, the ``path`` of its top node and any columns to hand down.
    """
    handed = [c for c in ends.columns if c not in ("tree", "path")]
    above = None
    for k in range(len(levels) - 1, -1, -1):
        nodes, width = levels[k], FAN**k
        at_top = nodes.filter(F.col("size") <= width).join(ends, "tree")
        kept = [c for c in nodes.columns] + ["path", *handed]
        placed = at_top.select(*kept)
        if above is not None:
            parent = above.select(
                F.col("tree"),
                F.floor((F.col("lo") - F.col("tree")) / (width * FAN)).cast("long").alias("bucket"),
                *(F.col(c).alias(f"p_{c}") for c in ("lo", "hi", "kids", "path", *handed)),
            )
            inside = (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi"))
            bucket = F.floor((F.col("lo") - F.col("tree")) / (width * FAN)).cast("long")
            under = nodes.filter(F.col("size") > width).withColumn("bucket", bucket).join(parent, ["tree", "bucket"]).filter(inside)
            left = F.array_join(F.transform(F.filter("p_kids", lambda kid: kid["hi"] <= F.col("lo")), lambda kid: kid["digest"]), "")
            right = F.array_join(F.transform(F.filter("p_kids", lambda kid: kid["lo"] >= F.col("hi")), lambda kid: kid["digest"]), "")
            path = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("p_path"))
            placed = placed.union(under.select(*nodes.columns, path.alias("path"), *(F.col(f"p_{c}") for c in handed)))
        # The two levels next to the leaves hold nearly all proofs and go straight into the join below them.
        above = staged(placed, "merkle-paths") if k > 1 else placed
    return above


def manifest(leaves: DataFrame) -> Manifest:
    """The trees over ``leaves`` (``lang, doc_id, leaf`` and what else they bring).

    Leaves of a language ascend by doc_id (null first), equal ids by digest;
    languages ascend by their UTF-8 bytes, null first.
    """
    order = ["lang", "doc_id", "leaf"]
    ranked = in_order(leaves, order, {"rank": F.lit(1)}, "merkle-leaves")
    trees = staged(ranked.groupBy("lang").agg(F.min("rank").alias("tree"), F.count(F.lit(1)).alias("size")), "merkle-trees")
    most = trees.agg(F.max("size")).first()[0] or 0
    side = checked_broadcast(trees.select(F.col("lang").alias("t_lang"), "tree", "size"))
    others = [c for c in leaves.columns if c != "leaf"]
    nodes = ranked.join(side, F.col("lang").eqNullSafe(F.col("t_lang"))).select(
        "tree", "size", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), F.col("leaf").alias("digest"), *others
    )
    levels = grow(staged(nodes, "merkle-nodes"), most)
    named = trees.select("lang", "tree").join(tops(levels), "tree")
    subroots = staged(in_order(named, ["tree"], {"lo": F.lit(1)}, "merkle-subroots"), "merkle-subroots")
    count = subroots.count()
    upper = grow(
        subroots.select(
            F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("size"), "lo", (F.col("lo") + 1).alias("hi"), "digest",
            F.col("tree").alias("of"),
        ),
        count,
    )
    root = tops(upper).select("digest").first()
    return Manifest(levels, subroots, upper, root[0] if root else None)


def prove(made: Manifest) -> DataFrame:
    """Every leaf with ``subroot`` and ``path``, its siblings up to the root."""
    start = made.subroots.sparkSession.range(1).select(F.lit(0).cast("long").alias("tree"), F.array().cast(PATH).alias("path"))
    ends = proofs(made.upper, start).select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), "path")
    return proofs(made.levels, ends)


def proof_digest(path: Column) -> Column:
    """One digest over all siblings of a path, bottom up and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def verify_documents(docs: DataFrame, text: Column | None = None, when: Column | None = None) -> DataFrame:
    """One row per document: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    Where ``when`` holds, the leaf is recomputed with ``text`` in place of the
    document's text and folded with the original siblings; elsewhere with its
    own. A null field has an encoding of its own, so null and empty texts differ.
    Rows that repeat a doc_id are leaves of their own, in the order of their
    digests; a null doc_id comes first in its language. Other columns are ignored.
    An empty table gives no rows.
    """
    changed = F.coalesce(F.lit(False) if when is None else when, F.lit(False))
    own = leaf_digest(F.col("text"))
    leaves = staged(
        docs.select("doc_id", "source", "lang", "n_chars", "text").select(
            F.col("doc_id").cast("long").alias("doc_id"),
            "lang",
            own.alias("leaf"),
            F.when(changed, leaf_digest(F.col("text") if text is None else text)).alias("other"),
        ),
        "merkle-digests",
    )
    made = manifest(leaves)
    return prove(made).select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        F.lit(made.root).cast("string").alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"),
        fold(F.coalesce("other", "digest"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return verify_documents(table(spark, sf_dir, "documents"), text=lower_ascii(F.col("text")), when=third)


def _sql(doc_levels: int = 8, lang_levels: int = 4) -> str:
    """The answer in SQL, with so many levels of each kind written out."""

    def encoded(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"

    def row(text: str) -> str:
        return "sha256(" + " || ".join(encoded(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    # The reflected CRC-32: a byte is mixed in, then eight single-bit steps, written as -1.
    steps = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: [ord(d), -1, -1, -1, -1, -1, -1, -1, -1]))"
    shift = "xor(c >> 1, 3988292384 * (c & 1))"
    crc = (
        f"xor(list_reduce(list_prepend(4294967295, list_transform({steps}, lambda s: CAST(s AS BIGINT))), "
        f"lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) ELSE {shift} END), 4294967295)"
    )
    lower = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    parts = [
        f"d AS (SELECT doc_id, lang, {row('text')} AS leaf, "
        f"CASE WHEN {crc} % 3 = 0 THEN {row(lower)} ELSE {row('text')} END AS other FROM documents)",
        "p0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, "
        "count(*) OVER (PARTITION BY lang) AS n, '' AS proof, other AS fold FROM d)",
        "a0 AS (SELECT lang, i, n, leaf AS h FROM p0)",
    ]

    def climb(nodes: str, rows: str, levels: int, same: str, by: str) -> None:
        for k in range(1, levels + 1):
            parts.append(
                f"{nodes}{k} AS (SELECT {by} i // 8 AS i, n, string_agg(h, '' ORDER BY i) AS run, sha256(string_agg(h, '' ORDER BY i)) AS h "
                f"FROM {nodes}{k - 1} WHERE n > {8 ** (k - 1)} GROUP BY {by} i // 8, n)"
            )
            at = f"64 * ((p.i // {8 ** (k - 1)}) % 8)"
            left, right = f"left(x.run, {at})", f"substr(x.run, {at} + 65)"
            parts.append(
                f"{rows}{k} AS (SELECT p.* EXCLUDE (proof, fold), CASE WHEN x.run IS NULL THEN p.proof ELSE p.proof || {left} || {right} END AS proof, "
                f"CASE WHEN x.run IS NULL THEN p.fold ELSE sha256({left} || p.fold || {right}) END AS fold "
                f"FROM {rows}{k - 1} p LEFT JOIN {nodes}{k} x ON {same} x.i = p.i // {8**k})"
            )

    climb("a", "p", doc_levels, "x.lang IS NOT DISTINCT FROM p.lang AND", "lang,")
    subroots = " UNION ALL ".join(f"SELECT lang, h FROM a{k} WHERE n <= {8**k}" for k in range(doc_levels + 1))
    parts += [
        f"s AS ({subroots})",
        "b0 AS (SELECT lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h FROM s)",
        f"q0 AS (SELECT p.doc_id, p.leaf, b.h AS subroot, b.i, b.n, p.proof, p.fold FROM p{doc_levels} p JOIN b0 b ON b.lang IS NOT DISTINCT FROM p.lang)",
    ]
    climb("b", "q", lang_levels, "", "")
    root = " UNION ALL ".join(f"SELECT h FROM b{k} WHERE n <= {8**k}" for k in range(lang_levels + 1))
    parts.append(f"r AS ({root})")
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, "
        f"fold AS folded_root, fold = r.h AS verified FROM q{lang_levels}, r"
    )


OP13_SQL = _sql()
