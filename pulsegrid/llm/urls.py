"""URL filters: a path-template tree per host, learned from labelled urls.

Every url is a host and path segments. From the root of each host down, a node
keeps its children by literal segment; children that are variable in kind
(numbers, long hexadecimal or mixed names) become one wildcard child, and
children whose labels do not differ beyond chance from those of the other
children are merged into the wildcard too, however many there are. A template is
the path from the root to a leaf. The share of blocked labels of every node is
smoothed towards its parent's, the host's towards that of all urls; so a
template without labels is judged by its nearest labelled ancestor. It is
rejected when its smoothed share reaches the threshold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import lower_ascii, staged, table, with_row_id

# (host, start of the path, verdict); the longest that fits a url decides.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
# Labels that stand for the parent's share in every smoothed share.
PRIOR_WEIGHT = 8.0
BLOCK_AT = 0.8
# A child keeps its own branch when its share differs by this many standard errors.
DIFFERS_AT = 1.96
WILD = "*"
VARIABLE = r"^(?:[0-9]+(?:\.[A-Za-z]{1,5})?|[0-9a-fA-F-]{8,}|(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z]).{12,})$"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name (host and path) and verdict of the longest rule that fits, else null."""
    name = verdict = F.lit(None).cast("string")
    for domain, start, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        name = F.when(fits, F.lit(domain + start)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _segments(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike(VARIABLE), F.lit(WILD)).otherwise(s))


def path_templates(urls: DataFrame, prior_weight: float = PRIOR_WEIGHT) -> DataFrame:
    """The template of every distinct (host, path) of ``urls`` and its smoothed share of blocked labels.

    ``urls`` has host, path, n, labelled, blocked: a row per distinct url, with
    counts. The work goes level by level, as far down as there are labels that
    could tell children apart, over rows that are summed per node, so a host with
    most of the urls is as many rows as it has different paths. Below a node
    without labels nothing can differ: what is left of the path is its own name.
    """
    spread = urls.agg(F.sum("blocked"), F.sum("labelled")).first()
    base = (spread[0] or 0) / spread[1] if spread[1] else 0.0
    left = _segments(F.col("path")).alias("left")
    rows = urls.select("host", left, "labelled", "blocked").groupBy("host", "left").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    # The node a row has come to, what is left of its way, and the share of the node above.
    rows = rows.withColumns({"way": F.col("left"), "done": F.lit(""), "share": F.lit(float(base)), "seen": F.lit(0).cast("long"), "open": F.lit(True)})
    nodes, closed = staged(rows, "url-nodes"), []
    while True:
        closed.append(nodes.filter("NOT open"))
        here = nodes.filter("open").withColumn("child", F.coalesce(F.get("way", F.lit(0)), F.lit("")))
        if here.isEmpty():
            break
        kids = here.groupBy("host", "done", "child").agg(
            F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.min("way").alias("lo"), F.max("way").alias("hi"), F.first("share").alias("above")
        )
        parents = kids.groupBy("host", "done").agg(
            F.sum("l").alias("pl"), F.sum("b").alias("pb"), F.count(F.lit(1)).alias("kinds"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
        )
        kids = kids.drop("lo", "hi").join(parents, ["host", "done"])
        other, own = F.col("pl") - F.col("l"), F.col("l")
        # Shares of the child and of its siblings, drawn to the node's own share where labels are few.
        share = (F.col("pb") + prior_weight * F.col("above")) / (F.col("pl") + prior_weight)
        mine = (F.col("b") + prior_weight * share) / (own + prior_weight)
        theirs = (F.col("pb") - F.col("b") + prior_weight * share) / (other + prior_weight)
        error = F.sqrt(share * (1 - share) * (1 / (own + prior_weight) + 1 / (other + prior_weight)))
        alike = (error == 0) | (F.abs(mine - theirs) < DIFFERS_AT * error)
        # A child without labels is like any other; it keeps its name, as nothing says it belongs to them.
        merged = (own > 0) & alike & (F.col("kinds") > 1)
        single = (F.col("lo") == F.col("hi")) | (F.col("pl") == 0)
        # Labels that are all the same cannot tell anything apart below the node.
        pure = (F.col("pb") == 0) | (F.col("pb") == F.col("pl"))
        # Segments that all ways of the node share; only the first and last way need comparing.
        common = F.array_position(F.zip_with("lo", "hi", lambda x, y: x.eqNullSafe(y)), False) - 1
        plan = kids.select(
            "host", "done", "child", share.alias("node_share"), F.col("pl").alias("node_seen"),
            F.when(single, "single").when(pure, "pure").when(common > 0, "common").otherwise("split").alias("state"),
            common.cast("int").alias("common"), F.when(merged, F.lit(WILD)).otherwise(F.col("child")).alias("name"),
        )
        state, way, done = F.col("state"), F.col("way"), F.col("done")
        ends, rest = F.size(way) == 0, F.array_join(F.concat(F.array(done), way), "/")
        nodes = staged(
            here.join(plan, ["host", "done", "child"]).select(
                "host", "left", "labelled", "blocked",
                F.when(state == "common", F.slice(way, F.col("common") + 1, F.size(way))).when((state == "split") & ~ends, F.slice(way, F.lit(2), F.size(way))).otherwise(way).alias("way"),
                F.when(state == "common", F.array_join(F.concat(F.array(done), F.slice(way, F.lit(1), F.col("common"))), "/"))
                .when(ends, done)
                .when(state == "split", F.concat(done, F.lit("/"), "name"))
                .when((state == "pure") & (F.col("labelled") > 0), F.concat(done, F.lit("/" + WILD)))
                .otherwise(rest)
                .alias("done"),
                F.when(state.isin("split", "pure"), F.col("node_share")).otherwise(F.col("share")).alias("share"),
                F.greatest("seen", F.when(F.col("node_seen") > 0, F.col("node_seen"))).alias("seen"),
                ((state == "common") | ((state == "split") & ~ends)).alias("open"),
            ),
            "url-nodes",
        )
    nodes = reduce(DataFrame.unionByName, closed)
    share = (F.sum("blocked") + prior_weight * F.max("share")) / (F.sum("labelled") + prior_weight)
    # Labels of the nearest ancestor that has any, or of the template itself.
    leaves = nodes.groupBy("host", "done").agg(share.alias("blocked_share"), F.max("seen").alias("evidence"))
    return nodes.select("host", "left", "done").join(leaves, ["host", "done"]).select(
        "host", "left", F.when(F.col("done") == "", F.lit("/")).otherwise(F.col("done")).alias("template"), "blocked_share", "evidence"
    )


def filter_urls(pages: DataFrame, labels: DataFrame | None = None, rules=RULES, block_at: float = BLOCK_AT) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, template, blocked_share``.

    A url that a rule fits gets the rule's verdict and is a labelled example; so
    are the pages in ``labels`` (page_id, blocked boolean), if given. The others
    are blocked when their template's smoothed share of blocked labels is
    ``block_at`` or more; a template without labels has that of its nearest
    labelled ancestor, and is allowed when its host has none. A null url, or one without ``://``, has an empty host
    and path; rows that repeat a url or page_id count each. Other columns, the
    pages themselves too, are not read. An empty table gives no rows.
    """
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = staged(
        with_row_id(pages, F.col("page_id").cast("long"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        .withColumns({"rule": rule, "says": says}),
        "url-rows",
    )
    marked = rows.withColumn("mark", F.when(F.col("says").isNotNull(), F.col("says") == "block"))
    if labels is not None:
        given = labels.filter("page_id IS NOT NULL AND blocked IS NOT NULL").groupBy("page_id").agg(F.max("blocked").alias("given"))
        marked = marked.join(given, "page_id", "left").withColumn("mark", F.coalesce("mark", "given"))
    urls = marked.groupBy("host", "path").agg(
        F.count("mark").alias("labelled"), F.coalesce(F.sum(F.col("mark").cast("long")), F.lit(0)).alias("blocked")
    )
    leaf = path_templates(urls)
    judged = rows.withColumn("left", _segments(F.col("path"))).join(leaf, ["host", "left"], "left")
    bad = (F.col("blocked_share") >= block_at) & (F.col("evidence") > 0)
    return judged.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("says", F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "template",
        "blocked_share",
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
