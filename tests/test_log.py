import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.errors import InvalidArgument, OffsetOutOfRange, PartitionOutOfRange, TopicExists, TopicNotFound
from pulsegrid.operators import compaction, log, numbering
from pulsegrid.schema import TopicSpec, topic_partitions
from pulsegrid.sources.message_log import MessageLog


def store_of(spark, folder, *counts, capacity=0):
    """A one-topic log with a given number of messages per partition, keyed by partition."""
    store = MessageLog(spark, folder, [TopicSpec("t", len(counts), capacity=capacity)])
    rows = [(n, str(p), f"msg{n}") for p, count in enumerate(counts) for n in range(count)]
    if rows:
        messages = spark.createDataFrame(rows, "n int, key string, payload string")
        store.publish(messages, "t", ["n"], router=lambda key: key.cast("int"))
    return store


def watermark(store):
    return store.stats().first()["min_consumer_offset"]


def relative_commits(store):
    return {r["group"]: r["offset"] for r in log.rebase_commits(store.commits(), store.bases()).collect()}


def payloads(df):
    return [r["payload"] for r in df.orderBy("offset").collect()]


# -- topics -----------------------------------------------------------------


def test_topic_rules():
    for bad in (("", 1), ("t", 0), ("t", -1)):
        with pytest.raises(InvalidArgument):
            TopicSpec(*bad)
    assert TopicSpec("t", 1, replicas=0).replicas == 3


def test_topic_names_are_unique(spark):
    with pytest.raises(TopicExists):
        topic_partitions(spark, [TopicSpec("t", 1), TopicSpec("t", 2)])


def test_default_capacity(spark):
    specs = [TopicSpec("a", 1), TopicSpec("b", 1, capacity=7), TopicSpec("c", 1, capacity=-1)]
    assert {r["topic"]: r["capacity"] for r in topic_partitions(spark, specs, 5).collect()} == {"a": 5, "b": 7, "c": -1}


def test_summary_lists_empty_topics(spark, folder):
    store = MessageLog(spark, folder, [TopicSpec("full", 2), TopicSpec("idle", 3)])
    store.publish(spark.createDataFrame([("k", "v", 1)], "key string, payload string, n int"), "full", ["n"])
    assert {tuple(r) for r in store.summary().collect()} == {("full", 2, 1), ("idle", 3, 0)}


# -- append -----------------------------------------------------------------


def test_offsets_equal_row_number(spark):
    df = spark.range(5000).select(
        F.lit("t").alias("topic"), (F.col("id") % 3 % 2).cast("int").alias("partition"), F.col("id").alias("n")
    )
    got = numbering.append_offsets(df.orderBy(F.rand(1)), ["n"])
    want = df.selectExpr("*", "row_number() over (partition by topic, partition order by n) - 1L as offset")
    assert got.exceptAll(want).count() == 0 and got.count() == 5000


def test_offsets_with_one_hot_partition(spark):
    """One partition holds nearly everything; it is still numbered by many tasks."""
    df = spark.range(20000).select(
        F.lit("t").alias("topic"), (F.col("id") % 100 == 0).cast("int").alias("partition"), F.col("id").alias("n")
    )
    numbered = numbering.append_offsets(df, ["n"], ranges=8)
    # AQE would put ranges as small as these into one task.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [len(part) for part in numbered.rdd.glom().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 8000 and sum(n > 1000 for n in sizes) >= 4
    wrong = F.col("offset") != F.expr("if(partition = 1, n div 100, n - n div 100 - 1)")
    assert numbered.count() == 20000 and numbered.filter(wrong).count() == 0


@pytest.mark.parametrize("ranges", [1, 2, 7, 50])
def test_ranges_of_any_order(spark, ranges):
    """Instants, nulls, ties in the first columns and structs give the same places however many ranges."""
    df = spark.range(3000).select(
        F.lit("t").alias("topic"), (F.col("id") % 3).cast("int").alias("partition"),
        F.when(F.col("id") % 11 != 0, F.timestamp_seconds(F.col("id") % 40)).alias("at"),
        F.when(F.col("id") % 5 != 0, F.struct((F.col("id") % 7).cast("string").alias("file"), F.col("id").alias("row"))).alias("place"),
        F.col("id"),
    )
    got = numbering.append_offsets(df, ["at", "place", "id"], ranges=ranges)
    want = df.selectExpr("*", "row_number() over (partition by topic, partition order by at, place, id) - 1L as offset")
    assert got.count() == 3000 and got.exceptAll(want).count() == 0
    again = numbering.append_offsets(df, ["at", "place", "id"], ranges=ranges)
    assert got.exceptAll(again).count() == 0


def test_row_ids_of_large_inputs(spark):
    ids = numbering.assign_row_ids(spark.range(5000).withColumnRenamed("id", "n"), [-F.col("n")], ranges=6)
    assert ids.filter(F.col("id") != 5000 - F.col("n")).count() == 0
    with pytest.raises(InvalidArgument):
        numbering.assign_row_ids(spark.range(10), [F.desc("id")], ranges=3)


def test_publish_in_ranges(spark, folder, monkeypatch):
    monkeypatch.setattr(numbering, "SINGLE_BYTES", 0)
    monkeypatch.setattr(numbering, "SINGLE_ROWS", 0)
    store = MessageLog(spark, folder, [TopicSpec("t", 3)])
    rows = spark.range(4000).select("id", F.when(F.col("id") % 10 != 0, F.col("id").cast("string")).alias("key"), F.lit("x").alias("payload"))
    done = store.publish(rows, "t", ["id"])
    assert done.messages.count() == 3600 and done.rejects.count() == 400
    gaps = store.messages().groupBy("partition").agg((F.max("offset") + 1 - F.countDistinct("offset")).alias("gaps"))
    assert {r["gaps"] for r in gaps.collect()} == {0}
    in_order = store.messages().withColumn("n", F.col("key").cast("long"))
    late = in_order.alias("a").join(in_order.alias("b"), F.expr("a.partition = b.partition AND a.offset = b.offset - 1 AND a.n > b.n"))
    assert late.count() == 0


def test_rows_that_change_are_refused(spark, folder, monkeypatch):
    monkeypatch.setattr(numbering, "SINGLE_BYTES", 0)
    monkeypatch.setattr(numbering, "SINGLE_ROWS", 0)
    store = MessageLog(spark, folder, [TopicSpec("t", 1)])
    rows = spark.range(4000).select("id", F.lit("k").alias("key"), F.lit("x").alias("payload"))
    changing = F.udf(lambda: random.random(), "double").asNondeterministic()
    with pytest.raises(InvalidArgument):
        store.publish(rows.withColumn("r", changing()).filter("r < 0.5"), "t", ["id"])
    assert store.published().count() == 0


def test_large_inputs_ask_for_more_ranges(spark, monkeypatch):
    from pulsegrid import session

    df = spark.range(100_000)
    assert session.range_count(df) is None
    monkeypatch.setattr(session, "RANGE_BYTES", 40_000)
    assert session.range_count(df) == 20
    assert session.range_count(spark.createDataFrame([(1,)], "id int")) is None
    assert session.split_by_range(df, "id").rdd.getNumPartitions() == 20


def test_joins_do_not_multiply_ranges(spark):
    from pulsegrid import session

    left, right = spark.range(200_000), spark.range(200_000).selectExpr("id % 10 as id", "id as other")
    assert session.range_count(left.join(right, "id")) is None


def test_broadcasts_are_bounded_by_bytes(spark, monkeypatch):
    from pulsegrid import session

    df = spark.range(1000)
    hinted = lambda x: "strategy=broadcast" in x._jdf.queryExecution().analyzed().toString()
    assert hinted(session.checked_broadcast(df, rows=10))
    monkeypatch.setattr(session, "BROADCAST_BYTES", 4000)
    assert not hinted(session.checked_broadcast(df, rows=10))


def test_row_ids(spark):
    ids = numbering.assign_row_ids(spark.range(1000).withColumnRenamed("id", "n"), [F.desc("n")], start=10)
    assert ids.filter(F.col("id") != 10 + 999 - F.col("n")).count() == 0


def test_publish_continues_at_tail(spark, folder):
    store = store_of(spark, folder, 3, 2)
    more = spark.createDataFrame([(0, "0", "late"), (1, "1", "late")], "n int, key string, payload string")
    done = store.publish(more, "t", ["n"], router=lambda key: key.cast("int"))
    assert {(r["partition"], r["offset"]) for r in done.messages.collect()} == {(0, 3), (1, 2)}
    assert payloads(store.messages().filter("partition = 0")) == ["msg0", "msg1", "msg2", "late"]


def test_publish_again_replaces_the_batch(spark, folder):
    store = store_of(spark, folder, 3)
    more = spark.createDataFrame([(0, "0", "x"), (1, "0", "y")], "n int, key string, payload string")
    for _ in range(2):
        store.publish(more, "t", ["n"], router=lambda key: key.cast("int"), batch_id=1)
    assert payloads(store.messages()) == ["msg0", "msg1", "msg2", "x", "y"]


def test_publish_sets_aside_what_it_refuses(spark, folder):
    store = MessageLog(spark, folder, [TopicSpec("t", 2)])
    rows = [(0, "", "no key"), (1, None, "null key"), (2, "1", "fine"), (3, "9", "outside")]
    done = store.publish(
        spark.createDataFrame(rows, "n int, key string, payload string"), "t", ["n"], router=lambda k: k.cast("int")
    )
    assert {(r["reason"], r["raw"]) for r in done.rejects.collect()} == {
        ("missing_key", "no key"),
        ("missing_key", "null key"),
        ("partition_range", "outside"),
    }
    assert payloads(done.messages) == ["fine"]


def test_unknown_topic(spark, folder):
    store = MessageLog(spark, folder, [TopicSpec("t", 1)])
    with pytest.raises(TopicNotFound):
        store.publish(spark.createDataFrame([("k", "v", 1)], "key string, payload string, n int"), "none", ["n"])


def test_topic_name_with_special_characters(spark, folder):
    store = MessageLog(spark, folder, [TopicSpec("a:b c", 1)])
    store.publish(spark.createDataFrame([("k", "v", 1)], "key string, payload string, n int"), "a:b c", ["n"])
    assert payloads(store.consume("a:b c", "g", 5)) == ["v"]


def test_capacity(spark, folder):
    store = store_of(spark, folder, 5, 2, capacity=3)
    assert {tuple(r) for r in store.messages().groupBy("partition").count().collect()} == {(0, 3), (1, 2)}
    full = store.rejects().collect()
    assert {(r["reason"], r["raw"], r["partition"]) for r in full} == {
        ("partition_full", "msg3", 0),
        ("partition_full", "msg4", 0),
    }
    for p in (0, 1):
        store.ack("t", "g", p, 2)
    store.compact()
    more = spark.createDataFrame([(n, "0", f"new{n}") for n in range(4)], "n int, key string, payload string")
    store.publish(more, "t", ["n"], router=lambda key: key.cast("int"))
    assert payloads(store.messages().filter("partition = 0")) == ["msg2", "new0", "new1"]


# -- read -------------------------------------------------------------------


def test_read_window(spark, folder):
    store = store_of(spark, folder, 5)
    messages, extents = store.messages(), store.extents()
    assert payloads(log.read_from(messages, extents, "t", 0, 1, 2)) == ["msg1", "msg2"]
    assert log.read_from(messages, extents, "t", 0, 0, 0).count() == 5
    assert log.read_from(messages, extents, "t", 0, 5).count() == 0
    for bad in (6, -1):
        with pytest.raises(OffsetOutOfRange):
            log.read_from(messages, extents, "t", 0, bad)
    with pytest.raises(PartitionOutOfRange):
        log.read_from(messages, extents, "t", 1, 0)


def test_get(spark, folder):
    store = store_of(spark, folder, 3)
    assert payloads(log.get_message(store.messages(), store.extents(), "t", 0, 2)) == ["msg2"]
    for bad in (-1, 3):
        with pytest.raises(OffsetOutOfRange):
            log.get_message(store.messages(), store.extents(), "t", 0, bad)


def test_consume_does_not_advance(spark, folder):
    store = store_of(spark, folder, 5)
    for _ in range(2):
        batch = store.consume("t", "g", 3)
        assert payloads(batch) == ["msg0", "msg1", "msg2"]
        assert {r["next_offset"] for r in batch.collect()} == {3}
    store.ack("t", "g", 0, 3)
    assert payloads(store.consume("t", "g", 3)) == ["msg3", "msg4"]
    assert payloads(store.consume("t", "g")) == ["msg3"]
    store.ack("t", "g", 0, 5)
    assert store.consume("t", "g", 3).count() == 0
    positions = log.consume_positions(store.commits(), store.extents(), "t", "g", 3).first()
    assert (positions["start_offset"], positions["next_offset"]) == (5, 5)


def test_consume_arguments(spark, folder):
    store = store_of(spark, folder, 1)
    with pytest.raises(InvalidArgument):
        store.consume("t", "", 1)
    for batch in (0, -1):
        with pytest.raises(InvalidArgument):
            store.consume("t", "g", batch)
    with pytest.raises(TopicNotFound):
        store.consume("none", "g")
    for partition in (-1, 1):
        with pytest.raises(PartitionOutOfRange):
            store.consume("t", "g", 1, partition)


def test_groups_are_independent(spark, folder):
    store = store_of(spark, folder, 4, 4)
    store.ack("t", "a", 0, 3)
    assert {(r["partition"], r["offset"]) for r in store.consume("t", "a", 2).collect()} == {(0, 3), (1, 0), (1, 1)}
    assert {(r["partition"], r["offset"]) for r in store.consume("t", "b", 1).collect()} == {(0, 0), (1, 0)}
    assert [r["offset"] for r in store.consume("t", "b", 1, partition=1).collect()] == [0]


def test_wide_topic_reads_like_a_narrow_one(spark, folder, monkeypatch):
    store = store_of(spark, folder, 6, 4, 2)
    store.ack("t", "g", 0, 1)
    narrow = store.consume("t", "g", 2)
    monkeypatch.setattr(log, "LITERAL_PARTITIONS", 1)
    wide = store.consume("t", "g", 2)
    assert narrow.exceptAll(wide).count() == 0 and wide.exceptAll(narrow).count() == 0 and wide.count() == 6


def test_consume_predicates_reach_the_scan(spark, folder):
    store = store_of(spark, folder, 50, 50)
    plan = store.consume("t", "g", 2)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(offset" in pushed and "LessThan(offset" in pushed


def test_group_with_its_own_offsets(spark, folder):
    """A commit without a range check, as a group that tracks itself makes."""
    store = store_of(spark, folder, 1)
    past = store.extents().select("topic", "partition", F.lit("g").alias("group"), F.lit(9).cast("bigint").alias("offset"))
    with pytest.raises(InvalidArgument):
        store.acknowledge(past)
    store.acknowledge(past, validate=False)
    with pytest.raises(OffsetOutOfRange):
        store.consume("t", "g", 1)


# -- commit -----------------------------------------------------------------


def test_commit_rules(spark, folder):
    store = store_of(spark, folder, 3)
    assert log.committed_offsets(store.commits(), store.extents(), "g").first()["offset"] == 0
    store.ack("t", "g", 0, 2)
    for bad in (4, -1):
        with pytest.raises(InvalidArgument, match="offset out of range"):
            store.ack("t", "g", 0, bad)
    with pytest.raises(InvalidArgument, match="empty group"):
        store.ack("t", "", 0, 1)
    assert relative_commits(store) == {"g": 2}
    store.ack("t", "g", 0, 1)
    assert relative_commits(store) == {"g": 1}


def test_watermark_moves(spark, folder):
    store = store_of(spark, folder, 10)
    seen = [watermark(store)]
    for acks in ([("g1", 3)], [("g2", 5)], [("g1", 7)], [("g1", 9), ("g2", 9)]):
        for group, offset in acks:
            store.ack("t", group, 0, offset)
        seen.append(watermark(store))
    assert seen == [0, 3, 3, 5, 9]


def test_registered_group_holds_watermark(spark, folder):
    store = store_of(spark, folder, 10)
    store.ack("t", "g1", 0, 4)
    late = spark.createDataFrame([("t", "late"), ("t", "g1")], "topic string, group string")
    assert store.watermarks(late).first()["watermark"] == 0
    store.ack("t", "late", 0, 2)
    assert store.watermarks(late).first()["watermark"] == 2


def test_lag(spark, folder):
    store = store_of(spark, folder, 10)
    store.ack("t", "g", 0, 4)
    assert [(r["group"], r["lag"]) for r in store.lag().collect()] == [("g", 6)]


# -- compaction -------------------------------------------------------------


def test_compact(spark, folder):
    store = store_of(spark, folder, 10)
    store.ack("t", "g1", 0, 5)
    store.ack("t", "g2", 0, 7)
    plan = store.compact("t").collect()
    assert [(r["id"], r["removed"]) for r in plan] == [("t-0", 5)]
    stats = store.stats().first()
    assert (stats["id"], stats["message_count"], stats["tail_offset"]) == ("t-0", 5, 5)
    assert relative_commits(store) == {"g1": 0, "g2": 2}
    left = log.rebase_messages(store.stored_messages(), store.bases())
    assert payloads(left) == [f"msg{n}" for n in range(5, 10)]
    assert [r["offset"] for r in left.orderBy("offset").collect()] == list(range(5))


def test_compact_without_groups_or_messages(spark, folder):
    store = store_of(spark, folder, 10, 0)
    assert {(r["id"], r["removed"]) for r in store.compact().collect()} == {("t-0", 0), ("t-1", 0)}
    assert store.messages().count() == 10


def test_compact_five_groups(spark, folder):
    store = store_of(spark, folder, 100)
    for i, offset in enumerate((50, 75, 25, 60, 40), 1):
        store.ack("t", f"group{i}", 0, offset)
    assert watermark(store) == 25
    assert store.compact().first()["removed"] == 25
    after = relative_commits(store)
    assert (after["group1"], after["group3"]) == (25, 0)
    assert store.messages().count() == 75


def test_compact_twice(spark, folder):
    store = store_of(spark, folder, 100)
    removed = []
    for a, b in ((30, 40), (50, 60)):  # absolute; the second round is 20 and 30 past the new base
        store.ack("t", "g1", 0, a)
        store.ack("t", "g2", 0, b)
        removed.append(store.compact().first()["removed"])
    assert removed == [30, 20]
    assert store.messages().count() == 50
    assert relative_commits(store) == {"g1": 0, "g2": 10}


def test_slow_consumer_keeps_messages(spark, folder):
    store = store_of(spark, folder, 100)
    store.ack("t", "fast", 0, 80)
    store.ack("t", "slow", 0, 30)
    assert store.compact().first()["removed"] == 30
    assert store.messages().count() == 70


def test_compact_reports_every_partition(spark, folder):
    store = store_of(spark, folder, 10, 10, 10)
    store.ack("t", "g", 1, 4)
    plan = store.compact("t")
    assert {(r["id"], r["removed"]) for r in plan.collect()} == {("t-0", 0), ("t-1", 4), ("t-2", 0)}
    assert tuple(compaction.compaction_summary(plan).first()) == ("t", 4, 3)
    with pytest.raises(TopicNotFound):
        store.compact("none")


@pytest.mark.parametrize(
    "messages,compactable,threshold,due",
    [(5, 0, 10, False), (15, 0, 10, True), (10, 0, 10, False), (10, 5, 10, False), (10, 6, 10, True), (9, 0, 0, False), (9, 1, 0, True), (9, 5, 9, True), (9, 4, 9, False)],
)
def test_triggers(spark, messages, compactable, threshold, due):
    stats = spark.createDataFrame(
        [("t", 0, messages, compactable), ("t", 1, 0, 0)],
        "topic string, partition int, message_count bigint, compactable_count bigint",
    )
    assert compaction.compaction_triggers(stats, threshold).first()["due"] is due


def test_only_due_topics_are_compacted_and_reclaimed(spark, folder):
    from pulsegrid.streaming.compaction import compact_due_topics

    store = MessageLog(spark, folder, [TopicSpec("big", 1), TopicSpec("small", 1)])
    for topic, count in (("big", 20), ("small", 5)):
        messages = spark.range(count).selectExpr("id as n", "'k' as key", "string(id) as payload")
        store.publish(messages, topic, ["n"])
        store.publish(messages, topic, ["n"])
        store.ack(topic, "g", 0, count + 1)
    done = {tuple(r) for r in compact_due_topics(store, threshold=14).collect()}
    assert done == {("big", 21, 1)}
    assert {tuple(r) for r in store.messages().groupBy("topic").count().collect()} == {("big", 19), ("small", 10)}
    # The first publish of the big topic lay below the base as a whole.
    assert store.stored_messages().filter("topic = 'big'").count() == 20
    assert store.extents().filter("topic = 'big'").first()["message_count"] == 19


def test_kept_plus_removed_is_everything(spark, folder):
    store = store_of(spark, folder, 17, 5, 0)
    for p, at in ((0, 11), (1, 5)):
        store.ack("t", "g", p, at)
    kept, plan = compaction.compact(store.messages(), store.watermarks())
    assert kept.count() + plan.agg(F.sum("removed")).first()[0] == 22


def test_stalled_watermarks(spark):
    snaps = [("t", 0, 1, 10, 5), ("t", 0, 2, 12, 5), ("t", 0, 3, 12, 5), ("t", 0, 4, 15, 9), ("t", 1, 1, 3, 0), ("t", 1, 3, 9, 0)]
    df = spark.createDataFrame(snaps, "topic string, partition int, snapshot_id bigint, tail_offset bigint, watermark bigint")
    assert [tuple(r) for r in log.stalled_watermarks(df).collect()] == [("t", 0, 2, 5, 2)]


def test_snapshots(spark, folder):
    store = store_of(spark, folder, 4)
    store.ack("t", "g", 0, 2)
    assert store.take_snapshot() == 0
    store.publish(spark.createDataFrame([("0", "x", 1)], "key string, payload string, n int"), "t", ["n"], router=lambda k: k.cast("int"))
    assert store.take_snapshot() == 1
    store.ack("t", "g", 0, 5)
    assert store.take_snapshot() == 2
    assert [tuple(r) for r in store.stalled().collect()] == [("t", 0, 1, 2, 1)]


def test_retained_bytes(spark, folder):
    store = store_of(spark, folder, 10)
    store.ack("t", "g", 0, 6)
    row = log.retained_bytes(store.messages(), store.watermarks()).first()
    assert (row["retained_bytes"], row["bound_bytes"]) == (16, 16.0)


def test_bases_are_pushed_into_the_scan(spark, folder):
    store = store_of(spark, folder, 20, 20, 20)
    assert "base_offset" not in store.messages()._jdf.queryExecution().optimizedPlan().toString()
    for p in (0, 1):
        store.ack("t", "g", p, 5 + p)
    store.compact()
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    live = store.messages()
    pushed = next(line for line in live._jdf.queryExecution().executedPlan().toString().split("\n") if "PushedFilters" in line)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(offset,5)" in pushed and "GreaterThanOrEqual(offset,6)" in pushed
    kept = live.groupBy("partition").agg(F.min("offset").alias("low"), F.count("*").alias("n")).collect()
    assert {tuple(r) for r in kept} == {(0, 5, 15), (1, 6, 14), (2, 0, 20)}


def test_reclaim_does_not_look_back(spark, folder, monkeypatch):
    from pulsegrid.sources import message_log

    store = MessageLog(spark, folder, [TopicSpec("t", 1)])

    def publish(n):
        for i in range(n):
            store.publish(spark.createDataFrame([(0, "k", "x")], "n int, key string, payload string"), "t", ["n"])

    asked = []
    monkeypatch.setattr(message_log, "folder_exists", lambda spark, path: "batch_id=" in path and asked.append(path) or exists(spark, path))
    from pulsegrid.session import folder_exists as exists

    publish(6)
    store.ack("t", "g", 0, 4)
    store.compact()
    asked.clear()
    assert store.reclaim() == 4 and len(asked) == 4
    asked.clear()
    assert store.reclaim() == 0 and asked == []
    publish(1)
    store.ack("t", "g", 0, 6)
    store.compact()
    asked.clear()
    assert store.reclaim() == 2 and len(asked) == 2
    assert [r["offset"] for r in store.messages().collect()] == [6]


def test_ranges_are_searched_in_compiled_code(spark):
    rows = spark.range(500).select(F.when(F.col("id") % 50 > 0, F.col("id") % 97).alias("a"), F.col("id").alias("row"))
    rows = rows.select(F.struct("a", F.col("a").cast("string").alias("b")).alias("source"), "row")
    key = numbering.order_key(rows, ["source", "row"])
    for count in (1, 2, 7, 40):
        bounds, kind = numbering.range_bounds(rows, key, count)
        placed = numbering.with_range(rows, key, bounds, kind)
        plan = placed._jdf.queryExecution().executedPlan().toString()
        assert "lambda" not in plan and "aggregate(" not in plan
        in_order = [r["_range"] for r in placed.orderBy("source", "row").collect()]
        assert in_order == sorted(in_order) and set(in_order) == set(range(len(bounds) + 1))
        # The first row of each range is its bound.
        firsts = placed.groupBy("_range").agg(F.min(key).alias("first")).orderBy("_range").collect()
        assert [r["first"] for r in firsts[1:]] == bounds
