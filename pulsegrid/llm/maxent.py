"""Language-model scoring with a hashed maximum-entropy model.

The next token is predicted in two softmax steps, its class and then its place
in the class. Features of the history (the word before, the two before, and the
one before that skipped to) are hashed to rows of weights, one weight per class
or place. The most frequent words fill the head classes; all other words fall by
their ending into tail classes, where their share follows their exact counts, so
every text has a probability.

Weights are trained by rounds of distributed gradient updates: each task runs
AdaGrad minibatches over its part of the round's documents from the common
weights and AdaGrad state. A row's change is averaged over the tasks that met the
row, by how often each did, so a history that one task met keeps its whole change.
The rounds grow with the training text. Counts cover all training text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import ROW, input_bytes, staged, table, text_or_empty, with_row_id
from pulsegrid.llm.shingles import SPREAD, hash_words_and_endings, mix64, text_slices
from pulsegrid.session import work_folder

HEAD_CLASSES, TAIL_CLASSES, MEMBERS = 48, 16, 64
CLASSES = HEAD_CLASSES + TAIL_CLASSES
# Rows of hashed weights: per history feature of the classes, and of all places together.
CLASS_ROWS, PLACE_ROWS = 4096, 8192
# Rounds at least; the square root of the training tokens over ROUND_TOKENS where that is more.
ROUNDS = 3
ROUND_TOKENS = 1 << 23
MINIBATCH = 2048
RATE = 0.1
# Counts of this many words go to the tasks; those of all others are joined.
COMMON_WORDS = 200_000
SMOOTHING = 0.1
START, END = (int(mix64(np.array([s], dtype=np.uint64))[0]) for s in (0x57A7, 0xE9D0))
# Rows of weights in one row of the table in which tasks hand in their changes.
BLOCK_ROWS = 256
SALTS = 256
# Input of a training task, at least: every task hands in the changes of all weights.
TASK_BYTES = 32 << 20


class Tokens:
    """Token stream of some texts: word hashes with an end per text, and what precedes each."""

    def __init__(self, texts: list[bytes]):
        words, bounds, endings = hash_words_and_endings(texts)
        n = np.diff(bounds)
        self.sizes = n + 1
        last = np.cumsum(self.sizes) - 1
        total = int(self.sizes.sum())
        is_end = np.zeros(total, dtype=bool)
        is_end[last] = True
        self.words = np.empty(total, dtype=np.uint64)
        self.words[~is_end], self.words[is_end] = words, END
        self.tail = np.zeros(total, dtype=np.int64)
        self.tail[~is_end] = (mix64(endings.astype(np.uint64)) % np.uint64(TAIL_CLASSES)).astype(np.int64)
        self.text = np.repeat(np.arange(len(texts)), self.sizes)
        self.starts = last - n
        self._distinct = None

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The different words, and which of them every token is."""
        if self._distinct is None:
            self._distinct = np.unique(self.words, return_inverse=True)
        return self._distinct

    def before(self, values: np.ndarray, back: int) -> np.ndarray:
        """The value ``back`` tokens earlier in the same text, else the start's."""
        out = np.empty_like(values)
        out[back:] = values[:-back] if back < len(values) else values[:0]
        out[:back] = START
        for i in range(back):
            at = self.starts + i
            out[at[at <= self.starts + self.sizes - 1]] = START
        return out


class Model:
    """Shortlist, class shares and weights; a few megabytes, whatever the corpus."""

    def __init__(self, shortlist: np.ndarray, counts: np.ndarray, tail_counts: np.ndarray):
        order = np.argsort(shortlist)
        self.words, self.slot = shortlist[order], order.astype(np.int64)
        mass = np.zeros(HEAD_CLASSES * MEMBERS)
        mass[: len(counts)] = counts
        place = mass.reshape(HEAD_CLASSES, MEMBERS)
        shares = np.concatenate((place.sum(1), tail_counts + SMOOTHING))
        # A class or place without words gets no probability.
        closed = np.float32(-40.0)
        with np.errstate(divide="ignore"):
            self.class_bias = np.maximum(np.log(shares / shares.sum()), closed).astype(np.float32)
            self.place_bias = np.maximum(np.log(place / np.maximum(place.sum(1, keepdims=True), 1)), closed).astype(np.float32)
        self.by_class = np.zeros((3 * CLASS_ROWS, CLASSES), dtype=np.float32)
        self.by_place = np.zeros((PLACE_ROWS, MEMBERS), dtype=np.float32)
        # What AdaGrad has seen of every row in the rounds before.
        self.seen = np.full(3 * CLASS_ROWS + PLACE_ROWS, 1.0, dtype=np.float32)

    def weights(self) -> np.ndarray:
        return np.concatenate((self.by_class, self.by_place))

    def add(self, change: np.ndarray, grown: np.ndarray) -> None:
        self.by_class += change[: len(self.by_class)]
        self.by_place += change[len(self.by_class) :]
        self.seen += grown

    def targets(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Class and place of every token (place -1 in tail classes), and its history's hashed rows."""
        distinct, at = tokens.distinct()
        slot = np.full(len(distinct), -1, dtype=np.int64)
        if len(self.words):
            near = np.minimum(np.searchsorted(self.words, distinct), len(self.words) - 1)
            slot = np.where(self.words[near] == distinct, self.slot[near], -1)
        slot = slot[at]
        cls = np.where(slot >= 0, slot // MEMBERS, HEAD_CLASSES + tokens.tail)
        one, two = tokens.before(tokens.words, 1), tokens.before(tokens.words, 2)
        both = mix64(one * SPREAD[0] + two * SPREAD[1])
        rows = np.stack([mix64(f * SPREAD[2 + i]) % np.uint64(CLASS_ROWS) + np.uint64(i * CLASS_ROWS) for i, f in enumerate((one, two, both))])
        own = cls.astype(np.uint64) * SPREAD[5]
        places = np.stack([mix64(f * SPREAD[6 + i] + own) % np.uint64(PLACE_ROWS) for i, f in enumerate((one, two))])
        return cls, np.where(slot >= 0, slot % MEMBERS, -1), rows.astype(np.int64), places.astype(np.int64)


# Logits beyond this are cut, in training and scoring alike.
STEEPEST = np.float32(60.0)


# Runs of more rows than this are left to reduceat, which works column by column and run by run.
SHORT_RUN = 8


def run_sums(values: np.ndarray, first: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Sums of runs of rows, to the last bit those of ``np.add.reduceat(values, first, axis=0)``."""
    out = np.take(values, first, axis=0)
    short = np.flatnonzero((times > 1) & (times <= SHORT_RUN))
    if len(short):
        short = short[np.argsort(-times[short], kind="stable")]
        n, at = times[short], first[short]
        rest = np.take(values, at + 1, axis=0)
        for i in range(2, int(n[0])):
            longer = int(np.searchsorted(-n, -i))
            rest[:longer] += np.take(values, at[:longer] + i, axis=0)
        out[short] += rest
    long = np.flatnonzero(times > SHORT_RUN)
    if len(long):
        n = times[long]
        begin = np.cumsum(n) - n
        picked = np.repeat(first[long] - begin, n) + np.arange(int(n.sum()))
        out[long] = np.add.reduceat(np.take(values, picked, axis=0), begin, axis=0)
    return out


class _Softmax:
    """Softmax of minibatches in memory that is used again and again."""

    def __init__(self, width: int):
        self.sum, self.part = (np.empty((MINIBATCH, width), dtype=np.float32) for _ in range(2))

    def gather(self, table_: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.take(table_, rows, axis=0, out=self.part[: len(rows)], mode="clip")

    def shares(self, bias: np.ndarray, table_: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exponentials of the logits of every token, and their sums."""
        out = np.take(table_, rows[0], axis=0, out=self.sum[: rows.shape[1]], mode="clip")
        for feature in rows[1:]:
            out += self.gather(table_, feature)
        out += bias
        np.minimum(out, STEEPEST, out=out)
        np.exp(out, out=out)
        return out, out.sum(axis=1)

    def log_share(self, bias: np.ndarray, table_: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
        p, total = self.shares(bias, table_, rows)
        return np.log(np.maximum(p[np.arange(len(p)), target] / total, 1e-30))

    def step(self, grad: "_AdaGrad", bias: np.ndarray, table_: np.ndarray, rows: np.ndarray, target: np.ndarray) -> None:
        p, total = self.shares(bias, table_, rows)
        p /= total[:, None]
        p[np.arange(len(p)), target] -= 1
        for feature in rows:
            order = np.argsort(feature.astype(np.uint16), kind="stable")
            ordered = feature[order]
            first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
            times = np.diff(np.append(first, len(ordered)))
            grad.step(table_, ordered[first], run_sums(self.gather(p, order), first, times), times)


class _AdaGrad:
    """Steps whose size shrinks with the gradients a row has seen. A step overwrites ``total``."""

    def __init__(self, seen: np.ndarray):
        self.seen, self.met = seen, np.zeros(len(seen), dtype=np.float32)

    def step(self, table_: np.ndarray, rows: np.ndarray, total: np.ndarray, times: np.ndarray) -> None:
        self.met[rows] += times
        seen = np.take(self.seen, rows)
        seen += np.square(total).mean(axis=1)
        self.seen[rows] = seen
        total *= (RATE / np.sqrt(seen))[:, None]
        now = np.take(table_, rows, axis=0)
        now -= total
        table_[rows] = now


def _gradients(model: Model, texts: Iterator[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minibatch updates over some texts: by row, the change, what AdaGrad saw and how often the row was met."""
    began, before = model.weights(), model.seen.copy()
    by_class, by_place = _AdaGrad(model.seen[: 3 * CLASS_ROWS]), _AdaGrad(model.seen[3 * CLASS_ROWS :])
    classes, members = _Softmax(CLASSES), _Softmax(MEMBERS)
    for part in texts:
        cls, place, rows, places = model.targets(Tokens(part))
        for a in range(0, len(cls), MINIBATCH):
            y, z = cls[a : a + MINIBATCH], place[a : a + MINIBATCH]
            classes.step(by_class, model.class_bias, model.by_class, rows[:, a : a + MINIBATCH], y)
            head = np.flatnonzero(z >= 0)
            if len(head):
                members.step(by_place, model.place_bias[y[head]], model.by_place, places[:, a + head], z[head])
    return model.weights() - began, model.seen - before, np.concatenate((by_class.met, by_place.met))


def _copy(model: Model) -> Model:
    out = Model.__new__(Model)
    out.__dict__.update({k: v.copy() for k, v in model.__dict__.items()})
    return out


def _train(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = ([t.encode() for t in part.column("text").to_pylist()] for batch in batches for part in text_slices(batch))
        change, grown, met = _gradients(_copy(model), texts)
        blocks = [i for i in range(0, len(met), BLOCK_ROWS) if met[i : i + BLOCK_ROWS].any()]
        salt = TaskContext.get().partitionId() % SALTS
        cut = lambda v, width: pa.array([v[i : i + BLOCK_ROWS].astype(width).tobytes() for i in blocks], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(blocks, dtype=np.int64) // BLOCK_ROWS, pa.int32()), pa.array(np.full(len(blocks), salt), pa.int32())]
            + [cut(met, "<f8"), cut(grown, "<f4"), cut(change, "<f2")],
            names=["block", "salt", "met", "grown", "change"],
        )

    return run


def _mean_change(width: str):
    """Means of the tasks' changes, of every row over the tasks that met it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        met, grown, change = np.zeros(BLOCK_ROWS), np.zeros(BLOCK_ROWS), np.zeros((BLOCK_ROWS, MEMBERS))
        for m, g, c in zip(pdf["met"], pdf["grown"], pdf["change"]):
            times = np.frombuffer(m, dtype="<f8")
            met += times
            grown += times * np.frombuffer(g, dtype="<f4")
            change += times[:, None] * np.frombuffer(c, dtype=width).reshape(change.shape)
        often = np.maximum(met, 1)
        cells = {"met": met, "grown": (grown / often).astype("<f4"), "change": (change / often[:, None]).astype("<f4")}
        return pd.DataFrame({"block": [pdf["block"].iat[0]], "salt": [pdf["salt"].iat[0]]} | {k: [v.tobytes()] for k, v in cells.items()})

    return run


def rounds_for(tokens: int, least: int = ROUNDS) -> int:
    """Rounds of training: as many more as tasks of a round when the text grows."""
    return max(least, int(np.ceil(np.sqrt(tokens / ROUND_TOKENS))))


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the tokens of a batch by word and language."""
    for batch in batches:
        for part in text_slices(batch):
            langs, texts = part.column("lang").to_pylist(), [t.encode() for t in part.column("text").to_pylist()]
            for lang in sorted(set(langs)):
                tokens = Tokens([t for t, of in zip(texts, langs) if of == lang])
                word, at, n = np.unique(tokens.words, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word.view(np.int64)), pa.array(tokens.tail[at], pa.int32()), pa.array([lang] * len(word), pa.string()), pa.array(n, pa.int64())],
                    names=["word", "tail", "lang", "n"],
                )


def _scorer(model: Model, common: tuple[np.ndarray, np.ndarray], total: int, kinds: int, tail_sizes: np.ndarray, tail_kinds: np.ndarray):
    """Sums of every text, and its words whose counts the task does not have."""
    words, counts = common
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    base_of = np.log10(total + SMOOTHING * (kinds + 1))
    tail_of = np.log10(tail_sizes + SMOOTHING * (tail_kinds + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, members = _Softmax(CLASSES), _Softmax(MEMBERS)
        for batch in batches:
            for part in text_slices(batch):
                tokens = Tokens([t.encode() for t in part.column("text").to_pylist()])
                cls, place, rows, places = model.targets(tokens)
                logs = np.empty(len(cls))
                for a in range(0, len(cls), MINIBATCH):
                    y, z = cls[a : a + MINIBATCH], place[a : a + MINIBATCH]
                    logs[a : a + MINIBATCH] = classes.log_share(model.class_bias, model.by_class, rows[:, a : a + MINIBATCH], y)
                    head = np.flatnonzero(z >= 0)
                    if len(head):
                        logs[a + head] += members.log_share(model.place_bias[y[head]], model.by_place, places[:, a + head], z[head])
                logs /= np.log(10)
                distinct, at = tokens.distinct()
                known = np.zeros(len(distinct), dtype=np.int64)
                if len(words):
                    near = np.minimum(np.searchsorted(words, distinct), len(words) - 1)
                    known = np.where(words[near] == distinct, counts[near], 0)
                c = known[at]
                log_c = np.log10(c + SMOOTHING)
                here = c > 0
                logs += np.where(here & (place < 0), log_c - tail_of[tokens.tail], 0.0)
                n_texts = part.num_rows
                rest = np.flatnonzero(~here)
                ends = np.searchsorted(tokens.text[rest], np.arange(n_texts + 1))
                offsets = pa.array(ends, pa.int32())
                add = lambda v: pa.array(np.bincount(tokens.text, v, n_texts))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in (ROW, "doc_id", "held_out")), pa.array(tokens.sizes, pa.int64())]
                    + [pa.array(np.bincount(tokens.text, here, n_texts).astype(np.int64)), add(np.where(here, log_c - base_of, 0.0)), add(logs)]
                    + [pa.ListArray.from_arrays(offsets, pa.array(tokens.words[rest].view(np.int64)))]
                    + [pa.ListArray.from_arrays(offsets, pa.array(tokens.tail[rest], pa.int32()))],
                    names=[ROW, "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "words", "tails"],
                )

    return run


def score_documents(docs: DataFrame, rounds: int = ROUNDS, common_words: int = COMMON_WORDS, group: str | None = "lang", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Tokens are the words with A-Z in lower case and one end. Documents whose
    CRC-32 of the doc_id as text is a multiple of 10 are held out; a null doc_id
    counts as the empty text and is. ``base_score`` is the smoothed unigram
    log10 probability, ``score`` the model's. ``group`` names a column by which
    frequent words are sorted into classes; scoring does not look at it. A null
    or empty text is its end alone. Repeated rows count, and are scored, each.
    Without training documents both scores follow from smoothing alone. Other
    columns are ignored. An empty table gives no rows. Training follows the
    partitions of the input, so reruns over the same files agree, and another
    layout moves scores slightly.
    """
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    kind = F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")
    source = docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), text_or_empty(text).alias("text"), kind.alias("lang"))
    train = source.filter(~F.col("held_out"))

    by_lang = train.select("lang", "text").mapInArrow(_counter, "word long, tail int, lang string, n long")
    by_lang = by_lang.groupBy("word", "tail", "lang").agg(F.sum("n").alias("n"))
    counts = staged(by_lang.groupBy("word", "tail").agg(F.sum("n").alias("c"), F.max_by("lang", "n").alias("lang")), "word-counts")
    common = counts.orderBy(F.desc("c"), "word").limit(common_words).select("word", "tail", "lang", "c").toArrow().to_pandas()
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()

    short = common.head(HEAD_CLASSES * MEMBERS).sort_values(["lang", "c", "word"], ascending=[True, False, True])
    listed = short["word"].to_numpy(np.int64)
    sizes = np.zeros((2, TAIL_CLASSES))
    for r in counts.groupBy("tail").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        sizes[:, r["tail"]] = r["c"], r["v"]
    np.subtract.at(sizes[0], short["tail"].to_numpy(np.int64), short["c"].to_numpy(np.float64))
    np.subtract.at(sizes[1], short["tail"].to_numpy(np.int64), 1.0)

    turns = rounds_for(total, rounds) if rounds and total else 0
    # More tasks than there are partitions change nothing.
    tasks = max(1, min(-(-input_bytes(docs) * rounds // (TASK_BYTES * max(turns, 1))), 1 << 30))
    model = Model(listed.view(np.uint64), short["c"].to_numpy(np.float64), sizes[0])
    schema = "block int, salt int, met binary, grown binary, change binary"
    if turns:
        # Dealt out once, so that a round reads its own documents only.
        path = work_folder(spark := docs.sparkSession, "train-turns")
        turn = F.pmod(F.xxhash64("doc_id"), F.lit(turns)).cast("int")
        train.select("text", turn.alias("turn")).write.partitionBy("turn").parquet(path)
        dealt = spark.read.schema("text string, turn int").parquet(path)
    for i in range(turns):
        change = dealt.filter(F.col("turn") == i).select("text").coalesce(tasks).mapInArrow(_train(model), schema)
        change = change.groupBy("block", "salt").applyInPandas(_mean_change("<f2"), schema)
        parts = change.groupBy("block").applyInPandas(_mean_change("<f4"), schema).collect()
        change, grown = np.zeros_like(model.weights()), np.zeros_like(model.seen)
        for r in parts:
            at = slice(r["block"] * BLOCK_ROWS, (r["block"] + 1) * BLOCK_ROWS)
            change[at] = np.frombuffer(r["change"], dtype="<f4").reshape(BLOCK_ROWS, MEMBERS)
            grown[at] = np.frombuffer(r["grown"], dtype="<f4")
        model.add(change, grown)

    scorer = _scorer(model, (common["word"].to_numpy(np.int64).view(np.uint64), common["c"].to_numpy(np.int64)), total, kinds, sizes[0], sizes[1])
    fields = f"{ROW} long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, words array<long>, tails array<int>"
    rows = staged(with_row_id(source, "doc_id", "held_out", "text").select(ROW, "doc_id", "held_out", "text").mapInArrow(scorer, fields), "scored")

    # Rarer words: how often a text has them, joined with their counts.
    rare = rows.select(ROW, F.explode(F.arrays_zip("words", "tails")).alias("w")).select(ROW, "w.words", "w.tails")
    rare = rare.groupBy(ROW, F.col("words").alias("word"), F.col("tails").alias("tail")).agg(F.count(F.lit(1)).alias("times"))
    rare = rare.join(counts.select("word", "c"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    log_c = F.log10(F.col("c") + SMOOTHING)
    tail_of = F.array(*(F.lit(float(v)) for v in np.log10(sizes[0] + SMOOTHING * (sizes[1] + 1))))
    more = rare.groupBy(ROW).agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * (log_c - float(np.log10(total + SMOOTHING * (kinds + 1))))).alias("more_base"),
        F.sum(F.col("times") * (log_c - F.get(tail_of, F.col("tail")))).alias("more_score"),
    )
    joined = rows.drop("words", "tails").join(more, ROW, "left")
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def op1_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
