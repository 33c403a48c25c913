"""Packing along a space-filling curve.

Documents become hashed word-count vectors, projected to a few dimensions whose
ranks give a cell of a grid; the Hilbert key of the cell orders them, so that
neighbours on the curve have alike words. The token stream in that order is cut
every ``length`` tokens, which pads nothing but the last sequence.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import ROW, in_order, staged, table, text_or_empty, with_row_id
from pulsegrid.llm.shingles import text_slices

LENGTH = 1024
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
# Buckets of the hashed word counts, dimensions of the curve, bits of each.
BUCKETS, DIMENSIONS, BITS = 512, 3, 10
SEED = 7


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class TextTokenizer:
    """Ids of whole texts under a byte-level vocabulary file.

    A file of ranks next to the vocabulary (same name, ``.tiktoken``) has the
    same tokens and is faster. It is used for Latin-1 texts, for which the two
    libraries split words alike; any other text goes to the vocabulary file
    itself, and so does every text when there are no ranks.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core already
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        self.fast = None
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                tokens = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 16-bit numbers."""
        if self.fast and _is_latin(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u2").tobytes()
        ids = np.array(self.model.encode(text, add_special_tokens=False).ids, dtype="<u4")
        if len(ids) and ids.max() > 0xFFFF:
            raise ValueError("ids must fit 16 bits")
        return ids.astype("<u2").tobytes()


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def projection(buckets: int = BUCKETS, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((buckets, dimensions)).astype(np.float32)


def word_vectors(texts: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
    """Hashed word counts of every text, dampened and of unit length."""
    out = np.zeros((len(texts), buckets), dtype=np.float32)
    for i, text in enumerate(texts):
        data = np.frombuffer(b" " + text + b" ", dtype=np.uint8)
        gap = np.flatnonzero((data == 32) | ((data >= 9) & (data <= 13)))
        start, stop = gap[:-1] + 1, gap[1:]
        start, stop = start[stop > start], stop[stop > start]
        if not len(start):
            continue
        # A word's hash: length, first and last bytes and the sum of its squared bytes.
        sums = np.concatenate(([0], np.cumsum(data.astype(np.int64) ** 2)))
        key = (sums[stop] - sums[start]) * 31 + (stop - start) * 131 + data[start].astype(np.int64) * 7 + data[stop - 1].astype(np.int64) * 1009
        counts = np.bincount((key * 2654435761 >> 11) % buckets, minlength=buckets)
        row = np.log1p(counts)
        out[i] = row / np.linalg.norm(row)
    return out


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of integer cells, a column per dimension.

    Skilling's transpose (2004): undo the excess work from the top bit down,
    Gray-encode, then interleave the bits.
    """
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(high, p, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), dtype=np.int64)
    q = top
    while q > 1:
        t ^= np.where((x[:, n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> bit) & 1)
    return key


def _tokenised(tokenizer: str):
    """Batches of (row, doc_id, text) to (row, doc_id, projected place, token count, ids as 16 or 32 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, plane = TextTokenizer(tokenizer), projection()
        for batch in batches:
            for part in text_slices(batch):
                texts = part.column("text").to_pylist()
                ids = [model.encode(t) for t in texts]
                place = word_vectors([t.encode() for t in texts]) @ plane
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), *(pa.array(place[:, d].astype(np.float64)) for d in range(DIMENSIONS))]
                    + [pa.array([len(b) // 2 + 1 for b in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["row", "doc_id", *(f"p{d}" for d in range(DIMENSIONS)), "tokens", "ids"],
                )

    return run


def _keyed(edges: list[list[float]]):
    """The Hilbert key of a projected place: quantile edges make the cells of a grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [np.searchsorted(np.array(e), batch.column(f"p{d}").to_numpy()) for d, e in enumerate(edges)]
            key = hilbert_key(np.stack(cells, axis=1)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(key), batch.column("tokens")], names=["row", "doc_id", "key", "tokens"]
            )

    return run


def _cut(length: int):
    """Pieces of every document between the multiples of ``length`` in the whole stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: [] for n in ("row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            for row, doc, begin, tokens, raw in zip(*(batch.column(n).to_pylist() for n in ("row", "doc_id", "begin", "tokens", "ids"))):
                ids = np.append(np.frombuffer(raw, "<u2"), END_ID).astype("<u4")
                at = 0
                while at < tokens:
                    sequence, offset = divmod(begin + at, length)
                    n = min(tokens - at, length - offset)
                    values = (row, doc, at, n, zlib.crc32(ids[at : at + n].tobytes()), tokens, sequence, offset)
                    for c, v in zip(cols.values(), values):
                        c.append(v)
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in cols.values()], names=list(cols))

    return run


def pack_along_curve(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document's tokens are its text's ids and a closing 0; a null or empty text
    is the 0 alone. Along the curve, ties by doc_id and then position, every
    sequence is filled to ``length``; only the last may be shorter. Rows that
    repeat a doc_id are packed each. Other columns are ignored. An empty table
    gives no rows. Ids must fit 16 bits, as those of a 50k vocabulary do.
    """
    rows = with_row_id(docs, F.col("doc_id").cast("long"), text_or_empty(text).alias("text"))
    rows = rows.select(F.col(ROW).alias("row"), "doc_id", "text")
    places = [f"p{d}" for d in range(DIMENSIONS)]
    schema = "row long, doc_id long, " + ", ".join(f"{p} double" for p in places) + ", tokens long, ids binary"
    ids = staged(rows.mapInArrow(_tokenised(tokenizer or default_tokenizer()), schema), "pack-ids")
    cells = 1 << BITS
    edges = ids.approxQuantile(places, [i / cells for i in range(1, cells)], 1 / (2 * cells))
    if not edges[0]:
        edges = [[0.0]] * DIMENSIONS
    narrow = ids.select("row", "doc_id", *places, "tokens").mapInArrow(_keyed(edges), "row long, doc_id long, key long, tokens long")
    begins = in_order(narrow, ["key", "doc_id", "row"], {"begin": F.col("tokens")}, "pack-order").select("row", "begin")
    pieces = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    out = ids.select("row", "doc_id", "tokens", "ids").join(begins, "row").mapInArrow(_cut(length), pieces)
    return out.drop("row")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_along_curve(table(spark, sf_dir, "documents"))
