"""WARC archives: monolithic gzip streams rewritten as a member per record.

Pages become archives that are one gzip stream each, as a careless crawler
writes them. The normaliser inflates every archive once, front to back, and
rewrites each record as its own gzip member next to a sidecar index of offsets,
so that any record can be read alone. Repeated payloads become revisits on the
way, by decisions joined from digests; payloads are never shuffled.

Tasks write files of their own under names no other attempt uses, and only files
named by a finished task are read: a lost executor leaves garbage, not damage.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import staged, table
from pulsegrid.session import remove_folder, work_folder

# An archive is closed once its records hold so many bytes.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 20
# Payloads shorter than this are stored whole however often they occur.
LEAST_REVISIT = 100
# Records that one reading task takes from an archive at a time.
SLICE_RECORDS = 2000
# Version line, revisit profile and media types of WARC 1.1.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_RESPONSE = "application/http; msgtype=response"
INFO_FIELDS = "application/warc-fields"
END = b"\r\n\r\n"

WRITTEN = "archive string, seq long, page_id long, payload_bytes long, payload_digest string"
NORMALISED = "archive string, sidecar string, records long, bytes long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string"


# -- files and records -------------------------------------------------------------------------


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI (local, HDFS, S3, GCS) and the path inside it."""
    if "://" in path and not path.startswith("file:"):
        return pa.fs.FileSystem.from_uri(path)
    return pa.fs.LocalFileSystem(), path.removeprefix("file:").replace("//", "/", 1) if path.startswith("file:") else path


def record_id(archive: str, seq: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{seq}')}>"


def record_bytes(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record: version line, fields that have a value, block."""
    lines = [VERSION, *(f"{name}: {value}" for name, value in fields if value is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def parse_head(head: bytes) -> dict[str, str]:
    """Fields of a record by lower-case name."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}


def one_line(text: str | None) -> str | None:
    """A url without the characters that would end its field."""
    return None if text is None else "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def inflated(stream, path: str) -> Iterator[bytes]:
    """The content of a gzip file of one or several members, piece by piece."""
    inflate = zlib.decompressobj(31)
    started = False
    while piece := stream.read(READ_BYTES):
        while piece:
            started = True
            yield inflate.decompress(piece)
            piece = inflate.unused_data
            if inflate.eof:
                inflate, started = zlib.decompressobj(31), False
    if started:
        raise ValueError(f"{path}: the gzip stream is cut off")


def records(pieces: Iterator[bytes], path: str) -> Iterator[tuple[bytes, bytes]]:
    """Head (without its empty line) and block of each record of an inflated archive."""
    held = bytearray()
    for piece in pieces:
        held += piece
        at = 0
        while (stop := held.find(END, at)) >= 0:
            head = bytes(held[at:stop])
            size = int(parse_head(head)["content-length"])
            begin = stop + len(END)
            if len(held) < begin + size + len(END):
                break
            yield head, bytes(held[begin : begin + size])
            at = begin + size + len(END)
        del held[:at]
    if held.strip():
        raise ValueError(f"{path}: the last record is cut off")


# -- writing -----------------------------------------------------------------------------------


def _writer(folder: str, archive_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inside = file_system(folder)
        out, deflate, archive, seq, held = None, None, "", 0, 0

        def close() -> None:
            if out is not None:
                out.write(deflate.flush())
                out.close()

        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                if out is None or held >= archive_bytes:
                    close()
                    fs.create_dir(inside, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    archive, seq, held = f"{folder}/{name}", 0, 0
                    out, deflate = fs.open_output_stream(f"{inside}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                    info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(archive, 0)), ("WARC-Date", date), ("Content-Type", INFO_FIELDS)]
                    out.write(deflate.compress(record_bytes(info, b"format: WARC File Format 1.1\r\n")))
                page, url = batch.column("page_id")[i].as_py(), batch.column("url")[i].as_py()
                payload = batch.column("html")[i].as_py().encode()
                digest = hashlib.sha256(payload).hexdigest()
                seq += 1
                fields = [
                    ("WARC-Type", "response"),
                    ("WARC-Record-ID", record_id(archive, seq)),
                    ("WARC-Date", date),
                    ("WARC-Target-URI", one_line(url)),
                    ("WARC-Payload-Digest", f"sha256:{digest}"),
                    ("X-Page-Id", page),
                    ("Content-Type", HTTP_RESPONSE),
                ]
                record = record_bytes(fields, http_head(len(payload)) + payload)
                out.write(deflate.compress(record))
                held += len(record)
                rows.append((archive, seq, page, len(payload), digest))
            if rows:
                columns = zip(*rows)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                names = ["archive", "seq", "page_id", "payload_bytes", "payload_digest"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
        close()

    return run


def write_monolithic(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of one gzip stream each below ``folder``; returns a row per record of a page.

    The archives of a task follow its split of ``pages``; nothing is shuffled.
    """
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    source = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )
    return staged(source.mapInArrow(_writer(folder, archive_bytes, date), WRITTEN), "warc-written")


def find_revisits(written: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Records that repeat a payload: ``archive, seq`` and the record that keeps it.

    Of equal payloads the record with the smallest page_id stays (a null page_id
    comes last), of repeated page_ids any one. Digests that more than a
    thousandth of all records share are a thousand at most and are broadcast;
    the others are too rare to make a task large.
    """
    place = F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "archive", "seq")
    large = written.filter(F.col("payload_bytes") >= least)
    total = large.count()
    groups = large.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("first")).filter("copies > 1")
    groups = staged(groups, "warc-groups")
    hot = F.broadcast(groups.filter(F.col("copies") * 1000 > total))
    rare = groups.filter(F.col("copies") * 1000 <= total)
    rows = large.select("archive", "seq", "payload_digest")
    both = rows.join(hot, "payload_digest").unionByName(rows.join(hot, "payload_digest", "left_anti").join(rare, "payload_digest"))
    repeats = (F.col("archive") != F.col("first.archive")) | (F.col("seq") != F.col("first.seq"))
    return both.filter(repeats).select(
        "archive", "seq", F.col("first.page_id").alias("of_page"), F.col("first.archive").alias("of_archive"), F.col("first.seq").alias("of_seq")
    )


# -- normalising -------------------------------------------------------------------------------


def _revisit(head: dict[str, str], block: bytes, of: dict) -> bytes:
    http = block[: block.find(END) + len(END)]
    fields = [
        ("WARC-Type", "revisit"),
        ("WARC-Record-ID", head["warc-record-id"]),
        ("WARC-Date", head.get("warc-date")),
        ("WARC-Target-URI", head.get("warc-target-uri")),
        ("WARC-Payload-Digest", head.get("warc-payload-digest")),
        ("WARC-Profile", SAME_PAYLOAD),
        ("WARC-Refers-To", record_id(of["of_archive"], of["of_seq"])),
        ("X-Page-Id", head.get("x-page-id")),
        ("X-Refers-To-Page-Id", of["of_page"]),
        ("Content-Type", HTTP_RESPONSE),
    ]
    return record_bytes(fields, http)


def _normaliser(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, inside = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                source, path = file_system(row["archive"])
                revisits = {r["seq"]: r for r in row["revisits"] or []}
                target.create_dir(inside, recursive=True)
                name = f"{path.rsplit('/', 1)[-1].removesuffix('.gz').removesuffix('.warc')}-{uuid.uuid4().hex[:12]}"
                at, lines = 0, []
                with (
                    source.open_input_stream(path, compression=None) as whole,
                    target.open_output_stream(f"{inside}/{name}.warc.gz", compression=None) as out,
                ):
                    for seq, (head, block) in enumerate(records(inflated(whole, path), path)):
                        fields = parse_head(head)
                        record = _revisit(fields, block, revisits[seq]) if seq in revisits else head + END + block + END
                        deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = deflate.compress(record) + deflate.flush()
                        out.write(member)
                        kind = "revisit" if seq in revisits else fields.get("warc-type", "")
                        lines.append(f"{at}\t{len(member)}\t{kind}\t{fields.get('warc-record-id', '')}\n")
                        at += len(member)
                with target.open_output_stream(f"{inside}/{name}.idx", compression=None) as out:
                    out.write("".join(lines).encode())
                done = [(f"{folder}/{name}.warc.gz",), (f"{folder}/{name}.idx",), (len(lines),), (at,)]
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(done, kinds)], names=["archive", "sidecar", "records", "bytes"])

    return run


def normalise(archives: DataFrame, folder: str, revisits: DataFrame | None = None, level: int = 6) -> DataFrame:
    """Rewrite every archive of ``archives`` (column ``archive``) with a gzip member per record.

    Returns a row per new archive: ``archive, sidecar, records, bytes``. A sidecar
    line has offset, length, type and id of a record, in file order. Records named
    by ``revisits`` (:func:`find_revisits`) lose their payload. An archive is one
    task, which holds one record at a time and the index of one archive.
    """
    names = archives.select("archive").distinct()
    if revisits is None:
        work = names.withColumn("revisits", F.array().cast("array<struct<seq:long,of_page:long,of_archive:string,of_seq:long>>"))
    else:
        one = F.collect_list(F.struct("seq", "of_page", "of_archive", "of_seq")).alias("revisits")
        work = names.join(revisits.groupBy("archive").agg(one), "archive", "left")
    work = staged(work, "warc-work")
    tasks = max(1, min(work.count(), 100_000))
    return staged(work.repartition(tasks).mapInArrow(_normaliser(folder, level), NORMALISED), "warc-archives")


# -- reading -----------------------------------------------------------------------------------


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            fs, path = file_system(row["archive"])
            index_fs, index = file_system(row["sidecar"])
            with index_fs.open_input_stream(index, compression=None) as f:
                lines = f.read().decode().splitlines()[row["first"] : row["first"] + SLICE_RECORDS]
            found = []
            with fs.open_input_file(path) as archive:
                for offset, length, kind, _ in (line.split("\t") for line in lines):
                    if kind not in ("response", "revisit"):
                        continue
                    archive.seek(int(offset))
                    raw = zlib.decompress(archive.read(int(length)), 31)
                    stop = raw.find(END)
                    head = parse_head(raw[:stop])
                    block = raw[stop + len(END) : stop + len(END) + int(head["content-length"])]
                    begin = block.find(END) + len(END)
                    stated = head["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response":
                        payload = block[begin:]
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        if digest != stated:
                            raise ValueError(f"{path} at {offset}: the payload does not match its digest")
                    else:
                        size, digest = int(parse_head(block[:begin])["content-length"]), stated
                    page, of = head.get("x-page-id"), head.get("x-refers-to-page-id")
                    found.append(
                        (page and int(page), size, digest, head["warc-type"], of and int(of), head.get("warc-target-uri"), head["warc-record-id"])
                    )
            if found:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)


def read_archives(archives: DataFrame) -> DataFrame:
    """The page records of normalised archives, found through their sidecars.

    An archive is read in slices of its index, each by a task of its own if need
    be. The digest of every stored payload is computed again; a mismatch fails.
    """
    slices = archives.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records"), F.lit(SLICE_RECORDS).cast("long"))))
    slices = slices.filter(F.col("first") < F.col("records")).select("archive", "sidecar", "first")
    n = archives.agg(F.sum(F.ceil(F.col("records") / SLICE_RECORDS))).first()[0]
    return slices.repartition(max(1, min(int(n or 0), 100_000))).mapInArrow(_reader, READ)


def archive_pages(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages into normalised archives below ``folder``, and every record read back.

    One row per page: ``page_id, payload_bytes, payload_digest, record_type,
    refers_to, url, record_id``. The payload is the html in UTF-8, a null html an
    empty one. Of equal payloads of at least ``LEAST_REVISIT`` bytes the record
    with the smallest page_id is the response and the others are revisits; rows
    that repeat a page_id count each, and a null page_id loses against any other.
    A null url leaves its field out; control characters in a url are percent
    encoded. Other columns are ignored. An empty table makes no archive and gives
    no rows.
    """
    spark = pages.sparkSession
    folder = folder or work_folder(spark, "warc")
    written = write_monolithic(pages, f"{folder}/whole", archive_bytes)
    archives = normalise(written, f"{folder}/records", find_revisits(written))
    remove_folder(spark, f"{folder}/whole")
    return read_archives(archives)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive_pages(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP11_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, payload_bytes >= 100 AND row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) > 1 AS again,
         min(page_id) OVER (PARTITION BY payload_digest) AS first
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to
FROM f
"""
