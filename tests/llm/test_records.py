"""WARC archives, hard negatives and the Merkle manifest against plain Python versions."""

import gzip
import hashlib
import io
import random
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import warc
from pulsegrid.llm.common import lower_ascii
from pulsegrid.llm.merkle import manifest, verify_documents
from pulsegrid.llm.negatives import MultiIndex, mine_negatives, prepare
from pulsegrid.llm.warc import archive_pages, normalise, read_archives, write_monolithic


def order(rows):
    return sorted(rows, key=str)


# -- WARC --------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string"
CLASHES = {"archive": "'x'", "seq": "1", "payload_digest": "'d'", "copies": "0", "first": "7", "record_id": "'r'", "text": "'t'"}


def pages_of(spark, rows):
    return spark.createDataFrame(rows, PAGES).selectExpr("*", *(f"{v} as {k}" for k, v in CLASHES.items()))


@pytest.fixture
def page_rows():
    same, tied = "<p>" + "same " * 40, "<b>" + "tied " * 40
    return [
        (1, None, None), (2, "http://a/", ""), (3, "http://b/\r\nX: y", "short"), (4, "http://c/", "short"), (5, "http://d/", "é\r\n\r\nWARC/1.1\r\n" + "ü" * 99),
        (9, "u", same), (7, "u", same), (8, "u", same), (None, "u", same), (6, "u", tied), (6, "v", tied), (None, None, None),
        (10, "long", "0123456789" * 300_000), (11, "long", "0123456789" * 300_000), (12, "just", "x" * 100), (13, "just", "x" * 100), (14, "under", "y" * 99), (15, "under", "y" * 99),
        (None, "n", "z" * 200), (None, "n", "z" * 200),
    ]


def brute_pages(rows):
    groups = defaultdict(list)
    for i, (page, _, html) in enumerate(rows):
        groups[(html or "").encode()].append((page is None, page, i))
    out = []
    for i, (page, _, html) in enumerate(rows):
        payload = (html or "").encode()
        first = min(groups[payload], key=lambda g: (g[0], g[1] or 0, g[2]))
        again = len(payload) >= 100 and first[2] != i
        out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", first[1] if again else None))
    return out


def test_pages_come_back_from_archives(spark, page_rows, folder):
    got = archive_pages(pages_of(spark, page_rows), folder, archive_bytes=2000).collect()
    assert order(tuple(r)[:5] for r in got) == order(brute_pages(page_rows))
    by_id = {r["record_id"]: r for r in got}
    assert len(by_id) == len(page_rows)
    assert next(r["url"] for r in got if r["page_id"] == 3) == "http://b/%0D%0AX: y"
    assert not list(Path(folder, "whole").glob("*")) and len(list(Path(folder, "records").glob("*.warc.gz"))) > 3
    assert archive_pages(pages_of(spark, [])).collect() == []


def test_each_record_is_a_member_of_its_own(spark, page_rows, folder):
    written = write_monolithic(pages_of(spark, page_rows).coalesce(1), f"{folder}/whole", 1 << 30)
    (whole,) = {r["archive"] for r in written.collect()}
    content = gzip.decompress(Path(whole).read_bytes())
    inflate = zlib.decompressobj(31)
    assert inflate.decompress(Path(whole).read_bytes()) == content and not inflate.unused_data
    (made,) = normalise(written, f"{folder}/records").collect()
    raw, index = Path(made["archive"]).read_bytes(), [line.split("\t") for line in Path(made["sidecar"]).read_text().splitlines()]
    assert gzip.decompress(raw) == content and made["bytes"] == len(raw) and made["records"] == len(page_rows) + 1 == len(index)
    for offset, length, kind, record in index:
        with gzip.GzipFile(fileobj=io.BytesIO(raw[int(offset) : int(offset) + int(length)])) as one:
            text = one.read()
        assert text.startswith(b"WARC/1.1\r\n") and f"WARC-Type: {kind}\r\nWARC-Record-ID: {record}\r\n".encode() in text
    # What is normal already stays as it is.
    again = normalise(spark.createDataFrame([(made["archive"],)], "archive string"), f"{folder}/again")
    assert gzip.decompress(Path(again.first()["archive"]).read_bytes()) == content
    assert order(tuple(r)[:3] for r in read_archives(again).collect()) == order(r[:3] for r in brute_pages(page_rows))


def test_damage_is_not_passed_on(spark, page_rows, folder):
    (whole,) = {r["archive"] for r in write_monolithic(pages_of(spark, page_rows).coalesce(1), f"{folder}/whole", 1 << 30).collect()}
    Path(whole).write_bytes(Path(whole).read_bytes()[:-20])
    with pytest.raises(Exception, match="cut off"):
        normalise(spark.createDataFrame([(whole,)], "archive string"), f"{folder}/records")


def test_slices_of_an_index(spark, page_rows, folder, monkeypatch):
    monkeypatch.setattr(warc, "SLICE_RECORDS", 3)
    got = archive_pages(pages_of(spark, page_rows * 5).coalesce(1), folder)
    assert order(tuple(r)[:3] for r in got.collect()) == order(r[:3] for r in brute_pages(page_rows * 5))


# -- hard negatives ----------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors_of(spark, rows):
    extra = {"row": "1", "vec": "'v'", "cell": "2", "bin": "3", "anchor": "4", "found": "'f'", "score": "0", "w": "9"}
    return spark.createDataFrame(rows, VECTORS).selectExpr("*", *(f"{v} as {k}" for k, v in extra.items()))


def brute_negatives(rows, every=10):
    kept = [
        (i, v, [int(np.floor(256 * float(np.float32(x)))) for x in e], label)
        for i, (v, e, label) in enumerate(rows)
        if None not in (v, e, label) and all(x is not None and np.isfinite(x) for x in e)
    ]
    out = []
    for i, v, e, label in kept:
        if v % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(e, f)), w, j, other) for j, w, f, other in kept if j != i)
        for score, w, _, _ in [s for s in scored if s[3] == label][:5]:
            fits = [s for s in scored if s[3] != label and 80 * -score <= 100 * -s[0] <= 100 * -score]
            out += [(v, w, rank, s[1], -score, -s[0]) for rank, s in enumerate(fits[:5], 1)]
    return out


def clustered(n, seed, width=8, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    rows = [(int(i), [float(x) for x in centres[i % 6] + 0.3 * rng.normal(size=width)], int(rng.integers(labels))) for i in range(n)]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_negatives_are_the_hardest(spark, seed):
    rows = clustered(700, seed)
    rows += [(1000 + i, rows[i][1], rows[i + 1][2]) for i in range(50)]  # equal vectors, other labels
    rows += [(2000 + i, rows[3][1], 1) for i in range(300)]  # a large group of equal rows
    nan, inf = float("nan"), float("inf")
    rows += [(None, [1.0] * 8, 1), (3000, None, 1), (3010, [1.0] * 8, None), (3020, [None] * 8, 1), (3030, [nan] * 8, 1), (3040, [inf] * 8, 1)]
    rows += [(10, rows[10][1], rows[10][2]), (3050, [], 1), (3060, [1.0, 2.0], 1), (3070, [0.0] * 8, 2)]
    got = mine_negatives(vectors_of(spark, rows), F.col("vec_id") % 10 == 0).collect()
    want = brute_negatives(rows)
    assert len(want) > 500 and order(map(tuple, got)) == order(want)


def test_few_rows(spark):
    anchors = F.col("vec_id") % 10 == 0
    assert mine_negatives(vectors_of(spark, []), anchors).collect() == []
    assert mine_negatives(vectors_of(spark, [(1, [1.0], 0), (2, [1.0], 1)]), anchors).collect() == []
    rows = [(0, [1.0], 0), (1, [0.9], 0), (2, [0.8], 1)]
    assert order(map(tuple, mine_negatives(vectors_of(spark, rows), anchors).collect())) == order(brute_negatives(rows)) != []
    assert mine_negatives(vectors_of(spark, [(0, [], 0), (1, [], 0)]), anchors).collect() == []


def test_bounds_stop_the_walk(spark):
    index = MultiIndex(prepare(vectors_of(spark, clustered(4000, 5))))
    rows = index.rows.toArrow()
    vectors, cells = np.array(rows.column("vec").to_pylist(), float), rows.column("cell").to_numpy()
    assert index.counts.sum() == 4000 and np.array_equal(np.bincount(cells, minlength=index.cells), index.counts)
    cut = index.width // 2
    for q in vectors[:20]:
        half = [book @ h + np.linalg.norm(h) * r for book, h, r in zip(index.books, (q[:cut], q[cut:]), index.radii)]
        bound = (half[0][:, None] + half[1][None, :]).ravel()
        assert (vectors @ q <= bound[cells] + 1e-6).all()


# -- Merkle ------------------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def text_of(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    """Digest at the top, and the siblings of each leaf, level by level."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for i, place in enumerate(at):
            run = place // 8 * 8
            paths[i].append((nodes[run:place], nodes[place + 1 : run + 8]))
            at[i] = place // 8
        nodes = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute_merkle(rows):
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0", 0) for r in rows]
    by = defaultdict(list)
    for doc, text, lang, source, n in full:
        leaf = H(*map(text_of, (doc, source, lang, n, text)))
        changed = doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0
        lower = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        by[lang].append((doc is not None, doc or 0, leaf, doc, H(*map(text_of, (doc, source, lang, n, lower))) if changed else leaf))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort()
        trees[lang] = tree([r[2] for r in by[lang]])
    root, above = tree([trees[lang][0] for lang in langs])
    out = []
    for lang, over in zip(langs, above):
        for (_, _, leaf, doc, other), path in zip(by[lang], trees[lang][1]):
            whole = path + over
            for left, right in whole:
                other = H(*left, other, *right)
            out.append((doc, leaf, trees[lang][0], root, H(*(d for left, right in whole for d in left + right)), other, other == root))
    return out


def third():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0


def test_merkle(docs_of, odd_rows, prose):
    rows = odd_rows + [(100 + i, f"Text {i} " + prose(3, i), "dé" if i % 3 else "en", None if i % 7 else "s") for i in range(700)]
    rows += [(-5, "A", "zh"), (5000, "B", "\U0001f600"), (5001, "C", "￮"), (5002, "D", "")]
    got = verify_documents(docs_of(*rows), lower_ascii(F.col("text")), third()).collect()
    assert order(map(tuple, got)) == order(brute_merkle(rows))
    assert {r["verified"] for r in got} == {True, False} and verify_documents(docs_of()).collect() == []


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_merkle_sizes(docs_of, n):
    rows = [(i, f"Doc {i}") for i in range(n)]
    got = verify_documents(docs_of(*rows), lower_ascii(F.col("text")), third()).collect()
    assert order(map(tuple, got)) == order(brute_merkle(rows))


def test_many_languages(docs_of):
    rows = [(i, f"Doc {i}", random.Random(i % 100).choice("abcdef") + str(i % 100)) for i in range(300)]
    got = verify_documents(docs_of(*rows)).collect()
    assert all(r["verified"] for r in got) and {r["root"] for r in got} == {brute_merkle(rows)[0][3]}


def test_intervals_nest(docs_of):
    from pulsegrid.llm.merkle import leaf_digest

    docs = docs_of(*[(i, f"Doc {i}", "de" if i % 5 else "en") for i in range(200)])
    made = manifest(docs.select("lang", "doc_id", leaf_digest(F.col("text")).alias("leaf")))
    for below, above in zip(made.levels, made.levels[1:]):
        nodes = below.collect()
        for parent in above.collect():
            inside = sorted((n["lo"], n["hi"], n["digest"]) for n in nodes if parent["lo"] <= n["lo"] and n["hi"] <= parent["hi"])
            assert inside == [tuple(k) for k in parent["kids"]] and len(inside) <= 8
            assert (inside[0][0], inside[-1][1]) == (parent["lo"], parent["hi"])
