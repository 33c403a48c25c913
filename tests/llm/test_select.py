import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import sharding
from pulsegrid.llm.maxent import score_documents
from pulsegrid.llm.mixing import fit_counts, mix_sources, share_out
from pulsegrid.llm.packing import TextTokenizer, default_tokenizer, hilbert_key, pack_along_curve
from pulsegrid.llm.quality import ORDER, SYMBOLS, _dense, _columns, classify_quality, kneser_ney, quantiles
from pulsegrid.llm.sharding import minimax_shards
from pulsegrid.llm.urls import filter_urls

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def order(rows):
    return sorted(rows, key=str)


# -- packing -----------------------------------------------------------------------------------


def ids_of(tokenizer, text):
    return [*tokenizer.model.encode(text, add_special_tokens=False).ids, 0]


def test_tokens_are_the_vocabulary_files():
    tokenizer = TextTokenizer(default_tokenizer())
    texts = ["", " ", "a  b", "\n\nx y\n", "tab\tx", "<|endoftext|>", "don't we'll\nI'm", "a\x1cb", "x\r\ny z", "éß ñ", "日本 語", "a\u2003b", "\U0001f600 x"]
    texts += [f"{p}{chr(c)}{q}" for c in range(256) for p in ("", " ", "a", "1", "!", "  ") for q in ("", " ", "b", "2", "?", "\t")]
    for text in texts:
        assert np.frombuffer(tokenizer.encode(text), "<u2").tolist() == ids_of(tokenizer, text)[:-1], repr(text)


def test_hilbert_neighbours_touch():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    key = hilbert_key(cells, 3)
    assert sorted(key) == list(range(512))
    assert np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1).max() == 1


def test_pieces_give_back_the_texts(docs_of, odd_rows):
    tokenizer = TextTokenizer(default_tokenizer())
    got = pack_along_curve(docs_of(*odd_rows)).collect()
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    for number, pieces in sequences.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 1024 or number == len(sequences) - 1
    want = Counter()
    for doc, text, *_ in odd_rows:
        want[doc, len(ids_of(tokenizer, text or ""))] += 1
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0) == want
    for doc, text in {1: "", 6: odd_rows[6][1], 7: odd_rows[7][1]}.items():
        ids = np.array(ids_of(tokenizer, text or ""), dtype="<u4")
        mine = sorted((r for r in got if r["doc_id"] == doc), key=lambda r: r["start"])
        assert sum(r["length"] for r in mine) == len(ids)
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    assert pack_along_curve(docs_of()).collect() == []


# -- mixing ------------------------------------------------------------------------------------


def test_share_out():
    assert share_out([10, 10, 10], [1, 1, 1]) == [10, 10, 10]
    assert share_out([100, 1, 0], [1, 1, 1]) == [98, 3, 0]
    assert share_out([], []) == [] and share_out([0, 0], [5, 2]) == [0, 0]


@pytest.mark.parametrize("seed", range(30))
def test_fit_is_the_nearest_subset(seed):
    r = np.random.default_rng(seed)
    lengths = np.sort(r.choice(np.arange(1, 60), 6, replace=False))
    counts = r.integers(1, 4, 6)
    sums = {0}
    for length, n in zip(lengths, counts):
        sums = {s + k * int(length) for s in sums for k in range(n + 1)}
    for budget in r.integers(0, int((lengths * counts).sum()) + 1, 8):
        take = fit_counts(lengths, counts, int(budget))
        assert (take >= 0).all() and (take <= counts).all()
        off = abs(int((lengths * take).sum()) - int(budget))
        assert off <= min(abs(s - int(budget)) for s in sums) + 2


def test_mix(docs_of, odd_rows, prose):
    rows = odd_rows + [(100 + i, prose(5 + i % 37, i), "en", f"s{i % 3}") for i in range(300)]
    docs = docs_of(*rows)
    got = mix_sources(docs).collect()
    assert order((r["doc_id"], r["size"]) for r in got) == order((d, len(WORD.findall(t or ""))) for d, t, *_ in rows)
    by = defaultdict(list)
    for (d, t, *rest), _ in zip(rows, rows):
        by[rest[1] if len(rest) > 1 else "s0"].append(len(WORD.findall(t or "")))
    names = sorted(by, key=lambda s: (s is None, s))
    sizes = [sum(by[s]) for s in names]
    targets = dict(zip(sizes, share_out(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])))
    taken = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(targets[r["source_size"]])
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[r["source_size"]] += r["taken"]
    for size, target in targets.items():
        assert abs(taken[size] - target) <= 1 or size > 30_000  # the very long text is all or nothing
    assert order(map(str, got)) == order(map(str, mix_sources(docs).collect()))
    assert mix_sources(docs_of()).collect() == []


# -- sharding ----------------------------------------------------------------------------------


def smallest(sizes, shards):
    def fits(capacity):
        used, load = 1, 0
        for s in sizes:
            if s > capacity:
                return False
            used, load = (used + 1, s) if load + s > capacity else (used, load + s)
        return used <= shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


@pytest.mark.parametrize("ranges", [sharding.RANGES, 64])
def test_shards(docs_of, odd_rows, prose, monkeypatch, ranges):
    monkeypatch.setattr(sharding.GroupEnds.__init__, "__defaults__", (ranges,))
    rows = odd_rows + [(100 + i, prose(1 + i * i % 50, i)) for i in range(400)] + [(900 + i, "same text") for i in range(150)]
    rows = [r for r in rows if r[0] != 6]
    got = minimax_shards(docs_of(*rows), shards=7).collect()
    assert order((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == order(
        (d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows
    )
    loads, groups, slots = Counter(), defaultdict(set), defaultdict(list)
    for r in got:
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    text_of = {(d, zlib.crc32((t or "").encode())): t or "" for d, t, *_ in rows}
    for r in got:
        groups[text_of[r["doc_id"], r["text_crc32"]]].add(r["shard"])
    assert all(len(s) == 1 for s in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    import hashlib

    sizes = Counter()
    for d, t, *_ in rows:
        sizes[hashlib.md5((t or "").encode()).hexdigest()] += len((t or "").encode()) + 16
    assert max(loads.values()) == smallest([sizes[k] for k in sorted(sizes)], 7)


@pytest.mark.parametrize("ranges", [16])
def test_shards_with_few_ranges(docs_of, prose, monkeypatch, ranges):
    monkeypatch.setattr(sharding.GroupEnds.__init__, "__defaults__", (ranges,))
    turns, refine = [], sharding.GroupEnds.refine
    monkeypatch.setattr(sharding.GroupEnds, "refine", lambda self, wanted: (turns.append(1), len(turns) > 60 and pytest.fail("no end"), refine(self, wanted)))
    rows = [(i, prose(1 + i * i % 50, i)) for i in range(40 if ranges < 16 else 400)]
    loads, sizes = Counter(), Counter()
    import hashlib

    for r in minimax_shards(docs_of(*rows), shards=3 if ranges < 16 else 7).collect():
        loads[r["shard"]] += r["size"]
    for _, t in rows:
        sizes[hashlib.md5(t.encode()).hexdigest()] += len(t.encode()) + 16
    assert max(loads.values()) == smallest([sizes[k] for k in sorted(sizes)], 3 if ranges < 16 else 7)


def test_few_shards(docs_of):
    assert minimax_shards(docs_of()).collect() == []
    got = minimax_shards(docs_of((1, "a"), (2, "b"), (3, "a")), shards=5).collect()
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)} and all(0 <= r["shard"] < 5 for r in got)


# -- urls --------------------------------------------------------------------------------------


def pages(spark, *rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, host string, n int")


def test_url_parts_and_rules(spark):
    cases = [
        ("HTTP://WWW.Example.NET/en/1?x#y", "www.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://a.net/EN/1", "a.net", "/EN/1", "net/", "block"),
        ("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("x://o.org/fr/1/2#a?b", "o.org", "/fr/1/2", "org/fr/", "allow"),
        ("http://net", "net", "", None, "allow"),
        ("http://net?/en/", "net", "", None, "allow"),
        ("http://a.net#", "a.net", "", None, "allow"),
        ("a/b://c.net/://d", "c.net", "/://d", "net/", "block"),
        ("no host", "", "", None, "allow"), ("", "", "", None, "allow"), (None, "", "", None, "allow"),
        ("http://É.NET/x", "É.net", "/x", "net/", "block"),
        ("http://h.org/" + "a/" * 3000, "h.org", "/" + "a/" * 3000, None, "allow"),
    ]
    df = pages(spark, *((i, c[0]) for i, c in enumerate(cases)), (0, cases[0][0]), (None, "http://b.net/"))
    got = defaultdict(list)
    for r in filter_urls(df).collect():
        got[r["page_id"]].append((r["host"], r["path"], r["rule"], r["verdict"]))
    for i, c in enumerate(cases):
        assert got[i] == [c[1:]] * (2 if i == 0 else 1), c
    assert got[None] == [("b.net", "/", "net/", "block")]
    assert filter_urls(pages(spark)).collect() == []


def test_templates_follow_labels(spark):
    rows = [(i, f"http://h.org/{'bad' if i % 2 else 'good'}/{i}/x") for i in range(200)]
    rows += [(1000, "http://h.org/bad/7777/x"), (1001, "http://h.org/good/7777/x"), (1002, "http://h.org/new/1/x"), (1003, "http://other.org/bad/1/x")]
    labels = spark.createDataFrame([(i, bool(i % 2)) for i in range(200)], "page_id long, blocked boolean")
    got = {r["page_id"]: r for r in filter_urls(pages(spark, *rows), labels).collect()}
    assert [got[i]["verdict"] for i in (1000, 1001, 1002, 1003)] == ["block", "allow", "allow", "allow"]
    assert got[1000]["template"] == "/bad/*/x"


def test_undecided_urls_follow_their_ancestors(spark, folder):
    from pulsegrid.llm.urls import op10_url_filters

    rows = [(i, f"http://a.example.com/de/{i}") for i in range(100)] + [(200 + i, f"http://b.org/fr/x{i}") for i in range(100)]
    rows += [(500, "http://a.example.com/news/x"), (501, "http://b.org/news/x"), (502, "http://c.example.com/news/x")]
    pages(spark, *rows).write.parquet(folder + "/pages.parquet")
    got = {r["page_id"]: r["verdict"] for r in op10_url_filters(spark, folder).collect()}
    assert [got[i] for i in (0, 200, 500, 501, 502)] == ["block", "allow", "block", "allow", "allow"]


def test_many_children_and_deep_paths_stay_apart(spark):
    deep = "/".join("abcdefghijkl")
    rows = [(i, f"http://h.org/{'bad' if i % 2 else 'good'}/{i}/x") for i in range(200)] + [(i, f"http://h.org/k{i}/x") for i in range(1000, 1150)]
    rows += [(i, f"http://h.org/{deep}/{'spam' if i % 2 else 'fine'}/y{i}") for i in range(300, 500)]
    rows += [(2000, "http://h.org/bad/7777/x"), (2001, "http://h.org/good/7777/x"), (2002, f"http://h.org/{deep}/spam/z"), (2003, f"http://h.org/{deep}/fine/z")]
    labels = spark.createDataFrame([(i, bool(i % 2)) for i in [*range(200), *range(300, 500)]], "page_id long, blocked boolean")
    got = {r["page_id"]: r["verdict"] for r in filter_urls(pages(spark, *rows), labels).collect()}
    assert [got[i] for i in range(2000, 2004)] == ["block", "allow", "block", "allow"]


# -- quality -----------------------------------------------------------------------------------


def test_kneser_ney_sums_to_one(spark):
    r = np.random.default_rng(3)
    grams = Counter(int(a) for a in (r.integers(0, 5, 3000) * SYMBOLS**3 + r.zipf(2.0, 3000) % 7 * SYMBOLS**2 + r.integers(0, 9, 3000) * SYMBOLS + r.zipf(1.8, 3000) % 40))
    counts = spark.createDataFrame(list(grams.items()), "gram long, n long")
    model = [(_columns(p, "gram", "p"), _columns(c, "context", "weight")) for p, c in kneser_ney(counts)]
    p = np.exp(-_dense(model).astype(np.float64)).reshape(-1, SYMBOLS)
    assert len(p) == SYMBOLS ** (ORDER - 1) and abs(p.sum(axis=1) - 1).max() < 1e-4
    # The highest order by its definition.
    n = {g: c for g, c in grams.items()}
    f = Counter(n.values())
    y = f[1] / (f[1] + 2 * f[2])
    d = [0] + [min(i, max(0, i - (i + 1) * y * f[i + 1] / f[i])) if f[i] else y for i in (1, 2, 3)]
    context = next(g // SYMBOLS for g, c in n.items() if c > 3)
    total = sum(c for g, c in n.items() if g // SYMBOLS == context)
    back = sum(d[min(c, 3)] for g, c in n.items() if g // SYMBOLS == context) / total
    lower = {g: v for g, v in zip(*model[2][0])}
    for g, c in n.items():
        if g // SYMBOLS == context:
            want = (c - d[min(c, 3)]) / total + back * lower[g % SYMBOLS**3]
            assert p.ravel()[g] == pytest.approx(want, rel=1e-4)


def test_quality(spark, docs_of, odd_rows, prose):
    good = [(100 + i, prose(80, i), ("en", "de")[i % 2]) for i in range(400)]
    junk = [(1000 + i, " ".join(w.upper() + "!!#" for w in prose(80, 9000 + i).split())) for i in range(40)]
    labels = spark.createDataFrame(
        [(100 + i, 1, 0) for i in range(300)] + [(100, 1, 0), (1000, 0, 1), (None, 1, 0), (350, 1, None)], "doc_id long, quality int, toxic int"
    )
    rows = odd_rows + good + junk
    got = classify_quality(docs_of(*rows), labels).collect()
    assert order(r["doc_id"] for r in got) == order(r[0] for r in rows)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert sum(kept[d] for d, *_ in good) >= 390 and not any(kept[d] for d, *_ in junk)
    assert all(kept[i] for i in (1, 2, 3))
    for none in (labels.limit(0), labels.filter("quality = 0")):
        assert all(r["kept"] for r in classify_quality(docs_of(*rows[:6]), none).collect())
    assert classify_quality(docs_of(), labels).collect() == []


def test_quality_uses_all_trusted(spark, docs_of, odd_rows, prose):
    rows = odd_rows + [(100 + i, prose(60 + i % 40, i), ("en", "de", None)[i % 3]) for i in range(500)]
    trusted = [(100 + i, 1, 0) for i in range(400)]
    # Labels of other documents change nothing, however many they are.
    others = [(10_000 + i, 1, 0) for i in range(30_000)]
    one, two = (spark.createDataFrame(l, "doc_id long, quality int, toxic int") for l in (trusted, trusted + others))
    few, many = (sorted(map(tuple, classify_quality(docs_of(*rows), l).collect()), key=repr) for l in (one, two))
    assert few == many


def test_quantiles(spark):
    r = random.Random(5)
    rows = [(g, r.choice((r.random(), 0.5, -2.0))) for g in "aabbbcddddddddd" * 40] + [("one", 1.5)] + [("two", x) for x in (1.0, 2.0)]
    values = spark.createDataFrame(rows, "g string, value double")
    for share in (0.0, 0.5, 0.995, 1.0):
        want = values.groupBy("g").agg(F.count("value"), F.percentile("value", F.lit(share))).collect()
        got = quantiles(values, ["g"], share).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))


# -- language model ----------------------------------------------------------------------------


def tokens(text):
    return [*WORD.findall((text or "").translate(AZ)), None]


@pytest.mark.parametrize("common", [200_000, 5])
def test_scores(docs_of, odd_rows, prose, common):
    rows = [r for r in odd_rows if r[0] != 6] + [(100 + i, " ".join(["ping pong"] * 30) + " " + prose(30, i)) for i in range(120)]
    got = score_documents(docs_of(*rows), common_words=common).collect()
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, *_ in rows}
    counts = Counter(w for d, t, *_ in rows if not held[d] for w in tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    want = []
    for d, t, *_ in rows:
        w = tokens(t)
        base = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w)
        want.append((d, held[d], len(w), sum(counts[x] > 0 for x in w), total, round(base, 6)))
    assert order((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == order(want)
    mine = [r for r in got if r["held_out"] and r["n_tokens"] > 20]
    assert mine and all(r["score"] > r["base_score"] for r in mine) and all(r["score"] <= 0 for r in got)


def test_scores_without_training(docs_of):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = score_documents(docs_of((held, "some words"))).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0) and math.isfinite(r["score"])
    assert score_documents(docs_of()).collect() == []


def test_a_task_keeps_what_it_alone_met(docs_of, monkeypatch):
    from pulsegrid.llm import maxent

    monkeypatch.setattr(maxent, "TASK_BYTES", 1)
    held = next(i for i in range(10_000, 10_100) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(i, " ".join(["ping pong"] * 300 if i < 100 else [f"w{i % 7} v{i % 5}"] * 300)) for i in range(800)] + [(held, "ping pong " * 50)]
    gain = []
    for parts in (1, 8):
        docs = docs_of(*rows).repartitionByRange(parts, "doc_id")
        r = next(r for r in score_documents(docs).collect() if r["doc_id"] == held)
        gain.append(r["score"] - r["base_score"])
    assert gain[1] > 0.8 * gain[0] > 0


def test_sums_of_runs_are_those_of_reduceat():
    """To the last bit, in runs of one row and of many."""
    from pulsegrid.llm.maxent import run_sums

    r = np.random.default_rng(3)
    for lengths in ([1], [9], [300, 1], [8] * 5, [1] * 50, r.integers(1, 12, 200), r.integers(1, 400, 20)):
        times = np.array(lengths)
        first = np.cumsum(times) - times
        values = r.normal(size=(int(times.sum()), 64)).astype(np.float32)
        assert (run_sums(values, first, times) == np.add.reduceat(values, first, axis=0)).all()


def test_rounds_grow_with_the_text():
    from pulsegrid.llm.maxent import ROUND_TOKENS, rounds_for

    assert rounds_for(1) == rounds_for(9 * ROUND_TOKENS) == 3 and rounds_for(900 * ROUND_TOKENS) == 30


# -- pipeline ----------------------------------------------------------------------------------


def test_pipeline(spark, docs_of, odd_rows, prose, folder):
    import corpus_pipeline
    from pulsegrid.llm.exact_dedup import exact_dedup
    from pulsegrid.llm.minhash import near_duplicates

    good = [(100 + i, prose(60, i), "en", f"s{i % 3}") for i in range(300)]
    copies = [(500 + i, good[i][1].upper() if i % 2 else good[i][1]) for i in range(20)]
    near = [(600 + i, good[30 + i][1] + " end") for i in range(20)]
    junk = [(1000 + i, "".join(c + "#!" for c in prose(40, 9000 + i))) for i in range(20)]
    rows = [r for r in odd_rows if r[0] != 6] + good + copies + near + junk
    docs_of(*rows).write.parquet(folder + "/documents.parquet")
    spark.createDataFrame([(100 + i, 1, 0) for i in range(250)], "doc_id long, quality int, toxic int").write.parquet(folder + "/labels.parquet")
    docs, kept = spark.read.parquet(folder + "/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = [r[0] for r in docs.select("doc_id").collect()]
        if name == "exact_dedup":
            want = [r["doc_id"] for r in exact_dedup(before).filter("kept").collect()]
            assert order(kept[name]) == order(want)
        if name == "near_dedup":
            want = [r["doc_id"] for r in near_duplicates(before, shingle=5).filter("kept").collect()]
            assert order(kept[name]) == order(want)
    assert not {d for d, *_ in junk} & set(kept["quality"])
    assert len({d for d, *_ in good} & set(kept["quality"])) >= 290
    assert not {100 + i for i in range(20)} & set(kept["exact_dedup"]) and {500 + i for i in range(20)} <= set(kept["exact_dedup"]) | set()
    assert not {600 + i for i in range(20)} & set(kept["near_dedup"])
    assert max(Counter(kept["mixing"]).values()) <= 3
    assert Counter(kept["mixing"]).total() == docs.filter(F.col("start") == 0).count()


def test_stages_take_an_empty_table(spark, docs_of, folder):
    import corpus_pipeline

    docs_of().write.parquet(folder + "/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(folder + "/labels.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
