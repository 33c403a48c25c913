import hashlib
from collections import defaultdict

from pulsegrid.llm.common import ROW, staged
from pulsegrid.llm.components import components
from pulsegrid.llm.exact_dedup import DigestIndex, exact_dedup
from pulsegrid.llm.fingerprints import BUCKET_CELLS, differing, fingerprint_documents, peel, sketch
from pulsegrid.llm.lines import dedup_lines
from pulsegrid.llm.minhash import near_duplicates

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256((text or "").translate(AZ).encode()).hexdigest()


def test_exact(docs_of, odd_rows):
    got = exact_dedup(docs_of(*odd_rows)).collect()
    assert len(got) == len(odd_rows)
    groups = defaultdict(list)
    for i, text, *_ in odd_rows:
        groups[sha(text)].append(i)
    for digest, ids in groups.items():
        rows = [r for r in got if r["text_sha256"] == digest]
        best = max((i for i in ids if i is not None), default=None)
        assert {(r["keep_id"], r["group_size"]) for r in rows} == {(best, len(ids))}
        assert [r["doc_id"] for r in rows if r["kept"]] == [best]
    assert exact_dedup(docs_of()).collect() == []


def test_index_outlives_a_run(spark, docs_of, folder):
    exact_dedup(docs_of((1, "a"), (2, "b")), DigestIndex(spark, folder + "/index", buckets=4))
    index = DigestIndex(spark, folder + "/index", buckets=4)
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup(docs_of((9, "A"), (8, "c")), index).collect()}
    assert got[9] == (1, False) and got[8] == (8, True)
    assert index.read().count() == 3


def brute_sets(rows, size):
    out = {}
    for i, (doc, text, *_) in enumerate(rows):
        w = [x for x in (text or "").translate(AZ).replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
        out[i] = {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
    return out


def brute_components(rows, size=4, percent=80):
    sets = brute_sets(rows, size)
    leader = {i: i for i in sets}

    def find(i):
        while leader[i] != i:
            i = leader[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                leader[find(i)] = find(j)
    ids = defaultdict(list)
    for i in sets:
        ids[find(i)].append(rows[i][0])
    return [(rows[i][0], len(sets[i]), min((d for d in ids[find(i)] if d is not None), default=None)) for i in sets]


def order(rows):
    return sorted(rows, key=str)


def test_near_on_odd_rows(docs_of, odd_rows):
    got = near_duplicates(docs_of(*odd_rows)).collect()
    assert order((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == order(brute_components(odd_rows))
    by = defaultdict(list)
    for r in got:
        if r["n_shingles"]:
            by[r["component_id"]].append(r["kept"])
    assert all(sum(k) == 1 for k in by.values())
    assert near_duplicates(docs_of()).collect() == []


def test_near_chains_and_shared_passages(docs_of, prose):
    """A chain that only links through its middle, and a passage that many unrelated texts share."""
    base = prose(120, 5).split()
    rows = []
    for step in range(6):  # each differs from the one before by a few words at another place
        changed = list(base)
        for k in range(step):
            for j in range(3):
                changed[10 + 18 * k + j] = f"new{k}-{j}"
        rows.append((100 - step, " ".join(changed)))
    passage = prose(60, 6)
    rows += [(200 + i, passage + " " + prose(25 + i % 9, 50 + i)) for i in range(60)]
    rows += [(300, passage), (301, passage.upper())]
    got = near_duplicates(docs_of(*rows)).collect()
    assert order((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == order(brute_components(rows))


def test_variants_of_one_original_are_hardly_compared(docs_of, prose, monkeypatch):
    """Many texts near a common original that is not there: few are near each other, and few are compared."""
    import random

    from pulsegrid.llm import minhash

    r = random.Random(7)
    base = prose(200, 8).split()
    rows = []
    for i in range(120):
        words = list(base)
        for at in r.sample(range(len(words)), 5 if i % 20 else 2):
            words[at] = f"own{i}-{at}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(2000 + i, " ".join(base[: 150 + i % 40] + [f"tail{i}"] * 30)) for i in range(40)]
    compared = []
    confirm = minhash._linked

    def counted(pairs, sets, percent):
        compared.append(pairs.count())
        return confirm(pairs, sets, percent)

    monkeypatch.setattr(minhash, "_linked", counted)
    got = near_duplicates(docs_of(*rows)).collect()
    want = brute_components(rows)
    assert order((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == order(want)
    assert len({c for _, _, c in want}) > 80
    assert sum(compared) < len(rows) * 8


def test_rare_shingles_keep_every_similar_pair(spark):
    """Of any two sets at 80 %, some kept shingle leaves room for what they share; brute force over random sets."""
    import random
    import struct

    from pulsegrid.llm.minhash import may_be_similar, rare_shingles

    r = random.Random(3)
    sets = {}
    for i in range(250):
        if i and r.random() < 0.7:
            grown = set(sets[r.randrange(i)])
            for _ in range(r.randrange(6)):
                grown.discard(r.choice(sorted(grown)))
                grown.add(r.randrange(-(1 << 63), 1 << 63) if r.random() < 0.5 else r.randrange(90))
            sets[i] = grown
        else:
            sets[i] = {r.randrange(90) for _ in range(r.randrange(1, 40))}
    packed = [(i, bytearray(b"".join(struct.pack("<q", x) for x in sorted(s)))) for i, s in sets.items()]
    rare = rare_shingles(spark.createDataFrame(packed, "node long, shingles binary"), 80)
    kept = rare.collect()
    other = rare.selectExpr("key", "node AS b", "n AS m", "rest AS left", "parity AS other")
    passed = {(x["node"], x["b"]) for x in rare.join(other, "key").filter(may_be_similar(80)).select("node", "b").collect()}
    by = defaultdict(dict)
    for row in kept:
        assert row["n"] == len(sets[row["node"]]) and row["key"] in sets[row["node"]]
        by[row["node"]][row["key"]] = row["rest"]
    links = 0
    for a in sets:
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if 100 * shared >= 80 * len(sets[a] | sets[b]):
                links += 1
                assert any(min(by[a][k], by[b][k]) >= shared for k in by[a].keys() & by[b].keys())
                assert (a, b) in passed and (b, a) in passed
    assert links > 100 and len(kept) < sum(map(len, sets.values())) / 2


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(90, 90), (95, 90), (100, 90)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_stop_at_stars(spark, monkeypatch):
    """Links that are stars are written once, and a path once more per step (two writes)."""
    written = []
    monkeypatch.setattr("pulsegrid.llm.components.staged", lambda df, purpose: written.append(purpose) or staged(df, purpose))
    for links, writes in ([(2, 1), (3, 1), (9, 8)], 1), ([(2, 1), (3, 2), (4, 4)], 3):
        written.clear()
        got = {tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == ({(1, 1), (2, 1), (3, 1), (9, 8), (8, 8)} if writes == 1 else {(1, 1), (2, 1), (3, 1)})
        assert len(written) == writes


def word_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_lines(docs_of, odd_rows):
    line = "the quick brown fox jumps over it"
    more = [
        (10, f"{line}\n{line}\nshort line here"), (11, line.replace("quick", "slow")), (12, line + " again"),
        (13, line.replace("brown ", "")), (14, line.replace("quick", "slow") + " again"), (15, line.upper()), (16, "the the the the the the"),
        (17, "the the the the the"), (18, "a b c d e f g"), (19, "g a b c d e f"),
    ]
    rows = [r for r in odd_rows if len(r[1] or "") < 1000] + more
    lines = []
    for n, (doc, text, *_) in enumerate(rows):
        for k, body in enumerate((text or "").split("\n")):
            for c in "\t\r\x0b\x0c":
                body = body.replace(c, " ")
            lines.append(((doc if doc is not None else 1 << 63, n, k), [w for w in body.translate(AZ).split(" ") if w]))
    want = []
    for place, words in lines:
        reason, keep = "first", None
        if len(words) < 5:
            reason = "short"
        else:
            same = [p for p, w in lines if w == words and p < place]
            first = min([*same, place])
            near = [p for p, w in lines if len(w) >= 5 and w != words and word_distance(w, words) == 1 and p < first]
            reason = "exact" if same else "near" if near else "first"
            keep = min([*near, *same], default=None)
        want.append((place[0] if place[0] < 1 << 63 else None, place[2], len(words), reason, keep[0] if keep else None, keep[2] if keep else None))
    got = [(r["doc_id"], r["line_no"], r["n_words"], r["reason"], r["keep_doc_id"], r["keep_line_no"]) for r in dedup_lines(docs_of(*rows)).collect()]
    assert order(got) == order(want)
    assert {r[3] for r in got} == {"short", "first", "exact", "near"}
    assert dedup_lines(docs_of()).collect() == []


def test_variant_keys_meet_where_variants_do(spark):
    """Equal keys for equal word sequences only, whichever word is left out."""
    from pyspark.sql import functions as F

    from pulsegrid.llm.lines import _variant_keys

    lines = [w.split() for w in ("a", "a b", "b a", "a a b b", "a b c d e f", "a b x d e f", "a b d e f", "a a a a a", "Ä b c d e ß g", "c a b")]
    marks = F.transform("words", lambda w, i: F.struct(F.xxhash64(w, i).alias("here"), F.xxhash64(w, i - 1).alias("before")))
    rows = spark.createDataFrame([(w,) for w in lines], "words array<string>").select("words", marks.alias("marks"))
    of = {}
    for words, keys in rows.select("words", _variant_keys(F.col("marks"))).collect():
        assert len(keys) == len(words) + 1
        for gone, key in enumerate(keys):
            of.setdefault(key, set()).add(tuple(words[: gone - 1] + words[gone:] if gone else words))
    assert all(len(v) == 1 for v in of.values())
    assert len(of) == len(set().union(*of.values()))


def test_only_keys_of_several_lines_are_compared(spark):
    from pulsegrid.llm.lines import _shared_keys

    rows = [(1, 10, 0), (1, 10, 1), (2, 10, 1), (2, 11, 1), (3, 12, 2), (3, 10, 3), (3, 12, 4), (4, 10, 5), (4, 11, 6)]
    got = _shared_keys(spark.createDataFrame(rows, "key long, line long, gone int"))
    assert sorted(tuple(r) for r in got.select("key", "line", "gone").collect()) == sorted(r for r in rows if r[0] != 1)


def test_line_words_beyond_ascii(spark):
    import re

    from pyspark.sql import functions as F

    from pulsegrid.llm.lines import line_words

    lines = ["The END of  it", "É Bé\x0bİX ǅ K", "\tA\x0c\rb ", "", " ", "Ⅷ Ωa", "NBSP\u00a0X\u2003Y z\x1cQ"]
    word = re.compile(r"[^\x20\x09-\x0D]+")
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", line_words(F.col("line")).alias("words")).collect()
    assert len(got) == len(lines) and all(r["words"] == word.findall(r["line"].translate(AZ)) for r in got)


def paragraphs(text):
    return {p for p in text.split("\n") if p.strip(" ")}


def likeness(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def test_fingerprints(docs_of, prose):
    texts = {i: "\n".join(prose(6, 1000 * i + j) for j in range(1 + i * 7 % 40)) for i in range(1, 40)}
    texts |= {40: None, 41: "", 42: "a\na\n \nb", 43: "b\na", 44: texts[7], 45: "\n".join(prose(2, j) for j in range(900)), 46: "Äö" * 50}
    got = {r["doc_id"]: r for r in fingerprint_documents(docs_of(*texts.items())).collect()}
    ids = sorted(texts, reverse=True)
    for k, i in enumerate(ids):
        text, after = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r["near_edited"] - likeness(paragraphs(text), paragraphs(edited))) < 1e-12
        assert abs(r["near_next"] - likeness(paragraphs(text), paragraphs(after))) < 1e-12
    assert got[7]["fingerprint"] == got[44]["fingerprint"] != got[8]["fingerprint"]


def test_an_edited_paragraph_stays_near(docs_of, prose):
    import random

    r = random.Random(5)
    cjk = "".join(chr(0x4E00 + r.randrange(2000)) for _ in range(900))
    got = {r["doc_id"]: r for r in fingerprint_documents(docs_of((1, prose(300, 1)), (2, prose(300, 2)), (3, cjk))).collect()}
    assert all(0.15 < r["near_edited"] < 0.8 and r["near_next"] < 0.1 for r in got.values()), [(d, r["near_edited"], r["near_next"]) for d, r in got.items()]


def test_sketch_differences_are_exact(spark, monkeypatch):
    """Every size of difference, in buckets of enough cells and of far too few."""
    import random

    r = random.Random(11)
    draw = lambda n: [r.randrange(-(1 << 63), 1 << 63) for _ in range(n)]
    rows = []
    for both, one, two in [(0, 0, 0), (0, 1, 0), (5, 0, 0), (3, 2, 4), (40, 9, 0), (0, 60, 70), (300, 100, 20), (1500, 3, 900)]:
        shared = draw(both)
        rows.append((shared + draw(one), shared[::-1] + draw(two), one + two))
    sets = spark.createDataFrame(rows, "ours array<long>, theirs array<long>, want int")
    assert len(BUCKET_CELLS) > 1
    for cells in (BUCKET_CELLS, (1,), (2, 4)):
        monkeypatch.setattr("pulsegrid.llm.fingerprints.BUCKET_CELLS", cells)
        assert all(w == n for w, n in sets.select("want", differing(sets.ours, sets.theirs)).collect())
    # A sketch that is too small says so, it never miscounts.
    small = sets.select("want", peel(sketch(sets.ours), sketch(sets.theirs), 4)).collect()
    assert all(n in (None, w) for w, n in small) and {n is None for _, n in small} == {True, False}


def test_differing_works_out_only_cells_that_hold_something(spark, monkeypatch):
    """Its time follows the digests, not the cells: subtables too long for any array."""
    import random

    r = random.Random(3)
    draw = lambda n: [r.randrange(-(1 << 63), 1 << 63) for _ in range(n)]
    shared = draw(70)
    rows = [(shared + draw(20), draw(30) + shared, 50), (shared, shared[::-1], 0), ([], draw(40), 40)]
    sets = spark.createDataFrame(rows, "ours array<long>, theirs array<long>, want int")
    monkeypatch.setattr("pulsegrid.llm.fingerprints.BUCKET_CELLS", (1 << 31,))
    assert all(w == n for w, n in sets.select("want", differing(sets.ours, sets.theirs)).collect())


def test_fingerprints_of_few_and_odd_rows(docs_of, odd_rows):
    assert fingerprint_documents(docs_of()).collect() == []
    one = fingerprint_documents(docs_of((3, "abc\nd"))).first()
    assert (one["near_next"], one["n_chars"]) == (1.0, 5)
    got = fingerprint_documents(docs_of(*odd_rows)).collect()
    assert order(r["doc_id"] for r in got) == order(r[0] for r in odd_rows)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert ROW not in got[0].asDict()
