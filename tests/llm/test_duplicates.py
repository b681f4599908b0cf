"""Similarity join, substring deduplication and decontamination against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from quirekit.llm import op3_jaccard, op4_decontamination, op8_substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text):
    w = lowered(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    sets = [(k, shingles(t)) for k, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        shared = Counter(j for g in s for j in where[g])
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j][1]) - n):
                parent[find(i)] = find(j)
        for g in s:
            where[g].append(i)
    least = {}
    for i, (k, _) in enumerate(sets):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [(k, len(s), least.get(find(i))) for i, (k, s) in enumerate(sets)]


def near_copies():
    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(n)] for n in (30, 60, 120, 400, 2500)]
    rows, key = [], 0
    for b in base:
        for _ in range(25):
            w = list(b)
            for _ in range(rng.randrange(0, 1 + len(b) // 25)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.4:
                w = w[: rng.randrange(int(len(w) * 0.75), len(w) + 1)]
            rows.append((key, "  ".join(w) if key % 2 else " ".join(w).upper()))
            key += 3
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows += [(key + i, " ".join(rng.choice(vocabulary) for _ in range(40 + i)) + "\n" + passage) for i in range(30)]
    chain = [f"c{i}" for i in range(300)]
    rows += [(5000 + i, " ".join(chain[i * 4 : i * 4 + 60])) for i in range(40)]
    rows += [(7000 - i, " ".join(base[1])) for i in range(40)]
    rows += [(9001, None), (9002, ""), (9003, " \t "), (9004, "one two"), (9005, "ONE  two"), (9006, "one two three four five"), (9007, "a " * 50), (9008, "a " * 900), (rows[0][0], rows[0][1]), (None, rows[3][1]), (None, "lonely words here")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("meet", [op3_jaccard.MEET, 3])
def test_jaccard_join(make, meet, monkeypatch):
    monkeypatch.setattr(op3_jaccard, "MEET", meet)
    rows = near_copies()
    got = sorted(map(repr, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in op3_jaccard.near_duplicates(make(rows)).collect())))
    want = sorted(map(repr, ((k, n, c if n else k) for k, n, c in components(rows))))
    assert got == want


def test_one_document_a_component_stays(make):
    rows = near_copies()
    kept = [r["doc_id"] for r in op3_jaccard.deduplicated(make(rows)).collect()]
    want = {c for k, n, c in components(rows) if c is not None and n} | {k for k, t in rows if not shingles(t)}
    assert sorted(k for k in kept if k is not None) == sorted(k for k in want if k is not None)
    assert kept.count(None) == 1  # the other row without an id is a copy


def test_rows_of_one_id_are_told_apart(make):
    text = lambda tag, n=40: " ".join(f"{tag}{i}" for i in range(n))
    rows = [(1, text("a")), (1, text("b")), (2, text("b") + " x"), (3, text("c")), (3, text("c")), (None, text("d")), (None, text("d")), (None, text("c")), (4, ""), (4, None)]
    kept = sorted(map(repr, ((r["doc_id"], r["text"]) for r in op3_jaccard.deduplicated(make(rows)).collect())))
    assert kept == sorted(map(repr, [(1, text("a")), (1, text("b")), (3, text("c")), (None, text("d")), (4, ""), (4, None)]))


def test_a_group_of_near_copies_makes_few_pairs(make, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = f"n{i}"
        rows.append((i, " ".join(w)))
    pairs, near = [], op3_jaccard._verified
    monkeypatch.setattr(op3_jaccard, "_verified", lambda found, *more: (pairs.append(found.count()), near(found, *more))[1])
    got = {r["doc_id"]: r["component_id"] for r in op3_jaccard.near_duplicates(make(rows)).collect()}
    assert got == {k: c for k, _, c in components(rows)}
    assert sum(pairs) < 6 * len(rows)


def test_bitmaps_never_exceed_the_difference():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (3, 100, 1500, 9000):
        common, one, two = (np.unique(rng.integers(0, 1 << 63, m, dtype=np.uint64)) for m in (n, n // 7, n // 3))
        a, b = np.union1d(common, one), np.union1d(common, two)
        x, y = op3_jaccard._bitmaps(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert op3_jaccard._distance(x, y) <= len(np.setxor1d(a, b))
        assert op3_jaccard._distance(x, x) == 0


def test_fragments_cut_the_global_order():
    import numpy as np

    rng = np.random.default_rng(3)
    count = rng.poisson(9, 1 << op3_jaccard.CELLS)
    count[rng.integers(0, len(count), 200)] += 5000
    slices = [{"slice": k, "cells": op3_jaccard._packed(x.astype(np.int64))} for k, x in enumerate(np.split(count, 16))]
    levels, pivots = op3_jaccard._order(slices)
    hashes = (np.repeat(np.arange(len(count), dtype=np.uint64), count) << np.uint64(64 - op3_jaccard.CELLS)) + rng.integers(0, 1 << 40, count.sum(), dtype=np.uint64)
    held = np.bincount(np.searchsorted(pivots, op3_jaccard._keys(hashes, levels), "right"), minlength=op3_jaccard.FRAGMENTS)
    assert len(pivots) == op3_jaccard.FRAGMENTS - 1 and held.min() > 0.95 * held.mean()


def test_empty_join(make, saved, spark):
    assert op3_jaccard.op3_jaccard(spark, saved(documents=make([]))).count() == 0
    assert op3_jaccard.op3_jaccard(spark, saved(documents=make([(1, None)]))).first()["component_id"] == 1


def removed(rows, span=50):
    first = {}
    for k, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - span + 1):
            g = tuple(w[i : i + span])
            key = float("inf") if k is None else k
            first[g] = min(key, first.get(g, key))
    out = []
    for k, t in rows:
        w = WORD.findall(t or "")
        keep = [True] * len(w)
        for i in range(len(w) - span + 1):
            if first[tuple(w[i : i + span])] < (float("inf") if k is None else k):
                keep[i : i + span] = [False] * span
        kept = [x for x, y in zip(w, keep, strict=True) if y]
        out.append((k, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("held", [op8_substrings.HELD, 200])
def test_substrings(make, held, monkeypatch):
    monkeypatch.setattr(op8_substrings, "HELD", held)
    rng = random.Random(11)
    vocabulary = [f"é{i}" for i in range(30)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [words(n) for n in (49, 50, 51, 75, 130, 400)]
    rows = []
    for i in range(120):
        body = []
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(passages)
            low = rng.randrange(0, max(1, len(p) - 60))
            body += words(rng.randrange(0, 30)) + p[low : low + rng.randrange(45, len(p) + 1)]
        rows.append((rng.randrange(100), "\n ".join(body)))
    rows += [(200 + i, " ".join(passages[5])) for i in range(60)] + [(300, "x " * 300), (301, "x " * 400), (302, "X " * 60), (400, None), (401, ""), (None, " ".join(passages[5])), rows[0], rows[0]]
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op8_substrings.deduplicated(make(rows), with_text=False).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, removed(rows)))


def test_substrings_of_nothing(make, saved, spark):
    assert op8_substrings.op8_substrings(spark, saved(documents=make([]))).count() == 0
    (row,) = op8_substrings.deduplicated(make([(1, "a  b")])).collect()
    assert (row["kept"], row["n_removed"]) == ("a b", 0)


def benchmark():
    rng = random.Random(13)
    word = lambda: rng.choice(["the", "of", "and", "is"]) if rng.random() < 0.4 else f"q{rng.randrange(3000)}"
    item = lambda n: " ".join(word() for _ in range(n)) + "? " + " ".join(word() for _ in range(8)) + "."
    return [(i, item(rng.randrange(10, 50))) for i in range(60)] + [(60, item(300)), (61, None), (62, ""), (63, "the"), (64, item(20))], rng, word


def leaks(docs, items):
    out = set()
    for i, t in items:
        if not lowered(t):
            continue
        head = re.split(r"(?<=[.!?])\s+", t.strip())
        q = lowered(" ".join(head[:-1])) if len(head) > 1 else lowered(t)
        q = q if len(q) >= 5 else lowered(t)
        k = min(5, len(q))
        grams = {tuple(q[j : j + k]) for j in range(len(q) - k + 1)}
        for d, text in docs:
            w = lowered(text)
            if sum(g in {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for g in grams) >= 0.5 * len(grams):
                out.add((d, i))
    return out


@pytest.mark.parametrize("shard", [op4_decontamination.SHARD, 700])
def test_decontamination(make, spark, shard):
    items, rng, word = benchmark()
    noise = lambda n: " ".join(word() for _ in range(n))
    docs = [(i, noise(rng.randrange(0, 500))) for i in range(60)]
    docs += [(100 + i, f"{noise(rng.randrange(300))}\n{t.upper()} {noise(rng.randrange(300))}") for i, t in items if t]
    docs += [(300, items[60][1]), (301, noise(90) + " " + " ".join(items[3][1].split()[:-8])), (302, None), (303, ""), (None, items[0][1]), (105, docs[65][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = op4_decontamination.matches(make(docs), table, shard=shard).filter("leak")
    want = {(d, i) for d, i in leaks(docs, items) if i != 63}
    assert {(r["doc_id"], r["item_id"]) for r in got.collect() if r["item_id"] != 63} == want
    kept = {r["doc_id"] for r in op4_decontamination.decontaminated(make(docs), table.filter("item_id <> 63")).collect()}
    assert kept == {k for k, _ in docs} - {d for d, _ in want}
    two = [(1, items[5][1]), (1, "clean words of the same id"), (None, items[5][1]), (None, "clean words without an id")]
    left = op4_decontamination.decontaminated(make(two), table.filter("item_id = 5"), shard=shard).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in left) == [("1", two[1][1]), ("None", two[3][1])]


@pytest.mark.parametrize("places", [op4_decontamination.PLACES, 0])
def test_retrieval_is_complete(monkeypatch, places):
    import numpy as np

    monkeypatch.setattr(op4_decontamination, "PLACES", places)

    items, rng, word = benchmark()
    index = op4_decontamination.build(items)
    texts = [" ".join(word() for _ in range(rng.randrange(1, 400))) + " " + items[i % 60][1] for i in range(40)]
    impact: dict = {}
    for e, (low, high) in enumerate(zip(index.postings[:-1], index.postings[1:], strict=True)):
        for q in range(low, high):
            assert index.segment[q] // index.block == index.entry[e] % index.blocks and index.impact[q] <= index.entry_bound[e]
            impact.setdefault(int(index.segment[q]), {})[int(index.terms[index.entry[e] // index.blocks])] = float(index.impact[q])
    for text in texts:
        words = op4_decontamination._words(text)
        rows = np.array([0, len(words)])
        got = dict(zip(*retrieved(index, words, rows), strict=True))
        want = {}
        step = op4_decontamination.STRIDE
        n = max(1, -(-len(words) // step))
        for p in range(n):
            own = set(words[p * step : (p + 2) * step].tolist())
            for s in range(len(index.item)):
                score = sum(x for t, x in impact[s].items() if t in own)
                if score >= op4_decontamination.THRESHOLD:
                    want[int(index.item[s])] = max(float(score), want.get(int(index.item[s]), 0.0))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def index_bytes(index):
    own = [x for x in vars(index).values() if hasattr(x, "nbytes")] + [g for name in ("question", "answer", "every") for _, g in getattr(index, name)]
    return sum(x.nbytes for x in own) + (index_bytes(index.parts) if index.parts else 0) + sum(g.nbytes + h.nbytes for g, h in (index.known or {}).values())


def test_an_index_is_bounded_by_its_words():
    rng = random.Random(5)
    many = [(i, " ".join(f"w{rng.randrange(200_000)}" for _ in range(220))) for i in range(4000)]
    assert index_bytes(op4_decontamination.build(many)) < 200e6
    assert index_bytes(op4_decontamination.build([(1, " ".join(f"w{i}" for i in range(1_000_000)) + ". the end of it")])) < 200e6


def test_equal_items_are_one(make, spark):
    items = [(1, "a b c d e f g h i j k l")] * 3 + [(2, "a b c d e f g h i j k l")]
    got = op4_decontamination.matches(make([(7, items[0][1])]), spark.createDataFrame(items, "item_id long, text string")).filter("leak").collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(7, 1), (7, 2)]


def retrieved(index, words, rows):
    _, item, score = op4_decontamination.retrieve(index, words, rows)
    return item.tolist(), score.tolist()


def test_empty_decontamination(make, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert op4_decontamination.matches(make([(1, "x")]), none).count() == 0
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert op4_decontamination.matches(make([]), some).count() == 0


def asked(rng, n_question, n_answer, tag):
    """An item of its own words, question first."""
    word = lambda: rng.choice(["the", "of", "and", "is"]) if rng.random() < 0.4 else f"{tag}{rng.randrange(400)}"
    line = lambda n: " ".join(word() for _ in range(n))
    return line(n_question) + "? " + line(n_answer) + "."


def test_short_questions_of_long_items_are_found(make, spark):
    rng = random.Random(21)
    items = [(i, asked(rng, rng.randrange(5, 16), rng.randrange(30, 150), "z")) for i in range(50)]
    noise = lambda n: " ".join(rng.choice(["the", "of", "and", "is", f"n{rng.randrange(900)}"]) for _ in range(n))
    docs = []
    for i, t in items:
        q = t.split("? ")[0].split(" ")
        q[-1] += "?"
        docs.append((i, f"{noise(200)} {' '.join(q)} {noise(200)}"))
        # the first and the last quarter of the question and a bit, far from each other
        n = (len(q) - 4 + 3) // 4 + 4
        docs.append((100 + i, f"{noise(100)} {' '.join(q[:n])} {noise(300)} {' '.join(q[-n:])} {noise(100)}"))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in op4_decontamination.matches(make(docs), table).filter("leak").collect()}
    want = leaks(docs, items)
    assert {(i, i) for i in range(50)} <= want
    assert got == want


def told(docs, items):
    """Pairs with half of the 5-grams of the question, of the whole item, or of an answer of ten words."""
    out = leaks(docs, items)
    for i, t in items:
        tail = lowered(re.split(r"(?<=[.!?])\s+", t.strip())[-1])
        for part in (lowered(t), *([tail] if len(tail) >= 10 else [])):
            grams = {tuple(part[j : j + 5]) for j in range(len(part) - 4)}
            for d, text in docs:
                w = lowered(text)
                if 2 * len(grams & {tuple(w[j : j + 5]) for j in range(len(w) - 4)}) >= len(grams):
                    out.add((d, i))
    return out


def test_answers_and_ends_of_items_are_leaks(make, spark):
    rng = random.Random(22)
    items = [(i, asked(rng, rng.randrange(5, 40), rng.randrange(5, 40), f"y{i}y")) for i in range(60)] + [(60, asked(rng, 13, 23, "x")), (61, asked(rng, 30, 9, "w"))]
    noise = lambda n: " ".join(rng.choice(["the", "of", "and", "is", f"n{rng.randrange(900)}"]) for _ in range(n))
    docs = [(500, noise(300)), (501, f"{noise(90)} {' '.join(items[60][1].split()[-27:])} {noise(90)}"), (502, f"{noise(9)} {items[61][1].split('? ')[1]} {noise(9)}")]
    for i, t in items:
        w = t.split()
        a = rng.randrange(len(w) - 5)
        docs.append((i, f"{noise(100)} {' '.join(w[a : rng.randrange(a + 5, len(w)) + 1])} {noise(100)}"))
        docs.append((100 + i, f"{noise(100)} {t.split('? ')[1]} {noise(100)}"))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = op4_decontamination.matches(make(docs), table).filter("leak").collect()
    want = told(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(want - leaks(docs, items)) > 30
    assert [(r["question_overlap"], r["answer_overlap"]) for r in got if r["doc_id"] == 501] == [(0.0, 1.0)]
    kept = {r["doc_id"] for r in op4_decontamination.decontaminated(make(docs), table).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want} and {500, 502} <= kept
