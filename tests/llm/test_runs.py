"""Repeated bytes against a search of all windows, and the run-length index against the strings it holds."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirekit.llm import op13_runs
from quirekit.llm.runindex import RunIndex, pieces_text

LAST = (1 << 63) - 1


def plain(rows, span=50):
    """(doc_id, n_bytes, n_removed, n_spans, sha) by a table of all windows."""
    least = {}
    for i, text in rows:
        body, key = (text or "").encode(), LAST if i is None else i
        for p in range(len(body) - span + 1):
            w = body[p : p + span]
            least[w] = min(least.get(w, LAST), key)
    out = []
    for i, text in rows:
        body, key = (text or "").encode(), LAST if i is None else i
        gone = [False] * len(body)
        for p in range(len(body) - span + 1):
            if least[body[p : p + span]] < key:
                gone[p : p + span] = [True] * span
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(body, gone) if not g)
        out.append(repr((i, len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest())))
    return sorted(out)


def shown(df):
    return sorted(repr(tuple(r)) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def prose(r, n):
    return " ".join(r.choice(["wort", "größe", "мир", "a", "the", "lamp", "日本", "quay", "x1"]) + str(r.randrange(40)) for _ in range(n))


def sample(seed=5):
    r = random.Random(seed)
    shared = [prose(r, n) for n in (9, 14, 30, 80)]
    rows = [(i * 7 % 41 - 3, " ".join(r.choice([*shared, prose(r, 6), prose(r, 20)]) for _ in range(r.randrange(1, 6)))) for i in range(41)]
    rows += [(50, None), (51, ""), (52, "short"), (53, "aaaa" * 60), (54, "a" * 300), (54, "a" * 90), (None, shared[3]), (None, shared[3]), (rows[3][0], shared[2])]
    return rows + rows[10:13]


def test_equals_plain_search(spark, make):
    rows = sample()
    docs = make(rows).repartition(3).withColumn("m", F.create_map(F.lit("a"), F.lit(1))).withColumn("block", F.lit(0))
    assert shown(op13_runs.deduplicated(docs)) == plain(rows)


@pytest.mark.parametrize("span,anchor,block,common", [(50, 26, 300, 1), (50, 50, 700, 2), (12, 5, 150, 3), (8, 1, 90, 4096), (20, 12, 1 << 20, 0)])
def test_small_blocks_and_common_anchors(spark, make, span, anchor, block, common):
    rows = sample(span)
    assert shown(op13_runs.deduplicated(make(rows).repartition(2), span, anchor, block=block, common=common)) == plain(rows, span)


def test_kept_bytes(spark, make):
    passage = prose(random.Random(2), 20)
    rows = [(1, passage), (2, "before " + passage + " after"), (3, passage)]
    kept = {r["doc_id"]: bytes(r["kept"]) for r in op13_runs.deduplicated(make(rows)).collect()}
    assert kept == {1: passage.encode(), 2: b"before  after", 3: b""}


def test_a_footer_with_other_surroundings(spark, make):
    """A footer shorter than a window is a common anchor of windows that all differ."""
    r = random.Random(4)
    rows = [(i, prose(r, 12) + " All rights reserved by the quay. " + prose(r, 9)) for i in range(60)]
    assert shown(op13_runs.deduplicated(make(rows), common=5)) == plain(rows)


def test_query_and_empty_table(spark, make, saved):
    rows = sample(9)
    assert shown(op13_runs.op13_runs(spark, saved(documents=make(rows)))) == plain(rows)
    assert op13_runs.op13_runs(spark, saved(documents=make([]))).count() == 0


def test_ids_that_are_no_numbers_are_refused(spark):
    with pytest.raises(ValueError):
        op13_runs.deduplicated(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_long_texts_are_hashed_in_parts(monkeypatch):
    r = np.random.default_rng(3)
    raw, offsets = r.integers(97, 100, 5000).astype(np.uint8), np.array([0, 30, 30, 2100, 2149, 5000])
    runs = lambda: {(d, s + i): a for d, s, n, a in zip(*(x.tolist() for x in op13_runs.anchored(raw, offsets, 50, 26)), strict=True) for i in range(n)}
    whole = runs()
    monkeypatch.setattr(op13_runs, "PIECE", 333)
    assert runs() == whole and set(whole) == {(2, i) for i in range(2070 - 49)} | {(4, i) for i in range(2851 - 49)}


@pytest.mark.parametrize("span", [2, 3, 7, 12, 30])
def test_matches_are_ranges_of_rows(span):
    r = random.Random(span)
    base = bytes(r.choice(b"abc\x00\xff") for _ in range(300))
    pieces = list({base[a : a + r.randrange(1, 60)] for a in (r.randrange(290) for _ in range(80))})
    symbols, start, length = pieces_text(pieces)
    index = RunIndex(symbols, start, length, span)
    ends, seen = {}, 0
    for piece, offset, end in index.statistics():
        for p, o, e in zip(piece.tolist(), offset.tolist(), end.tolist()):
            text = pieces[p][o : o + span]
            assert len(text) == span and ends.setdefault(text, e) == e
            seen += 1
    assert len(set(ends.values())) == len(ends) and seen == index.size == sum(max(0, len(p) - span + 1) for p in pieces)
    assert [ends[t] for t in sorted(ends)] == sorted(ends.values())  # rows are in the order of their bytes
    assert index.length.sum() == index.size and (not index.size or len(index.start) < index.size)


def test_grams_are_of_content():
    raw = np.frombuffer(b"abcdefgh abcdefgh abcdefg", np.uint8)
    for k in (1, 2, 3, 5, 7, 8):
        g = op13_runs.grams(raw, k)
        by = {}
        for i in range(len(raw) - k + 1):
            assert by.setdefault(raw[i : i + k].tobytes(), g[i]) == g[i]
        assert len(set(by.values())) == len(by) and len(g) == len(raw) - k + 1
