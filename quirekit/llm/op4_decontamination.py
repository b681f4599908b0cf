"""Benchmark decontamination: every training passage queries a BM25 index of test items by block-max WAND.

Index: items are cut into segments of at most SEGMENT words. A posting's impact is its BM25 weight over the segment's own total, so a passage
that holds a whole segment scores 1. Segments lie in blocks of BLOCK; a term keeps its largest impact over all
segments (the list's bound) and, for each block it stands in, its largest there (the block's bound) and its postings. Nothing is kept for blocks
without the term, so the index takes some 60 bytes a word of the items, whatever their lengths.

Queries: each text is cut into passages of 2 x STRIDE words that overlap by half; the distinct words of each are a query. A passage
whose list bounds can't reach the threshold is passed over. In the others terms rank by their list bounds, and the pivot is the first at which
their sum, from the least, reaches the threshold: no segment without a term from the pivot on can reach it, so only those terms' posting blocks
are opened, and the lists before the pivot are skipped to them. A block is left once its bounds can't reach the threshold, first with list
bounds for the skipped terms, then with their block bounds; segments of what is left are scored in full. All items above the threshold go to verification: shares of the word 5-grams of the item's question (all but its last sentence),
of its answer (the last) and of all of it that the whole document holds. A pair with enough of the question, of the item, or of an answer of
ANSWER words or more is a leak.

So that every leak is retrieved, these three are segments of a second index too, which the whole text queries in the same way. There impacts are
shares of the least weight that the words of enough of a part's 5-grams can have: a leak scores 1 at least, wherever its 5-grams stand.

The index is broadcast in shards of about SHARD words, one pass over the documents each; documents are never shuffled. Of several shards one is
alive at a time, and its pairs are written before the next. Equal items are one in the index. An item of more than a quarter of SHARD has a
shard of its own.

Defined results: null and empty texts match nothing; items without words are skipped; an item of fewer than five words counts as
one gram; a question of fewer is taken with its answer; an item of one sentence is question and answer both; repeated documents
repeat in the result, items of equal id and text are one; null ids pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, column, free, table, tuned, written
from .words import gram_hashes, hashed, sliced, word_bounds, word_hashes

SEGMENT, STRIDE, BLOCK, SHARD = 64, 64, 8, 1 << 20
#: Segments in a block of the index that whole texts query.
PART_BLOCK = 24
K1, B = 1.2, 0.75
#: Share of a segment's weight a passage must hold to be verified; share of a part's 5-grams that makes a leak.
THRESHOLD, OVERLAP = 0.4, 0.5
GRAM = 5
#: Words of an answer that is told without its question; shorter ones are common phrases.
ANSWER = 10
#: What a leak scores at least in the index of parts, less the rounding of sums of 32-bit impacts.
SURE = 1 - 1e-3
#: Leading bits of a word's hash by which its term is looked up.
HEAD = 18
#: Entries of the index opened at a time.
HELD = 1 << 20
#: Most terms x blocks whose entries have a table of places.
PLACES = 1 << 22
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+")


def _words(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = word_bounds(raw, np.array([0, len(raw)]))
    return word_hashes(raw, starts, ends, True)


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    return np.unique(gram_hashes(words, k))


@dataclass
class Index:
    """Impact-ordered postings in blocks, and what verification needs of each item."""

    ids: list
    terms: np.ndarray  # sorted word hashes
    first: np.ndarray  # place of the first term of each leading HEAD bits
    bound: np.ndarray  # of each term over all segments
    entries: np.ndarray  # place of each term's first entry; an entry is a term in a block it stands in
    entry: np.ndarray  # term * blocks + block of each entry, sorted
    entry_bound: np.ndarray
    postings: np.ndarray  # place of each entry's first posting
    segment: np.ndarray  # of each posting
    impact: np.ndarray
    place: np.ndarray | None  # of the entry of each term and block, -1 where there is none; kept for small indexes only, others search
    item: np.ndarray  # of each segment
    blocks: int
    block: int  # segments in a block
    question: list  # (k, grams) of each item
    answer: list
    every: list  # of the whole item
    alone: list  # whether the answer is told without its question
    parts: Index | None = None  # of what a leak is decided on, asked by whole texts
    known: dict | None = None  # k: (sorted grams of all items, whether one has these leading HEAD bits)


def build(items: list[tuple], k1: float = K1, b: float = B, overlap: float = OVERLAP) -> Index | None:
    """An index of (item_id, text) rows."""
    ids, question, answer, every, alone, parts, owner, whole, whole_owner = [], [], [], [], [], [], [], [], []
    for key, text in items:
        words = _words(text or "")
        if not len(words):
            continue
        sentences = _SENTENCE.split(text.strip())
        tail = _words(sentences[-1]) if len(sentences) > 1 else words
        head = words[: len(words) - len(tail)] if len(sentences) > 1 else words
        head, tail = head if len(head) >= GRAM else words, tail if len(tail) else words
        for grams, own in ((question, head), (answer, tail), (every, words)):
            k = min(GRAM, len(own))
            grams.append((k, _grams(own, k)))
        alone.append(len(tail) >= ANSWER)
        for own, used in ((words, True), (head, len(head) < len(words)), (tail, alone[-1] and len(tail) < len(words))):
            if used:
                whole.append(own)
                whole_owner.append(len(ids))
        n = -(-len(words) // SEGMENT)
        for piece in np.array_split(words, n):
            parts.append(piece)
            owner.append(len(ids))
        ids.append(key)
    if not ids:
        return None
    told = question, answer, every, alone
    index = _indexed(ids, parts, owner, BLOCK, k1, b, told)
    index.parts = _indexed(ids, whole, whole_owner, PART_BLOCK, k1, b, told, overlap)
    index.known = {}
    for k in {k for k, _ in question + answer + every}:
        grams = np.unique(np.concatenate([g for n, g in question + answer + every if n == k]))
        leading = np.zeros(1 << HEAD, bool)
        leading[grams >> np.uint64(64 - HEAD)] = True
        index.known[k] = grams, leading
    return index


def _need(words: np.ndarray, weight: np.ndarray, overlap: float) -> float:
    """A bound on the weight of the distinct words that any text with ``overlap`` of the 5-grams of ``words`` holds.

    Each word's weight is dealt out evenly over the 5-grams it is in, so 5-grams held never have more than the words held: the bound is the sum
    of as many of the lightest as are needed. ``weight`` is that of the sorted distinct words."""
    k = min(GRAM, len(words))
    start = np.unique(gram_hashes(words, k), return_index=True)[1]
    held = np.sort(np.unique(words, return_inverse=True)[1][start[:, None] + np.arange(k)], axis=1)
    new = np.c_[np.ones(len(held), bool), held[:, 1:] != held[:, :-1]]
    share = (np.where(new, weight[held], 0) / np.bincount(held[new], minlength=len(weight))[held]).sum(1)
    least = max(1, int(np.ceil(overlap * len(share) - 1e-9)))
    return float(np.sort(share)[:least].sum())


def _indexed(ids: list, parts: list, owner: list, block: int, k1: float, b: float, told: tuple, overlap: float | None = None) -> Index:
    """An index of word arrays. Impacts are shares of a segment's whole weight, or of what ``overlap`` of its 5-grams weigh at least."""
    common = np.unique(np.concatenate(parts), return_counts=True)
    count = dict(zip(common[0].tolist(), common[1].tolist(), strict=True))
    # Segments of one language and of like lengths share blocks, which keeps block bounds tight.
    order = sorted(range(len(parts)), key=lambda i: (max((count[w], w) for w in parts[i].tolist())[1], len(parts[i])))
    parts, owner = [parts[i] for i in order], np.array([owner[i] for i in order])
    length = np.array([len(p) for p in parts], float)
    rows = [np.unique(p, return_counts=True) for p in parts]
    words = np.concatenate([r[0] for r in rows])
    tf = np.concatenate([r[1] for r in rows]).astype(float)
    segment = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    terms, term = np.unique(words, return_inverse=True)
    df = np.bincount(term, minlength=len(terms))
    idf = np.log1p((len(parts) - df + 0.5) / (df + 0.5))
    weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[segment] / length.mean()))
    if overlap is None:
        unit = np.bincount(segment, weight)
    else:
        ends = np.cumsum([len(r[0]) for r in rows])
        unit = np.array([_need(p, weight[e - len(r[0]) : e], overlap) for p, r, e in zip(parts, rows, ends, strict=True)])
    impact = (weight / unit[segment]).astype(np.float32)
    by = np.lexsort((segment, term))
    term, segment, impact = term[by], segment[by], impact[by]
    n_blocks = -(-len(parts) // block)
    entry = term * n_blocks + segment // block
    postings = np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]])
    entry, entry_bound = entry[postings], np.maximum.reduceat(impact, postings)
    entries = np.searchsorted(entry // n_blocks, np.arange(len(terms) + 1))
    bound = np.maximum.reduceat(entry_bound, entries[:-1])
    place = None
    if len(terms) * n_blocks <= PLACES:
        place = np.full(len(terms) * n_blocks, -1, np.int32)
        place[entry] = np.arange(len(entry))
    first = np.searchsorted(terms, np.arange(1 << HEAD, dtype=np.uint64) << np.uint64(64 - HEAD))
    return Index(ids, terms, np.r_[first, len(terms)].astype(np.int32), bound, entries, entry, entry_bound, np.r_[postings, len(impact)], segment.astype(np.int32), impact, place, owner, n_blocks, block, *told)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... of counts[i] each."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - starts, counts)


def _scored(index: Index, term: np.ndarray, starts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (passage, segment, score) that reach the threshold, of passages with the terms from their start on."""
    sizes = np.diff(np.r_[starts, len(term)])
    owner = np.repeat(np.arange(len(starts)), sizes)
    by = np.lexsort((index.bound[term], owner))
    term = term[by]
    bound = index.bound[term].astype(float)
    upto = np.cumsum(bound)
    upto -= np.repeat(upto[starts] - bound[starts], sizes)
    skipped = np.add.reduceat((upto < threshold).astype(np.int64), starts)  # terms before the pivot
    rest = np.where(skipped > 0, upto[starts + np.maximum(skipped, 1) - 1], 0.0)  # what they can add
    opening = np.flatnonzero(upto >= threshold)
    n = index.entries[term[opening] + 1] - index.entries[term[opening]]
    entry = _spread(index.entries[term[opening]], n)
    pair = np.repeat(owner[opening], n) * index.blocks + index.entry[entry] % index.blocks
    by = np.argsort(pair, kind="stable")
    pair, entry = pair[by], entry[by]
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(pair)])
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    most, pair = np.add.reduceat(index.entry_bound[entry].astype(float), first), pair[first]
    live = most + rest[pair // index.blocks] >= threshold
    most, pair = most[live], pair[live]

    def entries(pair, low, count):
        """For terms low, low + 1, ... of each pair's passage: the pair and the entry of the term in the pair's block, where there is one. So many pairs
        at a time that their terms fit."""
        upto, found, i = np.cumsum(count), [], 0
        while i < len(pair):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + HELD, "right")))
            of = np.repeat(np.arange(i, j), count[i:j])
            key = term[_spread(low[i:j], count[i:j])] * index.blocks + pair[of] % index.blocks
            if index.place is None:
                spot = np.minimum(np.searchsorted(index.entry, key), len(index.entry) - 1)
                hit = index.entry[spot] == key
            else:
                spot = index.place[key]
                hit = spot >= 0
            found.append((of[hit], spot[hit]))
            i = j
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2

    passage = pair // index.blocks
    of, spot = entries(pair, starts[passage], skipped[passage])
    most = most + np.bincount(of, index.entry_bound[spot], len(pair))
    pair = pair[most >= threshold]
    passage = pair // index.blocks
    of, spot = entries(pair, starts[passage], sizes[passage])
    n = index.postings[spot + 1] - index.postings[spot]
    posting = _spread(index.postings[spot], n)
    place = np.repeat(of, n) * index.block + index.segment[posting] % index.block
    score = np.bincount(place, index.impact[posting], len(pair) * index.block)
    place = np.flatnonzero((score >= threshold) & (score > 0))  # at a threshold of nothing the last block's unused places would count
    return passage[place // index.block], pair[place // index.block] % index.blocks * index.block + place % index.block, score[place]


def retrieve(index: Index, words: np.ndarray, rows: np.ndarray, threshold: float = THRESHOLD, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (row, item, score) with a passage of the row, or the ``whole`` row, scoring at least ``threshold`` against a segment of the item."""
    none = (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    head = (words >> np.uint64(64 - HEAD)).astype(np.int32)
    low, size = index.first[head], index.first[head + 1] - index.first[head]
    hit, term = [], []
    for k in range(int(size.max(initial=0))):  # few terms share their leading bits
        own = np.flatnonzero(size > k)
        own = own[index.terms[low[own] + k] == words[own]]
        hit.append(own)
        term.append(low[own] + k)
    if not sum(map(len, hit)):
        return none
    hit, term = np.concatenate(hit), np.concatenate(term)
    # Passage p of a row covers its word blocks p and p + 1; the last block stands alone only in short texts.
    n_blocks = np.ones(len(rows) - 1, np.int64) if whole else np.maximum(1, -(-(rows[1:] - rows[:-1]) // STRIDE))
    base = np.cumsum(n_blocks) - n_blocks
    owner = np.searchsorted(rows, hit, "right") - 1
    block = base[owner] + (0 if whole else (hit - rows[owner]) // STRIDE)
    second = block > base[owner]
    v = len(index.terms)
    keys = np.concatenate([block * v + term, (block[second] - 1) * v + term[second]])
    keys = keys.astype(np.int32) if n_blocks.sum() * v < 1 << 31 else keys
    keys.sort()
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
    passage, term = keys // v, keys % v
    starts = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
    sizes = np.diff(np.r_[starts, len(passage)])
    live = np.add.reduceat(index.bound[term], starts) >= threshold  # list bounds
    pick = np.repeat(live, sizes)
    passage, term = passage[pick], term[pick]
    if not len(passage):
        return none
    starts = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
    ends = np.r_[starts[1:], len(passage)]
    # So many passages at a time that their terms' entries fit.
    load = np.cumsum(index.entries[term + 1] - index.entries[term] + 1)[ends - 1]
    got, j = [], 0
    while j < len(starts):
        i, j = j, max(j + 1, int(np.searchsorted(load, (load[j - 1] if j else 0) + HELD, "right")))
        low = starts[i]
        p, segment, score = _scored(index, term[low : ends[j - 1]], starts[i:j] - low, threshold - 1e-6)
        if len(p):
            row = np.searchsorted(base, passage[starts[i:j]][p], "right") - 1
            got.append((row, index.item[segment], score))
    if not got:
        return none
    row, item, score = (np.concatenate(x) for x in zip(*got, strict=True))
    by = np.lexsort((-score, item, row))
    row, item, score = row[by], item[by], score[by]
    new = np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])]
    return row[new], item[new], score[new]


def _held(index: Index, words: np.ndarray, rows: np.ndarray) -> dict:
    """k: (rows, grams) of the items' grams that the rows hold, by row."""
    out = {}
    for k, (known, leading) in index.known.items():
        grams = gram_hashes(words, k)
        at = np.flatnonzero(leading[grams >> np.uint64(64 - HEAD)])
        at = at[known[np.minimum(np.searchsorted(known, grams[at]), len(known) - 1)] == grams[at]]
        row = np.searchsorted(rows, at, "right") - 1
        whole = at + k <= rows[row + 1]
        out[k] = row[whole], grams[at[whole]]
    return out


def _share(part: tuple[int, np.ndarray], held: dict, row: int) -> float:
    k, own = part
    low, high = np.searchsorted(held[k][0], (row, row + 1))
    return float(np.isin(own, held[k][1][low:high]).mean()) if low < high else 0.0


def _candidates(index: Index, words: np.ndarray, rows: np.ndarray, threshold: float, held: dict) -> list[tuple]:
    """(row, item, score) of all pairs to verify, by row; the score is null where only the index of parts retrieves the pair."""
    near = {(r, i): s for r, i, s in zip(*(x.tolist() for x in retrieve(index, words, rows, threshold)), strict=True)}
    row, item, _ = retrieve(index.parts, words, rows, SURE, True)
    some = np.isin(row, np.concatenate([x[0] for x in held.values()]))  # the others have no share of anything
    return [(*pair, near.get(pair)) for pair in sorted(near.keys() | set(zip(row[some].tolist(), item[some].tolist(), strict=True)))]


def _shards(items: DataFrame, most: int) -> list[Column]:
    """Conditions that deal items (key, words) out to shards of at most ``most`` words, as counted; each longer than a quarter of that alone."""
    alone = F.col("words") > most // 4
    rest = items.filter(~alone)
    n = max(1, -(-(rest.agg(F.sum("words")).first()[0] or 0) * 2 // most))
    while rest.groupBy(F.pmod("key", F.lit(n))).agg(F.sum("words").alias("w")).filter(F.col("w") > most).limit(1).count():
        n *= 2
    long = [r["key"] for r in items.filter(alone).select("key").distinct().collect()]  # one pass over the documents each, so few
    return [~alone & (F.pmod("key", F.lit(n)) == k) for k in range(n)] + [alone & (F.col("key") == k) for k in long]


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, shard: int = SHARD) -> DataFrame:
    """(doc_id, item_id, bm25, question_overlap, answer_overlap, leak) of all pairs a passage retrieves above ``threshold``, and of all leaks."""
    spark = docs.sparkSession
    tuned(spark)
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).dropDuplicates()
    items = written(items.select("*", F.xxhash64("item_id", "text").alias("key"), F.regexp_count("text", F.lit(WORD)).alias("words")), "items", files=8)
    kinds = {"doc_id": dict(docs.dtypes)["doc_id"], "item_id": dict(items.dtypes)["item_id"]}
    names = ["doc_id", "item_id", "bm25", "question_overlap", "answer_overlap", "leak"]
    schema = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, bm25 double, question_overlap double, answer_overlap double, leak boolean"
    parts = _shards(items, shard)
    found = []
    for part in parts:
        rows = items.filter(part).select("item_id", "text").collect()  # a shard's words, checked, or one long item
        index = build([(r[0], r[1]) for r in sorted(rows, key=lambda r: (str(r[0]), r[1]))], overlap=overlap)
        if index is None:
            continue
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            index = shared.value
            for batch in batches:
                for part in sliced(batch):
                    words, offs = hashed(part, True)
                    found = []
                    held = _held(index, words, offs)
                    scored, scores = -1, {}
                    for row, item, score in _candidates(index, words, offs, threshold, held):
                        q, a = _share(index.question[item], held, row), _share(index.answer[item], held, row)
                        leak = q >= overlap or (index.alone[item] and a >= overlap) or _share(index.every[item], held, row) >= overlap
                        if score is None:
                            if not leak:
                                continue
                            if scored != row:
                                own = words[offs[row] : offs[row + 1]]
                                _, items, best = retrieve(index, own, np.array([0, len(own)]), 1e-6)
                                scored, scores = row, dict(zip(items.tolist(), best.tolist(), strict=True))
                            score = scores.get(item, 0.0)
                        found.append((row, index.ids[item], score, q, a, leak))
                    if found:
                        cols = list(zip(*found, strict=True))
                        keys = part.column(0).take(pa.array(cols[0], pa.int64()))
                        kind = pa.int64() if kinds["item_id"] == "bigint" else None
                        yield pa.RecordBatch.from_arrays([keys, pa.array(cols[1], kind), *[pa.array(c) for c in cols[2:]]], names)

        one = docs.select("doc_id", "text").mapInArrow(run, schema)
        if len(parts) > 1:
            one = written(one, "matches")
            shared.destroy()
        found.append(one)
    if not found:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, found)


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that leak an item, told by id and text: other texts of a leaking row's id stay, and null ids are no exception.

    The leaking rows are few and written first, so that texts don't shuffle to meet them."""
    key, row = F.xxhash64("doc_id", "text", F.col("text").isNull()), free(docs.columns, "__quirekit_row")
    leaks = matches(docs.select(key.alias("doc_id"), "text"), benchmark, **options).filter("leak").select(F.col("doc_id").alias(row)).distinct()
    return docs.withColumn(row, key).join(written(leaks, "leaks"), row, "left_anti").select(*[column(c) for c in docs.columns])


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of the benchmark's items in all documents: (doc_id, item_id, bm25, question_overlap, answer_overlap)."""
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).filter("leak")
    return found.select("doc_id", "item_id", F.round("bm25", 6).alias("bm25"), "question_overlap", "answer_overlap")


