"""Substring deduplication by seed and extend.

Seeds: of the SPAN - SEED + 1 word SEED-grams of each span of SPAN words the one with the least hash is the span's anchor
(winnowing), so two equal spans have equal anchors. Documents meet on anchors, dealt by the anchor's hash. Extension: each seed carries
the fingerprints of the spans around it, left and right, that have it as anchor; equal ones are matches of the full threshold length, and
runs of consecutive matching spans are the maximal repeats, merged by document. A span is a repeat where a document of smaller id has it.

A task keeps only the smallest document of each of its spans for the shuffle and decides the others itself, so a passage that a third
of all documents share reaches a reducer once a task. Texts are scanned once to make seeds and once to cut them.

Fingerprints: 64 bits of the anchor and 48 of the span must both agree.

Defined results: null and empty texts have no words; documents of fewer words than SPAN lose nothing; rows of equal id never remove each
other; ids are whole numbers (others are refused), a null one counts as the largest; repeated rows repeat; whole texts, whatever their length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets, table, tuned
from .words import gram_hashes, mix, sliced, text_bytes, word_bounds, word_hashes

SPAN, SEED = 50, 25
#: Spans a task holds at a time.
HELD = 1 << 20
_LAST = np.int64((1 << 63) - 1)
_U = np.uint64
_SEEDS = "bucket long, seeds binary, ids binary, rids binary, firsts binary, counts binary, prints binary"
_RANGES = "bucket long, id long, rid long, low long, high long"


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values."""
    step, out = 1, x
    while step * 2 <= n:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    return np.minimum(out[: len(x) - n + 1], out[n - step : n - step + len(x) - n + 1]) if step < n else out


def _spans(words: np.ndarray, rows: np.ndarray, span: int, seed: int):
    """Row, position, anchor and print of each span of consecutive words of a row."""
    owner, at = [], []
    n = rows[1:] - rows[:-1] - span + 1
    live = np.flatnonzero(n > 0)
    if not len(live):
        return None
    owner = np.repeat(live, n[live])
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n[live]) - n[live], n[live])
    flat = at + rows[owner]
    anchor = _sliding_min(gram_hashes(words, seed), span - seed + 1)[flat]
    prints = gram_hashes(words, span)[flat]
    return owner, at, anchor, mix(prints)


def _decided(ids, prints):
    """Per element: whether another of a smaller id has the same print."""
    order = np.lexsort((ids, prints))
    p, i = prints[order], ids[order]
    first = np.r_[True, p[1:] != p[:-1]]
    least = i[np.maximum.accumulate(np.where(first, np.arange(len(p)), 0))]
    later = np.empty(len(p), bool)
    later[order] = i > least
    return later


def _merged(ids, rids, at):
    """Positions as runs: id, rid, first, last."""
    order = np.lexsort((at, rids, ids))
    ids, rids, at = ids[order], rids[order], at[order]
    cut = np.flatnonzero((ids[1:] != ids[:-1]) | (rids[1:] != rids[:-1]) | (at[1:] > at[:-1] + 1))
    low, high = np.r_[0, cut + 1], np.r_[cut, len(at) - 1]
    return ids[low], rids[low], at[low], at[high]


def _seeds(n_buckets: int, span: int, seed: int):
    def flush(held):
        ids, rids, at, anchor, prints = (np.concatenate(x) for x in zip(*held, strict=True))
        later = _decided(ids, prints)
        if later.any():
            i, r, a, b = _merged(ids[later], rids[later], at[later])
            for k in range(0, len(i), 100_000):
                part = slice(k, k + 100_000)
                none = pa.nulls(len(i[part]), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i[part]), -1)), none, none, none, none, none, none, pa.array(i[part]), pa.array(r[part]), pa.array(a[part]), pa.array(b[part])], NAMES)
        keep = np.flatnonzero(~later)
        ids, rids, at, anchor, prints = (x[keep] for x in (ids, rids, at, anchor, prints))
        bucket = (anchor % _U(n_buckets)).astype(np.int64)
        order = np.lexsort((at, rids, ids, anchor, bucket))
        ids, rids, at, anchor, prints, bucket = (x[order] for x in (ids, rids, at, anchor, prints, bucket))
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (ids[1:] != ids[:-1]) | (rids[1:] != rids[:-1]) | (at[1:] != at[:-1] + 1)]
        first = np.flatnonzero(new)
        count = np.diff(np.r_[first, len(at)])
        edge = np.flatnonzero(np.r_[True, bucket[first][1:] != bucket[first][:-1]])
        ends = np.r_[edge[1:], len(first)]
        out = []
        for a, b in zip(edge, ends, strict=True):
            s = first[a:b]
            low, high = s[0], s[-1] + count[b - 1]
            six = (prints[low:high] >> _U(16)).view(np.uint8).reshape(-1, 8)[:, :6]
            out.append((int(bucket[s[0]]), anchor[s].tobytes(), ids[s].tobytes(), rids[s].tobytes(), at[s].astype(np.int32).tobytes(), count[a:b].astype(np.uint16 if count[a:b].max() < 65536 else np.uint32).tobytes(), six.tobytes()))
        for k in range(0, len(out), 64):
            cols = list(zip(*out[k : k + 64], strict=True))
            n = len(cols[0])
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]], *[pa.nulls(n, pa.int64())] * 4], NAMES)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in sliced(batch):
                raw, offs = text_bytes(part.column(part.schema.get_field_index("text")))
                starts, ends, rows = word_bounds(raw, offs)
                found = _spans(word_hashes(raw, starts, ends, False), rows, span, seed)
                if found is None:
                    continue
                owner, at, anchor, prints = found
                ids = part.column(0).fill_null(int(_LAST)).to_numpy(zero_copy_only=False)
                rids = part.column(1).to_numpy(zero_copy_only=False)
                held.append((ids[owner], rids[owner], at, anchor, prints))
                size += len(at)
                if size >= HELD:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


NAMES = ["bucket", "seeds", "ids", "rids", "firsts", "counts", "prints", "id", "rid", "low", "high"]


def _extend(rows: pd.DataFrame) -> pd.DataFrame:
    """Joins the seeds of one bucket and extends those that two documents share."""
    load = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in rows[name]])
    seeds, ids, rids, firsts = load("seeds", _U), load("ids", np.int64), load("rids", np.int64), load("firsts", np.int32).astype(np.int64)
    counts = np.concatenate([np.frombuffer(c, np.uint16 if len(c) * 4 == len(s) else np.uint32) for c, s in zip(rows["counts"], rows["seeds"], strict=True)]).astype(np.int64)
    six = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, 6) for x in rows["prints"]])
    begin = np.cumsum(counts) - counts
    order = np.lexsort((ids, seeds))
    s, i = seeds[order], ids[order]
    first = np.r_[True, s[1:] != s[:-1]]
    group = np.cumsum(first) - 1
    shared = np.zeros(group[-1] + 1, bool)
    shared[group[1:][(s[1:] == s[:-1]) & (i[1:] != i[:-1])]] = True
    live = order[shared[group]]
    if not len(live):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("id", "rid", "low", "high")})
    n = counts[live]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    flat = np.repeat(begin[live], n) + step
    wide = np.zeros((len(flat), 8), np.uint8)
    wide[:, :6] = six[flat]
    prints = mix(wide.view(_U).ravel() + np.repeat(seeds[live], n))
    ids, rids, at = np.repeat(ids[live], n), np.repeat(rids[live], n), np.repeat(firsts[live], n) + step
    later = _decided(ids, prints)
    if not later.any():
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("id", "rid", "low", "high")})
    i, r, a, b = _merged(ids[later], rids[later], at[later])
    return pd.DataFrame({"id": i, "rid": r, "low": a, "high": b})


def repeats(docs: DataFrame, span: int = SPAN, seed: int = SEED) -> DataFrame:
    """(id, rid, low, high): runs of spans, by their first word's position, that a document of smaller id also has.

    ``docs`` has doc_id, text and rid, a hash of the text that tells rows of equal id apart."""
    tuned(docs.sparkSession)
    # Both kinds of rows pass one shuffle: blobs by bucket, what a task has decided itself by document.
    found = docs.select("doc_id", "rid", "text").mapInArrow(_seeds(buckets(docs), span, seed), _SEEDS + ", id long, rid long, low long, high long")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(-1 - F.pmod(F.xxhash64("id", "rid", "low"), F.lit(n * 4)))
    return found.withColumn("part", spread).groupBy("part").applyInPandas(_reduce, "id long, rid long, low long, high long")


def _reduce(rows: pd.DataFrame) -> pd.DataFrame:
    # A part holds blobs or decided rows, never both: null columns of the ones would turn the others' integers into floats.
    return _extend(rows) if rows["bucket"].iloc[0] >= 0 else rows[["id", "rid", "low", "high"]]


def repeat_ranges(docs: DataFrame, span: int = SPAN, seed: int = SEED) -> DataFrame:
    """(id, rid, ranges): for each document with repeats the (first, last) positions of its runs."""
    return repeats(docs, span, seed).groupBy("id", "rid").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))


def _cut(span: int, with_text: bool):
    def run(batches):
        for batch in batches:
            for part in sliced(batch, 1 << 20):
                raw, offs = text_bytes(part.column(part.schema.get_field_index("text")))
                starts, ends, rows = word_bounds(raw, offs)
                ranges = part.column(part.schema.get_field_index("ranges"))
                n_words, n_removed, shas, texts = [], [], [], []
                for k in range(part.num_rows):
                    s, e = starts[rows[k] : rows[k + 1]], ends[rows[k] : rows[k + 1]]
                    spots = ranges[k].values
                    keep = np.ones(len(s), bool)
                    if spots is not None and len(spots):
                        mark = np.zeros(len(s) + 1, np.int64)
                        np.add.at(mark, spots.field("low").to_numpy(), 1)
                        np.add.at(mark, np.minimum(spots.field("high").to_numpy() + span, len(s)), -1)
                        keep = np.cumsum(mark[:-1]) == 0
                    body = raw[offs[k] : offs[k + 1]].tobytes()
                    base = offs[k]
                    kept = b" ".join([body[a - base : b - base] for a, b in zip(s[keep].tolist(), e[keep].tolist(), strict=True)])
                    n_words.append(len(s))
                    n_removed.append(int(len(s) - keep.sum()))
                    shas.append(hashlib.sha256(kept).hexdigest())
                    texts.append(kept.decode())
                out = [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas, pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                yield pa.RecordBatch.from_arrays(out + [pa.array(texts, pa.string())] * with_text, names + ["kept"] * with_text)

    return run


def deduplicated(docs: DataFrame, span: int = SPAN, seed: int = SEED, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) of every document, without the words that repeats cover."""
    if dict(docs.dtypes)["doc_id"] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("doc_id must be a whole number: the smallest one keeps a repeat")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("rid", F.xxhash64("text"))
    found = repeat_ranges(keyed, span, seed)
    body = keyed.withColumn("id", F.coalesce("doc_id", F.lit(int(_LAST)))).join(found, ["id", "rid"], "left").select("doc_id", "text", "ranges")
    return body.mapInArrow(_cut(span, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of all documents; see the module's defined results."""
    return deduplicated(table(spark, sf_dir, "documents"), with_text=False)


ORACLE = """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS l FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(l[p:p + 49], ' ')) AS h FROM (SELECT doc_id, l, unnest(range(1, len(l) - 48)) AS p FROM w WHERE len(l) >= 50)),
hit AS (SELECT DISTINCT doc_id, p FROM win JOIN (SELECT h, min(doc_id) AS d FROM win GROUP BY h) USING (h) WHERE d < doc_id),
cov AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM hit),
word AS (SELECT doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i FROM w),
kept AS (SELECT doc_id, count(cov.i) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (WHERE cov.i IS NULL) AS k FROM word LEFT JOIN cov USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(l) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
