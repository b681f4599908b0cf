"""Exact removal of long repeated byte strings with run-length Burrows-Wheeler indexes.

1. Texts are packed into blocks, which are written once. A window is ``span`` consecutive bytes of one text; the least hash among the ANCHOR-grams in
   it is its anchor, so equal windows have equal anchors. Runs of windows with one anchor make a piece: their bytes, at most 2 span - ANCHOR.
2. Blocks send a hash of each distinct anchor, 4 bytes and a count, dealt by the anchor; back come those that stand in more than one text, and
   whether they are common.
3. Blocks send the pieces of those anchors, dealt by the anchor; what equals a piece of a smaller id in the same block is decided there. Windows under a
   common anchor are sent one by one, dealt by their own hash, so a short footer of many texts with different surroundings is no hot group.
4. A bucket builds the run-length transform of the windows of its distinct pieces with sampled run ends (``runindex``), streams all pieces for their
   matching statistics, marks each match with the least id that has it (a match is a range of rows; the run ends lead to its text, which is
   compared), and answers with the windows of larger ids.
5. Blocks are cut by what all buckets answered.

Hashes only choose what meets; equality is decided on bytes, by the index and by equal pieces. Shuffled are hashes, pieces and, for two joins, the
compressed blocks, whose keys are all different: no id or text is a key, so copies and repeated rows make no hot key.

Defined results: null and empty texts have no bytes; texts shorter than ``span`` lose nothing; rows of equal id never remove each other's bytes; ids are whole
numbers (others are refused), a null one counts as the largest; repeated rows repeat; whole texts, whatever their length. Removed bytes may part a
character, so the kept text is binary. Further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets, dropped, table, tuned, written
from .runindex import RunIndex, expanded, pieces_text
from .words import mix, text_bytes

SPAN, ANCHOR = 50, 26
#: Bytes of text in a block, unless one text is longer; bytes hashed at a time.
BLOCK, PIECE = 4 << 20, 1 << 20
#: Occurrences from which an anchor is common.
COMMON = 4096
_LAST = np.int64((1 << 63) - 1)
_U = np.uint64
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xE7037ED1A0B428DB))
_MULTIPLIER = 0xC2B2AE3D27D4EB4F
_BLOCKS = "block long, size long, offsets binary, ids binary, nulls binary, body binary"
_PIECES = "part long, block long, text binary, lengths binary, which binary, docs binary, starts binary, ids binary"
_FOUND = "block long, docs binary, lows binary, highs binary"


def pack(values, kind=None) -> bytes:
    """Bytes or an array, compressed, after its size."""
    raw = values if isinstance(values, bytes) else np.ascontiguousarray(values, kind).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unpack(packed: bytes, kind=np.uint8) -> np.ndarray:
    size = int.from_bytes(packed[:8], "little")
    return np.frombuffer(pa.decompress(packed[8:], size, "zstd", asbytes=True) if size else b"", kind)


def _batch(names: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in names.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if k == "long" else pa.binary()) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def grams(raw: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k bytes, by doubling."""
    power, width, out, done = _BYTE[raw], 1, None, 0
    while True:
        if k & width:
            out, done = (power, width) if out is None else (out[: len(power) - done] * _U(pow(_MULTIPLIER, width, 1 << 64)) + power[done : done + len(out)], done + width)
        if width * 2 > k:
            return mix(out)
        power = power[:-width] * _U(pow(_MULTIPLIER, width, 1 << 64)) + power[width:]
        width *= 2


def _least(x: np.ndarray, n: int) -> np.ndarray:
    step = 1
    while step * 2 <= n:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (n - step)], x[n - step :]) if n > step else x


def anchored(raw: np.ndarray, offsets: np.ndarray, span: int, k: int):
    """Runs of windows with one anchor: text, first start in it, number, anchor. Where a text repeats itself runs are cut, so that none is longer than
    one anchor's reach."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    found = []
    for low in range(0, max(len(raw) - span + 1, 0), PIECE):
        part = raw[low : low + PIECE + span - 1]
        anchor = _least(grams(part, k), span - k + 1)
        own = owner[low : low + len(anchor)]
        at = np.flatnonzero(own == owner[low + span - 1 : low + span - 1 + len(anchor)])
        if not len(at):
            continue
        a, o = anchor[at], own[at]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (o[1:] != o[:-1]) | (at[1:] != at[:-1] + 1)])
        found.append((o[first], at[first] + low - offsets[o[first]], np.diff(np.r_[first, len(at)]), a[first]))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, _U))
    text, start, count, anchor = (np.concatenate(x) for x in zip(*found, strict=True))
    reach = span - k + 1
    n = -(-count // reach)
    step = expanded(np.zeros(len(n), np.int64), n) * reach
    text, start, count, anchor = (np.repeat(x, n) for x in (text, start, count, anchor))
    return text, start + step, np.minimum(count - step, reach), anchor


def _blocks(size: int):
    """Packs texts into blocks with ids that tell them apart in the written table."""

    def run(batches):
        task, made = TaskContext.get().partitionId() << 32, 0

        def block(texts, ids, nulls):
            lengths = [len(t) for t in texts]
            return _batch(_BLOCKS, [(task + made, sum(lengths), pack(np.r_[0, np.cumsum(lengths)], np.int64), pack(ids, np.int64), pack(nulls, np.uint8), pack(b"".join(t.tobytes() for t in texts)))])

        held, bytes_held = ([], [], []), 0
        for batch in batches:
            raw, offs = text_bytes(batch.column(1))
            ids, nulls = batch.column(0).fill_null(int(_LAST)).to_pylist(), batch.column(0).is_null().to_pylist()
            for i in range(batch.num_rows):
                text = raw[offs[i] : offs[i + 1]]
                if held[0] and bytes_held + len(text) > size:
                    yield block(*held)
                    made, held, bytes_held = made + 1, ([], [], []), 0
                for x, v in zip(held, (text, ids[i], nulls[i]), strict=True):
                    x.append(v)
                bytes_held += len(text)
            held = ([t.copy() for t in held[0]], *held[1:])  # the batch's memory goes
        if held[0]:
            yield block(*held)

    return run


def _loaded(batch: pa.RecordBatch, i: int):
    get = lambda name: batch.column(batch.schema.get_field_index(name))[i].as_py()
    return get("block"), unpack(get("body")), unpack(get("offsets"), np.int64), unpack(get("ids"), np.int64)


def _anchors(n: int, span: int, k: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block, raw, offsets, _ = _loaded(batch, i)
                text, _, _, anchor = anchored(raw, offsets, span, k)
                order = np.lexsort((text, anchor))
                a, t = anchor[order], text[order]
                first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]][: len(a)])
                count = np.minimum(np.diff(np.r_[first, len(a)]), 1 << 15)
                many = np.add.reduceat(np.r_[False, (a[1:] == a[:-1]) & (t[1:] != t[:-1])], first) if len(first) else count
                kept, count = a[first], (count << 1 | (many > 0)).astype(np.uint16 if len(count) and count.max() < 1 << 15 else np.uint32)
                bucket = (kept % _U(n)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                edge = np.searchsorted(bucket[by], np.arange(n + 1))
                rows = [(b, block, (kept[by[p:q]] >> _U(32)).astype(np.uint32).tobytes(), count[by[p:q]].astype(np.uint32).tobytes()) for b, (p, q) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if q > p]
                for j in range(0, len(rows), 256):
                    yield _batch("bucket long, block long, keys binary, counts binary", rows[j : j + 256])

    return run


def _shared(common: int):
    """Which anchors of a bucket stand in several texts; common ones apart."""

    def run(part: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, np.uint32) for x in part.column("keys").to_pylist()]
        flat, counts = np.concatenate(keys), np.frombuffer(b"".join(part.column("counts").to_pylist()), np.uint32)
        order = np.argsort(flat, kind="stable")
        s = flat[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        group = np.cumsum(np.r_[False, s[1:] != s[:-1]])
        several = (np.diff(np.r_[first, len(s)]) > 1) | (np.add.reduceat(counts[order] & 1, first) > 0)
        often = np.add.reduceat((counts[order] >> 1).astype(np.int64), first) > common
        state = np.empty(len(flat), np.uint8)
        state[order] = (several * (1 + (several & often)))[group]
        bucket, rows, at = part.column("bucket")[0].as_py(), [], 0
        for block, k in zip(part.column("block").to_pylist(), keys, strict=True):
            own = state[at : at + len(k)]
            at += len(k)
            if own.any():
                rows.append((block, bucket, k[own == 1].tobytes(), k[own == 2].tobytes()))
        return pa.Table.from_batches([_batch("block long, bucket long, keys binary, common binary", rows)])

    return run


def _ranges(block, docs, at):
    """Covered window starts of texts as runs, packed in one row of _FOUND."""
    order = np.lexsort((at, docs))
    docs, at = docs[order], at[order]
    cut = np.flatnonzero((docs[1:] != docs[:-1]) | (at[1:] > at[:-1] + 1))
    low, high = np.r_[0, cut + 1], np.r_[cut, len(at) - 1]
    return block, pack(docs[low], np.int32), pack(at[low], np.int32), pack(at[high], np.int32)


def _piece_rows(n_anchors: int, n: int, span: int, k: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block, raw, offsets, ids = _loaded(batch, i)
                text, start, count, anchor = anchored(raw, offsets, span, k)
                told, kind = [], []
                for x in batch.column(batch.schema.get_field_index("told"))[i].as_py():
                    for level, name in ((1, "keys"), (2, "common")):
                        own = np.frombuffer(x[name], np.uint32).astype(_U) | (_U(x["bucket"]) << _U(32))
                        told.append(own)
                        kind.append(np.full(len(own), level))
                told, kind = np.concatenate(told), np.concatenate(kind)
                by = np.argsort(told)
                told, kind = told[by], kind[by]
                asked = ((anchor % _U(n_anchors)) << _U(32)) | (anchor >> _U(32))
                spot = np.minimum(np.searchsorted(told, asked), len(told) - 1)
                level = np.where(told[spot] == asked, kind[spot], 0)
                single = np.flatnonzero(level == 2)
                t2, s2 = np.repeat(text[single], count[single]), expanded(start[single], count[single])
                ordinary = level == 1
                text, start, count, key = text[ordinary], start[ordinary], count[ordinary], anchor[ordinary]
                body = raw.tobytes()
                seen: dict[bytes, int] = {}
                text, start, count = np.r_[text, t2], np.r_[start, s2], np.r_[count, np.ones(len(t2), np.int64)]
                begin = offsets[text] + start
                which = np.array([seen.setdefault(body[a:b], len(seen)) for a, b in zip(begin.tolist(), (begin + count + span - 1).tolist(), strict=True)], np.int64)
                own = ids[text]
                least = np.full(len(seen), _LAST)
                np.minimum.at(least, which, own)
                later = own > least[which]
                if later.any():
                    found = _ranges(block, np.repeat(text[later], count[later]), expanded(start[later], count[later]))
                    yield _batch(_PIECES, [(-1 - block % n, block, b"", b"", b"", *found[1:])])
                pieces = list(seen)
                route = np.empty(len(pieces), np.int64)  # a common anchor's window goes by its own hash
                route[which[: len(key)]] = (key % _U(n)).astype(np.int64)
                if len(t2):
                    lone = which[len(key) :]
                    route[lone] = [int.from_bytes(hashlib.blake2b(pieces[w], digest_size=7).digest(), "little") % n for w in lone.tolist()]
                kept = np.flatnonzero(~later)
                kept = kept[np.lexsort((start[kept], text[kept], route[which[kept]]))]
                edge = np.searchsorted(route[which[kept]], np.arange(n + 1))
                rows = []
                for b in np.flatnonzero(np.diff(edge)).tolist():
                    part = kept[edge[b] : edge[b + 1]]
                    used, at = np.unique(which[part], return_inverse=True)
                    own_pieces = [pieces[u] for u in used.tolist()]
                    rows.append((b, block, pack(b"".join(own_pieces)), pack([len(p) for p in own_pieces], np.uint32), pack(at, np.uint32), pack(text[part], np.int32), pack(start[part], np.int32), pack(own[part], np.int64)))
                for j in range(0, len(rows), 64):
                    yield _batch(_PIECES, rows[j : j + 64])

    return run


def _matched(span: int):
    """The windows of one bucket's pieces that a smaller id also has."""

    def run(part: pa.Table) -> pa.Table:
        if part.column("part")[0].as_py() < 0:
            return pa.Table.from_arrays([part.column(c) for c in ("block", "docs", "starts", "ids")], ["block", "docs", "lows", "highs"])
        seen: dict[bytes, int] = {}
        load = lambda name, kind: [unpack(x, kind) for x in part.column(name).to_pylist()]
        which = []
        for text, lengths, own in zip(load("text", np.uint8), load("lengths", np.uint32), load("which", np.uint32), strict=True):
            body, ends = text.tobytes(), np.cumsum(lengths).tolist()
            at = np.array([seen.setdefault(body[a:b], len(seen)) for a, b in zip([0, *ends[:-1]], ends, strict=True)], np.int64)
            which.append(at[own])
        docs, starts, ids = load("docs", np.int32), load("starts", np.int32), load("ids", np.int64)
        block = np.repeat(np.array(part.column("block").to_pylist(), np.int64), [len(x) for x in docs])
        which, docs, starts, ids = np.concatenate(which), np.concatenate(docs).astype(np.int64), np.concatenate(starts).astype(np.int64), np.concatenate(ids)
        symbols, begin, length = pieces_text(list(seen))
        index = RunIndex(symbols, begin, length, span)
        windows, base = index.windows, index.first
        rows = np.empty(index.size, np.int64)
        for piece, offset, end in index.statistics():
            rows[base[piece] + offset] = end
        least = np.full(index.size + 1, _LAST)
        own = np.full(len(length), _LAST)
        np.minimum.at(own, which, ids)
        np.minimum.at(least, rows, np.repeat(own, windows))
        n = windows[which]
        spot = expanded(base[which], n)
        later = np.repeat(ids, n) > least[rows[spot]]
        who = np.repeat(np.arange(len(which)), n)[later]
        at = (expanded(starts, n))[later]
        order = np.argsort(block[who], kind="stable")
        who, at = who[order], at[order]
        edge = np.flatnonzero(np.r_[True, block[who][1:] != block[who][:-1]][: len(who)])
        told = [_ranges(int(block[who[a]]), docs[who[a:b]], at[a:b]) for a, b in zip(edge, np.r_[edge[1:], len(who)][: len(edge)], strict=True)]
        return pa.Table.from_batches([_batch(_FOUND, told)])

    return run


def _cut(span: int, with_text: bool):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                _, raw, offsets, ids = _loaded(batch, i)
                nulls = unpack(batch.column(batch.schema.get_field_index("nulls"))[i].as_py()).astype(bool)
                mark = np.zeros(len(raw) + 1, np.int32)
                for x in batch.column(batch.schema.get_field_index("found"))[i].as_py() or []:
                    docs = unpack(x["docs"], np.int32)
                    np.add.at(mark, offsets[docs] + unpack(x["lows"], np.int32), 1)
                    np.add.at(mark, offsets[docs] + unpack(x["highs"], np.int32) + span, -1)
                gone = np.cumsum(mark[:-1]) > 0
                rows = []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    own = gone[a:b]
                    removed = int(own.sum())
                    kept = raw[a:b][~own].tobytes() if removed else raw[a:b].tobytes()
                    spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if removed else 0
                    rows.append((b - a, removed, spans, hashlib.sha256(kept).hexdigest(), kept))
                for j in range(0, len(rows), 1000):
                    size, removed, spans, sha, kept = zip(*rows[j : j + 1000], strict=True)
                    own = pa.array(ids[j : j + 1000], mask=nulls[j : j + 1000])
                    out = [own, *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array(sha, pa.string())]
                    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                    yield pa.RecordBatch.from_arrays(out + [pa.array(kept, pa.binary())] * with_text, names + ["kept"] * with_text)

    return run


def deduplicated(docs: DataFrame, span: int = SPAN, anchor: int = ANCHOR, with_text: bool = True, block: int = BLOCK, common: int = COMMON) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every document, without the bytes that repeats cover."""
    if dict(docs.dtypes)["doc_id"] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("doc_id must be a whole number: the smallest one keeps a repeat")
    if not 0 < anchor <= span:
        raise ValueError("anchors must lie within a window")
    spark = docs.sparkSession
    tuned(spark)
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = buckets(body, 16 << 20)
    blocks = written(body.mapInArrow(_blocks(block), _BLOCKS), "blocks")
    hashes = blocks.mapInArrow(_anchors(n, span, anchor), "bucket long, block long, keys binary, counts binary")
    told = written(hashes.groupBy("bucket").applyInArrow(_shared(common), "block long, bucket long, keys binary, common binary"), "anchors")
    # Pieces are twice a window at most; a common anchor has one for each of its windows.
    size = told.agg(F.sum(F.length("keys") / 4 * (2 * span - anchor) + F.length("common") / 4 * span * (span - anchor + 1))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // (4 << 20)))
    asked = told.groupBy("block").agg(F.collect_list(F.struct("bucket", "keys", "common")).alias("told"))
    pieces = blocks.join(asked, "block").mapInArrow(_piece_rows(n, parts, span, anchor), _PIECES)
    found = written(pieces.groupBy("part").applyInArrow(_matched(span), _FOUND), "matches")
    dropped(told)
    per = found.groupBy("block").agg(F.collect_list(F.struct("docs", "lows", "highs")).alias("found"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return blocks.join(per, "block", "left").mapInArrow(_cut(span, with_text), out)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of all documents; see the module's defined results."""
    return deduplicated(table(spark, sf_dir, "documents"), with_text=False)


ORACLE = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, c, substring(h, 2000 * c + 1, 2098) AS s FROM (SELECT doc_id, h, unnest(range(0, (len(h) + 1999) // 2000)) AS c FROM t)),
w AS (SELECT doc_id, 1000 * c + q AS p, md5(substring(s, 2 * q + 1, 100)) AS k FROM (SELECT doc_id, c, s, unnest(range(0, least(1000, len(s) // 2 - 49))) AS q FROM c)),
hit AS (SELECT DISTINCT doc_id, p FROM w JOIN (SELECT k, min(doc_id) AS d FROM w GROUP BY k) USING (k) WHERE d < doc_id),
byte AS (SELECT doc_id, 1000 * c + q AS i, substring(s, 2 * q + 1, 2) AS x FROM (SELECT doc_id, c, s, unnest(range(0, least(1000, len(s) // 2))) AS q FROM c)),
cov AS (SELECT byte.doc_id, i, x, count(hit.p) OVER (PARTITION BY byte.doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS gone FROM byte LEFT JOIN hit ON hit.doc_id = byte.doc_id AND hit.p = i),
run AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM cov),
kept AS (SELECT doc_id, count_if(gone) AS n_removed, count_if(opens) AS n_spans, string_agg(x, '' ORDER BY i) FILTER (WHERE NOT gone) AS k FROM run GROUP BY 1)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)
"""
