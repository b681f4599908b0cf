"""Language-model scoring by Katz backoff over word bigrams.

Tokens are the lower-cased words of a text and one end. Good-Turing discounts (counts 1 to LOW) come from counts of counts; a context's
backoff weight is the mass its discounted bigrams leave over what the unigram model gives all words unseen after it, so every context's
distribution sums to one exactly. Unigrams are discounted too; the mass they leave is that of one unknown word.

Three scans. Unigram counts go to a table partitioned by word. Bigrams are counted by fingerprint for their counts of counts.
Then every occurrence goes to its context's partition, which counts its bigrams, derives its backoff weights and evaluates each token:
its bigram if seen, else the backoff weight times the unigram. Partial sums by document come together last.

The HEAD most frequent words, at most so many, are broadcast with their counts; occurrences of other words first pass their word's partition to get
theirs. Contexts with more than ``hot`` occurrences are split by the following word; their backoff weights are summed over the parts and
applied afterwards. So no key meets in one task, however frequent.

Defined results: a null or empty text is one end token; a null doc_id counts as held out; repeated rows count and repeat; where nothing was learned every token has
probability one, the unknown word's. A context none of whose bigrams is discounted takes one more count in its denominator; whether a split one
has any is told by the sum over its parts, so scores don't depend on what is split.
Hashes of 64 bits stand for words, bigrams and rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets, crc_mod, table, tuned, written
from .words import hashed, mix, sliced

#: Largest discounted count; most words broadcast; occurrences of a context in one task, at least, and most split contexts.
LOW, HEAD, HOT, MOST_HOT = 5, 1 << 21, 1 << 18, 100_000
#: Tokens a task holds at a time; bytes of stored input for each bucket.
HELD, EACH = 1 << 21, 8 << 20
END, BEGIN = np.uint64(0x0E9D0E9D0E9D0E9D), np.uint64(0xB0B0B0B0B0B0B0B1)
_BITS = 20
_U, _I = np.uint64, np.int64


def discounts(counts: dict[int, int]) -> np.ndarray:
    """Good-Turing factors d[0..LOW] of counts r (d[0] unused), from counts of counts; factors that don't lie in (0, 1) give way to
    absolute discounting by one half."""
    n = [0] + [counts.get(r, 0) for r in range(1, LOW + 2)]
    out = np.ones(LOW + 1)
    ratio = (LOW + 1) * n[LOW + 1] / n[1] if n[1] else 1.0
    for r in range(1, LOW + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - ratio) / (1 - ratio) if n[r] and ratio < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


@dataclass
class Unigrams:
    """What every task knows of the unigram model, of bounded size."""

    total: int = 0
    mass: int = 0  # what unigram counts are divided by
    types: int = 0
    d: np.ndarray = field(default_factory=lambda: np.ones(LOW + 1))
    unknown: float = 1.0
    head: np.ndarray = field(default_factory=lambda: np.zeros(0, _U))  # hashes of the most frequent words, sorted
    count: np.ndarray = field(default_factory=lambda: np.zeros(0, _I))
    rank: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # of each place by count: small numbers travel well
    place: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # of each rank
    first: np.ndarray = field(default_factory=lambda: np.zeros((1 << _BITS) + 1, np.int32))
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, _U))  # contexts that are split, sorted
    hot_count: np.ndarray = field(default_factory=lambda: np.zeros(0, _I))
    parts: np.ndarray = field(default_factory=lambda: np.zeros(0, _I))
    bigram_d: np.ndarray = field(default_factory=lambda: np.ones(LOW + 1))

    def probability(self, c: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(c))
        return np.where(c > 0, np.where(c <= LOW, self.d[np.minimum(c, LOW)], 1.0) * c / self.mass, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.types + 1)))

    def places(self, words: np.ndarray) -> np.ndarray:
        """Place of each word in the head, -1 for others."""
        out = np.full(len(words), -1, np.int32)
        top = (words >> _U(64 - _BITS)).astype(np.int32)
        low = self.first[top]
        size = self.first[top + 1] - low
        own = np.flatnonzero(size > 0)
        step = 0
        while len(own):
            hit = self.head[low[own] + step] == words[own]
            out[own[hit]] = low[own[hit]] + step
            own = own[~hit]
            step += 1
            own = own[size[own] > step]
        return out

    def split(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Hash that deals occurrences to buckets: the context's, and for split ones the part of the word."""
        out = context.copy()
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
            own = np.flatnonzero(self.hot[at] == context)
            part = word[own] % self.parts[at[own]].astype(_U)
            out[own] = mix(context[own] + part * _U(0x9E3779B97F4A7C15))
        return out


def _tokens(part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, their contexts and rows."""
    words, offs = hashed(part, True)
    token, context = np.insert(words, offs[1:], END), np.insert(words, offs[:-1], BEGIN)
    return token, context, np.repeat(np.arange(len(offs) - 1), np.diff(offs) + 1)


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _cut(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, first, end) of each run of a sorted array."""
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(edge, [*edge[1:], len(bucket)], strict=True)]


def _counted(n_buckets: int, pairs: bool):
    """Distinct words, or fingerprints of bigrams, of the texts with their counts, by bucket."""

    def flush(held):
        keys = np.concatenate(held)
        keys.sort()
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        counts = np.diff(np.r_[first, len(keys)]).astype(np.uint32)
        keys = keys[first]
        bucket = (keys % _U(n_buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        keys, counts, bucket = keys[order], counts[order], bucket[order]
        rows = []
        for k, a, b in _cut(bucket):
            body = (keys[a:b] >> _U(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() if pairs else keys[a:b].tobytes()
            rows.append((k, body, counts[a:b].tobytes() if counts[a:b].max() > 255 else counts[a:b].astype(np.uint8).tobytes()))
        for i in range(0, len(rows), 32):
            yield _batch(rows[i : i + 32], ["bucket", "keys", "counts"], [pa.int64(), pa.binary(), pa.binary()])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in sliced(batch):
                token, context, _ = _tokens(part)
                held.append(mix(context * _U(0xD6E8FEB86659FD93) + token) if pairs else token)
                size += len(token)
                if size >= HELD:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _merge(rows: pd.DataFrame, pairs: bool) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [], []
    for k, c in zip(rows["keys"], rows["counts"], strict=True):
        if pairs:
            wide = np.zeros((len(k) // 6, 8), np.uint8)
            wide[:, :6] = np.frombuffer(k, np.uint8).reshape(-1, 6)
            keys.append(wide.view(_U).ravel())
        else:
            keys.append(np.frombuffer(k, _U))
        counts.append(np.frombuffer(c, np.uint8 if len(c) == len(keys[-1]) else np.uint32).astype(_I))
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def _words_of(rows: pd.DataFrame) -> pd.DataFrame:
    keys, counts = _merge(rows, False)
    return pd.DataFrame({"word": keys.view(_I), "n": counts})


def _counts_of_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    r, n = np.unique(np.minimum(_merge(rows, True)[1], LOW + 2), return_counts=True)
    return pd.DataFrame({"r": r.astype(_I), "n": n.astype(_I)})


def learn(train: DataFrame, head: int = HEAD, hot: int = HOT) -> tuple[DataFrame, Unigrams]:
    """The table of unigram counts (word, n), and the model's bounded part."""
    tuned(train.sparkSession)
    n = buckets(train, EACH)
    text = train.select("text")
    blobs = text.mapInArrow(_counted(n, False), "bucket long, keys binary, counts binary")
    words = written(blobs.groupBy("bucket").applyInPandas(_words_of, "word long, n long"), "unigrams")
    level = F.floor(F.log2(F.col("n").cast("double")))
    by_level = {int(r["level"]): r["words"] for r in words.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()}  # at most 64 rows
    of = {int(r["n"]): int(r["words"]) for r in words.filter(F.col("n") <= LOW + 1).groupBy("n").agg(F.count("*").alias("words")).collect()}
    sums = words.agg(F.sum("n").alias("total"), F.count("*").alias("types")).first()
    model = Unigrams(int(sums["total"] or 0), int(sums["total"] or 0), int(sums["types"]))
    if not model.total:
        return words, model
    model.d = discounts(of)
    spent = sum((1 - model.d[r]) * r * of.get(r, 0) for r in range(1, LOW + 1))
    if not spent:  # no word is rare: the unknown word takes one more token
        model.mass += 1
        spent = 1.0
    model.unknown = float(spent / model.mass)
    least, held = 64, 0
    while least > 0 and held + by_level.get(least - 1, 0) <= head:
        least -= 1
        held += by_level.get(least, 0)
    top = words.filter(F.col("n") >= F.lit(1 << min(least, 62))).toArrow()  # at most ``head`` rows
    hashes, counts = top["word"].to_numpy().view(_U), top["n"].to_numpy()
    order = np.argsort(hashes)
    model.head, model.count = hashes[order], counts[order]
    model.place = np.argsort(-model.count, kind="stable").astype(np.int32)
    model.rank = np.empty(len(model.place), np.int32)
    model.rank[model.place] = np.arange(len(model.place), dtype=np.int32)
    model.first = np.searchsorted(model.head, np.arange((1 << _BITS) + 1, dtype=_U) << _U(64 - _BITS)).astype(np.int32)
    model.first[-1] = len(model.head)
    # The number of texts is the count of ends, which is also that of beginnings.
    ends = int((words.filter(F.col("word") == int(END.view(_I))).agg(F.sum("n")).first()[0]) or 0)
    bound = max(hot, model.total // MOST_HOT)
    many = model.count > bound
    keys, n_of = np.r_[model.head[many & (model.head != END)], BEGIN], np.r_[model.count[many & (model.head != END)], ends]
    keys, n_of = keys[n_of > bound], n_of[n_of > bound]
    order = np.argsort(keys)
    model.hot, model.hot_count = keys[order], n_of[order]
    model.parts = -(-model.hot_count // bound)
    pairs = text.mapInArrow(_counted(n, True), "bucket long, keys binary, counts binary")
    rows = pairs.groupBy("bucket").applyInPandas(_counts_of_pairs, "r long, n long").groupBy("r").agg(F.sum("n").alias("n")).collect()  # at most LOW + 2 rows
    model.bigram_d = discounts({int(r["r"]): int(r["n"]) for r in rows})
    return words, model


_NAMES = ["bucket", "contexts", "runs", "words", "counts", "docs", "uids", "train"]
_KINDS = [pa.int64()] + [pa.binary()] * 7
_BLOB = "bucket long, contexts binary, runs binary, words binary, counts binary, docs binary, uids binary, train binary"
_PACKED = ["slot", "uids", "n_tokens", "n_known", "base", "score"]
_PART = "slot long, uids binary, n_tokens binary, n_known binary, base binary, score binary, hot long, uid long, seen long, unseen long, count long, mass double, uni double"
_TOTAL = "uid long, n_tokens long, n_known long, base double, score double"


def _planes(x: np.ndarray, used: int) -> bytes:
    """The ``used`` low bytes of integers, one plane after the other, compressed: high bytes are all but empty."""
    flat = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1)[:, :used].T)
    return pa.compress(flat.tobytes(), "zstd", asbytes=True)


def _plain(body: bytes, n: int, used: int) -> np.ndarray:
    wide = np.zeros((n, 4), np.uint8)
    wide[:, :used] = np.frombuffer(pa.decompress(body, n * used, "zstd", asbytes=True), np.uint8).reshape(used, n).T
    return wide.view(np.uint32).ravel()


def _pack(bucket, context, word, count, row, uids, train):
    """Occurrences of one bucket, sorted by context: run-length contexts, words as ranks in the head or with counts, documents by place."""
    first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
    docs, doc = np.unique(row, return_inverse=True)
    return (
        bucket,
        context[first].tobytes(),
        _planes(np.diff(np.r_[first, len(context)]).astype(np.uint32), 4),
        _planes(word.astype(np.uint32), 3) if count is None else word.tobytes(),
        None if count is None else count.astype(np.uint32).tobytes(),
        doc.astype(np.uint16 if len(docs) <= 65536 else np.uint32).tobytes(),
        uids[docs].tobytes(),
        np.packbits(train[docs]).tobytes(),
    )


def _sums(uid, n_tokens, n_known, base):
    """Partial sums packed as one row that passes the shuffle: bucket below zero."""
    return (-1, uid.tobytes(), b"", n_tokens.astype(_I).tobytes(), n_known.astype(_I).tobytes(), base.tobytes(), b"", b"")


def _occurrences(shared, n_buckets: int, tail: bool):
    """Occurrences by context of the head's words, with sums by document; or, for ``tail``, those of other words by word."""

    def flush(held, model):
        token, context, row, uids, train, place = (np.concatenate(x) for x in zip(*held, strict=True))
        if tail:
            bucket = (token % _U(n_buckets)).astype(np.int32)
            order = np.lexsort((token, bucket))
        else:
            bucket = (model.split(context, token) % _U(n_buckets)).astype(np.int32)
            order = np.lexsort((context, bucket))
        token, context, row, place, bucket = token[order], context[order], row[order], place[order], bucket[order]
        out = []
        for k, a, b in _cut(bucket):
            s = slice(a, b)
            # For the tail the word leads and the context follows.
            out.append(_pack(k, token[s], context[s], np.zeros(0, np.uint32), row[s], uids, train) if tail else _pack(k, context[s], model.rank[place[s]], None, row[s], uids, train))
            if len(out) == 16:
                yield _batch(out, _NAMES, _KINDS)
                out = []
        if out:
            yield _batch(out, _NAMES, _KINDS)

    def run(batches):
        model: Unigrams = shared.value
        held, size, rows = [], 0, 0
        for batch in batches:
            for part in sliced(batch):
                token, context, row = _tokens(part)
                place = model.places(token)
                uids = part.column(0).to_numpy(zero_copy_only=False)
                train = part.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
                known = place >= 0
                if not tail:
                    n = len(uids)
                    c = model.count[place[known]]
                    sums = _sums(uids, np.bincount(row, minlength=n), np.bincount(row[known], minlength=n), np.bincount(row[known], model.base(c), n))
                    yield _batch([sums], _NAMES, _KINDS)
                pick = np.flatnonzero(known != tail)
                held.append((token[pick], context[pick], row[pick] + rows, uids, train, place[pick]))
                size, rows = size + len(pick), rows + len(uids)
                if size >= HELD or rows >= HELD:
                    yield from flush(held, model)
                    held, size, rows = [], 0, 0
        if size:
            yield from flush(held, model)

    return run


def _unpack(blobs: pd.DataFrame, model: Unigrams):
    """Concatenated contexts, words, counts of the words and documents of blobs; the documents' uids and training flags."""
    uids = np.unique(np.concatenate([np.frombuffer(u, _I) for u in blobs["uids"]]))
    flags = np.zeros(len(uids), np.uint8)
    out = []
    for c, r, w, n, d, u, t in zip(blobs["contexts"], blobs["runs"], blobs["words"], blobs["counts"], blobs["docs"], blobs["uids"], blobs["train"], strict=True):
        contexts = np.frombuffer(c, _U)
        runs = _plain(r, len(contexts), 4)
        total = int(runs.sum())
        at = np.searchsorted(uids, np.frombuffer(u, _I)).astype(np.int32)
        flags[at] = np.unpackbits(np.frombuffer(t, np.uint8), count=len(at))
        doc = at[np.frombuffer(d, np.uint16 if len(d) == 2 * total else np.uint32)]
        if n is None:
            place = model.place[_plain(w, total, 3)]
            word, n_of = model.head[place], model.count[place]
        else:
            word, n_of = np.frombuffer(w, _U), np.frombuffer(n, np.uint32).astype(_I) if len(n) else np.zeros(total, _I)
        out.append((np.repeat(contexts, runs), word, n_of, doc))
    return (*(np.concatenate(x) for x in zip(*out, strict=True)), uids, flags)


def _tail(shared, n_buckets: int):
    """Counts the words of a bucket and sends their occurrences on to their contexts' buckets."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        model: Unigrams = shared.value
        word, context, _, row, uids, flag = _unpack(rows, model)
        order = np.argsort(word, kind="stable")
        word, context, row = word[order], context[order], row[order]
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        n = np.diff(np.r_[first, len(word)])
        count = np.repeat(np.add.reduceat(flag[row].astype(_I), first), n)
        known, base = np.bincount(row, count > 0, len(uids)).astype(_I), np.bincount(row, model.base(count), len(uids))
        out = [_sums(uids, np.zeros(len(uids)), known, base)]
        bucket = (model.split(context, word) % _U(n_buckets)).astype(np.int32)
        order = np.lexsort((context, bucket))
        word, context, count, row, bucket = word[order], context[order], count[order], row[order], bucket[order]
        out += [_pack(k, context[a:b], word[a:b], count[a:b], row[a:b], uids, flag) for k, a, b in _cut(bucket)]
        return pd.DataFrame(out, columns=_NAMES)

    return run


def _slots(uids: np.ndarray, slots: int, **values) -> pd.DataFrame:
    """Sums by document packed into one row for each slot of documents; sums that aren't given are null."""
    slot = (uids.view(_U) % _U(slots)).astype(np.int32)
    order = np.argsort(slot, kind="stable")
    rows = [(k, uids[order[a:b]].tobytes(), *(_planes(values[c][order[a:b]], 8) if c in values else None for c in _PACKED[2:])) for k, a, b in _cut(slot[order])]
    return pd.DataFrame(rows, columns=_PACKED)


def _total(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of one slot's documents."""
    uids = np.unique(np.concatenate([np.frombuffer(u, _I) for u in rows["uids"]]))
    out = {"n_tokens": np.zeros(len(uids), _I), "n_known": np.zeros(len(uids), _I), "base": np.zeros(len(uids)), "score": np.zeros(len(uids))}
    for row in rows.itertuples(index=False):
        at = np.searchsorted(uids, np.frombuffer(row.uids, _I))
        for name, total in out.items():
            if getattr(row, name) is not None:
                flat = np.frombuffer(pa.decompress(getattr(row, name), len(at) * 8, "zstd", asbytes=True), np.uint8).reshape(8, -1)
                np.add.at(total, at, np.ascontiguousarray(flat.T).view(total.dtype).ravel())
    return pd.DataFrame({"uid": uids} | out)


def _evaluate(shared, slots: int):
    """Sums by document of all tokens whose contexts lie in a bucket."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        model: Unigrams = shared.value
        out = []
        sums = rows[rows["bucket"] < 0]
        for u, t, k, b in zip(sums["contexts"], sums["words"], sums["counts"], sums["docs"], strict=True):
            out.append(_slots(np.frombuffer(u, _I), slots, n_tokens=np.frombuffer(t, _I), n_known=np.frombuffer(k, _I), base=np.frombuffer(b, float)))
        blobs = rows[rows["bucket"] >= 0]
        if len(blobs):
            context, word, n_of, doc, uids, flag = _unpack(blobs, model)
            order = np.lexsort((word, context))
            context, word = context[order], word[order]
            n_of, doc = n_of[order], doc[order]
            del order
            new = np.r_[True, context[1:] != context[:-1]]
            pair = np.flatnonzero(new | np.r_[True, word[1:] != word[:-1]])
            c = np.add.reduceat(flag[doc].astype(_I), pair)  # training count of each bigram
            group = np.flatnonzero(new[pair])  # first bigram of each context
            own = np.add.reduceat(c, group)
            p_uni = model.probability(n_of[pair])
            kept = np.where(c <= LOW, model.bigram_d[np.minimum(c, LOW)], 1.0) * c
            mass, uni = np.add.reduceat(kept, group), np.add.reduceat(np.where(c > 0, p_uni, 0.0), group)
            heads = context[pair[group]]
            if len(model.hot):
                at = np.minimum(np.searchsorted(model.hot, heads), len(model.hot) - 1)
                hot = model.hot[at] == heads
                total = np.where(hot, model.hot_count[at], own).astype(float)
            else:
                hot, total = np.zeros(len(heads), bool), own.astype(float)
            total = np.where(~hot & (own > 0) & (mass >= own), total + 1, total)
            with np.errstate(divide="ignore", invalid="ignore"):
                weight = np.where(total > 0, (1 - mass / total) / (1 - uni), 1.0)
                per_group = np.diff(np.r_[group, len(pair)])
                seen = c > 0
                score = np.where(seen, np.log10(kept / np.repeat(total, per_group)), np.log10(p_uni) + np.where(np.repeat(hot, per_group), 0.0, np.repeat(np.log10(weight), per_group)))
            n = np.diff(np.r_[pair, len(context)])
            out.append(_slots(uids, slots, score=np.bincount(doc, np.repeat(score, n), len(uids))))
            if hot.any():
                out.append(pd.DataFrame({"hot": heads[hot].view(_I), "count": total[hot].astype(_I), "mass": mass[hot], "uni": uni[hot]}))
                # Unseen tokens wait for the context's weight; seen ones only where this part has no discounted bigram, as then no other may have.
                wait = np.repeat(np.repeat(hot, per_group) & (~seen | np.repeat(mass >= own, per_group)), n)
                if wait.any():
                    known = np.repeat(seen, n)[wait].astype(_I)
                    out.append(pd.DataFrame({"hot": context[wait].view(_I), "uid": uids[doc[wait]], "seen": known, "unseen": 1 - known}).groupby(["hot", "uid"], as_index=False).sum())
        # Typed one by one: a column that some lack would else pass through floats.
        names, blank = [*_PACKED, "hot", "uid", "seen", "unseen", "count", "mass", "uni"], dict.fromkeys(_PACKED[1:], None)
        kinds = dict.fromkeys(("slot", "hot", "uid", "seen", "unseen", "count"), "Int64") | dict.fromkeys(("mass", "uni"), "float64")
        return pd.concat([(x if "uids" in x else x.assign(**blank)).reindex(columns=names).astype(kinds) for x in out])

    return run


def scored(docs: DataFrame, train: Column, head: int = HEAD, hot: int = HOT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document, from the rows where ``train`` holds."""
    spark = docs.sparkSession
    tuned(spark)
    keyed = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    _, model = learn(keyed.filter("train"), head, hot)
    total = int(model.total)
    shared = spark.sparkContext.broadcast(model)  # at most HEAD words and MOST_HOT contexts
    n = buckets(docs, EACH, 1)
    known = keyed.select(F.xxhash64("doc_id", "text", F.col("text").isNull()).alias("uid"), "train", "text")
    names = written(keyed.select(F.xxhash64("doc_id", "text", F.col("text").isNull()).alias("uid"), "doc_id", "train"), "rows")
    rare = known.mapInArrow(_occurrences(shared, n, True), _BLOB).groupBy("bucket").applyInPandas(_tail(shared, n), _BLOB)
    every = known.mapInArrow(_occurrences(shared, n, False), _BLOB).unionByName(rare)
    part = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(-1 - F.pmod(F.xxhash64("contexts"), F.lit(4 * n)))
    parts = written(every.withColumn("part", part).groupBy("part").applyInPandas(_evaluate(shared, n), _PART), "scores")
    sums = parts.filter("slot is not null").select(*_PACKED).groupBy("slot").applyInPandas(_total, _TOTAL)
    whole = parts.filter("hot is not null and uid is null").groupBy("hot").agg(F.first("count").alias("count"), F.sum("mass").alias("mass"), F.sum("uni").alias("uni"))
    over = F.col("count") + F.when(F.col("mass") >= F.col("count"), 1).otherwise(0)  # as for any other context
    weight = whole.select("hot", F.log10((1 - F.col("mass") / over) / (1 - F.col("uni"))).alias("weight"), F.log10(F.col("count") / over).alias("less"))
    late = parts.filter("unseen is not null").select("uid", "hot", "seen", "unseen").join(F.broadcast(weight), "hot")  # at most MOST_HOT contexts
    late = late.select("uid", F.lit(None).cast("long").alias("n_tokens"), F.lit(None).cast("long").alias("n_known"), F.lit(None).cast("double").alias("base"), (F.when(F.col("unseen") > 0, F.col("unseen") * F.col("weight")).otherwise(0.0) + F.col("seen") * F.col("less")).alias("score"))
    by = sums.select("uid", "n_tokens", "n_known", "base", "score").unionByName(late).groupBy("uid").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    # Equal rows have one uid, and their sums are those of all of them.
    copies = names.groupBy("uid", "doc_id", "train").agg(F.count("*").alias("m"))
    one = copies.join(by, "uid").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return one.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        (F.col("n_tokens") / F.col("m")).cast("long").alias("n_tokens"),
        (F.col("n_known") / F.col("m")).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("m")).alias("base_score"),
        (F.col("score") / F.col("m")).alias("score"),
    )


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those whose crc32(doc_id) modulo 5 is not 1; see the module's defined results."""
    return scored(table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) != 1)
