"""N-gram Jaccard join by vertical partitioning: near-duplicate documents, exactly.

A document is its set of distinct word 5-grams; equal sets are one entity. The global order of n-grams puts rare ones first: a
count sketch of fixed size gives each n-gram a level, hashes order the rest. The order is cut at quantiles of all occurrences into FRAGMENTS; an
entity's n-grams are stored fragment by fragment. The sizes of two entities' fragments bound their overlap, which
prunes pairs; of the others the partial overlaps are counted in each fragment apart and summed.

Candidates share one of the first n-grams of the global order (two sets that link must share one of as many as they may differ in). N-grams
that the same entities share are one group. Pairs are found in three turns, each followed by the counts and by new components, and none ever
emits all pairs of a group: first each member proposes the one member of another component, of its own and of the next size class, with
which it shares most groups; then a group's members in different components meet, blockwise where it is large, and give a forest of the
nearest pairs; last, all pairs that still stand in different components. Size and the Hamming distance of
parity bitmaps, which never exceeds the sets' difference, discard pairs that can't link before sets are read; the counts decide.

Two sets link where 100 * intersection >= 80 * union. 64-bit hashes stand for n-grams and sets.

Defined results: texts without words, and nulls, have size 0 and are components of their own; fewer than five words are one
n-gram; a component's id is the least doc_id in it, null ids aside; repeated rows repeat.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, buckets, column, dropped, free, table, tuned, written
from .components import components
from .shingles import shingle_sets, signatures
from .words import mix, sliced

SHINGLE = 5
#: Logarithm of the cells of the sketch (4 MB of levels), least bits of a bitmap, fragments of the order, entities of a group that meet in one task,
#: logarithm of the bits of a screen (8 MB), partners of an entity that are verified in one group.
CELLS, BITS, FRAGMENTS, MEET, SCREEN, BLOCK = 22, 1024, 4, 2048, 26, 256
#: Most bits of a bitmap.
MOST_BITS = 1 << 20
_U = np.uint64
_I = np.int64


def _bitmaps(sets: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """Parity of the number of n-grams in each cell; as many cells as n-grams, BITS at least."""
    out = []
    for a, b in zip(offs.tolist(), offs[1:].tolist(), strict=False):
        cells = min(max(BITS, 1 << (b - a).bit_length()), MOST_BITS)
        odd = np.bincount(((sets[a:b] >> _U(8)) & _U(cells - 1)).astype(_I), minlength=cells) & 1
        out.append(np.packbits(odd.astype(np.uint8)).tobytes())
    return out


def _folded(bits: bytes, words: int) -> np.ndarray:
    """A bitmap with as many cells as ``words`` 64-bit words have: cells that fall together add up."""
    out = np.frombuffer(bits, _U)
    while len(out) > words:
        half = len(out) // 2
        out = out[:half] ^ out[half:]
    return out


def _distance(x: bytes, y: bytes) -> int:
    """Hamming distance of two bitmaps; at most the number of n-grams that only one set has."""
    words = min(len(x), len(y)) // 8
    return int(np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum())


def _slim(shingle: int):
    names = ["doc_id", "uid", "n", "sig", "bits", "slice", "cells"]

    def run(batches):
        count = np.zeros(1 << CELLS, np.int64)
        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for part in sliced(batch, 2 << 20):
                sets, offs = shingle_sets(part, shingle)
                sig = signatures(sets, offs)
                count += np.bincount((sets >> _U(64 - CELLS)).astype(_I), minlength=1 << CELLS)
                rows = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.diff(offs)), pa.array(sig.view(_I)), pa.array(_bitmaps(sets, offs), pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names
                )
        if count.any():
            for k, own in enumerate(np.split(count.astype(np.uint32), 16)):
                planes = np.ascontiguousarray(own.view(np.uint8).reshape(-1, 4).T)  # high bytes are all but empty
                body = pa.compress(planes.tobytes(), "zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), *[pa.nulls(1, pa.int64())] * 3, pa.nulls(1, pa.binary()), pa.array([k], pa.int32()), pa.array([body], pa.binary())], names)

    return run


def _sum_cells(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(1 << (CELLS - 4), np.int64)
    for body in rows["cells"]:
        planes = np.frombuffer(pa.decompress(body, len(total) * 4, "zstd", asbytes=True), np.uint8)
        total += np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel()
    return pd.DataFrame({"slice": [int(rows["slice"].iloc[0])], "cells": [_packed(total)]})


def _packed(counts: np.ndarray) -> bytes:
    """Counts of a slice byte by byte, so that they compress."""
    return pa.compress(np.ascontiguousarray(counts.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def _counts(cells: bytes) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(bytes(cells), 8 << (CELLS - 4), "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.int64).ravel()


def _order(slices: list) -> tuple[np.ndarray, np.ndarray]:
    """Level of each cell: 0 for counts that chance explains, else the logarithm of the excess; and the places that cut the global
    order into FRAGMENTS of as many occurrences."""
    held = {int(row["slice"]): _counts(row["cells"]) for row in slices}
    part = lambda k: slice(k << CELLS - 4, (k + 1) << CELLS - 4)
    total = sum(int(own.sum()) for own in held.values())
    mean = total / (1 << CELLS)
    levels, share = np.zeros(1 << CELLS, np.uint8), np.zeros((64, 16))
    for k, own in held.items():
        many = np.flatnonzero(own > mean + 4 * np.sqrt(mean) + 4)
        levels[part(k)][many] = np.ceil(np.log2(np.maximum(own[many] - mean, 1)))
        share[:, k] = np.bincount(levels[part(k)], own, 64)
    upto, pivots = np.cumsum(share), []
    for goal in (total * k / FRAGMENTS for k in range(1, FRAGMENTS)):
        spot = min(int(np.searchsorted(upto, goal, "right")), upto.size - 1)
        level, k = divmod(spot, 16)
        cells = np.flatnonzero(levels[part(k)] == level) if k in held else []
        cell = 0
        if len(cells):
            at = int(np.searchsorted(np.cumsum(held[k][cells]), goal - (upto[spot] - share[level, k]), "right"))
            cell = (k << CELLS - 4) + int(cells[min(at, len(cells) - 1)])
        pivots.append((level << 58) | (cell << 58 - CELLS))
    return levels, np.array(pivots, _U)


def _keys(sets: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The n-grams' places in the global order."""
    return (levels[(sets >> _U(64 - CELLS)).astype(_I)].astype(_U) << _U(58)) | (sets >> _U(6))


def _prefixes(shared, n_buckets: int, shingle: int):
    def flush(held):
        keys, sigs = (np.concatenate(x) for x in zip(*held, strict=True))
        rare = keys >> _U(58) == 0
        # Frequent n-grams go as they are, spread by entity; rare ones meet in buckets, where most prove to be alone.
        bucket = np.where(rare, (keys % _U(n_buckets)).astype(_I), -1 - (sigs % _U(n_buckets)).astype(_I))
        order = np.lexsort((keys, bucket))
        keys, sigs, bucket = keys[order], sigs[order], bucket[order]
        edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        out = [(int(bucket[a]), keys[a:b].tobytes(), sigs[a:b].tobytes()) for a, b in zip(edge, [*edge[1:], len(keys)], strict=True)]
        for i in range(0, len(out), 64):
            cols = list(zip(*out[i : i + 64], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["bucket", "keys", "sigs"])

    def run(batches):
        levels, _ = shared.value
        held, size, seen = [], 0, set()
        for batch in batches:
            for part in sliced(batch, 2 << 20):
                sets, offs = shingle_sets(part, shingle)
                sig = signatures(sets, offs)
                keys = _keys(sets, levels)
                n = np.diff(offs)
                need = np.where(n > 0, n - (4 * n + 4) // 5 + 1, 0)
                own = []
                for i in np.flatnonzero(n).tolist():
                    s = int(sig[i])
                    if s not in seen:
                        seen.add(s)
                        own.append(i)
                        keys[offs[i] : offs[i + 1]].sort()
                if not own:
                    continue
                own = np.array(own)
                m = need[own]
                flat = np.repeat(offs[own], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                held.append((keys[flat], np.repeat(sig[own], m)))
                size += len(flat)
                if size >= 1 << 20:
                    yield from flush(held)
                    held, size, seen = [], 0, set()
        if held:
            yield from flush(held)

    return run


def _shared(rows: pd.DataFrame) -> pd.DataFrame:
    """Entries of a bucket whose n-gram two entities have: rare n-grams as ``whole`` groups, named by their members, others by n-gram."""
    keys = np.concatenate([np.frombuffer(x, _U) for x in rows["keys"]])
    sigs = np.concatenate([np.frombuffer(x, _U) for x in rows["sigs"]])
    whole = bool(rows["bucket"].iloc[0] >= 0)
    if whole:
        order = np.lexsort((sigs, keys))
        keys, sigs = keys[order], sigs[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (sigs[1:] != sigs[:-1])
        keys, sigs = keys[new], sigs[new]
        same = np.zeros(len(keys) + 1, bool)
        same[1:-1] = keys[1:] == keys[:-1]
        live = same[:-1] | same[1:]
        keys, sigs = keys[live], sigs[live]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, _I)
        if len(first):
            m = np.diff(np.r_[first, len(keys)])
            keys = np.repeat(mix(np.bitwise_xor.reduceat(mix(sigs), first) + m.astype(_U)), m)
    out = pd.DataFrame({"key": keys.view(_I), "sig": sigs.view(_I)}).drop_duplicates()
    return out.assign(whole=whole)


def _groups(blobs: DataFrame) -> DataFrame:
    """(g, sig): members of the groups of entities that share one of their first n-grams; n-grams of the same members are one group."""
    shared = written(blobs.groupBy("bucket").applyInPandas(_shared, "key long, sig long, whole boolean"), "shared")
    many = shared.filter("not whole").select("key", "sig").distinct()
    lists = many.groupBy("key").agg(F.bit_xor(F.xxhash64("sig")).alias("x"), F.count("*").alias("m")).filter("m > 1")
    named = many.join(lists, "key").select(F.xxhash64("x", "m").alias("g"), "sig")
    out = written(shared.filter("whole").select(F.col("key").alias("g"), "sig").unionByName(named).distinct(), "members")
    dropped(shared)
    return out


def _forest(apart: np.ndarray, ends: np.ndarray) -> list[int]:
    """Pairs, the nearest first, that join what those before leave apart."""
    parent = np.arange(int(ends.max()) + 1).tolist() if len(ends) else []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    pairs = ends.tolist()
    for k in np.argsort(apart, kind="stable").tolist():
        x, y = root(pairs[k][0]), root(pairs[k][1])
        if x != y:
            parent[x] = y
            out.append(k)
    return out


def _meet(rows: pd.DataFrame, forest: bool) -> pd.DataFrame:
    """Pairs of one group's members in different components that size and bitmaps allow to link; of these all, or a forest of the
    nearest: fewer pairs than members."""
    rows = rows.sort_values(["g", "low", "high", "n"], kind="stable")
    key, low, high = (rows[c].to_numpy() for c in ("g", "low", "high"))
    sig, n, label, chunk = (rows[c].to_numpy() for c in ("sig", "n", "label", "chunk"))
    whole = rows["bits"].tolist()
    bits = np.stack([_folded(x, BITS // 64) for x in whole])
    n = n.astype(_I)
    group = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
    node = np.unique(np.stack([group, label], 1), axis=0, return_inverse=True)[1].ravel() if forest else None
    # Members of a group stand by size: those that are not too large for one follow it.
    base = group.astype(_I) << 40
    left = np.searchsorted(base + n, base + 5 * n // 4, "right") - np.arange(len(key)) - 1
    total = np.r_[0, np.cumsum(left)]
    found, i = [np.zeros((0, 3), _I)], 0

    def thin(pairs: np.ndarray) -> np.ndarray:
        x, y = pairs[:, 0], pairs[:, 1]
        return pairs[_forest(pairs[:, 2] / (n[x] + n[y]), np.stack([node[x], node[y]], 1))]

    while i < len(key):
        j = max(i + 1, int(np.searchsorted(total, total[i] + 200_000, "right")) - 1)
        m = left[i:j]
        a = np.repeat(np.arange(i, j), m)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m)
        fine = (label[a] != label[b]) & ((low[a] == high[a]) | (chunk[a] != chunk[b]))
        a, b = a[fine], b[fine]
        apart = np.bitwise_count(bits[a] ^ bits[b]).sum(1).astype(_I)
        fine = np.flatnonzero(9 * apart <= n[a] + n[b])
        a, b, apart = a[fine], b[fine], apart[fine]
        # Bitmaps of large sets are longer than what was compared so far.
        for k in np.flatnonzero(np.minimum(n[a], n[b]) >= BITS).tolist():
            apart[k] = _distance(whole[a[k]], whole[b[k]])
        fine = 9 * apart <= n[a] + n[b]
        if fine.any():
            pairs = np.stack([a[fine], b[fine], apart[fine]], 1)
            found.append(thin(pairs) if forest else pairs)
        i = j
    every = np.concatenate(found)
    if forest and len(every):
        every = thin(every)
    x, y = sig[every[:, 0]], sig[every[:, 1]]
    out = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)], 1), axis=0)
    return pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})


def _apart(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([_distance(a, b) for a, b in zip(x, y, strict=True)], dtype="int32")


def _screen(uids: DataFrame) -> np.ndarray:
    """One bit for each of 2**SCREEN slots that some uid falls in: of fixed size, it only saves reading the other texts."""
    slot = F.pmod("uid", F.lit(1 << SCREEN)) + 1
    rows = uids.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()  # at most 2**SCREEN bits
    out = np.zeros((1 << SCREEN - 15, 1 << 12), np.uint8)
    for row in rows:
        out[row["k"] - 1] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def _fragments(screened, ordered, shingle: int):
    def run(batches):
        screen, (levels, pivots) = screened.value, ordered.value
        for whole in batches:
            slot = np.mod(whole.column(0).to_numpy(zero_copy_only=False), 1 << SCREEN)
            keep = (screen[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1
            if not keep.any():
                continue
            batch = whole.filter(pa.array(keep.astype(bool)))
            for part in sliced(batch, 2 << 20):
                sets, offs = shingle_sets(part, shingle)
                sig = signatures(sets, offs).view(_I)
                owner = np.repeat(np.arange(len(sig)), np.diff(offs))
                which = owner * FRAGMENTS + np.searchsorted(pivots, _keys(sets, levels), "right")
                order = np.argsort(which, kind="stable")  # hashes stay sorted in each fragment
                which, sets = which[order], sets[order]
                cut = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(sets) else np.zeros(0, _I)
                grams = [sets[x:y].tobytes() for x, y in zip(cut, [*cut[1:], len(sets)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(sig[which[cut] // FRAGMENTS]), pa.array((which[cut] % FRAGMENTS).astype(np.int32)), pa.array(grams, pa.binary())], ["sig", "fragment", "grams"])

    return run


def _overlaps(rows: pd.DataFrame) -> pd.DataFrame:
    """Partial overlaps of the partners ``b`` with the ``a`` of their block, in one fragment."""
    out = []
    for (a, _, _), own in rows.groupby(["a", "block", "fragment"], sort=False):
        lone = (own["b"] == a).to_numpy()  # the set itself
        if not lone.any() or lone.all():
            continue
        one = np.frombuffer(own["grams"][lone].iloc[0], _U)
        for b, body in zip(own["b"][~lone], own["grams"][~lone], strict=True):
            two = np.frombuffer(body, _U)
            short, long = (one, two) if len(one) < len(two) else (two, one)
            at = np.minimum(np.searchsorted(long, short), len(long) - 1)
            out.append((a, b, int((long[at] == short).sum())))
    return pd.DataFrame(out, columns=["a", "b", "part"]).astype(_I)


def _near(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b) of the pairs whose sizes and bitmaps allow a link."""
    apart = F.pandas_udf(_apart, "int")
    of = lambda x: entities.select(F.col("sig").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    sized = pairs.join(of("a"), "a").join(of("b"), "b").filter(5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b"))
    return sized.filter(9 * apart("bits_a", "bits_b") <= F.col("n_a") + F.col("n_b")).select("a", "b", "n_a", "n_b")


def _verified(near: DataFrame, entities: DataFrame, keyed: DataFrame, ordered, shingle: int, parts: int, files: int) -> DataFrame:
    """(a, b) of the pairs that link: overlaps counted in each fragment, summed. Only sets of these pairs are made, texts never shuffle."""
    needed = near.select(F.col("a").alias("sig")).unionByName(near.select(F.col("b").alias("sig"))).distinct()
    needed = needed.join(entities.select("sig", F.col("least.uid").alias("uid")), "sig").select("uid")
    screen = keyed.sparkSession.sparkContext.broadcast(_screen(needed))
    found = keyed.select("uid", "text").mapInArrow(_fragments(screen, ordered, shingle), "sig long, fragment int, grams binary")
    fragments = written(found.groupBy("sig", "fragment").agg(F.first("grams").alias("grams")), "fragments")
    screen.destroy()
    # No two sets share more of a fragment than the smaller one has of it.
    size = lambda k: F.coalesce(F.max(F.when(F.col("fragment") == k, F.length("grams") / 8)), F.lit(0))
    sizes = fragments.groupBy("sig").agg(F.array(*[size(k) for k in range(FRAGMENTS)]).alias("sizes"))
    of = lambda x: sizes.select(F.col("sig").alias(x), F.col("sizes").alias(f"sizes_{x}"))
    bound = F.aggregate(F.zip_with("sizes_a", "sizes_b", lambda x, y: F.least(x, y)), F.lit(0.0), lambda t, x: t + x)
    pairs = near.join(of("a"), "a").join(of("b"), "b").filter(9 * bound >= 4 * (F.col("n_a") + F.col("n_b"))).select("a", "b", "n_a", "n_b")
    # A set that many pairs have meets its partners in blocks; each partner's fragments travel once a pair.
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    pairs = written(pairs.join(blocks, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")).drop("blocks"), "pairs", files=files)
    ones = pairs.select("a", "block").distinct().join(fragments.withColumnRenamed("sig", "a"), "a").withColumn("b", F.col("a"))
    twos = pairs.select("a", "block", "b").join(fragments.withColumnRenamed("sig", "b"), "b")
    both = ones.unionByName(twos).withColumn("part", F.pmod(F.xxhash64("a", "block", "fragment"), F.lit(parts)))
    counted = both.groupBy("part").applyInPandas(_overlaps, "a long, b long, part long").groupBy("a", "b").agg(F.sum("part").alias("both"))
    links = written(counted.join(pairs, ["a", "b"]).filter("9 * both >= 4 * (n_a + n_b)").select("a", "b"), "links", files=files)
    for done in (fragments, pairs):
        dropped(done)
    return links


def _proposed(members: DataFrame, nodes: DataFrame, files: int) -> DataFrame:
    """(a, b) of each entity and the member of another component, of its own and of the next size class, with which it shares most groups."""
    rows = members.join(nodes, "sig").withColumn("class", F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.25))))
    rank = F.xxhash64(F.pmod("g", F.lit(4)), "label")
    one = F.struct(rank.alias("rank"), "label", "sig")
    # Two members of different components, if the group has such: whoever belongs to the one's component meets the other.
    hubs = written(rows.groupBy("g", "class").agg(F.min(one).alias("low"), F.max(one).alias("high")), "hubs")
    steps = rows.select("g", "sig", "label", F.posexplode(F.array(F.col("class"), F.col("class") + 1)).alias("step", "class")).join(hubs, ["g", "class"])
    other = F.when(F.col("label") == F.col("low.label"), F.col("high")).otherwise(F.col("low"))
    met = steps.withColumn("hub", other).filter("hub.label <> label").groupBy("step", "sig", F.col("hub.sig").alias("hub")).agg(F.count("*").alias("m"))
    best = met.groupBy("step", "sig").agg(F.max(F.struct("m", "hub")).alias("best"))
    out = written(best.select(F.least("sig", "best.hub").alias("b"), F.greatest("sig", "best.hub").alias("a")).distinct(), "proposed", files=files)
    dropped(hubs)
    return out


def _sized(entities: DataFrame, name: str) -> DataFrame:
    return entities.select(F.col("sig").alias(name), F.col("n").alias(f"n_{name}"))


def _met(members: DataFrame, nodes: DataFrame, entities: DataFrame, parts: int, forest: bool, files: int) -> DataFrame:
    """(a, b) of the pairs in different components that share a group and may link, or of forests of such."""
    label = members.join(nodes, "sig")
    mixed = label.groupBy("g").agg(F.count("*").alias("m"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("g", F.ceil(F.col("m") / MEET).cast("int").alias("chunks"))
    left = label.join(mixed, "g").withColumn("chunk", F.pmod(F.xxhash64("sig"), F.col("chunks")).cast("int"))
    left = left.join(entities.select("sig", "bits"), "sig")
    block = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least("chunk", j).alias("low"), F.greatest("chunk", j).alias("high")))
    left = left.withColumn("block", F.explode(block)).select("g", "sig", "n", "label", "chunk", "bits", "block.low", "block.high")
    parted = left.withColumn("part", F.pmod(F.xxhash64("g", "low", "high"), F.lit(parts)))
    return written(parted.groupBy("part").applyInPandas(lambda rows: _meet(rows, forest), "a long, b long").distinct(), "met", files=files)


def near_components(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, uid, n, component, chosen) of every document: uid names its id and text, component is its component's id (null for
    texts without words), chosen the uid of the one document that stands for the component."""
    spark = docs.sparkSession
    tuned(spark)
    kind = dict(docs.dtypes)["doc_id"]
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("uid"), "text")
    n_buckets, files = buckets(docs), buckets(docs, 32 << 20, 0)  # pairs and labels are small beside the texts
    both = written(keyed.mapInArrow(_slim(shingle), f"doc_id {kind}, uid long, n long, sig long, bits binary, slice int, cells binary"), "sets")
    slim = both.filter(F.col("slice").isNull())
    # The sketch has 2**CELLS counts, whatever the size of the corpus: 16 slices of 2 MB, summed by slice.
    slices = both.filter(F.col("slice").isNotNull()).select("slice", "cells").groupBy("slice").applyInPandas(_sum_cells, "slice int, cells binary").collect()
    ordered = spark.sparkContext.broadcast(_order(slices))
    entities = written(slim.filter("n > 0").groupBy("sig").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("least"), F.first("n").alias("n"), F.first("bits").alias("bits")), "entities")
    members = _groups(keyed.select("uid", "text").mapInArrow(_prefixes(ordered, n_buckets, shingle), "bucket long, keys binary, sigs binary"))
    links, labels = [], None

    def nodes() -> DataFrame:
        own = entities.select("sig", "n")
        return own.withColumn("label", F.col("sig")) if labels is None else own.join(labels, F.col("sig") == F.col("v"), "left").select("sig", "n", F.coalesce("label", "sig").alias("label"))

    for turn in range(3):
        met = _met(members, nodes(), entities, n_buckets * 4, turn == 1, files) if turn else _proposed(members, nodes(), files)
        near = met.join(_sized(entities, "a"), "a").join(_sized(entities, "b"), "b").select("a", "b", "n_a", "n_b") if turn else _near(met, entities)
        near = written(near, "near", files=files)
        if some := not near.isEmpty():
            links.append(_verified(near, entities, keyed, ordered, shingle, n_buckets * FRAGMENTS, files))
            before, labels = labels, components(reduce(DataFrame.unionByName, links), files)
        for done in [near, met, *([before] if some and before is not None else [])]:
            dropped(done)
        if turn == 1 and not some:
            break  # no two members of a group that stand apart may link

    names = entities.select("sig", "least").join(nodes().select("sig", "label"), "sig")
    least = names.groupBy("label").agg(F.min("least").alias("one"))
    named = written(names.select("sig", "label").join(least, "label").select("sig", F.col("one.doc_id").alias("component"), F.col("one.uid").alias("chosen")), "components")
    for done in [members, entities, *links, *([labels] if links else [])]:
        dropped(done)
    return slim.select("doc_id", "uid", "n", "sig").join(named, "sig", "left").select("doc_id", "uid", "n", "component", "chosen")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    return near_components(docs, shingle).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicated(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id (of equal ids the one of the least hash; rows without an id only where all are).

    Rows of equal id and text count as one; rows without words stay, each."""
    uid, place = free(docs.columns, "__quirekit_uid"), free(docs.columns, "__quirekit_rank")
    found = near_components(docs, shingle).filter("n > 0 and chosen = uid").select(F.col("uid").alias(uid)).distinct()
    keyed = docs.withColumn(uid, F.xxhash64("doc_id", "text"))
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    # Rows of equal id and text rank by their other columns, of any type, as one JSON text.
    order = F.xxhash64(F.to_json(F.struct(*[column(c) for c in docs.columns])))
    rank = F.row_number().over(Window.partitionBy(uid).orderBy(order))
    one = keyed.filter(worded).join(found, uid, "left_semi").withColumn(place, rank).filter(F.col(place) == 1)
    return one.drop(place, uid).unionByName(docs.filter(~worded))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_shingles, component_id) of all documents; see the module's defined results."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(l[p:p + 4], ' ')) AS g FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 4, 1) + 1)) AS p FROM w WHERE len(l) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2) JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 80 * (p.n + q.n - i)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT a, y FROM reach JOIN edges ON x = b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) c ON c.a = w.doc_id
"""
