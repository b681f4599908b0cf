"""Vector codes by product quantisation, trained with Elkan's exact Lloyd rounds.

Vectors become whole numbers, floor(256 x), and are cut into equal parts; each part position has a codebook. A round assigns every part to its
nearest entry and moves each entry to the floor of its parts' mean. Between rounds each vector keeps, for each part, its entry, one upper bound of
the distance to it and one lower bound for every entry, in a table of the shared folder. Entries move: upper bounds grow by the movement of
their entry, lower bounds shrink by the movement of theirs. An entry is skipped where its lower bound, or half its distance from the part's entry,
lies strictly above the upper bound; all others are measured in whole numbers, so ties are decided exactly, to the lower index. Upper bounds are
rounded up, lower ones down, to one byte each: pruning may lose by it, results can't.

A round is one scan of that table and one shuffle of at most parts x entries sums a task. The driver holds the codebooks alone.

Defined results: rows with a null vector, or with a null or non-finite component, are dropped, as are vectors of another length than the
first kept one has, or of a length that can't be cut into equal parts. Components beyond ``vectors.limit`` (2**27 for 64 dimensions, x of half a
million) are held there. A null id comes last; rows of equal id rank by their vectors; repeated rows repeat. With fewer than ENTRIES vectors the
codebooks have fewer entries. Null labels are one label. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, table, tuned, written
from .vectors import above, below, binary, bytes_matrix, digest, floored, matrix, squares, summed, usable, whole

PARTS, ENTRIES, ROUNDS = 16, 64, 2
_STATE = "vec_id long, label {label}, x binary, entry binary, upper binary, lower binary"


def packed(bounds: np.ndarray) -> np.ndarray:
    """Lower bounds in a byte each, rounded down to three binary digits; below 1 they are 0."""
    bits = (np.maximum(bounds, 1.0).view(np.uint64) >> np.uint64(49)).astype(np.int64) - (1023 << 3) + 1
    return np.where(bounds < 1.0, 0, np.minimum(bits, 255)).astype(np.uint8)


def unpacked(codes: np.ndarray) -> np.ndarray:
    """The bounds that ``packed`` kept."""
    bits = (np.maximum(codes, 1).astype(np.uint64) - np.uint64(1) + np.uint64(1023 << 3)) << np.uint64(49)
    return np.where(codes == 0, 0.0, bits.view(np.float64))


def first_bounds(x: np.ndarray, book: np.ndarray):
    """Entry, upper bound and lower bounds of each row of one part, all measured."""
    d = squares(x, book)
    entry = d.argmin(1)
    root = np.sqrt(d)
    return entry, above(root[np.arange(len(x)), entry]), below(root)


def next_bounds(x: np.ndarray, book: np.ndarray, moved: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """The same after the entries moved, measuring only what the triangle inequality leaves open. Also the number of distances measured."""
    upper, lower = above(upper + moved[entry]), below(lower - moved)
    half = below(np.sqrt(squares(book, book))) / 2
    open_ = (lower <= upper[:, None]) & (half[entry] <= upper[:, None])
    open_[np.arange(len(x)), entry] = False
    rows = np.flatnonzero(open_.any(1))
    own = ((x[rows] - book[entry[rows]]) ** 2).sum(1)
    upper[rows] = above(np.sqrt(own))
    left = open_[rows] & (lower[rows] <= upper[rows, None]) & (half[entry[rows]] <= upper[rows, None])
    at, j = np.nonzero(left)
    if not len(at):
        return entry, upper, lower, len(rows)
    d = ((x[rows[at]] - book[j]) ** 2).sum(1)
    lower[rows[at], j] = below(np.sqrt(d))
    lower[rows, entry[rows]] = below(np.sqrt(own))
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    least = np.repeat(np.minimum.reduceat(d, first), np.diff(np.r_[first, len(at)]))
    tie = np.flatnonzero(d == least)
    tie = tie[np.r_[True, at[tie][1:] != at[tie][:-1]]]  # of equal ones the lowest index
    k, near, far = at[tie], j[tie], d[tie]
    better = (far < own[k]) | ((far == own[k]) & (near < entry[rows[k]]))
    row = rows[k[better]]
    entry = entry.copy()
    entry[row] = near[better]
    upper[row] = above(np.sqrt(far[better]))
    return entry, upper, lower, len(rows) + len(at)


def _assigned(books: np.ndarray, moved: np.ndarray | None, errors: bool):
    parts, entries, width = books.shape

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            x = matrix(get("x"), parts * width).reshape(n, parts, width)
            entry, upper, lower = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.float32), np.zeros((n, parts, entries), np.uint8)
            error = np.zeros(n, np.int64)
            if moved is not None:
                was = [bytes_matrix(get("entry"), np.uint8, parts), bytes_matrix(get("upper"), np.float32, parts), bytes_matrix(get("lower"), np.uint8, parts * entries).reshape(n, parts, entries)]
            for p in range(parts):
                if moved is None:
                    e, u, low = first_bounds(x[:, p], books[p])
                else:
                    e, u, low, _ = next_bounds(x[:, p], books[p], moved[p], was[0][:, p].astype(np.int64), was[1][:, p].astype(np.float64), unpacked(was[2][:, p]))
                entry[:, p], upper[:, p], lower[:, p] = e, np.nextafter(u.astype(np.float32), np.float32(np.inf)), packed(low)
                if errors:
                    error += ((x[:, p] - books[p][e]) ** 2).sum(1)
            ids = [get("vec_id"), get("label")]
            if errors:
                yield pa.RecordBatch.from_arrays([*ids, pa.array([r.tobytes().hex() for r in entry], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])
            else:
                yield pa.RecordBatch.from_arrays([*ids, binary(x.reshape(n, -1).astype(np.int32)), binary(entry), binary(upper), binary(lower)], ["vec_id", "label", "x", "entry", "upper", "lower"])

    return run


def _members(parts: int, entries: int, width: int):
    """Sums of a task's parts by entry."""

    def run(batches):
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            x = matrix(batch.column(0), parts * width).reshape(-1, parts, width)
            entry = bytes_matrix(batch.column(1), np.uint8, parts)
            for p in range(parts):
                np.add.at(sums[p], entry[:, p], x[:, p])
                counts[p] += np.bincount(entry[:, p], minlength=entries)
        p, e = np.nonzero(counts)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(counts[p, e]), pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "s"])

    return run


def coded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of the usable rows of vectors (vec_id, embedding, label), and the codebooks, parts x entries x width."""
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256: a code has two hexadecimal digits a part")
    spark = vectors.sparkSession
    tuned(spark)
    kind = vectors.schema["label"].dataType.simpleString()
    out = f"vec_id long, label {kind}, code string, error long"
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").filter(usable("embedding") & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    order = [F.asc_nulls_last("vec_id"), F.col("embedding")]
    head = fine.orderBy(*order).limit(1).select(F.size("embedding")).first()
    if head is None:
        return spark.createDataFrame([], out), np.zeros((parts, 0, 0), np.int64)
    dims = head[0]
    width = dims // parts
    x = fine.filter(F.size("embedding") == dims).select("vec_id", "label", whole("embedding", dims).alias("x"), "embedding")
    start = [r["x"] for r in x.orderBy(*order).limit(entries).select("x").collect()]  # as many rows as a codebook has entries
    books = np.array(start, np.int64).reshape(len(start), parts, width).transpose(1, 0, 2)
    rows, moved = x.select("vec_id", "label", "x"), None
    for _ in range(rounds):
        state = written(rows.mapInArrow(_assigned(books, moved, False), _STATE.format(label=kind)), "codes")
        if moved is not None:
            dropped(rows)
        counts, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for r in summed(state.select("x", "entry").mapInArrow(_members(*books.shape), "part long, entry long, n long, s array<long>"), ["part", "entry"], width):
            counts[r["part"], r["entry"]], sums[r["part"], r["entry"]] = r["n"], [r[f"s{i}"] for i in range(width)]
        now = floored(sums, counts, books)
        moved = above(np.sqrt(((now - books) ** 2).sum(2)))
        books, rows = now, state
    return rows.mapInArrow(_assigned(books, moved, True), out), books


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of all usable embeddings; see the module's defined results."""
    found, books = coded(table(spark, sf_dir, "embeddings"))
    found = written(found, "coded")  # read twice
    sums = found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return found.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    width, ks = 64 // PARTS, range(1, 64 // PARTS + 1)
    steps = [
        "f AS (SELECT vec_id, label, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64)",
        f"x AS (SELECT vec_id, label, p, [{', '.join(f'floor(256 * embedding[p * {width} + {k}]::DOUBLE)::BIGINT' for k in ks)}] AS x FROM f, range({PARTS}) r(p))",
        f"b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM x QUALIFY e < {ENTRIES})",
    ]
    gap = " + ".join(f"(x[{k}] - c[{k}]) * (x[{k}] - c[{k}])" for k in ks)
    floor_ = lambda k: f"((sum(x[{k}]) - ((sum(x[{k}]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT"
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS (SELECT vec_id, label, p, x, arg_min(e, d * {ENTRIES} + e) AS e, min(d) AS d FROM (SELECT vec_id, label, x.p, x, e, {gap} AS d FROM x JOIN b{r} ON x.p = b{r}.p) GROUP BY ALL)")
        if r < ROUNDS:
            steps.append(f"m{r} AS (SELECT p, e, [{', '.join(floor_(k) for k in ks)}] AS n FROM a{r} GROUP BY 1, 2)")
            steps.append(f"b{r + 1} AS (SELECT p, e, coalesce(n, c) AS c FROM b{r} LEFT JOIN m{r} USING (p, e))")
    steps.append(f"v AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY 1, 2)")
    steps.append("l AS (SELECT label, sum(error)::BIGINT AS label_error FROM v GROUP BY 1)")
    steps.append(f"s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, label_error, codebooks_sha256 FROM v JOIN l ON v.label IS NOT DISTINCT FROM l.label, s"


ORACLE = _oracle()
