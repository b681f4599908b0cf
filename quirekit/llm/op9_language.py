"""Language identification by multilingual mixture inference.

Byte trigrams of the lower-cased letters, hashed to BINS, are counted by language over all training texts. A word's likelihood
under a language is the product over its trigrams. Expectation-maximisation estimates the proportions of languages
that best explain a document's words; of the sets of the most likely one, two, ... languages, the one with the highest
penalised likelihood (BIC) is the document's set, its largest share the prediction.

The model has at most MODEL numbers, whatever the size of the corpus and the number of languages; it is broadcast. Up to 128 languages have BINS bins
each; of more, neighbouring bins are joined until the model fits, so thousands of labels are told by coarser counts but all are learned. Languages
are counted first, then texts are scanned once to count and once to predict, with no shuffle of texts. A task holds the words of one slice
of texts (or one text) x languages.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and no set, and so is every text where nothing was
learned; rows without language teach nothing; ties go to the language first by name; repeated rows repeat.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table, tuned
from .words import sliced, text_bytes

BINS = 1 << 15
#: Most numbers of a model.
MODEL = 1 << 22
ITERATIONS = 12
#: Log-likelihood a further language must gain, in units of half the logarithm of the number of words.
PENALTY = 2.0
_LETTER = re.compile(r"[^\W\d_]")

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = np.arange(97, 123)
for _b in range(128):
    if not chr(_b).isalpha():
        _FOLD[_b] = 32
_FOLD[ord("'")] = ord("'")


def _bins(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram bin at each byte (of the byte and its two neighbours), and folded bytes; rows stand apart by spaces."""
    flat = np.full(len(raw) + 2, 32, np.uint8)
    flat[1:-1] = _FOLD[raw]
    before, here, after = flat[:-2].copy(), flat[1:-1], flat[2:].copy()
    before[offs[:-1][offs[:-1] < len(raw)]] = 32
    after[offs[1:][offs[1:] > 0] - 1] = 32
    code = (before.astype(np.uint32) << np.uint32(16)) | (here.astype(np.uint32) << np.uint32(8)) | after
    code *= np.uint32(2654435761)
    return (code >> np.uint32(17)).astype(np.int32), here


def bins_of(languages: int, most: int = MODEL) -> int:
    """Bins a language has so that the model fits: a power of two."""
    room = max(1, most // max(1, languages))
    return min(BINS, 1 << (room.bit_length() - 1))


def trained(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = MODEL) -> tuple[list[str], np.ndarray]:
    """Languages by name, and log-probabilities (bins x languages), from all rows with a language."""
    tuned(docs.sparkSession)
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    n_bins = bins_of(known.select(lang).distinct().count(), most)
    joined = (BINS // n_bins).bit_length() - 1

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in sliced(batch):
                raw, offs = text_bytes(part.column(1))
                bins, here = _bins(raw, offs)
                names = np.array(part.column(0).to_pylist(), dtype=object)
                edge = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
                for a, b in zip(edge, [*edge[1:], len(names)], strict=True):
                    low, high = offs[a], offs[b]
                    own = bins[low:high][here[low:high] != 32]
                    total[names[a]] = total.get(names[a], 0) + np.bincount(own >> joined, minlength=n_bins)
                if len(total) * n_bins > 1 << 22:
                    yield from flushed(total)
                    total = {}
        yield from flushed(total)

    def flushed(total):
        for name, n in total.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(n[used].astype(np.int64))], ["lang", "bin", "n"])

    rows = known.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(count, "lang string, bin int, n long")
    counts = rows.groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()  # at most MODEL rows
    place = counts.column("lang").combine_chunks().dictionary_encode() if counts.num_rows else pa.array([], pa.string()).dictionary_encode()
    held = place.dictionary.to_pylist()
    names = sorted(held)
    rank = {name: i for i, name in enumerate(names)}
    table_ = np.full((n_bins, max(1, len(names))), 0.5)
    column = np.array([rank[h] for h in held], np.int64)[place.indices.to_numpy(zero_copy_only=False)]
    table_[counts.column("bin").to_numpy(), column] += counts.column("n").to_numpy()
    return names, np.log(table_ / table_.sum(0)).astype(np.float32)


def _infer(raw: np.ndarray, offs: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions (rows x languages) under the selected sets, the sets, and the number of words with letters."""
    rows, langs = len(offs) - 1, logp.shape[1]
    bins, here = _bins(raw, offs)
    bins >>= (BINS // len(logp)).bit_length() - 1
    solid = here != 32
    spots = np.flatnonzero(solid)
    share, chosen, n = np.zeros((rows, langs)), np.zeros((rows, langs), bool), np.zeros(rows, np.int64)
    if not len(spots):
        return share, chosen, n
    cut = np.zeros(len(raw) + 1, bool)
    cut[offs] = True
    first = np.r_[True, ~solid[spots[1:] - 1]] | cut[spots]
    words = np.flatnonzero(first)
    like = np.add.reduceat(logp[bins[spots]], words, axis=0)
    like -= like.max(1, keepdims=True)
    like = np.exp(np.maximum(like, -60.0))
    owner = np.searchsorted(offs, spots[words], "right") - 1
    n = np.bincount(owner, minlength=rows)
    live = np.flatnonzero(n)
    n_live = n[live][:, None]
    starts = np.r_[0, np.cumsum(n[live])[:-1]]
    seat = np.repeat(np.arange(len(live)), n[live])

    def fit(pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(rounds):
            post = like * pi[seat]
            post /= post.sum(1, keepdims=True)
            pi = np.add.reduceat(post, starts, axis=0) / n_live
            pi = np.maximum(pi, 1e-9) * (pi > 0)
        total = np.log(np.maximum((like * pi[seat]).sum(1), 1e-300))
        return pi, np.add.reduceat(total, starts)

    full, _ = fit(np.full((len(live), langs), 1 / langs, np.float32), ITERATIONS)
    order = np.argsort(-full, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    best = np.full(len(live), -np.inf)
    pick, sets = np.zeros((len(live), langs)), np.zeros((len(live), langs), bool)
    for k in range(1, langs + 1):
        # No likelihood exceeds 1, so no set of k or more can win where its penalty alone costs more than the best (less rounding).
        if (best > 1e-5 * n[live] - PENALTY * 0.5 * (k - 1) * np.log(n[live] + 1.0)).all():
            break
        inside = rank < k
        pi = np.where(inside, np.maximum(full, 1e-6), 0)
        pi, fitness = fit((pi / pi.sum(1, keepdims=True)).astype(np.float32), 0 if k == 1 else 2)
        fitness = fitness - PENALTY * 0.5 * (k - 1) * np.log(n[live] + 1.0)
        better = fitness > best
        best[better], pick[better], sets[better] = fitness[better], pi[better], inside[better]
    share[live], chosen[live] = pick, sets
    return share, chosen, n


def identified(docs: DataFrame, names: list[str], logp: np.ndarray, keep: list[str], prefix: str = "") -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred, score and languages (``name:share`` of the set, largest first), their names after ``prefix``."""
    added = [f"{prefix}{n}" for n in ("lang_pred", "score", "languages")]
    spark = docs.sparkSession
    tuned(spark)
    model = spark.sparkContext.broadcast(logp)
    kinds = dict(docs.dtypes)

    def run(batches):
        for batch in batches:
            for part in sliced(batch, (1 << 23) // max(8, len(names))):
                text = part.column(part.schema.get_field_index("text"))
                raw, offs = text_bytes(text)
                share, chosen, _ = _infer(raw, offs, model.value)
                fine = np.array([bool(t and _LETTER.search(t)) for t in text.to_pylist()], bool)
                fine &= chosen.any(1) & bool(names)
                top = share.argmax(1)
                pred = [names[j] if ok else "und" for j, ok in zip(top, fine, strict=True)]
                score = np.where(fine, share[np.arange(len(top)), top], 0.0).clip(0, 1)
                sets = [",".join(f"{names[j]}:{share[i, j]:.3f}" for j in np.argsort(-share[i], kind="stable") if chosen[i, j]) if fine[i] else "" for i in range(len(top))]
                out = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*out, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.string())], [*keep, *added])

    picked = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])])
    return picked.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"`{n}` {k}" for n, k in zip(added, ("string", "double", "string"), strict=True))]))


def held_out(key: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(crc_mod(key, folds) == fold, F.lit(False))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by a model of those whose crc32(doc_id) modulo 4 is not 2; see the module's defined results."""
    docs = table(spark, sf_dir, "documents")
    names, logp = trained(docs.filter(~held_out()))
    return identified(docs, names, logp, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages")
