"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target number of words. A target of k sizes and a remainder is met by k complete epochs of all the
source's documents and one fractional selection: documents sorted by exponential keys -ln(u)/quality, taken while the
prefix sum of their words stays within the remainder. u is a hash of the document's id and text, so reruns agree.

The prefix sum never sorts a whole source in a task: logarithms of the keys fall into bins of 1 / GRID, sums of bins (combined before the
shuffle) give the one bin in which a source's remainder ends, that bin alone is cut into PARTS, and so on, LEVELS times; only what is
left, one in billions of a source's documents, is sorted. The bins are the same whatever the size of the corpus.

Defined results: a null text has no words; a null source is one source, ranked last; documents of equal keys go by id, then
size; a document without words is never taken; repeated rows count as documents of their own. The document the remainder ends
in is taken where this comes nearer to the target. Further columns of any type pass through; one called as what the mix adds is called
``doc_...`` in the result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import column, table, tuned, written
from .words import sliced, text_bytes, word_bounds

#: Weights of sources in the order of their names, repeating; what the mix holds of all words; most epochs of a source.
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2
#: Bins of a unit of the log key, parts each bin is cut into, and how often.
GRID, PARTS, LEVELS = 8, 256, 4


#: What the mix adds to a document's row.
ADDED = ("size", "source_size", "target", "copies", "taken")


def _named(columns: list[str]) -> tuple[dict[str, str], str]:
    """The names documents' own columns go by in the result, and a prefix that none of them has. One called as what the mix adds gets ``doc_`` in front."""
    taken, own = {c.lower() for c in columns}, {}
    for c in columns:
        name = c
        while name.lower() in ADDED or (name != c and name.lower() in taken):
            name = f"doc_{name}"
        own[c] = name
        taken.add(name.lower())
    prefix = "__mix"
    while any(n.startswith(prefix) for n in taken):
        prefix += "_"
    return own, prefix


def _measured(kept: list[str], added: list[str]):
    """Kept columns, the draw, and words and bytes of ``text``."""

    def run(batches):
        for batch in batches:
            for part in sliced(batch):
                raw, offs = text_bytes(part.column(part.schema.get_field_index("text")))
                _, _, rows = word_bounds(raw, offs)
                own = [part.column(i) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*own, part.column(part.num_columns - 1), pa.array(rows[1:] - rows[:-1]), pa.array(offs[1:] - offs[:-1])], kept + added)

    return run


def sized(docs: DataFrame, seed: int = 17, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """Columns ``keep`` (all, by default) of ``docs`` with words and bytes of each text, a number below 2**52 drawn by id and text, its log key and
    bins, their names after the prefix that is answered too."""
    tuned(docs.sparkSession)
    own, p = _named(docs.columns)
    keep = docs.columns if keep is None else keep
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    draw = F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("long")
    read = docs.select(*[column(c).alias(own[c]) for c in keep], *([] if "text" in keep else ["text"]), draw.alias(f"{p}draw"))
    kept, added = [own[c] for c in keep], [f"{p}draw", f"{p}size", f"{p}bytes"]
    schema = StructType([*[StructField(own[c], docs.schema[c].dataType) for c in keep], *[StructField(n, LongType()) for n in added]])
    rows = read.mapInArrow(_measured(kept, added), schema)
    rows = rows.withColumn(f"{p}key", log_key(F.col(f"{p}draw"), F.col(f"{p}size"), F.col(f"{p}bytes")))
    return rows.select("*", *[b.alias(f"{p}bin{k}") for k, b in enumerate(bins(F.col(f"{p}key")))]), p


def quality(size: Column, n_bytes: Column) -> Column:
    """Quality weight in (0, 1] without labels: long texts of usual word length weigh most."""
    usual = F.exp(-F.abs(n_bytes / F.greatest(size, F.lit(1)) - 6.5) / 6.5)
    return F.greatest(usual * size / (size + 20), F.lit(0.01))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, n, target): ``share`` of all words dealt by weight, no source above ``epochs`` of its own.

    Sources in the order of cap over weight are capped as long as the level, what is left over the weight left, is above."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(epochs))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("held", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = (F.sum("source_size").over(every) * share - F.col("spent")) / (F.sum("weight").over(every) - F.col("held"))
    per = per.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    first = F.min_by("level", F.struct(F.col("level").isNull(), F.col("cap") / F.col("weight"))).over(every)
    return per.select("source", "source_size", "n", F.least(F.col("cap"), F.coalesce(first * F.col("weight"), F.col("cap"))).alias("target"))


def log_key(draw: Column, size: Column, n_bytes: Column) -> Column:
    """Logarithm of the exponential key -ln(u) / quality: precise where u is next to one."""
    return F.log(-F.log((draw + 0.5) / float(1 << 52))) - F.log(quality(size, n_bytes))


def bins(value: Column) -> list[Column]:
    """The value's bin, its part of the bin, its part of that, and so on."""
    out, rest = [], value * GRID
    for _ in range(LEVELS):
        out.append(F.floor(rest).cast("int"))
        rest = (rest - F.floor(rest)) * PARTS
    return out


def ends(slim: DataFrame, per: DataFrame) -> DataFrame:
    """(at, end, before): the bins in which a source's remainder ends, level by level, and the words before them."""
    names = [f"bin{k}" for k in range(LEVELS)]
    found = per.select(F.col("of").alias("at"), "rest", F.array().cast("array<int>").alias("end"), F.lit(0).cast("long").alias("before"))
    upto = Window.partitionBy("at").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    for k in range(LEVELS):
        inside = F.col("source").eqNullSafe(F.col("at")) & (F.array(*names[:k]) == F.col("end") if k else F.lit(True))
        sums = slim.join(found, inside).groupBy("at", "rest", "end", "before", F.col(names[k]).alias("bin")).agg(F.sum("size").alias("words"))
        sums = sums.withColumn("upto", F.col("before") + F.sum("words").over(upto)).filter(F.col("upto") > F.col("rest"))
        last = sums.groupBy("at", "rest").agg(F.min(F.struct("bin", "end", (F.col("upto") - F.col("words")).alias("before"))).alias("last"))
        found = last.select("at", "rest", F.concat("last.end", F.array("last.bin")).alias("end"), "last.before")
    return found.drop("rest")


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = 17, keep: list[str] | None = None) -> DataFrame:
    """``docs``, all columns or those to keep, with size, source_size, target, copies and taken.

    Measures are written once; where texts are kept, words are counted once more with the rows, so that texts neither shuffle nor are written (unless sources
    are too many to be broadcast)."""
    keep = docs.columns if keep is None else list(dict.fromkeys([*keep, "doc_id", "source"]))
    rows, p = sized(docs, seed, keep if "text" not in keep else ["source"])
    names = [f"bin{k}" for k in range(LEVELS)]
    rows = written(rows, "mix")
    slim = rows.select("source", *[F.col(f"{p}{n}").alias(n) for n in ("size", *names)])
    if "text" in keep:
        rows, p = sized(docs, seed, keep)
    per = source_targets(slim, weights, share, epochs)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    per = per.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    per = written(per.select(F.col("source").alias("of"), "source_size", "target", "full", "rest"), "mix-sources")
    last = written(ends(slim, per), "mix-ends")
    apart = lambda df: df.select(*[F.col(c).alias(f"{p}{c}") for c in df.columns])
    m = lambda name: F.col(f"{p}{name}")
    rows = rows.join(apart(per), F.col("source").eqNullSafe(m("of"))).join(apart(last), F.col("source").eqNullSafe(m("at")), "left")
    place = F.array(*[m(n) for n in names])
    # Of each source only the documents of the last bin are sorted; the others are whole in or out.
    order = Window.partitionBy("source").orderBy(m("key"), "doc_id", m("size")).rowsBetween(Window.unboundedPreceding, 0)
    cut = rows.filter(place == m("end")).withColumn(f"{p}upto", m("before") + F.sum(m("size")).over(order))
    cut = cut.withColumn(f"{p}more", (m("upto") - m("size") / 2 <= m("rest")).cast("int")).drop(f"{p}upto")
    others = rows.filter(m("end").isNull() | (place != m("end"))).withColumn(f"{p}more", (m("end").isNull() | (place < m("end"))).cast("int"))
    both = cut.unionByName(others)
    copies = F.when(m("size") > 0, m("full") + F.when(m("rest") > 0, m("more")).otherwise(0)).otherwise(0).cast("long")
    kept = [column(c) for c in both.columns if not c.startswith(p)]
    return both.withColumn(f"{p}copies", copies).select(*kept, *[m(n).alias(n) for n in ("size", "source_size", "target", "copies")], (m("copies") * m("size")).alias("taken"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of all documents; see the module's defined results."""
    return mixed(table(spark, sf_dir, "documents"), keep=["doc_id", "source"]).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


#: The same mix by one sort a source.
ORACLE = f"""
WITH w AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS size, strlen(coalesce(text, '')) AS bytes,
  ('0x' || substr(md5(concat_ws(':', '17', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))), 1, 13))::BIGINT AS draw FROM documents),
k AS (SELECT *, ln(-ln((draw + 0.5::DOUBLE) / 4503599627370496)) - ln(greatest(exp(-abs(bytes / greatest(size, 1)::DOUBLE - 6.5) / 6.5) * size / (size + 20), 0.01)) AS key FROM w),
p AS (SELECT source, sum(size)::DOUBLE AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1)::INT % 3 + 1]::DOUBLE AS weight FROM w GROUP BY source),
o AS (SELECT *, 2 * source_size AS cap, row_number() OVER (ORDER BY 2 * source_size / weight, source NULLS LAST) AS i, sum(source_size) OVER () AS every, sum(weight) OVER () AS held FROM p),
l AS (SELECT *, (every * 1.5 - coalesce(sum(cap) OVER b, 0)) / (held - coalesce(sum(weight) OVER b, 0)) AS level FROM o WINDOW b AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, i) FROM l WHERE level * weight <= cap) * weight, cap)) AS target FROM l),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS full_epochs FROM t),
s AS (SELECT k.*, f.source_size, target, full_epochs, target - full_epochs * f.source_size AS rest, sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM k JOIN f ON k.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, round(target, 6) AS target, (size * (full_epochs + CASE WHEN rest > 0 AND upto - size / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM s
"""
