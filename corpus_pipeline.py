"""From documents to a training mix: five stages, each over all that its predecessor kept.

1. language: documents whose language can't be told (no text, no letter, or no language with a fair share) go; ``lang`` becomes the one
   inferred. The model learns from the stage's own rows that have a language.
2. near_duplicates: one document of each component of the n-gram Jaccard join stays, that of the least doc_id.
3. decontamination: documents that leak a benchmark item go.
4. pii: confirmed personal data is replaced by its kind in brackets; ``n_chars`` follows.
5. mixing: each document gets the number of copies the mix holds of it; those with none go.

Stages 1 to 4 return the columns of documents; the last adds size, source_size, target, copies and taken to them.

Defined results, for every stage: rows are told apart by id and text, never by id alone, and a null id is an id. Null and empty texts, and
those without a letter, go at stage 1, so no later stage drops or changes a row for want of a text. Rows of equal id and text count as one from
stage 2 on; of near copies the least id stays, one without an id only where no other has one. A null language teaches nothing and is filled in;
a null source is a source of its own, ranked last. Ties go by id, then by the hash of id and text. Further columns, of any type and
whatever their names, pass through all stages unchanged; the last calls one ``doc_...`` that has the name of what it adds. Empty tables give empty results; without benchmark items nothing leaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirekit.llm import op3_jaccard, op4_decontamination, op5_mixing, op9_language, op10_pii
from quirekit.llm.common import column, marked, swept, table, written

#: Share of a document its first language must hold.
FAIR = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows whose language can be told, with that language as ``lang``; the model learns from the rows that have one."""
    names, logp = op9_language.trained(docs)
    columns = docs.columns
    told = op9_language.identified(docs, names, logp, columns, "__told_").filter((F.col("__told_lang_pred") != "und") & (F.col("__told_score") >= FAIR))
    return told.select(*[F.col("__told_lang_pred").alias("lang") if c == "lang" else column(c) for c in columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies."""
    return op3_jaccard.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that leak an item of the table ``benchmark``."""
    return op4_decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in ``text`` and counts ``n_chars`` anew; keeps every row."""
    clean = op10_pii.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else clean


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that the mix holds, all columns, with the number of copies."""
    return op5_mixing.mixed(docs).filter("copies > 0")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("mixing", mixing),
]

#: Language inference, similarity joins and the mix's hashes can't be told in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again. What a stage wrote besides its result goes
    once that is written; the last stage's tables stay as long as its result may be read."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        began = marked()
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        swept(spark, began, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
