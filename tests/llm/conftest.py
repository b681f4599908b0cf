import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def make(spark):
    """Documents from (doc_id, text[, lang, source]) rows, with columns whose names clash with inner ones."""

    def build(rows, extra=True):
        from pyspark.sql import functions as F

        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        out = spark.createDataFrame(full, SCHEMA)
        if extra:
            for name in ("uid", "rid", "sig", "key", "bucket", "label", "pii", "size", "score", "spans", "_rank", "n", "id", "v"):
                out = out.withColumn(name, F.lit("clash"))
        return out

    return build


@pytest.fixture()
def saved(tmp_path):
    """Writes tables where a query reads them."""

    def save(**tables):
        for name, frame in tables.items():
            frame.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return save
