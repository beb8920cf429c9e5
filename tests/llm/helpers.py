"""Small frames for the edge cases every operator must handle."""

from __future__ import annotations

import duckdb

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "row string, fp long, n_words long, anchor long, spans string, score double, bits long, doc long, text_hash long, findings string"


def docs(spark, texts, ids=None, sources=None):
    """Rows of the documents schema; ``texts`` may hold None."""
    ids = list(range(1, len(texts) + 1)) if ids is None else ids
    sources = sources or [f"s{i % 3}" for i in range(len(texts))]
    rows = [(i, t, None, s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources)]
    return spark.createDataFrame(rows, SCHEMA)


def hard(spark):
    """NULLs, empty, one-word and very long texts, repeated rows, extra
    columns whose names clash with the operators' own."""
    long = " ".join(f"w{i * 7919 % 4001}" for i in range(30_000))
    texts = [None, "", " \n\t ", "word", "the same text twice over", "the same text twice over", long, "é ß 日本 \U0001f600 a"]
    df = docs(spark, [*texts, "x", "x"], ids=[1, 2, 3, 4, 5, 5, 7, 8, None, None], sources=[None, *"abcabcabc"])
    for c in CLASHES.split(", "):
        name, kind = c.split(" ")
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("7").cast(kind))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def save(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def duck(sf_dir, sql):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.sql(sql).df()


def same(spark_df, duck_df):
    a = spark_df.toPandas()
    cols = sorted(a.columns)
    assert cols == sorted(duck_df.columns)
    key = lambda d: sorted(map(repr, d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None)))
    assert key(a) == key(duck_df)
