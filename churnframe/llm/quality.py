"""Quality by importance resampling.

Texts are bags of hashed word unigrams and bigrams (A-Z lower-cased).  Two
generative models - bucket frequencies of the target text and of the raw text -
give each document its log importance weight, the sum over its n-grams of
log(target / raw).  Gumbel noise on the weights and a top-k are a sample
without replacement with odds in proportion to the weights.

Target: labelled rows of quality 1, a hash sample of at most about ``SAMPLE``
of of them.  Raw: every document.  k is ``SHARE`` of the rows.  The k-th largest
key is found to its last bit by counts on the doubles' ordered bits (eight a
round), so no task sorts or holds the table.

Defined results: NULL and empty texts have weight 0; long texts count whole;
noise depends on doc_id and the seed alone (NULL ids share one draw); rows
whose key equals the k-th to the last bit are all selected, so repeated rows
stay together;
without target rows all weights are 0; an empty table gives no rows; extra
columns ride in ``row``.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnframe.llm import common as C
from churnframe.operators.quantiles import order_statistics

BUCKETS = 10_000
SAMPLE = 20_000
SHARE = 0.8
SEED = 11
VOCABULARY = 500_000


class Grams:
    """Bucket numbers of a text's unigrams and bigrams."""

    def __init__(self, buckets: int):
        self.buckets, self.known = np.uint64(buckets), {}

    def of(self, text: bytes) -> np.ndarray:
        known, digest = self.known, xxhash.xxh3_64_intdigest
        if len(known) > VOCABULARY:
            known.clear()
        words = []
        for w in text.lower().split():
            h = known.get(w)
            if h is None:
                h = known[w] = digest(w)
            words.append(h)
        one = np.array(words, dtype=np.uint64)
        two = C.mixed(one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:])
        return (np.concatenate([one, two]) % self.buckets).astype(np.int64)


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """Sums over all rows; a task sends one row per bucket at most."""
    schema = T.StructType([C.field("bucket", "int"), C.field("n", "long")])

    def make():
        grams = Grams(buckets)

        def run(batches):
            total = np.zeros(buckets, np.int64)
            for batch in batches:
                for text in batch.column("text").to_pylist():
                    total += np.bincount(grams.of(text), minlength=buckets)
            seen = np.flatnonzero(total)
            yield {"bucket": seen.astype(np.int32), "n": total[seen]}

        return run

    out = np.zeros(buckets)
    for r in C.emit_rows(texts, make, schema).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Per bucket, log of the smoothed target over raw frequency."""
    if not target.sum():
        return np.zeros(len(raw))
    smooth = lambda n: (n + 1) / (n.sum() + len(n))
    return np.log(smooth(target)) - np.log(smooth(raw))


def resample(
    docs: DataFrame,
    target_ids: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    share: float = SHARE,
    sample: int = SAMPLE,
    buckets: int = BUCKETS,
    seed: int = SEED,
    carry: list[str] | None = None,
) -> DataFrame:
    """``row``, ``log_weight``, ``sample_key`` and ``selected``.
    ``target_ids`` has the ids of the target documents in ``id_col``."""
    spark = C.prepare(docs.sparkSession)
    key = F.col(C.quoted(id_col))
    usable = target_ids.where(key.isNotNull()).select(key.alias("doc"))
    part = min(1.0, sample / max(1, usable.count()))
    # at most about `sample` ids: a bounded broadcast
    picked = usable.where(C.hash_share(F.col("doc"), part)).distinct()
    texts = docs.select(key.alias("doc"), C.utf8(text_col).alias("text"))
    target = bucket_counts(texts.join(F.broadcast(picked), "doc", "left_semi").select("text"), buckets)
    ratio = spark.sparkContext.broadcast(log_ratio(target, bucket_counts(texts.select("text"), buckets)))

    def make():
        grams = Grams(buckets)

        def work(batch):
            return {"log_weight": [float(ratio.value[grams.of(t)].sum()) for t in batch.column("text").to_pylist()]}

        return work

    df = docs.select(C.packed(docs, carry), key.alias("doc"), C.utf8(text_col).alias("text"))
    scored = C.map_batches(df, make, [C.field("log_weight", "double")], ("text",))
    uniform = (F.pmod(F.xxhash64("doc", F.lit(seed)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    scored = scored.withColumn("sample_key", F.col("log_weight") - F.log(-F.log(uniform))).drop("doc")
    scored = C.materialise(scored)
    n = scored.count()
    k = int(round(share * n))
    least = order_statistics(scored, {"sample_key": [n - k]})["sample_key"][n - k] if k else float("inf")
    return scored.withColumn("selected", F.col("sample_key") >= F.lit(least))


def query(spark, sf_dir: str) -> DataFrame:
    good = C.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    found = resample(C.table(spark, sf_dir, "documents"), good, carry=["doc_id"])
    return found.select("row.doc_id", "log_weight", "sample_key", "selected")
