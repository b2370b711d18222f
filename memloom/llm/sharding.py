"""Two-pass external shuffle into shards, by DataFrame functions only.

Pass 1 scatters the records uniformly into memory-sized buckets by a seeded hash of document, text and, so that equal rows part too, a
row's number among its equals. Pass 2 gathers a bucket
into one array, puts it in a fixed order, shuffles it with Spark's seeded Fisher-Yates (`shuffle`) and cuts it up again; buckets
laid end to end are a random order of all records. Law `rows`: shard s takes the ranks from s*n/S to (s+1)*n/S, so that
counts are at most one apart, and a bucket's records go to one shard or two neighbours. A bucket holds BUCKET bytes of text
on average however large the input is; copies of a text, and repeated rows, go to different buckets. A seed fixes the order: buckets are dealt
to tasks by their number and each has a seed of its own, so neither the number of partitions nor a task's second run changes it.

Null text: no bytes, size 1. Null doc_id: an ordinary value. Repeated rows and ties: each row gets a slot of its own. Empty input: no rows.
A text longer than a bucket is a record like others. Extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import by_parts, running_totals, stored

#: Bytes of text in a bucket, on average, and the seed.
BUCKET = 8_000_000
SEED = 20240131


def numbered(docs: DataFrame) -> DataFrame:
    """docs with `copy`, the number of a row among those equal to it: all 0 where no row repeats, as in a table with ids.

    Repeated rows are found by narrow keys and counted with a partial step, so that a row that makes up a third of the table gathers nowhere.
    """
    key = docs.select("doc_id", F.xxhash64("text").alias("h"))
    twice = stored(key.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_d"), F.col("h").alias("_h")), "repeated")
    if twice.isEmpty():
        return docs.withColumn("copy", F.lit(0).cast("long"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_h"))
    counted = docs.join(twice, same, "left_semi").groupBy("doc_id", "text").agg(F.count("*").alias("n"))
    copies = counted.select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    return docs.join(twice, same, "left_anti").withColumn("copy", F.lit(0).cast("long")).unionByName(copies)


def scattered(docs: DataFrame, buckets: int, seed: int = SEED) -> DataFrame:
    """Pass 1: (bucket, doc_id, text); the hash decides, so that a lost task's second run deals the same way."""
    key = F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"), "copy")
    dealt = numbered(docs).select(F.pmod(key, F.lit(buckets)).cast("int").alias("bucket"), "doc_id", "text")
    return dealt.repartitionById(buckets, F.col("bucket"))


def shuffled(records: DataFrame, seed: int = SEED) -> DataFrame:
    """Pass 2: (bucket, at, n, doc_id, text), `at` being the place in the bucket after the shuffle.

    A bucket is a partition by its number, and Spark adds that number to the seed.
    """
    full = records.groupBy("bucket").agg(F.collect_list(F.struct("doc_id", "text")).alias("held"))
    full = full.withColumn("held", F.shuffle(F.array_sort("held"), F.lit(seed)))
    return full.select("bucket", F.size("held").alias("n"), F.posexplode("held").alias("at", "r")).select("bucket", "n", "at", "r.doc_id", "r.text")


def shard_documents(docs: DataFrame, shards: int = 16, bucket_bytes: int = BUCKET, seed: int = SEED) -> DataFrame:
    """Every record with its shard and its slot in it. The shuffled buckets are written once, by bucket, in the shared folder."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = by_parts(size + 64 * n, bucket_bytes, 1, 1_000_000)
    written = stored(shuffled(scattered(docs, buckets, seed), seed), "shards")
    # Ranks: the counts of the buckets before, summed within groups of buckets and then over the groups.
    counts = written.groupBy("bucket").agg(F.max("n").alias("n"))
    before = running_totals(counts, "bucket", "n", F.expr("bucket DIV 4096"))
    ranked = written.join(before, "bucket").withColumn("rank", F.col("before") + F.col("at"))
    shard = F.expr(f"CAST(((rank + 1) * {shards} - 1) DIV {max(1, n)} AS INT)")
    first = F.expr(f"(shard * CAST({n} AS BIGINT)) DIV {shards}")
    return ranked.withColumn("shard", shard).select(
        "doc_id", "text", "shard", (F.col("rank") - first).alias("slot")
    )
