"""Substring search by trigrams: postings written beside the records, so that a search reads a few buckets of them.

Each different trigram of a record's lower-cased texts is a row of the postings, in the folder of its bucket and sorted
there; how many records a trigram has is a table of its own. A search takes the rarest of its trigrams, reads their
buckets alone, keeps the records that have all of them, and verifies these against the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.shipping import dealt

GRAM = 3
#: Records whose trigrams one task finds, about.
RECORDS = 1 << 14
#: Folders of postings; trigrams of a query that are looked up, the rarest.
BUCKETS, LOOKED_UP = 64, 4
#: Files that a bucket is dealt over at most.
PARTS = 4


def grams(text: Column) -> Column:
    """The different trigrams of a text in lower case; none of a shorter or null one."""
    low = F.lower(text)
    places = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(low, i, F.lit(GRAM))))


def _texts(rows: DataFrame, columns: tuple[str, ...]) -> Column:
    """All texts of a row as one array; array columns add each element."""
    none = F.array().cast("array<string>")
    parts = [F.coalesce(F.col(c), none) if rows.schema[c].dataType.typeName() == "array" else F.array(F.col(c)) for c in columns]
    return F.filter(F.concat(*parts), lambda x: x.isNotNull())


def bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write_postings(rows: DataFrame, key: str, columns: tuple[str, ...], path: str) -> None:
    """Postings (bucket, gram, key) under path/postings and counts (gram, n) under path/counts, of texts and arrays of texts."""
    # a key's texts come together first, so that its trigrams are told apart in its own row
    own = dealt(rows.select(F.col(key).alias("key"), _texts(rows, columns).alias("texts")), RECORDS, "key").groupBy("key").agg(F.flatten(F.collect_list("texts")).alias("texts"))
    found = own.select("key", F.explode(F.array_distinct(F.flatten(F.transform("texts", grams)))).alias("gram")).withColumn("bucket", bucket(F.col("gram")))
    # a frequent gram is dealt over several files of its bucket
    spread = found.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)))
    spread.repartition(BUCKETS * PARTS, "bucket", "part").sortWithinPartitions("bucket", "gram").drop("part").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    rows.sparkSession.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).sort("gram").write.mode("overwrite").parquet(f"{path}/counts")


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame | None:
    """(key) of the records that have the query's rarest trigrams; None if the query is too short for one."""
    q = query.strip().lower()
    wanted = sorted({q[i : i + GRAM] for i in range(len(q) - GRAM + 1)})
    if not wanted:
        return None
    counts = {r["gram"]: r["n"] for r in spark.read.parquet(f"{path}/counts").where(F.col("gram").isin(wanted)).collect()}
    rare = sorted(wanted, key=lambda g: (counts.get(g, 0), g))[:LOOKED_UP]
    in_buckets = [r[0] for r in spark.range(1).select(F.explode(F.array(*[bucket(F.lit(g)) for g in rare]))).collect()]
    postings = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(in_buckets) & F.col("gram").isin(rare))
    return postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rare)).select("key")


def holds(rows: DataFrame, query: str, columns: tuple[str, ...]) -> Column:
    q = F.lit(query.strip().lower())
    return F.exists(_texts(rows, columns), lambda x: F.contains(F.lower(x), q))


def search_postings(rows: DataFrame, key: str, query: str, columns: tuple[str, ...], path: str) -> DataFrame:
    """Rows of which a column holds the query, whatever its case, by the postings of these columns; array columns match by
    element. An empty query keeps all rows, one of under three characters reads all of them."""
    if not query.strip():
        return rows
    found = candidates(rows.sparkSession, path, query)
    own = rows if found is None else rows.join(found.withColumnRenamed("key", key), key, "left_semi")
    return own.where(holds(own, query, columns))
