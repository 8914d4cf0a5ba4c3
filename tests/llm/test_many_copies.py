"""Many copies of one text beside a single variant: copies are never paired with each other."""

from threading import Timer

from pyspark.sql import functions as F

from lectern.llm import lookalikes


def test_copies_are_not_enumerated(spark):
    n = 100_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, "h\u0435llo paper").otherwise("hello paper").alias("text"))
    stop = Timer(45, spark.sparkContext.cancelAllJobs)  # n * n pairs take longer
    stop.start()
    try:
        got = lookalikes.same_looking_pairs(docs).agg(F.count("*"), F.sum((F.col("doc_id_a") == 7).cast("int")), F.sum((F.col("doc_id_b") == 7).cast("int"))).first()
    finally:
        stop.cancel()
    assert tuple(got) == (n - 1, n - 8, 7)
