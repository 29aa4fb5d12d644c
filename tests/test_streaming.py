"""Streamed counts equal batch counts."""

from taxoloom.streaming import frequencies


def test_counts_follow_the_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b\na"), (2, "b c"), (3, "a")], "doc_id long, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for name, f in (("words_seen", frequencies.word_counts), ("lengths_seen", frequencies.document_lengths)):
        q = f(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, f(docs).collect()))
