from corpusloom.streaming import history


def test_history_over_batches(spark, tmp_path):
    schema = "id long, conversation_id long, role string, content string"
    for k, rows in enumerate([[(1, 1, "user", "a"), (2, 1, "assistant", "b"), (1, 2, "user", "x")], [(4, 1, "assistant", "d"), (3, 1, "user", "c")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = history.last_messages(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 3)

        def store(batch, number):
            batch.write.mode("overwrite").parquet(str(tmp_path / f"out{number}"))

        q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(store).trigger(availableNow=True).start()
        q.awaitTermination()
    last = [(r.conversation_id, r.nth, r.content) for r in spark.read.parquet(str(tmp_path / "out1")).orderBy("nth").collect()]
    assert last == [(1, 1, "b"), (1, 2, "c"), (1, 3, "d")]


def test_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("cast(ts as timestamp) ts", "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    counted = history.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = counted.writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = events.selectExpr("date_trunc('hour', ts) start", "event_type").groupBy("start", "event_type").count()
    closed = spark.table("windows")
    assert closed.count() > 0
    assert closed.select("start", "event_type", "n").exceptAll(batch).count() == 0
