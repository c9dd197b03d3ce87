from lexisift.streaming.logs import arriving_logs, counted_repeats, summarise_arriving


def test_logs_that_arrive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"a{i}.log").write_text("warn: A.B\n      slow\nwarn: A.B\n      slow\n")
        query = summarise_arriving(arriving_logs(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
        assert query.awaitTermination(120) and query.exception() is None
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        assert [(r.message, r.repeat_count) for r in rows] == [("slow", 2)] * (i + 1)


def test_repeats_in_windows_of_time(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type")
    table.write.parquet(str(tmp_path / "events"))
    stream = counted_repeats(spark.readStream.schema(table.schema).parquet(str(tmp_path / "events")), "ts", ["event_type"])
    query = stream.writeStream.format("memory").queryName("repeats").outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert spark.sql("select sum(repeat_count) as n from repeats").first().n == table.count()
