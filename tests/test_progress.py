import pytest
from pyspark.sql import functions as F

from palimpsest.operators import progress


def test_stages_count_what_passes(spark):
    run = progress.Run()
    df = run.stage(spark.createDataFrame([("a",), ("bc",), (None,)], "t string"), "in", size=F.octet_length("t"), failed=F.col("t").isNull())
    run.stage(df.where("t is not null"), "out").write.format("noop").mode("overwrite").save()
    assert [tuple(r) for r in run.table(spark).collect()] == [("in", 3, 3, 1), ("out", 2, 0, 0)]
    with pytest.raises(ValueError, match="there already"):
        run.stage(df, "in")
    empty = progress.Run()
    empty.stage(df.limit(0), "none", size=F.octet_length("t"), failed=F.col("t") == "x").write.format("noop").mode("overwrite").save()
    assert [tuple(r) for r in empty.table(spark).collect()] == [("none", 0, 0, 0)]


def test_streams_report_each_batch(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text("a\nbb\n" * (i + 1))
    seen = progress.StreamedRun()
    spark.streams.addListener(seen)
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path))
    counted = progress.streamed_stage(stream, "lines", size=F.octet_length("value"), failed=F.col("value") == "bb")
    writer = counted.writeStream.format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "state"))
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    for _ in range(100):
        if sum(r[3] for r in seen.rows) == 12:
            break
        __import__("time").sleep(0.1)
    spark.streams.removeListener(seen)
    totals = seen.table(spark).groupBy("query", "stage").agg(F.countDistinct("batch"), F.sum("n_rows"), F.sum("n_bytes"), F.sum("n_failed")).collect()
    assert [tuple(r) for r in totals] == [("counted", "lines", 3, 12, 18, 6)] and not seen.failures
