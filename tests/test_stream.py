from pyspark.sql import functions as F

from sievemark.operators import regions
from sievemark.streaming import incremental
from sievemark.streaming.incremental import file_stream, id_range, scored_stream, windowed_counts


def test_each_record_is_scored_once(spark, tmp_path):
    source, out, bad, state = (str(tmp_path / x) for x in ("in", "out", "bad", "state"))
    schema = "id long, v int"
    score = lambda df: df.withColumn("score", F.col("v") * 2)
    valid = lambda df: df.withColumn("valid", F.col("v") >= 0)

    def go():
        scored_stream(file_stream(spark, source, spark.createDataFrame([], schema).schema), score, valid, out, bad, state, "id").awaitTermination()
        return sorted((r["id"], r["score"]) for r in spark.read.parquet(out).collect())

    spark.createDataFrame([(1, 1), (2, -1), (3, 3), (3, 3)], schema).write.mode("append").parquet(source)
    assert go() == [(1, 2), (3, 6)]
    spark.createDataFrame([(3, 9), (4, 4)], schema).write.mode("append").parquet(source)
    assert go() == [(1, 2), (3, 6), (4, 8)]
    assert spark.read.parquet(bad).count() == 1


def test_windowed_counts(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:10", "a"), ("2024-01-01 00:00:50", "a"), ("2024-01-01 00:01:10", "a")], "t string, k string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r["n"] for r in windowed_counts(df, "t", ["k"], "1 minute", "1 minute").collect()) == [1, 2]


def _regions(spark, tmp_path, batches, **more):
    source, out, bad, state, sums = (str(tmp_path / x) for x in ("in", "out", "bad", "state", "sums"))
    schema = spark.createDataFrame([], "id long, " + regions.MEASURED).schema
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        scored_stream(file_stream(spark, source, schema), lambda df: df, lambda df: df.withColumn("valid", F.col("id").isNotNull()), out, bad, state, "id", sums=regions.partial, partials=sums, **more).awaitTermination()
    return spark.read.schema(schema).parquet(out), spark.read.parquet(sums)


def test_sums_of_batches_are_the_rollup(spark, tmp_path):
    kinds = ("Trusted ICU Coverage", "Likely Medical Gap", "Insufficient Data", "Needs Human Review")
    row = lambda i: (i, kinds[i % 4], i % 101, i * 7 % 101, f"s{i % 3}" if i % 5 else None, f"d{i % 7}" if i % 2 else None)
    batches = [[row(i) for i in range(60)], [row(i) for i in range(40, 120)], [row(i) for i in range(100, 110)], [row(0), (None, None, None, None, None, None)]]
    for k, more in enumerate(({}, {"slot": id_range("id", 25)})):
        out, sums = _regions(spark, tmp_path / str(k), batches, **more)
        assert out.count() == 120
        for level in ("state", "district"):
            assert sorted(map(str, regions.merged(sums, level).collect())) == sorted(map(str, regions.rollup(out, level).collect()))


def test_a_batch_reads_the_ranges_that_it_touches(spark, tmp_path, monkeypatch):
    row = lambda i: (i, "Likely Medical Gap", 50, 0, "s", "d")
    read, earlier = [], incremental._earlier

    def counted(*given):
        found = earlier(*given)
        read.append(len(found.inputFiles()))
        return found

    monkeypatch.setattr(incremental, "_earlier", counted)
    _regions(spark, tmp_path, [[row(i) for i in range(10 * b, 10 * b + 12)] for b in range(8)], slot=id_range("id", 10))
    # the range before is touched by the two ids that come twice; older ones are not, however many there are
    assert read[0] == 0 and max(read) == min(read[2:]) <= 3
    monkeypatch.setattr(incremental, "MOST_SLOTS", 1)
    out, _ = _regions(spark, tmp_path / "all", [[row(i) for i in range(30)], [row(i) for i in range(5, 45)]], slot=id_range("id", 10))
    assert out.count() == 45


def test_a_batch_of_many_ranges_is_laid_out_in_few_wide_folders(spark, tmp_path, monkeypatch):
    row = lambda i: (i, "Likely Medical Gap", 50, 0, "s", "d")
    read, earlier = [], incremental._earlier

    def counted(*given):
        found = earlier(*given)
        read.append(len(found.inputFiles()))
        return found

    monkeypatch.setattr(incremental, "_earlier", counted)
    monkeypatch.setattr(incremental, "MOST_FOLDERS", 16)
    # 101 ranges at once (7 when wider), then some of their ids again with new ones, in narrow ranges
    batches = [[row(i) for i in range(-500, 501, 2)], [row(i) for i in range(-20, 20)], [row(i) for i in range(40)] + [(None, *row(0)[1:])]]
    out, sums = _regions(spark, tmp_path, batches, slot=id_range("id", 10))
    files = [f for f in out.inputFiles() if "batch=0" in f]
    assert len({f.rsplit("/", 1)[0] for f in files}) <= 16 and len(files) <= 16
    assert sorted(r["id"] for r in out.where("id is not null").collect()) == sorted(set(range(-500, 501, 2)) | set(range(-20, 40)))
    assert sorted(map(str, regions.merged(sums, "state").collect())) == sorted(map(str, regions.rollup(out, "state").collect()))
    assert read[1] <= 4
