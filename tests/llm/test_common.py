from pyspark.sql import functions as F

from cubeline.llm import common as C


def test_parts_and_ranges_go_by_stored_bytes(spark, tmp_path, monkeypatch):
    df = spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x"))
    df.repartition(40).write.parquet(f"{tmp_path}/t")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "64k")
    try:
        t = spark.read.parquet(f"{tmp_path}/t")
        assert t.rdd.getNumPartitions() == 40 and C.joined_parts(t).rdd.getNumPartitions() == 12
        monkeypatch.setattr(C, "PART_BYTES", 1 << 16)
        assert 15 <= C.joined_parts(t).rdd.getNumPartitions() <= 40 and C.joined_parts(t).count() == 20_000
        monkeypatch.setattr(C, "RANGE_BYTES", 1 << 16)
        assert C.ranges_for(t) == -(-C.stored_bytes(t) // (1 << 16)) > 12
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    local = spark.createDataFrame([(1,)], "a int")  # its size is not known
    assert C.stored_bytes(local) is None and C.joined_parts(local) is local and C.ranges_for(local) == 12


def test_bucket_of_is_a_binary_search(spark):
    import bisect
    import random

    rng = random.Random(1)
    keys = ["".join(rng.choices("abcé日", k=rng.randint(0, 5))) for _ in range(400)]
    for n in (0, 1, 2, 7, 64, 200):
        cuts = sorted(set(rng.sample(keys, n)))
        df = spark.createDataFrame([(k,) for k in keys], "k string")
        got = [r[0] for r in df.select(C._bucket_of(F.col("k"), cuts)).collect()]
        assert got == [bisect.bisect_right(cuts, k) for k in keys], n


def test_stage_and_names(spark):
    df = spark.range(5)
    s = C.stage(df, "x", narrow=True)
    assert sorted(s.collect()) == df.collect()
    C.discard(s)
    assert not C.path_exists(spark, s.staged_at)
    assert C.free_names(spark.createDataFrame([(1, 2)], "A int, _a int"), "a", "b") == ["__a", "b"]
