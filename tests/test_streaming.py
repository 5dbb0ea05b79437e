from echofold.streaming import incremental as S


def test_arriving_duplicates(spark, tmp_path):
    schema = "path string, size_bytes long, sha256 string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        q = S.arriving_duplicates(spark.readStream.schema(schema).json(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.path, r.keeper, r.ordinal) for r in spark.read.parquet(out).collect())

    assert arrive(("/b", 1, "x"), ("/a", 1, "x"), ("/c", 1, "y")) == [("/b", "/a", 2)]
    assert arrive(("/0", 1, "x"), ("/d", 1, "y")) == [("/0", "/a", 3), ("/b", "/a", 2), ("/d", "/c", 2)]


def test_upsert_folds_like_a_batch(spark, tmp_path):
    schema = "entity long, sequence long, state string"
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    for rows in ([(1, 1, "planned"), (2, 2, "planned")], [(1, 3, "moving"), (3, 4, "planned")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        S.upsert(spark.readStream.schema(schema).json(source), table, str(tmp_path / "cp"), ["entity"], "sequence").awaitTermination()
    assert sorted(map(tuple, S.read_table(spark, table).collect())) == [(1, 3, "moving"), (2, 2, "planned"), (3, 4, "planned")]


def test_control(spark):
    c = S.Control(spark, "t")
    assert not c.pause() and not c.resume()
    c.begin("grouping")
    assert c.pause() and c.state == "paused"
    c.begin("quick_hashing")
    assert c.state == "paused" and c.resume() and c.state == "quick_hashing"
    assert c.cancel() and not c.cancel()
    spark.clearTags()
