from lodeseek.streaming.incremental import follow


def test_only_new_content_is_appended(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "table", "checkpoint"))
    for rows in ([(1, "a  b"), (2, "c")], [(3, "a b"), (4, "d")]):
        spark.createDataFrame(rows, "doc_id long, text string").write.mode("append").parquet(source)
        follow(spark, source, table, checkpoint).awaitTermination(60)
    assert sorted(r.doc_id for r in spark.read.parquet(table).collect()) == [1, 2, 4]
