from strandweave.params import Params
from strandweave.streaming import admission

COLUMNS = "id1 string, id2 string, from1 int, to1 int, from2 int, to2 int, score double"


def test_best_edges_arrive(spark, tmp_path):
    genes = spark.createDataFrame([("a", "a:1", 100), ("b", "b:1", 90)], "species string, gene string, length int")
    put = lambda rows: spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put([("b:1", "a:1", 1, 9, 2, 10, 70.0), ("a:1", "x:1", 1, 9, 1, 9, 99.0), ("a:1", "b:1", 1, 5, 1, 5, 10.0)])
    stream = admission.best_so_far(admission.admitted(admission.watch(spark, f"{tmp_path}/in"), genes, Params(cutoff=60)))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("sw_best").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
        assert [tuple(r) for r in spark.table("sw_best").collect()] == [("a:1", "b:1", 70.0, 2, 10, 1, 9)]
        put([("a:1", "b:1", 3, 12, 4, 13, 80.0)])
        q.processAllAvailable()
        assert [tuple(r) for r in spark.table("sw_best").collect()] == [("a:1", "b:1", 80.0, 3, 12, 4, 13)]
    finally:
        q.stop()
