import datetime as dt

import __spark_entry__ as E


def events(spark, path):
    start = dt.datetime(2024, 1, 1)
    kinds = ["view", "click", "purchase", "error", "signup"]
    rows = [(u * 100 + d, start + dt.timedelta(days=d, minutes=u), u, kinds[(u + d) % 5], float((u * 7 + d * 13) % 100), '{"k": 3}') for u in range(20) for d in range(8)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")


def test_tree_rows_are_written_once_for_all_passes(spark, tmp_path):
    events(spark, tmp_path)
    a, feats = E._tree_data(spark, str(tmp_path))
    files = a.unpersist().select("*").inputFiles()
    assert files and all("model-rows" in f for f in files)
    assert a.columns == ["id", "day", "split", "y", "base_t", "y_abs", *feats, "features"]
    assert a.count() > 0 and a.where("y_abs - base_t <> y").count() == 0


def test_neighbour_rows_are_written_once_for_all_passes(spark, tmp_path):
    events(spark, tmp_path)
    for side in E._knn_rows(spark, str(tmp_path)):
        files = side.inputFiles()
        assert files and all("knn-data" in f for f in files) and side.count() > 0
