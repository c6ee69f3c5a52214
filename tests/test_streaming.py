"""The micro-batch refresh produces the same feature rows as the batch plan."""

import tempfile

from cohortflow.plans.prepare import events_features
from cohortflow.streaming.daily import latest, refresh_batch, start
from tests.conftest import SF_SMALL


def test_available_now_refresh_matches_batch(spark):
    import os
    src = tempfile.mkdtemp(prefix="cf-stream-in-")      # the stream source watches a folder
    os.symlink(f"{SF_SMALL}/events.parquet", os.path.join(src, "part-0.parquet"))
    out = tempfile.mkdtemp(prefix="cf-stream-out-")
    ck = tempfile.mkdtemp(prefix="cf-stream-ck-")
    q = start(spark, src, out + "/features", ck, horizons=2)
    q.awaitTermination(300)
    got = spark.read.parquet(out + "/features").drop("epoch")
    exp = events_features(spark, SF_SMALL, 2)
    assert got.count() == exp.count()
    assert got.select("id", "day", "U_t_lag1").exceptAll(exp.select("id", "day", "U_t_lag1")).count() == 0


def test_a_batch_run_again_and_a_later_epoch_leave_one_set_of_rows_per_id(spark):
    out = tempfile.mkdtemp(prefix="cf-stream-out-") + "/features"
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    run = refresh_batch(spark, f"{SF_SMALL}/events.parquet", out, horizons=1)
    ids = [r[0] for r in events.select("user_id").distinct().orderBy("user_id").limit(3).collect()]
    first, second = events.where(events.user_id.isin(ids)), events.where(events.user_id == ids[0])
    run(first, 0)
    once = spark.read.parquet(out).count()
    run(first, 0)                                           # a retry after a lost driver
    assert spark.read.parquet(out).count() == once
    run(second, 1)
    assert spark.read.parquet(out).count() > once
    now = latest(spark, out)
    assert now.count() == once and now.select("id", "day").distinct().count() == once
    assert {(r["id"], r["epoch"]) for r in now.select("id", "epoch").distinct().collect()} == {(ids[0], 1), (ids[1], 0), (ids[2], 0)}
