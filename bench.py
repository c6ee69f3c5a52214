"""Headline timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints ONE JSON line.

Each query is forced end to end with the ``noop`` writer (no collect to the
driver).  The inputs are re-read from parquet for every query, so timings include
scans and every shuffle of the plan.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from cohortflow.config import EventConfig  # noqa: E402
from cohortflow.functions.scalar import treatment_flag  # noqa: E402
from cohortflow.operators import events as evo  # noqa: E402
from cohortflow.operators import linear as lin  # noqa: E402
from cohortflow.operators import metrics as mt  # noqa: E402
from cohortflow.operators import resample as rs  # noqa: E402
from cohortflow.operators import trees as tr  # noqa: E402
from cohortflow.plans.features import feature_columns  # noqa: E402
from cohortflow.plans.forecast import SweepConfig, horizon_sweep  # noqa: E402
from cohortflow.plans.prepare import events_features, events_panel  # noqa: E402
from cohortflow.session import get_session  # noqa: E402


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", app="cohortflow-bench", shuffle_partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    # JVM start and first-query compilation, reported apart from the query timings
    t0 = time.time()
    spark.range(1000).selectExpr("sum(id)").collect()
    warmup = round(time.time() - t0, 3)
    times = {}

    def timed(name, fn):
        t0 = time.time()
        fn()
        times[name] = round(time.time() - t0, 3)

    timed("panel_score", lambda: run(events_panel(spark, sf_dir)))
    timed("feature_block_h14", lambda: run(events_features(spark, sf_dir, horizons=14)))

    def ev_panel():
        p = events_panel(spark, sf_dir)
        return p.select("id", "day", treatment_flag("treatment").alias("is_treated"), "treatment_type", "U_t")

    timed("event_study_l3", lambda: run(evo.event_table(ev_panel(), EventConfig(L=3, H=3))))
    timed("split_folds", lambda: run(rs.split_ids(events_panel(spark, sf_dir)).join(rs.grouped_folds(events_panel(spark, sf_dir)), "id")))

    def pred():
        f = events_features(spark, sf_dir, horizons=1)
        return f.select("id", "day", F.col("U_next_h1").alias("y"), F.col("U_t_roll7_mean").alias("p")).dropna()

    timed("bootstrap_ci_b200", lambda: mt.bootstrap_metric_ci(pred(), "id", "y", "p", 200).collect())
    timed("calibration_bins", lambda: mt.calibration_bins(pred(), "p", "y").collect())

    def cv(kind):
        f = events_features(spark, sf_dir, horizons=1)
        feats = feature_columns(f, "dU_next_h1")
        d = f.join(rs.grouped_folds(f, 5), "id").where(F.col("dU_next_h1").isNotNull())
        table, _ = lin.cv_linear(d, feats, "dU_next_h1", "fold", kind)
        mt.cv_summary(table, ("param_id",)).collect()

    timed("cv_grid_ridge_9x5", lambda: cv("ridge"))
    timed("cv_grid_lasso_9x5", lambda: cv("lasso"))
    timed("cv_grid_elasticnet_63x5", lambda: cv("elasticnet"))

    def sweep():
        s, p, _ = horizon_sweep(events_features(spark, sf_dir, horizons=7), SweepConfig(model="ridge", horizons=7))
        s.collect()

    timed("horizon_sweep_ridge_h7", sweep)

    def trees(fit):
        f = events_features(spark, sf_dir, horizons=1)
        feats = feature_columns(f, "dU_next_h1")
        d = f.join(rs.split_ids(f, "id", 0.15, None), "id").where((F.col("split") == "train") & F.col("dU_next_h1").isNotNull())
        a = tr.assemble(d, feats, lin.medians(d, feats), [F.col("dU_next_h1").alias("y")]).persist()
        fit(a)
        a.unpersist()

    timed("forest_fit_300x10", lambda: trees(lambda a: tr.fit_forest(a, "y", 300, 10, 4)))
    timed("boosting_fit_300x3", lambda: trees(lambda a: tr.fit_boosting(a, "y", 300, 3, 0.03)))
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf,
                      "warmup_sec": warmup}))


if __name__ == "__main__":
    main()
