"""Driver contract smoke checks on sf0.001."""

import __spark_entry__ as E


def test_entry_returns_rows_with_stable_schema(spark):
    a = E.entry(spark)
    b = E.entry(spark)
    assert a.schema == b.schema
    assert a.count() > 0


def test_registry_is_consistent():
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 80
    for name in qs:
        assert name[0] in "spwaujfomx"


def test_cheap_queries_run_small(spark):
    from tests.conftest import SF_SMALL
    for name in ("p06_composite_score", "w17_treated_events_l1", "f01_id_split", "a05_calibration_bins"):
        assert E.queries()[name](spark, SF_SMALL).count() > 0
