"""The bucketed store against ingest_batch over all stored rows, and its plan."""

import random

from tickerloom.operators import store, warehouse

SCHEMA = "candidate_id long, normalized_url string, provider long, provider_item_id string, normalized_headline string"


def test_store_equals_ingest_batch(spark):
    rng = random.Random(4)
    store.create_store(spark, "kept", 8)
    known, expected = [], []
    for n in range(2):
        rows = [(1000 * n + i, f"u{rng.randrange(60)}", 1, f"i{rng.randrange(50)}" if rng.random() < 0.6 else None, f"h{rng.randrange(20)}") for i in range(40)]
        batch = spark.createDataFrame(rows, SCHEMA)
        want = {r.candidate_id for r in warehouse.ingest_batch(batch, spark.createDataFrame(known, SCHEMA)).filter("inserted").collect()}
        got = {r.candidate_id for r in store.ingest(spark, "kept", batch).filter("inserted").collect()}
        assert got == want and got
        known += [r for r in rows if r[0] in want]
        expected += sorted(want)
    assert sorted(r.candidate_id for r in spark.table("kept").collect()) == sorted(expected)
    again = store.ingest(spark, "kept", spark.createDataFrame(known, SCHEMA))
    assert again.filter("inserted").isEmpty() and spark.table("kept").count() == len(expected)


def test_stored_rows_are_not_shuffled(spark):
    store.create_store(spark, "plain", 8)
    rows = [(i, f"u{i}", 1, f"i{i}", f"h{i}") for i in range(50)]
    store.ingest(spark, "plain", spark.createDataFrame(rows, SCHEMA))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        free = store.judged(spark, "plain", spark.createDataFrame([(99, "u7", 1, None, "h"), (98, "new", 1, "i9", "h")], SCHEMA))
        plan = free._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    lines = plan.splitlines()
    scans = [k for k, line in enumerate(lines) if "FileScan parquet" in line]
    assert scans
    for k in scans:  # upwards from a stored scan to the first join there is no exchange
        depth = len(lines[k]) - len(lines[k].lstrip(" :+-"))
        above = []
        for line in reversed(lines[:k]):
            d = len(line) - len(line.lstrip(" :+-"))
            if d < depth:
                above.append(line)
                depth = d
            if "Join" in line and d == depth:
                break
        assert not any("Exchange" in line for line in above), above
    assert all("SelectedBucketsCount: 8 out of 8" in lines[k] or "Bucketed: true" in lines[k] for k in scans)
