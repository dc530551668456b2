"""The streamed deduplication as a registered query: one file or several, in a folder whose name needs escapes."""

import datetime as dt

import pytest

from tickerloom.plans import queries as plans

AT = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("files", [1, 3])
@pytest.mark.parametrize("rows", [[], [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "a"), (2, None), (2, "")]])
def test_stream_event_dedupe_of_files(spark, tmp_path, files, rows):
    folder = tmp_path / "with a blank, 100%25"
    df = spark.createDataFrame([(i, u, t, AT) for i, (u, t) in enumerate(rows)], "event_id long, user_id long, event_type string, ts timestamp")
    df.repartition(files).write.parquet(f"file://{folder}/events.parquet")
    got = plans.queries()["stream_event_dedupe"](spark, str(folder)).collect()
    assert sorted(map(repr, ((r.user_id, r.event_type) for r in got))) == sorted(map(repr, set(rows)))
