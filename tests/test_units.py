"""Units as a data source: ranges, zips, and a stream with a hole that is filled later."""

import zipfile

from pyspark.sql import functions as F

from tickerloom.sources import gkg
from tickerloom.sources.units import UnitSource, UnitStreamReader, later
from tickerloom.streaming import ingest


def put(folder, stamp, *lines):
    with zipfile.ZipFile(folder / f"{stamp}.gkg.csv.zip", "w") as z:
        z.writestr("first.csv", "\n".join(lines) + "\r\n")
        z.writestr("second.csv", "not read")


def test_units_in_a_range(spark, tmp_path):
    spark.dataSource.register(UnitSource)
    for k in range(6):
        put(tmp_path, later("20240101000000", k), f"a{k}", "", f"b{k}")
    (tmp_path / "notes.txt").write_text("x")
    (tmp_path / "20240101.gkg.csv.zip").write_text("no time")
    all_units = spark.read.format("units").load(str(tmp_path))
    assert {(r.unit, r.line, r.value) for r in all_units.collect()} == {(later("20240101000000", k), n, f"{c}{k}") for k in range(6) for n, c in enumerate("ab")}
    some = spark.read.format("units").option("from", "20240101001500").option("until", "20240101004500").load("file://" + str(tmp_path))
    assert some.select("unit").distinct().count() == 3 and some.rdd.getNumPartitions() == 3
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        cut = spark.read.format("units").option("pushdown", "true").load(str(tmp_path)).filter((F.col("unit") > "20240101001500") & (F.col("unit") < "20240101010000") & (F.length("value") == 2))
        assert sorted(r.value for r in cut.collect()) == ["a2", "a3", "b2", "b3"]
        assert cut.rdd.getNumPartitions() <= 3
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert gkg.parse_lines(all_units.select("value")).count() == 0
    empty = tmp_path / "none"
    empty.mkdir()
    assert spark.read.format("units").load(str(empty)).count() == 0


def test_a_hole_is_filled_later_and_nothing_comes_twice(spark, tmp_path):
    spark.dataSource.register(UnitSource)
    src, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()
    unit = lambda k: later("20240101000000", k)

    def run():
        stream = spark.readStream.format("units").load(str(src))
        ingest.write_batches(stream, out, checkpoint).awaitTermination()
        return sorted(r.value for r in spark.read.parquet(out).collect())

    for k in (0, 1, 3):
        put(src, unit(k), f"u{k}")
    assert run() == ["u0", "u1", "u3"]
    assert run() == ["u0", "u1", "u3"]  # a restart reads nothing again
    put(src, unit(2), "u2")  # late
    put(src, unit(5), "u5")
    assert run() == ["u0", "u1", "u2", "u3", "u5"]
    put(src, unit(4), "u4")
    assert run() == [f"u{k}" for k in range(6)]
    put(src, unit(30), "u30")
    put(src, unit(7), "u7")  # older than the units looked back over, but after the newest one read
    assert run() == sorted([*(f"u{k}" for k in range(6)), "u30", "u7"])
    put(src, unit(8), "u8")  # given up
    assert "u8" not in run()


def test_offsets_decide_what_a_batch_reads(tmp_path):
    reader = UnitStreamReader({"path": str(tmp_path)})
    assert reader.latestOffset() == reader.initialOffset() and reader.partitions(reader.initialOffset(), reader.initialOffset()) == []
    for k in (0, 3):
        put(tmp_path, later("20240101000000", k), "x")
    end = reader.latestOffset()
    assert end == {"latest": later("20240101000000", 3), "missing": [later("20240101000000", k) for k in (1, 2)]}
    put(tmp_path, later("20240101000000", 2), "x")
    assert [p.stamp for p in reader.partitions(reader.initialOffset(), end)] == [later("20240101000000", k) for k in (0, 3)]
    assert [p.stamp for p in reader.partitions(end, reader.latestOffset())] == [later("20240101000000", 2)]
