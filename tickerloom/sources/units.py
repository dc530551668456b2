"""Quarter-hour files as a Spark data source, in batches and as a stream that waits for missing ones.

A unit is a file named by its time (yyyyMMddHHmmss) and a suffix; zipped ones hold their lines in the first entry. Register with
``spark.dataSource.register(UnitSource)``; then ``spark.read.format("units")`` or ``spark.readStream.format("units")``.
"""

from __future__ import annotations

import datetime as dt
import io
import zipfile
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

STEP = dt.timedelta(minutes=15)
STAMP = "%Y%m%d%H%M%S"
#: Units that a missing one is looked for, counted from the newest.
LOOK_BACK = 12
#: Lines of one Arrow batch.
LINES = 20_000


def later(stamp: str, steps: int) -> str:
    return (dt.datetime.strptime(stamp, STAMP) + steps * STEP).strftime(STAMP)


class Folder:
    """The units of a folder: local, or any address that Arrow's file systems know."""

    def __init__(self, options: dict):
        self.path, self.suffix = options["path"].rstrip("/"), options.get("suffix", ".gkg.csv.zip")
        self.first, self.last = options.get("from", ""), options.get("until", "9")

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def stamps(self) -> list[str]:
        """Times of the units that are there, within the range asked for; oldest first. Other files are passed over."""
        from pyarrow import fs

        system, base = self._system()
        found = []
        for info in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            stamp = info.base_name.removesuffix(self.suffix)
            if info.type == fs.FileType.File and info.base_name != stamp and len(stamp) == 14 and stamp.isdigit() and self.first <= stamp <= self.last:
                found.append(stamp)
        return sorted(found)

    def lines(self, stamp: str) -> Iterator[str]:
        """A unit's lines without their ends; none if the file has gone."""
        system, base = self._system()
        try:
            with system.open_input_stream(f"{base}/{stamp}{self.suffix}", compression=None) as f:
                raw = f.read()
        except FileNotFoundError:
            return
        if self.suffix.endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                names = z.namelist()
                raw = z.read(names[0]) if names else b""
        for line in raw.decode("utf-8", "replace").split("\n"):
            if line := line.removesuffix("\r"):
                yield line


class Unit(InputPartition):
    def __init__(self, stamp: str):
        super().__init__(stamp)
        self.stamp = stamp


def _batches(folder: Folder, stamp: str):
    import pyarrow as pa

    held: list[str] = []
    at = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([stamp] * len(held)), pa.array(range(at, at + len(held)), pa.int32()), pa.array(held)], ["unit", "line", "value"])

    for line in folder.lines(stamp):
        held.append(line)
        if len(held) == LINES:
            yield batch()
            at += len(held)
            held = []
    if held:
        yield batch()


class UnitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = Folder(options)

    def partitions(self) -> list[Unit]:
        return [Unit(s) for s in self.folder.stamps()]

    def read(self, partition: Unit):
        return _batches(self.folder, partition.stamp) if partition is not None else iter(())


class PrunedUnitReader(UnitReader):
    def pushFilters(self, filters: list) -> Iterator:
        """Comparisons of the unit with a time choose files; Spark still checks those given back."""
        for f in filters:
            mine = getattr(f, "attribute", None) == ("unit",) and isinstance(getattr(f, "value", None), str)
            if mine and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.folder.first = max(self.folder.first, f.value + ("0" if isinstance(f, GreaterThan) else ""))
            if mine and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.folder.last = min(self.folder.last, f.value)
            if not (mine and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThanOrEqual))):
                yield f


class UnitStreamReader(DataSourceStreamReader):
    """Offsets hold the newest unit seen and which of the LOOK_BACK units up to it are missing. A batch reads what is new and what was
    missing and has come since; both follow from its two offsets, so a restart reads every unit once."""

    def __init__(self, options: dict):
        self.folder = Folder(options)
        self.look_back = int(options.get("lookback", LOOK_BACK))

    def initialOffset(self) -> dict:
        return {"latest": "", "missing": []}

    def latestOffset(self) -> dict:
        there = self.folder.stamps()
        if not there:
            return self.initialOffset()
        latest, known = there[-1], set(there)
        wanted = [later(latest, -k) for k in range(self.look_back - 1, 0, -1)]
        return {"latest": latest, "missing": [s for s in wanted if there[0] < s and s not in known]}

    def partitions(self, start: dict, end: dict) -> list[Unit]:
        if not end["latest"]:
            return []
        oldest = later(end["latest"], 1 - self.look_back)
        come = [s for s in start["missing"] if s >= oldest and s not in end["missing"]]
        new = [s for s in self.folder.stamps() if start["latest"] < s <= end["latest"] and s not in end["missing"]]
        return [Unit(s) for s in sorted({*come, *new})]

    def read(self, partition: Unit):
        return _batches(self.folder, partition.stamp)


class UnitSource(DataSource):
    """Options: path, suffix, from and until (times, both included), lookback; pushdown: whether filters on the unit choose files, for sessions
    with ``spark.sql.python.filterPushdown.enabled`` (others refuse a reader that could)."""

    @classmethod
    def name(cls) -> str:
        return "units"

    def schema(self) -> str:
        return "unit string, line int, value string"

    def reader(self, schema) -> UnitReader:
        return (PrunedUnitReader if self.options.get("pushdown", "false") == "true" else UnitReader)(self.options)

    def streamReader(self, schema) -> UnitStreamReader:
        return UnitStreamReader(self.options)
