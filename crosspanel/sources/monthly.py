"""A panel in a folder by month, as a data source of its own: `spark.read.format("crosspanel").load(path)`.

Rows lie in `month=YYYY-MM` folders of Parquet files, which is the partitioning that most work on panels asks for. Bounds
on `date` in a query are pushed down to the months: other folders are neither listed for tasks nor opened. Each file is
one task's input. Writing deals each task's rows into files by month under names that no reader looks for; only the
commit gives them their names, so a task that is repeated or a job that fails leaves nothing behind that is read.

Rows without a date are in `month=none`, and are read unless a bound on the date leaves them out. The source opens
files from Python: paths that pyarrow's file systems know (local, HDFS, S3). For stores that only Spark's own readers
open there is `ParquetAdapter`.

Pushing filters into Python sources must be on (`register` does that); without it months are not skipped, and results
are the same.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from crosspanel.operators.contracts import fail

NAME = "crosspanel"
NO_DATE = "none"
#: Files under such a name are under way.
HIDDEN = "_"


def register(spark: SparkSession) -> None:
    """Make the source known to a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PanelSource)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def month_files(path: str) -> dict[str, list[str]]:
    """The files of each month, by its name."""
    fs, root = _open(path.rstrip("/"))
    found: dict[str, list[str]] = {}
    for info in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
        folder, _, name = info.path.rpartition("/")
        month = folder.rpartition("/")[2]
        if info.is_file and name.endswith(".parquet") and not name.startswith(HIDDEN) and month.startswith("month="):
            found.setdefault(month.removeprefix("month="), []).append(info.path)
    return {m: sorted(files) for m, files in sorted(found.items())}


class PanelSource(DataSource):
    """The folder of one panel."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _path(self) -> str:
        path = self.options.get("path")
        return path or fail("source", "no_path", "a folder is needed: load(path) or save(path)")

    def schema(self) -> StructType:
        files = [f for own in month_files(self._path()).values() for f in own]
        if not files:
            fail("source", "no_panel", f"no month folders in {self._path()}")
        fs, _ = _open(self._path())
        with fs.open_input_file(files[-1]) as file:
            return from_arrow_schema(pq.read_schema(file))

    def reader(self, schema: StructType) -> PanelReader:
        return PanelReader(self._path(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> PanelWriter:
        if "date" not in schema.names:
            fail("source", "missing_column", "a panel needs a `date`")
        return PanelWriter(self._path(), schema, overwrite)


@dataclass
class PanelFile(InputPartition):
    """One file of a month."""

    month: str
    file: str

    def __init__(self, month: str, file: str) -> None:
        super().__init__((month, file))
        self.month, self.file = month, file


class PanelReader(DataSourceReader):
    """Reads the months that a query's bounds on the date leave."""

    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema = path, schema
        self.low: dt.date | None = None
        self.high: dt.date | None = None
        self.dated = False

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take bounds on `date` for the months; Spark still applies every filter to the rows."""
        for f in filters:
            if getattr(f, "attribute", None) == ("date",):
                value = getattr(f, "value", None)
                if isinstance(f, IsNotNull) or isinstance(value, dt.date):
                    self.dated = True
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) and isinstance(value, dt.date):
                    self.low = value if self.low is None else max(self.low, value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) and isinstance(value, dt.date):
                    self.high = value if self.high is None else min(self.high, value)
            yield f

    def months(self, names: list[str]) -> list[str]:
        """Those that may hold rows within the bounds."""
        low, high = (None if d is None else f"{d:%Y-%m}" for d in (self.low, self.high))
        return [m for m in names if (not self.dated if m == NO_DATE else (low is None or m >= low) and (high is None or m <= high))]

    def partitions(self) -> list[InputPartition]:
        files = month_files(self.path)
        return [PanelFile(m, f) for m in self.months(list(files)) for f in files[m]]

    def read(self, partition: PanelFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no month is left
            return
        fs, _ = _open(self.path)
        wanted = to_arrow_schema(self.schema)
        with fs.open_input_file(partition.file) as file:
            for batch in pq.ParquetFile(file).iter_batches(columns=self.schema.names):
                table = pa.Table.from_batches([batch]).select(self.schema.names).cast(wanted)
                yield from table.to_batches()


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: (name while under way, name when done)."""

    files: list[tuple[str, str]]


class PanelWriter(DataSourceArrowWriter):
    """Appends files by month, or puts them in place of all that was there."""

    def __init__(self, path: str, schema: StructType, overwrite: bool) -> None:
        self.path, self.schema, self.overwrite = path, schema, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _open(self.path.rstrip("/"))
        writers: dict[str, tuple] = {}
        for batch in iterator:
            table = pa.Table.from_batches([batch])
            month = pc.fill_null(pc.strftime(table["date"], "%Y-%m"), NO_DATE)
            for name in pc.unique(month).to_pylist():
                own = table.filter(pc.equal(month, name))
                if name not in writers:
                    folder, file = f"{root}/month={name}", f"{uuid.uuid4().hex}.parquet"
                    fs.create_dir(folder, recursive=True)
                    out = fs.open_output_stream(f"{folder}/{HIDDEN}{file}")
                    writers[name] = (pq.ParquetWriter(out, own.schema), out, f"{folder}/{HIDDEN}{file}", f"{folder}/{file}")
                writers[name][0].write_table(own)
        for writer, out, _, _ in writers.values():
            writer.close()
            out.close()
        return Written([(hidden, final) for _, _, hidden, final in writers.values()])

    def commit(self, messages: list[Written | None]) -> None:
        """All tasks are done: name their files, then take away what they replace."""
        fs, _ = _open(self.path)
        before = [f for own in month_files(self.path).values() for f in own] if self.overwrite else []
        for message in messages:
            for hidden, final in message.files if message else []:
                fs.move(hidden, final)
        for file in before:
            fs.delete_file(file)

    def abort(self, messages: list[Written | None]) -> None:
        """Some task failed: take away what the others wrote."""
        fs, _ = _open(self.path)
        for message in messages:
            for hidden, _ in message.files if message else []:
                if fs.get_file_info(hidden).is_file:
                    fs.delete_file(hidden)
