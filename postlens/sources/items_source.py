"""``items``: a pull source over stored raw pages (Python Data Source API).

    items_source.register(spark)
    spark.read.format("items").option("path", ".../pages.parquet").option("keyword", "bitcoin").load()
    spark.readStream.format("items").option("path", ...).option("log", ...).load()

The driver lists the files and opens none of them.  A file is read in ``splitsPerFile``
partitions (its row groups in turn), a small Arrow batch at a time inside the tasks; the keyword
(case-insensitive substring of the page) and the filters of the query (a range of ids passes over
whole row groups by their statistics) are applied while reading.

A stream takes files in order of arrival.  With the option ``log`` (a shared folder, one for each
query) it writes down the names of the files that it finds, at most ``maxFilesPerTrigger`` at a time,
and an offset is the number of entries in that log: every file is read once, whatever its name
and time, and a restarted query reads the same files again.  An ``availableNow`` run takes one entry.
Without a log an offset is the latest modification time delivered and the names of the files of that time:
a file that appears later with an earlier time (moved there, or by a clock that is behind) is not seen.
"""

from __future__ import annotations

import json
import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import datasource as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

SCHEMA = "page_id long, url string, html string"
COLUMNS = ["page_id", "url", "html"]
BATCH_ROWS = 500


def _file_system(path: str):
    """The file system of a path or URI, and the path there."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _listing(path: str) -> list[tuple[int, str]]:
    """Modification times (ns) and names of the Parquet files of a file or folder, the oldest first."""
    from pyarrow import fs

    system, at = _file_system(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at))
    return sorted((f.mtime_ns or 0, f.path) for f in found if f.type == fs.FileType.File and f.path.endswith(".parquet"))


class Piece(InputPartition):
    """Every ``n``-th row group of a file, from the ``k``-th on."""

    def __init__(self, file: str, k: int, n: int):
        super().__init__((file, k, n))
        self.file, self.k, self.n = file, k, n


def _condition(f: ds.Filter):
    """A filter of the query as an Arrow expression; None if it has none (Spark tests every filter again)."""
    import pyarrow.compute as pc

    if isinstance(f, ds.Not):
        inner = None if isinstance(f.child, (ds.In, ds.EqualNullSafe)) else _condition(f.child)
        return None if inner is None else ~inner
    if len(f.attribute) != 1 or f.attribute[0] not in COLUMNS:
        return None
    c = pc.field(f.attribute[0])
    if isinstance(f, ds.IsNull):
        return c.is_null()
    if isinstance(f, ds.IsNotNull):
        return c.is_valid()
    if isinstance(f, ds.In):
        return c.isin(list(f.value))
    if isinstance(f, ds.StringContains):
        return pc.match_substring(c, f.value)
    if isinstance(f, ds.StringStartsWith):
        return pc.starts_with(c, f.value)
    made = {ds.EqualTo: c.__eq__, ds.GreaterThan: c.__gt__, ds.GreaterThanOrEqual: c.__ge__,
            ds.LessThan: c.__lt__, ds.LessThanOrEqual: c.__le__}.get(type(f))
    return made(f.value) if made else None


class _Pages:
    """What the batch and the stream reader share."""

    filters: tuple = ()

    def __init__(self, options):
        self.path = options["path"]
        self.keyword = (options.get("keyword") or "").lower()
        self.splits = int(options.get("splitsPerFile", "1"))

    def pieces(self, files: list[str]) -> list[Piece]:
        return [Piece(f, k, self.splits) for f in files for k in range(self.splits)]

    def read(self, partition: Piece | None):
        if partition is None:  # a folder without files
            return
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.dataset as pads

        system, _ = _file_system(self.path)
        file = next(pads.dataset(partition.file, filesystem=system, format="parquet").get_fragments())
        groups = list(range(partition.k, file.num_row_groups, partition.n))
        if not groups:
            return
        keep = [c for c in map(_condition, self.filters) if c is not None]
        if self.keyword:
            keep.append(pc.match_substring(pc.utf8_lower(pc.field("html")), self.keyword))
        both = None
        for c in keep:
            both = c if both is None else both & c
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])
        rows = file.subset(row_group_ids=groups).scanner(columns=COLUMNS, filter=both, batch_size=BATCH_ROWS,
                                                         batch_readahead=1, use_threads=False)
        for batch in rows.to_batches():
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in schema], schema=schema)


class ItemsReader(_Pages, DataSourceReader):
    def pushFilters(self, filters):
        self.filters = tuple(filters)
        return filters  # Spark tests them again: reading may leave rows in, never out

    def partitions(self):
        return self.pieces([name for _, name in _listing(self.path)])


class ArrivalLog:
    """Entries ``0, 1, ...`` of file names in a folder, each written once."""

    def __init__(self, folder: str):
        self.system, self.folder = _file_system(folder)
        self.system.create_dir(self.folder, recursive=True)
        self.entries: list[list[str]] = []
        self.names: set[str] = set()

    def _file(self, n: int) -> str:
        return f"{self.folder}/{n:012d}.json"

    def load(self) -> int:
        """Read the entries not read yet; the number of all."""
        from pyarrow import fs

        while self.system.get_file_info(self._file(len(self.entries))).type == fs.FileType.File:
            with self.system.open_input_stream(self._file(len(self.entries))) as f:
                self.entries.append(json.loads(f.read()))
            self.names.update(self.entries[-1])
        return len(self.entries)

    def append(self, names: list[str]) -> None:
        part = f"{self.folder}/.{uuid.uuid4().hex}"
        with self.system.open_output_stream(part) as f:
            f.write(json.dumps(names).encode())
        self.system.move(part, self._file(len(self.entries)))  # whole or not at all


class ItemsStreamReader(_Pages, DataSourceStreamReader):
    def __init__(self, options):
        super().__init__(options)
        self.log = ArrivalLog(options["log"]) if options.get("log") else None
        self.most = int(options.get("maxFilesPerTrigger", "0")) or None
        if self.most and not self.log:
            raise ValueError("maxFilesPerTrigger needs the option log: without it a restarted stream does not know what it has read")
        self.planned = None

    def initialOffset(self):
        return {"entry": 0} if self.log else {"mtime": -1, "names": []}

    def latestOffset(self):
        files = _listing(self.path)
        if self.log is None:
            if not files:
                return self.initialOffset()
            last = files[-1][0]
            return {"mtime": last, "names": [name for t, name in files if t == last]}
        n = self.log.load()
        if self.planned is None or self.planned >= n:  # else the last entry still waits for a micro-batch
            new = [name for _, name in files if name not in self.log.names]
            if new:
                self.log.append(new[:self.most])
        return {"entry": self.log.load()}

    def partitions(self, start, end):
        if self.log is not None:
            self.log.load()
            self.planned = end["entry"]
            return self.pieces([name for e in self.log.entries[start["entry"]:end["entry"]] for name in e])

        def upto(offset, t, name):
            return t < offset["mtime"] or t == offset["mtime"] and name in offset["names"]
        return self.pieces([name for t, name in _listing(self.path) if upto(end, t, name) and not upto(start, t, name)])

    def commit(self, end):
        pass


class ItemsDataSource(DataSource):
    @classmethod
    def name(cls):
        return "items"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ItemsReader(self.options)

    def streamReader(self, schema):
        return ItemsStreamReader(self.options)


def register(spark) -> None:
    """Make the format known to the session, and let the session hand filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ItemsDataSource)
