"""Bundles: ZIP files of snapshot members ``<folder>/<YYYYMMDD-HHMM>-<file>``, read by slices of members, at once or as a stream,
and written day by day in two phases.

Paths may be mounted folders or addresses of any store that pyarrow opens (file, hdfs, s3, gs); all executors must reach them.
"""

from __future__ import annotations

import io
import posixpath
import re
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, InputPartition, WriterCommitMessage

MEMBERS = "bundle string, position int, name string, day string, checksum bigint, content binary"


_FIELDS = pa.schema([("bundle", pa.string()), ("position", pa.int32()), ("name", pa.string()), ("day", pa.string()), ("checksum", pa.int64()), ("content", pa.binary())])
_BATCH, _DEFAULT_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInArrow over batches of about ``BATCH_BYTES`` or one row, unless the session has a bound of its own: documents and bundles are
    large, and JVM and worker hold a batch several times over. What Arrow has freed goes back to the system after each batch."""

    def releasing(batches):
        for out in run(batches):
            yield out
            pa.default_memory_pool().release_unused()
        pa.default_memory_pool().release_unused()

    if df.sparkSession.conf.get(_BATCH) == _DEFAULT_BATCH:
        df.sparkSession.conf.set(_BATCH, BATCH_BYTES)
    return df.mapInArrow(releasing, schema)


def _day(name: str) -> str:
    return name.rsplit("/", 1)[-1][:8]


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path or address, and the path within it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _files(fs: pafs.FileSystem, path: str) -> list[str]:
    """The file itself, or the visible files right below a folder; none where there is nothing."""
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.File:
        return [path]
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted(f.path for f in found if f.type == pafs.FileType.File and not posixpath.basename(f.path).startswith((".", "_")))


class _Slice(InputPartition):
    def __init__(self, root: str, path: str, members: list[tuple[int, str]]):
        self.root, self.path, self.members = root, path, members


def _read(partition: _Slice) -> Iterator[tuple]:
    if partition.members:
        with _opened(partition.root)[0].open_input_file(partition.path) as file, zipfile.ZipFile(file) as bundle:
            listed = bundle.infolist()
            for position, name in partition.members:
                content = bundle.read(listed[position])
                yield posixpath.basename(partition.path), position, name, _day(name), zlib.crc32(content), content


class _Listing:
    """Members of the ZIP files at the paths, in slices of about ``sliceBytes``."""

    def __init__(self, options):
        self.paths = [p for p in options["path"].split(",") if p]
        self.suffix, self.bytes = options.get("suffix", ""), int(options.get("sliceBytes", 32 << 20))

    def bundles(self) -> Iterator[tuple[str, str, list[zipfile.ZipInfo]]]:
        """Each ZIP file and the directory at its end, which is all that is read of it."""
        for root in self.paths:
            fs, path = _opened(root)
            for file in _files(fs, path):
                with fs.open_input_file(file) as held, zipfile.ZipFile(held) as bundle:
                    yield root, file, bundle.infolist()

    def slices(self, root: str, file: str, members: list[tuple[int, zipfile.ZipInfo]]) -> list[_Slice]:
        out, held, size = [], [], 0
        for position, info in members:
            held.append((position, info.filename))
            size += info.file_size
            if size >= self.bytes:
                out.append(_Slice(root, file, held))
                held, size = [], 0
        return [*out, _Slice(root, file, held)] if held else out


class _Reader(_Listing, DataSourceReader):
    days: set | None = None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("day",):
                self.days = {f.value} if self.days is None else self.days & {f.value}
            else:
                yield f

    def partitions(self):
        wanted = lambda info: not info.is_dir() and info.filename.endswith(self.suffix) and (self.days is None or _day(info.filename) in self.days)
        out = [s for root, file, listed in self.bundles() for s in self.slices(root, file, [(k, i) for k, i in enumerate(listed) if wanted(i)])]
        return out or [_Slice("", "", [])]

    def read(self, partition):
        """A batch a member; rows would be gathered by the thousand."""
        for row in _read(partition):
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _FIELDS)], schema=_FIELDS)
            pa.default_memory_pool().release_unused()


class _StreamReader(_Listing, DataSourceStreamReader):
    """What has been read is told by the number of members of each bundle: bundles only grow at their end, and a member that
    arrives in an older bundle, or with an older archive time, is still new. A restart from the checkpoint reads each member once.

    Members of a batch are dealt in order of archive time.
    """

    def initialOffset(self):
        return {}

    def latestOffset(self):
        return {file: len(listed) for _, file, listed in self.bundles()}

    def partitions(self, start, end):
        out = []
        for root, file, listed in self.bundles():
            new = [(k, listed[k]) for k in range(start.get(file, 0), min(end.get(file, 0), len(listed)))]
            new = [(k, i) for k, i in new if not i.is_dir() and i.filename.endswith(self.suffix)]
            out += self.slices(root, file, sorted(new, key=lambda x: posixpath.basename(x[1].filename)))
        return out or [_Slice("", "", [])]

    def read(self, partition):
        return _read(partition)


class BundleSource(DataSource):
    """``spark.read.format("bundles").load(path)``, or ``readStream``: members of the ZIP files at a path that driver and executors
    share.

    Options: suffix (of member names), sliceBytes (uncompressed bytes of a partition). Equality on ``day`` is pushed down to
    the listing, so other days' members aren't read; this needs spark.sql.python.filterPushdown.enabled.
    """

    @classmethod
    def name(cls):
        return "bundles"

    def schema(self):
        return MEMBERS

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)


def read_bundles(spark: SparkSession, path: str, suffix: str = "", slice_bytes: int = 32 << 20) -> DataFrame:
    """The members of the ZIP files at a path. Turns pushdown into Python data sources on for the session, as the source needs it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BundleSource)
    return spark.read.format("bundles").option("suffix", suffix).option("sliceBytes", str(slice_bytes)).load(path)


def stream_bundles(spark: SparkSession, path: str, suffix: str = "", slice_bytes: int = 32 << 20) -> DataFrame:
    """The same as a stream: each trigger reads the members that have come since the last."""
    spark.dataSource.register(BundleSource)
    return spark.readStream.format("bundles").option("suffix", suffix).option("sliceBytes", str(slice_bytes)).load(path)


def write_bundles(files: DataFrame, folder: str, bundle: str = "bundle", content: str = "content") -> str:
    """Writes rows of bundle name and bytes as files ``<folder>/<name>.zip``; returns the folder.

    The folder must be one that all executors reach. A file appears under its name only when whole, so a task that is run again
    writes the same one. Rows with a null name or no bytes are left out.
    """
    try:
        fs, path = _opened(folder)
        fs.create_dir(path, recursive=True)
    except OSError as error:
        raise ValueError(f"{folder} can't be opened as a folder") from error

    def run(batches: Iterator[pa.RecordBatch]):
        fs, path = _opened(folder)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_output_stream(part := f"{path}/.{name}-{uuid.uuid4().hex}") as out:
                    out.write(data)
                fs.move(part, f"{path}/{name}.zip")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    some = files.select(F.col(bundle), F.col(content)).where(F.col(bundle).isNotNull() & F.col(content).isNotNull())
    map_arrow(some, run, "n bigint").agg(F.sum("n")).first()
    return folder


def _day_of(file: str) -> str | None:
    """The day of a file that a day writer has written."""
    found = re.fullmatch(r"(.*)-[0-9a-f]{12}\.zip", posixpath.basename(file))
    return found and found[1]


@dataclass
class _Written(WriterCommitMessage):
    """What one task has written: (day, temporary file, final name)."""

    files: list[tuple[str, str, str]]


class _DayWriter(DataSourceArrowWriter):
    """ZIP files of days, first under an attempt's hidden folder. The driver moves them when all tasks are done; if one fails for
    good the folder goes, and nothing has become visible. Days that are there already are not written again, unless they are to
    be overwritten; then the old files of a day go right before the new ones come."""

    def __init__(self, options, overwrite: bool):
        self.root, self.overwrite, self.attempt = options["path"], overwrite or options.get("overwrite") == "true", f"_attempt-{uuid.uuid4().hex}"
        fs, path = _opened(self.root)
        fs.create_dir(path, recursive=True)
        self.present = {_day_of(f) for f in _files(fs, path)}

    def write(self, iterator):
        fs, path = _opened(self.root)
        held: dict[str, zipfile.ZipFile] = {}
        out, day, stream = [], None, None
        fs.create_dir(f"{path}/{self.attempt}", recursive=True)
        try:
            for batch in iterator:
                for own, name, content in zip(*(batch.column(c).to_pylist() for c in ("day", "name", "content"))):
                    if own is None or name is None or content is None or (own in self.present and not self.overwrite):
                        continue
                    if own != day:
                        if day is not None:
                            held.pop(day).close()
                            stream.close()
                        part = uuid.uuid4().hex
                        stream = fs.open_output_stream(temporary := f"{path}/{self.attempt}/{part}")
                        held[own], day = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED, compresslevel=1), own
                        out.append((own, temporary, f"{own}-{part[:12]}.zip"))
                    held[day].writestr(zipfile.ZipInfo(name), content, zipfile.ZIP_DEFLATED)
        finally:
            for bundle in held.values():
                bundle.close()
                stream.close()
        return _Written(out)

    def commit(self, messages):
        fs, path = _opened(self.root)
        files = [f for m in messages if m is not None for f in m.files]
        for old in [f for f in _files(fs, path) if _day_of(f) in {day for day, _, _ in files}]:
            fs.delete_file(old)
        for _, temporary, final in files:
            fs.move(temporary, f"{path}/{final}")
        self._clear(fs, path)

    def abort(self, messages):
        self._clear(*_opened(self.root))

    def _clear(self, fs, path):
        if fs.get_file_info(f"{path}/{self.attempt}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{path}/{self.attempt}")


class DayBundles(DataSource):
    """``df.write.format("day_bundles").mode("append").save(path)``: rows (day, name, content) as ZIP files by day, see ``write_days``."""

    @classmethod
    def name(cls):
        return "day_bundles"

    def schema(self):
        return "day string, name string, content binary"

    def writer(self, schema, overwrite):
        return _DayWriter(self.options, overwrite)


def write_days(members: DataFrame, path: str, overwrite: bool = False, parts: int = 1) -> None:
    """Writes members (day, name, content) as files ``<path>/<day>-<part>.zip``, in two phases: all of them appear when the job is
    done, or none. Days that have files are left as they are unless ``overwrite``.

    A day goes to one task, or to ``parts`` of them by a hash of the name where days are large. Rows with a null are left out.
    """
    members.sparkSession.dataSource.register(DayBundles)
    rows = members.select(F.col("day").cast("string").alias("day"), "name", "content")
    dealt = rows.repartition("day", F.pmod(F.xxhash64("name"), F.lit(parts))).sortWithinPartitions("day", "name")
    dealt.write.format("day_bundles").mode("append").option("overwrite", str(overwrite).lower()).save(path)


def members_of(files: DataFrame, content: str = "content", bundle: str = "bundle", suffix: str = "") -> DataFrame:
    """The members of bundles given as rows with their bytes, as Spark's binary file reader has them."""
    names = MEMBERS.replace(" binary", "").split(", ")
    fields = [n.split(" ")[0] for n in names]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(data)) as opened:
                    for position, info in enumerate(opened.infolist()):
                        if info.filename.endswith(suffix) and not info.is_dir():
                            raw = opened.read(info)
                            row = [name, position, info.filename, _day(info.filename), zlib.crc32(raw), raw]
                            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.binary()))], fields)

    return map_arrow(files.select(F.col(bundle).alias("bundle"), F.col(content).alias("content")), run, MEMBERS)
