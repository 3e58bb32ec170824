"""Files by byte ranges, as Spark data sources: lidar sweeps, and raw ranges of any file.

One big file is many tasks. Paths are URIs of file systems that pyarrow knows, or bare local paths; on a cluster all
executors must reach them.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: A point is five little-endian 32-bit floats: x, y, z, intensity and ring. Fixed values.
POINT_BYTES = 20
_POINTS = "frame_id string, point_pos long, x double, y double, z double, intensity double, ring double"


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[fs.FileInfo]:
    """The data files at or under ``path``, by name; hidden ones, and those in hidden folders, are left out."""
    system, at = _located(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [info]
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    shown = lambda p: not any(part[:1] in "._" for part in p[len(at.rstrip("/")) + 1 :].split("/"))
    return sorted((f for f in found if f.type == fs.FileType.File and shown(f.path)), key=lambda f: f.path)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    size: int


class RangeReader(DataSourceReader):
    """Partitions of at most ``range_bytes`` that begin at multiples of ``unit`` bytes."""

    unit = 1

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.step = max(1, int(options.get("range_bytes", 64 << 20)) // self.unit) * self.unit

    def partitions(self) -> list[Range]:
        return [Range(f.path, start, min(self.step, f.size - start)) for f in _files(self.path) for start in range(0, f.size, self.step)]

    def bytes_of(self, part: Range) -> bytes:
        with _located(self.path)[0].open_input_file(part.path) as f:
            return f.read_at(part.size, part.start)

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([part.path]), pa.array([part.start], pa.int64()), pa.array([self.bytes_of(part)], pa.binary())], ["path", "start", "data"])


class TaskReader(RangeReader):
    """Ranges as rows, consecutive ones of a file in one task: of at most 64 MB, and of few enough bytes for 128 tasks."""

    def partitions(self) -> list[Range]:
        files = _files(self.path)
        most = min(64 << 20, sum(f.size for f in files) // 128) // self.step
        size = self.step * max(1, most)
        return [Range(f.path, start, min(size, f.size - start)) for f in files for start in range(0, f.size, size)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        for start in range(part.start, part.start + part.size, self.step):
            yield from super().read(Range(part.path, start, min(self.step, part.start + part.size - start)))


class ByteRanges(DataSource):
    """path, start and data of each range of the files under ``path``."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, start long, data binary"

    def reader(self, schema) -> TaskReader:
        return TaskReader(self.options)


class PointReader(RangeReader):
    """Points of sweeps; a sweep's name is that of its file up to the first dot."""

    unit = POINT_BYTES

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.size % self.unit:
            raise ValueError(f"{part.path} does not hold whole points")
        data = np.frombuffer(self.bytes_of(part), "<f4").reshape(-1, 5).astype(np.float64)
        name, first = part.path.rsplit("/", 1)[-1].split(".")[0], part.start // self.unit
        for a in range(0, len(data), 65_536):
            own = data[a : a + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(own)), pa.array(np.arange(first + a, first + a + len(own))), *[pa.array(c) for c in own.T.copy()]], ["frame_id", "point_pos", "x", "y", "z", "intensity", "ring"])


@dataclass
class Staged(WriterCommitMessage):
    files: list[str]


class PointWriter(DataSourceArrowWriter):
    """A file for each frame. Tasks write to a folder of the run; commit moves the files that succeeded, and abort removes the folder."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, f"_staged-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        system, root = _located(self.path)
        context = TaskContext.get()
        own = posixpath.join(root, self.run, f"{context.partitionId()}-{context.attemptNumber()}")
        files, now, out = [], None, None
        for batch in batches:
            frames = batch.column("frame_id").to_pylist()
            values = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "z", "intensity", "ring")], 1).astype("<f4")
            starts = [i for i in range(len(frames)) if i == 0 or frames[i] != frames[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(frames)], strict=True):
                if frames[a] != now:
                    if out:
                        out.close()
                    now = frames[a]
                    if not now or set(now) & set("/\\.") or now in (posixpath.basename(f).split(".")[0] for f in files[-1:]):
                        raise ValueError(f"{now!r} can't name a file")
                    system.create_dir(own, recursive=True)
                    files.append(posixpath.join(own, f"{now}.bin"))
                    out = system.open_output_stream(files[-1])
                out.write(values[a:b].tobytes())
        if out:
            out.close()
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = _located(self.path)
        files = [f for m in messages if m for f in m.files]
        names = {posixpath.basename(f) for f in files}
        if len(names) < len(files):
            raise ValueError("rows of one frame were in several tasks")
        for old in _files(self.path) if system.get_file_info(root).type == fs.FileType.Directory and self.overwrite else ():
            if posixpath.basename(old.path) not in names:
                system.delete_file(old.path)
        for f in files:
            system.move(f, posixpath.join(root, posixpath.basename(f)))
        if files:
            system.delete_dir(posixpath.join(root, self.run))

    def abort(self, messages: list[Staged | None]) -> None:
        system, root = _located(self.path)
        if system.get_file_info(posixpath.join(root, self.run)).type == fs.FileType.Directory:
            system.delete_dir(posixpath.join(root, self.run))


class LidarPoints(DataSource):
    """Binary sweeps as rows of points, and rows as sweeps."""

    @classmethod
    def name(cls) -> str:
        return "lidar_points"

    def schema(self) -> str:
        return _POINTS

    def reader(self, schema) -> PointReader:
        return PointReader(self.options)

    def writer(self, schema, overwrite: bool) -> PointWriter:
        return PointWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the sources known to a session."""
    spark.dataSource.register(ByteRanges)
    spark.dataSource.register(LidarPoints)


def lidar_points(spark: SparkSession, path: str, range_bytes: int = 64 << 20) -> DataFrame:
    """frame_id (the file's name), point_pos, x, y, z, intensity and ring; a file of more than ``range_bytes`` is several tasks."""
    register(spark)
    return spark.read.format("lidar_points").option("range_bytes", range_bytes).load(path)


def write_lidar_points(points: DataFrame, path: str) -> None:
    """``points`` (frame_id, point_pos, x, y, z and maybe intensity and ring, else 0) as a file for each frame, in order of point_pos.

    Frames that are not written stay as they are; files appear only when all tasks have succeeded.
    """
    register(points.sparkSession)
    rest = [c if c in points.columns else f"0 as {c}" for c in ("intensity", "ring")]
    rows = points.selectExpr("frame_id", "cast(point_pos as long) as point_pos", *[f"cast({c.split(' ')[0]} as double) as {c.split(' ')[-1]}" for c in ("x", "y", "z", *rest)])
    rows.repartition("frame_id").sortWithinPartitions("frame_id", "point_pos").write.format("lidar_points").mode("append").save(path)
