"""Batch sources ``fvecs`` and ``ivecs``: files of ``[int32 width][width x 4-byte values]`` records.

Register with ``register(spark)``, then ``spark.read.format("fvecs").load(path)``. A file is split
in byte ranges of whole records, so one large file is read by many tasks. A folder is read as the
concatenation of its files in name order; ids are record numbers over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Bytes per task unless the option ``split_bytes`` says otherwise.
SPLIT_BYTES = 64 << 20
BATCH_ROWS = 8192


class RecordRange(InputPartition):
    """Records [first, first + count) of a file whose first record has the id ``offset``."""

    def __init__(self, path: str, width: int, first: int, count: int, offset: int):
        self.path, self.width, self.first, self.count, self.offset = path, width, first, count, offset


def _open(path: str):
    """Random access to a file of any storage Arrow knows; plain paths are local or mounted."""
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


def _files(path: str) -> list[str]:
    fs, inner = pafs.FileSystem.from_uri(path)
    if fs.get_file_info(inner).type != pafs.FileType.Directory:
        return [path]
    names = [f.base_name for f in fs.get_file_info(pafs.FileSelector(inner)) if f.type == pafs.FileType.File]
    return [f"{path.rstrip('/')}/{n}" for n in sorted(names) if not n.startswith(("_", "."))]


class VecsReader(DataSourceReader):
    def __init__(self, path: str, options: dict, element: str):
        self.path = path
        self.strict = str(options.get("strict", "false")).lower() == "true"
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.element = element

    def partitions(self):
        """Record ranges; the width of the first record holds for its file, trailing bytes are ignored."""
        ranges, offset = [], 0
        for path in _files(self.path):
            with _open(path) as f:
                size = f.size()
                if size < 4:
                    continue
                width = int(np.frombuffer(f.read(4), dtype="<i4")[0])
            if width <= 0:
                raise ValueError(f"{path}: the first record has width {width}")
            record = 4 * (width + 1)
            total = size // record
            step = max(1, self.split_bytes // record)
            ranges += [RecordRange(path, width, s, min(step, total - s), offset) for s in range(0, total, step)]
            offset += total
        return ranges or [RecordRange(self.path, 0, 0, 0, 0)]

    def read(self, partition: RecordRange) -> Iterator[pa.RecordBatch]:
        if partition.count == 0:
            return
        record = 4 * (partition.width + 1)
        value_type = pa.float32() if self.element == "f" else pa.int64()
        names = ["vec_id", "embedding"] if self.element == "f" else ["query_id", "neighbors"]
        with _open(partition.path) as f:
            f.seek(partition.first * record)
            done = 0
            while done < partition.count:
                rows = min(BATCH_ROWS, partition.count - done)
                raw = np.frombuffer(f.read(rows * record), dtype="<i4").reshape(rows, partition.width + 1)
                if self.strict and (raw[:, 0] != partition.width).any():
                    raise ValueError(f"{partition.path}: records of different width")
                body = np.ascontiguousarray(raw[:, 1:])
                flat = body.view("<f4").reshape(-1) if self.element == "f" else body.reshape(-1).astype(np.int64)
                offsets = np.arange(0, (rows + 1) * partition.width, partition.width, dtype=np.int32)
                ids = partition.offset + partition.first + done + np.arange(rows, dtype=np.int64)
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=value_type))
                yield pa.RecordBatch.from_arrays([pa.array(ids), values], names=names)
                done += rows


class FvecsSource(DataSource):
    """``vec_id bigint, embedding array<float>``; ids are record numbers."""

    @classmethod
    def name(cls) -> str:
        return "fvecs"

    def schema(self) -> str:
        return "vec_id bigint, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return VecsReader(self.options["path"], dict(self.options), "f")


class IvecsSource(DataSource):
    """``query_id bigint, neighbors array<bigint>``; ids are record numbers."""

    @classmethod
    def name(cls) -> str:
        return "ivecs"

    def schema(self) -> str:
        return "query_id bigint, neighbors array<bigint>"

    def reader(self, schema) -> DataSourceReader:
        return VecsReader(self.options["path"], dict(self.options), "i")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FvecsSource)
    spark.dataSource.register(IvecsSource)
