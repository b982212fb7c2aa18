"""A data source for matrices in ``.npy`` files: rows are read by ranges, and written by a two-phase commit.

``spark.dataSource.register(Matrices)``, then ``spark.read.format("matrix").load(folder)`` gives ``row`` and ``vector``, and
``df.select("row", "vector").write.format("matrix").mode("append").save(folder)`` writes. The folder is one that every
node has. Tasks write under names of their own; only when all have ended does a list name their files, so what a failed
task or job wrote is never read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "row long, vector array<float>"
#: Rows of a partition, of a batch and of a file.
RANGE, BATCH, FILE_ROWS = 1 << 17, 4096, 1 << 17


@dataclass
class Rows(InputPartition):
    """Rows ``begin`` to ``stop`` of a file."""

    path: str
    begin: int
    stop: int


@dataclass
class Written(WriterCommitMessage):
    files: list


def listed(folder: str) -> list[str]:
    """The matrix files that lists name, in order; without a list, all ``.npy`` files of the folder."""
    if not os.path.isdir(folder):
        return [folder]
    lists = sorted(f for f in os.listdir(folder) if f.startswith("list-") and f.endswith(".json"))
    if not lists:
        return [os.path.join(folder, f) for f in sorted(os.listdir(folder)) if f.endswith(".npy") and not f.startswith(("row-", "part-"))]
    out = []
    for name in lists:
        with open(os.path.join(folder, name)) as f:
            out += [os.path.join(folder, x) for x in json.load(f)]
    return out


class MatrixReader(DataSourceReader):
    def __init__(self, folder: str, rows: int) -> None:
        self.folder, self.rows = folder, rows

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in listed(self.folder):
            n = len(np.load(path, mmap_mode="r"))
            out += [Rows(path, a, min(a + self.rows, n)) for a in range(0, n, self.rows)]
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        # Only the rows asked for are read from the file.
        data = np.load(partition.path, mmap_mode="r")
        beside = partition.path[:-4] + ".rows.npy"
        rows = np.load(beside, mmap_mode="r") if os.path.exists(beside) else None
        for a in range(partition.begin, partition.stop, BATCH):
            b = min(a + BATCH, partition.stop)
            x = np.ascontiguousarray(data[a:b], dtype=np.float32)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.record_batch([pa.array(np.asarray(rows[a:b]) if rows is not None else np.arange(a, b, dtype=np.int64)), vectors], names=["row", "vector"])


class MatrixWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool) -> None:
        self.folder, self.overwrite = folder, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        os.makedirs(self.folder, exist_ok=True)
        files: list[str] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> None:
            name = f"part-{uuid4()}.npy"
            for suffix, i in ((".rows.npy", 0), (".npy", 1)):
                path = os.path.join(self.folder, name[:-4] + suffix)
                with open(f"{path}.tmp", "wb") as f:
                    np.save(f, np.concatenate([x[i] for x in held]))
                os.replace(f"{path}.tmp", path)
            files.append(name)
            held.clear()

        try:
            for batch in iterator:
                vectors = batch.column("vector")
                sizes = np.diff(vectors.offsets.to_numpy())
                if vectors.null_count or vectors.values.null_count or batch.column("row").null_count or len(set(sizes.tolist())) > 1:
                    raise ValueError("a matrix has rows of one length, without nulls")
                if batch.num_rows:
                    x = vectors.flatten().to_numpy().astype(np.float32).reshape(batch.num_rows, -1)
                    held.append((batch.column("row").to_numpy().astype(np.int64), x))
                if sum(len(r) for r, _ in held) >= FILE_ROWS:
                    flush()
            if held:
                flush()
        except BaseException:
            remove(self.folder, files)
            raise
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        before = [f for f in os.listdir(self.folder) if f.startswith("list-")] if self.overwrite else []
        old = [os.path.basename(f) for f in listed(self.folder)] if before else []
        path = os.path.join(self.folder, f"list-{len(os.listdir(self.folder)):012d}-{uuid4()}.json")
        with open(f"{path}.tmp", "w") as f:
            json.dump([x for m in messages if m is not None for x in m.files], f)
        os.replace(f"{path}.tmp", path)
        for name in before:
            os.remove(os.path.join(self.folder, name))
        remove(self.folder, old)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        remove(self.folder, [x for m in messages if m is not None for x in m.files])


def remove(folder: str, files: list[str]) -> None:
    for name in files:
        for path in (os.path.join(folder, name), os.path.join(folder, name[:-4] + ".rows.npy")):
            if os.path.exists(path):
                os.remove(path)


class Matrices(DataSource):
    """Options: ``path``, and ``rows`` of a partition."""

    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return MatrixReader(self.options["path"], int(self.options.get("rows", RANGE)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return MatrixWriter(self.options["path"], overwrite)
