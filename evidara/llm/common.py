"""Session, shared-folder and table helpers that the operators share."""

from __future__ import annotations

import gc
import os
import tempfile
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

#: Bytes of text that one vectorised step looks at; bounds a worker's memory.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or (unset, on a local master only, as in tests) one of our own."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="evidara-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def with_fields(ddl: str, df: DataFrame, carry: tuple[str, ...]) -> T.StructType:
    """The schema ddl with the carried columns of df."""
    return T.StructType([*T.StructType.fromDDL(ddl).fields, *(df.schema[c] for c in carry)])


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def new_shared_dir(spark: SparkSession, kind: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def drop_shared_dir(spark: SparkSession, uri: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def local_path(uri: str) -> str | None:
    """The path of a shared folder that is mounted (file: or none as scheme); None for other stores."""
    parts = urllib.parse.urlsplit(uri)
    return urllib.parse.unquote(parts.path) if parts.scheme in ("", "file") else None


class SharedFile:
    """One new file of a shared folder. It is written under a name of its own and renamed when closed, so attempts of a task do each other no harm."""

    def __init__(self, uri: str, name: str):
        self.size, self.root, self.name, self.attempt = 0, local_path(uri), name, f".{name}.{uuid.uuid4().hex}"
        if self.root is not None:
            os.makedirs(self.root, exist_ok=True)
            self.out = open(f"{self.root}/{self.attempt}", "wb")  # noqa: SIM115
        else:
            from pyarrow import fs

            self.store, self.path = fs.FileSystem.from_uri(uri)
            self.store.create_dir(self.path, recursive=True)
            self.out = self.store.open_output_stream(f"{self.path}/{self.attempt}")

    def write(self, data: bytes | memoryview) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        if self.root is not None:
            os.replace(f"{self.root}/{self.attempt}", f"{self.root}/{self.name}")
        else:
            self.store.move(f"{self.path}/{self.attempt}", f"{self.path}/{self.name}")


def put_bytes(uri: str, name: str, *parts: bytes | memoryview) -> None:
    """Write one file of a shared folder (see SharedFile)."""
    out = SharedFile(uri, name)
    for part in parts:
        out.write(part)
    out.close()


class SharedReader:
    """Reads ranges of the files of a shared folder without mapping or fetching them whole; at most so many files are open."""

    OPEN = 256

    def __init__(self, uri: str):
        self.uri, self.root, self.files = uri, local_path(uri), {}

    def read(self, name: str, offset: int, size: int) -> bytes:
        file = self.files.get(name)
        if file is None:
            if len(self.files) >= self.OPEN:
                self.files.pop(next(iter(self.files))).close()
            if self.root is not None:
                file = open(f"{self.root}/{name}", "rb", buffering=0)  # noqa: SIM115
            else:
                from pyarrow import fs

                store, path = fs.FileSystem.from_uri(self.uri)
                file = store.open_input_file(f"{path}/{name}")
            self.files[name] = file
        if self.root is not None:
            return os.pread(file.fileno(), size, offset)
        file.seek(offset)
        return file.read(size)


def read_file(uri: str, name: str) -> bytes | None:
    """One file of a shared folder, None if there is none of that name."""
    root = local_path(uri)
    try:
        if root is not None:
            with open(f"{root}/{name}", "rb") as f:
                return f.read()
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        with store.open_input_stream(f"{path}/{name}") as f:
            return f.read()
    except FileNotFoundError:
        return None


def map_file(uri: str, name: str):
    """Memory-map one file of a shared folder; other stores' files are fetched once to an unlinked local file."""
    import mmap

    root = local_path(uri)
    if root is not None:
        with open(f"{root}/{name}", "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if os.fstat(f.fileno()).st_size else b""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with tempfile.TemporaryFile() as own, store.open_input_stream(f"{path}/{name}") as source:
        while chunk := source.read(8 << 20):
            own.write(chunk)
        own.flush()
        return mmap.mmap(own.fileno(), 0, access=mmap.ACCESS_READ) if own.tell() else b""


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each part holds about size bytes of text, one document at least."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // size
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)
