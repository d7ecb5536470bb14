"""Resumable ingest: files already processed are skipped, on streams and in batch (STR-1)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BLOCK_BYTES = 1 << 20  # a task holds some blocks, never a whole file
FILES = "source_sha256 string, source_path string, source_bytes bigint"
BLOCKS = f"{FILES}, block bigint, raw_bytes binary"


def _blocks(path: str) -> Iterator[bytes]:
    scheme, _, rest = path.rpartition("file:")
    local = scheme == "" and rest.startswith("/")
    system, inner = (fs.LocalFileSystem(), "/" + rest.lstrip("/")) if local else fs.FileSystem.from_uri(path)
    with system.open_input_stream(inner, buffer_size=0) as source:
        while block := source.read(BLOCK_BYTES):
            yield block


def _with_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            digest, size = hashlib.sha256(), 0
            for block in _blocks(path):
                digest.update(block)
                size += len(block)
            yield pa.RecordBatch.from_pydict({"source_sha256": [digest.hexdigest()], "source_path": [path], "source_bytes": [size]})


def _with_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row(file: dict, number: int, block: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({**{k: [v] for k, v in file.items()}, "block": [number], "raw_bytes": pa.array([block], pa.binary())})

    for batch in batches:
        for file in batch.to_pylist():
            digest, number = hashlib.sha256(), 0
            for block in _blocks(file["source_path"]):
                digest.update(block)
                yield row(file, number, block)
                number += 1
            if digest.hexdigest() != file["source_sha256"]:
                raise ValueError(f"{file['source_path']} changed while it was read")


def _resolved(spark: SparkSession, folder: str) -> str:
    """The folder behind a mount, as tasks open files without Spark's readers."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).resolvePath(path).toString()


def archive_stream(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """New files of a folder with their digest; contents are hashed block by block."""
    files = spark.readStream.format("binaryFile").schema(
        "path string, modificationTime timestamp, length bigint, content binary"
    ).option("pathGlobFilter", glob).load(_resolved(spark, folder))
    return files.select("path").mapInArrow(_with_digests, FILES)


def ingest_new_files(spark: SparkSession, folder: str, table: str, checkpoint: str, glob: str = "*") -> StreamingQuery:
    """Append unseen files to ``table`` and stop; running it again adds nothing.

    The checkpoint remembers the files, the state remembers digests, so a renamed
    copy of a file is not stored twice. A file is stored as rows of one block each,
    numbered from 0; only digests are shuffled. Spark's file sources pass over empty files.
    """
    fresh = archive_stream(spark, folder, glob).dropDuplicates(["source_sha256"])
    return (
        fresh.mapInArrow(_with_blocks, BLOCKS).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def stored_files(blocks: DataFrame) -> DataFrame:
    """One row per ingested file, without its contents."""
    return blocks.where("block = 0").select("source_sha256", "source_path", "source_bytes")


def whole_files(blocks: DataFrame) -> DataFrame:
    """One row per ingested file with all its bytes, for files that fit a row."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "raw_bytes"))), lambda b: F.hex(b["raw_bytes"]))
    return blocks.groupBy("source_sha256", "source_path", "source_bytes").agg(F.unhex(F.array_join(parts, "")).alias("raw_bytes"))
