"""Words, shingles and Arrow batches shared by the text operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
GAP = re.compile(rb"[\x20\x09-\x0D]")
SEGMENT = 1 << 20
PIECE_BYTES = 4 << 20


def table(spark, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``docs`` has it in either case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_lists(data: bytes, size: int = SEGMENT) -> Iterator[list[bytes]]:
    """The words of ``data`` in order, about ``size`` bytes of text at a time, so that long texts need little memory."""
    start = 0
    while start < len(data):
        end = min(start + size, len(data))
        if end < len(data):
            gap = GAP.search(data, end)
            end = gap.start() if gap else len(data)
        yield data[start:end].split()
        start = end


def shingles(data: bytes, width: int) -> Iterator[list[bytes]]:
    """Every run of ``width`` words joined by one space, repeats included; with fewer words the whole sequence, with none nothing."""
    kept: list[bytes] = []
    found = False
    for words in word_lists(data):
        words = kept + words
        if len(words) >= width:
            found = True
            yield list(map(b" ".join, zip(*[words[i:] for i in range(width)])))
        kept = words[max(0, len(words) - width + 1):] if width > 1 else []
    if not found and kept:
        yield [b" ".join(kept)]


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_batches(df: DataFrame, schema: T.StructType, step: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """Rows of ``schema`` made from the Arrow batches of ``df`` by ``step``, which returns one array or list per column.

    Batches are cut to about ``PIECE_BYTES``, as what is made from a text can be many times its size.
    """

    arrow = to_arrow_schema(schema)

    def run(batches):
        for whole in batches:
            rows = max(1, whole.num_rows * PIECE_BYTES // max(whole.nbytes, 1))
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                columns = [
                    c if isinstance(c, (pa.Array, pa.ChunkedArray)) and c.type == f.type else pa.array(c, f.type)
                    for c, f in zip(step(batch), arrow)
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)


def schema_of(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])
