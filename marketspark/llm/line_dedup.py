"""Lines that many documents share, dropped from every document.

Lines are exploded and hashed twice: once to count the documents of every hash, once
with their positions to find the lines to drop. A text is then put together again from
the positions that stay. A line found in so many documents that it could crowd a task
is one of at most ``HEAVY_LINES`` (their counts add up to no more than all rows), so
these are broadcast; every other line meets its count in a shuffle of bounded keys.

Defined cases: a null or empty text is one empty line. Every row is a document of its
own, also if its id is null or repeated; a line counts once a row. A line shorter than
``min_length`` after stripping is never dropped. If all lines go, the text is empty. An
empty table gives no rows. Other columns stay; the two counts take free names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketspark.llm.text import LOWER, as_bytes, free_name, map_batches, schema_of
from marketspark.session import stage

SPACE = b" \t\n\x0b\x0c\r"
HEAVY_LINES = 100_000
HASH = (("one", T.LongType()), ("other", T.LongType()))


def line_keys(text: bytes) -> list[bytes]:
    """The lines of a text, stripped and with A-Z lowered."""
    return [line.strip(SPACE).translate(LOWER) for line in text.split(b"\n")]


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _digests(keys: list[bytes]) -> np.ndarray:
    """128 bits of every key as two signed longs."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype="<i8").reshape(-1, 2)


def common_lines(docs: DataFrame, text_col: str = "text", min_documents: int = 10, min_length: int = 1) -> DataFrame:
    """(one, other, n, heavy): hashes of the lines found in at least ``min_documents`` rows, counted before the shuffle."""

    def step(batch):
        keys = [k for t in as_bytes(batch.column(0)) for k in set(line_keys(t)) if _long_enough(k, min_length)]
        return list(_digests(keys).T)

    hashes = map_batches(docs.select(F.col(text_col).cast("string")), schema_of(*HASH), step)
    counts = stage(hashes.groupBy("one", "other").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return stage(counts.where(F.col("n") >= min_documents).withColumn("heavy", F.col("n") * HEAVY_LINES >= F.lit(total)))


def without_common_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_documents: int = 10, min_length: int = 1
) -> DataFrame:
    """``docs`` without the lines found in at least ``min_documents`` rows, with the counts ``n_lines`` (before) and ``n_dropped``."""
    common = common_lines(docs, text_col, min_documents, min_length)
    text = F.col(text_col).cast("string")
    # a row is told by its id and 128 bits of its text; rows equal in both lose the same lines
    named = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))

    def positions(batch):
        keys = [line_keys(t) for t in as_bytes(batch.column(1))]
        sizes = [len(k) for k in keys]
        row = pa.array(np.repeat(np.arange(len(keys)), sizes))
        at = np.concatenate([np.arange(n) for n in sizes] or [np.zeros(0)]).astype(np.int64)
        digests = _digests([k for found in keys for k in found])
        return [*(batch.column(i).take(row) for i in (0, 2, 3)), at, *digests.T]

    place = T.StructType([named.schema["id"], named.schema["t1"], named.schema["t2"], T.StructField("at", T.LongType()), *schema_of(*HASH)])
    lines = map_batches(named, place, positions)
    same = ["one", "other"]
    told = lines.join(F.broadcast(common.where("heavy").select(*same, "heavy")), same, "left")
    light = told.where("heavy IS NULL").join(common.where("NOT heavy").select(*same).hint("shuffle_hash"), same, "left_semi")
    dropped = told.where("heavy").unionByName(light)
    gone = dropped.groupBy(F.col("id").alias("_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2")).agg(F.collect_set("at").alias("_gone"))

    held = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    met = held.join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")), "left")
    n_lines, n_dropped, place_of = free_name(docs, "n_lines"), free_name(docs, "n_dropped"), docs.columns.index(text_col)
    width = len(docs.columns)
    out = T.StructType([
        *(T.StructField(f.name, T.StringType()) if f.name == text_col else f for f in docs.schema),
        T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType()),
    ])

    def rebuild(batch):
        kept, before, lost = [], [], []
        for data, gone in zip(as_bytes(batch.column(place_of)), batch.column(width)):
            gone = set(gone.values.to_numpy().tolist()) if gone.is_valid else ()
            parts = data.split(b"\n") if gone else ()
            kept.append(b"\n".join(line for at, line in enumerate(parts) if at not in gone) if gone else data)
            before.append(data.count(b"\n") + 1)
            lost.append(len(gone))
        columns = batch.columns[:width]
        columns[place_of] = pa.array(kept, pa.binary()).cast(pa.string())
        return [*columns, before, lost]

    flat = met.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("_gone").alias(free_name(docs, "_gone")))
    return map_batches(flat, out, rebuild)
