"""Benchmark items inside long documents, by size-partitioned MinHash containment.

Items are partitioned by their number of distinct five-word shingles (powers of two).
Each partition has one sketch length: as many of the smallest shingle hashes of an item
(bottom-k MinHash) as could all be missing from a text that still holds ``threshold`` of
the largest item of the partition, plus one. A text that contains the item therefore
shares at least one hash with the sketch, wherever in the text it stands; candidates are
verified on the shingles themselves.

Documents look sketches up against all of their shingles. While all sketch hashes fit
in ``probe_limit`` they travel with the task and filter at once, beyond that every
distinct shingle hash goes to the join.

Defined cases: words are runs of non-space with A-Z lowered; a text with fewer than five
words is one shingle, one without words (or null) has none and matches nothing. Repeated
rows, of documents or items, give repeated result rows. Null ids are kept as they are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketspark.llm.text import LOWER, as_bytes, free_name, map_batches, schema_of, shingles, word_lists
from marketspark.session import bounded_broadcast, stage

WIDTH = 5
THRESHOLD = 0.8
PROBE_LIMIT = 4_000_000  # 32 MB of hashes
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles, made from one hash per word."""
    kept, parts = np.zeros(0, dtype=np.uint64), []
    for words in word_lists(text.translate(LOWER)):
        kept = np.concatenate([kept, np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))])
        runs = len(kept) - width + 1
        if runs > 0:
            mixed = np.zeros(runs, dtype=np.uint64)
            for k in range(width):
                mixed = (mixed ^ kept[k:k + runs]) * FACTOR
                mixed ^= mixed >> np.uint64(31)
            parts.append(np.unique(mixed))
            kept = kept[runs:]
    if not parts and len(kept):
        parts.append(np.array([xxhash.xxh3_64_intdigest(kept.tobytes(), seed=width)], dtype=np.uint64))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)


def sketch_length(size: int, threshold: float) -> int:
    """Sketch length of the partition that holds items of ``size`` distinct shingles."""
    largest = (1 << size.bit_length()) - 1
    return largest - math.ceil(threshold * largest - 1e-9) + 1


def sketches(items: DataFrame, id_col: str = "item_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(size_class, h, item_id): the smallest shingle hashes of every item."""
    out = schema_of(("size_class", T.IntegerType()), ("h", T.LongType()), ("item_id", items.schema[id_col].dataType))

    def step(batch):
        sizes, hashes, ids = [], [], []
        for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            found = shingle_hashes(text)
            if len(found):
                least = found[: sketch_length(len(found), threshold)]
                sizes += [len(found).bit_length()] * len(least)
                hashes += least.view(np.int64).tolist()
                ids += [item] * len(least)
        return [sizes, hashes, ids]

    return map_batches(items.select(id_col, F.col(text_col).cast("string").alias("text")), out, step)


def _probes(docs: DataFrame, wanted: np.ndarray | None) -> DataFrame:
    """(doc, h): distinct shingle hashes of every text, only those in ``wanted`` if it is given."""
    out = schema_of(("doc", docs.schema["doc"].dataType), ("h", T.LongType()))

    def step(batch):
        rows, hashes = [], []
        for k, text in enumerate(as_bytes(batch.column(1))):
            found = shingle_hashes(text)
            if wanted is not None and len(found):
                if not len(wanted):
                    continue
                at = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
                found = found[wanted[at] == found]
            if len(found):
                rows.append(np.full(len(found), k))
                hashes.append(found)
        at = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
        held = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        return [batch.column(0).take(pa.array(at)), pa.array(held.view(np.int64))]

    return map_batches(docs, out, step)


def _shared(text: bytes, item: bytes) -> tuple[int, int]:
    """Distinct shingles of the item, and how many of them the text has."""
    wanted = {s for run in shingles(item.translate(LOWER), WIDTH) for s in run}
    found = set()
    for run in shingles(text.translate(LOWER), WIDTH):
        found.update(wanted.intersection(run))
    return len(wanted), len(found)


def contained_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
    threshold: float = THRESHOLD, probe_limit: int = PROBE_LIMIT,
) -> DataFrame:
    """(doc, digest, item_id, n_item, n_shared, containment) of every document and item it holds ``threshold`` of.

    ``digest`` is the SHA-256 of the document's text, so that rows with one id but different texts stay apart.
    """
    index = stage(sketches(items, item_col, text_col, threshold))
    wanted = None
    if index.count() <= probe_limit:
        wanted = np.unique(np.array([r.h for r in index.select("h").distinct().collect()], dtype=np.int64).view(np.uint64))
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    pairs = _probes(texts, wanted).join(index, "h").select(F.col("doc").alias("_doc"), F.col("item_id").alias("_item")).distinct()
    pairs = stage(pairs)
    named = items.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("item_text"))
    asked = texts.join(bounded_broadcast(pairs), F.col("doc").eqNullSafe(F.col("_doc"))).join(named, F.col("_item").eqNullSafe(F.col("item_id")))
    asked = asked.select("doc", F.sha2(F.col("text"), 256).alias("digest"), "item_id", "text", "item_text")
    out = T.StructType(asked.schema.fields[:3] + schema_of(("n_item", T.LongType()), ("n_shared", T.LongType())).fields)

    def step(batch):
        counts = [_shared(a, b) for a, b in zip(as_bytes(batch.column(3)), as_bytes(batch.column(4)))]
        return [*batch.columns[:3], [c[0] for c in counts], [c[1] for c in counts]]

    return map_batches(asked, out, step).withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("containment") >= threshold)


def uncontaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no item; columns stay as they are."""
    doc, digest = free_name(docs, "_held_doc"), free_name(docs, "_held_digest")
    found = stage(contained_items(docs, items, threshold=threshold).select(F.col("doc").alias(doc), F.col("digest").alias(digest)).distinct())
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.sha2(F.col("text").cast("string"), 256) == F.col(digest))
    return docs.join(bounded_broadcast(found), same, "left_anti")
