"""Language identification with error-correcting output codes.

Every language gets a codeword. Each bit has a binary classifier: log-odds of hashed
letter n-grams between the languages whose codeword sets the bit and the others. A text
is given the codeword of least loss, each bit weighted by how far apart its two sides
lie; a text whose two best codewords lie closer than ``AMBIGUOUS`` is flagged.

The model is learned from at most ``sample_rows`` rows of each language, picked by a hash
of their id; prediction covers every row and the whole of its text.

Defined cases: a null text or one without a letter gives ``und`` with score 0. Rows with
a null id or language are predicted but never learned from. Repeated rows get equal
answers, ties go to the first language in order. Without any labelled row all texts are
``und``; with one language every text with a letter gets it, with score 1.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketspark.llm.text import free_name, map_batches, schema_of

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SAMPLE_ROWS = 4000
AMBIGUOUS = 0.02
UNKNOWN = "und"
PIECE = 1 << 20
SHARPNESS = 4.0


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def gram_buckets(text: str | None):
    """Buckets of the letter n-grams of ``text`` with runs of other characters as one gap, a piece at a time; nothing without a letter."""
    letters = _is_letter()
    for start in range(0, len(text or ""), PIECE):
        codes = np.frombuffer(text[start:start + PIECE + max(ORDERS) - 1].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        known = letters[codes]
        if not known.any():
            continue
        codes = np.where(known, codes, 32)
        keep = known.copy()
        keep[1:] |= known[:-1]  # one gap after a letter stays
        codes = np.concatenate([[32], codes[keep]]).astype(np.uint64)
        for n in ORDERS:
            mixed = np.full(max(len(codes) - n + 1, 0), n, dtype=np.uint64)
            for k in range(n):
                mixed = (mixed * np.uint64(0x9E3779B97F4A7C15)) ^ codes[k:len(codes) - n + 1 + k]
            if len(mixed):
                yield ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(49)).astype(np.int64)


def codewords(count: int) -> np.ndarray:
    """A row of +1/-1 per language: all distinct splits up to six languages, beyond that the most separated of seeded random codes."""
    if count <= 6:
        bits = max(1, 2 ** (count - 1) - 1)
        return np.array([[1 if k == 0 or not (b + 1) >> (k - 1) & 1 else -1 for b in range(bits)] for k in range(count)])
    rng, length, best = np.random.default_rng(7), math.ceil(10 * math.log2(count)), None
    for _ in range(50):
        code = rng.choice([-1, 1], (count, length))
        apart = (length - (code @ code.T - 2 * length * np.eye(count))).min() if (np.abs(code.sum(0)) < count).all() else -1
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


class Model:
    """Languages, their codewords and the weights of the bit classifiers."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        self.code = codewords(len(self.langs)) if self.langs else np.zeros((0, 0))
        if len(self.langs) < 2:
            return
        share = np.array([(counts[x] + 0.05) / (counts[x] + 0.05).sum() for x in self.langs])  # every language counts the same
        ones = (self.code > 0).astype(float)
        on, off = (side.T @ share / side.sum(0)[:, None] for side in (ones, 1 - ones))
        weights = np.log(on) - np.log(off)
        means = share @ weights.T  # of each language and bit
        low = np.where(self.code > 0, means, np.inf).min(0)
        high = np.where(self.code < 0, means, -np.inf).max(0)
        half = np.maximum((low - high) / 2, 1e-6)
        self.weights, self.middle, self.half = weights.T.astype(np.float32), (low + high) / 2, half
        self.trust = half / half.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous) of a whole text."""
        total, grams = 0.0, 0
        for buckets in gram_buckets(text):
            grams += len(buckets)
            if len(self.langs) > 1:
                total = total + self.weights[buckets].sum(0, dtype=np.float64)
        if not grams or not self.langs:
            return UNKNOWN, 0.0, False
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        margin = (total / grams - self.middle) / self.half
        loss = (np.logaddexp(0, -SHARPNESS * self.code * margin) * self.trust).sum(1)
        chance = np.exp(-SHARPNESS * (loss - loss.min()))
        chance /= chance.sum()
        first, second = np.argsort(-chance, kind="stable")[:2]
        return self.langs[first], float(chance[first]), bool(chance[first] - chance[second] < AMBIGUOUS)


def hash_part(id_column: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(parts))


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, learn: Column, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most about ``sample_rows`` rows of each language where ``learn`` holds."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        learn & F.col("lang").isNotNull()
    )
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model({})
    spot = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_000))
    limit = F.coalesce(F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1_000_000, math.ceil(1e6 * sample_rows / n)))])[F.col("lang")], F.lit(0))
    sample = rows.where(spot < limit).select("lang", "text").repartition(8)
    out = schema_of(("lang", T.StringType()), ("counts", T.BinaryType()))

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                held = found.setdefault(lang, np.zeros(BUCKETS))
                for buckets in gram_buckets(text):
                    held += np.bincount(buckets, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=out.names)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "counts": [sum(np.frombuffer(x) for x in rows["counts"]).tobytes()]})

    sums = sample.mapInArrow(count, out).groupBy("lang").applyInPandas(add, out).collect()
    return Model({r.lang: np.frombuffer(r["counts"]) for r in sums})


def identify(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """All columns of ``docs`` followed by the language, its score and the flag, under ``names``."""
    at = docs.columns.index(text_col)
    out = T.StructType(list(docs.schema.fields) + list(schema_of((names[0], T.StringType()), (names[1], T.DoubleType()), (names[2], T.BooleanType()))))

    def step(batch):
        found = [model.predict(t) for t in batch.column(at).cast(pa.string()).to_pylist()]
        return [*batch.columns, *map(list, zip(*found))]

    return map_batches(docs, out, step)


def learned_rows(id_column: Column) -> Column:
    """Rows the model may learn from: crc32 of the id modulo 4 is not 2."""
    return F.coalesce(hash_part(id_column, 4) != 2, F.lit(False))


def predictions(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every document."""
    model = fit(docs, "doc_id", "text", "lang", learned_rows(F.col("doc_id")), sample_rows)
    rows = docs.select("doc_id", F.coalesce(hash_part(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return identify(rows, model).drop("text")


def identified(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents whose language is told with certainty: neither ``und`` nor ambiguous. Columns stay as they are."""
    model = fit(docs, "doc_id", "text", "lang", learned_rows(F.col("doc_id")), sample_rows)
    names = tuple(free_name(docs, n) for n in ("lang_pred", "lang_score", "lang_ambiguous"))
    told = identify(docs.withColumn("text", F.col("text").cast("string")), model, "text", names)
    return told.where((F.col(names[0]) != UNKNOWN) & ~F.col(names[2])).select(*[F.col(f"`{c}`") for c in docs.columns])
