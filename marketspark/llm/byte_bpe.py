"""Byte-level BPE: encoding by ranked merges over distinct words, decoding by concatenation.

Each text is split by the pattern; a batch folds the merges of every distinct word once,
from single bytes, always joining the leftmost pair of lowest rank, and keeps the ids in
a cache of bounded size, as words repeat across texts. Words of up to ``LONG`` bytes scan
their pairs, longer ones use a heap, with equal results.

Defined cases: a null text is empty and has no tokens (hashes of the empty string).
Repeated rows give equal rows; null ids stay. Very long texts are split where one space
stands between two words, which no match of the pattern crosses.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketspark.llm.text import map_batches

LONG = 64
CACHE_WORDS = 400_000
CHUNK = 1 << 20
CUT = regex.compile(r"(?<=\S) (?=\S)")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with one base64 piece and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a short word: join the leftmost pair of lowest rank until none is left."""
    parts = [word[i:i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i:i + 2]) for i in range(len(word) - 1)]
    while True:
        best, at = None, -1
        for i, rank in enumerate(pairs):
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            return [ranks[p] for p in parts]
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1])
        if at:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for long words, in n log n: a heap of (rank, position) over linked parts, stale entries skipped."""
    stop, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    alive = [True] * len(word)
    heap = [(ranks[p], i, i + 2) for i in range(len(word) - 1) if (p := word[i:i + 2]) in ranks]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        if i >= 0 and stop[i] < len(word):
            end = stop[stop[i]]
            rank = ranks.get(word[i:end])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end))

    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or stop[i] >= len(word) or stop[stop[i]] != end:
            continue
        alive[stop[i]] = False
        stop[i] = end
        if end < len(word):
            before[end] = i
        offer(i)
        offer(before[i])
    out, i = [], 0
    while i < len(word):
        out.append(ranks[word[i:stop[i]]])
        i = stop[i]
    return out


class Encoder:
    """Ids of texts for one rank table and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split, self.cache = ranks, regex.compile(pattern).findall, {}
        self.pieces = {rank: piece for piece, rank in ranks.items()}

    def word(self, word: str) -> list[int]:
        data = word.encode()
        if data in self.ranks:
            ids = [self.ranks[data]]
        else:
            ids = merge_short(data, self.ranks) if len(data) <= LONG else merge_long(data, self.ranks)
        if len(data) <= LONG:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        ids, start, known = [], 0, self.cache.get
        while start < len(text):
            end = len(text)
            if end - start > CHUNK:
                cut = CUT.search(text, start + CHUNK)
                end = cut.start() if cut else end
            for word in self.split(text if end - start == len(text) else text[start:end]):
                ids += known(word) or self.word(word)
            start = end
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


_ENCODERS: dict = {}


def _encoder(shared, pattern: str) -> Encoder:
    """One encoder, and so one cache, per worker process and table."""
    ranks = shared.value
    key = (id(ranks), pattern)
    if key not in _ENCODERS or _ENCODERS[key].ranks is not ranks:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks, pattern)
    return _ENCODERS[key]


def ids_digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    source = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    out = T.StructType([source.schema.fields[0], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def step(batch):
        encoder = _encoder(shared, pattern)
        return [batch.column(0), pa.array([encoder.encode(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))]

    return map_batches(source, out, step)


def decode(rows: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, data): the pieces of the ids, concatenated; null ids give no bytes."""
    shared = rows.sparkSession.sparkContext.broadcast({rank: piece for piece, rank in ranks.items()})
    source = rows.select(id_col, ids_col)
    out = T.StructType([source.schema.fields[0], T.StructField("data", T.BinaryType())])

    def step(batch):
        piece = shared.value.__getitem__
        return [batch.column(0), [b"".join(map(piece, ids or [])) for ids in batch.column(1).to_pylist()]]

    return map_batches(source, out, step)


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text, encoded and decoded again in one pass; with the ids if asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    source = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    out = T.StructType([
        source.schema.fields[0], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
        *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []),
    ])

    def step(batch):
        encoder, rows = _encoder(shared, pattern), []
        for text in batch.column(1).to_pylist():
            ids = encoder.encode(text or "")
            digests = (len(ids), ids_digest(ids), hashlib.sha256(encoder.decode(ids)).hexdigest())
            rows.append((*digests, array("i", ids)) if keep_ids else digests)
        columns = [batch.column(0), *map(list, zip(*rows))]
        if keep_ids:
            ends = [0, *accumulate(map(len, columns[4]))]
            values = np.concatenate([np.frombuffer(x, dtype=np.int32) for x in columns[4]]) if ends[-1] else np.zeros(0, dtype=np.int32)
            columns[4] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)).cast(pa.list_(pa.int32()))
        return columns

    return map_batches(source, out, step)


def default_table() -> tuple[dict[bytes, int], str]:
    """Ranks and pattern of the installed multilingual vocabulary."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN
