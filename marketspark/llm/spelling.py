"""Spelling variants: words one edit apart, found by permuterm rotations.

Every word ends in a terminator and is turned to each of its rotations. Where two words
differ by one replaced code point, the rotations that start behind it agree in all but
their last code point; where one has a code point more, its rotation less the last one
is a whole rotation of the other. So rotations sorted by that prefix put near words side
by side, and a scan over the groups emits them. A group holds one word per letter of the
alphabet and the word without the letter, never more, however large the vocabulary is.

A word of more than ``LONG`` code points is named by a digest and its prefixes by a
polynomial hash, so that its rotations need little room and no quadratic time.

Defined cases: a null or empty text has no words; a null id counts as the empty text in
``<id>:``; rows are documents of their own, also if repeated. Equal counts are decided by
code-point order. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketspark.llm.text import LOWER, as_bytes, map_batches, schema_of, word_lists
from marketspark.session import stage

MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
FOLD = 199
LONG = 64
END = "$"
PRIME, BASE = (1 << 127) - 1, 0x9E3779B97F4A7C15F39CC0605CEDC835 % ((1 << 127) - 1)
#: Letters U+00C0 to U+00FF are the byte 0xC3 and one of 0x80 to 0xBF; other lead bytes begin no letter.
FOREIGN = re.compile(rb"[\xC2\xC4-\xF4][\x80-\xBF]+")
BLANKED = bytes(b if 97 <= b <= 122 or 0x80 <= b <= 0xBF or b == 0xC3 else 0x20 for b in LOWER)


def letter_runs(text: bytes) -> Counter:
    """How often each maximal run of letters occurs, A-Z lowered."""
    found: Counter = Counter()
    for words in word_lists(text):
        found.update(FOREIGN.sub(b" ", b" ".join(words)).translate(BLANKED).split())
    return found


def _misspelt(run: bytes, start: int) -> str:
    """The run, less one code point if ``FOLD`` divides the CRC-32 that continues ``start``."""
    h, word = zlib.crc32(run, start), run.decode()
    return word if h % FOLD else word[: h % len(word)] + word[h % len(word) + 1:]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n, name): the words of at least ``min_length`` code points and ``min_count`` occurrences."""

    def step(batch):
        counts: Counter = Counter()
        for key, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            start = zlib.crc32(f"{'' if key is None else key}:".encode())
            for run, n in letter_runs(text).items():
                if len(run) >= min_length and len(word := _misspelt(run, start)) >= min_length:
                    counts[word] += n
        return [list(counts), list(counts.values()), [w if len(w) <= LONG else END + xxhash.xxh3_128_hexdigest(w.encode()) for w in counts]]

    source = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    seen = map_batches(source, schema_of(("word", T.StringType()), ("n", T.LongType()), ("name", T.StringType())), step)
    return seen.groupBy("word").agg(F.sum("n").alias("n"), F.first("name").alias("name")).where(F.col("n") >= min_count)


def rotation_keys(word: str) -> Iterator[tuple[str, str]]:
    """(prefix, last code point) of every rotation of ``word`` and its terminator.

    The rotation as a whole, where the word may be the shorter one, has no last code
    point; that ending in the terminator itself skips no letter and is left out.
    """
    if len(word) <= LONG:
        whole = word + END
        for i in range(len(whole)):
            turned = whole[i:] + whole[:i]
            yield turned, ""
            if i:
                yield turned[:-1], turned[-1]
        return
    # the same prefixes as hashes: those of the parts before and behind the cut, joined by powers of the base
    head, power = [0], [1]
    for c in map(ord, word):
        head.append((head[-1] * BASE + c) % PRIME)
        power.append(power[-1] * BASE % PRIME)
    size = len(word)

    def joined(behind: int, before: int) -> str:
        """``word[behind:] + END + word[:before]``, beyond ``LONG`` letters its hash and length."""
        if size - behind + before <= LONG:
            return word[behind:] + END + word[:before]
        tail = head[size] - head[behind] * power[size - behind]
        return f"{END}{size - behind + 1 + before}:{((tail * BASE + ord(END)) * power[before] + head[before]) % PRIME:x}"

    for i in range(size + 1):
        yield joined(i, i), ""
        if i:
            yield joined(i, i - 1), word[i - 1]


def near_pairs(words: DataFrame) -> DataFrame:
    """(name, near): every two names one edit apart, in both directions, once."""

    def turn(batch):
        names, keys, lasts = [], [], []
        for word, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for key, last in rotation_keys(word):
                names.append(name)
                keys.append(key)
                lasts.append(last)
        return [keys, lasts, names]

    kinds = schema_of(("prefix", T.StringType()), ("last", T.StringType()), ("name", T.StringType()))
    turned = map_batches(words.select("word", "name"), kinds, turn).repartitionByRange("prefix").sortWithinPartitions("prefix", "last")

    def scan(batches):
        held: list[str] = []
        at = None
        for batch in batches:
            one, near = [], []
            for prefix, name in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if prefix != at:
                    at, held = prefix, []
                for other in held:
                    one += (name, other)
                    near += (other, name)
                held.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.string()), pa.array(near, pa.string())], names=["name", "near"])

    return turned.mapInArrow(scan, "name string, near string").where("name <> near").distinct()


def variant_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO
) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word.

    ``form`` is the near word of largest count if that is at least ``ratio`` times the
    word's own; ``root`` is the last form of the chain, along which counts only grow.
    """
    words = stage(vocabulary(docs, id_col, text_col, min_length, min_count))
    named = words.select(F.col("name").alias("near"), F.struct((-F.col("n")).alias("less"), F.col("word").alias("form")).alias("at"))
    best = near_pairs(words).join(named, "near").groupBy("name").agg(F.count(F.lit(1)).alias("n_near"), F.min("at").alias("at"))
    chosen = -F.col("at.less") >= ratio * F.col("n")
    formed = stage(words.join(best, "name", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(chosen, F.col("at.form")).alias("form"), F.when(chosen, -F.col("at.less")).alias("form_n")
    ))
    steps = formed.where("form IS NOT NULL").select(F.col("word").alias("_from"), F.col("form").alias("_to"))
    moving = stage(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    ended = []
    while not moving.isEmpty():
        # counts grow by the ratio with each step, so the chain ends after a few
        hop = stage(moving.join(steps, F.col("root") == F.col("_from"), "left"))
        ended.append(hop.where("_to IS NULL").select("word", "root"))
        moving = hop.where("_to IS NOT NULL").select("word", F.col("_to").alias("root"))
    roots = formed.where("form IS NULL").select("word", F.col("word").alias("root"))
    for part in ended:
        roots = roots.unionByName(part)
    return formed.join(roots, "word")
