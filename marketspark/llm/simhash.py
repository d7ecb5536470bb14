"""Near duplicates by SimHash, found with a generalised pigeonhole search.

The 64 bits are grouped into partitions of correlated bits. If the radii allowed per
partition add up to ``max_distance - partitions + 1``, two fingerprints within
``max_distance`` bits agree within the radius of some partition. Each fingerprint
gets its own unequal radii (a partition may be skipped) by dynamic programming on
candidate counts estimated from a bounded sample; the sample steers cost only, every
fingerprint is indexed and probed.

Defined cases: a null or empty text has no words and fingerprint zero, linked like any
other. Repeated rows share a fingerprint. A null id never names a component; if all
ids of a component are null, so is its name. An empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from marketspark.llm.decontamination import shingle_hashes
from marketspark.llm.text import LOWER, as_bytes, free_name, map_batches, schema_of, shingles, word_lists
from marketspark.operators.graph import connected_components
from marketspark.session import bounded_broadcast, stage

BITS = 64
MAX_RADIUS = 3
REACH = 16
SAMPLE_ROWS = 2048
BLOCK = 256  # texts compared with each other in one place
SAMPLE_TEXTS, SAMPLE_PART, HELD_BACK = 4096, 64, 100_000  # which shingles stand last in the exact search: cost only
CROWDED = 1024  # texts of one hash that meet all its others in one place
PROBE_COST, CANDIDATE_COST = 1.0, 0.05  # a probe row is shuffled, a candidate only compared


def fingerprint(text: bytes, width: int, distinct: bool) -> int:
    """64 bits, each set where over half of the shingles' hashes (XXH64, seed 42) have it; no words: zero."""
    counts, total, seen = np.zeros(BITS, dtype=np.int64), 0, set()
    for run in shingles(text.translate(LOWER), width):
        if distinct:
            run = set(run) - seen
            seen |= run
        for start in (0,) if len(run) <= 1 << 16 else range(0, len(run), 1 << 16):
            part = run if len(run) <= 1 << 16 else list(run)[start:start + (1 << 16)]
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(42)), dtype=">u8", count=len(part))
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            total += len(part)
    return int(np.packbits(counts * 2 > total).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distinct: bool = False) -> DataFrame:
    """(id, fp) for every row; ``fp`` holds the 64 bits as a signed long."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = schema_of(("id", source.schema["id"].dataType), ("fp", T.LongType()))
    return map_batches(source, out, lambda b: [b.column(0), [fingerprint(t, width, distinct) for t in as_bytes(b.column(1))]])


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1]


def _co_occurrence(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many of them set bits i and j; summed per task, then over all."""

    def run(batches):
        gram, rows = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy()).astype(np.float32)
            gram += bits.T @ bits
            rows += len(bits)
        i, j = np.divmod(np.arange(BITS * BITS + 1), BITS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.append(gram.ravel(), rows).astype(np.int64))], names=["i", "j", "n"]
        )

    sums = prints.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    gram, rows = np.zeros((BITS, BITS)), 0
    for i, j, n in sums:
        if i < BITS:
            gram[i, j] = n
        else:
            rows = n
    return rows, gram


def correlated_groups(gram: np.ndarray, rows: int, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups of nearly equal size, each grown by the bit most correlated with it."""
    mean = np.diag(gram) / max(rows, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    correlation = np.abs((gram / max(rows, 1) - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(correlation, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        order = sorted(left)
        group = [max(order, key=lambda b: (correlation[b, order].max(), -b))]
        left.discard(group[0])
        while len(group) < size:
            best = max(sorted(left), key=lambda b: (correlation[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


class Allocation:
    """Partitions, the flips of each radius, and the sample that candidate counts are estimated from."""

    def __init__(self, groups: list[list[int]], sample: np.ndarray, rows: int, distance: int):
        self.masks = np.array([_mask(g) for g in groups], dtype=np.uint64)
        self.sample, self.scale, self.distance = sample.astype(np.int64).view(np.uint64), rows / max(len(sample), 1), distance
        self.steps = min(distance, MAX_RADIUS) + 2  # a step above the radius; step 0 skips the partition
        self.flips = [
            [np.array([_mask(c) for r in range(radius + 1) for c in combinations(g, r)], dtype=np.uint64) for radius in range(self.steps - 1)]
            for g in groups
        ]

    def costs(self, prints: np.ndarray) -> np.ndarray:
        """Estimated cost of each fingerprint, partition and step."""
        out = np.zeros((len(prints), len(self.masks), self.steps))
        for i, mask in enumerate(self.masks):
            near = np.bitwise_count((prints[:, None] ^ self.sample[None, :]) & mask)
            for step in range(1, self.steps):
                out[:, i, step] = PROBE_COST * len(self.flips[i][step - 1]) + CANDIDATE_COST * self.scale * (near < step).sum(1)
        return out

    def choose(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Steps per fingerprint and partition of least total cost that add up to ``distance + 1``, and that cost."""
        costs, need = self.costs(prints), self.distance + 1
        best = np.full((len(prints), need + 1), np.inf)
        best[:, 0] = 0
        picked = []
        for i in range(len(self.masks)):
            options = np.full((len(prints), need + 1, self.steps), np.inf)
            for step in range(min(self.steps, need + 1)):
                options[:, step:, step] = best[:, : need + 1 - step] + costs[:, i, step][:, None]
            picked.append(options.argmin(2))
            best = options.min(2)
        steps, left = np.zeros((len(prints), len(self.masks)), dtype=np.int64), np.full(len(prints), need)
        for i in reversed(range(len(self.masks))):
            steps[:, i] = picked[i][np.arange(len(prints)), left]
            left = left - steps[:, i]
        return steps, best[:, need]

    def probes(self, prints: np.ndarray) -> tuple[np.ndarray, ...]:
        """(partition, value, row of the fingerprint) of every signature to look up."""
        steps, _ = self.choose(prints)
        parts, values, owners = [], [], []
        for i, mask in enumerate(self.masks):
            for step in range(1, self.steps):
                rows = np.flatnonzero(steps[:, i] == step)
                flips = self.flips[i][step - 1]
                values.append(((prints[rows] & mask)[:, None] ^ flips[None, :]).ravel())
                owners.append(np.repeat(rows, len(flips)))
                parts.append(np.full(len(rows) * len(flips), i, dtype=np.int32))
        return np.concatenate(parts), np.concatenate(values).view(np.int64), np.concatenate(owners)


def plan_search(prints: DataFrame, distance: int, sample_rows: int = SAMPLE_ROWS) -> Allocation:
    """Partitions and radii for ``prints``: correlations over all of them, costs from ``sample_rows`` taken in hash order."""
    rows, gram = _co_occurrence(prints)
    sample = np.array([r.fp for r in prints.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample_rows).collect()], dtype=np.int64)
    fewest = max(1, math.ceil((distance + 1) / (min(distance, MAX_RADIUS) + 1)))
    plans = [Allocation(correlated_groups(gram, rows, m), sample, rows, distance) for m in range(max(fewest, 2), distance + 2)] or [
        Allocation(correlated_groups(gram, rows, 1), sample, rows, distance)
    ]
    tried = plans[0].sample[:256]
    return min(plans, key=lambda p: (p.choose(tried)[1].mean() if len(tried) else 0) + len(p.masks))


def _neighbour_links(nodes: DataFrame, distance: int, second: int) -> DataFrame:
    """Links between nodes up to ``REACH`` places apart in four rotated sort orders: a bounded number a node, however dense a group is."""
    turned = F.array(*[
        F.struct(F.lit(k).alias("turn"), (F.shiftleft("fp", 16 * k).bitwiseOR(F.shiftrightunsigned("fp", BITS - 16 * k)) if k else F.col("fp")).alias("at"))
        for k in range(4)
    ])
    ordered = nodes.select("node", "fp", "fp2", F.inline(turned)).repartitionByRange("turn", "at").sortWithinPartitions("turn", "at").select("turn", "node", "fp", "fp2")

    def run(batches):
        last = [np.zeros(0, dtype=np.int64)] * 4
        for batch in batches:
            seen = len(last[0])
            turn, node, fp, fp2 = (np.concatenate([a, b.to_numpy()]) for a, b in zip(last, batch.columns))
            for step in range(1, REACH + 1):
                right = np.arange(max(seen, step), len(node))
                left = right - step
                near = (turn[left] == turn[right]) & (np.bitwise_count((fp[left] ^ fp[right]).view(np.uint64)) <= distance)
                near &= np.bitwise_count((fp2[left] ^ fp2[right]).view(np.uint64)) <= second
                yield pa.RecordBatch.from_arrays([pa.array(node[left[near]]), pa.array(node[right[near]])], names=["a", "b"])
            last = [x[-REACH:] for x in (turn, node, fp, fp2)]

    return ordered.mapInArrow(run, "a long, b long")


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    named = labels.select(F.col("node").alias("_node"), F.col("component").alias("_named"))
    return nodes.join(named, F.col("label") == F.col("_node"), "left").withColumn("label", F.coalesce("_named", "label")).drop("_node", "_named")


def linked_nodes(nodes: DataFrame, distance: int, second: int = BITS) -> DataFrame:
    """(node, fp, fp2, label): equal labels where a chain of links joins nodes.

    Two nodes are linked if ``fp`` differs in at most ``distance`` bits and ``fp2`` in at
    most ``second``. Dense groups are first contracted along sorted orders, so the exact
    search after it returns only pairs that still join two groups and never all pairs
    within one.
    """
    first = connected_components(_neighbour_links(nodes, distance, second), "a", "b")
    base = stage(_labelled(nodes.select("node", "fp", "fp2", F.col("node").alias("label")), first))
    plan = plan_search(nodes.select("fp").distinct(), distance)
    masks = [_signed(int(m)) for m in plan.masks]
    index = base.select(
        F.col("node").alias("b"), F.col("fp").alias("fp_b"), F.col("fp2").alias("fp2_b"), F.col("label").alias("label_b"),
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("part", "value"),
    )
    probes = schema_of(("part", T.IntegerType()), *[(c, T.LongType()) for c in ("value", "a", "fp_a", "fp2_a", "label_a")])

    def run(batches):
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            for start in range(0, batch.num_rows, 1024):
                node, fp, fp2, label = (c[start:start + 1024] for c in columns)
                part, value, row = plan.probes(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (part, value, node[row], fp[row], fp2[row], label[row])], names=probes.names)

    pairs = base.select("node", "fp", "fp2", "label").mapInArrow(run, probes).join(index, ["part", "value"]).where(
        (F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b"))
        & (_distance(F.col("fp_a"), F.col("fp_b")) <= distance) & (_distance(F.col("fp2_a"), F.col("fp2_b")) <= second)
    )
    joined = connected_components(pairs.select("label_a", "label_b").distinct(), "label_a", "label_b")
    return _labelled(base, joined)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_distance: int = 4, distinct: bool = False) -> DataFrame:
    """(id, fingerprint, component_id) for every row: the smallest id reachable over links of at most ``max_distance`` bits."""
    rows = stage(fingerprints(docs, id_col, text_col, width, distinct))
    prints = stage(rows.groupBy("fp").agg(F.min("id").alias("least")))
    nodes = prints.select(F.col("fp").alias("node"), "fp", F.lit(0).cast("long").alias("fp2"))
    labels = stage(linked_nodes(nodes, max_distance).select("fp", "label"))
    named = prints.join(labels, "fp")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_print = named.select("fp", "label").join(least, "label").select(F.col("fp").alias("_fp"), "label", "component_id")
    return rows.join(by_print, F.col("fp") == F.col("_fp")).select(
        F.col("id").alias(id_col), hex_digits(F.col("fp")).alias("fingerprint"), "component_id", "label", "fp"
    )


def _normal_key(text: bytes) -> str:
    """Digest of the lower-cased words in order: equal for texts that differ in case of A-Z and spacing only."""
    digest = xxhash.xxh3_128()
    for words in word_lists(text.translate(LOWER)):
        digest.update(b" ".join(words) + b" ")
    return digest.hexdigest()


def _central(members: DataFrame, count: int) -> DataFrame:
    """(label, key): of every label the ``count`` members nearest to the majority of its bits."""
    bit = [F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1).cast("long")) for i in range(BITS)]
    votes = members.groupBy("label").agg(F.count(F.lit(1)).alias("votes"), *[F.sum(b).alias(f"b{i}") for i, b in enumerate(bit)])
    centre = F.lit(0).cast("long")
    for i in range(BITS):
        centre = centre.bitwiseOR(F.when(2 * F.col(f"b{i}") > F.col("votes"), F.lit(_signed(1 << i))).otherwise(F.lit(0).cast("long")))
    centred = members.join(votes.select(F.col("label").alias("_label"), centre.alias("centre")), F.col("label") == F.col("_label"))
    nearest = W.partitionBy("label").orderBy(_distance(F.col("fp"), F.col("centre")), "key")
    return centred.withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= count).select("label", "key")


def _spanning_links(asked: DataFrame, grams: DataFrame, min_jaccard: float) -> DataFrame:
    """(a, b): links that join all members of each (label, job) between which chains of alike texts run.

    ``asked`` holds (label, job, key, asks): texts that ask are compared with all texts of
    their job. A job holds a bounded number of texts, and a text is not compared with a
    cluster that it already belongs to.
    """

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["asks", "key"], ascending=[False, True]).drop_duplicates("key")
        keys, asks, sets = list(rows["key"]), list(rows["asks"]), [np.asarray(g) for g in rows["grams"]]
        home, links = list(range(len(keys))), []

        def root(k):
            while home[k] != k:
                home[k] = home[home[k]]
                k = home[k]
            return k

        for i in range(1, len(keys)):
            for j in range(i):
                small, large = sorted((len(sets[i]), len(sets[j])))
                if not (asks[i] or asks[j]) or small == 0 or small < min_jaccard * large or root(i) == root(j):
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= min_jaccard * (small + large - both):
                    links.append((keys[i], keys[j]))
                    home[root(i)] = root(j)
        return pd.DataFrame(links, columns=["a", "b"])

    held = asked.join(grams.select(F.col("key").alias("_key"), "grams"), F.col("key") == F.col("_key")).select("label", "job", "key", "asks", "grams")
    return held.groupBy("label", "job").applyInPandas(compare, "a string, b string")


def _alike(members: DataFrame, grams: DataFrame, min_jaccard: float) -> DataFrame:
    """(node, component) of the members of labels that are joined by chains of alike texts.

    First every block of a label meets the label's most central texts, which joins nearly
    all of a dense group at once and all of a small one. Only texts of labels of several
    blocks that this leaves outside their label's largest cluster then meet every block;
    two texts of one cluster need no comparison.
    """
    sizes = members.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = members.join(sizes.select(F.col("label").alias("_label"), "blocks"), F.col("label") == F.col("_label")).select(
        "label", "key", "blocks", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block")
    )
    placed = stage(placed)
    central = _central(members, BLOCK).join(sizes, "label").select("label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1).cast("array<string>")).alias("job"), "key", F.lit(True).alias("asks"))
    asked = placed.select("label", F.col("block").cast("string").alias("job"), "key", F.lit(False).alias("asks")).unionByName(central)
    links = stage(_spanning_links(asked, grams, min_jaccard))
    clusters = stage(connected_components(links, "a", "b"))

    large = placed.where("blocks > 1").join(clusters.select(F.col("node").alias("_key"), "component"), F.col("key") == F.col("_key"), "left").withColumn(
        "component", F.coalesce("component", "key")
    )
    weights = large.groupBy("label", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = weights.groupBy("label").agg(F.max_by("component", F.struct("n", "component")).alias("largest")).select(F.col("label").alias("_in"), "largest")
    outside = stage(large.join(largest, F.col("label") == F.col("_in")).where("component <> largest").select("label", "key", "blocks", "block"))
    if outside.isEmpty():
        return clusters
    slices = outside.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("slices"))
    one = outside.join(slices, "label").select(
        "label", F.pmod(F.xxhash64("key"), F.col("slices").cast("long")).alias("slice"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at"), "key", F.lit(True).alias("asks")
    )
    other = placed.join(slices, "label").select(
        "label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices").cast("long") - 1)).alias("slice"), F.col("block").alias("at"), "key", F.lit(False).alias("asks")
    )
    asked = one.unionByName(other).select("label", F.concat_ws("/", "slice", "at").alias("job"), "key", "asks")
    return connected_components(links.unionByName(_spanning_links(asked, grams, min_jaccard)), "a", "b")


def _frequent(sample: DataFrame, width: int) -> np.ndarray:
    """The shingle hashes that several texts of ``sample`` hold, the ``HELD_BACK`` most frequent at most."""

    def hashes(batch):
        return [np.concatenate([shingle_hashes(t, width) for t in as_bytes(batch.column(0))] or [np.zeros(0, dtype=np.uint64)]).view(np.int64)]

    counts = map_batches(sample, schema_of(("gram", T.LongType())), hashes).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    found = counts.where("n > 1").orderBy(F.desc("n"), "gram").limit(HELD_BACK).select("gram").toArrow()
    return np.unique(found.column(0).to_numpy().view(np.uint64))


def _prefixes(source: DataFrame, last: np.ndarray, min_jaccard: float, width: int) -> DataFrame:
    """(key, size, grams): of every text the shingle hashes of which any text as similar as ``min_jaccard`` holds one.

    Two such texts share more shingles than either has outside its prefix, so their
    prefixes meet in any order of shingles that all texts keep. That of the hash is taken,
    with the hashes ``last`` after all others.
    """

    def prefix(text: bytes) -> tuple[int, np.ndarray]:
        found = shingle_hashes(text, width)
        behind = last[np.minimum(np.searchsorted(last, found), len(last) - 1)] == found if len(last) else np.zeros(len(found), dtype=bool)
        count = len(found) - math.ceil(min_jaccard * len(found) - 1e-9) + 1 if len(found) else 0
        return len(found), np.concatenate([found[~behind], found[behind]])[:count].view(np.int64)

    def step(batch):
        texts = as_bytes(batch.column(0))
        made = [prefix(t) for t in texts]
        return [[_normal_key(t) for t in texts], [m[0] for m in made], [m[1] for m in made]]

    return map_batches(source.select("text"), schema_of(("key", T.StringType()), ("size", T.LongType()), ("grams", T.ArrayType(T.LongType()))), step)


def _missed_pairs(source: DataFrame, clusters: DataFrame, texts: int, min_jaccard: float, width: int) -> DataFrame:
    """(a, b): texts of different clusters whose prefixes meet; holds every such pair as similar as ``min_jaccard``.

    The prefixes are made and dealt out by hash once, four longs a row. A hash that only one
    cluster holds makes no pair, so a dense group that is joined already costs nothing.
    Hashes that a sample shows to be frequent stand last in the order and so seldom in a
    prefix; what many texts still share is split into blocks.
    """
    sample = source.where(F.pmod("h", F.lit(max(1, min(texts // SAMPLE_TEXTS, SAMPLE_PART)))) == 0).dropDuplicates(["h"]).select("text")
    made = _prefixes(source, _frequent(sample, width), min_jaccard, width).dropDuplicates(["key"])
    named = clusters.select(F.col("node").alias("_node"), "component")
    placed = F.shiftleft("size", 32).bitwiseOR(F.col("at").cast("long"))
    # a text outside all clusters is its own home: a null takes no room in the shuffle
    rows = made.join(named, F.col("key") == F.col("_node"), "left").select(
        F.xxhash64("key").alias("text"), F.when(F.col("component").isNotNull(), F.xxhash64("component")).alias("home"), "size", F.posexplode("grams").alias("at", "gram")
    ).select("gram", "text", "home", placed.alias("place")).repartition("gram")
    one = W.partitionBy("gram")
    homed = rows.withColumn("home", F.coalesce("home", "text"))
    shared = homed.select("*", F.min("home").over(one).alias("_one"), F.max("home").over(one).alias("_other"), F.count(F.lit(1)).over(one).alias("n")).where("_one <> _other")
    met = stage(shared.select("gram", "text", "home", "place", F.ceil(F.col("n") / CROWDED).alias("blocks")))
    each = met.select("gram", "blocks", "text", "home", F.shiftright("place", 32).alias("size"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).alias("at"))
    block = {"a": F.pmod("text", F.col("blocks")), "b": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))}
    a, b = (each.select("gram", block[side].alias("block"), *[F.col(c).alias(f"{c}_{side}") for c in ("text", "home", "size", "at")]) for side in "ab")
    larger, smaller = F.greatest("size_a", "size_b"), F.least("size_a", "size_b")
    near = (F.col("text_a") < F.col("text_b")) & (F.col("home_a") != F.col("home_b")) & (smaller >= min_jaccard * larger - 1e-6)
    both = a.join(b, ["gram", "block"]).where(near).groupBy("text_a", "text_b").agg(
        F.count(F.lit(1)).alias("shared"), *[F.min(c).alias(c) for c in ("size_a", "size_b", "at_a", "at_b")])
    # what two texts share they share in both prefixes or behind the end of the one that ends first, and nothing before the first shared hash
    needed = min_jaccard / (1 + min_jaccard) * (F.col("size_a") + F.col("size_b")) - 1e-6
    behind = F.greatest(*[F.ceil(min_jaccard * F.col(c) - 1e-9) - 1 for c in ("size_a", "size_b")])
    rest = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
    return both.where((F.col("shared") + behind >= needed) & (rest >= needed)).select("text_a", "text_b")


def _verified(pairs: DataFrame, grams: DataFrame, min_jaccard: float) -> DataFrame:
    """The pairs whose shingles are as similar as ``min_jaccard``."""
    one, other = (grams.select(F.col("key").alias(f"key_{side}"), F.col("grams").alias(f"grams_{side}")) for side in "ab")
    both = pairs.join(one, F.col("a") == F.col("key_a")).join(other, F.col("b") == F.col("key_b")).select("a", "b", "grams_a", "grams_b")

    def run(batches):
        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                shared = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(shared >= min_jaccard * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return both.mapInArrow(run, "a string, b string")


def without_near_duplicates(
    docs: DataFrame, max_distance: int = 8, max_second: int = 16, min_jaccard: float = 0.8, width: int = 5
) -> DataFrame:
    """One document of each group of near copies, that with the smallest id; columns stay as they are.

    Candidates are linked by SimHash over the distinct words, which near copies change
    little, and by a second one over ``width``-word shingles, which unrelated texts never
    share. They are verified by the Jaccard similarity of their ``width``-word shingles.
    That joins dense groups cheaply; pairs beyond the distances, such as cut or extended
    copies, are then found exactly by the shingles that similar texts must share. Texts of equal words are one text from the start. Of rows repeated as a whole one
    stays; a null id counts as the largest.
    """
    text = F.col("text").cast("string")
    source = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    out = T.StructType(source.schema.fields[:2] + schema_of(("fp", T.LongType()), ("fp2", T.LongType()), ("key", T.StringType())).fields)

    def prints(batch):
        texts = as_bytes(batch.column(2))
        return [
            batch.column(0), batch.column(1), [fingerprint(t, 1, True) for t in texts], [fingerprint(t, width, False) for t in texts], [_normal_key(t) for t in texts]
        ]

    rows = stage(map_batches(source, out, prints))
    rep = F.min(F.struct(F.col("id").isNull().alias("lost"), "id", "h")).alias("rep")
    texts = stage(rows.groupBy("key", "fp", "fp2").agg(rep))
    nodes = stage(texts.select(F.xxhash64("fp", "fp2").alias("node"), "fp", "fp2").distinct())
    labels = stage(linked_nodes(nodes, max_distance, max_second).select("node", "label"))
    labelled = texts.join(labels, F.xxhash64("fp", "fp2") == F.col("node")).select("key", "fp", "rep", "label")
    crowded = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("label").alias("_label"))
    members = stage(labelled.join(crowded, F.col("label") == F.col("_label"), "left_semi"))

    gram_rows = schema_of(("key", T.StringType()), ("grams", T.ArrayType(T.LongType())))

    def grams_of(keyed: DataFrame) -> DataFrame:
        wanted = bounded_broadcast(keyed.select("key", F.col("rep.id").alias("_id"), F.col("rep.h").alias("_h")))
        held = source.join(wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select("key", "text")
        return stage(
            map_batches(held, gram_rows, lambda b: [b.column(0), [shingle_hashes(t, width).view(np.int64) for t in as_bytes(b.column(1))]]).dropDuplicates(["key"])
        )

    clusters = stage(_alike(members, grams_of(members), min_jaccard).select("node", "component"))
    keys = texts.select(F.xxhash64("key").alias("text"), "key")
    a, b = (keys.select(F.col("text").alias(f"text_{side}"), F.col("key").alias(side)) for side in "ab")
    pairs = stage(_missed_pairs(source, clusters, texts.count(), min_jaccard, width).join(a, "text_a").join(b, "text_b").select("a", "b"))
    asked = texts.join(bounded_broadcast(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()), "key", "left_semi")
    links = stage(_verified(pairs, grams_of(asked), min_jaccard))
    if not links.isEmpty():
        clusters = connected_components(links.unionByName(clusters.select(F.col("node").alias("a"), F.col("component").alias("b"))), "a", "b")
    clusters = clusters.select(F.col("node").alias("_node"), "component")
    grouped = texts.join(clusters, F.col("key") == F.col("_node"), "left").groupBy(F.coalesce("component", "key").alias("group")).agg(F.min("rep").alias("rep"))
    kept = grouped.select(F.col("rep.id").alias("_id"), F.col("rep.h").alias("_h"), F.lit(True).alias("_kept"))
    counted = rows.groupBy("id", "h").agg(F.count(F.lit(1)).alias("n"))
    told = counted.join(kept, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    id_name, h_name = free_name(docs, "_id"), free_name(docs, "_h")
    exceptions = stage(told.where("_kept IS NULL OR n > 1").select(F.col("id").alias(id_name), F.col("h").alias(h_name), F.col("_kept").isNull().alias("_gone")))

    same = F.col("doc_id").eqNullSafe(F.col(id_name)) & (F.xxhash64(text) == F.col(h_name))
    single = docs.join(bounded_broadcast(exceptions.drop("_gone")), same, "left_anti")
    repeated = exceptions.where("NOT _gone").drop("_gone")
    if repeated.isEmpty():
        return single
    return single.unionByName(docs.join(bounded_broadcast(repeated), same, "left_semi").dropDuplicates(["doc_id", "text"]))
