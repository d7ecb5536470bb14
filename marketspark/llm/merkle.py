"""Merkle manifest of a table, verified leaf by leaf with a recursive query.

Every row is a leaf. The leaves of a group are ordered and every ``FAN_OUT`` consecutive
nodes become their parent until one is left; the groups' roots, ordered by group, become
one root the same way. The levels are stored as node rows linked to their parent. A
recursive query then climbs from every leaf to the root: it appends the siblings on the
way and folds the (possibly tampered) leaf into what should be the root.

Leaves of one run share all their ancestors, so they climb as one row that holds a hash
for each of them and their common siblings once. A node above many leaves is stored in
as many copies as it needs for each copy to meet a bounded number of climbers.

Defined cases: a null column is ``-``. Rows are ordered by id, null first, then by leaf
digest, so repeated rows have equal proofs. A null group comes first. A null id is never
tampered with. A single row is leaf, group root and root, with the proof of no siblings.
An empty table gives no rows. Only the named columns enter a leaf; others are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.operators.ranking import ranked_rows
from marketspark.session import ensure_checkpoint_dir, stage

FAN_OUT = 16
COPY_LEAVES = 4096  # leaves under one copy of a node row
HEX = 64
NODE = ["key", "nth", "n", "digest", "weight", "node", "children", "id", "changed"]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 of the columns, each ``-`` if null, else its length in bytes, a colon and its value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in texts]), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def _linked(nodes: DataFrame, tier: int, level: int) -> DataFrame:
    """``nodes`` of one level with the id of their parent, their place in its run and the copies it is stored in."""
    run = F.floor((F.col("nth") - 1) / FAN_OUT)
    beneath = F.sum("weight").over(Window.partitionBy("key", run))
    return nodes.select(
        *NODE, F.lit(tier).alias("above"), F.concat_ws("/", F.lit(tier), F.lit(level + 1), run.cast("string"), F.col("key")).alias("parent"),
        ((F.col("nth") - 1) % FAN_OUT).cast("int").alias("place"), F.ceil(beneath / COPY_LEAVES).alias("copies"),
    )


def _parents(linked: DataFrame) -> DataFrame:
    """One node row per run of linked nodes; a run holds at most ``FAN_OUT``."""
    run = linked.groupBy("key", "parent").agg(
        F.max(F.floor((F.col("nth") - 1) / FAN_OUT) + 1).alias("nth"), F.max(F.ceil(F.col("n") / FAN_OUT)).alias("n"), F.sum("weight").alias("weight"),
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"])).alias("children"),
    )
    nothing = [F.lit(None).cast(t).alias(c) for c, t in linked.select("id", "changed").dtypes]
    return run.select("key", "nth", "n", F.sha2("children", 256).alias("digest"), "weight", F.col("parent").alias("node"), "children", *nothing)


def _tree(nodes: DataFrame, tier: int) -> tuple[list[DataFrame], DataFrame]:
    """The linked nodes of every level, and the nodes that end alone, one per key."""
    linked, ended, level = [], [], 0
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        ended.append(nodes.where("n = 1"))
        if most <= 1:
            return linked, reduce(DataFrame.unionByName, ended)
        linked.append(stage(_linked(nodes.where("n > 1"), tier, level)))
        nodes, most, level = stage(_parents(linked[-1])), -(-most // FAN_OUT), level + 1


@dataclass(frozen=True)
class Manifest:
    """Leaves and inner nodes, each linked to its parent, as written tables."""

    leaves: DataFrame  # key, id, digest, changed, parent, place, copies
    nodes: DataFrame  # node, copy, tier, digest, children, parent, place, copies

    @property
    def root(self) -> str | None:
        """The digest that stands for the whole table; none for an empty one."""
        found = self.nodes.where("parent IS NULL AND copy = 0").select("digest").union(self.leaves.where("parent IS NULL").select("digest")).first()
        return found[0] if found else None


def build_manifest(
    docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", order: str = "doc_id",
    changed: Column | None = None,
) -> Manifest:
    """Hash every row of ``docs``, build the levels and write them to the session's shared folder.

    ``changed`` is the digest that a reader finds instead of the stored leaf, null where the row is as it was.
    """
    group_text = F.col(group).cast("string")
    rows = docs.select(
        F.when(group_text.isNull(), "").otherwise(F.concat(F.lit("="), group_text)).alias("key"), F.col(order).alias("id"),
        leaf_digest([F.col(c) for c in columns]).alias("digest"), (F.lit(None).cast("string") if changed is None else changed).alias("changed"),
    )
    placed = ranked_rows(rows, ["key"], [F.col("id").asc_nulls_first(), "digest"], "nth", "n")
    blank = [F.lit(None).cast("string").alias(c) for c in ("node", "children")]
    leaves = stage(placed.select("key", "nth", "n", "digest", F.lit(1).cast("long").alias("weight"), *blank, "id", "changed"))
    linked, ends = _tree(leaves, 0)
    ends = ends.drop("nth", "n").withColumnRenamed("key", "group").withColumn("key", F.lit(""))
    above, root = _tree(stage(ranked_rows(ends, ["key"], ["group"], "nth", "n").select(*NODE)), 1)
    top = root.select(*NODE, F.lit(None).cast("int").alias("above"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("long").alias("copies"))
    every = reduce(DataFrame.unionByName, [*linked, *above, top])
    inner = every.where("children IS NOT NULL").select(
        "node", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("weight") / COPY_LEAVES) - 1)).alias("copy"),
        F.substring("node", 1, 1).cast("int").alias("tier"), "digest", "children", "parent", "place", "copies",
    )
    folder = f"{ensure_checkpoint_dir(docs.sparkSession)}/merkle-{uuid4().hex}"
    every.where("children IS NULL").select("id", "digest", "changed", "parent", "place", "copies").write.parquet(f"{folder}/leaves")
    inner.write.parquet(f"{folder}/nodes")
    read = docs.sparkSession.read
    return Manifest(read.parquet(f"{folder}/leaves"), read.parquet(f"{folder}/nodes"))


def _others(children: str, place: str) -> str:
    return f"concat(substr({children}, 1, {HEX} * {place}), substr({children}, {HEX} * {place} + {HEX + 1}))"


def _fold(children: str, place: str, digest: str) -> str:
    return f"sha2(concat(substr({children}, 1, {HEX} * {place}), {digest}, substr({children}, {HEX} * {place} + {HEX + 1})), 256)"


CLIMB = f"""
WITH RECURSIVE climb(run, slot, parent, place, copies, tier, digest, group_root, folded, siblings) AS (
  SELECT run, slot, parent, place, copies, tier, digest, CAST(NULL AS STRING), transform(leaves, x -> {_fold('children', 'x.place', 'coalesce(x.changed, x.digest)')}), ''
  FROM {{runs}}
  UNION ALL
  SELECT c.run, c.slot, n.parent, n.place, n.copies, n.tier, n.digest, CASE WHEN c.tier = 0 AND n.tier = 1 THEN c.digest ELSE c.group_root END,
    transform(c.folded, x -> {_fold('n.children', 'c.place', 'x')}), concat(c.siblings, {_others('n.children', 'c.place')})
  FROM climb c JOIN {{nodes}} n ON n.node = c.parent AND n.copy = pmod(c.slot, c.copies)
)
SELECT run AS at_run, CASE WHEN tier = 0 THEN digest ELSE group_root END AS group_root, digest AS root, folded, siblings FROM climb WHERE parent IS NULL
"""


def verify(manifest: Manifest) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf, by climbing to the root."""
    spark = manifest.leaves.sparkSession
    slot = F.xxhash64("run")
    runs = manifest.leaves.where("parent IS NOT NULL").groupBy(F.col("parent").alias("run")).agg(
        F.array_sort(F.collect_list(F.struct("place", "id", "digest", "changed"))).alias("leaves"), F.first("copies").alias("stored")
    ).withColumn("slot", slot)
    found = runs.join(manifest.nodes, (F.col("run") == F.col("node")) & (F.pmod("slot", "stored") == F.col("copy")))
    started = stage(found.select("run", "slot", "leaves", "children", "tier", "digest", "parent", "place", "copies"))
    names = {"runs": f"runs_{uuid4().hex}", "nodes": f"nodes_{uuid4().hex}"}
    started.createOrReplaceTempView(names["runs"])
    # only nodes above other nodes are climbed to; those of the first level, fifteen of sixteen, are left out
    manifest.nodes.where("tier = 1 OR NOT startswith(node, '0/1/')").createOrReplaceTempView(names["nodes"])
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    try:
        climbed = stage(spark.sql(CLIMB.format(**names)))
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", limit)
        for name in names.values():
            spark.catalog.dropTempView(name)
    leaf = started.join(climbed, F.col("run") == F.col("at_run")).select("children", "group_root", "root", "siblings", F.inline(F.arrays_zip("leaves", "folded")))
    told = leaf.select(
        F.col("leaves.id").alias("id"), F.col("leaves.digest").alias("leaf"), F.coalesce("group_root", "leaves.digest").alias("subroot"), "root",
        F.sha2(F.concat(F.expr(_others("children", "leaves.place")), "siblings"), 256).alias("proof_sha256"), F.col("folded").alias("folded_root"),
    )
    alone = manifest.leaves.where("parent IS NULL").select(
        "id", F.col("digest").alias("leaf"), F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.sha2(F.lit(""), 256).alias("proof_sha256"),
        F.coalesce("changed", "digest").alias("folded_root"),
    )
    return told.unionByName(alone).withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_case(docs: DataFrame, one_in: int = 5) -> Column:
    """The digest of a row with its text lowered, for the ids whose CRC-32 ``one_in`` divides."""
    columns = [lowered(F.col(c).cast("string")) if c == "text" else F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    return F.when(F.crc32(F.col("doc_id").cast("string")) % one_in == 0, leaf_digest(columns))
