"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees of a random forest are cut into rules: the conjunction of the comparisons
on the path to each node. A logistic regression with a lasso penalty weighs the rules
and drops most; the rest are compiled into one Spark column expression, so scoring is a
projection over the statistics of whole texts.

The model learns from at most about ``SAMPLE_ROWS`` labelled rows, picked by a hash of
their id and sorted, so that repeated runs fit the same model; every text is scored.

Defined cases: a null or empty text has all statistics zero and is scored like any other.
Rows with a null id are scored but never learned from, null labels are ignored, repeated
rows get equal scores. With labels of one class only, or none, the score is their share
of ones (0.5 without labels). An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.llm.quality_rules import statistics
from marketspark.session import stage

SAMPLE_ROWS = 20_000
TREES, DEPTH, LASSO, SEED = 24, 3, 0.0005, 11
ACCEPT = 0.3

Rule = tuple[tuple[str, float, float], ...]  # (statistic, above, up to) per compared statistic


def features() -> dict[str, Column]:
    """The statistics the rules compare."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"), "lines": F.col("n_lines").cast("double"), "symbol_rate": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / lines, "repeat_share": F.col("n_repeat_words") / words, "word_length": F.col("word_chars") / words,
        "capital_share": F.col("n_capitals") / chars, "words_per_line": F.col("n_words") / lines,
    }


def path_rules(node, names: list[str], bounds: dict[str, tuple[float, float]] | None = None) -> set[Rule]:
    """The conjunctions that lead to the nodes below ``node`` of a fitted tree."""
    found: set[Rule] = set()
    if node.subtreeDepth() == 0:
        return found
    bounds, split = bounds or {}, node.split()
    name, cut = names[split.featureIndex()], float(split.threshold())
    low, high = bounds.get(name, (float("-inf"), float("inf")))
    for child, limits in ((node.leftChild(), (low, min(high, cut))), (node.rightChild(), (max(low, cut), high))):
        inner = {**bounds, name: limits}
        found.add(tuple(sorted((n, a, b) for n, (a, b) in inner.items())))
        found |= path_rules(child, names, inner)
    return found


def compiled(rule: Rule, columns: dict[str, Column]) -> Column:
    """A rule as a boolean column."""
    tests = [columns[n] > a for n, a, _ in rule if a != float("-inf")] + [columns[n] <= b for n, _, b in rule if b != float("inf")]
    return reduce(lambda a, b: a & b, tests)


class RuleEnsemble:
    """Weighted rules and an intercept."""

    def __init__(self, weights: dict[Rule, float], intercept: float):
        self.weights, self.intercept = weights, intercept

    def score(self, columns: dict[str, Column]) -> Column:
        """Chance of label 1, as an expression."""
        total = F.lit(self.intercept)
        for rule, weight in self.weights.items():
            total = total + F.when(compiled(rule, columns), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


class Constant:
    """The share of ones where there is nothing to tell apart."""

    def __init__(self, share: float):
        self.share = share

    def score(self, columns: dict[str, Column]) -> Column:
        return F.lit(self.share)


def fit(labelled: DataFrame) -> RuleEnsemble | Constant:
    """Fit on (id, label, statistics); the rows are few and go into one sorted partition."""
    columns = features()
    names = list(columns)
    rows = labelled.select("id", F.col("label").cast("double").alias("label"), *[c.alias(n) for n, c in columns.items()])
    rows = stage(rows.repartition(1).sortWithinPartitions("id", "label", *names))
    classes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(classes) < 2:
        return Constant(next(iter(classes), 0.5))
    table = VectorAssembler(inputCols=names, outputCol="stats").transform(rows)
    forest = RandomForestClassifier(
        featuresCol="stats", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird", minInstancesPerNode=5
    ).fit(table)
    rules = sorted(set().union(*[path_rules(t._java_obj.rootNode(), names) for t in forest.trees]))
    if not rules:
        return Constant(classes.get(1.0, 0) / sum(classes.values()))
    held = rows.select("label", *[compiled(rule, {n: F.col(n) for n in names}).cast("double").alias(f"r{k}") for k, rule in enumerate(rules)])
    matrix = VectorAssembler(inputCols=held.columns[1:], outputCol="rules").transform(held).select("label", "rules")
    lasso = LogisticRegression(featuresCol="rules", labelCol="label", elasticNetParam=1.0, regParam=LASSO, maxIter=60).fit(stage(matrix))
    weights = {rule: float(w) for rule, w in zip(rules, lasso.coefficients) if abs(w) > 1e-9}
    return RuleEnsemble(weights, float(lasso.intercept))


def part(id_column: Column, parts: int) -> Column:
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(parts))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    counts = stage(statistics(docs.select(F.col(id_col).alias("id"), "text"), "id", "text", ()))
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("label")).where(F.col("label").isNotNull() & (part(F.col("_id"), 5) != 0))
    limit = min(1.0, sample_rows / max(known.count(), 1))
    sample = known.where(F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1_000_000)) < int(1_000_000 * limit))
    model = fit(sample.join(counts, F.col("_id") == F.col("id")))
    return counts.select(
        F.col("id").alias(id_col), F.coalesce(part(F.col("id"), 5) == 0, F.lit(False)).alias("held_out"), model.score(features()).alias("score")
    ).select("*", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
