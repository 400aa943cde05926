"""Quality: a sparse ensemble of rules over text statistics.

Statistics are column expressions. A forest of shallow trees is fitted to the labelled rows, every
path from a root to a node is a rule (a conjunction of thresholds), a logistic regression with an L1
penalty weighs the rules, and those with a weight are compiled back into one column expression.
Trees and weights are fitted by Spark on all labelled rows; what comes to the driver is the forest,
whose size does not depend on the data.

Contract for odd input: null and empty texts have all statistics zero and are scored by the rules
these meet; a null id is scored and never learned from; labels without id or value are left out, and
of repeated labels of one id the larger counts; with labels of one kind or none, every score is the
share of ones, drawn in by one row of each kind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.components import shared_folder, stored
from factweave.llm.toxicity import labelled

TREES = 12
DEPTH = 3
PENALTY = 0.002
SEED = 7
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"

Rule = tuple[tuple[str, bool, float], ...]  # (statistic, greater, threshold) of each condition


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def statistics(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """id and statistics of every text, and the names of the statistics."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    base = base.withColumns(
        {
            "chars": F.length("text"),
            "words": F.filter(F.split("text", r"[ \t\n\x0b\f\r]+"), lambda w: w != ""),
            "lines": F.filter(F.split("text", "\n"), lambda x: x != ""),
        }
    ).withColumns({"n_words": F.size("words"), "n_lines": F.size("lines")})

    def held(chars: str) -> Column:
        return _share(F.col("chars") - F.length(F.translate("text", chars, "")), F.col("chars"))

    found = {
        "size": F.log1p("chars"),
        "word_length": _share(F.col("chars"), F.col("n_words")),
        "longest_word": F.coalesce(F.array_max(F.transform("words", F.length)), F.lit(0)),
        "different_words": _share(F.size(F.array_distinct("words")), F.col("n_words")),
        "different_lines": _share(F.size(F.array_distinct("lines")), F.col("n_lines")),
        "line_words": _share(F.col("n_words"), F.col("n_lines")),
        "upper": held(_UPPER),
        "digits": held("0123456789"),
        "exclaims": held("!"),
        "bars": held("|"),
        "stops": held("."),
        "commas": held(","),
        "symbols": held("#$%&*+/<=>@\\^_`{}~[]()"),
    }
    return base.select("id", *[c.cast("double").alias(n) for n, c in found.items()]), list(found)


def tree_rules(model, names: list[str]) -> list[Rule]:
    """Every path from a root to another node, once, simplest first. Of several conditions on one
    side of a statistic the tightest is kept."""
    found: set[Rule] = set()

    def walk(node, path: dict[tuple[str, bool], float]) -> None:
        if path:
            found.add(tuple(sorted((n, g, t) for (n, g), t in path.items())))
        if node.getClass().getSimpleName() != "InternalNode":
            return
        name, threshold = names[node.split().featureIndex()], node.split().threshold()
        for greater, child in ((False, node.leftChild()), (True, node.rightChild())):
            before = path.get((name, greater), threshold)
            tight = max(before, threshold) if greater else min(before, threshold)
            walk(child, path | {(name, greater): tight})

    for tree in model.trees:
        walk(tree._call_java("rootNode"), {})
    return sorted(found, key=lambda r: (len(r), r))


def compiled(rule: Rule) -> Column:
    tests = [F.col(n) > t if greater else F.col(n) <= t for n, greater, t in rule]
    return reduce(lambda a, b: a & b, tests)


def fit_rules(rows: DataFrame, names: list[str]) -> tuple[list[tuple[Rule, float]], float]:
    """Weighted rules and the intercept from rows of statistics with a label 0 or 1."""
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        ones, total = counts.get(1, 0) + 1, sum(counts.values()) + 2
        return [], _log_odds(ones / total)
    data = rows.select(array_to_vector(F.array(*names)).alias("features"), F.col("label").cast("double").alias("label"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="0.5", seed=SEED).fit(data)
    rules = tree_rules(forest, names)
    if not rules:
        return [], _log_odds(counts[1] / sum(counts.values()))
    met = F.array(*[compiled(r).cast("double") for r in rules])
    data = rows.select(array_to_vector(met).alias("features"), F.col("label").cast("double").alias("label"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=60).fit(data)
    weights = zip(rules, lasso.coefficients.toArray().tolist(), strict=True)
    return [(r, w) for r, w in weights if w], float(lasso.intercept)


def _log_odds(share: float) -> float:
    import math

    return math.log(share / (1 - share))


def rule_score(rules: list[tuple[Rule, float]], intercept: float) -> Column:
    """The ensemble as one column expression over the statistics."""
    terms = [F.when(compiled(r), F.lit(w)).otherwise(0.0) for r, w in rules]
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(intercept))))


def quality(
    docs: DataFrame, labels: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3
) -> DataFrame:
    """One row per row of the documents: id, score and predicted (1 from the threshold on), then the
    statistics. ``held`` is a condition on the id column of the labels; such rows are not learned from."""
    found, names = statistics(docs, id_col, text_col)
    found = stored(found, shared_folder(docs.sparkSession, "statistics"))
    rules, intercept = fit_rules(found.join(labelled(labels, "quality", held, id_col), "id"), names)
    scored = found.withColumn("score", rule_score(rules, intercept))
    return scored.select("id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *names)
