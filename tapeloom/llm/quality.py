"""Quality scores by a sparse ensemble of rules over text statistics.

Statistics are Spark column expressions over whole texts.  A forest of small trees is grown on a
bounded, hash-picked sample of labelled rows; every path from a root is one conjunctive rule, and an
L1-penalised logistic regression over the rules keeps a few.  The kept rules compile into one column
expression, so scoring is a projection.

Cases: a null text counts as empty; an empty text has all statistics 0 and is scored; without labels
of both classes the score is the share of good labels (0.5 without any label); repeated rows each
get a row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.shared import discard, durable

#: Labelled rows that are used at most (in expectation); trees, their depth, and the L1 penalty.
SAMPLE, TREES, DEPTH, PENALTY = 20_000, 12, 3, 0.003


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, by name."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    n = F.length(text)
    words = F.array_remove(F.split(text, r"[ \n\t\r]+"), "")
    lines = F.split(text, "\n")

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    return {
        "length": F.log1p(n.cast("double")),
        "words_per_line": share(F.size(words), F.size(lines)),
        "letters_per_word": share(n, F.size(words)),
        "capitals": share(count("[A-Z]++"), F.size(words)),
        "capital_words": share(count("[A-Z]{2,}+"), F.size(words)),
        "symbols": share(count(r"[#$%&*@^~=<>{}\\]++"), F.size(words)),
        "bars": share(count(r"\|"), F.size(words)),
        "exclamations": share(count("!"), F.size(words)),
        "digits": share(count("[0-9]++"), F.size(words)),
        "sentence_ends": share(count(r"[.?!](?=\s|$)"), F.size(words)),
        "distinct_words": share(F.size(F.array_distinct(words)), F.size(words)),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
    }


#: A rule: (statistic, is it above, bound), all of which hold.
Rule = tuple[tuple[str, bool, float], ...]


def _holds(rule: Rule) -> Column:
    condition = F.lit(True)
    for name, above, bound in rule:
        condition &= (F.col(name) > bound) if above else (F.col(name) <= bound)
    return condition


@dataclass
class RuleModel:
    """Rules with weights; the score is the logistic function of their sum."""

    rules: list[tuple[Rule, float]]
    constant: float

    def score(self) -> Column:
        """The score as a column over the statistics."""
        total = F.lit(float(self.constant))
        for rule, weight in self.rules:
            total += F.when(_holds(rule), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def tree_rules(description: str, names: list[str]) -> set[Rule]:
    """The rules of all paths of a forest, from its printed form."""
    rules: set[Rule] = set()
    path: list[tuple[int, tuple[str, bool, float]]] = []
    for line in description.splitlines():
        depth = len(line) - len(line.lstrip())
        if found := re.match(r"\s*(?:If|Else) \(feature (\d+) (<=|>) ([-\d.Ee+]+)\)", line):
            while path and path[-1][0] >= depth:
                path.pop()
            path.append((depth, (names[int(found[1])], found[2] == ">", float(found[3]))))
            rules.add(tuple(sorted({step for _, step in path})))
        elif re.match(r"\s*Tree \d+", line):
            path = []
    return rules


def fit(labelled: DataFrame, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> RuleModel:
    """Learn from labelled (text, label 0 or 1); about sample rows, picked by a hash, are used.

    The hash is over all columns of labelled: with a name of the row among them, copies of one text
    are drawn one by one.
    """
    rows = labelled.where("label in (0, 1)")
    sizes = rows.agg(F.count("*").alias("n"), F.sum("label").alias("good")).first()
    n, good = sizes["n"], sizes["good"] or 0
    if not n or good in (0, n):
        share = good / n if n else 0.5
        return RuleModel([], 30.0 if share == 1 else -30.0 if share == 0 else math.log(share / (1 - share)))
    bound = int(min(1.0, sample / n) * (1 << 30))
    picked = rows.where(F.pmod(F.xxhash64(*rows.columns, F.lit(5)), F.lit(1 << 30)) < bound)
    stats = statistics(F.col("text"))
    table = durable(picked.select(F.col("label").cast("double").alias("label"), *(c.alias(k) for k, c in stats.items())), "statistics")
    names = list(stats)
    points = VectorAssembler(inputCols=names, outputCol="features").transform(table).select("label", "features", *names)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=17, featureSubsetStrategy="onethird").fit(points)
    rules = sorted(tree_rules(forest.toDebugString, names))
    if not rules:
        return RuleModel([], math.log(good / (n - good)))
    flags = F.array(*(_holds(r).cast("double") for r in rules))
    from pyspark.ml.functions import array_to_vector

    marked = points.select("label", array_to_vector(flags).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(marked)
    weights = lasso.coefficients.toArray()
    discard(table)
    return RuleModel([(r, float(w)) for r, w in zip(rules, weights, strict=True) if w], float(lasso.intercept))


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, label of about sample labelled documents of docs, picked by a hash of doc_id.

    They are picked from labels (doc_id, label) that have a document, so texts are never shuffled:
    the picked labels are broadcast. Copies of a text are drawn one by one.
    """
    known = labels.where("label in (0, 1)").join(docs.select("doc_id"), "doc_id", "left_semi")
    bound = int(min(1.0, sample / max(known.count(), 1)) * (1 << 30))
    picked = known.where(F.pmod(F.xxhash64("doc_id", "label", F.lit(5)), F.lit(1 << 30)) < bound)
    return docs.select("doc_id", "text").join(F.broadcast(picked.select("doc_id", "label")), "doc_id")


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """doc_id, score (0 to 1), predicted (0 or 1) of every whole text of docs."""
    stats = statistics(F.col("text"))
    table = docs.select("doc_id", F.col("text").cast("string").alias("text")).select("doc_id", *(c.alias(k) for k, c in stats.items()))
    scored = table.select("doc_id", model.score().alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
