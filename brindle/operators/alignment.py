"""Alignment of gold and predicted items, one to one, by evidence, topic or key."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aligned(gold: DataFrame, predicted: DataFrame, case: str, order: str, by: dict[str, int]) -> DataFrame:
    """Pairs (case, gold, predicted, score): each gold item in its order takes the best item still free.

    Both frames have `case`, `order` (distinct within a case) and the text columns of `by`, which score a
    pair by the best of the columns that are given and equal; of equal scores the earlier item is better.

    What one item takes depends on those before, so the items of a case meet in one task.  They are gone
    through once: per column and value the predictions wait in a queue in their order, so time and memory
    grow with the items of a case, not with its pairs.
    """
    names = sorted(by, key=lambda c: -by[c])
    row = lambda frame, is_gold: frame.select(F.col(case).alias("case"), F.lit(is_gold).alias("is_gold"), F.col(order).alias("place"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"v{i}") for i, c in enumerate(names)])
    scores = [by[c] for c in names]

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        queues, taken, out = {}, set(), []
        ordered = group.sort_values("place")
        values = [f"v{i}" for i in range(len(scores))]
        for item in ordered[~ordered["is_gold"]].to_dict("records"):
            for i, v in enumerate(values):
                if item[v]:
                    queues.setdefault((i, item[v]), deque()).append(item["place"])
        for item in ordered[ordered["is_gold"]].to_dict("records"):
            for i, v in enumerate(values):
                queue = queues.get((i, item[v]), ())
                while queue and queue[0] in taken:
                    queue.popleft()
                if queue:
                    taken.add(queue[0])
                    out.append((item["case"], item["place"], queue.popleft(), scores[i]))
                    break
        return pd.DataFrame(out, columns=["case", "gold", "predicted", "score"])

    kind, at = gold.schema[case].dataType.simpleString(), gold.schema[order].dataType.simpleString()
    return row(gold, True).unionByName(row(predicted, False)).groupBy("case").applyInPandas(pick, f"case {kind}, gold {at}, predicted {at}, score int")


def confusion(pairs: DataFrame, gold: DataFrame, predicted: DataFrame, case: str, order: str, kind: str) -> DataFrame:
    """Counts of (gold kind, predicted kind) over the pairs; items without a partner count against null."""
    g = gold.select(F.col(case).alias("case"), F.col(order).alias("gold"), F.col(kind).alias("gold_kind"))
    p = predicted.select(F.col(case).alias("case"), F.col(order).alias("predicted"), F.col(kind).alias("predicted_kind"))
    rows = pairs.select("case", "gold", "predicted").join(g, ["case", "gold"], "full").join(p, ["case", "predicted"], "full")
    return rows.groupBy("gold_kind", "predicted_kind").agg(F.count(F.lit(1)).alias("n"))
