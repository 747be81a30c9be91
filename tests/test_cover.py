"""The cover-density rank against a search over all runs of a text."""

import random

from pyspark.sql import functions as F

from brindle.functions import terms


def _searched(words, asked):
    has = lambda i, j: set(asked) <= set(words[i : j + 1])
    total = 0.0
    for j in range(len(words)):
        for i in range(j + 1):
            if asked and has(i, j) and not has(i + 1, j) and not has(i, j - 1):
                total += 0.1 / (j - i + 2 - sum(w in asked for w in words[i : j + 1]))
    return round(total, 9)


def _ranks(spark, rows):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, w array<string>, q array<string>")
    return [r["rank"] for r in frame.select("i", terms.rank_cover(F.col("w"), F.col("q")).alias("rank")).orderBy("i").collect()]


def test_rank_equals_a_search_of_all_runs(spark):
    rng = random.Random(5)
    rows = [([rng.choice("abcdexyz") for _ in range(rng.randrange(45))], rng.sample("abcd", rng.randrange(5))) for _ in range(200)]
    found = _ranks(spark, rows)
    assert all(abs(r - _searched(*row)) < 1e-8 for r, row in zip(found, rows)) and sum(r > 0 for r in found) > 50


def test_near_words_rank_above_far_ones_and_nothing_ranks_zero(spark):
    near, far, lacking, empty, unasked, long = _ranks(spark, [
        (["a", "b", "x", "x"], ["a", "b"]), (["a", "x", "x", "b"], ["a", "b"]), (["a", "a"], ["a", "b"]), ([], ["a"]), (["a"], []), (["a"] + ["x"] * 30_000 + ["b", "a"], ["a", "b"]),
    ])
    assert (near, far, lacking, empty, unasked) == (0.1, round(0.1 / 3, 9), 0.0, 0.0, 0.0)
    assert abs(long - (0.1 / 30_001 + 0.1)) < 1e-8
