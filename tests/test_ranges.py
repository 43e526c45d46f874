"""Overlapping rules against trying them in order."""

import random

from pyspark.sql import functions as F

from pagewright.operators import ranges


def found(spark, rules, numbers, payload=("name",)):
    rules = spark.createDataFrame(rules, "lo bigint, hi bigint, ord int, name string")
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "i int, n bigint")
    return [r["name"] for r in ranges.first_match(rows, "n", rules, list(payload)).orderBy("i").collect()]


def test_agrees_with_trying_rules_in_order(spark):
    rng = random.Random(4)
    rules = []
    for i in range(300):
        lo = rng.randrange(-200, 2000)
        rules.append((lo, lo + rng.choice([0, 1, 5, 40, 700]), i, f"r{i}"))
    rng.shuffle(rules)
    rules += [(None, 5, 0, "no end"), (9, 3, 0, "wrong way"), (10**15, 10**15 + 9, 5, "far")]
    numbers = [*range(-210, 2710), None, 10**15, 10**15 + 9, 10**15 + 10, 10**17]
    wanted = [min(((o, name) for lo, hi, o, name in rules if n is not None and lo is not None and lo <= n <= hi), default=(0, None))[1] for n in numbers]
    assert found(spark, rules, numbers) == wanted


def test_odd_tables(spark):
    assert found(spark, [], [1, None]) == [None, None]
    assert found(spark, [(1, 3, 7, "b"), (1, 3, 7, "a")], [0, 1, 3, 4]) == [None, "a", "a", None]
    assert found(spark, [(1, 3, 7, "b")], []) == []


def test_blocks_cover_each_interval_once(spark):
    pairs = [(a, b) for a in range(0, 20) for b in range(a, 20)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    for r in df.withColumn("x", ranges._blocks(F.col("a"), F.col("b"), 6)).collect():
        cells = [i for level, block in r["x"] for i in range(block << level, (block + 1) << level)]
        assert sorted(cells) == list(range(r["a"], r["b"])), r
        assert len(r["x"]) <= 2 * 6


def test_the_winner_is_found_without_sorting_rules_or_numbers(spark):
    """Blocks and positions are grouped by hashing, which leaves a row a group before anything moves; ranges of any width win."""
    rng = random.Random(9)
    held = [(lo, lo + rng.choice([0, 1, 7, 8, 63, 64, 900]), rng.randrange(50), f"r{i}") for i, lo in enumerate(rng.choices(range(2000), k=300))]
    rules = spark.createDataFrame(held, "lo bigint, hi bigint, ord int, name string")
    rows = spark.range(3000).withColumnRenamed("id", "n")
    found = ranges.first_match(rows, "n", rules, ["name"])
    for n, name in found.collect():
        claims = [(o, x) for lo, hi, o, x in held if lo <= n <= hi]
        assert name == (min(claims)[1] if claims else None)
    plan = ranges.intervals(rules, ["name"])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    blocks = spark.createDataFrame([(3, 9, 5), (4, 8, 7)], "a bigint, b bigint, place bigint").select(
        "place", F.explode(ranges._blocks(F.col("a"), F.col("b"), F.length(F.bin(F.col("b") - F.col("a"))) - 1)).alias("at"))
    assert sorted(map(tuple, blocks.select("place", "at.level", "at.block").collect())) == [(5, 0, 3), (5, 0, 8), (5, 2, 1), (7, 2, 1)]
