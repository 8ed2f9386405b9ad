from collections import Counter, defaultdict
from datetime import datetime, timedelta
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from skein.operators import frequency, orphans
from skein.plans import skewed

REFS = "src_table string, row_id long, premise string, at timestamp_ntz, name string, since int"
LIVES = "name string, since timestamp_ntz, until timestamp_ntz"


def test_profile_hot_key_nulls_and_repeats(spark):
    data = [("hot", i % 7, f"t{i % 3}") for i in range(900)] + [("b", None, None), ("b", 1, None), ("b", 1, "t"), (None, 1, "x")]
    df = spark.createDataFrame(data, "key string, v0 int, kind string")
    made = frequency.key_profile(df, F.col("key"), {"n_a": F.col("v0"), "n_b": F.col("kind")})
    assert rows(made, "key", "n_rows", "n_a", "n_b") == [("b", 3, 1, 1), ("hot", 900, 7, 3)]


def test_modes_ties_and_null_values(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "y"), ("a", "x"), ("b", None), ("b", "z"), ("c", None)], "k string, v string")
    w = frequency.weighted_values(df, F.col("k"), F.col("v"))
    assert rows(frequency.modes(w)) == [("a", "x", 2), ("b", "z", 1), ("c", None, 1)]


def test_percentiles_against_sorting(spark):
    rng = random.Random(3)
    data = [(k, rng.randint(0, 50)) for k in "aaaaab" for _ in range(300)] + [("c", 5), ("n", None)]
    w = frequency.weighted_values(spark.createDataFrame(data, "k string, v int"), F.col("k"), F.col("v"))
    want = []
    for k in "abc":
        s = sorted(v for x, v in data if x == k)
        want += [(k, p, s[max(1, -(-int(p * 100) * len(s) // 100)) - 1]) for p in (0.0, 0.5, 0.9)]
    assert rows(frequency.percentiles(w, [0.0, 0.5, 0.9], splits=7)) == sorted(want, key=repr)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, v int")
    assert not rows(frequency.key_profile(df, F.col("k"), {"n": F.col("v")}))
    assert not rows(frequency.percentiles(frequency.weighted_values(df, F.col("k"), F.col("v")), [0.5]))
    assert not rows(orphans.orphans(spark.createDataFrame([], REFS), spark.createDataFrame([], LIVES)))


def brute(refs, lives):
    alive = lambda p, t: t is not None and any(n == p and s <= t and (u is None or u > t) for n, s, u in lives)
    return sorted({(a, t and t.strftime("%Y-%m"), r, p) for a, r, p, t, *_ in refs if p is not None and not alive(p, t)}, key=repr)


@pytest.mark.parametrize("limits", [(1000, 100_000, 1000), (2, 0, 1000), (2, 100_000, 2), (1, 0, 1)])
def test_orphans_against_brute_force(spark, limits):
    rng = random.Random(5)
    day = lambda: datetime(2023, 1, 1) + timedelta(days=rng.randint(0, 200), hours=rng.randint(0, 5))
    lives = []
    for n in "abcdef":
        for _ in range(rng.randint(0, 9)):
            s = day()
            lives.append((n, s, None if rng.random() < 0.2 else s + timedelta(days=rng.randint(0, 40))))
    lives = [*{(n, s): (n, s, u) for n, s, u in lives}.values()]
    refs = [("t", i, rng.choice(["a"] * 6 + [*"bcdefgh", None]), day() if rng.random() < 0.97 else None, "clash", 1) for i in range(400)]
    refs += refs[:40]
    found = orphans.orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(lives, LIVES), *limits)
    assert rows(found) == brute(refs, lives)
    counts = orphans.orphan_counts(spark.createDataFrame(refs, REFS), spark.createDataFrame(lives, LIVES), *limits)
    assert rows(counts) == sorted(((*k, n) for k, n in Counter(r[:2] for r in brute(refs, lives)).items()), key=repr)


def test_orphans_hot_key_in_one_month(spark):
    """A third of all references name one key, within one month and many at one time; it is declared and removed all the time."""
    rng = random.Random(9)
    day = lambda: datetime(2023, 5, 1) + timedelta(minutes=rng.randint(0, 40_000))
    lives = [*{(n, s): (n, s, s + timedelta(minutes=rng.randint(0, 30))) for n, s in (("hot", day()) for _ in range(400))}.values()] + [("b", datetime(2023, 1, 1), None)]
    noon = datetime(2023, 5, 9, 12)
    refs = [("t", i if i % 50 else None, "hot" if i % 3 else rng.choice("bcd"), noon if i % 5 == 0 else day(), "", 1) for i in range(900)]
    want = brute(refs, lives)
    assert rows(orphans.orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(lives, LIVES), key_rows=100)) == want
    counts = orphans.orphan_counts(spark.createDataFrame(refs, REFS), spark.createDataFrame(lives, LIVES), key_rows=100)
    assert rows(counts) == sorted(((*k, n) for k, n in Counter(r[:2] for r in want).items()), key=repr)


def test_lifetimes_last_row_holds(spark):
    at = lambda d: datetime(2023, 1, d)
    df = spark.createDataFrame([(1, " a ", at(1), None), (2, "_root_.a", at(1), at(3)), (3, "a", at(5), None), (4, None, at(1), None), (5, "b", None, None), (6, "", at(1), None)], "ord long, full_name string, added_at timestamp_ntz, removed_at timestamp_ntz")
    assert rows(orphans.lifetimes(df)) == [("a", at(1), at(3)), ("a", at(5), None)]


def test_found_queries_on_dirty_tables(spark, tmp_path):
    """Extra columns with clashing names, null and empty arrays and elements, null times and names."""
    at = datetime(2023, 2, 1)
    steps = [(1, 10, " a", ["p", " p ", None, "", "_root_.p"], at, "x", 1), (2, 10, "a", ["p"], at, "x", 1), (3, 11, None, None, None, "x", 1), (4, 12, "b", [], at, "x", 1), (5, None, "b", ["q"], at, "x", 1)]
    spark.createDataFrame(steps, "ord long, step_id long, full_name string, premises array<string>, recorded_at timestamp_ntz, key string, weight int").write.parquet(f"{tmp_path}/tactic_steps.parquet")
    spark.createDataFrame([(7, "t", [("p", "l", 3), (None, "l", None), None], at, 1)], "bridge_id long, theorem string, cross_cluster_premises array<struct<premise string, cluster_label string, in_degree long>>, recorded_at timestamp_ntz, n int").write.parquet(f"{tmp_path}/bridge_theorems_filtered.parquet")
    spark.createDataFrame([(1, "p", datetime(2023, 3, 1), None)], "ord long, full_name string, added_at timestamp_ntz, removed_at timestamp_ntz").write.parquet(f"{tmp_path}/corpus.parquet")
    d = str(tmp_path)
    assert rows(skewed.p1_premises(spark, d), "premise", "n_references", "n_steps", "n_theorems") == [("p", 4, 1, 1), ("q", 1, 0, 1)]
    assert rows(skewed.p1_found(spark, d)) == [("in_degree", "3"), ("premises", "p"), ("premises", "q")]
    assert rows(skewed.p2_found(spark, d)) == [("bridge_theorems_filtered", "2023-02", 7, "p"), ("tactic_steps", "2023-02", 10, "p"), ("tactic_steps", "2023-02", None, "q")]


def test_counts_agree_with_counter(spark):
    rng = random.Random(1)
    data = [(rng.choice("aaab"), rng.randint(0, 5), rng.choice("xyz")) for _ in range(500)]
    made = frequency.key_profile(spark.createDataFrame(data, "k string, a int, b string"), F.col("k"), {"na": F.col("a"), "nb": F.col("b")})
    sets = defaultdict(lambda: (set(), set()))
    for k, a, b in data:
        sets[k][0].add(a), sets[k][1].add(b)
    n = Counter(k for k, _, _ in data)
    assert rows(made) == sorted(((k, n[k], len(s[0]), len(s[1])) for k, s in sets.items()), key=repr)
