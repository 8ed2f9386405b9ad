import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from conftest import DATA, rows
from pyspark.sql import functions as F

from skein.llm import cooccurrence, neardup, packing, queries, residue, subsequences, terms, tokenize

WORDS = ["simp", "rw", "exact", "intro", "apply", "ext", "use", "rare1", "rare2"]


@pytest.mark.parametrize("name", queries.SQL)
def test_query_equals_sql(name, against_sql):
    against_sql(queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.SQL])
def test_query_without_sql_runs(name, spark):
    df = queries.QUERIES[name](spark, str(DATA / "sf0.001"))
    assert df.count() > 0 and df.columns


# terms


@pytest.mark.parametrize("held, size", [(7, 10**9), (40, 10**9), (400_000, 2000), (400_000, 10**9)])
def test_terms_against_counter(spark, held, size):
    rng = random.Random(2)
    data = [("f" if i % 4 else "g", [rng.choice(["the"] * 20 + ["", "É", "x" * 3000, None] + [f"t{rng.randint(0, 300)}"]) for _ in range(rng.randint(0, 12))], 1) for i in range(500)] + [("f", None, 1), (None, ["a", "a"], 1)]
    df = spark.createDataFrame(data, "field string, terms array<string>, term int").repartition(3)
    occurrences, records = Counter(), Counter()
    for f, ts, _ in data:
        ts = [t for t in ts or [] if t is not None]
        occurrences.update((f, t) for t in ts)
        records.update({(f, t) for t in ts})
    got = rows(terms.term_counts(df, held, size), "field", "term", "n_occurrences", "n_records")
    assert got == sorted(((f, t, n, records[f, t]) for (f, t), n in occurrences.items()), key=repr)


def test_terms_marks_and_empty(spark):
    counts = spark.createDataFrame([("f", "a", 9, 2), ("f", "b", 9, 3), ("f", "c", 9, 6), ("f", "d", 9, 5)], "field string, term string, n_occurrences long, n_records long")
    assert rows(terms.marked(counts, {"f": 100}), "term", "mark") == [("a", "rare"), ("b", None), ("c", "common"), ("d", None)]
    assert not terms.term_counts(spark.createDataFrame([], "field string, terms array<string>")).count()


# subsequences


def holds(seq, gap, lengths):
    found = set()
    for start in range(len(seq)):
        ends = [(start, (seq[start],))]
        for length in range(2, max(lengths) + 1):
            ends = [(j, p + (seq[j],)) for i, p in ends for j in range(i + 1, min(len(seq), i + gap + 1))]
            if length in lengths:
                found |= {p for _, p in ends}
    return found


def frequent(seqs, gap, lengths, min_count, min_share):
    n = sum(len(s) >= min(lengths) for s in seqs)
    support = Counter(p for s in seqs for p in holds(s, gap, lengths))
    return sorted(((p, k) for p, k in support.items() if k >= min_count and k >= min_share * n), key=repr)


@pytest.mark.parametrize("block, most", [(1024, 2048), (6, 2048), (6, 3)])
def test_subsequences_against_brute_force(spark, monkeypatch, block, most):
    monkeypatch.setattr(subsequences, "MOST_ITEMS", most)
    rng = random.Random(11)
    seqs = {f"n{i}": [rng.choice(WORDS[:7] * 3 + WORDS) for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 30]))] for i in range(80)}
    seqs |= {f"copy{i}": seqs["n3"] for i in range(5)}
    data = [(n, i if i else None, 100 - i, w, 1) for n, s in seqs.items() for i, w in enumerate(s)]
    data += data[::3]
    df = spark.createDataFrame(data, "name string, step_no int, step_id long, word string, block int").repartition(3)
    for gap, lengths, share in ((3, (3, 4), 0.1), (1, (2,), 0.05), (5, (3, 4), 0.35)):
        blocks = subsequences.ordered_blocks(df, F.array("word"), gap * (max(lengths) - 1), block)
        got = subsequences.frequent_subsequences(blocks.select("long", "values"), gap, lengths, 4, share)
        assert rows(got, "items", "n_sequences") == frequent(seqs.values(), gap, lengths, 4, share)


@pytest.mark.parametrize("places", [50, 1_000_000])
def test_subsequences_of_a_hot_name_without_step_numbers(spark, monkeypatch, places):
    """One name has a third of all rows, its step numbers are null or equal, rows come again: order is by step_id."""
    monkeypatch.setattr(subsequences, "CHUNK_PLACES", places)
    rng = random.Random(4)
    seqs = {"hot": [rng.choice(WORDS) for _ in range(300)], "even": [rng.choice(WORDS) for _ in range(120)]} | {f"n{i}": [rng.choice(WORDS) for _ in range(rng.randint(1, 12))] for i in range(60)}
    data = [(n, None if n == "hot" else 7 if n == "even" else i, 1000 * len(n) + i, w) for n, s in seqs.items() for i, w in enumerate(s)]
    df = spark.createDataFrame(data + data[::2] + [(None, 1, 1, "rw"), ("none", 1, 2, None)], "name string, step_no int, step_id long, word string").repartition(4)
    blocks = subsequences.ordered_blocks(df, F.array_compact(F.array("word")), 12, 16)
    sizes = {r["long"]: r["n"] for r in blocks.groupBy("long").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes["hot"] == 19 and sizes["even"] == 8
    assert blocks.agg(F.max(F.size("values"))).first()[0] <= 28
    got = subsequences.frequent_subsequences(blocks.select("long", "values"), 4, (3, 4), 4, 0.1)
    assert rows(got, "items", "n_sequences") == frequent(seqs.values(), 4, (3, 4), 4, 0.1)


def test_subsequences_empty(spark):
    none = spark.createDataFrame([], "long string, values array<string>")
    assert not subsequences.frequent_subsequences(none).count()
    short = spark.createDataFrame([(None, ["a"]), (None, [])], none.schema)
    assert not subsequences.frequent_subsequences(short).count()


# near duplicates


def hashed(spark, sets):
    df = spark.createDataFrame([(n, sorted(s)) for n, s in sets.items()], "name string, w array<string>")
    return df.select("name", F.array_sort(F.array_distinct(F.transform("w", lambda x: F.xxhash64(x)))).alias("windows"))


def test_similar_against_brute_force(spark):
    rng = random.Random(21)
    sets = {}
    for i in range(120):
        base = {f"w{rng.randint(0, 4000)}" for _ in range(rng.randint(20, 60))}
        sets[f"n{i:03}"] = base
        for k in range(rng.choice([0, 0, 1, 3])):
            drop = set(rng.sample(sorted(base), rng.randint(0, len(base) // 4)))
            sets[f"n{i:03}e{k}"] = (base - drop) | {f"v{i}{k}{j}" for j in range(rng.randint(0, 5))}
    sets |= {f"same{i}": {f"s{j}" for j in range(25)} for i in range(30)}
    members, one = neardup.classes(hashed(spark, sets))
    pairs = neardup.similar_classes(one, 0.7)
    want = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])]
    assert rows(neardup.expand(pairs, members)) == sorted(want, key=repr)


def test_anchor_recall_at_the_threshold(spark):
    """400 pairs of similarity just 0.7: 14 of 20 windows of the union are shared."""
    sets = {}
    for i in range(400):
        shared = {f"{i}s{j}" for j in range(28)}
        sets[f"a{i}"] = shared | {f"{i}a{j}" for j in range(6)}
        sets[f"b{i}"] = shared | {f"{i}b{j}" for j in range(6)}
    _, one = neardup.classes(hashed(spark, sets))
    assert neardup.similar_classes(one, 0.7).count() == 400


def test_similar_of_a_hot_anchor(spark):
    """90 variants of one set meet at the same anchors, in blocks of 7 ids: every pair comes out, and once."""
    base = [f"b{j}" for j in range(40)]
    sets = {f"n{i:02}": {*base, f"own{i}"} for i in range(90)}
    members, one = neardup.classes(hashed(spark, sets))
    pairs = neardup.similar_classes(one, 0.7, block=7)
    assert rows(neardup.expand(pairs, members)) == sorted(itertools.combinations(sorted(sets), 2), key=repr)


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_meetings_over_batches(size):
    import pyarrow as pa

    anchors = [1, 1, 1, 2, 3, 3, 4, 4, 4, 4, 4, 5]
    ids = list(range(100, 112))
    batches = [pa.record_batch({"anchor": pa.array(anchors[i : i + size], pa.int64()), "class_id": pa.array(ids[i : i + size], pa.int64())}) for i in range(0, 12, size)]
    got = Counter()
    for b in neardup._meetings(2)(iter(batches)):
        for r in b.to_pylist():
            got.update({tuple(sorted((x, y))) for x in r["left"] for y in r["right"] if x != y})
    assert got == Counter((x, y) for (i, x), (j, y) in itertools.combinations(enumerate(ids), 2) if anchors[i] == anchors[j])


def test_similar_empty(spark):
    members, one = neardup.classes(spark.createDataFrame([], "name string, windows array<long>"))
    assert not neardup.expand(neardup.similar_classes(one, 0.7), members).count()


@pytest.mark.parametrize("tall", [30, 45])
def test_similar_sets_held_in_rows(spark, tmp_path, tall):
    """Sets of more than so many windows are never put in one row; links among them, and across the bound, come out all the same."""
    rng = random.Random(17)
    data, at = [], 0
    for i in range(14):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(25, 60))]
        for name in [f"n{i:02}", f"n{i:02}copy", f"n{i:02}edit", f"n{i:02}far"]:
            words = base[:]
            if name.endswith("edit"):
                words = [*base, *(f"v{at}{j}" for j in range(rng.randint(1, 8)))]
            if name.endswith("far"):
                words = [f"x{at}{j}" if j % step == 0 else w for step in [rng.randint(8, 40)] for j, w in enumerate(base)]
            at += 1
            data += [(1000 * at + j, 1000 * at + j, name, j, w) for j, w in enumerate(words)]
    spark.createDataFrame(data, "ord long, step_id long, full_name string, step_no int, tactic string").write.parquet(f"{tmp_path}/tactic_steps.parquet")
    d = str(tmp_path)
    assert queries.proof_windows(spark, d)[1] is None and queries.proof_windows(spark, d, tall)[1].count() > 0
    got = []
    for bound in (neardup.TALL, tall):
        members, pairs = queries._similar(spark, d, bound)
        got.append(rows(neardup.expand(pairs, members)))
    assert got[0] == got[1] and len(got[0]) > 20


def test_windows_cross_steps_and_blocks(spark, tmp_path):
    data = [(i, i, " p" if i % 2 else "_root_.p", i // 2 if i < 40 else 1024 + i, f"t{i} u{i}") for i in range(60)] + [(99, 99, None, 0, "a b c"), (98, 98, "q", None, None)]
    df = spark.createDataFrame(data, "ord long, step_id long, full_name string, step_no int, tactic string")
    df.unionByName(df.limit(5)).write.parquet(f"{tmp_path}/tactic_steps.parquet")
    made = queries.proof_windows(spark, str(tmp_path))[0].collect()
    assert [(r["name"], len(r["windows"])) for r in made] == [("p", 118)]


# co-occurrence


@pytest.mark.parametrize("held", [5, 200_000])
def test_together_against_brute_force(spark, held):
    rng = random.Random(8)
    items = [f"i{k:02}" for k in range(30)]
    data = []
    for _ in range(400):
        r = ["hot"] + rng.sample(items, rng.randint(0, 4)) + (["x", "y"] if rng.random() < 0.1 else []) + [None] * rng.randint(0, 1)
        data.append((r + r[:1], "clash"))
    data += [(None, ""), ([], ""), ([None], "")]
    sets = [set(r) - {None} for r, _ in data if r and set(r) - {None}]
    single = Counter(x for s in sets for x in s)
    both = Counter(p for s in sets for p in itertools.combinations(sorted(s), 2))
    n = len(sets)
    want = [(a, b, k, single[a], single[b], n) for (a, b), k in both.items() if k >= 5 and k * n >= 2 * single[a] * single[b]]
    df = spark.createDataFrame(data, "items array<string>, item string").repartition(3)
    got = cooccurrence.together(df, 5, 2.0, 0.0, cuts=3, held_places=held, held_pairs=held)
    assert rows(got, "item_a", "item_b", "n_ab", "n_a", "n_b", "n") == sorted(want, key=repr)
    xl = lambda v: v * math.log(v) if v > 0 else 0.0
    for r in got.collect():
        k, a, b = r["n_ab"], r["n_a"], r["n_b"]
        llr = 2 * (xl(k) + xl(a - k) + xl(b - k) + xl(n - a - b + k) + xl(n) - xl(a) - xl(n - a) - xl(b) - xl(n - b))
        assert abs(llr - r["llr"]) < 1e-6 and abs(r["lift"] - k * n / (a * b)) < 1e-9


def test_together_leaves_hopeless_items_out_before_pairing(monkeypatch):
    import pyarrow as pa

    records = pa.array([["a", "b", "hot"], ["a", "hot", "once"], ["b", "hot"], [], ["a", "b"]])
    able = bytearray(4096)
    for x in ("a", "b"):
        c = cooccurrence.crc32(x.encode()) & 32767
        able[c >> 3] |= 1 << (c & 7)
    run = cooccurrence._stripes(["hot"], bytes(able), 15, 4, 100, 100)
    made = [r for b in run(iter([pa.RecordBatch.from_arrays([records], names=["items"])])) for r in b.to_pylist()]
    assert [(r["item"], r["neighbours"], r["counts"]) for r in made] == [("a", ["b"], [2])]


def test_together_by_significance(spark):
    data = [["a", "b"]] * 6 + [["a"]] * 30 + [["b"]] * 30 + [["c"]] * 200 + [["d", "e"]] * 9
    df = spark.createDataFrame([(x,) for x in data], "items array<string>")
    every = {(r["item_a"], r["item_b"]): r["llr"] for r in cooccurrence.together(df, 5, 1.0, 0.0).collect()}
    assert set(every) == {("a", "b"), ("d", "e")}
    least = sorted(every.values())
    assert cooccurrence.together(df, 5, 1.0, sum(least) / 2).count() == 1


def test_together_empty(spark):
    assert not cooccurrence.together(spark.createDataFrame([], "items array<string>")).count()


# tokenizer

TEXTS = [
    None, "", " ", "\n\n \n", "Hello world", "Hello  world\t\tx", "it's we'll I'D", "naïve ２３ ½ 数学 ℝ≥0∞ 👩‍🔬👍🏽", "a b c　d\x85e", "x" * 5000, "9" * 3000 + " " * 700, "\r\nline\r\n", "<|endoftext|> tail",
    "é combining", "Ядро الفئة", "''re don''t", "﻿bom", "  lead", "trail  ", "`{{ x }}` $a_1$", "\x1c\x1d", "the the the",
]


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("hot", [3, 50_000])
def test_encoded_equals_tokenizer(spark, hot):
    data = [(i, t, ["x"], 0) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], [], 1), (None, "no id", None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, words array<string>, row int")
    want = sorted(zip([d[0] for d in data], map(tuple, reference_ids([d[1] for d in data]))), key=repr)
    made = tokenize.encoded(df.select("doc_id", "text"), hot_words=hot)
    assert rows(made) == want
    assert rows(tokenize.decoded(made)) == sorted(((d[0], d[1] or "") for d in data), key=repr)
    counts = tokenize.token_counts(df.select("doc_id", "text"), hot_words=hot)
    assert rows(counts, "doc_id", "n_tokens") == sorted(((d, len(i)) for d, i in want), key=repr)


def test_encoded_random_texts(spark):
    rng = random.Random(5)
    alphabet = "ab1 2'\n\t.,_-é数😀 sdtm"
    data = [(i, "".join(rng.choices(alphabet, k=rng.randint(0, 40)))) for i in range(600)]
    made = tokenize.encoded(spark.createDataFrame(data, "doc_id long, text string"), hot_words=20)
    assert rows(made) == sorted(zip(range(600), map(tuple, reference_ids([t for _, t in data]))), key=repr)


def test_encoded_empty_table(spark):
    assert not tokenize.encoded(spark.createDataFrame([], "doc_id long, text string")).count()


def test_words_join_to_the_text(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS if t], "text string")
    assert all("".join(w) == t for t, w in df.select("text", tokenize.words("text")).collect())


# packing


def test_knapsack_against_brute_force():
    import numpy as np

    rng = random.Random(3)
    for _ in range(20):
        sizes = np.array(sorted(rng.sample(range(2, 30), 5)))
        values = np.array([rng.random() for _ in sizes])
        limits = np.array([rng.randint(0, 9) for _ in sizes])
        best = [0.0] * 61
        for s, v, most in zip(sizes, values, limits):
            best = [max(best[c - k * s] + k * v for k in range(min(most, c // s) + 1)) for c in range(61)]
        held = packing.knapsack(sizes, values, 60, limits)
        assert held @ sizes <= 60 and (held <= limits).all() and abs(held @ values - best[60]) < 1e-9


def test_program_against_its_dual_bound():
    """Long-tailed lengths: the program covers every length exactly, and is within 0.2 % of the bound."""
    import numpy as np

    for n in (10_000, 100_000):
        k, c = np.unique(np.clip(np.random.default_rng(0).lognormal(5, 1, n), 1, 2048).astype(int), return_counts=True)
        demand = dict(zip(k.tolist(), c.tolist()))
        covered = Counter()
        for at, many, times in packing.solve(k, c, 2048):
            covered.update(dict(zip(k[at].tolist(), (many * times).tolist())))
            assert times > 0 and k[at] @ many <= 2048
        assert covered == Counter(demand)
        used = max(first + n // held for _, _, n, first, held in packing.plan(demand))
        bound = packing.dual_bound(demand)
        assert -(-sum(s * d for s, d in demand.items()) // 2048) <= bound <= used <= 1.002 * bound


def test_program_meets_its_dual_where_lengths_waste_room():
    """Lengths that can't fill containers: the bound is beyond the sum of the lengths, and the packing meets it."""
    import numpy as np

    rng = np.random.default_rng(5)
    wasteful = {k: c for low, high, n in [(1000, 1200, 5000), (600, 620, 500)] for k, c in Counter(rng.integers(low, high, n).tolist()).items()}
    for demand, least in [({1025: 1000, 1: 10}, 1000), ({700: 1000, 1: 1000}, 500), ({1024: 7, 1025: 8, 3: 2}, 12), (wasteful, 4300)]:
        k, c = np.array(sorted(demand)), np.array([demand[s] for s in sorted(demand)])
        covered = Counter()
        for at, many, times in packing.solve(k, c, 2048):
            covered.update(dict(zip(k[at].tolist(), (many * times).tolist())))
            assert times > 0 and k[at] @ many <= 2048
        assert covered == Counter(demand)
        used = max(first + n // held for _, _, n, first, held in packing.plan(demand))
        bound = packing.dual_bound(demand)
        assert least <= bound <= used <= 1.005 * bound


def test_dual_bound_is_one():
    rng = random.Random(6)
    for _ in range(30):
        items = sorted(rng.choices(range(3, 11), k=rng.randint(1, 8)))
        best = len(items)

        def pack(rest, rooms):
            nonlocal best
            if not rest:
                best = min(best, len(rooms))
            elif len(rooms) < best:
                for i, room in enumerate(rooms):
                    if rest[-1] <= room:
                        pack(rest[:-1], rooms[:i] + [room - rest[-1]] + rooms[i + 1 :])
                pack(rest[:-1], [*rooms, 10 - rest[-1]])

        pack(items, [])
        assert packing.dual_bound(dict(Counter(items)), 10) <= best <= max(f + n // h for _, _, n, f, h in packing.plan(dict(Counter(items)), 10))
    assert packing.dual_bound({}) == 0


@pytest.mark.parametrize("capacity, sizes", [(10, [3, 3, 3, 7, 10, 1] * 30), (100, [51] * 40 + [49] * 40 + [50] * 7), (16, [5] * 200 + [35, 32, 16, 1, 0, -2, None]), (8, [])])
def test_packed_invariants(spark, capacity, sizes):
    items = spark.createDataFrame([(i, 1000 + i % 50, n) for i, n in enumerate(sizes)], "row long, doc_id long, n_tokens long")
    made = packing.packed(items, capacity).collect()
    want = [(1000 + i % 50, f, min(capacity, n - f)) for i, n in enumerate(sizes) if n and n > 0 for f in range(0, n, capacity)]
    assert sorted((r["doc_id"], r["first_token"], r["n_tokens"]) for r in made) == sorted(want)
    room = defaultdict(int)
    for r in made:
        room[r["container_id"]] += r["n_tokens"]
    assert all(v <= capacity for v in room.values()) and sorted(room) == list(range(len(room)))
    if sizes and None not in sizes:
        assert len(room) <= 1.1 * math.ceil(sum(sizes) / capacity) + 1


def test_packed_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ITEMS", 10)
    items = spark.range(300).selectExpr("id as row", "id as doc_id", "1 + id % 3 as n_tokens")
    made = packing.packed(items, 6)
    assert made.count() == 300 and made.select("doc_id").distinct().count() == 300
    assert made.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).where("n > 6").count() == 0


# residue

RESIDUE = {
    1: "Title: {{ title }}\nWritten by Fold", 2: "Title: ${file}\nWritten by Mesh", 3: "Last changed on @@DATE@@, release 7.", 4: "Last changed on [your date here], release 3.",
    5: "As a corollary, the <file goes here> kernel is again strict.", 6: "The graph is %TITLE% here, as is the net (insert file).", 7: "Titre : [INSÉRER DATE ICI]", 8: "```lean\ntheorem x {{ file }} : a = b := by simp\n```",
    9: "dolor sit ipsum velun amet lorem sit velun. Ipsum lorem amet velun sit dolor.", 10: "Velun ipsum amet sit dolor velun lorem.", 11: "asdf foo bar qwer blah asdf foo", 12: "Text goes here. Text goes here. Text goes here.",
    13: "A stock line of nothing much. A stock line of nothing much. Fine.", 14: "A stock line of nothing much. A stock line of nothing much.", 15: "A real sentence. A stock line of nothing much.",
    16: "<html><head><title>503</title></head><body><h1>Service away</h1><hr>docsrv/2.1</body></html>", 17: "<html><head><title>404</title></head><body><h1>No such page</h1><hr>docsrv/3.0</body></html>", 18: "Uh-oh. NO SUCH PAGE (a77363a7dde5). Go back.",
    19: '{"status": 503, "error": "Service away", "id": "1ab"}', 20: '{"status": 500, "error": "Broken", "id": "2"}', 21: "Please enable JavaScript to view this index.", 22: "Please enable JS to view this graph.",
    23: "<noscript>Your browser blocks active content.</noscript>", 24: "The kernel is fine.\nYour browser blocks active content.", 25: "HTTP/1.1 404\nContent-Length: 3\n\nNO SUCH PAGE\n",
}
FINE = {
    101: None, 102: "", 103: " \n\t ", 104: "The doc generator replaces `{{ title }}` by the value of `Mesh`.", 105: "In Lua the pattern `%(file)s` needs escaping.", 106: 'The message "Please enable scripts" came from the old viewer.',
    107: "The goal view also works with JavaScript disabled, since `f` renders to plain HTML.", 108: "The call gave error 404 after the rename.", 109: "A page not found now falls back to the parent.", 110: "Here `{x : α}` is implicit.",
    111: "We test the layout with lorem ipsum paragraphs; only `f` is shown.", 112: "error: unknown constant 'Mesh.dist' at 717:4", 113: "Sans cette hypothèse c'est faux. Sans cette hypothèse c'est faux.", 114: "x" * 30_000,
    115: "```\n{{ title }}\n```", 116: "foo is a bar of some kind that nobody has ever seen in these halls", 117: "a_1 <= b_2 and f^[3] x = {y | y < z}",
}


def test_residue_cases(spark):
    data = [(i, t, "k", "s", 1) for i, t in {**RESIDUE, **FINE}.items()] + [(None, "{{ title }}", "k", "s", 1), (1, RESIDUE[1], "k", "s", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, key string, sub string, n int").repartition(3)
    found = {r["doc_id"] for r in residue.residue(df).collect()}
    assert found - set(RESIDUE) == set()
    assert set(RESIDUE) - found == set()


def found_in(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = residue.residue(df).collect()
    return {(texts[r["doc_id"]], r["reason"]) for r in got}


def test_residue_induces_slots(spark):
    filled = [f"Title: {a} {b}\nWritten by {a}, release {i}.\nThe set {a.lower()} is {w}." for i, (a, b, w) in enumerate([("Fold", "Mesh", "open"), ("Mesh", "Loom", "closed"), ("Spire", "Crest", "small"), ("Norm", "Trace", "flat"), ("Graph", "Form", "free")])]
    left = ["Title: {title}\nFine.", "Title: [TITLE]\nGood.", "Title: <TITLE>\nNice.", "Title: $title\nWell.", "We go on.\nWritten by undefined, release 8.", "Written by null, release 7.", "Written by TBD, release 6.", "Title: \nOwner: Fold", "Written by , release 3."]
    alone = ["{title}", "[TITLE]", "undefined", "TBD", "Name: ____", "Author: {author}"]
    fine = ["The set fold is null.", "The list:\n\na paragraph", "Let {x} be [a] and <b>bold</b>.", "The value `{title}` is set.", "It says \"Written by null\" there.", "A price of $five is low.", "See {mesh} for more."]
    assert found_in(spark, filled + left + alone + fine) == {(x, "placeholder") for x in left + alone}


def test_residue_short_and_long_filler(spark):
    long = "This paragraph stands here for the real one and shows nothing but how long a real one would be. "
    filler = ["Lorem ipsum dolor.", "asdf asdf asdf", "bla bla bla", "Fold is fine. " + long * 4]
    fine = ["foo bar", "A fold.", long + "Fold is fine.", "We prove the fold lemma by cases on the net. " * 2 + "Then it ends. " + "word " * 200]
    assert found_in(spark, filler + fine) == {(x, "filler") for x in filler}


def test_residue_pages_without_a_failure_recur_by_their_words(spark):
    page = "<html><h1>Please wait</h1><p>Node %s asks for patience</p></html>"
    same = [page % x for x in ("x1", "y27")]
    assert found_in(spark, same + ["<html><h1>Fold</h1><p>One thing</p></html>", "<html><h1>Mesh</h1><p>Another thing</p></html>"]) == {(x, "error_page") for x in same}


def test_residue_pages_by_structure(spark):
    amid = ["Fold is fine.\n<html><h1>503</h1><p>Request ID: %s</p></html>\nMesh is, too." % x for x in ("9fa3c7", "bb12")]
    amid += ["Fold.\nHTTP/1.1 502 Bad\nServer: %s\nX-Request-Id: %s\n\nThe upstream is gone\nMesh is fine here, and it goes on for much longer than any page would go on.\nLoom is a word, and so is spire, as all of us know by now.\n" % x for x in (("apex", "ab12cd"), ("nadir", "ff3e"))]
    amid += ['Fold.\n{"status": 500, "error": "Broken", "path": "%s"}\nMesh.' % x for x in ("/a/fold", "/b/mesh/loom")]
    whole = ["<html>\n<head><title>404</title></head>\n<body><h1>Nothing lies here</h1></body>\n</html>", "Error 429: Far too many calls", "HTTP/1.1 403 Forbidden\nVia: x\n\nKeep out of this"]
    said = ["Spire.\nNothing lies here.\nCrest."]
    fine = ["503", "It is 503. We go on.", "<html><h1>Fold</h1></html>", "HTTP/1.1 200 OK\nVia: y\n\nAll is well", "The call gave error 404 after the rename."]
    assert found_in(spark, amid + whole + said + fine) == {(x, "error_page") for x in amid + whole + said}
    left = ["Title: {{ title }}", "${file}"]
    assert found_in(spark, [left[0], "Fine."]) | found_in(spark, [left[1], "Let ${x} be."]) == {(x, "placeholder") for x in left}


def test_residue_empty(spark):
    assert not residue.residue(spark.createDataFrame([], "doc_id long, text string")).count()


def test_groups_follow_from_pairs(spark):
    d = str(DATA / "sf0.01")
    pairs = [tuple(r) for r in queries.p5_found(spark, d).select("name_a", "name_b").collect()]
    groups = {r["name"]: (r["group_name"], r["n_links"]) for r in queries.p5_groups(spark, d).collect()}
    links = Counter(n for p in pairs for n in p)
    assert {n: k for n, (_, k) in groups.items() if k} == dict(links)
    parent = {n: n for n in groups}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        parent[root(a)] = root(b)
    both = {(root(n), g) for n, (g, _) in groups.items()}
    assert len(both) == len({a for a, _ in both}) == len({b for _, b in both})


def test_clean_is_the_rest(spark):
    d = str(DATA / "sf0.001")
    found, clean = queries.p9_found(spark, d), queries.p9_clean(spark, d)
    assert clean.join(found, "doc_id").count() == 0 and found.count() + clean.count() == spark.read.parquet(f"{d}/documents.parquet").count()
