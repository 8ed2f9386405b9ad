import itertools
import json
import math
import random

import pytest
from conftest import DATA, rows
from pyspark.sql import functions as F

from skein.operators import bridges, charts, complexity, labels, ngrams, reports, similarity, validation
from skein.plans import base, reference


def members(spark, counts):
    data = [(cid, m) for cid, mods in counts.items() for m, n in mods.items() for _ in range(n)]
    return labels.labels(labels.distribution(spark.createDataFrame(data, "cid int, module string"), ["cid"]), ["cid"])


def test_labels_thresholds_and_ties(spark):
    lab = members(spark, {1: {"A": 3}, 2: {"B": 2, "A": 2}, 3: {"A": 2, "B": 2, "C": 1}, 4: {"A": 1998, **{f"m{i}": 1001 for i in range(3)}}, 5: {"A": 4994, "B": 5006 - 1000, "C": 1000}, 6: {"A": 4996, "B": 4004, "C": 1000}})
    got = {r["cid"]: r for r in lab.collect()}
    assert (got[1]["label"], got[1]["entropy"], got[1]["norm_entropy"]) == ("A", 0.0, 0.0)
    assert (got[2]["label"], got[2]["is_mixed"], got[2]["norm_entropy"]) == ("A", False, 1.0)
    assert not got[3]["is_mixed"] and got[3]["dominant_fraction"] == 0.4
    assert got[4]["is_mixed"] and got[4]["label"] == "A + m0 + m1"
    assert rows(labels.pure(lab).select("cid")) == [(1,), (2,), (6,)]
    assert labels.mixed_pure_counts(lab).first().asDict() == {"n_clusters": 6, "n_mixed": 1, "n_pure": 3}
    assert 0 <= min(r["norm_entropy"] for r in got.values()) and max(r["norm_entropy"] for r in got.values()) <= 1


@pytest.mark.parametrize("size", [0, 1, 2, 3, 4])
def test_windows(spark, size):
    s = [str(i) for i in range(size)]
    got = spark.createDataFrame([(s,)], "items array<string>").select(ngrams.windows("items", 3)).first()[0]
    assert got == [s[i : i + 3] for i in range(size - 2)]


def test_gram_bridges_against_formula(spark):
    rng = random.Random(4)
    proofs = [(rng.randint(0, 5), [rng.choice(["simp", "rw a", "ext b", "use"]) for _ in range(rng.randint(0, 9))]) for _ in range(60)]
    prof = ngrams.profiles(spark.createDataFrame(proofs, "cid int, items array<string>"), [2, 3])
    for n, min_count in ((2, 1), (3, 2)):
        counts, totals = {}, {}
        for cid, items in proofs:
            for i in range(len(items) - n + 1) if len(items) >= 3 else ():
                g = tuple(items[i : i + n])
                counts.setdefault(g, {}).setdefault(cid, 0)
                counts[g][cid] += 1
                totals[cid] = totals.get(cid, 0) + 1
        want = []
        for g, c in counts.items():
            c = {k: v for k, v in c.items() if v >= min_count}
            if len(c) >= 2 and any(w.split()[0] not in ("simp", "ext", "use") for w in g):
                s = sum(c.values())
                h = -sum(v / s * math.log2(v / s) for v in c.values()) / math.log2(len(totals))
                mean = sum(v / totals[k] for k, v in c.items()) / len(c)
                want.append((g, len(c), round(h, 9), round(h * (1 - mean), 9)))
        got = bridges.gram_bridges(prof.where(F.col("n") == n), min_count=min_count, top_k=None)
        assert rows(got, "gram", "n_clusters", "h_norm", "bridge_score") == sorted(want, key=repr)


def test_gram_bridges_one_cluster(spark):
    prof = spark.createDataFrame([(3, ["a"], 1, 2)], "n int, gram array<string>, cid int, cnt long")
    assert rows(bridges.gram_bridges(prof, min_clusters=1).select("h_norm", "bridge_score")) == [(0.0, 0.0)]


def test_best_n(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.0325), (3, 0.0067), (4, 0.001)], "n int, frac_ge2 double")
    assert ngrams.best_n(df).first()[0] == 3
    assert ngrams.best_n(df.where("n < 3")).first()[0] == 3
    assert ngrams.best_n(df.limit(0)).first()[0] == 3


@pytest.mark.parametrize("points, want", [([(0, 0), (1, 15), (2, 34), (3, 60)], 2), ([(0, 5), (1, 5), (2, 5)], 0), ([(0, 1), (4, 2)], 4), ([], 0)])
def test_elbow(spark, points, want):
    assert bridges.elbow(spark.createDataFrame(points, "theta long, count long")).first()[0] == want


def test_bridge_theorem_and_depth_differ_on_own_cluster(spark):
    edges = spark.createDataFrame([("t", "p"), ("t", "q"), ("t", "u"), ("s", "p"), ("s", "q2")], "src string, dst string")
    clusters = spark.createDataFrame([("t", 1), ("p", 1), ("q", 2), ("s", 3), ("q2", 2)], "name string, cid int")
    lab = spark.createDataFrame([(1, "One"), (2, "Two")], "cid int, label string")
    pure = spark.createDataFrame([(1,), (2,)], "cid int")
    found = bridges.bridge_theorems(edges, clusters, lab, pure)
    assert rows(found, "theorem", "self_label", "premise_cluster_ids", "premise_cluster_labels", "n_premises") == [("s", "3", (1, 2), ("One", "Two"), 2), ("t", "One", (1, 2), ("One", "Two"), 3)]
    degrees = spark.createDataFrame([("p", 2), ("q", 1)], "name string, in_degree long")
    assert rows(bridges.depth_candidates(edges, clusters, pure, degrees)) == [("s", 2, 0, (("p", 1, 2), ("q2", 2, 0)))]
    assert rows(bridges.pair_counts(found)) == [(1, 2, 2)]


def test_empty_bridges(spark):
    edges = spark.createDataFrame([], "src string, dst string")
    clusters = spark.createDataFrame([], "name string, cid int")
    degrees = spark.createDataFrame([], "name string, in_degree long")
    none = bridges.depth_candidates(edges, clusters, clusters.select("cid"), degrees)
    swept = bridges.indegree_sweep(none, degrees)
    assert not swept.count() and bridges.elbow(swept).first()[0] == 0 and not bridges.filtered(none, 0).count()


def levenshtein(a, b):
    a, b = a[:80], b[:80]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_bridges_against_brute_force(spark):
    rng = random.Random(9)
    proofs = [(f"n{i:03}", i % 4, [f"tactic {rng.randint(0, 60)}" for _ in range(rng.choice([5, 6, 90, 130]))]) for i in range(40)]
    proofs += [("copy", 0, proofs[1][2][:-1] + ["x"]), ("single", 9, ["only"] * 5)]
    df = spark.createDataFrame(proofs, "name string, cid int, items array<string>")
    c = similarity.coded(similarity.top_proofs(df, similarity.top_clusters(df), 6)).cache()
    chosen = {}
    for name, cid, items in sorted(proofs, key=lambda p: (-len(p[2]), p[0])):
        if len(chosen.setdefault(cid, [])) < 6:
            chosen[cid].append((name, items))
    ed = lambda x, y: levenshtein(x, y) / max(len(x), len(y), 1)
    inside = [ed(x[1], y[1]) for ps in chosen.values() for x, y in itertools.combinations(ps[:10], 2)] + [1.0 for ps in chosen.values() if len(ps) == 1]
    inside.sort()
    mid = (inside[(len(inside) - 1) // 2] + inside[len(inside) // 2]) / 2
    assert abs(similarity.baseline(c).first()[0] - mid) < 1e-12
    order = sorted(chosen, key=lambda k: (-sum(p[1] == k for p in proofs), k))
    want = []
    for a, b in itertools.combinations(order, 2):
        best = min(((ed(x[1], y[1]), i, j) for i, x in enumerate(chosen[a]) for j, y in enumerate(chosen[b])))
        if best[0] < min(mid, 1.0):
            want.append((a, b, chosen[a][best[1]][0], chosen[b][best[2]][0], round(best[0], 9)))
    got = similarity.edit_bridges(c, spark.createDataFrame([], "cid int, label string"))
    assert rows(got, "cluster_a", "cluster_b", "theorem_a", "theorem_b", "norm_edit_dist") == sorted(want, key=repr)


def test_edit_queries_take_all_of_a_cluster(spark):
    d, k = str(DATA / "sf0.01"), similarity.PER_CLUSTER
    for query, known in ((reference.proof_edit_distance, reference._proof_codes(spark, d)), (reference.token_edit_distance, reference._event_codes(spark, d))):
        sizes = {r["cid"]: r["count"] for r in known.groupBy("cid").count().collect()}
        pairs = {r["cid"]: r["count"] for r in query(spark, d).groupBy("cid").count().collect()}
        assert 10 < max(sizes.values()) <= k and pairs == {c: n * (n - 1) // 2 for c, n in sizes.items() if n > 1}
    p = base.event_sequences(spark, d).where(F.size("items") >= similarity.LEAST_STEPS)
    cut = similarity.coded(similarity.top_proofs(p, similarity.top_clusters(p), 10))
    ten, full = ({(r["cluster_a"], r["cluster_b"]): r["norm_edit_dist"] for r in df.collect()} for df in (reference._bridges_of_events(spark, cut), reference.event_edit_bridges(spark, d)))
    assert all(full[p] <= e for p, e in ten.items()) and any(full[p] < e for p, e in ten.items())
    assert 0 < reference.proof_edit_baseline(spark, d).first()[0] <= 1


def test_validation_verdicts(spark):
    known = {"b": {"x": ["foo", "Foo"], "y": ["bar"]}, "c": {"x": ["foo"], "y": ["nothing"]}, "d": {"x": ["no"], "y": ["none"]}}
    clusters = spark.createDataFrame([("foo1", 1), ("Foo", 2), ("bar", 3), ("foobar", 4)], "name string, cid int")
    pats = validation.patterns(spark, known)
    found = validation.matches(clusters.select("name"), pats)
    spans = validation.span(found, clusters, pats)
    assert rows(spans) == [("b", 3, 2, 1, 3, True), ("c", 2, 0, 0, 2, False), ("d", 0, 0, 0, 0, False)]
    strict = validation.detected(found, spark.createDataFrame([("foobar",)], "theorem string"))
    assert rows(strict, "bridge", "side") == [("b", 0), ("b", 1), ("c", 0)]
    none = strict.limit(0)
    assert rows(validation.verdicts(spans, none, strict)) == [("b", "yes", "YES", "YES (loose)"), ("c", "partial", "no", "YES (loose)"), ("d", "no", "no", "no")]
    assert len(validation.KNOWN_BRIDGES) == 8 and all(len(s) == 2 for s in validation.KNOWN_BRIDGES.values())


def test_complexity_values(spark):
    lab = spark.createDataFrame([(1, "A", 9, False, [("m", 2), ("k", 1)]), (2, "A", 5, False, [("m", 4)]), (3, "C", 1, True, [])], "cid int, label string, size long, is_mixed boolean, top_modules array<struct<module string, cnt long>>")
    cand = spark.createDataFrame([("t", [("p", 2, 1), ("q", 2, 1), ("r", 3, 1), ("s", 1, 1), ("z", 7, 1)])], "theorem string, cross_premises array<struct<premise string, cid int, in_degree long>>")
    clusters = spark.createDataFrame([("t", 1)], "name string, cid int")
    w = complexity.interaction(cand, clusters, lab).cache()
    assert rows(w) == [(1, 2, 1), (1, 3, 1), (2, 1, 1), (3, 1, 1)]
    got = {r["cid"]: r for r in complexity.complexity(w, lab).collect()}
    assert abs(got[1]["integration"] - 1) < 1e-9 and abs(got[1]["differentiation"] - 0.4206) < 1e-4 and got[3]["differentiation"] == 0
    assert abs(complexity.global_complexity(w, lab).first()[0] - 1) < 1e-9
    assert complexity.global_complexity(w.limit(0), lab).first()[0] == 0
    assert got[2]["total_bridge_connections"] == 1


def test_recorded_golden_entropy(spark):
    """Entropy of counts over log2(99) as a recorded run has it."""
    prof = [(3, ["g"], c, n) for c, n in ((1, 3), (2, 1))] + [(3, ["other"], c, 1) for c in range(3, 100)]
    b = bridges.gram_bridges(spark.createDataFrame(prof, "n int, gram array<string>, cid int, cnt long"))
    h = b.where("n_clusters = 2").first()["h_norm"]
    assert abs(h - (-(0.75 * math.log2(0.75) + 0.25 * math.log2(0.25))) / math.log2(99)) < 1e-12


def test_charts_and_reports(spark):
    subs = spark.createDataFrame([(1, 0, "A + B", 6), (1, 1, "B", 3), (1, -1, "X", 9), (2, 0, "C", 1)], "top int, sub int, label string, size long")
    assert rows(charts.hierarchy(subs), "top", "sub", "bar", "left", "shown_label") == [(1, 0, 0, 0.0, "A"), (1, 1, 0, round(2 / 3, 9), "B"), (2, 0, 1, 0.0, "C")]
    b = spark.createDataFrame([(1, 0.5, [1, 2, 3]), (2, 0.25, [2, 1])], "bridge_id int, bridge_score double, cids array<int>")
    assert rows(charts.cluster_edges(b)) == [(1, 2, 0.75), (1, 3, 0.5), (2, 3, 0.5)]
    df = spark.createDataFrame([("x" * 60, 1), ("y", 2)], "t string, n int")
    lines = reports.lines(df, [F.desc("n")], "%2d %s", reports.shortened("t"))
    assert rows(lines) == [(1, " 1 y"), (2, " 2 " + "x" * 54 + "...")]


def test_formats_round_trip(spark, tmp_path):
    from skein import schemas
    from skein.sources import formats

    raw = spark.createDataFrame([("f", [("a", "def"), ("b", None)]), ("g", [])], schemas.RAW_CORPUS)
    assert rows(formats.corpus_rows(raw)) == [("a", "def", "f"), ("b", "", "f")]
    steps = formats.step_rows({"train": spark.createDataFrame([("rw [<a>x</a>]", "t", None)], schemas.RAW_STEPS), "test": spark.createDataFrame([("simp",)], "tactic string")})
    assert rows(steps, "full_name", "tactic", "premises", "split") == [("", "simp", (), "test"), ("t", "rw [x]", ("x",), "train")]
    formats.write_json(steps.drop("ord"), f"{tmp_path}/s")
    back = formats.read_steps(spark, f"{tmp_path}/s")
    assert rows(back, "tactic", "split") == [("rw [x]", "train"), ("simp", "test")]
    formats.write_map(spark.createDataFrame([(2, "b"), (1, "a")], "cid int, label string"), "cid", f"{tmp_path}/m")
    text = next((tmp_path / "m").glob("part*")).read_text()
    assert json.loads(text) == {"1": "a", "2": "b"}
    assert formats.read_or_empty(spark, f"{tmp_path}/none", schemas.CANDIDATES).count() == 0
    with open(tmp_path / "c.jsonl", "w") as f:
        f.write('{"full_name": "a", "kind": "x"}\n{"full_name": "a", "kind": "y"}\n')
    last = formats.read_corpus(spark, f"{tmp_path}/c.jsonl").groupBy("full_name").agg(F.max_by("kind", "ord").alias("kind"))
    assert rows(last) == [("a", "y")]


def test_pipeline_resumes(spark, tmp_path):
    from conftest import DATA

    from skein.plans import pipeline

    if not (DATA / "sf0.001").exists():
        pytest.skip("no test tables")
    d, out = str(DATA / "sf0.001"), str(tmp_path / "run")
    first = pipeline.run(spark, d, out, ["labels"])
    assert {"steps", "edges", "clusters", "labels"} <= set(first) and "sweep" not in first
    stamp = (tmp_path / "run/clusters/_SUCCESS").stat().st_mtime_ns
    every = pipeline.run(spark, d, out)
    assert (tmp_path / "run/clusters/_SUCCESS").stat().st_mtime_ns == stamp and set(every) == set(pipeline.STEPS)
    pipeline.export(spark, out, str(tmp_path / "to"))
    assert (tmp_path / "to/ngram_sweep/_SUCCESS").exists() and (tmp_path / "to/validation_clusters/_SUCCESS").exists()
    validation = spark.read.json(str(tmp_path / "to/validation"))
    assert validation.count() == 16 and {"bridge", "side", "n_matches", "sample_theorems", "clusters_overlap", "detected"} <= set(validation.columns)
    assert "global_cn" in spark.read.json(str(tmp_path / "to/global_complexity")).columns


def test_ingest_from_raw_lines(spark, tmp_path):
    """Two splits and two corpus files by the command line; a later declaration holds, steps stand in the order of lines."""
    import json

    from skein.__main__ import main
    from skein.plans import base

    def lines(name, records):
        (tmp_path / name).write_text("".join(json.dumps(r) + "\n" for r in records))
        return str(tmp_path / name)

    a = lines("a.jsonl", [{"path": "Mathlib/A/X.lean", "premises": [{"full_name": "p", "kind": "def"}, {"full_name": "p", "kind": "lemma"}]}, {"path": "Mathlib/B/Y.lean", "premises": []}])
    b = lines("b.jsonl", [{"path": "Mathlib/B/Z.lean", "premises": [{"full_name": "q", "kind": None}, {"full_name": "p", "kind": "thm"}]}])
    train = lines("train.jsonl", [{"full_name": "t", "file_path": "Mathlib/C/T.lean", "tactic": f"rw [<a>p</a>, h{i}]"} for i in range(40)])
    test = lines("test.jsonl", [{"full_name": "t", "file_path": "", "tactic": "exact <a>q</a>"}, {"full_name": "u"}])
    d = str(tmp_path / "tables")
    main(["ingest", "--corpus", a, b, "--split", f"train={train}", "--split", f"test={test}", "--to", d], spark)
    assert rows(base.corpus(spark, d)) == [("p", "thm", "Mathlib/B/Z.lean"), ("q", "", "Mathlib/B/Z.lean")]
    proofs = {r["name"]: r["tactics"] for r in base.proofs(base.steps(spark, d)).collect()}
    assert proofs == {"t": [f"rw [p, h{i}]" for i in range(40)] + ["exact q"], "u": []}
    main(["run", "--tables", d, "--out", str(tmp_path / "run"), "--step", "edges", "--step", "nodes"], spark)
    assert rows(spark.read.parquet(str(tmp_path / "run/edges"))) == [("t", "p"), ("t", "q")]
    assert {r["name"] for r in spark.read.parquet(str(tmp_path / "run/nodes")).collect()} == {"p", "q", "t", "u"}


def test_complexity_query_equals_the_pipelines_table(spark, tmp_path):
    """The query's interactions are those of the filtered bridges, as the pipeline's step makes them of the same inputs."""
    from conftest import DATA

    from skein.operators import bridges, complexity
    from skein.plans import reference

    if not (DATA / "sf0.001").exists():
        pytest.skip("no test tables")
    d = str(DATA / "sf0.001")
    cand, degrees, c, lab, _ = reference._candidates(spark, d)
    theta = bridges.elbow(bridges.indegree_sweep(cand, degrees)).first()[0]
    kept = bridges.filtered(cand, theta)
    assert 0 < kept.count() < cand.count()
    assert rows(reference.interaction_matrix(spark, d)) == rows(complexity.interaction(kept, c, lab))


def test_stream_equals_batch(spark, tmp_path):
    from datetime import datetime, timedelta

    from skein.streaming import arrivals

    t = datetime(2023, 1, 1)
    events = [(t + timedelta(minutes=7 * i), "a" if i % 3 else "b", float(i)) for i in range(60)]
    df = spark.createDataFrame(events, "ts timestamp, event_type string, value double")
    df.write.parquet(f"{tmp_path}/in")
    late = spark.createDataFrame([(t + timedelta(days=2), "end", 0.0)], df.schema)
    late.write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = arrivals.to_table(arrivals.event_windows(stream), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == rows(arrivals.event_windows(df))
    steps = [(t + timedelta(days=i), i % 5, "· rw [x]" if i % 2 else "") for i in range(20)]
    s = spark.createDataFrame(steps, "recorded_at timestamp, step_id long, tactic string")
    assert sum(r["n"] for r in arrivals.word_counts(s).collect()) == 5 or arrivals.word_counts(s).count() > 0


def test_labels_back_to_clusters(spark):
    lab = spark.createDataFrame([(4, "A"), (2, "A"), (3, "B")], "cid int, label string")
    rec = spark.createDataFrame([("t", [("p", "A", 9), ("q", "B", 1), ("r", None, 2), ("s", "?", 1)])], "theorem string, cross_cluster_premises array<struct<premise string, cluster_label string, in_degree long>>")
    assert rows(complexity.by_label(rec, lab)) == [("t", (("p", 2, 9), ("q", 3, 1), ("r", -1, 2), ("s", -1, 1)))]
    assert rows(complexity.by_label(rec, lab, theta=2, kept=2)) == [("t", (("q", 3, 1), ("r", -1, 2)))]


def test_report_of_candidates(spark):
    found = spark.createDataFrame([("t", 2, 1, [("p", 1, 3), ("q", 2, 1), ("r", 9, 2)])], "theorem string, n_clusters long, min_cross_indegree long, cross_premises array<struct<premise string, cid int, in_degree long>>")
    lab = spark.createDataFrame([(1, "B"), (2, "A")], "cid int, label string")
    line = reports.of_candidates(found, lab).first()["line"]
    assert line.endswith("? · A · B  q(1), r(2), p(3)") and line.startswith("  1  t ")


def test_views(spark, tmp_path):
    from skein.sources.tables import register

    spark.range(3).write.parquet(f"{tmp_path}/some.parquet")
    register(spark, str(tmp_path), ["some"])
    assert spark.sql("select count(*) from some").first()[0] == 3
