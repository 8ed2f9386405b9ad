import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from skein.functions import names, paths, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column("v").alias("x")).first()[0]


@pytest.mark.parametrize("value, want", [("  a.b ", "a.b"), ("_root_.a", "a"), (" _root_._root_.a\t", "_root_.a"), ("_root_.", None), ("", None), (None, None), ("　\n", None), ("A _root_.b", "A _root_.b")])
def test_clean_name(spark, value, want):
    assert one(spark, value, names.clean_name) == want


def test_white_is_unicodes():
    assert all(c.isspace() for c in names.WHITE) and len(set(names.WHITE)) == 25


@pytest.mark.parametrize("value, want", [(None, []), ("", []), ("simp [a,b]; ⟨x⟩", ["simp", "a", "b", "x"]), ("a b\r\nc d", ["a", "b", "c", "d"]), (" · intro {h} ", ["·", "intro", "h"])])
def test_tokens(spark, value, want):
    assert one(spark, value, names.tokens) == want


def test_leading_word_skips_bullets(spark):
    assert one(spark, "· · exact h", names.leading_word) == "exact"
    assert one(spark, "·", names.leading_word) is None


EXAMPLES = {
    "rw [Finset.sum_comm]": "rw [@]", "rw [h]": "rw [?]", "rw [← hx]": "rw [← ?]", "simp [Finset.mem_range, hf]": "simp [@, ?]", "intro x": "intro ?",
    "apply le_antisymm": "apply @", "cases' n with n": "cases' ? with ?", "exact ⟨h, rfl⟩": "exact ⟨?, rfl⟩", "norm_cast": "norm_cast", "constructor": "constructor",
    "rintro ⟨y, hy⟩": "rintro ⟨?, ?⟩", "have h := Nat.lt_of_lt_pred h": "have ? := @ ?", "simp only [Matrix.mul_fin_two, h]": "simp only [@, ?]", "exact hf.continuous.measurable": "exact @",
    "funext x": "funext ?", "ext1": "ext1", "apply Finset.sum_congr rfl": "apply @ rfl", "intro j hj": "intro ? ?", "classical infer_instance": "classical infer_instance",
    "split_ifs with h": "split_ifs with ?", "by_contra! h": "by_contra! ?", "rw [h₁]": "rw [h₁]", "h' x": "?' ?", "norm_num'x": "@", "hypothesis": "hypothesis", "tfae_have 1 → 2": "tfae_have # → #",
}


@pytest.mark.parametrize("value, want", EXAMPLES.items())
def test_normalised_examples(spark, duck, value, want):
    assert one(spark, value, text.normalised) == want
    assert duck.execute(f"select {text.sql_normalised('v')} from (select ? v)", [value]).fetchall() == [(want,)]


def restated(t):
    """The rules once more, with Python's own word boundaries."""
    kw = set(text.KEYWORDS)
    t = " ".join(t.split())
    t = re.sub(r"\b(?:[A-Za-z][A-Za-z0-9_']*(?:\.[A-Za-z0-9_']+)+|[A-Z][A-Za-z0-9_']{3,})\b", "@", t)
    for body, to in ((r"\b[a-z][a-z0-9']*(?:_[a-z0-9']+)+\b", "@"), (r"\b[a-z][a-z0-9']{0,3}\b", "?")):
        t = re.sub(body, lambda m, to=to: m.group(0) if m.group(0) in kw else to, t)
    return re.sub(r"\b\d+\b", "#", t)


def test_normalised_random(spark, duck):
    import random

    rng = random.Random(7)
    bits = ["a", "h", "Foo", ".", "_", "'", "₁", "φ", " ", "12", "simp", "norm_num", "at", "(", "⟨", "x", "[", "é", "cases'", "B9"]
    made = sorted({"".join(rng.choices(bits, k=rng.randint(1, 9))) for _ in range(3000)})
    df = spark.createDataFrame([(m,) for m in made], "v string").select("v", text.normalised("v").alias("n"))
    got = dict(df.collect())
    assert {m: got[m] for m in made} == {m: restated(m) for m in made}
    sql = dict(duck.execute(f"select v, {text.sql_normalised('v')} from (select unnest(?::varchar[]) v)", [made]).fetchall())
    assert sql == got


def test_anchors(spark):
    assert one(spark, "rw [<a>x.y</a>, <a>z</a>] <a>b\nc</a>", text.anchors) == ["x.y", "z"]
    assert one(spark, " rw [<a>x$1</a>] ", text.without_anchors) == "rw [x$1]"


@pytest.mark.parametrize("path, module, top, sub", [
    ("Mathlib/Topology/Basic.lean", "Mathlib.Topology.Basic", "Topology", "Topology"), ("a/Mathlib/B/Mathlib/C.lean", "Mathlib.B.Mathlib.C", "B", "B"), ("Mathlib.lean", "Mathlib", "Mathlib", "Mathlib"),
    (".lake/packages/batteries/Batteries/X.lean", ".lake/packages/batteries/Batteries/X", "Batteries", "External"), ("Foo/Bar.v2/x.lean", "Foo/Bar.v2/x", "External", "External"), ("", "", "Unknown", "Unknown"), (None, "", "Unknown", "Unknown"),
])
def test_paths(spark, path, module, top, sub):
    df = spark.createDataFrame([(path,)], "p string").select(paths.module_of("p"), paths.top_module("p"), paths.top_module("p", []))
    assert tuple(df.first()) == (module, top, sub)


def test_all_generic(spark):
    df = spark.createDataFrame([(["simp [x]", "ext"],), (["simp", "gcongr"],)], "gram array<string>")
    assert rows(df.select(text.all_generic(F.col("gram")).alias("x"))) == [(False,), (True,)]
