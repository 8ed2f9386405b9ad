"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import clean_name, clean_names, leading_word, sql_name, sql_tokens, tokens
from ..operators.graph import connected_components
from ..sources.shared import written
from ..sources.tables import first_delivery, table
from . import cooccurrence, neardup, packing, residue, subsequences, terms, tokenize

MAX_GAP, LENGTHS, WINDOW, LEAST_WINDOWS, SIMILARITY = 5, (3, 4), 3, 20, 0.7


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tactic_steps")


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every token of the tactics and element of the n-grams with its occurrences, records and mark."""
    steps = first_delivery(_steps(spark, d), "step_id", {"tactic": F.col("tactic")})
    bridges = table(spark, d, "bridges")
    records = steps.select(F.lit("tactic").alias("field"), tokens("tactic").alias("terms")).unionByName(bridges.select(F.lit("ngram").alias("field"), F.col("ngram").alias("terms")))
    totals = {"tactic": _steps(spark, d).select("step_id").where("step_id is not null").distinct().count(), "ngram": bridges.count()}
    return terms.marked(terms.term_counts(records), totals).withColumnRenamed("field", "src_field")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_terms(spark, d).where("mark is not null").select("src_field", "term", "mark")


def p4_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Frequent orders of three or four leading words with the number of proofs that hold them."""
    rows = _steps(spark, d).select(clean_name("full_name").alias("name"), "step_no", "step_id", "tactic")
    blocks = subsequences.ordered_blocks(rows, F.array_compact(F.array(leading_word("tactic"))), MAX_GAP * (max(LENGTHS) - 1))
    found = subsequences.frequent_subsequences(blocks.select("long", "values"), MAX_GAP, LENGTHS)
    return found.select(F.array_join("items", " > ").alias("step_pattern"), F.col("n_sequences").alias("n_proofs"), "share")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_patterns(spark, d).select("step_pattern")


def proof_windows(spark: SparkSession, d: str, tall: int = neardup.TALL) -> tuple[DataFrame, DataFrame | None]:
    """The set of runs of three tokens of each proof, as 64-bit hashes, from 20 windows on: ``name, windows`` (sorted), and
    ``name, window`` of proofs of more than ``tall`` windows, None if there are none."""
    rows = _steps(spark, d).select(clean_name("full_name").alias("name"), "step_no", "step_id", "tactic")
    blocks = subsequences.ordered_blocks(rows, tokens("tactic"), WINDOW - 1).where(F.size("values") >= WINDOW)
    at = lambda i, k: F.element_at("values", (i + k).cast("int"))
    runs = F.transform(F.sequence(F.lit(1), F.size("values") - (WINDOW - 1)), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))
    made = written(blocks.select("name", "long", F.array_distinct(runs).alias("windows")))
    is_one = F.col("long").isNull() & (F.size("windows") <= tall)
    whole = made.where(is_one).select("name", "windows")
    over = made.where(~is_one)
    each = None
    if over.limit(1).count():
        each = written(over.select("name", F.explode("windows").alias("window")).distinct())
        large = each.groupBy("name").count().where(F.col("count") > tall).select("name")
        small = each.join(large, "name", "left_anti").groupBy("name").agg(F.collect_list("window").alias("windows"))
        whole, each = whole.unionByName(small), written(each.join(large, "name", "left_semi"))
        each = each if each.limit(1).count() else None
    return whole.where(F.size("windows") >= LEAST_WINDOWS).select("name", F.array_sort("windows").alias("windows")), each


def _similar(spark: SparkSession, d: str, tall: int = neardup.TALL) -> tuple[DataFrame, DataFrame]:
    sets, each = proof_windows(spark, d, tall)
    members, one = neardup.classes(sets)
    one = written(one)
    if each is None:
        return members, written(neardup.similar_classes(one, SIMILARITY))
    more, rows = neardup.tall_classes(each)
    return members.unionByName(more), written(neardup.similar_classes(one, SIMILARITY, written(rows), part=tall))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    members, pairs = _similar(spark, d)
    return neardup.expand(pairs, members)


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per proof name with at least 20 windows: the least name of its class of equal proofs, the least name of its
    group of linked classes, and its number of links."""
    members, pairs = _similar(spark, d)
    sizes = written(members.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("class_name")))
    ends = pairs.select(F.col("a").alias("class_id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("class_id"), F.col("a").alias("other")))
    links = ends.join(sizes.select(F.col("class_id").alias("other"), "n"), "other").groupBy("class_id").agg(F.sum("n").alias("n_other"))
    groups = connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("class_id"), F.col("component").alias("group"))
    per_class = sizes.join(links, "class_id", "left").join(groups, "class_id", "left")
    per_class = written(per_class.select("class_id", "class_name", F.coalesce("group", "class_id").alias("group"), (F.col("n") - 1 + F.coalesce("n_other", F.lit(0))).alias("n_links")))
    named = per_class.groupBy("group").agg(F.min("class_name").alias("group_name"))
    return members.join(per_class.join(named, "group"), "class_id").select("name", "class_name", "group_name", "n_links")


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of premises cited together by at least 5 steps and 4 times as often as chance explains."""
    steps = first_delivery(_steps(spark, d), "step_id", {"items": clean_names("premises")})
    found = cooccurrence.together(steps.select("items"))
    return found.select(F.col("item_a").alias("premise_a"), F.col("item_b").alias("premise_b"), F.col("n_ab").alias("n_common"), "n_a", "n_b", "n", F.round("lift", 9).alias("lift"), F.round("llr", 6).alias("llr"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pairs(spark, d).select("premise_a", "premise_b")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encoded(table(spark, d, "documents").select("doc_id", "text"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts again, from their ids; empty for a null text."""
    return tokenize.decoded(p7_ids(spark, d))


def p7_words(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct word with its ids and occurrences."""
    return tokenize.word_table(table(spark, d, "documents").select("text"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of each text, or of each piece of a text beyond 2,048 tokens."""
    return packing.packed(tokenize.token_counts(table(spark, d, "documents").select("doc_id", "text")))


def p8_summary(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, the least number by the sum of tokens and by the program's dual, and the share of room that is filled."""
    placed = written(p8_containers(spark, d))
    least = packing.dual_bound({r[0]: r[1] for r in placed.groupBy("n_tokens").count().collect()})  # at most capacity rows
    per = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    filled = F.sum("n") / (F.count(F.lit(1)) * packing.CAPACITY)
    return per.agg(F.count(F.lit(1)).alias("n_containers"), F.ceil(F.sum("n") / packing.CAPACITY).alias("least_possible"), F.lit(least).cast("long").alias("dual_bound"), F.max("n").alias("fullest"), filled.alias("filled"))


def p9_reasons(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_reasons(spark, d).select("doc_id").distinct()


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """The table without the documents that hold residue."""
    return table(spark, d, "documents").join(p9_found(spark, d), "doc_id", "left_anti")


QUERIES = {f.__name__: f for f in (p3_terms, p3_found, p4_patterns, p4_found, p5_found, p5_groups, p6_pairs, p6_found, p7_ids, p7_decoded, p7_words, p8_containers, p8_summary, p9_reasons, p9_found, p9_clean)}

_TERMS = f"""steps as (select step_id, arg_min(coalesce(tactic, ''), ord) tactic from tactic_steps where step_id is not null group by 1),
records as (
  select 'tactic' src_field, step_id id, {sql_tokens('tactic')} terms from steps
  union all select 'ngram', bridge_no, ngram from bridges),
totals as (select src_field, count(*) total from records group by 1),
counts as (select src_field, term, count(*) n_occurrences, count(distinct id) n_records from (select src_field, id, unnest(terms) term from records) where term is not null group by 1, 2),
marked as (select c.*, case when n_records < 3 then 'rare' when n_records > 0.05 * total then 'common' end mark from counts c join totals using (src_field))"""
_WORD = f"list_filter({sql_tokens('tactic')}, lambda x: x <> '·')[1]"
_STEPS = f"steps as (select distinct {sql_name('full_name')} name, coalesce(step_no, -1) step_no, step_id, tactic from tactic_steps)"
_PATTERNS = f"""{_STEPS},
words as (select name, row_number() over (partition by name order by step_no, step_id) p, w from (select name, step_no, step_id, {_WORD} w from steps where name is not null) where w is not null),
three as (select count(*) n from (select name from words group by 1 having count(*) >= 3)),
p3 as (select a.name, a.w || ' > ' || b.w || ' > ' || c.w pattern, c.p from words a
  join words b on b.name = a.name and b.p between a.p + 1 and a.p + 5 join words c on c.name = a.name and c.p between b.p + 1 and b.p + 5),
p4 as (select p3.name, pattern || ' > ' || e.w pattern from p3 join words e on e.name = p3.name and e.p between p3.p + 1 and p3.p + 5),
held as (select pattern, count(distinct name) n_proofs from (select name, pattern from p3 union all select name, pattern from p4) group by 1),
found as (select pattern step_pattern, n_proofs, n_proofs / n::double share from held, three where n_proofs >= 8 and n_proofs >= 0.025 * n)"""
_WINDOWS = f"""{_STEPS},
tok as (select name, list(t order by step_no, step_id) t from (select name, step_no, step_id, {sql_tokens('tactic')} t from steps where name is not null) group by 1),
flat as (select name, flatten(t) t from tok),
win as (select distinct name, t[i] || chr(1) || t[i + 1] || chr(1) || t[i + 2] w from (select name, t, unnest(range(1, len(t) - 1)) i from flat)),
sized as (select name, count(*) n from win group by 1 having count(*) >= 20),
kept as (select w.name, w, n from win w join sized using (name)),
found as (select a.name name_a, b.name name_b from kept a join kept b on a.w = b.w and a.name < b.name group by 1, 2 having count(*) >= 0.7 * (any_value(a.n) + any_value(b.n) - count(*)))"""
_PAIRS = f"""items as (select distinct step_id, p from (select step_id, {sql_name('p')} p from (select step_id, unnest(premises) p from tactic_steps)) where p is not null and step_id is not null),
total as (select count(distinct step_id) n from items), single as (select p, count(*) n from items group by 1),
pairs as (select a.p premise_a, b.p premise_b, count(*) n_common from items a join items b on a.step_id = b.step_id and a.p < b.p group by 1, 2 having count(*) >= 5),
found as (select premise_a, premise_b, n_common, x.n n_a, y.n n_b, total.n n from pairs, total, single x, single y where x.p = premise_a and y.p = premise_b and n_common * total.n >= 4 * x.n * y.n)"""


def _xlogx(e: str) -> str:
    return f"(case when {e} > 0 then ({e}) * ln(({e})::double) else 0 end)"


_LLR = " ".join(sign + _xlogx(e) for sign, e in (("", "n_common"), ("+", "n_a - n_common"), ("+", "n_b - n_common"), ("+", "n - n_a - n_b + n_common"), ("+", "n"), ("-", "n_a"), ("-", "n - n_a"), ("-", "n_b"), ("-", "n - n_b")))

SQL = {
    "p3_terms": f"with {_TERMS} select * from marked",
    "p3_found": f"with {_TERMS} select src_field, term, mark from marked where mark is not null",
    "p4_patterns": f"with {_PATTERNS} select * from found",
    "p4_found": f"with {_PATTERNS} select step_pattern from found",
    "p5_found": f"with {_WINDOWS} select * from found",
    "p5_groups": f"""with recursive {_WINDOWS},
ends as (select name_a a, name_b b from found union all select name_b, name_a from found),
same as (select name, md5(string_agg(w, chr(2) order by w)) class from kept group by 1),
cc(node, root) using key (node) as (select name, name from sized union
  select e.b, min(cc.root) from cc join ends e on e.a = cc.node join recurring.cc old on old.node = e.b where encode(cc.root) < encode(old.root) group by e.b),
links as (select a, count(*) n from ends group by 1)
select s.name, min(s.name) over (partition by class) class_name, root group_name, coalesce(n, 0) n_links from same s join cc on cc.node = s.name left join links on links.a = s.name""",
    "p6_pairs": f"with {_PAIRS} select *, round(n_common::double * n / (n_a::double * n_b), 9) lift, round(2 * ({_LLR}), 6) llr from found",
    "p7_decoded": "select doc_id, coalesce(text, '') as text from documents",
    "p6_found": f"with {_PAIRS} select premise_a, premise_b from found",
}
