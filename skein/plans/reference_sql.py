"""SQL with the results of ``reference``, for an engine that reads the same tables."""

from __future__ import annotations

from ..functions.names import WHITE, quoted, sql_name, sql_tokens
from ..functions.paths import sql_module_of, sql_top_module
from ..functions.text import GENERIC, sql_collapsed, sql_normalised
from ..operators.charts import COLOURS, OTHER_COLOUR
from ..operators.validation import KNOWN_BRIDGES
from .base import ABSTRACT, ALL, CLUSTERS, CORPUS, EDGES, EVENTS, GRAPH, LABELS, NODES, PROOFS, RECORDED, ST

_GENERIC = ", ".join(f"'{g}'" for g in GENERIC)
_DEG = "deg as (select nd.name, count(ed.src) in_degree from nd left join ed on ed.dst = nd.name group by 1)"
_UND = "ud as (select distinct least(src, dst) src, greatest(src, dst) dst from ed where src <> dst)"
_SHOWN = "label, dominant_module, round(dominant_fraction, 6) dominant_fraction, round(entropy, 6) entropy, round(norm_entropy, 6) norm_entropy, is_mixed, size, top_modules"
_COMPONENTS = """ends as (select src a, dst b from links union select dst, src from links),
reach as (select a node, a root from ends union select e.b, r.root from reach r join ends e on e.a = r.node)"""
# least reachable name by rounds in which only changed nodes tell their neighbours
_LEAST = f"""with recursive {GRAPH}, ends as (select src a, dst b from ed union select dst, src from ed),
cc(node, component) using key (node) as (select name, name from nd union
  select e.b, min(cc.component) from cc join ends e on e.a = cc.node join recurring.cc old on old.node = e.b where encode(cc.component) < encode(old.component) group by e.b)"""


def _labels_of(source: str) -> str:
    """The label CTEs over another member table ``(cid, module)``."""
    tail = LABELS[LABELS.index("rk as") :]
    return f"mods as (select cid, module, count(*) cnt from {source} group by 1, 2),\n{tail}"


def _grams(items: str, lengths: str, sep: str) -> str:
    return f"grams as (select cid, n, array_to_string(items[i:i + n - 1], '{sep}') gram, items[i:i + n - 1] g from (select cid, n, items, unnest(range(1, len(items) - n + 2)) i from (select cid, items, unnest({lengths}) n from {items})))"


_STREAM = f"{ST},\n{CLUSTERS},\n{ABSTRACT},\ntk as (select distinct x, {sql_tokens('x')} t from (select unnest(items) x from ab)),\nsq as (select name, unnest(items) x, generate_subscripts(items, 1) i from ab),\nfl as (select name, flatten(list(t order by i)) items from sq join tk using (x) group by 1),\nseqs as (select cm.cid, fl.items from fl join cm using (name) join ab using (name) where len(ab.items) >= 3)"
_ITEMS = f"{ST},\n{CLUSTERS},\n{ABSTRACT},\nseqs as (select cm.cid, ab.items from ab join cm using (name) where len(items) >= 3)"
_SWEEP = """spread as (select n, gram, count(distinct cid) k from grams group by 1, 2),
swept as (select n, count(*) total_unique, avg((k >= 2)::int) frac_ge2, avg((k >= 3)::int) frac_ge3, avg((k >= 5)::int) frac_ge5, quantile_cont(k, 0.5) median_clusters, quantile_cont(k, 0.9) p90_clusters, max(k) max_clusters from spread group by 1)"""
_SWEPT = "select n::int n, total_unique, round(frac_ge2, 6) frac_ge2, round(frac_ge3, 6) frac_ge3, round(frac_ge5, 6) frac_ge5, round(median_clusters, 6) median_clusters, round(p90_clusters, 6) p90_clusters, max_clusters from swept"


def _bridges(min_count: int, generic: bool, top: int | None) -> str:
    keep = f"where list_bool_or(list_transform(g, lambda x: string_split(x, ' ')[1] not in ({_GENERIC})))" if generic else ""
    limit = f"qualify row_number() over (partition by n order by round(h_norm * (1 - m), 9) desc, array_to_string(g, chr(1))) <= {top}" if top else ""
    return f"""prof as (select n, gram, g, cid, count(*) cnt from grams group by 1, 2, 3, 4),
tot as (select n, cid, sum(cnt) total from prof group by 1, 2), kk as (select n, count(*) k from tot group by 1),
agg as (select n, gram, g, count(*) c, (sum(sum_cnt) )::double s, sum(l) l, avg(rel) m, string_agg(cid || ':' || cnt, ',' order by cid) cluster_counts
  from (select p.n, p.gram, p.g, p.cid, p.cnt, p.cnt sum_cnt, p.cnt * log2(p.cnt) l, p.cnt / t.total::double rel from prof p join tot t using (n, cid) where p.cnt >= {min_count}) group by 1, 2, 3 having count(*) >= 2),
sc as (select *, case when k > 1 then abs(log2(s) - l / s) / log2(k) else 0 end h_norm from agg join kk using (n)),
br as (select n::int n, gram, c n_clusters, round(h_norm, 6) h_norm, round(1 - m, 6) rarity, round(h_norm * (1 - m), 6) bridge_score, round(m, 6) mean_relative_freq, cluster_counts from sc {keep} {limit})"""


_LINKS = """lk as (select e.src, e.dst, s.cid cid_s, p.cid cid_p from ed e join cm p on p.name = e.dst join pure on pure.cid = p.cid join cm s on s.name = e.src)"""
_BT = f"""{_LINKS},
hit as (select distinct src, cid_s, cid_p from lk),
bt as (select src theorem, cid_s, count(*) n_premise_clusters, list(cid_p order by cid_p) ids, string_agg(l.label, ';' order by l.label) labels from hit join lab l on l.cid = cid_p group by 1, 2 having count(*) >= 2)"""
_DC = f"""{_LINKS}, {_DEG},
cr as (select lk.*, in_degree from lk join deg on deg.name = lk.dst where cid_p <> cid_s),
dc as (select src theorem, any_value(cid_s) cid_s, count(distinct cid_p) n_clusters, min(in_degree) min_cross_indegree, string_agg(dst || ':' || cid_p || ':' || in_degree, ',' order by encode(dst)) cross_premises from cr group by 1 having count(distinct cid_p) >= 2)"""
_SW = f"""{_DC},
pp as (select floor(quantile_cont(in_degree, 0.9))::bigint p90 from deg),
th as (select unnest(range(0, p90 + 1, greatest(1, p90 // 100))) theta from pp),
sw as (select theta, (select count(*) from dc where min_cross_indegree <= theta) count from th)"""
_EL = f"""{_SW},
nm as (select theta, (theta - min(theta) over ()) / (max(theta) over () - min(theta) over () + 1e-9) x, (count - min(count) over ()) / (max(count) over () - min(count) over () + 1e-9) y from sw),
en as (select arg_min(x, theta) x1, arg_min(y, theta) y1, arg_max(x, theta) x2, arg_max(y, theta) y2, count(*) n from nm),
ds as (select theta, n, round(abs((x2 - x1) * (y1 - y) - (y2 - y1) * (x1 - x)) / (sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) + 1e-9), 12) d from nm, en),
el as (select coalesce(case when max(n) >= 3 then arg_max(theta, {{'d': d, 't': -theta}}) else max(theta) end, 0) theta from ds)"""

_SIDES = [("mesh / fold", 0, "mesh."), ("mesh / fold", 1, "fold."), ("norm / trace", 0, "norm_"), ("norm / trace", 0, ".norm"), ("norm / trace", 1, "trace"), ("left / missing", 0, "_left"), ("left / missing", 1, "Brouwer")]


def _pats(rows: list[tuple[str, int, str]]) -> str:
    return "pats(bridge, side, pattern) as (values " + ", ".join(f"('{b}', {s}, '{p}')" for b, s, p in rows) + ")"


_PATS = _pats(_SIDES)
_KNOWN = _pats([(b, i, p) for b, sides in KNOWN_BRIDGES.items() for i, ps in enumerate(sides.values()) for p in ps])
_MT = f"{_PATS},\nmt as (select distinct bridge, side, name from cm, pats where contains(name, pattern))"
_SPAN = """sd as (select bridge, count(*) filter (side = 0) n_a, count(*) filter (side = 1) n_b, coalesce(list(distinct cid) filter (side = 0), []) a, coalesce(list(distinct cid) filter (side = 1), []) b from (select distinct bridge from pats) left join (mt join cm using (name)) using (bridge) group by 1),
sp as (select bridge, n_a, n_b, len(list_intersect(a, b)) clusters_overlap, len(list_distinct(a || b)) - len(list_intersect(a, b)) clusters_separated,
  len(list_filter(a, lambda x: not list_contains(b, x))) > 0 and len(list_filter(b, lambda x: not list_contains(a, x))) > 0 bridge_spans_clusters from sd)"""
_W = f"""{_EL},
xl as (select distinct theorem, cr.cid_s i, cr.cid_p j from dc join cr on cr.src = dc.theorem cross join el where min_cross_indegree <= el.theta),
on1 as (select i, j, count(*) w from xl group by 1, 2),
w as (select i, j, sum(w)::bigint weight from (select i, j, w from on1 union all select j, i, w from on1) group by 1, 2),
rs as (select *, weight / (sum(weight) over (partition by i))::double p from w),
ig as (select lab.cid, coalesce(-sum(p * log2(p + 1e-12)), 0) integration, coalesce(sum(weight), 0)::bigint total_bridge_connections from lab left join rs on rs.i = lab.cid group by 1)"""
_DF = """tm as (select cid, cnt / (sum(cnt) over (partition by cid))::double p from tmod),
df as (select cid, 1 + sum(p * log2(p + 1e-12)) / log2(count(*) + 1) differentiation from tm group by 1)"""
_NC = f"{_W},\n{_DF},\nnc as (select lab.*, integration, differentiation, integration * differentiation neural_complexity, total_bridge_connections from lab join ig using (cid) join df using (cid))"
_COLOUR = "case string_split(label, ' + ')[1] " + " ".join(f"when '{m}' then '{c}'" for m, c in COLOURS.items()) + f" else '{OTHER_COLOUR}' end"
_RW = f"""{RECORDED},
bt0 as (select bridge_id, {sql_name('any_value(theorem)')} theorem, any_value(cross_cluster_premises) ps from bridge_theorems_filtered group by 1),
fl as (select label, min(cid) cid from lab group by 1),
pl as (select distinct theorem, coalesce(fl.cid, -1) j from (select theorem, unnest(ps).cluster_label as label from bt0 where theorem is not null) left join fl using (label)),
on1 as (select cm.cid i, j, count(*) w from pl join cm on cm.name = pl.theorem where cm.cid <> j and j in (select cid from lab) and cm.cid in (select cid from lab) group by 1, 2),
w as (select i, j, sum(w)::bigint weight from (select i, j, w from on1 union all select j, i, w from on1) group by 1, 2),
rs as (select *, weight / (sum(weight) over (partition by i))::double p from w),
ig as (select lab.cid, coalesce(-sum(p * log2(p + 1e-12)), 0) integration, coalesce(sum(weight), 0)::bigint total_bridge_connections from lab left join rs on rs.i = lab.cid group by 1)"""
_CODES = f"""{EVENTS},
q as (select * from es where len(items) >= 5),
tc as (select cid, count(*) n_proofs, row_number() over (order by count(*) desc, cid) cluster_rank from q group by 1 order by 2 desc, 1 limit 30),
tp as (select q.cid, name, items, len(items) len, cluster_rank, row_number() over (partition by q.cid order by len(items) desc, name) rn,
  array_to_string(list_transform(items[1:80], lambda x: chr(97 + list_position(['click', 'error', 'purchase', 'signup', 'view'], x)::int)), '') code from q join tc using (cid) qualify rn <= 30),
within as (select levenshtein(x.code, y.code) / greatest(x.len, y.len, 1)::double d from tp x join tp y on x.cid = y.cid and x.rn < y.rn where y.rn <= 10
  union all select 1.0 from tp group by cid having count(*) = 1),
bl as (select quantile_cont(d, 0.5) baseline from within)"""
_QP = f"{ST},\n{CLUSTERS},\n{ABSTRACT},\nq as (select name, cid, len(items) len from ab join cm using (name) where len(items) >= 5)"
_CGE = "ce as (select a.cid cid_a, b.cid cid_b, sum(a.bridge_score) weight from x a join x b on a.bridge_no = b.bridge_no and a.cid < b.cid group by 1, 2)"
_X = f"x as (select bridge_no, bridge_score, unnest(map_keys(cluster_counts)) cid from bridges),\n{_CGE}"
_HIER = f"""{ALL},
tt as (select cid as top, sum(cnt) total from rk group by 1), bar as (select top, total, row_number() over (order by total desc, top) - 1 bar from tt order by total desc, top limit 15),
fr as (select bar.top, rank - 1 sub, bar, bar.total::bigint total, module as label, cnt, cnt / bar.total::double fraction from rk join bar on bar.top = rk.cid)"""
_TEXT = "from tactic_steps where tactic is not null"

SQL = {
    "corpus_last_wins": f"with {CORPUS} select * from co",
    "first_value_per_key": f"with {ST}, {CORPUS}, {NODES} select * from fp",
    "proof_sequences": f"with {ST}, {PROOFS} select name, len(tactics) n_tactics, array_to_string(tactics, chr(10)) tactics from pr",
    "graph_nodes": f"with {GRAPH} select name, file_path, {sql_module_of('file_path')} as module from nd",
    "graph_edges": f"with {ST}, {EDGES} select * from ed",
    "graph_size": f"with {GRAPH} select (select count(*) from nd) n_nodes, (select count(*) from ed) n_edges",
    "in_degree": f"with {GRAPH}, {_DEG} select * from deg",
    "indegree_p90": f"with {GRAPH}, {_DEG} select floor(quantile_cont(in_degree, 0.9))::bigint p90 from deg",
    "indegree_histogram": f"with {GRAPH}, {_DEG} select in_degree, count(*) n_nodes from deg where in_degree > 0 group by 1",
    "undirected_edges": f"with {ST}, {EDGES}, {_UND} select * from ud",
    "induced_subgraph": f"with {ST}, {EDGES}, {CLUSTERS} select a.cid, src, dst from ed join cm a on a.name = src join cm b on b.name = dst where a.cid = b.cid",
    "node_index": f"with {CLUSTERS} select cid, row_number() over (order by cid) - 1 idx from (select distinct cid from cm)",
    "connected_components": f"{_LEAST} select node, component from cc",
    "largest_component": f"{_LEAST} select node from cc where component = (select component from cc group by 1 order by count(*) desc, encode(component) limit 1)",
    "component_sizes": f"{_LEAST} select component, count(*) n_nodes from cc group by 1",
    "modularity": f"""with {ST}, {EDGES}, {_UND}, {CLUSTERS}, e as (select a.cid ca, b.cid cb from ud join cm a on a.name = src join cm b on b.name = dst),
dg as (select cid, count(*) d from (select ca cid from e union all select cb from e) group by 1)
select round((select count(*) from e where ca = cb) / (sum(d) / 2) - sum(d::double * d) / (sum(d)::double * sum(d)), 6) modularity from dg""",
    "sub_lcc_status": f"""with recursive {ST}, {EDGES}, {CLUSTERS},
links as (select a.cid || chr(1) || src src, a.cid || chr(1) || dst dst from ed join cm a on a.name = src join cm b on b.name = dst where a.cid = b.cid),
{_COMPONENTS}, cc as (select cm.cid, cm.name, coalesce(r.c, cm.cid || chr(1) || cm.name) c from cm left join (select node, min(root) c from reach group by 1) r on r.node = cm.cid || chr(1) || cm.name),
sz as (select cid, c, count(*) n from cc group by 1, 2), best as (select cid, c, n from sz qualify row_number() over (partition by cid order by n desc, c) = 1)
select cc.cid, name, cc.c = best.c in_lcc, best.n >= 10 splittable from cc join best using (cid)""",
    "module_from_path": f"select file_path, {sql_module_of('file_path')} as module from (select distinct file_path from tactic_steps)",
    "module_parts": f"select file_path, {sql_top_module('file_path')} as top_module, {sql_top_module('file_path', [])} as top_module_sub, string_split({sql_module_of('file_path')}, '.')[2] as summary_module from (select distinct file_path from tactic_steps)",
    "cluster_summary": f"""with {GRAPH}, nm as (select cm.cid, string_split({sql_module_of('nd.file_path')}, '.')[2] as module from cm left join nd using (name)),
c as (select cid, module, count(*) cnt, row_number() over (partition by cid order by count(*) desc, module) r from nm where module is not null group by 1, 2)
select cid, size, coalesce(t, '') top_modules from (select cid, count(*) size from nm group by 1) left join (select cid, string_agg(module || ':' || cnt, ',' order by r) t from c where r <= 5 group by 1) using (cid)""",
    "module_distribution": f"with {ALL} select * from mods",
    "cluster_labels": f"with {ALL} select cid, {_SHOWN} from lab",
    "mixed_pure_counts": f"with {ALL} select count(*) n_clusters, count(*) filter (is_mixed) n_mixed, (select count(*) from pure) n_pure from lab",
    "pure_clusters": f"with {ALL} select * from pure",
    "source_labels": f"with m as (select coalesce(source, '?') cid, coalesce(lang, '?') as module from documents), {_labels_of('m')} select cid, {_SHOWN} from lab",
    "anchor_extract": "select anchor, count(*) n from (select unnest(regexp_extract_all(tactic, '<a>(.*?)</a>', 1)) anchor from tactic_steps) group by 1",
    "anchor_extract_joined": "select anchor, count(*) n from (select unnest(regexp_extract_all(replace(tactic, chr(10), ' '), '<a>(.*?)</a>', 1)) anchor from tactic_steps) group by 1",
    "anchor_clean": f"select ord, trim(regexp_replace(tactic, '<a>(.*?)</a>', '\\1', 'g'), {quoted(WHITE)}) tactic from tactic_steps",
    "whitespace_collapse": f"select ord, {sql_collapsed('tactic')} as tactic {_TEXT}",
    "normalize_text": f"select tactic, {sql_normalised('tactic')} as normal from (select distinct tactic {_TEXT})",
    "tokenise": f"select ord, array_to_string({sql_tokens('tactic')}, ' ') as tokens from tactic_steps",
    "token_stream": f"""with {ST}, {PROOFS}, tk as (select tactic, {sql_tokens('tactic')} as t from (select distinct tactic from st)),
fl as (select name, array_to_string(flatten(list(t order by step_no, step_id)), ' ') tokens from st join tk using (tactic) group by 1) select name, tokens from fl""",
    "ngrams_of_words": f"""with {ST}, ws as (select name, step_no, step_id, list_filter({sql_tokens('tactic')}, lambda x: x <> '·')[1] w from st),
lead_ as (select w a, lead(w, 1) over z b, lead(w, 2) over z c from ws where w is not null window z as (partition by name order by step_no, step_id))
select a || ' | ' || b || ' | ' || c gram, count(*) cnt from lead_ where c is not null group by 1""",
    "ngram_profile": f"with {_ITEMS}, {_grams('seqs', '[3]', ' | ')} select n::int n, cid, gram, count(*) cnt from grams group by 1, 2, 3, g",
    "ngram_sweep": f"with {_STREAM}, {_grams('seqs', 'range(1, 9)', ' ')}, {_SWEEP} {_SWEPT}",
    "best_n": f"with {_STREAM}, {_grams('seqs', 'range(1, 9)', ' ')}, {_SWEEP} select coalesce(min(n) filter (n >= 2 and frac_ge2 < 0.02), 3)::int best_n from swept",
    "generic_filter": f"with {_ITEMS}, {_grams('seqs', '[3]', ' | ')} select distinct gram from grams where list_bool_and(list_transform(g, lambda x: string_split(x, ' ')[1] in ({_GENERIC})))",
    "bridge_scores": f"with {_ITEMS}, {_grams('seqs', '[3, 4, 5]', ' | ')}, {_bridges(1, True, None)} select * from br",
    "bridge_list": f"""with {_STREAM.replace('seqs as', 'tseqs as')}, seqs as (select cm.cid, ab.items from ab join cm using (name) where len(items) >= 3),
{_grams('tseqs', 'range(1, 9)', ' ').replace('grams as', 'tgrams as')}, {_SWEEP.replace('from grams', 'from tgrams')}, bn as (select coalesce(min(n) filter (n >= 2 and frac_ge2 < 0.02), 3) b from swept),
{_grams('seqs', '(select [b, b + 1] from bn)', ' | ')}, {_bridges(3, True, 300)} select * from br""",
    "event_bridges": f"with {EVENTS}, {_grams('es', '[3, 4]', ' | ')}, {_bridges(1, False, None)} select * from br",
    "event_sweep": f"with {EVENTS}, {_grams('es', 'range(1, 9)', ' ')}, {_SWEEP} {_SWEPT}",
    "bridge_theorems": f"""with {RECORDED}, {_BT} select theorem, cid_s self_cluster, l.label self_label, n_premise_clusters, array_to_string(ids, ',') premise_cluster_ids, labels premise_cluster_labels, u.n n_premises
from bt join lab l on l.cid = cid_s join (select src, count(*) n from ed group by 1) u on u.src = theorem order by n_premise_clusters desc, encode(theorem) limit 500""",
    "bridge_pair_counts": f"with {RECORDED}, {_BT} select cid_a, cid_b, count(*) n from (select a.cid_p cid_a, b.cid_p cid_b from hit a join hit b on a.src = b.src and a.cid_p < b.cid_p) group by 1, 2 order by n desc, cid_a, cid_b limit 15",
    "depth_candidates": f"with {RECORDED}, {_DC} select theorem, n_clusters, min_cross_indegree, cross_premises from dc",
    "indegree_sweep": f"with {RECORDED}, {_SW} select * from sw",
    "elbow_theta": f"with {RECORDED}, {_EL} select theta from el",
    "filtered_bridges": f"with {RECORDED}, {_EL} select theorem, n_clusters, min_cross_indegree from dc, el where min_cross_indegree <= theta",
    "top_clusters": f"with {_QP} select cid, count(*) n_proofs from q group by 1 order by 2 desc, 1 limit 30",
    "top_proofs_per_cluster": f"with {_QP}, tc as (select cid from q group by 1 order by count(*) desc, 1 limit 30) select cid, name, len, row_number() over (partition by cid order by len desc, encode(name)) rn from q join tc using (cid) qualify rn <= 30",
    "token_edit_distance": f"with {_CODES} select x.cid, x.name name_a, y.name name_b, levenshtein(x.code, y.code) edits, round(levenshtein(x.code, y.code) / greatest(x.len, y.len, 1)::double, 6) norm_edit_dist from tp x join tp y on x.cid = y.cid and x.rn < y.rn",
    "edit_baseline": f"with {_CODES} select round(baseline, 6) baseline from bl",
    "event_edit_bridges": f"""with {_CODES}, al as (select x.cid cluster_a, y.cid cluster_b, x.name theorem_a, y.name theorem_b, levenshtein(x.code, y.code) / greatest(x.len, y.len, 1)::double e, x.rn ra, y.rn rb from tp x join tp y on x.cluster_rank < y.cluster_rank),
best as (select * from al where e < 1.0 qualify row_number() over (partition by cluster_a, cluster_b order by e, ra, rb) = 1)
select cluster_a, cluster_b, theorem_a, theorem_b, round(e, 6) norm_edit_dist, round(baseline - e, 6) surprise from best, bl where e < baseline order by e, cluster_a, cluster_b limit 200""",
    "pattern_search": f"with {CLUSTERS}, {_MT} select bridge, side, name from mt",
    "bridge_span": f"with {CLUSTERS}, {_MT}, {_SPAN} select * from sp",
    "validation_summary": f"""with {RECORDED}, {_MT} select bridge, side, cid, any_value(l.label) as label, count(*) n_matches, array_to_string(list(name order by encode(name))[1:5], ',') theorems from mt join cm using (name) join lab l using (cid) group by 1, 2, 3""",
    "detected_matches": f"with {RECORDED}, {_DC}, {_MT} select bridge, side, name from mt where name in (select theorem from dc)",
    "validation_verdicts": f"""with {RECORDED}, {_EL}, {_BT.replace(_LINKS + ',', '')}, {_MT}, {_SPAN}
select bridge, case when n_a > 0 and n_b > 0 then 'yes' when n_a + n_b > 0 then 'partial' else 'no' end found, case when bridge_spans_clusters then 'YES' else 'no' end spans,
  case when exists (select 1 from mt, dc, el where mt.bridge = sp.bridge and mt.name = dc.theorem and min_cross_indegree <= el.theta) then 'YES (strict)'
    when exists (select 1 from mt, bt where mt.bridge = sp.bridge and mt.name = bt.theorem) then 'YES (loose)' else 'no' end detected from sp""",
    "known_bridge_verdicts": f"""with {RECORDED}, {_EL}, {_BT.replace(_LINKS + ',', '')}, {_MT.replace(_PATS, _KNOWN)}, {_SPAN}
select bridge, case when n_a > 0 and n_b > 0 then 'yes' when n_a + n_b > 0 then 'partial' else 'no' end found, case when bridge_spans_clusters then 'YES' else 'no' end spans,
  case when exists (select 1 from mt, dc, el where mt.bridge = sp.bridge and mt.name = dc.theorem and min_cross_indegree <= el.theta) then 'YES (strict)'
    when exists (select 1 from mt, bt where mt.bridge = sp.bridge and mt.name = bt.theorem) then 'YES (loose)' else 'no' end detected from sp""",
    "interaction_matrix": f"with {RECORDED}, {_W} select * from w",
    "integration": f"with {RECORDED}, {_W} select cid, round(integration, 6) + 0.0 integration, total_bridge_connections from ig",
    "differentiation": f"with {RECORDED}, {_DF} select cid, round(differentiation, 6) + 0.0 differentiation from df",
    "neural_complexity": f"with {RECORDED}, {_NC} select cid, label, size, round(integration, 6) + 0.0 integration, round(differentiation, 6) + 0.0 differentiation, round(neural_complexity, 6) + 0.0 neural_complexity, total_bridge_connections, is_mixed from nc",
    "global_cn": f"with {RECORDED}, {_W} select round(coalesce(sum(weight * abs(a.integration - b.integration)) / sum(weight), 0), 6) global_cn from w join ig a on a.cid = i join ig b on b.cid = j where i < j",
    "recorded_interaction_matrix": f"with {_RW} select * from w",
    "recorded_complexity": f"with {_RW}, {_DF} select cid, round(integration, 6) + 0.0 integration, round(integration * differentiation, 6) + 0.0 neural_complexity, total_bridge_connections from ig join df using (cid)",
    "bridge_theorem_report": f"""with {RECORDED}, {_BT}, f as (select theorem, n_premise_clusters n, l.label own, array_to_string(list_sort(list_distinct(string_split(labels, ';'))), ' · ') ls, row_number() over (order by n_premise_clusters desc, encode(theorem)) r from bt join lab l on l.cid = cid_s)
select r::int rank, printf('%3d  ', r) || rpad(case when len(theorem) > 57 then theorem[1:54] || '...' else theorem end, 57, ' ') || printf('  %2d  ', n) || '[' || own || ']  ' || ls line from f where r <= 200""",
    "filtered_report": f"""with {RECORDED}, {_EL}, f as (select dc.*, row_number() over (order by n_clusters desc, min_cross_indegree, encode(theorem)) r from dc cross join el where min_cross_indegree <= theta),
k as (select r, theorem, n_clusters, min_cross_indegree, array_to_string(list_sort(list(distinct coalesce(l.label, '?'))), ' · ') labels,
  coalesce(string_agg(dst || '(' || in_degree || ')', ', ' order by in_degree, encode(dst)) filter (in_degree <= theta), '') premises
  from f join cr on cr.src = f.theorem cross join el left join lab l on l.cid = cr.cid_p where r <= 200 group by 1, 2, 3, 4)
select r::int rank, printf('%3d  ', r) || rpad(case when len(theorem) > 57 then theorem[1:54] || '...' else theorem end, 57, ' ') || printf('  %2d  %3d  ', n_clusters, min_cross_indegree) || labels || '  ' || premises line from k""",
    "cluster_graph_edges": f"with {_X} select cid_a, cid_b, round(weight, 6) weight from ce",
    "plot_cluster_edges": f"""with {ALL}, {_X}, k as (select ce.* from ce where cid_a in (select cid from lab) and cid_b in (select cid from lab)), mm as (select min(weight) lo, max(weight) hi from k)
select cid_a, cid_b, round(0.3 + 2.5 * (weight - lo) / (hi - lo + 1e-12), 6) width from k, mm""",
    "plot_cluster_nodes": f"with {ALL} select cid, round(sqrt(size) * 8, 6) node_size, {_COLOUR} colour, case when size > 300 then label end shown_label from lab",
    "plot_legend": f"select distinct string_split(label, ' + ')[1] as module, {_COLOUR} colour from cluster_labels",
    "plot_purity": f"with {ALL} select cid, round(dominant_fraction, 6) dominant_fraction, round(norm_entropy, 6) norm_entropy, round(sqrt(size) * 5, 6) marker_size, {_COLOUR} colour, case when size > 1000 then string_split(label, ' + ')[1] end shown_label, dominant_fraction < 0.4 left_of_line from lab",
    "plot_module_bars": f"""with {_HIER} select top, sub::int sub, bar, total, round(fraction, 6) fraction, round(coalesce(sum(fraction) over (partition by top order by cnt desc, sub rows between unbounded preceding and 1 preceding), 0), 6) as left, case when fraction > 0.08 then label end shown_label from fr""",
    "plot_complexity": f"with {RECORDED}, {_NC} select cid, greatest(20, 5 * total_bridge_connections) marker_size, round(neural_complexity, 6) + 0.0 neural_complexity, row_number() over (order by round(neural_complexity, 9) desc, cid) <= 20 in_bars from nc",
    "label_report": f"""with {ALL}, t as (select *, row_number() over (order by size desc, cid) r from lab) select r::int rank, printf('%3d  C%-4d %6d  %s', r, cid, size, case when len(label) > 57 then label[1:54] || '...' else label end) line from t where r <= 40""",
    "event_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') start, event_type, count(*) n, round(sum(value), 3) total from events group by 1, 2",
}
