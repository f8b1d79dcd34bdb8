"""The SQL of the queries, for an engine that has the tables as views."""

from __future__ import annotations

from cragline.operators.scores import removal_sql

ACC = """acc AS (
    SELECT c_custkey AS class_key, n.n_name || '.C' || c_custkey AS class_fqn, n.n_name AS package, CASE WHEN c_custkey // 10 <> c_custkey THEN c_custkey // 10 END AS parent_key,
        o_orderkey AS method, l_partkey AS variable, l_suppkey AS provider, sn.n_regionkey AS region, s_nationkey <> c_nationkey AS is_foreign, l_quantity AS loc, l_linenumber AS depth,
        l_returnflag = 'R' AS is_call, o_orderpriority = '1-URGENT' AS is_protected, o_orderstatus = 'O' AS is_override, l_partkey % 4 = 0 AS public_attribute, l_partkey % 4 = 1 AS protected_attribute
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n.n_nationkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey)"""
MM = """mm0 AS (
    SELECT class_key, class_fqn, method, count(*) + 1 AS cyclo, CAST(sum(loc) AS BIGINT) AS loc, CAST(max(depth) AS BIGINT) AS nesting, count(DISTINCT variable) AS noav,
        count(DISTINCT CASE WHEN is_foreign THEN {'p': provider, 'v': variable} END) AS atfd, count(DISTINCT CASE WHEN NOT is_foreign THEN {'p': provider, 'v': variable} END) AS own,
        count(DISTINCT CASE WHEN is_foreign THEN provider END) AS fdp, count(DISTINCT CASE WHEN is_foreign THEN region END) AS regions,
        count(*) <= 4 AS is_accessor, bool_or(is_protected) AS is_protected, bool_or(is_override) AS is_override
    FROM acc GROUP BY ALL),
mm AS (SELECT *, CASE WHEN own + atfd = 0 THEN 1.0 ELSE own::DOUBLE / (own + atfd)::DOUBLE END AS laa, atfd AS cint,
    CASE WHEN atfd = 0 THEN 0.0 ELSE regions::DOUBLE / atfd::DOUBLE END AS cdisp FROM mm0)"""
TCC = """used AS (SELECT DISTINCT class_key, class_fqn, method, variable FROM acc),
linked AS (SELECT class_key, count(*) AS pairs FROM (SELECT DISTINCT a.class_key, a.method, b.method AS other FROM used a JOIN used b ON a.class_key = b.class_key AND a.variable = b.variable AND a.method < b.method) GROUP BY 1),
sizes AS (SELECT class_key, class_fqn, count(DISTINCT method) AS n FROM used GROUP BY ALL),
tcc AS (SELECT class_key, class_fqn, coalesce(pairs, 0) AS pairs, CASE WHEN n <= 1 THEN 0.0 ELSE coalesce(pairs, 0)::DOUBLE / (n * (n - 1) / 2)::DOUBLE END AS tcc FROM sizes LEFT JOIN linked USING (class_key))"""
CM = """own AS (SELECT DISTINCT class_key, parent_key, variable FROM acc),
up AS (SELECT a.class_key, count(*) AS used_parent FROM own a JOIN own b ON a.parent_key = b.class_key AND a.variable = b.variable GROUP BY 1),
fc AS (SELECT class_key, count(DISTINCT CASE WHEN is_foreign THEN provider END) AS atfd, count(DISTINCT CASE WHEN NOT is_foreign THEN variable END) AS noa,
    count(DISTINCT CASE WHEN NOT is_foreign AND public_attribute THEN variable END) AS nopa, count(DISTINCT CASE WHEN NOT is_foreign AND protected_attribute THEN variable END) AS hidden, max(package) AS package, max(parent_key) AS parent_key FROM acc GROUP BY 1),
cm0 AS (SELECT class_key, class_fqn, CAST(sum(cyclo) AS BIGINT) AS wmc, count(*) AS nom, CAST(sum(loc) AS BIGINT) AS loc, count(*) FILTER (is_accessor) AS accessors, count(*) FILTER (is_protected) AS protected,
    count(*) FILTER (is_override) AS overridden, count(*) FILTER (loc > 65 AND cyclo >= 4 AND nesting >= 5 AND noav > 7) AS brains FROM mm GROUP BY ALL),
cm AS (SELECT class_key, cm0.class_fqn, package, parent_key, wmc, nom, loc, atfd, accessors, noa, nopa, nopa + accessors AS open_members, (nom - accessors)::DOUBLE / nom::DOUBLE AS woc, wmc::DOUBLE / nom::DOUBLE AS amw, tcc, protected + hidden AS protected, overridden,
    coalesce(used_parent, 0) AS used_parent, brains FROM cm0 JOIN fc USING (class_key) JOIN tcc USING (class_key) LEFT JOIN up USING (class_key)),
wp0 AS (SELECT c.*, p.nom AS parent_nom, p.wmc AS parent_wmc, p.amw AS parent_amw, coalesce(p.protected, 0) AS n_prot FROM cm c LEFT JOIN cm p ON c.parent_key = p.class_key),
wp AS (SELECT *, CASE WHEN n_prot = 0 THEN 0.0 ELSE used_parent::DOUBLE / n_prot::DOUBLE END AS bur, overridden::DOUBLE / nom::DOUBLE AS bovr, nom - overridden AS nas, (nom - overridden)::DOUBLE / nom::DOUBLE AS pnas FROM wp0)"""
CALLERS = "callers AS (SELECT variable AS callee, count(DISTINCT {'c': class_key, 'm': method}) AS cm, count(DISTINCT class_key) AS cc FROM acc WHERE is_call AND is_foreign GROUP BY 1)"
FACTS = f"WITH RECURSIVE {ACC}, {MM}, {TCC}, {CM}, {CALLERS}"
CBO = "cbo AS (SELECT class_key, class_fqn, count(DISTINCT provider) AS cbo FROM acc GROUP BY ALL)"

COMMITS = """ev AS (SELECT event_id // 3 AS commit, CAST(floor(epoch(ts)) AS BIGINT) AS sec, user_id AS path, event_type IN ('click', 'purchase') AS counts FROM events),
times AS (SELECT commit, min(sec) AS ts FROM ev GROUP BY 1),
cf AS (SELECT (SELECT max(commit) FROM ev) - commit AS commit_pos, ts, path, counts FROM ev JOIN times USING (commit)),
scm AS (SELECT path, count(*) AS commit_count, min(ts) AS earliest_commit, arg_min(ts, commit_pos) AS most_recent_commit FROM (SELECT DISTINCT path, commit_pos, ts FROM cf) GROUP BY 1),
changes AS (SELECT ts, arg_max(n, commit_pos) AS n FROM (SELECT commit_pos, ts, count(*) AS n FROM cf WHERE counts GROUP BY ALL) GROUP BY 1),
later AS (SELECT ts, n, CAST(sum(n) OVER (ORDER BY ts DESC) AS BIGINT) AS later FROM changes),
prone AS (SELECT scm.*, CASE WHEN coalesce(later, 0) <> 0 THEN commit_count::DOUBLE / later::DOUBLE ELSE CAST('inf' AS DOUBLE) END AS change_proneness FROM scm ASOF LEFT JOIN later ON earliest_commit <= later.ts)"""

NATIONS = """refs AS (SELECT sr.r_name || '.' || sn.n_name AS owner_fqn, cr.r_name || '.' || cn.n_name AS target_fqn, count(*) AS refs
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
    JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey GROUP BY ALL),
ce AS (SELECT owner_fqn AS src, target_fqn AS dst, CAST(sum(refs) AS BIGINT) AS weight FROM refs WHERE owner_fqn <> target_fqn GROUP BY ALL),
pe AS (SELECT split_part(src, '.', 1) AS src, split_part(dst, '.', 1) AS dst, CAST(sum(weight) AS BIGINT) AS weight FROM ce WHERE split_part(src, '.', 1) <> split_part(dst, '.', 1) GROUP BY ALL)"""


def handoffs(n: int) -> str:
    return f"""ho AS (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS dst FROM events),
hw AS (SELECT src, dst, count(*) AS weight FROM ho WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL),
e AS (SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS n FROM hw) WHERE n <= {n})"""


SCC = """vs AS (SELECT src AS v FROM e UNION SELECT dst FROM e),
reach AS (SELECT v AS a, v AS b FROM vs UNION SELECT reach.a, e.dst FROM reach JOIN e ON reach.b = e.src),
scc AS (SELECT x.a AS v, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY 1),
big AS (SELECT component AS cycle_id, v FROM scc WHERE component IN (SELECT component FROM scc GROUP BY 1 HAVING count(*) > 1))"""
GRAPH = f"WITH RECURSIVE {handoffs(2)}, {SCC}"
RINGS = f"WITH RECURSIVE {handoffs(1)}, {SCC}"
UND = "und AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM e WHERE src <> dst)"
LINE = """le AS (SELECT src, dst, a.component FROM e JOIN scc a ON src = a.v JOIN scc b ON dst = b.v AND a.component = b.component WHERE src <> dst),
line AS (SELECT a.src AS a_src, a.dst AS a_dst, b.src AS b_src, b.dst AS b_dst FROM le a JOIN le b ON a.dst = b.src),
louts AS (SELECT a_src, a_dst, count(*) AS out FROM line GROUP BY ALL), lends AS (SELECT a_src AS src, a_dst AS dst FROM line UNION SELECT b_src, b_dst FROM line),
s0 AS (SELECT src, dst, 1.0::DOUBLE / (SELECT count(*) FROM lends) AS score FROM lends)"""
for _i in range(1, 6):
    LINE += f""",
s{_i} AS (SELECT src, dst, sum(score) AS score FROM (
    SELECT src, dst, 0.0::DOUBLE AS score FROM lends
    UNION ALL SELECT b_src, b_dst, p.score / out FROM line JOIN s{_i - 1} p ON p.src = a_src AND p.dst = a_dst JOIN louts USING (a_src, a_dst)
    UNION ALL SELECT src, dst, p.score FROM s{_i - 1} p WHERE NOT EXISTS (SELECT 1 FROM louts o WHERE o.a_src = p.src AND o.a_dst = p.dst)) GROUP BY ALL)"""

NEAR = """nb AS (SELECT u AS a, v AS b FROM und UNION SELECT v, u FROM und), dg AS (SELECT a AS v, count(*) AS n FROM nb GROUP BY 1),
tr AS (SELECT x.a AS v, count(*) AS t FROM nb x JOIN nb y ON x.a = y.a AND x.b < y.b JOIN und ON u = x.b AND und.v = y.b GROUP BY 1),
ab AS (SELECT a AS v, count(*) FILTER (2 * n > 3) AS h FROM nb JOIN dg ON b = dg.v GROUP BY 1),
near AS (SELECT dg.v, n, coalesce(t, 0) AS t, 2 * n AS d, h FROM dg LEFT JOIN tr USING (v) JOIN ab USING (v))"""

CYCLES = """walk AS (SELECT src AS root, dst AS at, [src, dst] AS path FROM e WHERE dst > src
    UNION ALL SELECT root, e.dst, list_append(path, e.dst) FROM walk JOIN e ON walk.at = e.src WHERE e.dst > root AND NOT list_contains(path, e.dst)),
cycles AS (SELECT path, len(path) AS length FROM walk JOIN e ON e.src = walk.at AND e.dst = walk.root)"""

LINES = """ln0 AS (SELECT doc_id, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND x <> '{' AND x <> '}' AND NOT starts_with(x, '//') AND NOT starts_with(x, '*')) AS ls FROM documents WHERE text IS NOT NULL AND doc_id % 17 <> 0
    AND NOT (regexp_matches(split_part(ltrim(text, ' '), ' ', 1), '^(?i)(get|is|set)') AND len(string_split(trim(text, ' '), chr(10))) <= 1)),
ln AS (SELECT source AS class_fqn, doc_id AS method, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM ln0 WHERE len(ls) >= 5),
hits AS (SELECT a.method AS a, b.method AS b, a.pos AS x, b.pos AS y FROM ln a JOIN ln b ON a.line = b.line AND a.method < b.method),
runs AS (SELECT a, b, min(x) AS start_a, min(y) AS start_b, count(*) AS size FROM (SELECT *, x - row_number() OVER (PARTITION BY a, b, x - y ORDER BY x) AS island FROM hits) GROUP BY a, b, x - y, island),
gaps AS (SELECT *, start_a - lag(start_a + size) OVER w AS gap_a, start_b - lag(start_b + size) OVER w AS gap_b FROM runs WINDOW w AS (PARTITION BY a, b ORDER BY start_a, start_b)),
joined AS (SELECT *, coalesce(gap_a >= 0 AND gap_b >= 0 AND least(gap_a, gap_b) <= 5, false) AS j FROM gaps),
marked AS (SELECT *, sum(CASE WHEN j THEN 0 ELSE 1 END) OVER (PARTITION BY a, b ORDER BY start_a, start_b) AS chain, CASE WHEN j THEN least(gap_a, gap_b) ELSE 0 END AS gap FROM joined),
chains AS (SELECT a, b, CAST(chain AS BIGINT) AS chain, count(*) AS clones, CAST(sum(size) + sum(gap) AS BIGINT) AS sdc, min(size) AS least_size, max(size) AS most_size, max(gap) AS most_gap FROM marked GROUP BY a, b, chain HAVING count(*) > 1),
avgs AS (SELECT avg(len(string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10)))) AS average FROM documents WHERE doc_id IN (SELECT method FROM ln)),
sig AS (SELECT a, b, max(sec) AS sec, max(sdc) AS sdc FROM (SELECT a, b, size AS sec, 0 AS sdc FROM runs, avgs WHERE size > average
    UNION ALL SELECT a, b, most_size, sdc FROM chains WHERE sdc >= 13 AND least_size > 5 AND most_gap <= 5) GROUP BY ALL),
owner AS (SELECT DISTINCT method, class_fqn FROM ln),
pairs AS (SELECT a, b, sec, sdc, x.class_fqn AS ca, y.class_fqn AS cb FROM sig JOIN owner x ON a = x.method JOIN owner y ON b = y.method),
flagged AS (SELECT ca AS class_fqn, sec, sdc, a || ' ↔ ' || regexp_extract(cb, '[^.]*$') || '.' || b AS partner FROM pairs
    UNION ALL SELECT cb, sec, sdc, b || ' ↔ ' || regexp_extract(ca, '[^.]*$') || '.' || a FROM pairs WHERE ca <> cb)"""

GOD_LONG = """god AS (SELECT class_fqn, class_key, atfd, wmc, tcc FROM wp WHERE atfd > 5 AND wmc >= 47 AND tcc < 0.33),
long AS (SELECT class_fqn, 0 AS idx, 'ATFD' AS name, atfd::DOUBLE AS value, 'asc' AS direction FROM god UNION ALL SELECT class_fqn, 1, 'WMC', wmc::DOUBLE, 'asc' FROM god UNION ALL SELECT class_fqn, 2, 'TCC', tcc, 'desc' FROM god),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY idx ORDER BY CASE WHEN direction = 'desc' THEN -value ELSE value END) AS rank FROM long),
overall AS (SELECT class_fqn, CAST(sum_of_ranks AS BIGINT) AS sum_of_ranks, dense_rank() OVER (ORDER BY sum_of_ranks) AS overall_rank FROM (SELECT class_fqn, sum(rank) AS sum_of_ranks FROM ranked GROUP BY 1))"""

PRIORITY = """paths AS (SELECT class_fqn, class_key % (SELECT max(user_id) + 1 FROM events) AS path, effort_rank FROM {instances}),
ranks AS (SELECT path, row_number() OVER (ORDER BY change_proneness, path, class_fqn) AS r FROM paths JOIN prone USING (path)),
top AS (SELECT path, max(r) AS change_proneness_rank FROM ranks GROUP BY 1),
pri AS (SELECT class_fqn, path, effort_rank, change_proneness_rank, change_proneness_rank - effort_rank AS raw_priority, row_number() OVER (ORDER BY change_proneness_rank - effort_rank DESC, class_fqn) AS priority FROM paths JOIN top USING (path))"""
GOD_PRIORITY = f"{FACTS}, {GOD_LONG}, {COMMITS}, inst AS (SELECT class_fqn, class_key, overall_rank AS effort_rank FROM overall JOIN god USING (class_fqn)), {PRIORITY.format(instances='inst')}"

ORACLE: dict[str, str] = {
    "method_metrics": f"{FACTS} SELECT class_fqn, method, cyclo, loc, nesting, noav, atfd, own, fdp, laa, cint, cdisp FROM mm",
    "class_metrics": f"{FACTS} SELECT class_fqn, package, parent_key, wmc, nom, loc, atfd, accessors, noa, nopa, woc, amw, tcc, protected, overridden, used_parent, brains FROM cm",
    "tcc": f"{FACTS} SELECT class_fqn, pairs, tcc FROM tcc",
    "laa": f"{FACTS} SELECT class_fqn, method, laa FROM mm",
    "cint_cdisp": f"{FACTS} SELECT class_fqn, method, cint, cdisp FROM mm",
    "cm_cc": f"{FACTS} SELECT callee, cm, cc FROM callers",
    "high_cbo": f"{FACTS}, {CBO} SELECT class_fqn, cbo FROM cbo WHERE cbo > 20",
    "metric_dense_ranks": f"{FACTS}, {GOD_LONG} SELECT 'god_class' AS type, class_fqn AS instance, CAST(idx AS INT) AS idx, name, value, direction, rank FROM ranked",
    "overall_rank": f"{FACTS}, {GOD_LONG} SELECT 'god_class' AS type, class_fqn AS instance, sum_of_ranks, overall_rank FROM overall",
    "scm_log": f"WITH {COMMITS} SELECT * FROM scm",
    "commit_changes": f"WITH {COMMITS} SELECT * FROM changes",
    "suffix_sums": f"WITH {COMMITS} SELECT * FROM later",
    "change_proneness": f"WITH {COMMITS} SELECT * FROM prone",
    "change_rank": f"WITH {COMMITS} SELECT path, row_number() OVER (ORDER BY change_proneness, path) AS change_proneness_rank FROM prone",
    "god_class_priority": f"{GOD_PRIORITY} SELECT * FROM pri",
    "bubble_rows": f"""{GOD_PRIORITY} SELECT priority, '[''' || class_fqn || ''',' || effort_rank || ',' || change_proneness_rank || ',' || priority || ',' || ((SELECT max(priority) FROM pri) - priority) || ']' AS row FROM pri""",
    "csv_rows": f"{GOD_PRIORITY} SELECT priority, concat_ws(',', class_fqn, priority, raw_priority, change_proneness_rank, effort_rank, path) AS row FROM pri",
    "cbo_priority": f"{FACTS}, {CBO}, {COMMITS}, inst AS (SELECT class_fqn, class_key, cbo AS effort_rank FROM cbo WHERE cbo > 20), {PRIORITY.format(instances='inst')} SELECT * FROM pri",
    "class_edges": f"WITH {NATIONS} SELECT * FROM ce",
    "package_edges": f"WITH {NATIONS} SELECT * FROM pe",
    "package_edge_members": f"WITH {NATIONS} SELECT split_part(src, '.', 1) AS package_src, split_part(dst, '.', 1) AS package_dst, src, dst, weight FROM ce WHERE split_part(src, '.', 1) <> split_part(dst, '.', 1)",
    "in_codebase_filter": f"WITH {NATIONS} SELECT * FROM ce WHERE split_part(src, '.', 1) IN ('ASIA', 'EUROPE') AND split_part(dst, '.', 1) IN ('ASIA', 'EUROPE')",
    "undirected_edges": f"{GRAPH}, {UND} SELECT u, v FROM und",
    "degrees": f"{GRAPH} SELECT v, (SELECT count(*) FROM e WHERE src = v) AS out_degree, (SELECT count(*) FROM e WHERE dst = v) AS in_degree, (SELECT count(*) FROM e WHERE src = v) + (SELECT count(*) FROM e WHERE dst = v) AS degree FROM vs",
    "scc": f"{GRAPH} SELECT v, component FROM scc",
    "cycle_components": f"{GRAPH} SELECT cycle_id, v FROM big",
    "ranked_cycles": f"""{GRAPH}, sz AS (SELECT cycle_id, count(*) AS n_vertices FROM big GROUP BY 1), ec AS (SELECT a.cycle_id, count(*) AS n_edges FROM e JOIN big a ON src = a.v JOIN big b ON dst = b.v AND a.cycle_id = b.cycle_id GROUP BY 1)
        SELECT cycle_id, n_vertices, coalesce(n_edges, 0) AS n_edges, row_number() OVER (ORDER BY n_vertices DESC, cycle_id) AS priority FROM sz LEFT JOIN ec USING (cycle_id)""",
    "is_cyclic": f"{GRAPH} SELECT count(*) > 0 AS cyclic FROM big",
    "connected_components": f"""WITH RECURSIVE {handoffs(1)}, b AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e), r AS (SELECT x AS v, x AS w FROM b UNION SELECT r.v, b.y FROM r JOIN b ON r.w = b.x)
        SELECT v, min(w) AS component FROM r GROUP BY 1""",
    "graph_stats": f"""{GRAPH}, sz AS (SELECT component, count(*) AS n FROM scc GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n_vertices, (SELECT count(*) FROM e) AS n_edges, count(*) AS n_components,
        count(*) FILTER (n = 1) AS n_trivial, count(*) FILTER (n > 1) AS n_nontrivial, max(n) AS largest FROM sz""",
    "line_digraph": f"{GRAPH}, {LINE} SELECT * FROM line",
    "line_pagerank5": f"{GRAPH}, {LINE} SELECT src, dst, round(score, 9) AS score FROM s5",
    "pagerank_fas_first_cut": f"""{GRAPH}, {LINE} SELECT src, dst, component FROM (SELECT src, dst, component, row_number() OVER (PARTITION BY component ORDER BY round(score, 9) DESC, weight, src, dst) AS n
        FROM e JOIN s5 USING (src, dst) JOIN scc ON src = v) WHERE n = 1""",
    "edge_cycle_counts": f"{GRAPH} SELECT src, dst, weight, count(*) AS cycle_count FROM e JOIN big a ON src = a.v JOIN big b ON dst = b.v AND a.cycle_id = b.cycle_id GROUP BY ALL",
    "edge_priority": f"""WITH RECURSIVE {NATIONS}, e AS (SELECT * FROM ce), {SCC}, {SCC.replace('vs AS', 'pvs AS').replace('FROM vs', 'FROM pvs').replace('reach', 'preach').replace('scc', 'pscc').replace('big', 'pbig').replace(' e', ' pe')},
        cnt AS (SELECT src, dst, weight, count(*) AS cycle_count FROM ce JOIN big a ON src = a.v JOIN big b ON dst = b.v AND a.cycle_id = b.cycle_id GROUP BY ALL),
        pcnt AS (SELECT src, dst, count(*) AS n FROM pe JOIN pbig a ON src = a.v JOIN pbig b ON dst = b.v AND a.cycle_id = b.cycle_id GROUP BY ALL),
        prem AS (SELECT src, dst FROM pe WHERE weight = (SELECT min(weight) FROM pe)),
        vrem AS (SELECT v FROM (SELECT src AS v, weight FROM ce UNION ALL SELECT dst, weight FROM ce) GROUP BY v ORDER BY sum(weight) DESC, v LIMIT 3),
        rows AS (SELECT cnt.src, cnt.dst, weight, cycle_count, coalesce(n, 0) AS package_cycle_count, EXISTS (SELECT 1 FROM prem WHERE prem.src = split_part(cnt.src, '.', 1) AND prem.dst = split_part(cnt.dst, '.', 1)) AS package_edge_removed,
            CASE WHEN cnt.src IN (SELECT v FROM vrem) THEN 1 ELSE 0 END AS source_removed, CASE WHEN cnt.dst IN (SELECT v FROM vrem) THEN 1 ELSE 0 END AS target_removed
            FROM cnt LEFT JOIN pcnt ON pcnt.src = split_part(cnt.src, '.', 1) AND pcnt.dst = split_part(cnt.dst, '.', 1))
        SELECT *, row_number() OVER (ORDER BY cycle_count DESC, weight, package_edge_removed DESC, package_cycle_count DESC, source_removed DESC, target_removed DESC, src, dst) AS priority FROM rows""",
    "simple_cycles": f"{RINGS}, {CYCLES} SELECT array_to_string(path, '>') AS path, length FROM cycles",
    "optimal_back_edges": f"""{RINGS}, {CYCLES}, st AS (SELECT path, unnest(path) AS src, unnest(list_append(path[2:], path[1])) AS dst FROM cycles), cc AS (SELECT src, dst, weight, count(*) AS cycles FROM st JOIN e USING (src, dst) GROUP BY ALL)
        SELECT * FROM cc WHERE cycles = (SELECT max(cycles) FROM cc) AND weight = (SELECT min(weight) FROM cc WHERE cycles = (SELECT max(cycles) FROM cc))""",
    "triangles": f"""{GRAPH}, {UND}, nb AS (SELECT u AS a, v AS b FROM und UNION SELECT v, u FROM und), d AS (SELECT a AS v, count(*) AS degree FROM nb GROUP BY 1),
        t AS (SELECT x.a AS v, count(*) AS n FROM nb x JOIN nb y ON x.a = y.a AND x.b < y.b JOIN und ON u = x.b AND und.v = y.b GROUP BY 1)
        SELECT v, degree, coalesce(n, 0) AS triangles, CASE WHEN degree < 2 THEN 0.0 ELSE 2.0::DOUBLE * coalesce(n, 0) / (degree * (degree - 1)) END AS clustering FROM d LEFT JOIN t USING (v)""",
    "vertex_removal_score": f"{GRAPH}, {UND}, {NEAR} {removal_sql(3, 'near')}",
    "clustering": f"{GRAPH}, {UND}, {NEAR} SELECT v, CASE WHEN n < 2 THEN 0.0 ELSE 2.0::DOUBLE * t / (n * (n - 1)) END AS clustering FROM near",
    "dot_edges": f"""{GRAPH}, {LINE}, red AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY component ORDER BY round(score, 9) DESC, weight, src, dst) AS n FROM e JOIN s5 USING (src, dst) JOIN scc ON src = v) WHERE n = 1)
        SELECT src, dst, src || ' -> ' || dst || ' [ label = "' || weight || '" weight = "' || weight || '"' || CASE WHEN EXISTS (SELECT 1 FROM red WHERE red.src = e.src AND red.dst = e.dst) THEN ' color = "red"' ELSE '' END || ' ];' AS line FROM e""",
    "clone_runs": f"WITH {LINES} SELECT a, b, start_a, start_b, size FROM runs",
    "clone_chains": f"WITH {LINES} SELECT * FROM chains",
    "significant_duplication": f"WITH {LINES} SELECT class_fqn, max(sec) AS sec, max(sdc) AS sdc, count(DISTINCT partner) AS n_partners FROM flagged GROUP BY 1",
}

#: The thresholds as the detection strategies state them: type, relation, key, predicate, metrics with direction.
DETECTORS = [
    ("brain_method", "mm", "class_fqn, method", "loc > 65 AND cyclo >= 4 AND nesting >= 5 AND noav > 7", "LOC loc asc, CYCLO cyclo asc, MAXNESTING nesting asc, NOAV noav asc"),
    ("feature_envy", "mm", "class_fqn, method", "atfd > 5 AND laa < 0.33 AND fdp <= 5", "ATFD atfd asc, LAA laa desc, FDP fdp desc"),
    ("intensive_coupling", "mm", "class_fqn, method", "nesting > 1 AND (cint > 7 AND cdisp < 0.5 OR cint > 5 AND cdisp < 0.25)", "CINT cint asc, CDISP cdisp desc, MAXNESTING nesting asc"),
    ("dispersed_coupling", "mm", "class_fqn, method", "nesting > 1 AND cint > 7 AND cdisp >= 0.5", "CINT cint asc, CDISP cdisp asc, MAXNESTING nesting asc"),
    ("shotgun_surgery", "callers", "callee", "cm > 7 AND cc > 7", "CM cm asc, CC cc asc"),
    ("god_class", "wp", "class_fqn", "atfd > 5 AND wmc >= 47 AND tcc < 0.33", "ATFD atfd asc, WMC wmc asc, TCC tcc desc"),
    ("data_class", "wp", "class_fqn", "woc < 0.33 AND (nopa + accessors > 5 AND wmc < 31 OR nopa + accessors > 7 AND wmc < 47)", "WOC woc desc, PublicAttrsAndAccessors open_members asc, WMC wmc desc"),
    ("brain_class", "wp", "class_fqn", "NOT (atfd > 5 AND wmc >= 47 AND tcc < 0.33) AND wmc >= 47 AND tcc < 0.5 AND (brains > 1 AND loc >= 195 OR brains = 1 AND loc >= 390 AND wmc >= 94)", "BrainMethods brains asc, LOC loc asc, WMC wmc asc, TCC tcc desc"),
    ("refused_bequest", "wp", "class_fqn", "parent_key IS NOT NULL AND nom > 7 AND (amw > 2 OR wmc > 14) AND (bovr < 0.33 OR n_prot > 5 AND bur < 0.33)", "NProtM n_prot asc, BUR bur desc, BOvR bovr desc, NOM nom asc, AMW amw asc, WMC wmc asc"),
    ("tradition_breaker", "wp", "class_fqn", "parent_amw > 2 AND parent_nom > 6 AND parent_wmc >= 23 AND nom >= 12 AND (amw > 2 OR wmc >= 47) AND nas >= 7 AND pnas >= 0.67", "NAS nas asc, PNAS pnas asc, NOM nom asc, AMW amw asc, WMC wmc asc, Overridden overridden asc"),
]
_LONG = []
for _name, _from, _key, _test, _metrics in DETECTORS:
    _cells = [m.split() for m in _metrics.split(", ")]
    ORACLE[_name] = f"{FACTS} SELECT {_key}, {', '.join(c for _, c, _ in _cells)} FROM {_from} WHERE {_test}"
    for _i, (_n, _c, _d) in enumerate(_cells):
        _LONG.append(f"SELECT '{_name}' AS type, concat_ws('::', {_key}) AS instance, {_i} AS idx, '{_n}' AS name, {_c}::DOUBLE AS value, '{_d}' AS direction FROM {_from} WHERE {_test}")
ALL = f"everything AS ({' UNION ALL '.join(_LONG)})"
ORACLE["disharmonies"] = f"{FACTS}, {ALL} SELECT * FROM everything"
ORACLE["ranked_disharmonies"] = f"""{FACTS}, {ALL}, {COMMITS},
    mranks AS (SELECT *, dense_rank() OVER (PARTITION BY type, idx ORDER BY CASE WHEN direction = 'desc' THEN -value ELSE value END) AS rank FROM everything),
    efforts AS (SELECT type, instance, dense_rank() OVER (PARTITION BY type ORDER BY s) AS effort_rank FROM (SELECT type, instance, sum(rank) AS s FROM mranks GROUP BY ALL)),
    paths AS (SELECT type, instance AS class_fqn, CAST(regexp_extract(split_part(instance, '::', 1), '[0-9]+$') AS BIGINT) % (SELECT max(user_id) + 1 FROM events) AS path, effort_rank FROM efforts),
    numbered AS (SELECT type, path, row_number() OVER (PARTITION BY type ORDER BY change_proneness, path, class_fqn) AS r FROM paths JOIN prone USING (path)),
    top AS (SELECT type, path, max(r) AS change_proneness_rank FROM numbered GROUP BY ALL)
    SELECT type, class_fqn, path, effort_rank, change_proneness_rank, change_proneness_rank - effort_rank AS raw_priority,
        row_number() OVER (PARTITION BY type ORDER BY change_proneness_rank - effort_rank DESC, class_fqn) AS priority FROM paths JOIN top USING (type, path)"""
GOD_RANKS = """granks0 AS (SELECT class_fqn, atfd, wmc, tcc, dense_rank() OVER (ORDER BY wmc) AS wmc_rank, dense_rank() OVER (ORDER BY atfd) AS atfd_rank, dense_rank() OVER (ORDER BY tcc DESC) AS tcc_rank FROM god),
    granks1 AS (SELECT *, wmc_rank + atfd_rank + tcc_rank AS sum_of_ranks FROM granks0), granks AS (SELECT *, dense_rank() OVER (ORDER BY sum_of_ranks) AS overall_rank FROM granks1)"""
ORACLE["god_class_ranks"] = f"{FACTS}, {GOD_LONG}, {GOD_RANKS} SELECT * FROM granks"
ORACLE["long_methods"] = f"{FACTS} SELECT class_fqn, method, loc, cyclo FROM mm WHERE loc > 65"
ORACLE["complex_methods"] = f"{FACTS} SELECT class_fqn, method, loc, cyclo FROM mm WHERE cyclo >= 4"
_DAY = "strftime(make_timestamp({} * 1000000), '%Y-%m-%dT%H:%M:%S')"
_CSV = f"{GOD_PRIORITY}, {GOD_RANKS}, cells AS (SELECT *, CAST(floor(tcc * 100 + 0.5) AS BIGINT) AS cents FROM pri JOIN granks USING (class_fqn) JOIN scm USING (path))"
ORACLE["csv_report"] = f"""{_CSV} SELECT CAST(0 AS BIGINT) AS pos, 'Ver,Class,Priority,Change Proneness Rank,Effort Rank,Method Count,Most Recent Commit Date,Commit Count,' AS line
    UNION ALL SELECT priority, '1.0,' || class_fqn || ',' || priority || ',' || change_proneness_rank || ',' || effort_rank || ',' || wmc || ',' || {_DAY.format('most_recent_commit')} || ',' || commit_count || ',eol' FROM cells"""
ORACLE["csv_report_detailed"] = f"""{_CSV} SELECT CAST(0 AS BIGINT) AS pos, 'Ver,Class,Priority,Change Proneness Rank,Effort Rank,WMC,WMC Rank,ATFD,ATFD Rank,TCC,TCC Rank,Date of First Commit,Most Recent Commit Date,Commit Count,Full Path,' AS line
    UNION ALL SELECT priority, '1.0,' || class_fqn || ',' || priority || ',' || change_proneness_rank || ',' || effort_rank || ',' || wmc || ',' || wmc_rank || ',' || atfd || ',' || atfd_rank || ',' || (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') || ',' || tcc_rank || ','
        || {_DAY.format('earliest_commit')} || ',' || {_DAY.format('most_recent_commit')} || ',' || commit_count || ',' || path || ',eol' FROM cells"""
ORACLE["json_report"] = f"""{GOD_PRIORITY} SELECT '{{"rankedDisharmonies":[' || string_agg('{{"className":"' || class_fqn || '","fullFilePath":' || path || ',"effortRank":' || effort_rank || ',"changePronenessRank":' || change_proneness_rank || ',"priority":' || raw_priority || '}}', ',' ORDER BY priority) || '],"errors":[]}}' AS json FROM pri"""
ORACLE["class_names"] = "SELECT n_name || '.C' || c_custkey AS class_fqn, n_name AS package, 'C' || c_custkey AS simple, n_name || '.C' || c_custkey AS outer_class FROM customer JOIN nation ON c_nationkey = n_nationkey"
ORACLE["line_counts"] = r"""SELECT doc_id AS method, CAST(CASE WHEN body = '' THEN 0 ELSE len(string_split(body, chr(10))) END AS BIGINT) AS loc,
    CAST(len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND x <> '{' AND x <> '}' AND NOT starts_with(x, '//') AND NOT starts_with(x, '*'))) AS BIGINT) AS normalised
    FROM (SELECT doc_id, text, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS body FROM documents)"""
ORACLE["arc_set_checks"] = "SELECT * FROM (VALUES ('surplus', true, true), ('greedy', true, true), ('matrix', true, true)) AS t(name, small, acyclic)"
ORACLE["vertex_set_checks"] = f"{RINGS}, {CYCLES} SELECT name, true AS valid, (SELECT count(*) FROM cycles) AS ring_vertices FROM (VALUES ('greedy'), ('scc'), ('score'), ('local')) AS t(name)"
ORACLE["order_checks"] = f"{GRAPH} SELECT count(*) AS n_vertices, count(*) AS n_places, count(*) - 1 AS last, true AS acyclic FROM vs"
# On separate rings all edges of a ring score alike, so one edge of each goes: the lightest, by name where there are several.
_LIGHTEST = f"{RINGS}, {CYCLES}, st AS (SELECT path, unnest(path) AS src, unnest(list_append(path[2:], path[1])) AS dst FROM cycles), lightest AS (SELECT src, dst, weight, row_number() OVER (PARTITION BY path ORDER BY weight, src, dst) AS n FROM st JOIN e USING (src, dst))"
ORACLE["min_fas_exact"] = f"{_LIGHTEST} SELECT src, dst, weight FROM lightest WHERE n = 1"
ORACLE["pagerank_fas"] = f"{_LIGHTEST} SELECT src, dst, 1 AS round FROM lightest WHERE n = 1"
ORACLE["fvs_k"] = f"{RINGS}, {CYCLES} SELECT count(*) AS k FROM cycles"
ORACLE["line_statistics"] = f"""{GRAPH}, {LINE}, o AS (SELECT a_src AS src, a_dst AS dst, count(*) AS o FROM line GROUP BY ALL), i AS (SELECT b_src AS src, b_dst AS dst, count(*) AS i FROM line GROUP BY ALL),
    lv AS (SELECT src, dst, coalesce(o, 0) AS o, coalesce(i, 0) AS i FROM lends LEFT JOIN o USING (src, dst) LEFT JOIN i USING (src, dst))
    SELECT count(*) AS n_vertices, CAST(sum(o) AS BIGINT) AS n_edges, count(*) FILTER (i = 0) AS sources, count(*) FILTER (o = 0) AS sinks, sum(o)::DOUBLE / count(*) AS mean_degree, sum(o)::DOUBLE / (count(*) * (count(*) - 1)) AS density FROM lv"""
BETWEEN = """nb AS (SELECT u AS a, v AS b FROM und UNION SELECT v, u FROM und),
    far AS (SELECT a AS s, a AS v, 0 AS d FROM nb UNION SELECT far.s, nb.b, d + 1 FROM far JOIN nb ON far.v = nb.a WHERE d < 24),
    dist AS (SELECT s, v, min(d) AS d FROM far GROUP BY ALL),
    steps AS (SELECT s, v, d FROM dist WHERE d = 0 UNION ALL SELECT steps.s, nb.b, steps.d + 1 FROM steps JOIN nb ON steps.v = nb.a JOIN dist t ON t.s = steps.s AND t.v = nb.b AND t.d = steps.d + 1),
    ways AS (SELECT s, v, d, count(*) AS n FROM steps GROUP BY ALL),
    between_ AS (SELECT m.v, sum(m.n::DOUBLE * r.n / whole.n) AS x FROM ways m JOIN ways r ON r.s = m.v JOIN ways whole ON whole.s = m.s AND whole.v = r.v AND whole.d = m.d + r.d WHERE m.d > 0 AND r.d > 0 GROUP BY 1)"""
ORACLE["betweenness"] = f"{GRAPH}, {UND}, {BETWEEN} SELECT vs.v, round(coalesce(x, 0), 6) AS betweenness FROM vs LEFT JOIN between_ USING (v)"
ORACLE["structural_importance"] = f"""{GRAPH}, {UND}, {NEAR.replace('nb AS', 'nbr AS').replace('FROM nb', 'FROM nbr').replace('JOIN nb', 'JOIN nbr')}, {BETWEEN}
    SELECT near.v, round(n + 10 * round(coalesce(x, 0), 12) + 0.5 * t, 6) AS importance FROM near LEFT JOIN between_ USING (v)"""
ORACLE["articulation_points"] = f"""{RINGS}, {UND}, nb AS (SELECT u AS a, v AS b FROM und UNION SELECT v, u FROM und), sides AS (SELECT a AS gone, min(b) AS start, count(*) AS n FROM nb GROUP BY 1),
    seen AS (SELECT gone, start AS v FROM sides UNION SELECT gone, nb.b FROM seen JOIN nb ON seen.v = nb.a WHERE nb.b <> gone)
    SELECT sides.gone AS v FROM sides JOIN nb ON nb.a = sides.gone LEFT JOIN seen ON seen.gone = sides.gone AND seen.v = nb.b GROUP BY sides.gone HAVING count(*) FILTER (seen.v IS NULL) > 0"""
