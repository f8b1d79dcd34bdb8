import math

import pytest
from pyspark.sql import functions as F

from cragline.functions import names
from cragline.operators import churn, clones, detectors, graph, metrics, priority, ranking, report
from cragline.sources import code


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_class_and_package_edges(spark):
    refs = [("p.A", "p.B"), ("p.B", "p.C"), ("p.C", "p.A"), ("p.C", "p.E"), ("p.D", "p.A"), ("p.D", "p.C"), ("p.E", "p.D"), ("p.E", "p.D"), ("p.A", "p.A"), ("p.A", "x.F"), ("q.G", "p.A")]
    edges = graph.class_edges(df(spark, refs, "owner_fqn string, target_fqn string"))
    kept = graph.keep_in_codebase(edges, df(spark, [("p",)], "package string"))
    assert {(r.src, r.dst): r.weight for r in kept.collect()} == {("p.A", "p.B"): 1, ("p.B", "p.C"): 1, ("p.C", "p.A"): 1, ("p.C", "p.E"): 1, ("p.D", "p.A"): 1, ("p.D", "p.C"): 1, ("p.E", "p.D"): 2}
    assert {(r.src, r.dst): r.weight for r in graph.package_edges(edges).collect()} == {("p", "x"): 1, ("q", "p"): 1}
    assert graph.package_edge_members(edges).count() == 2


def test_change_proneness_literals(spark):
    t1, t2 = 1595275997, 1595175997
    series = df(spark, [(t1, 1), (t1 + 300, 3), (t1 + 600, 3), (t2, 1), (t2 + 300, 5), (t2 + 600, 5)], "ts long, n long")
    scm = df(spark, [("file1", 1, t1), ("file2", 1, t2), ("late", 2, t1 + 601), ("none", 0, t1 + 601)], "path string, commit_count long, earliest_commit long")
    got = {r.path: r for r in churn.change_ranks(churn.change_proneness(scm, series), "path").collect()}
    assert got["file1"].change_proneness == 1 / 7 and got["file2"].change_proneness == 1 / 18
    assert got["late"].change_proneness == math.inf and math.isnan(got["none"].change_proneness)
    assert [got[k].change_proneness_rank for k in ("file2", "file1", "late", "none")] == [1, 2, 3, 4]


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_asof_and_suffix_sums_by_linear_scan(spark, width):
    import random

    r = random.Random(width)
    series = sorted({r.randint(0, 300) for _ in range(40)})
    probes = [r.randint(-5, 310) for _ in range(80)]
    right = df(spark, [(t, t * 10) for t in series], "ts long, v long")
    got = churn.asof_forward(df(spark, list(enumerate(probes)), "i long, at long"), right, "at", "ts", "v", width).collect()
    assert {x.i: x.v for x in got} == {i: next((t * 10 for t in series if t >= p), None) for i, p in enumerate(probes)} and len(got) == 80
    sums = churn.suffix_sums(right.withColumnRenamed("v", "n"), width).collect()
    assert {x.ts: x.later for x in sums} == {t: sum(u * 10 for u in series if u >= t) for t in series}


def test_log_and_changes(spark):
    rows = [(2, 100, "a.java", True), (1, 200, "a.java", True), (1, 200, "b.java", True), (0, 200, "c.txt", False), (3, 200, "d.java", True)]
    commits = df(spark, rows, "commit_pos long, ts long, path string, counts boolean")
    log = {r.path: tuple(r)[1:] for r in churn.scm_log(commits).collect()}
    assert log["a.java"] == (2, 100, 200)
    assert {r.ts: r.n for r in churn.commit_changes(commits).collect()} == {100: 1, 200: 1}


def test_metric_ranks_and_ties(spark):
    rows = [("ThemeImpl", 16.0, 60.0, 0.0782), ("Sorter", 25.0, 51.0, 0.2), ("AttributeHandler", 79.0, 79.0, 0.0278)]
    long = [("g", c, i, n, v, "asc") for c, *vs in rows for i, (n, v) in enumerate(zip(("ATFD", "WMC", "TCC"), vs, strict=True))]
    ranked = ranking.metric_ranks(df(spark, long, "type string, instance string, idx int, name string, value double, direction string"))
    got = {r.instance: (r.sum_of_ranks, r.overall_rank) for r in ranking.overall_ranks(ranked).collect()}
    assert got == {"ThemeImpl": (5, 1), "Sorter": (6, 2), "AttributeHandler": (7, 3)}
    tied = ranking.metric_ranks(df(spark, [("g", x, 0, "m", v, "desc") for x, v in (("a", 0.4), ("b", 0.1), ("c", 0.4))], "type string, instance string, idx int, name string, value double, direction string"))
    assert {r.instance: r["rank"] for r in tied.collect()} == {"a": 1, "c": 1, "b": 2}
    legacy = ranking.god_class_ranks(df(spark, [("a", 1, 1, 0.5), ("b", 2, 2, 0.7)], "class_fqn string, wmc long, atfd long, tcc double"), legacy_tcc=True)
    assert {r.tcc_rank for r in legacy.collect()} == {1}
    flat = ranking.min_max(df(spark, [(3.0,), (3.0,)], "x double"), "x", "s").collect()
    assert [r.s for r in flat] == [0.0, 0.0]


def test_metrics_of_a_small_class(spark):
    rows = [
        (1, "p.A", "p", None, 1, "x", 1, 0, False, 3.0, 1, True, True, False, True, False), (1, "p.A", "p", None, 1, "y", 2, 0, True, 4.0, 2, False, True, False, True, False),
        (1, "p.A", "p", None, 2, "x", 1, 0, False, 1.0, 1, False, False, True, True, False), (1, "p.A", "p", None, 2, "v", 1, 0, False, 0.0, 1, False, False, True, False, True), (1, "p.A", "p", None, 3, "z", 3, 1, True, 1.0, 1, False, False, True, False, False),
        (2, "p.B", "p", 1, 4, "x", 1, 0, True, 9.0, 3, True, False, False, False, False),
    ]
    access = df(spark, rows, "class_key long, class_fqn string, package string, parent_key long, method long, variable string, provider long, region long, is_foreign boolean, loc double, depth int, is_call boolean, is_protected boolean, is_override boolean, is_public_attribute boolean, is_protected_attribute boolean")
    got = {r.class_key: r for r in metrics.with_parents(metrics.class_metrics(access)).collect()}
    a, b = got[1], got[2]
    assert (a.wmc, a.nom, a.loc, a.atfd, a.noa, a.nopa, a.protected, a.overridden) == (8, 3, 9, 2, 2, 1, 2, 2) and a.tcc == 1 / 3
    assert (b.used_parent, b.n_prot, b.bur, b.tcc) == (1, 2, 0.5, 0.0)
    methods = {r.method: r for r in metrics.method_metrics(access).collect()}
    assert methods[1].laa == 0.5 and methods[2].laa == 1.0 and methods[3].cdisp == 1.0 and methods[2].cdisp == 0.0
    assert {r.callee: (r.cm, r.cc) for r in metrics.callers(access).collect()} == {"x": (1, 1)}  # not the call within the class


def test_thresholds_at_their_edges(spark):
    rows = df(spark, [("in", 6, 47, 0.32), ("atfd", 5, 47, 0.32), ("wmc", 6, 46, 0.32), ("tcc", 6, 47, 0.33)], "class_fqn string, atfd long, wmc long, tcc double")
    found = detectors.describe(detectors.detect(rows, "god_class"), "god_class")
    one = detectors.parse_description(found).first()
    assert found.count() == 1 and one.description == "God Class detected: ATFD=6, WMC=47, TCC=0.32" and (one.class_fqn, one.wmc) == ("in", 47)


#: Metrics that meet the thresholds of a detector by one step, and for each term the step that no longer does.
EDGES = {
    "brain_method": [({"loc": 66, "cyclo": 4, "nesting": 5, "noav": 8}, [{"loc": 65}, {"cyclo": 3}, {"nesting": 4}, {"noav": 7}])],
    "feature_envy": [({"atfd": 6, "laa": 0.32, "fdp": 5}, [{"atfd": 5}, {"laa": 0.33}, {"fdp": 6}])],
    "intensive_coupling": [({"cint": 8, "cdisp": 0.49, "nesting": 2}, [{"cint": 7}, {"cdisp": 0.5}, {"nesting": 1}]), ({"cint": 6, "cdisp": 0.24, "nesting": 2}, [{"cint": 5}, {"cdisp": 0.25}, {"nesting": 1}])],
    "dispersed_coupling": [({"cint": 8, "cdisp": 0.5, "nesting": 2}, [{"cint": 7}, {"cdisp": 0.49}, {"nesting": 1}])],
    "shotgun_surgery": [({"cm": 8, "cc": 8}, [{"cm": 7}, {"cc": 7}])],
    "god_class": [({"atfd": 6, "wmc": 47, "tcc": 0.32}, [{"atfd": 5}, {"wmc": 46}, {"tcc": 0.33}])],
    "data_class": [({"woc": 0.32, "nopa": 3, "accessors": 3, "wmc": 30}, [{"woc": 0.33}, {"nopa": 2}, {"accessors": 2}, {"wmc": 31}]), ({"woc": 0.32, "nopa": 8, "accessors": 0, "wmc": 46}, [{"nopa": 7}, {"wmc": 47}])],
    "brain_class": [({"atfd": 5, "wmc": 47, "tcc": 0.49, "brains": 2, "loc": 195}, [{"wmc": 46}, {"tcc": 0.5}, {"brains": 1}, {"loc": 194}, {"atfd": 6, "tcc": 0.32}]), ({"atfd": 9, "wmc": 94, "tcc": 0.33, "brains": 1, "loc": 390}, [{"wmc": 93}, {"tcc": 0.32}, {"brains": 0}, {"loc": 389}])],
    "refused_bequest": [({"parent_key": 1, "bovr": 0.32, "n_prot": 0, "bur": 0.0, "nom": 8, "amw": 2.1, "wmc": 14}, [{"parent_key": None}, {"bovr": 0.33}, {"nom": 7}, {"amw": 2.0}]), ({"parent_key": 1, "bovr": 0.33, "n_prot": 6, "bur": 0.32, "nom": 8, "amw": 2.0, "wmc": 15}, [{"n_prot": 5}, {"bur": 0.33}, {"wmc": 14}])],
    "tradition_breaker": [({"parent_amw": 2.1, "parent_nom": 7, "parent_wmc": 23, "nom": 12, "amw": 2.1, "wmc": 46, "nas": 7, "pnas": 0.67, "overridden": 5}, [{"parent_amw": 2.0}, {"parent_nom": 6}, {"parent_wmc": 22}, {"nom": 11}, {"amw": 2.0}, {"nas": 6}, {"pnas": 0.66}]), ({"parent_amw": 2.1, "parent_nom": 7, "parent_wmc": 23, "nom": 12, "amw": 2.0, "wmc": 47, "nas": 7, "pnas": 0.67, "overridden": 5}, [{"wmc": 46}])],
}


@pytest.mark.parametrize("name", EDGES)
def test_each_term_of_each_detector(spark, name):
    keys = {"class": ["class_fqn"], "method": ["class_fqn", "method"], "callee": ["callee"]}[detectors.RULES[name].level]
    rows, want = [], set()
    for meets, misses in EDGES[name]:
        for change in [{}, *misses]:
            rows.append(meets | change)
            if not change:
                want.add(len(rows) - 1)
    columns = list(rows[0])
    kinds = ", ".join(f"{c} {'double' if any(isinstance(r[c], float) for r in rows) else 'long'}" for c in columns)
    table = df(spark, [(*[str(i) if k != "method" else i for k in keys], *[float(r[c]) if f" {c} double" in f" {kinds}" else r[c] for c in columns]) for i, r in enumerate(rows)], ", ".join(f"{k} {'long' if k == 'method' else 'string'}" for k in keys) + ", " + kinds)
    assert {int(r[keys[0]]) for r in detectors.detect(table, name).collect()} == want


def test_long_and_complex_methods(spark):
    rows = df(spark, [(1, 66, 3), (2, 65, 4), (3, 65, 3)], "method long, loc long, cyclo long")
    assert [r.method for r in detectors.long_method(rows).collect()] == [1] and [r.method for r in detectors.complex_method(rows).collect()] == [2]


def test_ordinals_by_ranges(spark):
    rows = df(spark, [(i % 3, (i * 37) % 100, i) for i in range(200)], "g long, x long, i long")
    got = {r.i: r.n for r in ranking.ordinal(rows, "n", F.desc("x"), "i").collect()}
    assert got == {i: n for n, i in enumerate(sorted(range(200), key=lambda i: (-((i * 37) % 100), i)), 1)}
    within = {r.i: r.n for r in ranking.ordinal_within(rows, "n", ["g"], "x", "i").collect()}
    for g in range(3):
        assert [within[i] for i in sorted(range(g, 200, 3), key=lambda i: ((i * 37) % 100, i))] == list(range(1, len(range(g, 200, 3)) + 1))
    assert ranking.ordinal(rows.limit(0), "n", "x").count() == 0


def test_class_report_layouts(spark):
    rows = df(spark, [("p.A", 1, 5, 2, 50, 1, 7, 2, 0.125, 1, 1595275997, 1595276000, 3, "a.java")], "class_fqn string, priority long, change_proneness_rank long, effort_rank long, wmc long, wmc_rank long, atfd long, atfd_rank long, tcc double, tcc_rank long, earliest_commit long, most_recent_commit long, commit_count long, path string")
    short = [r.line for r in report.csv_report(rows, "1.0").orderBy("pos").collect()]
    assert short == ["Ver,Class,Priority,Change Proneness Rank,Effort Rank,Method Count,Most Recent Commit Date,Commit Count,", "1.0,p.A,1,5,2,50,2020-07-20T20:13:20,3,eol"]
    long = [r.line for r in report.csv_report(rows, "1.0", True).orderBy("pos").collect()]
    assert long[0].count(",") == 15 and long[1] == "1.0,p.A,1,5,2,50,1,7,2,0.13,1,2020-07-20T20:13:17,2020-07-20T20:13:20,3,a.java,eol"
    assert spark.range(1).select(report.csv_name("x", "2", F.lit("2024-03-05 15:06:00").cast("timestamp"))).first()[0] == "RefFirst_Px_PV2_PD202403050306.csv"


def test_signatures_and_partners(spark):
    cases = {
        "copy(Generic{T extends hudson.model.TopLevelItem},java.lang.String)": "copy(T,String)",
        "isAllSuitableNodesOffline(Generic{R extends hudson.model.AbstractBuild}, Generic{R}>})": "isAllSuitableNodesOffline(R)",
    }
    for given, want in cases.items():
        assert spark.range(1).select(names.short_signature(F.lit(given))).first()[0] == want
    partners = "upWaitQueue(com.tonikelope.megabasterd.Transference) ↔ TransferenceManager.downWaitQueue(com.tonikelope.megabasterd.Transference)"
    assert spark.range(1).select(names.short_partners(F.lit(partners))).first()[0] == "upWaitQueue(Transference) ↔ TransferenceManager.downWaitQueue(Transference)"


def test_duplication_of_eligible_methods_alone(spark):
    body = "\n".join(f"line {k};" for k in range(14))
    other = "\n".join(f"thing {k};" for k in range(6))
    rows = [("p.A", 1, body, False, False), ("p.B", 2, "x;\n" + body, False, False), ("p.C", 3, body, True, False), ("p.D", 4, body, False, True), ("p.E", 5, other, False, False), ("p.F", 6, "license\n" + other.replace("thing", "word"), False, False), ("p.G", 7, "license\n" + other.replace("thing", "name"), False, False)]
    bodies = df(spark, rows, "class_fqn string, method long, body string, is_constructor boolean, is_accessor boolean")
    got = {r.class_fqn: (r.sec, r.sdc, r.partners) for r in clones.significant_duplication(bodies).collect()}
    assert got == {"p.A": (14, 0, "1 ↔ B.2"), "p.B": (14, 0, "2 ↔ A.1")}
    methods = clones.eligible_methods(bodies)
    assert clones.average_loc(methods).first().average == (14 + 15 + 6 + 7 + 7) / 5
    every = {tuple(r) for r in clones.clone_runs(clones.lines_of(methods)).collect()}
    seeded = {tuple(r) for r in clones.clone_runs(clones.lines_of(methods), clones.seeded_pairs(methods)).collect()}
    assert seeded == {r for r in every if r[:2] == (1, 2)} and len(every) > len(seeded)


def brute_runs(a, b):
    found = []
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] == b[j] and not (i and j and a[i - 1] == b[j - 1]):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                found.append((i, j, n))
    return found


def test_clone_runs_and_chains(spark):
    import random

    r = random.Random(2)
    bodies = [[r.choice("abcdefg") for _ in range(r.randint(5, 25))] for _ in range(8)]
    lines = clones.eligible_lines(df(spark, [(f"p.C{i % 3}", i, "\n".join(f" {x} " for x in b) + "\n{\n}\n// no\n") for i, b in enumerate(bodies)], "class_fqn string, method long, body string"))
    got = {}
    for x in clones.clone_runs(lines).collect():
        got.setdefault((x.a, x.b), set()).add((x.start_a, x.start_b, x["size"]))
    want = {(i, j): set(brute_runs(bodies[i], bodies[j])) for i in range(8) for j in range(i + 1, 8)}
    assert got == {k: v for k, v in want.items() if v}
    chains = {}
    for (a, b), runs in want.items():
        runs, current, n = sorted(runs), [], 0
        for run in [*runs, None]:
            if run and current:
                p = current[-1]
                gaps = run[0] - p[0] - p[2], run[1] - p[1] - p[2]
                if min(gaps) >= 0 and min(gaps) <= 5:
                    current.append(run)
                    continue
            if len(current) > 1:
                sdc = sum(x[2] for x in current) + sum(min(y[0] - x[0] - x[2], y[1] - x[1] - x[2]) for x, y in zip(current, current[1:], strict=False))
                chains.setdefault((a, b), []).append((len(current), sdc))
            current = [run]
    got = {}
    for x in clones.clone_chains(clones.clone_runs(lines)).collect():
        got.setdefault((x.a, x.b), []).append((x.clones, x.sdc))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in chains.items()}


def test_edge_priority_order(spark):
    rows = [("C1", 5, 1, False, 6, 0, 0), ("C2", 5, 1, False, 1, 1, 0), ("C3", 3, 1, False, 5, 0, 1), ("C4", 3, 1, False, 0, 0, 0), ("C5", 3, 1, True, 2, 0, 0)]
    counted = df(spark, [(f"p{n}.x", f"q{n}.y", w, c) for n, c, w, *_ in rows], "src string, dst string, weight long, cycle_count long")
    counts = df(spark, [(f"p{n}", f"q{n}", k) for n, _, _, _, k, *_ in rows], "src string, dst string, cycle_count long")
    removed = df(spark, [("pC5", "qC5")], "src string, dst string")
    gone = df(spark, [("pC2.x",), ("qC3.y",)], "v string")
    got = priority.edge_priority(counted, counts, removed, gone).orderBy("priority").collect()
    assert [r.src for r in got] == ["pC1.x", "pC2.x", "pC5.x", "pC3.x", "pC4.x"]


def test_priorities_and_locations(spark):
    instances = df(spark, [("a.A", "A", 2), ("a.B", "B", 1), ("a.X", "gone", 1)], "class_fqn string, path string, effort_rank long")
    scm = df(spark, [("A", 2, 10), ("B", 1, 10)], "path string, commit_count long, earliest_commit long")
    got = {r.class_fqn: r for r in priority.prioritize(instances, scm, df(spark, [(10, 4)], "ts long, n long")).collect()}
    assert set(got) == {"a.A", "a.B"} and got["a.A"].change_proneness_rank > got["a.B"].change_proneness_rank
    assert all(r.raw_priority == r.change_proneness_rank - r.effort_rank for r in got.values())
    places = priority.locate(df(spark, [("p.A$B",), ("p.C",), ("p.D",)], "class_fqn string"), df(spark, [("p.A", "A.java"), ("p.C", "C.java")], "class_fqn string, path string"))
    assert {r.class_fqn: r.path for r in places.collect()} == {"p.A$B": "A.java", "p.C": "C.java", "p.D": None}


def test_names(spark):
    row = spark.range(1).select(
        names.package_of(F.lit("a.b.C")).alias("p"), names.package_of(F.lit("C")).alias("q"), names.simple_name(F.lit("a.b.C")).alias("s"), names.outer_of(F.lit("a.B$C$1")).alias("o"),
        names.canonical_path(F.lit("file:///r/x\\y.java"), "/r").alias("c"), names.line_count(F.lit("\n a\nb \n")).alias("n"), names.line_count(F.lit("  ")).alias("z"),
        names.normalised_lines(F.lit("{\n a; \n// x\n* y\n}\n\nb")).alias("l"), names.short_signature(F.lit("m(java.util.List<java.lang.String>,int)")).alias("m"),
        names.short_partners(F.lit("m(a.b.C) ↔ D.n(e.F)")).alias("d"), names.escape(F.lit("a<b>&")).alias("e"), names.stamp(F.lit("2020-01-02 15:04:05").cast("timestamp")).alias("t"),
    ).first()
    assert (row.p, row.q, row.s, row.o, row.c, row.n, row.z) == ("a.b", "", "C", "a.B", "x/y.java", 2, 0)
    assert (list(row.l), row.m, row.d, row.e, row.t) == (["a;", "b"], "m(List,int)", "m(C) ↔ D.n(F)", "a&lt;b&gt;&amp;", "202001020304")
    assert names.blob_url("https://h/r.git", "abc") == "https://h/r/blob/abc/"


def test_sources(spark, tmp_path):
    for name, text in {"src/main/p/A.java": "package p;\nimport q.B;\npublic class A<T> extends Base {}", "src/test/p/T.java": "package p; class T {}", "x.txt": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = code.simple_facts(code.source_tree(spark, str(tmp_path))).collect()
    assert [(r.package, r.class_fqn, r.parent, list(r.imports)) for r in rows] == [("p", "p.A", "Base", ["q.B"])]
    assert code.source_tree(spark, str(tmp_path), code.Config(exclude_tests=False)).count() == 2
    refs = df(spark, [("a", "field", ["x", "x", "y"]), ("a", "javadoc", ["z"])], "owner_fqn string, ref_kind string, targets array<string>")
    assert sorted(r.target_fqn for r in code.flat_refs(refs).collect()) == ["x", "y"]
    assert code.violations(df(spark, [("CBORule", "has 23 of"), ("Other", "1")], "rule string, message string"), "CBO").first().n == 23


def test_reports(spark, tmp_path):
    ranked = df(spark, [("a.B", "B", 1, 3, 2, 1), ("a.C<", "C", 2, 1, -1, 2)], "class_fqn string, path string, effort_rank long, change_proneness_rank long, raw_priority long, priority long")
    assert [r.row for r in report.bubble_rows(ranked).orderBy("priority").collect()] == ["['a.B',1,3,1,1]", "['a.C<',2,1,2,0]"]
    assert report.json_report(ranked).first().json.startswith('{"rankedDisharmonies":[{"className":"a.B"')
    page = report.html_report([("God", ranked), ("None", ranked.limit(0))], "R")
    assert "a.C&lt;" in page and "None" not in page and "No disharmony" in report.html_report([("x", ranked.limit(0))], "R")
    report.write_text(page, str(tmp_path / "a/b.html"))
    assert (tmp_path / "a/b.html").read_text() == page
    edges = df(spark, [("A", "B", 2), ("B", "C$1", 1)], "src string, dst string, weight long")
    text = report.dot_text(edges, df(spark, [("A", "B")], "src string, dst string"))
    assert 'A -> B [ label = "2" weight = "2" color = "red" ];' in text and {r.v for r in report.shown_vertices(edges).collect()} == {"A", "B"}
    report.save(ranked, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2 and report.specs(spark).count() == 11


def test_cycle_table_and_command_line(spark, tmp_path, capsys):
    from cragline.__main__ import main

    members = df(spark, [(1, "A"), (1, "B")], "cycle_id int, v string")
    edges = df(spark, [("A", "B", 2), ("B", "A", 1), ("A", "X", 9)], "src string, dst string, weight long")
    rows = report.cycle_table(members, edges, df(spark, [("B", "A")], "src string, dst string"), df(spark, [("A",)], "v string")).collect()
    assert sorted((r.v, r.edges) for r in rows) == [("A*", "B:2"), ("B", "A:1*")]
    main(["list"])
    assert "god_class_priority" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["nothing", str(tmp_path)])
