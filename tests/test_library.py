import json
import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import checks, physics, text
from quillon.operators import aggregates, elementwise, filters, grid, neighbours, relations, scans, sparse
from quillon.plans import validation
from quillon.sources import files, generators, sinks
from quillon.streaming import simulation


def frame(spark, rows, kind):
    return spark.createDataFrame(rows, kind)


# --- readers and writers
def test_edge_list_skips_comments_and_closes_pairs(spark, tmp_path):
    (tmp_path / "g.txt").write_text("# c\n\n0 1\n1\t4\n")
    e = files.edge_list(spark, str(tmp_path / "g.txt"))
    assert sorted(map(tuple, e.collect())) == [(0, 1), (1, 0), (1, 4), (4, 1)] and files.vertex_count(e) == 5


def test_text_formats(spark, tmp_path):
    (tmp_path / "log").write_text("RUN MODE: a\nT P\n1 2.5\n3 x\nRUN MODE: b\n")
    assert files.log_header(spark, str(tmp_path / "log"), "RUN MODE").first().value == "b"
    (tmp_path / "num").write_text("h h\n1 2.5\n# c\n3 x\n")
    assert [(r.a, r.b) for r in files.numeric_log(spark, str(tmp_path / "num"), ["a", "b"]).orderBy("line").collect()] == [(1.0, 2.5), (3.0, None)]
    (tmp_path / "kv").write_text("T=1 | P = 2\nnothing\n")
    assert sorted((r.key, r.value) for r in files.key_value_lines(spark, str(tmp_path / "kv")).collect()) == [("P", "2"), ("T", "1")]
    (tmp_path / "b").write_text("CPU: 1.5 ms at 2\nCPU: 2.5 ms at 4\n")
    assert [(r.ms, r.n) for r in files.all_matches(spark, str(tmp_path / "b"), r"CPU: ([\d.]+) ms at (\d+)", ["ms", "n"]).collect()] == [(1.5, 2.0), (2.5, 4.0)]
    lines = frame(spark, [("FINAL_T = 9.5", 0), ("FINAL_T = 1.5", 2), ("x FINAL_P: -2e1", 1), ("FINAL_T = ?", 3)], "value string, line int")
    assert tuple(files.final_values(lines, ["T", "P"]).first()) == (1.5, -20.0)


def test_dump_takes_the_last_frame(spark, tmp_path):
    one = "ITEM: TIMESTEP\n{s}\nITEM: NUMBER OF ATOMS\n1\nITEM: BOX BOUNDS\n0 1\nITEM: ATOMS id x\n{a}\n"
    (tmp_path / "d").write_text(one.format(s=0, a="1 0.5") + one.format(s=10, a="1 0.75\n2 0.25"))
    rows = files.lammps_dump(spark, str(tmp_path / "d")).orderBy("line").collect()
    assert [(r.step, r.atom["x"]) for r in rows] == [(10, "0.75"), (10, "0.25")]
    (tmp_path / "r").write_text("# c\n0 2\n1 0.1 0.0\n2 0.2 1.5\n")
    assert [(r.r, r.g) for r in files.lammps_rdf(spark, str(tmp_path / "r"), 1).collect()] == [(0.2, 1.5)]


def test_json_folder_and_archive_sources(spark, tmp_path):
    (tmp_path / "db.json").write_text(json.dumps([{"path": "a", "short": "s"}, {"path": "b"}]))
    db = files.json_documents(spark, str(tmp_path / "db.json"), "path string, short string", {"short": "-"})
    assert sorted(map(tuple, db.collect())) == [("a", "s"), ("b", "-")]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "Plasma_flow.pdf").write_text("x")
    (tmp_path / "sub" / "other.pdf").write_text("xyz")
    found = files.scan_folder(spark, str(tmp_path / "sub"), ".pdf", ["plasma", "flow"])
    assert [(r.name, r.tags) for r in found.collect()] == [("Plasma_flow.pdf", ["plasma", "flow"])]
    assert files.scan_folder(spark, str(tmp_path / "sub"), ".pdf", ["plasma"], found).count() == 0
    import io
    import tarfile

    with tarfile.open(tmp_path / "p.tar.gz", "w:gz") as tar:
        info = tarfile.TarInfo("m.tex")
        info.size = 5
        tar.addfile(info, io.BytesIO(b"hello"))
    assert [(r.member, r.text) for r in files.archive_members(spark, str(tmp_path / "p.tar.gz")).collect()] == [("m.tex", "hello")]
    assert files.resolve_case("c", ["d"], {"d/c.json"}.__contains__) == "d/c.json"


def test_writers(spark, tmp_path):
    df = frame(spark, [(1, "a", None)], "k int, s string, v double")
    sinks.write_csv(df, str(tmp_path / "c"), ["s", "gone", "k"])
    assert [tuple(r) for r in files.csv_rows(spark, str(tmp_path / "c")).collect()] == [("a", None, "1")]
    sinks.append_log(df, str(tmp_path / "c"), ["s", "gone", "k"])
    assert files.csv_rows(spark, str(tmp_path / "c")).count() == 2
    state = lambda rows: frame(spark, rows, "k string, status string, at int")
    sinks.upsert_json(state([("x", "RUNNING", 1), ("y", "RUNNING", 1)]), str(tmp_path / "j"), "k", "at")
    out = sinks.upsert_json(state([("x", "SUCCESS", 2)]), str(tmp_path / "j"), "k", "at")
    assert sorted((r.k, r.status) for r in out.collect()) == [("x", "SUCCESS"), ("y", "RUNNING")]
    report = sinks.markdown_report("R", {"checks": frame(spark, [("m", "pass")], "name string, status string")})
    assert "pass: 1" in report and "| m | pass |" in report
    sinks.write_text(df.select("k", "s"), str(tmp_path / "t"), "%d %s")
    assert spark.read.text(str(tmp_path / "t")).first().value == "1 a"


# --- generators
def test_generators_do_not_depend_on_partitions(spark):
    a = generators.vector(spark, 1000, levels=256)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, a.repartition(7).collect()))
    coo = generators.unique_coo(spark, 16, 16, 500)
    assert coo.count() == coo.select("r", "c").distinct().count()
    e = generators.rmat_edges(spark, 8, 8)
    assert e.count() == 4096 and e.groupBy("src").count().agg(F.max("count")).first()[0] > 40
    p = generators.lattice_particles(spark, 1000, 10.0, 2.0)
    r = p.agg(F.avg(F.col("px") ** 2).alias("t"), F.max(F.abs("x")).alias("x"), F.countDistinct("x", "y", "z").alias("n")).first()
    assert abs(r.t - 2.0) < 0.4 and r.x < 5 and r.n == 1000
    inside = generators.ellipsoid_particles(spark, 500, (3.0, 2.0, 1.0), 0.3, 0.5).where("x*x/9 + y*y/4 + z*z > 1.0000001")
    assert inside.count() == 0


# --- edges of aggregates and windows
def test_statistics_of_few_rows(spark):
    rows = frame(spark, [(1.0, 2.0)], "x double, y double")
    r = aggregates.linear_fit(rows, "x", "y").first()
    assert r.n == 1 and math.isnan(r.slope) and math.isnan(r.r2)
    assert rows.agg(aggregates.sample_std("x")).first()[0] == 0.0
    flat = aggregates.linear_fit(frame(spark, [(1.0, 2.0), (2.0, 2.0), (float("nan"), 1.0)], "x double, y double"), "x", "y").first()
    assert flat.n == 2 and flat.slope == 0.0 and flat.r2 == 1.0


def test_windows_and_scans(spark):
    df = frame(spark, [(i, i + 1) for i in range(10)], "idx long, v long")
    assert sorted(r.idx for r in scans.row_window(df, "second_half").collect()) == [5, 6, 7, 8, 9]
    assert sorted(r.idx for r in scans.row_window(df, "last_80_percent").collect()) == list(range(2, 10))
    assert sorted(r.idx for r in scans.row_window(df, "last_fraction:0.0").collect()) == [9]
    with pytest.raises(ValueError):
        scans.row_window(df, "odd")
    assert [r.scan for r in scans.prefix_sum(df, buckets=3).orderBy("idx").collect()] == [i * (i + 1) // 2 for i in range(1, 11)]
    assert scans.prefix_sum(df.limit(0)).count() == 0


def test_merge_keeps_the_first_run_first(spark):
    a, b = frame(spark, [(0, 1), (1, 3)], "idx long, v long"), frame(spark, [(0, 1), (1, 2)], "idx long, v long")
    out = relations.merge_sorted(a, b).orderBy("pos").collect()
    assert [(r.v, r.side) for r in out] == [(1, 0), (1, 1), (2, 1), (3, 0)]


def test_sparse_forms_agree(spark):
    a = frame(spark, [(0, 1, 2), (2, 0, 3), (2, 2, 1)], "r long, c long, v long")
    x = frame(spark, [(0, 1), (1, 10), (2, 100)], "i long, x long")
    want = [(0, 20), (1, 0), (2, 103)]
    assert sorted(map(tuple, sparse.spmv(a, x, 3).collect())) == want
    csr = sparse.coo_to_csr(a, 3)
    assert sorted(map(tuple, sparse.spmv_csr(csr, x).collect())) == want
    assert [r.start for r in csr.orderBy("r").collect()] == [0, 1, 1]
    assert all(len(r.entries) == 2 for r in sparse.csr_to_ell(csr).collect())
    m = lambda df: sorted(tuple(map(float, r)) for r in df.collect())
    assert m(sparse.matmul(a, a)) == m(sparse.matmul_blocks(a, a, 2))


def test_stencils_of_a_constant_grid(spark):
    g = frame(spark, [(i, j, k, 1.0) for i in range(4) for j in range(4) for k in range(4)], "i long, j long, k long, v double")
    assert {round(r.v, 9) for r in grid.smooth3d(g, 4, 2).collect()} == {1.0}
    assert {r.v for r in grid.stencil3d(g, 4).collect()} == {1.75} and grid.stencil3d(g, 4).count() == 8
    assert {(r.gx, r.lap) for r in grid.gradient_laplacian(g, 4, 1.0).collect()} == {(0.0, 0.0)}


def test_neighbour_pairs_equal_all_pairs(spark):
    p = generators.isotropic_particles(spark, 150, 6.0, 1.0).select("id", "x", "y", "z").collect()
    df = frame(spark, [tuple(r) for r in p], "id long, x double, y double, z double")
    for periodic in (True, False):
        gap = lambda d: d - 6.0 * round(d / 6.0) if periodic else d  # noqa: B023, E731
        want = {(a.id, b.id) for a in p for b in p if a.id < b.id and sum(gap(a[c] - b[c]) ** 2 for c in "xyz") < 1.44}
        assert {(r.a, r.b) for r in neighbours.pairs_within(df, 1.2, 6.0, periodic).collect()} == want


# --- simulation invariants
def test_wrap_and_reflect(spark):
    df = frame(spark, [(5.5, 1.0, 0, 0.0), (-5.0, 1.0, 0, 0.0), (16.0, 2.0, 0, 0.0)], "x double, px double, ix int, wall double")
    w = df.withColumns(simulation.wrap("x", 10.0)).collect()
    assert [(r.x, r.ix) for r in w] == [(-4.5, 1), (5.0, -1), (-4.0, 2)]
    r = df.withColumns(simulation.reflect("x", 10.0)).collect()
    assert [(x.x, x.px, x.wall) for x in r] == [(4.5, -1.0, 2.0), (-5.0, 1.0, 0.0), (-4.0, 2.0, 8.0)]


def test_dynamics_conserve_momentum_and_energy(spark):
    p = generators.lattice_particles(spark, 125, 6.0, 0.5)
    start = simulation.observables(simulation.pair_forces(p, 6.0), 6.0).first()
    end = simulation.observables(simulation.evolve(p, 3, 6.0, 0.001, simulation.Policy(), cut=1), 6.0).first()
    assert abs(end.ke + end.pe - start.ke - start.pe) < 1e-2 * abs(start.ke + start.pe)
    assert all(abs(end[c] - start[c]) < 1e-9 for c in ("px", "py", "pz"))


def test_collisions_conserve(spark):
    p = generators.lattice_particles(spark, 216, 6.0, 1.0)
    a, b = simulation.observables(p, 6.0).first(), simulation.observables(simulation.collide(p, 6.0, 2, 0.5, 0.8), 6.0).first()
    assert a.n == b.n and abs(a.ke - b.ke) < 1e-9 * a.ke and abs(a.px - b.px) < 1e-9
    q = generators.ellipsoid_particles(spark, 300, (3.0, 3.0, 3.0), 0.3, 0.5)
    out = simulation.collide(q, 6.0, 2, 0.5, 0.8, "relativistic", 0.5)
    total = lambda df: df.agg(F.sum("e"), F.sum("px"), F.sum("py"), F.sum("pz")).first()
    assert all(abs(x - y) < 1e-6 for x, y in zip(total(q), total(out)))
    more = simulation.collide(q, 6.0, 2, 0.5, 0.8, "relativistic", 0.5, split=1.0)
    less = simulation.collide(q, 6.0, 2, 0.5, 0.8, "relativistic", 0.5, merge=1.0)
    assert more.count() > 300 > less.count()
    assert all(abs(x - y) < 1e-6 for x, y in zip(total(q), total(less)))


def test_thermostats(spark):
    p = generators.isotropic_particles(spark, 3000, 8.0, 3.0)
    t = simulation.andersen(p, 1.0, 1e9, 1.0, 3, 0).agg(F.avg(F.col("px") ** 2)).first()[0]
    assert abs(t - 1) < 0.15
    chain = simulation.NoseHooverChain(1.0, 300)
    assert chain.half_step(600.0, 0.05) < 1 or chain.half_step(600.0, 0.05) < 1
    hot = generators.ellipsoid_particles(spark, 400, (1.0, 1.0, 1.0), 0.6, 0.5)
    mean = lambda df: df.agg(F.avg((F.col("px") ** 2 + F.col("py") ** 2 + F.col("pz") ** 2) / F.col("e"))).first()[0] / 3
    assert abs(mean(simulation.rescale_relativistic(hot, 0.3, 0.5)) - 0.3) < abs(mean(hot) - 0.3)


# --- formulas, checks, texts
def test_formulas(spark):
    one = spark.range(1)
    f, virial, e = one.select(*physics.lennard_jones(F.lit(2 ** (1 / 3)))).first()
    assert abs(f) < 1e-9 and abs(e + 1) < 1e-12
    assert tuple(one.select(*physics.lennard_jones(F.lit(9.0))).first()) == (0.0, 0.0, 0.0)
    assert one.select(physics.lennard_jones(F.lit(0.01))[0] * 0.1).first()[0] == pytest.approx(1e4)
    assert physics.second_virial(3.418) == pytest.approx(0, abs=0.03)
    assert one.select(physics.carnahan_starling_z(F.lit(0.0))).first()[0] == 1.0
    assert physics.pressure_tail(0.8) < 0 and physics.energy_tail(0.8) < 0


def test_checks(spark):
    v = frame(spark, [(1.0,), (None,), (float("nan"),)], "v double")
    assert [r.s for r in v.select(checks.check_threshold(F.col("v"), low=0.0)[0].alias("s")).collect()] == ["pass", "fail", "fail"]
    assert {r.s for r in v.select(checks.check_threshold(F.col("v"))[0].alias("s")).collect()} == {"info"}
    rows = frame(spark, [(0.0, 0.0), (None, 1.0), (1.0, None), (1.0, 2.0)], "a double, b double")
    assert [r.s for r in rows.select(checks.compare_values(F.col("a"), F.col("b"), max_pct=1.0)[2].alias("s")).collect()] == ["pass", "missing_value", "missing_reference", "fail"]


def test_missing_comparison_does_not_fail_the_case(spark):
    _, code = validation.run_case(spark, {"comparisons": [{"name": "c", "type": "summary_table", "left": "x", "right": "y", "observables": []}]}, {})
    assert code == 0
    _, code = validation.run_case(spark, {"metrics": [{"name": "m", "type": "csv_column", "table": "x"}]}, {})
    assert code == 1
    listing = frame(spark, [("a", 3)], "path string, length long")
    got = validation.artifacts(spark, [{"path": "a"}, {"path": "b"}, {"path": "c", "required": False}], listing).collect()
    assert {r.path: r.status for r in got} == {"a": "present", "b": "missing_required", "c": "missing_optional"}


def test_texts(spark):
    df = frame(spark, [(1, "x" * 1801), (2, "")], "doc_id long, text string")
    assert [(r.chunk_no, len(r.chunk)) for r in text.chunks(df).orderBy("chunk_no").collect()] == [(0, 1000), (1, 1000), (2, 201)]
    p = frame(spark, [("\\begin{abstract} body \\end{abstract}",), ("% c",), ("12 + 3",), ("A real sentence.",)], "p string")
    assert [r[0] for r in p.select(text.worth_translating(F.col("p"))).collect()] == [True, False, True, True]
    q = frame(spark, [(x,) for x in ("\\def\\a{b}", "\\begin{figure}\nx\n\\end{figure}", "\\input{a}\n \\include{b}", "\\input{a}\nwords", "\\label{x}", "\\section{Intro}")], "p string")
    assert [r[0] for r in q.select(text.worth_translating(F.col("p"))).collect()] == [False, False, False, True, False, True]
    head, body, tail = p.select(*text.strip_environment(F.col("p"))).first()
    assert (head.strip(), body.strip(), tail.strip()) == ("\\begin{abstract}", "body", "\\end{abstract}")
    one = frame(spark, [("\\input{a} \\include{b.tex}", "\\alpha中", "T: 5 | x")], "a string, b string, c string")
    r = one.select(text.rewrite_inputs(F.col("a")), text.space_after_macro(F.col("b")), text.key_value(F.col("c"), "T")).first()
    assert tuple(r) == ("\\input{a_ZH} \\include{b_ZH.tex}", "\\alpha 中", "5")


def test_cell_ids_clamp_and_truncate(spark):
    df = frame(spark, [(-9.0, 0.0, 0.0), (4.999, 4.999, 4.999), (0.0, 0.0, 9.0)], "x double, y double, z double")
    assert [r[0] for r in df.select(elementwise.cell_id(10.0, 2)).collect()] == [6, 7, 7]


def test_groups_overlap(spark):
    df = frame(spark, [(1,), (2,)], "v int")
    out = filters.groups_by_predicate(df, {"all": F.lit(True), "two": F.col("v") == 2})
    assert sorted((r.v, r.group) for r in out.collect()) == [(1, "all"), (2, "all"), (2, "two")]


def test_fits_recover_parameters(spark):
    import numpy as np

    from quillon.operators import fits

    p = np.linspace(0.05, 3, 60)
    bins = frame(spark, [(float(x), float(2 * x * x * np.exp(-(np.sqrt(x * x + 0.25) - 0.5) / 0.4))) for x in p], "p double, density double")
    a, t = fits.fit_juttner(bins, 0.5)
    assert a == pytest.approx(2, rel=1e-3) and t == pytest.approx(0.4, rel=1e-3)
    line = frame(spark, [(float(e), float(np.exp(1 - e / 0.7))) for e in p] + [(9.0, 0.0)], "e double, density double")
    assert fits.fit_log_boltzmann(line) == pytest.approx((1.0, 0.7), rel=1e-4)


def test_translation_calls_only_for_misses(spark):
    from quillon.plans import translation

    docs = frame(spark, [(1, "Hello there\n\n% note\n\n\\begin{abstract} Some body \\end{abstract}"), (2, "Hello there\n\n\\begin{thebibliography}{9}\n\nStays here")], "doc_id long, text string")
    cache = frame(spark, [("x", "y")], "hash string, value string")
    out, whole = translation.translate_documents(docs, cache, lambda x: x.str.upper())
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[1] == "HELLO THERE\n\n% note\n\n\\begin{abstract} SOME BODY \\end{abstract}"
    assert got[2] == "HELLO THERE\n\n\\begin{thebibliography}{9}\n\nStays here"
    assert whole.count() == 3
    again, _ = translation.translate_documents(docs, whole, lambda x: 1 / 0)
    assert {r.doc_id: r.text for r in again.collect()} == got
    status = frame(spark, [("a", "SUCCESS", 1), ("b", "FAILED", 1)], "name string, status string, at int")
    tasks = frame(spark, [("a",), ("b",), ("c",)], "name string")
    assert [r.name for r in translation.pending(tasks, status).collect()] == ["b", "c"]
    new = translation.record(status, frame(spark, [("b", "SUCCESS", 2)], "name string, status string, at int"))
    assert [r.name for r in translation.pending(tasks, new).collect()] == ["c"]


# --- registered queries


def test_bfs_levels_reach_the_end_of_a_long_component(spark, tmp_path):
    from quillon import registry

    # parts and suppliers in a chain: p1 s1 p2 s2 ...
    rows = [(i, s, 50) for i in range(1, 11) for s in (i - 1, i) if s]
    frame(spark, rows, "l_partkey long, l_suppkey long, l_quantity long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.v: r.level for r in registry.queries()["bfs_levels"](spark, str(tmp_path)).collect()}
    assert got == {2 * i: 2 * (i - 1) for i in range(1, 11)} | {2 * i + 1: 2 * i - 1 for i in range(1, 11)}


def test_ranks_integrals_and_first_values_in_two_phases(spark):
    import random

    rng = random.Random(4)
    data = [(i, rng.choice([None, "b", "A", "c"]), rng.choice([1, 2]), float(rng.randrange(50))) for i in rng.sample(range(10_000), 300)]
    df = spark.createDataFrame(data, "idx long, name string, g int, v double").repartition(5)
    want = {r[0]: k for k, r in enumerate(sorted(data, key=lambda r: (r[1] is not None, (r[1] or "").lower(), r[0])))}
    assert {r.idx: r.rank for r in scans.ranks(df, [F.lower("name")], "idx", buckets=7).collect()} == want
    area = {}
    for g in (None, 1, 2):
        rows = sorted((r[0], r[3]) for r in data if g in (None, r[2]))
        area[g] = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(rows, rows[1:]))
    assert abs(scans.trapezoid(df, "idx", "v", buckets=7).first().integral - area[None]) < 1e-6
    assert all(abs(r.integral - area[r.g]) < 1e-6 for r in scans.trapezoid(df, "idx", "v", ["g"], 7).collect())
    assert scans.trapezoid(df.limit(0), "idx", "v").first().integral == 0 and scans.ranks(df.limit(0), [F.col("name")], "idx").count() == 0
    third = {g: sorted((r[0], r[3]) for r in data if r[2] == g)[2][1] for g in (1, 2)}
    got = scans.relative_to_first(df.withColumn("v", F.col("v") + 1), "idx", "v", 3, ["g"]).collect()
    assert len(got) == 300 and all(abs(r.ratio - r.v / (third[r.g] + 1)) < 1e-9 for r in got)
    assert scans.relative_to_first(df, "idx", "v", 400).where("ratio is not null").count() == 0


def test_random_entries_are_as_many_as_asked(spark):
    for rows, cols, nnz in ((64, 64, 1000), (3, 3, 20), (5, 4, 20), (2, 2, 0)):
        got = generators.unique_coo(spark, rows, cols, nnz).collect()
        assert len(got) == len({(r.r, r.c) for r in got}) == min(nnz, rows * cols) and all(0 <= r.r < rows and 0 <= r.c < cols for r in got)


def test_pairs_of_a_wide_cutoff_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    places = [(i, *(rng.uniform(-5, 5) for _ in range(3))) for i in range(60)]
    df = spark.createDataFrame(places, "id long, x double, y double, z double")
    gap = lambda a, b: sum((u - v - 10 * round((u - v) / 10)) ** 2 for u, v in zip(a[1:], b[1:]))
    want = {(a[0], b[0]) for a in places for b in places if a[0] < b[0] and gap(a, b) < 25}
    found = [(r.a, r.b) for r in neighbours.pairs_within(df, 5.0, 10.0).collect()]
    assert len(found) == len(want) and set(found) == want
