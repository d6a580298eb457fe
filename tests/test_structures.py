"""Index, versions, cases, graphs, hybrid matrices and scans against plain versions."""

import contextlib
import math
import random
import re
import threading
import time
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import graph as G
from quillon.operators import postings as I
from quillon.operators import scans as W
from quillon.operators import sparse as S
from quillon.plans import cases
from quillon.sources import versions as V


# --- index
def plain_bm25(docs, query, k, digits=6, k1=1.5, b=0.75, eps=0.25):
    words = {i: (t or "").lower().split() for i, t in docs.items()}
    n, avgdl = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: eps * mean if x < 0 else x for w, x in idf.items()}
    asked, out = query.lower().split(), []
    for i, ws in words.items():
        c = Counter(ws)
        if any(c[w] for w in asked):
            out.append((round(sum(idf[w] * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * len(ws) / avgdl)) for w in asked if c[w]), digits), i))
    return [(i, s) for s, i in sorted(out, key=lambda x: (-x[0], x[1]))[:k]]


def test_search_equals_brute_force_over_segments(spark, tmp_path):
    rng = random.Random(2)
    voc = [f"w{i}" for i in range(40)] + ["hot"] * 60
    docs = {i: " ".join(rng.choices(voc, k=rng.randint(0, 60))) for i in range(400)} | {400: None, 401: "", 402: "W1 w1\tw1\nhot", 403: "same words", 404: "same words"}
    base = str(tmp_path / "ix")
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in docs.items()], "doc_id long, text string, bucket string, tf int")
    for part in range(3):
        assert I.add_documents(df.where(F.col("doc_id") % 3 == part), base, block=16, buckets=4) == part + 1
    for query, k in (("w1 hot", 7), ("hot", 3), ("w3 w3 w9 unknown", 10), ("same words", 5), ("w1 w2 w3 w4 w5", 400)):
        got = [tuple(r) for r in I.search(spark, base, query, k, digits=6).collect()]
        want = plain_bm25(docs, query, k)
        assert [i for i, _ in got] == [i for i, _ in want] and all(math.isclose(a, b, abs_tol=2e-6) for (_, a), (_, b) in zip(got, want))
    assert I.search(spark, base, "unknown").count() == 0 and I.search(spark, base, " ").count() == 0 and I.search(spark, str(tmp_path / "none"), "w1").count() == 0
    # an older version is still there, and only the terms' folders are read
    assert {i % 3 for i, _ in [tuple(r) for r in I.search(spark, base, "hot", 50, version=1).collect()]} == {0}
    plan = I.postings(spark, base, ["w1"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(term" in plan or "PushedFilters" in plan
    wanted = {r["b"] for r in spark.createDataFrame([("w1",)], "term string").select(I._bucket(F.col("term"), 4).alias("b")).collect()}
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in I.postings(spark, base, ["w1"]).select(F.input_file_name()).distinct().toPandas().iloc[:, 0]} == wanted


def test_blocks_below_the_cutoff_are_not_scored(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(["rare"] * ((i % 7 == 0) + (i == 77) * 9) + ["pad"] * (i % 50))) for i in range(500)], "doc_id long, text string")
    base = str(tmp_path / "ix")
    I.add_documents(docs, base, block=16)
    r = I.search(spark, base, "rare", 1, first=1)
    assert r.first().doc == 77 and T.bm25(docs, "rare", k=1).first().doc_id == 77


# --- versions
def test_readers_see_whole_versions(spark, tmp_path):
    base = str(tmp_path / "t")
    df = lambda n: spark.range(n).withColumn("a b", F.lit("x"))
    assert V.read_version(spark, base) is None
    one = V.write_version(df(3), base)
    store = V.Store(spark, base)
    df(50).write.parquet(store.folder(0))  # a writer that died before it published
    busy = store.folder(4)
    df(1).write.parquet(busy)  # and one that is at work when others expire versions
    with pytest.raises(V.Conflict):
        store.publish(0, {"folder": "late"})
    assert V.read_version(spark, base).count() == 3 and store.numbers() == [1]
    V.write_version(one.unionAll(df(2)), base)  # reads what it replaces
    assert V.read_version(spark, base).count() == 5 and V.read_version(spark, base, 1).count() == 3
    with pytest.raises(V.Conflict):  # made from version 1, which isn't the newest
        V.write_version(df(9), base, after=1)
    for n in (6, 7):
        V.write_version(df(n), base, "json", keep=2)
    assert store.numbers() == [3, 4] and V.read_version(spark, base).count() == 7 and V.read_version(spark, base, 3).columns == ["id", "a b"]
    assert len([x for x in (tmp_path / "t").iterdir() if x.name.startswith("data-")]) == 3
    store.publish(4, {"folder": busy, "format": "parquet", "schema": "id long, `a b` string"})
    assert V.read_version(spark, base).count() == 1


# --- cases
def test_cases_have_every_status_and_detail(spark, tmp_path):
    t = spark.createDataFrame([(i, float(i) if i != 3 else math.nan, "x" if i == 5 else str(2 * i), None) for i in range(10)], "o int, v double, s string, n double")
    s = spark.createDataFrame([("a", 0, 1.0, 2.0, None), ("a", 1, 3.0, 2.0, None), ("b", 2, None, 1.0, 4.0), ("c", 3, 1.0, None, None), ("d", 4, 1.0, 1.0, 9.0)], "observable string, o int, value double, reference double, rel_error_pct double")
    case = {
        "metrics": [
            {"name": "m", "type": "csv_column", "path": "t", "column": "v", "window": "second_half", "threshold": {"min": 7, "max": 6.5}},
            {"name": "std", "type": "csv_column", "path": "t", "column": "s", "stat": "std", "window": "last_fraction:0.1"},
            {"name": "last", "type": "csv_column", "path": "t", "column": "v", "stat": "last", "threshold": {"target": 9, "max_abs_error": 0.5}},
            {"name": "drift", "type": "csv_column", "path": "t", "column": "v", "stat": "relative_drift_abs_max", "window": "second_half", "threshold": {}},
            {"name": "none", "type": "csv_column", "path": "t", "column": "n"},
            {"name": "no_column", "type": "csv_column", "path": "t", "column": "zz", "threshold": {"min": 0}},
            {"name": "fit", "type": "msd_fit", "path": "t", "step_column": "v", "msd_column": "s", "dt": 2, "outputs": ["r2", "D"], "threshold": {"r2_min": 0.99, "D_min": 0.1}},
            {"name": "flat", "type": "msd_fit", "path": "t", "step_column": "n", "msd_column": "v"},
            {"name": "err", "type": "summary_observable", "path": "s", "observable": "d", "threshold": {"max": 5}},
            {"name": "first", "type": "summary_observable", "path": "s", "observable": "a", "error_column": "value"},
            {"name": "not_there", "type": "summary_observable", "path": "s", "observable": "z"},
            {"name": "gone", "type": "summary_observable", "path": "q", "observable": "z", "required": False}, {"name": "bad", "type": "csv_column", "path": "t", "column": "v", "stat": "mode"}, {"type": "who"},
        ],
        "comparisons": [
            {"type": "summary_table", "path": "s", "observables": [{"name": "a", "threshold": {"abs_error_max": 0.5, "rel_error_pct_max": 60}}, {"name": "b", "threshold": {"rel_error_pct_max": 4}}, {"name": "c"}, {"name": "d", "threshold": {"rel_error_pct_max": 5}}, {"name": "e"}]},
            {"type": "summary_table", "path": "q", "observables": [{"name": "f"}]}, {"type": "summary_table", "path": "q", "required": False, "observables": [{"name": "g"}]},
            {"type": "paired_csv_column", "name": "h", "left_path": "t", "left_column": "v", "right_path": "t", "right_column": "v"}, {"type": "paired_csv_column", "name": "i", "left_path": "q", "left_column": "v", "right_path": "t", "right_column": "v"},
            {"type": "paired_csv_column", "name": "j", "left_path": "t", "left_column": "n", "right_path": "t", "right_column": "v"}, {"name": "k"},
        ],
        "artifacts": [{"name": "x", "path": "x.png"}, {"name": "y", "path": "y.png", "required": False}],
    }
    tables = {"t": (t, "o"), "s": (s, "o")}
    listing = spark.createDataFrame([("x.png", 7)], "path string, length long")
    rows, ok = cases.run_case(spark, case, tables, out=str(tmp_path / "r"), listing=listing)
    got = [(r.name, r.status, r.value if r.value is None else round(r.value, 6), r.detail) for r in rows.orderBy("no").collect()]
    assert got[:15] == [
        ("m", "fail", 7.0, "<= 6.5"), ("std", "info", 0.0, "no threshold"), ("last", "pass", 9.0, "|value - 9| <= 0.5"), ("drift", "info", 0.8, "threshold has no scalar rule"),
        ("none", "fail", None, "no numeric values in t:n"), ("no_column", "fail", None, "no numeric values in t:zz"), ("fit.r2", "pass", 1.0, ">= 0.99"), ("fit.D", "pass", round(1 / 6, 6), ">= 0.1"), ("flat.r2", "fail", None, "value is not finite"), ("flat.D", "fail", None, "value is not finite"),
        ("err", "fail", 9.0, "<= 5"), ("first", "info", 1.0, "no threshold"), ("not_there", "fail", None, "observable z not found"), ("gone", "missing_optional", None, "missing q"), ("bad", "fail", None, "unknown stat mode"),
    ]
    assert [(n, s) for n, s, _, _ in got[15:]] == [
        ("unnamed", "fail"), ("a", "fail"), ("b", "pass"), ("c", "missing_reference"), ("d", "fail"), ("e", "missing_observable"), ("f", "missing_required"), ("g", "missing_reference"),
        ("h", "info"), ("i", "missing_value"), ("j", "missing_value"), ("k", "fail"),
    ]
    assert dict((n, d) for n, _, _, d in got)["a"] == "abs_error <= 0.5" and dict((n, d) for n, _, _, d in got)["i"].startswith("missing value table q; ")
    assert not ok and spark.read.csv(str(tmp_path / "r" / "metrics"), header=True).count() == len(got)
    good = {"metrics": case["metrics"][1:2], "comparisons": case["comparisons"][2:3]}
    assert cases.passed(cases.evaluate(spark, good, tables)) and not cases.passed(cases.evaluate(spark, good, tables), cases.artifacts(spark, {"artifacts": [{"name": "z", "path": "z"}]}, listing))


def test_a_table_is_aggregated_by_one_scan(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") * 2.0).alias("v"), (F.col("id") * 3.0).alias("w")).write.parquet(str(tmp_path / "p"))
    t = spark.read.parquet(str(tmp_path / "p"))
    case = {"metrics": [{"name": f"{c}{w}{s}", "type": "csv_column", "path": "t", "column": c, "window": w, "stat": s} for c in "vw" for w in ("all", "second_half", "last_80_percent") for s in cases.STATISTICS]}
    plan = cases.Plan(case, {"t"})
    df = cases.values(plan, {"t": (t, "id")})
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1 and df.count() == len(plan.wishes) == 24


# --- graphs
def random_edges(seed, n=60, m=400):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(100, i) for i in range(n)] + [(3, 3), (1, 2), (2, 1), (200, 201), (None, 5)]
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    return edges, near


@pytest.mark.parametrize("hub", [1, 5, 1000])
def test_triangles_equal_brute_force(spark, hub):
    edges, near = random_edges(hub)
    want = {v: sum(1 for a in near[v] for b in near[v] if a < b and b in near[a]) for v in near}
    got = {r.v: r.n for r in G.triangles(spark.createDataFrame(edges, "src long, dst long"), hub).collect()}
    assert got == {v: n for v, n in want.items() if n}


def peeled(near):
    near, core, k = {v: set(x) for v, x in near.items()}, {}, 0
    while near:
        v = min(near, key=lambda x: len(near[x]))
        k = max(k, len(near[v]))
        core[v] = k
        for u in near.pop(v):
            near[u].discard(v)
    return core


@pytest.mark.parametrize("n, m", [(60, 400), (300, 450)])
def test_core_numbers_equal_peeling(spark, n, m):
    edges, near = random_edges(n, n, m)
    got = {r.v: r.core for r in G.core_numbers(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == peeled(near)
    for v, k in got.items():
        assert sum(got[u] >= k for u in near[v]) >= k
    assert G.core_numbers(spark.createDataFrame([], "src long, dst long")).count() == 0


# --- hybrid matrices
def test_a_long_row_does_not_set_the_width(spark):
    entries = [(r, c, r + c) for r in range(40) for c in range(r % 4)] + [(41, c, 1) for c in range(500)]
    a = spark.createDataFrame(entries, "r long, c long, v long")
    x = spark.range(500).select(F.col("id").alias("i"), (F.col("id") + 1).alias("x"))
    padded, rest = S.hybrid(a, 43)
    want = Counter({r: 0 for r in range(43)})
    for r, c, v in entries:
        want[r] += v * (c + 1)
    assert {r.r: r.y for r in S.spmv_hybrid(padded, rest, x).collect()} == dict(want) == {r.r: r.y for r in S.spmv(a, x, 43).collect()}
    sizes, plain = S.hybrid_bytes(padded, rest).first(), S.format_sizes(a, 43).first()
    assert sizes.hybrid_bytes < plain.ell_bytes and S.hybrid_width(a, 43) == min(range(0, 5), key=lambda k: 43 * (8 * k + 4) + 12 * sum(max(0, n - k) for n in Counter(r for r, _, _ in entries).values()))
    empty = S.hybrid(a.limit(0), 3)
    assert sorted((r.r, r.y) for r in S.spmv_hybrid(*empty, x).collect()) == [(0, 0), (1, 0), (2, 0)]


# --- scans
@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_scans_of_hot_and_unique_keys(spark, buckets):
    rng = random.Random(buckets)
    rows = [(i, "hot" if i % 3 else rng.choice(["a", "b", None]), rng.choice([None, None, i]), rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, g string, v long, u double").repartition(5)
    key = lambda g: (g is not None, g or "")
    by_group = sorted(rows, key=lambda r: (key(r[1]), r[0]))
    assert {r.i: r["rank"] for r in W.ranks(df, [F.col("g")], "i", buckets=buckets).collect()} == {r[0]: k for k, r in enumerate(by_group)}
    assert {r.i: r["rank"] for r in W.ranks(df, [F.col("u")], "i", buckets=buckets).collect()} == {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[3], r[0])))}
    seen, want = Counter(), {}
    for r in by_group:
        want[r[0]] = seen[r[1]]
        seen[r[1]] += 1
    assert {r.i: r.place for r in W.places(df, ["g"], ["i"], buckets=buckets).collect()} == want
    state, whole, last, along = {}, {}, None, {}
    for r in sorted(rows):
        state[r[1]] = r[2] if r[2] is not None else state.get(r[1])
        last = r[2] if r[2] is not None else last
        whole[r[0]], along[r[0]] = state[r[1]], last
    got = W.carry_forward(W.carry_forward(df, ["i"], {"x": "v"}, ["g"], buckets), ["i"], {"y": F.col("v")}, buckets=buckets).collect()
    assert {r.i: r.x for r in got} == whole and {r.i: r.y for r in got} == along and len(got) == 300
    assert W.carry_forward(df.limit(0), ["i"], {"x": "v"}, ["g"]).count() == 0 and W.ranks(df.limit(0), [F.col("g")], "i").count() == 0


def test_one_group_lies_in_many_buckets(spark):
    df = spark.range(4000).withColumn("g", F.lit("one")).withColumn("v", F.when(F.col("id") % 1000 == 0, F.col("id")))
    marked = df.select(W.order_buckets(df, ["g", "id"], 10).alias("b")).groupBy("b").count().collect()
    assert len(marked) == 10 and max(r["count"] for r in marked) < 1000
    assert T.sticky(df, F.col("id") == 1234, "id").where("after").count() == 4000 - 1234


# --- files
FRAME = "ITEM: TIMESTEP\n{s}\nITEM: NUMBER OF ATOMS\n2\nITEM: BOX BOUNDS\n0 1\nITEM: ATOMS id x\n1 {a}\n2 {b}\n"


def test_frames_of_several_files_and_splits(spark, tmp_path):
    from quillon.sources import files

    for name, n in (("a", 300), ("b", 7)):
        (tmp_path / f"{name}.dump").write_text("".join(FRAME.format(s=10 * k, a=k, b=-k) for k in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        frames = files.dump_frames(spark, str(tmp_path / "*.dump"))
        assert spark.read.option("lineSep", "ITEM: TIMESTEP").text(str(tmp_path / "a.dump")).rdd.getNumPartitions() > 1
        got = sorted((r.file[-6:], r.frame, r.step) for r in frames.collect())
        assert got == sorted([("a.dump", k, 10 * k) for k in range(300)] + [("b.dump", k, 10 * k) for k in range(7)])
        last = sorted((r.file[-6:], r.frame, r.step, r.line, r.atom["x"]) for r in files.lammps_dump(spark, str(tmp_path / "*.dump")).collect())
        assert last == [("a.dump", 299, 2990, 0, "299"), ("a.dump", 299, 2990, 1, "-299"), ("b.dump", 6, 60, 0, "6"), ("b.dump", 6, 60, 1, "-6")]
        for name in "cd":
            (tmp_path / f"{name}.log").write_text("head\n" + "".join(f"{k} {name}{k}\n\n" for k in range(2000)) + f"MODE: {name}\n")
        rows = files.numeric_log(spark, str(tmp_path / "*.log"), ["n"]).where("n is not null").collect()
        assert sorted((r.file[-5:], r.line, r.n) for r in rows) == sorted((f"{x}.log", 2 * k + 1, float(k)) for x in "cd" for k in range(2000))
        assert sorted((r.file[-5:], r.value) for r in files.log_header(spark, str(tmp_path / "*.log"), "MODE").collect()) == [("c.log", "c"), ("d.log", "d")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_main_members_of_archives(spark, tmp_path):
    import io
    import tarfile

    import pandas as pd

    from quillon.sources import files

    def archive(name, members):
        with tarfile.open(tmp_path / name, "w:gz") as tar:
            for path, text in members:
                info = tarfile.TarInfo(path)
                info.size = len(text.encode())
                tar.addfile(info, io.BytesIO(text.encode()))

    doc = "\\begin{document}"
    archive("a.tar.gz", [("sub/large.tex", doc + "x" * 500), ("./main.tex", doc + "é"), ("other.tex", "y" * 900), ("main_ZH.tex", doc + "z" * 999), ("notes.txt", "n")])
    archive("b.tar.gz", [("s/one.tex", doc), ("s/two.tex", doc + "longer"), ("root.tex", "w" * 99)])
    archive("c.tar.gz", [("x.tex", "1"), ("d/y.tex", "22"), ("a.tex", "33")])
    members = files.archive_members(spark, str(tmp_path / "*.tar.gz"))
    assert members.count() == 10
    assert sorted((r.archive[-8:], r.member, r.size) for r in files.main_members(members).collect()) == [("a.tar.gz", "main.tex", 18), ("b.tar.gz", "s/two.tex", 22), ("c.tar.gz", "a.tex", 2)]
    # members come as they stream by: the first is there before the second is found to be cut off
    raw = (tmp_path / "a.tar.gz").read_bytes()
    import gzip

    plain = gzip.decompress(raw)
    stream = files.unpacked(iter([pd.DataFrame({"path": ["p"], "content": [plain[: 512 + 1024 + 512 + 5]]})]))
    assert next(stream)["member"][0] == "sub/large.tex"
    with pytest.raises(tarfile.TarError):
        list(stream)


def test_entries_of_a_saved_feed(spark):
    from quillon.sources import files

    xml = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>q</title>
    <entry><id>http://x/abs/1</id><title> A
 title </title><summary>S &amp; s</summary><published>2024-05-06T00:00:00Z</published><author><name>N One</name></author><author><name>N Two</name></author>
      <link href="http://x/abs/1" type="text/html"/><link title="pdf" href="http://x/pdf/1v2" type="application/pdf"/></entry>
    <entry><id>http://x/abs/2</id><author><name>Alone</name></author></entry><entry><title>bare</title></entry></feed>"""
    rows = files.feed_entries(spark.createDataFrame([(1, xml), (2, "<feed xmlns='http://www.w3.org/2005/Atom'></feed>"), (3, None)], "id int, xml string")).drop("xml").orderBy("entry").collect()
    assert [tuple(r) for r in rows] == [
        (1, 0, "A  title" if rows[0].title == "A  title" else "A title", "S & s", ["N One", "N Two"], "2024-05-06", "http://x/pdf/1v2"),
        (1, 1, "No Title", "No Summary", ["Alone"], "Unknown", "http://x/pdf/2.pdf"), (1, 2, "bare", "No Summary", [], "Unknown", ""),
    ]


# --- states and remembered results
def test_workers_share_tasks(spark, tmp_path):
    import datetime

    from quillon.plans import translation as P

    at = lambda h: datetime.datetime(2024, 1, 1, h)
    tasks = spark.createDataFrame([(f"t{i}",) for i in range(5)], "name string")
    one, two = P.Tasks(spark, str(tmp_path / "s")), P.Tasks(spark, str(tmp_path / "s"))
    names = lambda df: sorted(r.name for r in df.collect())
    assert names(one.claim(tasks, "one", at(1), 2)) == ["t0", "t1"] and names(two.claim(tasks, "two", at(1), 2)) == ["t2", "t3"]
    one.finish(spark.createDataFrame([("t0", "SUCCESS"), ("t1", "FAILED"), ("t2", "SUCCESS")], "name string, status string"), "one", at(2))
    assert {r.name: (r.status, r.worker, r.tries) for r in one.state().collect()} == {"t0": ("SUCCESS", "one", 1), "t1": ("FAILED", "one", 1), "t2": ("RUNNING", "two", 1), "t3": ("RUNNING", "two", 1)}
    assert names(one.claim(tasks, "one", at(3), 9, stale="5 hours")) == ["t1", "t4"]  # the failed one again, none of the other's
    assert names(one.claim(tasks, "one", at(7), 9, stale="5 hours")) == ["t2", "t3"]  # whose worker has died
    two.finish(spark.createDataFrame([("t2", "SUCCESS")], "name string, status string"), "two", at(8))  # too late
    assert {r.name: r.worker for r in one.state().where("status = 'RUNNING'").collect()} == {"t1": "one", "t2": "one", "t3": "one", "t4": "one"}
    one.finish(spark.createDataFrame([("t1", "FAILED"), ("t2", "SKIPPED"), ("t3", "SUCCESS"), ("t4", "SUCCESS")], "name string, status string"), "one", at(9))
    assert names(two.claim(tasks, "two", at(10), 9, tries=2)) == [] and names(two.claim(tasks, "two", at(11), 9, tries=3)) == ["t1"]


def test_a_writer_that_loses_tries_again(spark, tmp_path):
    import datetime

    from quillon.plans import translation as P

    tasks = spark.createDataFrame([("a",), ("b",)], "name string")
    one, other = P.Tasks(spark, str(tmp_path / "s")), P.Tasks(spark, str(tmp_path / "s"))
    meddle = [lambda: other.claim(tasks, "other", datetime.datetime(2024, 1, 1), 1)]
    whole = one._change
    state = one.state
    one.state = lambda number=None: (state(number), meddle and meddle.pop()())[0]  # another worker claims after this one has read
    got = one.claim(tasks, "one", datetime.datetime(2024, 1, 1), 2)
    assert whole and sorted(r.name for r in got.collect()) == ["b"]


def test_results_are_remembered_until_inputs_change(spark, tmp_path):
    from quillon.sources import memo

    data, base = str(tmp_path / "d"), str(tmp_path / "memo")
    spark.range(10).write.parquet(data)
    ask = lambda k=5: spark.read.parquet(data).where(F.col("id") < k).groupBy((F.col("id") % 2).alias("odd")).count()
    key = memo.fingerprint(ask())
    assert key == memo.fingerprint(ask()) != memo.fingerprint(ask(6))
    first = memo.remembered(ask(), base)
    assert sorted(map(tuple, first.collect())) == [(0, 3), (1, 2)] and base in first.inputFiles()[0]
    assert memo.remembered(ask(), base).inputFiles() == first.inputFiles()
    spark.range(3).write.mode("append").parquet(data)
    assert sorted(map(tuple, memo.remembered(ask(), base).collect())) == [(0, 5), (1, 3)]
    memo.remembered(ask(7), base, keep=1)
    assert len([x for x in (tmp_path / "memo").iterdir() if not x.name.startswith(".")]) == 1
    local = spark.createDataFrame([(1,)], "a int")
    assert memo.fingerprint(local) is None and memo.remembered(local, base) is local and memo.remembered(local, base, "v1").inputFiles()
    assert memo.fingerprint(ask().withColumn("r", F.rand())) is None and memo.fingerprint(ask().withColumn("u", F.udf(str)("odd"))) is None


# --- pairs and documents
@pytest.mark.parametrize("leaf", [1, 50, 10**9])
def test_distance_counts_equal_all_pairs(spark, leaf):
    from quillon.operators import neighbours as J

    rng = random.Random(leaf)
    points = [(i, rng.uniform(-7, 17), rng.gauss(5, 0.4), rng.choice([0.0, 5.0, 9.999])) for i in range(120)] + [(200 + i, 1.0, 1.0, 1.0) for i in range(40)] + [(300, 6.0, 1.0, 1.0)]
    box, bins, width = 10.0, 10, 0.5
    want = Counter()
    for i, p in enumerate(points):
        for q in points[:i]:
            d = [a - b - box * round((a - b) / box) for a, b in zip(p[1:], q[1:])]
            want[int(math.sqrt(sum(x * x for x in d)) / width)] += 1
    df = spark.createDataFrame(points, "id long, x double, y double, z double")
    got = {r.bin: r.n for r in J.distance_counts(df, box, bins, width, leaf).collect()}
    assert {k: n for k, n in got.items() if n} == {k: n for k, n in want.items() if k < bins}
    a, b = ({r.bin: round(r.g, 9) for r in J.radial_distribution(df, box, bins, few).collect()} for few in (0, 10**6))
    assert a == b and len(a) == bins


MARKDOWN = """# Title
Text with $a_b$ and 50% of `x_y` in **bold & more**

- one
  - inner
    1. deep

    2. deeper
  goes on
- two
1. first
| a | b |
|---|:-:|
| c_d | $x|y$ |
after
![alt](<p.png>)
* last
    indented more
## Sub"""


def test_markdown_documents(spark):
    from quillon.operators import markdown as K

    docs = {"a": MARKDOWN, "b": "- open\n| t |", "c": "", "d": "plain ~^\\"}
    lines = [(k, i, t) for k, text in docs.items() for i, t in enumerate(text.split("\n"))] + [("e", 0, None)]
    got = defaultdict(list)
    for r in K.documents_to_latex(spark.createDataFrame(lines, "doc string, no int, text string").repartition(3), "doc", "no").orderBy("key", "no").collect():
        got[r.key].append(r.latex)
    assert got["a"] == [
        "\\subsection{Title}", "Text with $a_b$ and 50\\% of \\texttt{x\\_y} in \\textbf{bold \\& more}", "", "\\begin{itemize}", "\\item one", "\\begin{itemize}", "\\item inner",
        "\\begin{enumerate}", "\\item deep", "", "\\item deeper", "\\end{enumerate}", "\\end{itemize}", "\\end{itemize}", "  goes on", "\\begin{itemize}", "\\item two", "\\end{itemize}", "\\begin{enumerate}", "\\item first",
        "\\begin{longtable}{l|l}\\hline", "a & b \\\\ \\hline", "c\\_d & \\$x & y\\$ \\\\ \\hline", "\\end{enumerate}", "\\end{longtable}", "after",
        "\\begin{figure}[h]\\centering\\includegraphics[width=0.8\\textwidth]{p.png}\\caption{alt}\\end{figure}", "\\begin{itemize}", "\\item last", "indented more", "\\end{itemize}", "\\subsubsection{Sub}",
    ]
    assert got["b"] == ["\\begin{itemize}", "\\item open", "\\begin{longtable}{l}\\hline", "t \\\\ \\hline", "\\end{itemize}", "\\end{longtable}"]
    assert got["c"] == [""] and got["d"] == ["plain \\textasciitilde{}\\textasciicircum{}\\textbackslash{}"] and got["e"] == [""]
    for out in got.values():
        assert sum(x.startswith("\\begin{") and "figure" not in x for x in out) == sum(x.startswith("\\end{") for x in out)
    assert K.documents_to_latex(spark.createDataFrame([], "doc string, no int, text string"), "doc", "no").count() == 0


def test_layouts_environment_and_heads(spark, tmp_path):
    from quillon.sources import files, sinks

    p = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 2.0, True), (0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, False)], "x double, y double, z double, px double, py double, pz double, E double, alive boolean")
    sinks.write_particles(p, str(tmp_path / "p"))
    got = files.csv_rows(spark, str(tmp_path / "p"))
    assert got.columns == sinks.PARTICLES and [(r.x, r.vx, r.E, r.pol_x) for r in got.collect()] == [("1.0", "2.0", "2.0", None)]
    places, momenta = files.state(spark, str(tmp_path / "p"))
    assert tuple(places.first()) == (1.0, 2.0, 3.0) and tuple(momenta.first()) == (4.0, 5.0, 6.0)
    sinks.write_grid(spark.range(27).select(F.col("id").alias("cell_idx"), F.lit(0.5).alias("n")), str(tmp_path / "g"), 3)
    cells = files.csv_rows(spark, str(tmp_path / "g"))
    assert cells.columns == sinks.GRID and {(r.cell_idx, r.ix, r.iy, r.iz) for r in cells.collect()} == {(str(i), str(i % 3), str(i // 3 % 3), str(i // 9)) for i in range(27)}
    (tmp_path / "env").write_text("# c\nA = 'x y' \nB=\"1=2\"\nnothing\n A=z\n")
    assert {r.key: r.value for r in files.environment(spark, str(tmp_path / "env")).collect()} == {"A": "z", "B": "1=2"}
    heads = files.first_pages(spark.createDataFrame([("é" * 7000,), (None,)], "text string"))
    assert sorted(len(r["head"]) for r in heads.collect()) == [0, 6000]
    assert files.first_pages(spark.createDataFrame([(bytearray(b"raw"),)], "content binary"), extract=F.upper(F.col("content").cast("string"))).first()["head"] == "RAW"


def test_old_preambles_are_made_new(spark):
    old = r"""\documentstyle[prl,aps]{revtex}
\usepackage[final]{pdfcprot}
\twocolumn[\hsize\textwidth\columnwidth\hsize\csname @twocolumnfalse\endcsname
\pacs{12.38} ]
\pdfximage { fig.pdf } \def\pages{\the\pdflastximagepages}
  ]
\section{A}"""
    new = r"""\documentclass[prl,aps,twocolumn]{revtex4-2}
\usepackage{graphicx}
\providecommand{\draft}{}
\providecommand{\address}[1]{\affiliation{#1}}
\newdimen\epsfxsize
\providecommand{\epsffile}[2][]{\includegraphics[width=\epsfxsize]{#2}}

% % \usepackage{pdfcprot}

\pacs{12.38}
\newcount\pagescount
\ifx\XeTeXpdfpagecount\undefined
  \pdfximage{fig.pdf}
  \pagescount=\pdflastximagepages
\else
  \pagescount=\XeTeXpdfpagecount"fig.pdf"
\fi
\edef\pages{\the\pagescount}

\section{A}"""
    rows = [(0, old), (1, "\\documentstyle{revtex}x"), (2, "\\pacs{1} ] stays"), (3, "\\usepackage{pdfcprot}"), (4, None)]
    got = {r.i: r.t for r in spark.createDataFrame(rows, "i int, t string").select("i", T.modern_preamble(F.col("t")).alias("t")).collect()}
    assert got[0] == new
    assert got[1].startswith("\\documentclass[twocolumn]{revtex4-2}\n\\usepackage{graphicx}\n") and got[1].endswith("\nx")
    assert got[2] == rows[2][1] and got[3] == "% \\usepackage{pdfcprot}" and got[4] is None
    names = spark.createDataFrame([(r"\input{a/b.tex} \include{c} \subfile{ d } \input{e_ZH} \input{f_ZH.tex}",)], "t string")
    assert names.select(T.rewrite_inputs(F.col("t"))).first()[0] == r"\input{a/b_ZH} \include{c_ZH} \subfile{d_ZH} \input{e_ZH} \input{f_ZH.tex}"


def test_reports_are_written_whole_and_in_order(spark, tmp_path):
    from quillon.sources import sinks

    df = spark.range(3000).select(F.col("id").alias("k"), F.concat(F.lit("a|"), "id").alias("v"), F.lit(None).cast("string").alias("n")).repartition(7)
    sinks.write_report(sinks.report_lines("R", {"one": (df, "k"), "two": (df.limit(0), "k")}), str(tmp_path / "r"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    assert text.split("\n")[:8] == ["# R", "", "## one", "", "| k | v | n |", "| --- | --- | --- |", "| 0 | a\\|0 |  |", "| 1 | a\\|1 |  |"]
    assert text.endswith("| 2999 | a\\|2999 |  |\n## two\n\n| k | v | n |\n| --- | --- | --- |\n") and text.count("\n") == 6 + 3000 + 4


def test_triangles_shuffle_lists_not_wedges(spark):
    """A wedge isn't a row: with all edges from the left to the right side and none within, no join has more rows than there are edges."""
    edges = spark.range(40 * 30).select((F.col("id") % 40).alias("src"), (100 + F.floor(F.col("id") / 40)).alias("dst"))
    closed = edges.unionByName(spark.createDataFrame([(0, 1)], "src long, dst long"))
    assert G.triangles(edges).count() == 0
    got = {r.v: r.n for r in G.triangles(closed, 7).collect()}
    assert got == {0: 30, 1: 30} | {100 + i: 1 for i in range(30)}
    plan = G.triangles(closed)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" in plan and "explode(sequence" not in plan.lower()


@pytest.mark.parametrize("most", [1, 700])
def test_triangles_in_rounds_equal_brute_force(spark, monkeypatch, most):
    edges, near = random_edges(most)
    want = {v: sum(1 for a in near[v] for b in near[v] if a < b and b in near[a]) for v in near}
    rounds, closed = [], G._closed
    monkeypatch.setattr(G, "_closed", lambda *a: rounds.append(a) or closed(*a))
    found = G.triangles(spark.createDataFrame(edges, "src long, dst long"), 2, most).collect()
    assert len(rounds) > 1 and len(found) == len({r.v for r in found})
    assert {r.v: r.n for r in found} == {v: n for v, n in want.items() if n}
    assert G.triangles(spark.createDataFrame([(1, 1), (None, 2)], "src long, dst long"), most=most).count() == 0


def test_triangles_hold_a_part_of_what_they_send(spark):
    """All pairs of 200 vertices: 19,900 edges send 1.3 million numbers, in one round or in five of which one at a time is on disk."""
    pair = lambda x: F.xxhash64(F.floor(x).cast("long"))
    edges = spark.range(200 * 200).select(pair(F.col("id") % 200).alias("src"), pair(F.col("id") / 200).alias("dst"))
    dirs = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    used = lambda: sum(f.stat().st_size for d in dirs for f in Path(d).rglob("shuffle_*.data"))

    def peak(most):
        spark._jvm.System.gc()
        time.sleep(1)
        before, seen, done = used(), [0], threading.Event()

        def watch():
            while not done.wait(0.05):
                with contextlib.suppress(FileNotFoundError):
                    seen.append(used() - before)

        thread = threading.Thread(target=watch)
        thread.start()
        try:
            found = G.triangles(edges, most=most).collect()
        finally:
            done.set()
            thread.join()
        assert len(found) == 200 and {r.n for r in found} == {199 * 198 // 2}
        return max(seen)

    assert 0 < peak(300_000) < 0.6 * peak(10**9)


@pytest.mark.parametrize("per", [3, 20, 1000])
def test_pairs_of_blocks_equal_brute_force(spark, per):
    from quillon.operators import neighbours as J

    rng = random.Random(per)
    whole = [(i, *(rng.randrange(-150, 150) for _ in range(3))) for i in range(90)] + [(100 + i, 7, 7, 7) for i in range(30)] + [(200, None, 1, 1)]
    gap = lambda a, b: sum((u - v - 100 * round((u - v) / 100)) ** 2 for u, v in zip(a[1:], b[1:]))
    want = {(a[0], b[0]): gap(a, b) for a in whole[:-1] for b in whole[:-1] if a[0] < b[0] and gap(a, b) < 900}
    ints = spark.createDataFrame(whole, "id long, x long, y long, z long")
    floats = ints.select("id", *(F.col(c).cast("double").alias(c) for c in "xyz")).unionByName(spark.createDataFrame([(201, float("nan"), 1.0, 1.0), (202, 1.0, float("inf"), 1.0)], "id long, x double, y double, z double"))
    for df in (ints, floats):
        found = J.near_pairs(df, 30.0, 100.0, per).collect()
        assert len(found) == len(want) and {(r.a, r.b): r.r2 for r in found} == want
    assert {r.r2: r.n for r in J.squared_distance_counts(ints, 30.0, 100.0, per).collect()} == Counter(want.values())
    both = [{r.bin: r.n for r in J.distance_counts(df, 100.0, bins, 30.0 / bins, per).collect()} for df in (ints, floats) for bins in (6, 40)]
    assert both[0] == both[2] == Counter(int(math.sqrt(v) / 5) for v in want.values()) and both[1] == both[3] and sum(both[1].values()) == len(want)


def test_pairs_are_no_rows_of_a_join(spark, data):
    """Counts over pairs come from arrays in tasks: as many rows as blocks and distances, not as pairs."""
    from quillon import registry
    from quillon.operators import neighbours as J

    df = spark.range(4000).select("id", *(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(100)).alias(c) for c in "xyz"))
    counted = J.squared_distance_counts(df, 50.0, 100.0)
    assert counted.agg(F.sum("n")).first()[0] > 10**6 and "MapInPandas" in counted._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in registry.queries()["pair_sums"](spark, data)._jdf.queryExecution().optimizedPlan().toString()


def test_several_orders_are_cut_from_the_table_itself(spark, monkeypatch):
    """The sample and counts of a later order don't number the rows by the earlier ones again."""
    rows = [(i, i * 7 % 13, i * 5 % 11) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, a long, b long")
    from quillon.plans import vectors

    seen, cut = [], W.order_buckets
    monkeypatch.setattr(W, "order_buckets", lambda d, *more: seen.append(d._jdf.queryExecution().optimizedPlan().toString()) or cut(d, *more))
    orders = {"x": [F.col("a")], "y": [-F.col("b")], "z": [F.col("b"), F.col("a")]}
    got = W.several_ranks(df, orders, "i", 5).collect()
    for name, key in (("x", lambda r: r[1]), ("y", lambda r: -r[2]), ("z", lambda r: (r[2], r[1]))):
        want = {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (key(r), r[0])))}
        assert {r.i: r[name] for r in got} == want
    vectors.three_sort_modes(spark, "/root/testdata/sf0.001")
    assert len(seen) == 6 and not any("Window" in p for p in seen)


def test_matmul_blocks_deals_few_blocks_to_a_task(spark, monkeypatch):
    """What Python holds of a product is a bounded number of blocks, as arrays of numbers; repeated entries add up."""
    monkeypatch.setattr(S, "BLOCKS_A_TASK", 3)
    rng = random.Random(8)
    entries = [(rng.randrange(12), rng.randrange(12), rng.randrange(-3, 9)) for _ in range(150)]
    a = spark.createDataFrame(entries, "r long, c long, v long")
    want = {(r.r, r.c): float(r.v) for r in S.matmul(a, a).collect()}
    out = S.matmul_blocks(a, a, 2)
    assert {(r.r, r.c): r.v for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    tasks = int(re.search(r"Repartition (\d+)", plan)[1])
    assert tasks >= 6 ** 3 // 3 - 3 and "collect_list(struct(i" not in plan


def test_hybrid_reads_its_matrix_once(spark, data):
    """Both parts come from the written entries, not from the table again."""
    a = spark.read.parquet(f"{data}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("r"), F.col("l_partkey").alias("c")).agg(F.sum("l_quantity").cast("long").alias("v"))
    for part in S.hybrid(a, 20):
        assert "parquet" not in part._jdf.queryExecution().optimizedPlan().toString().lower()


def test_words_are_counted_within_the_row(spark):
    rows = [(1, ["b", "a", "b", "", "b"]), (2, []), (3, ["x"]), (4, ["é", "z", "é"])]
    df = spark.createDataFrame(rows, "i long, w array<string>").select("i", I.counted("w").alias("t"))
    assert {r.i: {t.term: t.tf for t in r.t} for r in df.collect()} == {i: dict(Counter(w)) for i, w in rows}
    assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_rounds_of_cores_send_what_they_lowered(spark):
    """A path in a graph whose other bounds stay: later rounds shuffle its few changes and a row or so a vertex, not the edges."""
    ring = [(i, (i + j) % 2000) for i in range(2000) for j in range(1, 31)]
    path = [(5000 + i, 5001 + i) for i in range(60)]
    edges = spark.createDataFrame(ring + path, "src long, dst long").repartition(4)
    context = spark.sparkContext._jsc.sc()

    def shuffled(rounds):
        def total():
            context.listenerBus().waitUntilEmpty()
            return context.statusStore().executorList(False).apply(0).totalShuffleWrite()

        start = total()
        got = {r.v: r.core for r in G.core_numbers(edges, rounds).collect()}
        assert {got[i] for i in range(2000)} == {60} and [got[5000 + i] for i in range(rounds + 1)] == [1] * (rounds + 1) and got[5030] == 2
        return total() - start

    assert (shuffled(9) - shuffled(4)) / 5 < 5 * len(ring)  # bytes a round; 27 an edge when each round sent all bounds


def test_core_numbers_of_hubs_and_short_lists(spark):
    edges, near = random_edges(5, 200, 900)
    edges += [(1000, b) for b in range(150)]  # a hub, in many rows
    for _, b in edges[-150:]:
        near[1000].add(b)
        near[b].add(1000)
    for size in (1, 7, 10_000):
        assert {r.v: r.core for r in G.core_numbers(spark.createDataFrame(edges, "src long, dst long"), size=size).collect()} == peeled(near)
