"""Queries over vectors, matrices and grids made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import elementwise as M
from ..operators import filters as L
from ..operators import grid as N
from ..operators import relations as R
from ..operators import scans as W
from ..operators import sparse as P
from ..registry import register
from ..sources.tables import table

#: events as a vector of whole cents, in DuckDB.
V = "(SELECT event_id AS idx, CAST(round(value * 100) AS BIGINT) AS v, event_type, user_id FROM events)"
LONG = "CAST({} AS BIGINT)"


def vec(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("idx"), F.round(F.col("value") * 100).cast("long").alias("v"), "event_type", "user_id")


@register("map_add", f"SELECT a.idx, a.v + b.p_size AS v FROM {V} a JOIN part b ON a.idx = b.p_partkey")
def map_add(spark, d):
    return M.vector_add(vec(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_size").alias("v")))


@register("filter_even", f"SELECT idx, v FROM {V} WHERE v % 2 = 0")
def filter_even(spark, d):
    return L.compact(vec(spark, d).select("idx", "v"))


@register("filter_close", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE abs(l_discount - 0.05) <= 1e-8 + 1e-5 * 0.05 AND l_returnflag = 'R'")
def filter_close(spark, d):
    rows = table(spark, d, "lineitem").where(L.close(F.col("l_discount"), 0.05) & (F.col("l_returnflag") == "R"))
    return rows.select("l_orderkey", "l_linenumber", "l_quantity")


@register("filter_finite", "SELECT count(*) AS n FROM (SELECT TRY_CAST(replace(props, '{\"k\": ', '') AS DOUBLE) AS x, value FROM events) WHERE isfinite(value)")
def filter_finite(spark, d):
    return table(spark, d, "events").where(L.finite("value")).agg(F.count("*").alias("n"))


@register("filter_prefix_sorted", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'small')")
def filter_prefix_sorted(spark, d):
    return table(spark, d, "part").where(F.startswith("p_name", F.lit("small"))).select("p_partkey", "p_name").orderBy("p_name", "p_partkey")


@register(
    "filter_below_p99",
    f"SELECT idx, v FROM {V} WHERE v < (SELECT quantile_cont(v, 0.99) FROM {V})",
)
def filter_below_p99(spark, d):
    return L.below_percentile(vec(spark, d).select("idx", "v"), "v", 0.99)


@register(
    "named_groups",
    f"""SELECT g AS "group", count(*) AS n FROM (
        SELECT 'even' AS g FROM {V} WHERE v % 2 = 0 UNION ALL SELECT 'large' FROM {V} WHERE v > 2000 UNION ALL
        SELECT 'click' FROM {V} WHERE event_type = 'click') GROUP BY g""",
)
def named_groups(spark, d):
    groups = {"even": F.col("v") % 2 == 0, "large": F.col("v") > 2000, "click": F.col("event_type") == "click"}
    return L.groups_by_predicate(vec(spark, d), groups).groupBy("group").agg(F.count("*").alias("n"))


@register("first_match", f"SELECT v FROM {V} WHERE event_type = 'purchase' ORDER BY idx LIMIT 1")
def first_match(spark, d):
    return L.first_where(vec(spark, d), F.col("event_type") == "purchase", "idx", "v")


@register("reduce_sum", f"SELECT CAST(sum(v) AS BIGINT) AS total FROM {V}")
def reduce_sum(spark, d):
    return vec(spark, d).agg(F.sum("v").alias("total"))


@register(
    "hist_bins",
    f"""SELECT b AS bin, {LONG.format("count(v)")} AS n FROM generate_series(0, 255) AS g(b)
        LEFT JOIN (SELECT CAST(l_quantity AS BIGINT) AS v FROM lineitem) ON v = b GROUP BY b""",
)
def hist_bins(spark, d):
    return A.histogram(table(spark, d, "lineitem").select(F.col("l_quantity").alias("v")), 256)


@register(
    "hist_density",
    f"""WITH h AS (SELECT CASE WHEN v = 100 THEN 19 ELSE CAST(floor(v / 5.0) AS BIGINT) END AS bin, count(*) AS n
                   FROM (SELECT value AS v FROM events) WHERE v >= 0 AND v <= 100 GROUP BY 1)
        SELECT CAST(b AS BIGINT) AS bin, {LONG.format("coalesce(n, 0)")} AS n, round(coalesce(n, 0) / (sum(coalesce(n, 0)) OVER () * 5.0), 9) AS density
        FROM generate_series(0, 19) g(b) LEFT JOIN h ON h.bin = b""",
)
def hist_density(spark, d):
    return A.density_histogram(table(spark, d, "events").select(F.col("value").alias("v")), 0.0, 100.0, 20).withColumn("density", F.round("density", 9))


@register("scan_inclusive", f"SELECT idx, v, CAST(sum(v) OVER (ORDER BY idx) AS BIGINT) AS scan FROM {V}")
def scan_inclusive(spark, d):
    return W.prefix_sum(vec(spark, d).select("idx", "v"))


@register(
    "scan_exclusive",
    f"SELECT idx, v, CAST(coalesce(sum(v) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS scan FROM {V}",
)
def scan_exclusive(spark, d):
    return W.prefix_sum(vec(spark, d).select("idx", "v"), exclusive=True)


MERGED = f"""(SELECT v, side, idx, row_number() OVER (ORDER BY v, side, idx) - 1 AS pos FROM (
    SELECT v, 0 AS side, idx FROM {V} WHERE idx % 2 = 0 UNION ALL SELECT v, 1 AS side, idx FROM {V} WHERE idx % 2 = 1))"""


@register("merge_runs", f"SELECT v, CAST(side AS INTEGER) AS side, idx, CAST(pos AS BIGINT) AS pos FROM {MERGED}")
def merge_runs(spark, d):
    x = vec(spark, d).select("idx", "v")
    return R.merge_sorted(x.where("idx % 2 = 0"), x.where("idx % 2 = 1"))


@register("merge_co_rank", f"SELECT CAST(count(*) AS BIGINT) AS from_a FROM {MERGED} WHERE pos < 1000 AND side = 0")
def merge_co_rank(spark, d):
    return R.co_rank(merge_runs(spark, d), 1000)


@register("topk_argmax", f"SELECT event_type, arg_max(idx, v * 1000000000 - idx) AS at_max, arg_min(idx, v * 1000000000 + idx) AS at_min FROM {V} GROUP BY event_type")
def topk_argmax(spark, d):
    return vec(spark, d).groupBy("event_type").agg(R.arg_max("v", "idx").alias("at_max"), R.arg_min("v", "idx").alias("at_min"))


@register("batch_limit", f"SELECT idx, v FROM {V} ORDER BY v DESC, idx LIMIT 5")
def batch_limit(spark, d):
    return vec(spark, d).select("idx", "v").orderBy(F.desc("v"), "idx").limit(5)


@register(
    "key_bounds",
    f"""SELECT CAST(k AS BIGINT) AS key, {LONG.format("(SELECT count(*) FROM lineitem WHERE l_quantity < k)")} AS "first",
        {LONG.format("(SELECT count(*) FROM lineitem WHERE l_quantity <= k)")} AS "last" FROM generate_series(0, 59) g(k)""",
)
def key_bounds(spark, d):
    return R.bounds_of_keys(table(spark, d, "lineitem"), "l_quantity", [], 60)


@register("sort_by_key", f"SELECT event_type, idx, v FROM {V}")
def sort_by_key(spark, d):
    return R.sort_by_key(vec(spark, d).select("event_type", "idx", "v"), "event_type", "idx")


COO = "(SELECT l_suppkey AS r, l_partkey AS c, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2)"


def coo(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("r"), F.col("l_partkey").alias("c")).agg(F.sum("l_quantity").cast("long").alias("v"))


def price(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.round(F.col("p_retailprice") * 100).cast("long").alias("x"))


def suppliers(spark, d) -> int:
    return table(spark, d, "supplier").agg(F.max("s_suppkey")).first()[0] + 1


SPMV = f"""SELECT s_suppkey AS r, CAST(coalesce(sum(v * CAST(round(p_retailprice * 100) AS BIGINT)), 0) AS BIGINT) AS y
           FROM supplier LEFT JOIN {COO} a ON a.r = s_suppkey LEFT JOIN part ON p_partkey = a.c GROUP BY 1"""


@register("spmv_coo", SPMV)
def spmv_coo(spark, d):
    return P.spmv(coo(spark, d), price(spark, d), suppliers(spark, d))


@register("spmv_csr", SPMV)
def spmv_csr(spark, d):
    return P.spmv_csr(P.coo_to_csr(coo(spark, d), suppliers(spark, d)), price(spark, d))


@register("spmv_ell", SPMV)
def spmv_ell(spark, d):
    return P.spmv_ell(P.csr_to_ell(P.coo_to_csr(coo(spark, d), suppliers(spark, d))), price(spark, d))


@register("spmv_jds", SPMV)
def spmv_jds(spark, d):
    ell = P.csr_to_ell(P.coo_to_csr(coo(spark, d), suppliers(spark, d)))
    return P.spmv_jds(P.jds_diagonals(ell), P.ell_to_jds(ell).select("place", "r"), price(spark, d))


@register(
    "coo_to_csr_ptrs",
    f"""SELECT r, CAST(nnz AS BIGINT) AS nnz, CAST(coalesce(sum(nnz) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
        FROM (SELECT s_suppkey AS r, count(c) AS nnz FROM supplier LEFT JOIN {COO} a ON a.r = s_suppkey GROUP BY 1)""",
)
def coo_to_csr_ptrs(spark, d):
    return P.coo_to_csr(coo(spark, d), suppliers(spark, d)).select("r", "nnz", "start")


@register("csr_to_ell", f"""WITH n AS (SELECT s_suppkey AS r, count(c) AS nnz FROM supplier LEFT JOIN {COO} a ON a.r = s_suppkey GROUP BY 1)
        SELECT r, CAST(nnz AS BIGINT) AS nnz, CAST((SELECT max(nnz) FROM n) AS INTEGER) AS width FROM n""")
def csr_to_ell(spark, d):
    return P.csr_to_ell(P.coo_to_csr(coo(spark, d), suppliers(spark, d))).select("r", "nnz", F.size("entries").alias("width"))


@register(
    "jds_order",
    f"""SELECT CAST(row_number() OVER (ORDER BY nnz DESC, r) - 1 AS BIGINT) AS place, r, CAST(nnz AS BIGINT) AS nnz
        FROM (SELECT s_suppkey AS r, count(c) AS nnz FROM supplier LEFT JOIN {COO} a ON a.r = s_suppkey GROUP BY 1)""",
)
def jds_order(spark, d):
    return P.ell_to_jds(P.csr_to_ell(P.coo_to_csr(coo(spark, d), suppliers(spark, d))))


@register("format_sizes", f"""SELECT CAST(sum(n) * 12 AS BIGINT) AS coo_bytes, CAST(sum(n) * 8 + (s + 1) * 4 AS BIGINT) AS csr_bytes, CAST(max(n) * s * 8 + s * 4 AS BIGINT) AS ell_bytes
        FROM (SELECT r, count(*) AS n FROM {COO} GROUP BY r), (SELECT max(s_suppkey) + 1 AS s FROM supplier) GROUP BY s""")
def format_sizes(spark, d):
    return P.format_sizes(coo(spark, d), suppliers(spark, d))


DENSE = """(SELECT vec_id AS r, CAST(i - 1 AS BIGINT) AS c, CAST(floor(embedding[i] * 256) AS BIGINT) AS v
            FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))"""


def dense(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("r"), F.posexplode("embedding").alias("c", "x"))
    return e.select("r", F.col("c").cast("long").alias("c"), F.floor(F.col("x").cast("double") * 256).alias("v"))


GRAM = f"SELECT a.c AS r, b.c AS c, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM {DENSE} a JOIN {DENSE} b ON a.r = b.r GROUP BY 1, 2".replace("embedding[i] * 256", "CAST(embedding[i] AS DOUBLE) * 256")


@register("matmul_gram", GRAM)
def matmul_gram(spark, d):
    m = dense(spark, d)
    return P.matmul(m.select(F.col("c").alias("r"), F.col("r").alias("c"), "v"), m)


@register("matmul_blocks", GRAM)
def matmul_blocks(spark, d):
    m = dense(spark, d)
    return P.matmul_blocks(m.select(F.col("c").alias("r"), F.col("r").alias("c"), "v"), m).withColumn("v", F.col("v").cast("long"))


MASK = [[1, 2, 3, 2, 1], [2, 4, 6, 4, 2], [3, 6, 9, 6, 3], [2, 4, 6, 4, 2], [1, 2, 3, 2, 1]]
IMG = """(SELECT CAST(day(ts) - 1 AS BIGINT) AS r, CAST(hour(ts) AS BIGINT) AS c, count(*) AS v FROM events GROUP BY 1, 2)"""


def image(spark, d):
    e = table(spark, d, "events")
    return e.groupBy((F.day("ts") - 1).cast("long").alias("r"), F.hour("ts").cast("long").alias("c")).agg(F.count("*").alias("v"))


@register(
    "conv2d_5x5",
    f"""SELECT i.r - m.dr AS r, i.c - m.dc AS c, CAST(sum(i.v * m.w) AS DOUBLE) AS v FROM {IMG} i,
        (VALUES {", ".join(f"({a - 2}, {b - 2}, {w})" for a, row in enumerate(MASK) for b, w in enumerate(row))}) m(dr, dc, w)
        WHERE i.r - m.dr BETWEEN 0 AND 29 AND i.c - m.dc BETWEEN 0 AND 23 GROUP BY 1, 2""",
)
def conv2d_5x5(spark, d):
    return N.convolve2d(image(spark, d), MASK, 30, 24)


G = 5
CUBE = f"""(SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(k AS BIGINT) AS k, coalesce(n, 0) AS v
            FROM (SELECT * FROM generate_series(0, {G - 1}) a(i), generate_series(0, {G - 1}) b(j), generate_series(0, {G - 1}) c(k))
            LEFT JOIN (SELECT day(ts) % {G} AS i, hour(ts) % {G} AS j, user_id % {G} AS k, count(*) AS n FROM events GROUP BY 1, 2, 3) USING (i, j, k))"""


def cube(spark, d):
    e = table(spark, d, "events")
    n = e.groupBy((F.day("ts") % G).cast("long").alias("i"), (F.hour("ts") % G).cast("long").alias("j"), (F.col("user_id") % G).alias("k")).agg(F.count("*").alias("v"))
    a = spark.range(G)
    every = a.select(F.col("id").alias("i")).crossJoin(a.select(F.col("id").alias("j"))).crossJoin(a.select(F.col("id").alias("k")))  # the grid
    return every.join(n, ["i", "j", "k"], "left").select("i", "j", "k", F.coalesce("v", F.lit(0)).alias("v"))


def _around(v: str = "v") -> str:
    return " + ".join(f"(SELECT {v} FROM g h WHERE h.i = g.i + {x} AND h.j = g.j + {y} AND h.k = g.k + {z})" for x, y, z in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)))


def _near(v: str, axis: str, step: int, cte: str = "g") -> str:
    on = " AND ".join(f"h.{a} = {f'((g.{a} + {step}) % {G} + {G}) % {G}' if a == axis else f'g.{a}'}" for a in "ijk")
    return f"(SELECT h.{v} FROM {cte} h WHERE {on})"


@register("stencil3d", f"WITH g AS {CUBE} SELECT i, j, k, CAST(v + 0.125 * ({_around()}) AS DOUBLE) AS v FROM g WHERE i BETWEEN 1 AND {G - 2} AND j BETWEEN 1 AND {G - 2} AND k BETWEEN 1 AND {G - 2}")
def stencil3d(spark, d):
    return N.stencil3d(cube(spark, d), G)


SIX = " + ".join(_near("v", a, s) for a in "ijk" for s in (1, -1))


@register("smooth_periodic", f"WITH g AS {CUBE} SELECT i, j, k, round(CAST(0.4 * v + 0.1 * ({SIX}) AS DOUBLE), 6) AS v FROM g")
def smooth_periodic(spark, d):
    return N.smooth3d(cube(spark, d), G, rounds=1).withColumn("v", F.round("v", 6))


def _central(v: str, a: str) -> str:
    return f"(({_near(v, a, 1)} - {_near(v, a, -1)}) / 2.0)"


@register(
    "gradient_laplacian",
    f"""WITH g AS {CUBE} SELECT i, j, k, CAST({_central("v", "i")} AS DOUBLE) AS gx, CAST({_central("v", "j")} AS DOUBLE) AS gy,
        CAST({_central("v", "k")} AS DOUBLE) AS gz, CAST({SIX} - 6 * v AS DOUBLE) AS lap FROM g""",
)
def gradient_laplacian(spark, d):
    out = N.gradient_laplacian(cube(spark, d), G, 1.0)
    return out.select("i", "j", "k", *(F.col(c).cast("double").alias(c) for c in ("gx", "gy", "gz", "lap")))


FLOW = f"(SELECT i, j, k, v AS lap, v * (i + 1) AS ux, v * (j + 2) AS uy, v * (k + 3) AS uz FROM {CUBE})"


def _second() -> str:
    dd = {(u, x): _central(f"u{u}", a) for u in "xyz" for a, x in zip("ijk", "xyz")}
    parts = {f"gl{x}": _central("lap", a) for a, x in zip("ijk", "xyz")}
    parts |= {"wx": f"{dd['z', 'y']} - {dd['y', 'z']}", "wy": f"{dd['x', 'z']} - {dd['z', 'x']}", "wz": f"{dd['y', 'x']} - {dd['x', 'y']}"}
    parts |= {f"s{u}{x}": f"0.5 * ({dd[u, x]} + {dd[x, u]})" for u, x in ("xx", "xy", "xz", "yy", "yz", "zz")}
    return f"WITH g AS {FLOW} SELECT i, j, k, " + ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS {n}" for n, e in parts.items()) + " FROM g"


@register("vorticity_shear", _second())
def vorticity_shear(spark, d):
    g = cube(spark, d).select("i", "j", "k", F.col("v").alias("lap"), (F.col("v") * (F.col("i") + 1)).alias("ux"), (F.col("v") * (F.col("j") + 2)).alias("uy"), (F.col("v") * (F.col("k") + 3)).alias("uz"))
    out = N.second_level(g, G, 1.0)
    return out.select("i", "j", "k", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in out.columns[3:]))


@register("union_distinct_tags", "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS tag FROM part")
def union_distinct_tags(spark, d):
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("tag")).distinct().orderBy("tag")


@register(
    "tagged_union",
    "SELECT 'nation' AS kind, n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT 'region', r_regionkey, r_name, NULL FROM region",
)
def tagged_union(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return R.tagged_union({"nation": n, "region": r}).select("kind", "id", "name", "region")


@register("anti_join_new", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join_new(spark, d):
    known = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return R.new_rows(table(spark, d, "customer"), known, "c_custkey").select("c_custkey")


@register(
    "lookup_last",
    """SELECT c_custkey, o.o_orderkey AS o_orderkey, o.o_orderkey IS NULL AS missing FROM customer
       LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) o ON o_custkey = c_custkey""",
)
def lookup_last(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return R.lookup_last(table(spark, d, "customer").select("c_custkey"), o, "c_custkey", "o_orderkey", "o_orderkey")


@register(
    "update_by_key",
    "SELECT n_nationkey, coalesce(r_name, n_name) AS n_name FROM nation LEFT JOIN region ON r_regionkey = n_nationkey",
)
def update_by_key(spark, d):
    new = table(spark, d, "region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name"))
    return R.update_by_key(table(spark, d, "nation").select("n_nationkey", "n_name"), new, "n_nationkey", ["n_name"])


@register("upsert_latest", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def upsert_latest(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return R.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id")


@register(
    "three_sort_modes",
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS by_date,
       row_number() OVER (ORDER BY lower(o_orderpriority), o_orderkey) - 1 AS by_name,
       row_number() OVER (ORDER BY nullif(o_orderpriority, '4-NOT SPECIFIED') IS NULL, lower(o_orderstatus), o_orderkey) - 1 AS by_absent FROM orders""",
)
def three_sort_modes(spark, d):
    """Newest first; by name whatever its case; those with a value before those without, by name."""
    o = table(spark, d, "orders")
    absent = (F.col("o_orderpriority") == "4-NOT SPECIFIED").cast("int")
    orders = {"by_date": [F.datediff(F.lit("1970-01-01"), "o_orderdate")], "by_name": [F.lower("o_orderpriority")], "by_absent": [absent, F.lower("o_orderstatus")]}
    out = o.select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    return W.several_ranks(out, orders, "o_orderkey").select("o_orderkey", *orders)
