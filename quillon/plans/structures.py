"""Queries over structures that are built from the tables: an inverted index, compiled cases, triangles, hybrid matrices, carried states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import elementwise as M
from ..operators import graph as G
from ..operators import markdown as K
from ..operators import postings as I
from ..operators import scans as W
from ..operators import sparse as S
from ..operators.rounds import new_folder
from ..registry import register
from ..sources.tables import table
from . import cases
from .vectors import SPMV, coo, price, suppliers


_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"


def _bm25_sql(query: str, k: int) -> str:
    asked = ", ".join(f"'{w}'" for w in query.split())
    return f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
       f AS (SELECT t, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS t FROM w) GROUP BY t),
       i AS (SELECT t, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM f, s), m AS (SELECT avg(idf) AS m FROM i),
       q AS (SELECT t, CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END AS idf FROM i, m WHERE t IN ({asked})),
       c AS (SELECT doc_id, len(w) AS dl, t, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS t FROM w) WHERE t IN ({asked}) GROUP BY 1, 2, 3)
       SELECT doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM c JOIN q USING (t), s GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {k}"""


_ASKED = [("the thesh inonha", 5), ("der que la the", 20)]


@register("index_search", " UNION ALL ".join(f"SELECT {i} AS query, * FROM ({_bm25_sql(*a)})" for i, a in enumerate(_ASKED)))
def index_search(spark, d):
    """Two searches of one index, made of one segment and a second one with later documents."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    base = new_folder(spark, "index")
    I.add_documents(docs.where("doc_id % 4 > 0"), base)
    I.add_documents(docs.where("doc_id % 4 = 0"), base)
    out = None
    for i, (query, k) in enumerate(_ASKED):
        rows = I.search(spark, base, query, k, digits=6).select(F.lit(i).alias("query"), F.col("doc").alias("doc_id"), "score")
        out = rows if out is None else out.unionByName(rows)
    return out


# --- compiled cases
def _summary(events):
    """Observables by type of event, in the order of the type: some lack a value or a reference, one brings its own error."""
    v, kind = F.round(F.col("value") * 100).cast("long"), F.col("event_type")
    rows = events.groupBy(kind.alias("observable")).agg(F.sum(F.when(F.col("event_id") % 2 == 0, v)).alias("even"), F.sum(F.when(F.col("event_id") % 2 == 1, v)).alias("odd"))
    return rows.select(
        "observable", F.ascii("observable").alias("row"), F.when(F.col("observable") != "error", F.col("even")).alias("value"), F.when(F.col("observable") != "signup", F.col("odd")).alias("reference"),
        F.when(F.col("observable") == "click", F.lit(3.5)).alias("rel_error_pct"),
    )


CASE = {
    "name": "events_and_orders",
    "metrics": [
        {"name": "later_mean", "type": "csv_column", "path": "events", "column": "value", "window": "second_half", "threshold": {"min": 0, "max": 1000}},
        {"name": "later_std", "type": "csv_column", "path": "events", "column": "value", "window": "last_80_percent", "stat": "std"},
        {"name": "last_value", "type": "csv_column", "path": "events", "column": "value", "stat": "last", "threshold": {"target": -1, "max_abs_error": 0.5}},
        {"name": "drift", "type": "csv_column", "path": "orders", "column": "o_totalprice", "window": "last_fraction:0.25", "stat": "relative_drift_abs_max", "threshold": {"max": 1e12}},
        {"name": "no_numbers", "type": "csv_column", "path": "lineitem", "column": "l_returnflag"},
        {"name": "quantity", "type": "csv_column", "path": "lineitem", "column": "l_quantity", "threshold": {"min": 1, "max": 50, "target": 25.5, "max_abs_error": 2}},
        {"name": "line", "type": "msd_fit", "path": "orders", "step_column": "o_orderkey", "msd_column": "o_totalprice", "dt": 0.5, "window": "last_80_percent", "outputs": ["D", "r2"], "threshold": {"r2_min": 0.99}},
        {"name": "own_error", "type": "summary_observable", "path": "summary", "observable": "click", "threshold": {"max": 5}},
        {"name": "no_error", "type": "summary_observable", "path": "summary", "observable": "view", "threshold": {"max": 5}},
        {"name": "no_observable", "type": "summary_observable", "path": "summary", "observable": "nothing", "threshold": {"max": 5}},
        {"name": "absent", "type": "csv_column", "path": "nowhere", "column": "x"},
        {"name": "absent_optional", "type": "msd_fit", "path": "nowhere", "step_column": "x", "msd_column": "y", "required": False},
        {"name": "odd_type", "type": "unheard_of"},
        {"name": "odd_stat", "type": "csv_column", "path": "events", "column": "value", "stat": "mode"},
    ],
    "comparisons": [
        {"type": "summary_table", "path": "summary", "observables": [
            {"name": "view", "threshold": {"rel_error_pct_max": 100}}, {"name": "click", "threshold": {"rel_error_pct_max": 3.4}}, {"name": "purchase"}, {"name": "error"}, {"name": "signup", "threshold": {"abs_error_max": 1}}, {"name": "nothing"},
        ]},
        {"type": "summary_table", "path": "nowhere", "required": False, "observables": [{"name": "optional"}]},
        {"type": "summary_table", "path": "nowhere", "observables": [{"name": "needed"}]},
        {"type": "paired_csv_column", "name": "pair", "left_path": "lineitem", "left_column": "l_discount", "right_path": "lineitem", "right_column": "l_tax", "threshold": {"abs_error_max": 1e-9, "rel_error_pct_max": 1000}},
        {"type": "paired_csv_column", "name": "pair_alone", "left_path": "events", "left_column": "value", "right_path": "nowhere", "right_column": "value"},
        {"type": "pairs_of_pairs", "name": "odd_comparison"},
    ],
}


@register(
    "validation_compiled",
    """WITH e AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS rn, count(*) OVER () AS t FROM events), o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, count(*) OVER () AS t FROM orders),
    s AS (SELECT event_type AS observable, CASE WHEN event_type <> 'error' THEN CAST(sum(CASE WHEN event_id % 2 = 0 THEN CAST(round(value * 100) AS BIGINT) END) AS DOUBLE) END AS v,
                 CASE WHEN event_type <> 'signup' THEN CAST(sum(CASE WHEN event_id % 2 = 1 THEN CAST(round(value * 100) AS BIGINT) END) AS DOUBLE) END AS r FROM events GROUP BY 1),
    q AS (SELECT o_totalprice AS p, rn FROM o WHERE rn >= floor(t * 0.75)), f AS (SELECT o_orderkey * 0.5 AS x, o_totalprice AS y FROM o WHERE rn >= floor(t / 5)),
    m(name, value, low, high, target, err, free) AS (
        SELECT 'later_mean', (SELECT avg(value) FROM e WHERE rn >= floor(t / 2)), 0, 1000, NULL, NULL, false UNION ALL
        SELECT 'later_std', (SELECT stddev_samp(value) FROM e WHERE rn >= floor(t / 5)), NULL, NULL, NULL, NULL, true UNION ALL
        SELECT 'last_value', (SELECT arg_max(value, event_id) FROM e), NULL, NULL, -1, 0.5, false UNION ALL
        SELECT 'drift', (SELECT max(abs(p - (SELECT arg_min(p, rn) FROM q)) / greatest(abs((SELECT arg_min(p, rn) FROM q)), 1e-12)) FROM q), NULL, 1e12, NULL, NULL, false UNION ALL
        SELECT 'quantity', (SELECT avg(l_quantity) FROM lineitem), 1, 50, 25.5, 2, false UNION ALL
        SELECT 'line.r2', (SELECT regr_r2(y, x) FROM f), 0.99, NULL, NULL, NULL, false UNION ALL
        SELECT 'line.D', (SELECT regr_slope(y, x) / 6 FROM f), NULL, NULL, NULL, NULL, true UNION ALL
        SELECT 'own_error', 3.5, NULL, 5, NULL, NULL, false),
    c AS (SELECT observable AS name, v, r, abs(v - r) AS ae, 100 * abs(v - r) / greatest(abs(r), 1e-12) AS pct FROM s),
    p AS (SELECT avg(l_discount) AS v, avg(l_tax) AS r FROM lineitem)
    SELECT 'check' AS kind, name, CASE WHEN free THEN 'info' WHEN coalesce(value >= low, true) AND coalesce(value <= high, true) AND coalesce(abs(value - target) <= err, true) THEN 'pass' ELSE 'fail' END AS status,
           round(value, 6) AS value, CAST(NULL AS DOUBLE) AS reference, CAST(NULL AS DOUBLE) AS rel_error_pct FROM m
    UNION ALL SELECT 'check', name, status, NULL, NULL, NULL FROM (VALUES ('no_numbers', 'fail'), ('no_error', 'fail'), ('no_observable', 'fail'), ('absent', 'missing_required'), ('absent_optional', 'missing_optional'),
           ('odd_type', 'fail'), ('odd_stat', 'fail')) t(name, status)
    UNION ALL SELECT 'comparison', name, CASE name WHEN 'error' THEN 'missing_value' WHEN 'signup' THEN 'missing_reference' WHEN 'click' THEN 'fail' WHEN 'purchase' THEN 'info' ELSE CASE WHEN pct <= 100 THEN 'pass' ELSE 'fail' END END,
           v, r, CASE name WHEN 'click' THEN 3.5 ELSE round(pct, 6) END FROM c
    UNION ALL SELECT 'comparison', name, status, NULL, NULL, NULL FROM (VALUES ('nothing', 'missing_observable'), ('optional', 'missing_reference'), ('needed', 'missing_required'), ('odd_comparison', 'fail')) t(name, status)
    UNION ALL SELECT 'comparison', 'pair', CASE WHEN abs(v - r) <= 1e-9 THEN 'pass' ELSE 'fail' END, round(v, 6), round(r, 6), round(100 * abs(v - r) / greatest(abs(r), 1e-12), 6) FROM p
    UNION ALL SELECT 'comparison', 'pair_alone', 'missing_reference', round((SELECT avg(value) FROM events), 6), NULL, NULL""",
)
def validation_compiled(spark, d):
    events = table(spark, d, "events")
    tables = {"events": (events, "event_id"), "orders": (table(spark, d, "orders"), "o_orderkey"), "lineitem": (table(spark, d, "lineitem"), "l_orderkey"), "summary": (_summary(events), "row")}
    rows = cases.evaluate(spark, CASE, tables)
    return rows.select("kind", "name", "status", *(F.round(c, 6).alias(c) for c in ("value", "reference", "rel_error_pct")))


# --- graphs
TRADE = """(SELECT 3 * l_partkey AS src, 3 * l_suppkey + 1 AS dst FROM lineitem UNION SELECT 3 * o_custkey + 2, 3 * l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey
            UNION SELECT 3 * o_custkey + 2, 3 * l_suppkey + 1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def trade(spark, d):
    """Parts, suppliers and customers, joined where a line item names both."""
    lines = table(spark, d, "lineitem").select("l_orderkey", (3 * F.col("l_partkey")).alias("p"), (3 * F.col("l_suppkey") + 1).alias("s"))
    both = lines.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (3 * F.col("o_custkey") + 2).alias("c")), "l_orderkey")
    pair = lambda df, a, b: df.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    return pair(lines, "p", "s").unionByName(pair(both, "c", "p")).unionByName(pair(both, "c", "s"))


@register(
    "triangle_counts",
    f"""WITH e AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v FROM {TRADE} GROUP BY ALL), t AS (SELECT x.u AS a, x.v AS b, y.v AS c FROM e x JOIN e y ON y.u = x.v JOIN e z ON z.u = x.u AND z.v = y.v)
        SELECT v, count(*) AS n FROM (SELECT unnest([a, b, c]) AS v FROM t) GROUP BY v""",
)
def triangle_counts(spark, d):
    return G.triangles(trade(spark, d))


@register("core_numbers")
def core_numbers(spark, d):
    """Of the parts and suppliers: no SQL, tests compare with peeling."""
    lines = table(spark, d, "lineitem")
    return G.core_numbers(lines.select((2 * F.col("l_partkey")).alias("src"), (2 * F.col("l_suppkey") + 1).alias("dst")))


@register("spmv_hybrid", SPMV)
def spmv_hybrid(spark, d):
    return S.spmv_hybrid(*S.hybrid(coo(spark, d), suppliers(spark, d)), price(spark, d))


# --- states carried along ordered rows
@register(
    "carry_forward",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents),
        f AS (SELECT doc_id, no, CASE WHEN length(line) > 200 THEN md5(line) END AS long, CASE WHEN contains(line, 'the') THEN 1 END AS the FROM l)
        SELECT doc_id, CAST(no AS INTEGER) AS no, last_value(long IGNORE NULLS) OVER a AS long, last_value(the IGNORE NULLS) OVER a AS the, last_value(long IGNORE NULLS) OVER b AS long_here FROM f
        WINDOW a AS (ORDER BY doc_id, no ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING)""",
)
def carry_forward(spark, d):
    """Of every line of all documents: the last long line and whether "the" was met, along the table; the last long line of the document."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    marked = lines.select("doc_id", "no", F.when(F.length("line") > 200, F.md5(F.col("line").cast("binary"))).alias("l"), F.when(F.contains("line", F.lit("the")), F.lit(1)).alias("t"))
    along = W.carry_forward(marked, ["doc_id", "no"], {"long": "l", "the": "t"})
    return W.carry_forward(along, ["no"], {"long_here": "l"}, ["doc_id"]).drop("l", "t")


@register(
    "vector_products",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * l_tax + l_discount * l_quantity + l_tax * l_discount AS dot, l_discount * l_discount - l_tax * l_quantity AS cx, l_tax * l_tax - l_quantity * l_discount AS cy,
       l_quantity * l_quantity - l_discount * l_tax AS cz, sqrt(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax) AS length FROM lineitem""",
)
def vector_products(spark, d):
    a, b = ["l_quantity", "l_discount", "l_tax"], ["l_tax", "l_quantity", "l_discount"]
    x, y, z = M.cross(a, b)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", M.dot(a, b).alias("dot"), x.alias("cx"), y.alias("cy"), z.alias("cz"), M.length(*a).alias("length"))


# --- documents
_MARKED = """SELECT doc_id, no, CASE WHEN no % 11 = 10 THEN 4 WHEN no % 7 = 6 THEN 3 WHEN no % 5 = 4 THEN 2 WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS k, CASE WHEN no % 3 = 2 THEN 4 ELSE 2 * ((no + doc_id) % 2) END AS indent, (no + doc_id) % 4 = 0 AS numbered
             FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents)"""


@register(
    "markdown_documents",
    f"""WITH m AS ({_MARKED}), b AS (SELECT *, sum(CASE WHEN k IN (3, 4) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no) AS block FROM m), i AS (SELECT * FROM b WHERE k < 2),
        p AS (SELECT x.doc_id, x.no, x.indent, (SELECT max(y.no) FROM i y WHERE y.doc_id = x.doc_id AND y.block = x.block AND y.no < x.no AND y.indent <= x.indent) AS up FROM i x),
        o AS (SELECT p.doc_id, count(*) FILTER (WHERE p.up IS NULL OR u.indent < p.indent) AS lists FROM p LEFT JOIN i u ON u.doc_id = p.doc_id AND u.no = p.up GROUP BY p.doc_id),
        t AS (SELECT doc_id, count(*) FILTER (WHERE k = 2 AND coalesce(before, -1) <> 2) AS tables, count(*) FILTER (WHERE k = 2) AS r FROM (SELECT doc_id, no, k, lag(k) OVER (PARTITION BY doc_id ORDER BY no) AS before FROM m WHERE k >= 2) GROUP BY doc_id)
        SELECT CAST(doc_id AS VARCHAR) AS key, coalesce(lists, 0) + coalesce(tables, 0) AS begins, coalesce(lists, 0) + coalesce(tables, 0) AS ends, count(*) FILTER (WHERE k < 2) AS items, coalesce(any_value(t.r), 0) AS table_rows, count(*) FILTER (WHERE k = 3) AS headings
        FROM m LEFT JOIN o USING (doc_id) LEFT JOIN t USING (doc_id) GROUP BY doc_id, lists, tables""",
)
def markdown_documents(spark, d):
    """All documents' lines as items, table rows, headings and text in turn: how many environments are opened and closed in each."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    no, word = F.col("no"), F.concat(F.regexp_replace("line", r"[|#*$`!\[\]\-]", ""), F.lit("."))
    indent = F.when(no % 3 == 2, 4).otherwise(2 * ((no + F.col("doc_id")) % 2)).cast("int")
    item = F.concat(F.repeat(F.lit(" "), indent), F.lit("- "), word)
    kind = F.when(no % 11 == 10, F.concat(F.lit("x"), word)).when(no % 7 == 6, F.concat(F.lit("# "), word)).when(no % 5 == 4, F.concat(F.lit("| a | "), word, F.lit(" |"))).otherwise(item)
    latex = K.documents_to_latex(lines.select("doc_id", "no", kind.alias("text")), "doc_id", "no")
    count = lambda k: F.sum((F.col("kind") == k).cast("long"))
    return latex.groupBy("key").agg(count("begin").alias("begins"), count("end").alias("ends"), count("item").alias("items"), count("row").alias("table_rows"), count("heading").alias("headings"))
