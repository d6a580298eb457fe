"""Queries over texts, and the declarative validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks as C
from ..functions import text as T
from ..operators import relations as R
from ..registry import register
from ..sources import sinks as K
from ..sources.tables import table
from . import validation as V
from .particles import SERIES, series


@register(
    "text_chunks",
    """SELECT doc_id, CAST(k AS INTEGER) AS chunk_no, md5(substring(text, CAST(k * 800 + 1 AS BIGINT), 1000)) AS hash
       FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 800.0) AS BIGINT))) AS k FROM documents WHERE length(text) > 0)""",
)
def text_chunks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return T.chunks(docs).select("doc_id", "chunk_no", F.md5(F.col("chunk").cast("binary")).alias("hash"))


@register("text_tokens", "SELECT conv_id, turn, CAST(len(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS INTEGER) AS n FROM conversations")
def text_tokens(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(T.tokens(F.col("text"))).alias("n"))


@register(
    "md5_cache_join",
    """SELECT hit, count(*) AS n FROM (SELECT md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0) AS hit FROM documents WHERE doc_id % 2 = 1) GROUP BY 1""",
)
def md5_cache_join(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    cache = docs.where("doc_id % 2 = 0").select(F.md5(F.col("text").cast("binary")).alias("hash"), F.lit("done").alias("value")).dropDuplicates(["hash"])
    asked = docs.where("doc_id % 2 = 1")
    hits, _ = R.cache_lookup(asked, cache)
    flagged = asked.join(hits.select("doc_id", F.lit(True).alias("hit")), "doc_id", "left").select(F.coalesce("hit", F.lit(False)).alias("hit"))
    return flagged.groupBy("hit").agg(F.count("*").alias("n"))


@register("cache_extend", "SELECT count(DISTINCT md5(text)) AS n FROM documents")
def cache_extend(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    cache = docs.where("doc_id % 3 = 0").select(F.md5("text").alias("hash"), F.lit("old").alias("value")).dropDuplicates(["hash"])
    _, misses = R.cache_lookup(docs, cache)
    return R.extend_cache(cache, misses.select("hash", F.lit("new").alias("value"))).agg(F.count("*").alias("n"))


@register(
    "kwic",
    """SELECT doc_id, md5(replace(substring(text, CAST(greatest(p - 200, 1) AS BIGINT), CAST(p + 5 + 200 - greatest(p - 200, 1) AS BIGINT)), chr(10), ' ')) AS hash
       FROM (SELECT doc_id, text, instr(lower(text), 'there') AS p FROM documents) WHERE p > 0""",
)
def kwic(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.keyword_in_context(F.col("text"), "There").alias("k"))
    return docs.where("k is not null").select("doc_id", F.md5(F.col("k").cast("binary")).alias("hash"))


@register(
    "bm25_topk",
    """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
       s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
       f AS (SELECT t, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS t FROM w) GROUP BY t),
       i AS (SELECT t, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM f, s), m AS (SELECT avg(idf) AS m FROM i),
       q AS (SELECT t, CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END AS idf FROM i, m WHERE t IN ('the', 'thesh', 'inonha')),
       c AS (SELECT doc_id, len(w) AS dl, t, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS t FROM w) WHERE t IN ('the', 'thesh', 'inonha') GROUP BY 1, 2, 3),
       r AS (SELECT doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM c JOIN q USING (t), s GROUP BY doc_id)
       SELECT doc_id, score FROM r ORDER BY score DESC, doc_id LIMIT 5""",
)
def bm25_topk(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return T.bm25(docs, "the thesh inonha", k=5, digits=6)


@register("paragraph_split", "SELECT conv_id, turn, CAST(len(string_split(text, chr(10))) AS INTEGER) AS lines, CAST(len(string_split(text, chr(10) || chr(10))) AS INTEGER) AS paragraphs FROM conversations")
def paragraph_split(spark, d):
    c = table(spark, d, "conversations")
    p = T.paragraphs(c.select("conv_id", "turn", "text")).groupBy("conv_id", "turn").agg(F.count("*").cast("int").alias("paragraphs"))
    return c.select("conv_id", "turn", F.size(F.split("text", "\n")).alias("lines")).join(p, ["conv_id", "turn"])


@register("paragraph_join", "SELECT doc_id, md5(text) AS hash FROM documents")
def paragraph_join(spark, d):
    parts = T.paragraphs(table(spark, d, "documents").select("doc_id", "text"))
    return T.join_paragraphs(parts, "doc_id").select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash"))


@register(
    "paragraph_filter",
    r"""SELECT NOT (t = '' OR regexp_matches(t, '^(%|\\(def|newcommand|usepackage|documentclass|bibliography|input|include|subfile))')
                   OR (starts_with(t, '\begin{figure}') AND NOT contains(t, '\caption'))
                   OR (regexp_matches(t, '^\\[a-zA-Z]+\{[^}]+\}$') AND NOT regexp_matches(t, '\\(title|section|subsection|subsubsection|caption|author)'))) AS worth,
              count(*) AS n
       FROM (SELECT regexp_replace(p, '^\s+|\s+$', '', 'g') AS t FROM (SELECT unnest(string_split(text, chr(10))) AS p FROM documents)) GROUP BY 1""",
)
def paragraph_filter(spark, d):
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("p"))
    return lines.select(T.worth_translating(F.col("p")).alias("worth")).groupBy("worth").agg(F.count("*").alias("n"))


@register("sticky_state", "SELECT event_id, bool_or(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id) AS after FROM events")
def sticky_state(spark, d):
    return T.sticky(table(spark, d, "events"), F.col("event_type") == "purchase", "event_id", ["user_id"]).select("event_id", "after")


@register("safe_names", "SELECT p_partkey, substring(regexp_replace(p_name || '/' || p_brand, '[^A-Za-z0-9]', '_', 'g'), 1, 12) AS name FROM part")
def safe_names(spark, d):
    return table(spark, d, "part").select("p_partkey", T.safe_name(F.concat_ws("/", "p_name", "p_brand"), 12).alias("name"))


@register("keyword_tags", "SELECT p_partkey, array_to_string(list_filter(['red', 'small', 'ring'], lambda k: contains(lower(p_name), k)), ',') AS tags FROM part")
def keyword_tags(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(T.keyword_tags(F.col("p_name"), ["red", "small", "ring"]), ",").alias("tags"))


@register("tag_filter", "SELECT p_partkey FROM part WHERE contains(p_name, 'red') OR contains(p_name, 'ring')")
def tag_filter(spark, d):
    from ..operators.filters import any_tag

    p = table(spark, d, "part").withColumn("tags", T.keyword_tags(F.col("p_name"), ["red", "small", "ring"]))
    return p.where(any_tag(F.col("tags"), ["red", "ring"])).select("p_partkey")


@register("json_get", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_get(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.from_json("props", "k bigint")["k"], F.lit(0)).alias("k"))


@register("safe_cast", "SELECT sum(CASE WHEN TRY_CAST(props AS DOUBLE) IS NULL THEN 1 ELSE 0 END)::BIGINT AS bad FROM events")
def safe_cast(spark, d):
    return table(spark, d, "events").agg(F.sum(F.isnan(C.safe_double(F.col("props"))).cast("long")).alias("bad"))


@register(
    "threshold_check",
    """SELECT event_id, CASE WHEN value >= 5 AND value <= 50 AND abs(value - 20) <= 25 THEN 'pass' ELSE 'fail' END AS status,
       CASE WHEN value >= 5 AND value <= 50 AND abs(value - 20) <= 25 THEN '>= 5; <= 50; |value - 20| <= 25'
            ELSE concat_ws('; ', CASE WHEN value < 5 THEN '>= 5' END, CASE WHEN value > 50 THEN '<= 50' END, CASE WHEN abs(value - 20) > 25 THEN '|value - 20| <= 25' END) END AS detail FROM events""",
)
def threshold_check(spark, d):
    status, detail = C.check_threshold(F.col("value"), 5.0, 50.0, 20.0, 25.0)
    return table(spark, d, "events").select("event_id", status.alias("status"), detail.alias("detail"))


@register(
    "compare_values",
    """SELECT p_partkey, CASE WHEN abs(p_retailprice - p_size * 30.0) <= 400 AND 100 * abs(p_retailprice - p_size * 30.0) / greatest(abs(p_size * 30.0), 1e-12) <= 60 THEN 'pass' ELSE 'fail' END AS status FROM part""",
)
def compare_values(spark, d):
    _, _, status = C.compare_values(F.col("p_retailprice"), F.col("p_size") * 30.0, 400.0, 60.0)
    return table(spark, d, "part").select("p_partkey", status.alias("status"))


@register("status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, d):
    return K.status_counts(table(spark, d, "orders").withColumnRenamed("o_orderstatus", "status"))


CASE = {
    "metrics": [
        {"name": "mean_n", "type": "csv_column", "table": "series", "column": "n", "window": "second_half", "stat": "mean", "threshold": {"min": 0.0}},
        {"name": "last_cents", "type": "csv_column", "table": "series", "column": "cents", "stat": "last"},
        {"name": "fit", "type": "msd_fit", "table": "series", "x": "step", "y": "cents", "window": "all", "thresholds": {"r2": {"min": 0.99}}},
        {"name": "absent", "type": "csv_column", "table": "nowhere", "column": "x"},
        {"name": "odd", "type": "unheard_of"},
    ],
    "comparisons": [{"name": "pair", "type": "paired_csv_column", "left": "series", "right": "series", "column": "n", "stat": "max", "max_rel_pct": 1.0}],
}


@register(
    "validation_case",
    f"""WITH s AS {SERIES}, h AS (SELECT n FROM (SELECT n, row_number() OVER (ORDER BY step) - 1 AS rn, count(*) OVER () AS t FROM s) WHERE rn >= floor(t / 2))
        SELECT 'check' AS kind, 'mean_n' AS name, 'pass' AS status, round((SELECT avg(n) FROM h), 6) AS value UNION ALL
        SELECT 'check', 'last_cents', 'info', CAST((SELECT arg_max(cents, step) FROM s) AS DOUBLE) UNION ALL
        SELECT 'check', 'fit.r2', CASE WHEN (SELECT regr_r2(cents, step) FROM s) >= 0.99 THEN 'pass' ELSE 'fail' END, round((SELECT regr_r2(cents, step) FROM s), 6) UNION ALL
        SELECT 'check', 'fit.D', 'info', round((SELECT regr_slope(cents, step) / 6 FROM s), 6) UNION ALL
        SELECT 'check', 'absent', 'missing_required', NULL UNION ALL SELECT 'check', 'odd', 'fail', NULL UNION ALL
        SELECT 'comparison', 'pair', 'pass', CAST((SELECT max(n) FROM s) AS DOUBLE)""",
)
def validation_case(spark, d):
    rows, _ = V.run_case(spark, CASE, {"series": series(spark, d)})
    return rows.select("kind", "name", "status", F.round("value", 6).alias("value"))


@register(
    "summary_comparison",
    """WITH s AS (SELECT event_type AS name, avg(value) FILTER (WHERE event_id % 2 = 0) AS v, avg(value) FILTER (WHERE event_id % 2 = 1 AND event_type <> 'signup') AS r FROM events GROUP BY 1)
       SELECT name, CASE WHEN r IS NULL THEN 'missing_reference' WHEN 100 * abs(v - r) / greatest(abs(r), 1e-12) <= 5 THEN 'pass' ELSE 'fail' END AS status, round(v, 6) AS value FROM s""",
)
def summary_comparison(spark, d):
    """Mean values by type of event, those of even events against those of odd ones."""
    e = table(spark, d, "events")
    side = lambda odd: e.where(F.col("event_id") % 2 == odd).groupBy(F.col("event_type").alias("observable")).agg(F.avg("value").cast("string").alias("value"), F.max("event_id").alias("row"))
    names = ["click", "error", "purchase", "signup", "view"]
    c = {"name": "s", "type": "summary_table", "left": "l", "right": "r", "observables": [{"name": n, "max_rel_pct": 5.0} for n in names]}
    out = V.evaluate_comparisons(spark, {"l": side(0), "r": side(1).where("observable <> 'signup'")}, [c])
    return out.select("name", "status", F.round("value", 6).alias("value"))


@register(
    "markdown_lines",
    r"""SELECT CAST(p_partkey AS BIGINT) AS line, CASE p_partkey % 6 WHEN 0 THEN 'heading' WHEN 1 THEN 'list' WHEN 2 THEN 'table' WHEN 3 THEN 'separator' ELSE 'text' END AS kind,
       CASE p_partkey % 6 WHEN 0 THEN '\section{' || p_name || '}' WHEN 1 THEN '\item \textbf{' || p_name || '} and \texttt{code}' WHEN 2 THEN '\$' || p_size || ' & a\_' || p_size || ' \\' WHEN 3 THEN '\hline'
            WHEN 4 THEN '\href{u}{' || p_name || '}' ELSE p_size || '\% \& more\_x \textbackslash{}y \textasciitilde{}' END AS latex FROM part""",
)
def markdown_lines(spark, d):
    """Parts as lines of every kind."""
    name, size, k = F.col("p_name"), F.col("p_size").cast("string"), F.col("p_partkey") % 6
    text = F.when(k == 0, F.concat(F.lit("# "), name)).when(k == 1, F.concat(F.lit("- **"), name, F.lit("** and `code`"))).when(k == 2, F.concat(F.lit("| $"), size, F.lit(" | a_"), size, F.lit(" |")))
    text = text.when(k == 3, "|---|---|").when(k == 4, F.concat(F.lit("["), name, F.lit("](u)"))).otherwise(F.concat(size, F.lit("% & more_x \\y ~")))
    return K.markdown_to_latex(table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("line"), text.alias("text")))


@register("translate_with_cache", "SELECT doc_id, md5('T:' || text) AS hash FROM documents WHERE lang = 'en' AND regexp_matches(text, '[a-zA-Z]{3}') AND NOT contains(text, chr(10) || chr(10))")
def translate_with_cache(spark, d):
    from .translation import translate_documents

    docs = table(spark, d, "documents").where("lang = 'en'").where(F.col("text").rlike("[a-zA-Z]{3}") & ~F.contains("text", F.lit("\n\n")))
    cache = docs.where("doc_id % 2 = 0").select(F.md5("text").alias("hash"), F.concat(F.lit("T:"), F.col("text")).alias("value")).dropDuplicates(["hash"])
    done, _ = translate_documents(docs, cache, lambda x: "T:" + x)
    return done.select("doc_id", F.md5("text").alias("hash"))


@register("pending_tasks", "SELECT o_orderkey AS name FROM orders WHERE o_orderstatus <> 'F' ORDER BY 1 LIMIT 5")
def pending_tasks(spark, d):
    from .translation import pending

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("name"), F.when(F.col("o_orderstatus") == "F", "SUCCESS").otherwise("FAILED").alias("status"))
    return pending(o.select("name"), o, batch=5)


@register(
    "pending_by_state",
    """SELECT CAST(o_orderkey AS VARCHAR) AS name FROM orders
       WHERE o_orderstatus = 'P' AND o_orderpriority <> '5-LOW' AND o_orderkey % 4 < 3 OR o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1999-01-01' - INTERVAL 30 DAY OR o_orderstatus NOT IN ('F', 'P', 'O')
       ORDER BY o_orderkey // 100000, CAST(o_orderkey AS VARCHAR)""",
)
def pending_by_state(spark, d):
    """Orders as tasks: F is done, P failed or was skipped, O began at its date and is stale after 30 days."""
    import datetime

    from .translation import pending

    o = table(spark, d, "orders").withColumn("name", F.col("o_orderkey").cast("string"))
    status = F.when(F.col("o_orderstatus") == "F", "SUCCESS").when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW"), "SKIPPED").when(F.col("o_orderstatus") == "P", "FAILED").when(F.col("o_orderstatus") == "O", "RUNNING")
    states = o.select("name", status.alias("status"), F.col("o_orderdate").alias("at"), (F.col("o_orderkey") % 4).alias("tries"))
    return pending(o.select("name"), states, now=datetime.datetime(1999, 1, 1), stale="30 days", tries=3)


@register(
    "translate_all",
    r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
        t AS (SELECT doc_id, k, p, regexp_replace(p, '^\s+|\s+$', '', 'g') AS t FROM p),
        w AS (SELECT doc_id, k, p, NOT (t = '' OR regexp_matches(t, '^(%|\\(def|newcommand|usepackage|documentclass|bibliography|input|include|subfile))')
                   OR (starts_with(t, '\begin{figure}') AND NOT contains(t, '\caption'))
                   OR (regexp_matches(t, '^\\[a-zA-Z]+\{[^}]+\}$') AND NOT regexp_matches(t, '\\(title|section|subsection|subsubsection|caption|author)'))) AS worth FROM t)
        SELECT doc_id, md5(string_agg(CASE WHEN worth THEN 'T:' || p ELSE p END, chr(10) || chr(10) ORDER BY k)) AS hash FROM w GROUP BY doc_id""",
)
def translate_all(spark, d):
    """Whole texts of all languages, each line a paragraph: split, translated where worth it, a third of it from the cache, and joined again."""
    from .translation import translate_documents

    docs = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    known = T.paragraphs(docs.where("doc_id % 3 = 0")).select(F.md5(F.col("paragraph").cast("binary")).alias("hash"), F.concat(F.lit("T:"), "paragraph").alias("value")).dropDuplicates(["hash"])
    done, _ = translate_documents(docs, known, lambda x: "T:" + x)
    return done.select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash"))
