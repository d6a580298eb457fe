"""URL rules by a sort-merge range join of reversed hosts.

A host's labels in reverse, each followed by a dot (``net.example.blog.``), are
its key: the keys of a host and of all its subdomains are those that begin with
its own, an interval of the sorted keys, and the intervals of any rules are nested
or apart.  Pages and rules are dealt to ranges of keys and sorted; a sweep opens
a rule where its interval begins, closes it at the first key outside, and so
holds the rules that enclose the page at hand on a stack.  Of these, those whose
path begins the page's path fit, and the longest decides.

Ranges are cut at keys of a sample of the pages, which decides about balance only.
A cut may fall within equal keys (pages of a key are spread by a hash), so a
host with a third of all pages lies in as many ranges as its share.  A range
begins with the rules that are open at its cut: they are found by equality of
the cut's leading labels with rules' keys, so neither rules nor pages are broadcast.

Defined results: a null url, or one without ``://``, has an empty host and path, and
no rule fits it; rules without host are left out, those with a null path have an
empty one; of equal rules block wins; of fitting rules with as many characters
the one with the longer host; repeated pages give a row each; columns other than
page_id and url are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Verdict, host and path of the rules that op12 applies.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Verdict where no rule fits: rules make exceptions from what passes.
DEFAULT = "allow"
#: Pages of the sample for each range.
SAMPLED = 100
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OUT = "page_id long, host string, path string, rule string, verdict string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://`` up to ``/?#``, A-Z lower-cased; and then up to ``?#``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2))
    return F.translate(host, _UP, _LOW), path


def host_key(host: Column) -> Column:
    """Labels in reverse, each with a dot behind it; empty for an empty host."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _labels(key: str, n: int) -> str | None:
    """The first n labels of a key; none if it has fewer."""
    at = -1
    for _ in range(n):
        at = key.find(".", at + 1)
        if at < 0:
            return None
    return key[: at + 1]


def sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages of one range with their rules, from rows sorted by key, rules first."""
    stack: list[tuple[str, int, dict[int, dict[str, tuple[str, str]]]]] = []  # key, length of the host, rules by length of their path
    for frame in frames:
        out = []
        for key, kind, page, host, path, name, verdict in zip(*(frame[c].tolist() for c in ("key", "kind", "page_id", "host", "path", "rule", "verdict"))):
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not kind:
                if not stack or stack[-1][0] != key:
                    stack.append((key, len(key) - 1, {}))
                stack[-1][2].setdefault(len(path), {})[path] = (name, verdict)
                continue
            best = (-1, -1, None, None)
            for _, size, rules in stack:
                for n, of in rules.items():
                    if size + n >= best[0] and (fits := of.get(path[:n])):  # host lengths grow along the stack
                        best = max(best, (size + n, size, *fits), key=lambda x: x[:2])
            out.append((page, host, path, best[2], best[3]))
        if out:
            done = pd.DataFrame(out, columns=["page_id", "host", "path", "rule", "verdict"])
            yield done.assign(page_id=done["page_id"].astype("Int64"))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, ranges: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page by rules of (verdict, host, path)."""
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    url = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    p = url.select("page_id", host.alias("host"), path.alias("path"), F.hex(F.xxhash64("page_id", "url")).alias("spread"))
    p = p.select("*", host_key(F.col("host")).alias("key"))
    place = F.concat("key", F.lit("\x00"), F.lpad("spread", 16, "0"))  # equal keys lie in the order of the hash

    low = F.translate(F.col("host").cast("string"), _UP, _LOW)
    r = rules.select(F.col("verdict").cast("string").alias("verdict"), low.alias("host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path")).where("host <> ''")
    r = r.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(host_key(F.col("host")).alias("key"), "path", F.concat("host", "path").alias("rule"), "verdict")

    n = max(1, pages.count())
    some = p.sample(min(1.0, ranges * SAMPLED / n), 1).select(place.alias("at")).collect()
    at = sorted(x["at"] for x in some)
    cuts = sorted({at[i * len(at) // ranges] for i in range(1, ranges)}) if at else []
    range_of = F.pandas_udf(lambda s: s.map(lambda x: bisect_right(cuts, x)).astype("int32"), "int")

    depths = [x[0] for x in r.select((F.length("key") - F.length(F.replace("key", F.lit("."), F.lit("")))).alias("n")).distinct().collect()]
    leads = [(i, lead) for i, cut in enumerate(cuts, 1) for d in depths if (lead := _labels(cut.split("\x00", 1)[0], d))]
    own = r.select(range_of("key").alias("range"), "*")
    opened = own.withColumnRenamed("range", "own").join(spark.createDataFrame(leads, "range int, key string"), "key").where("own < range")

    none = lambda kind: F.lit(None).cast(kind)
    every = p.select(range_of(place).alias("range"), "key", F.lit(1).alias("kind"), "page_id", "host", "path", none("string").alias("rule"), none("string").alias("verdict"))
    for part in (own, opened):
        every = every.unionByName(part.select("range", "key", F.lit(0).alias("kind"), none("long").alias("page_id"), none("string").alias("host"), "path", "rule", "verdict"))
    swept = every.repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions("key", "kind").drop("range").mapInPandas(sweep, _OUT)
    return swept.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "verdict string, host string, path string"))


_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
SQL12 = f"""WITH p AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{_UP}', '{_LOW}') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, row_number() OVER () AS k FROM pages),
    r(verdict, rh, rp) AS (VALUES {_VALUES}),
    m AS (SELECT k, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY k)
    SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM p LEFT JOIN m USING (k)"""
