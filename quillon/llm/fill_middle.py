"""Fill-in-middle form of documents, with cuts at token boundaries found by overlapping chunks.

A token is a run of A-Z and a-z, or any other single character, so whether one
begins at a character depends on that character and the one before alone: it
does unless both are letters.  A text is cut into chunks of CHUNK characters, each
read together with the last character of the chunk before.  Every chunk counts
the tokens that begin in it; the running sum of the counts tells which chunk a
token's rank belongs to, and only the (at most two) chunks that own a cut are
read again, to find the character at which the token begins.

All of it are DataFrame functions over an array of chunks in the text's own row:
the output's digest needs the whole text in a row anyway, so no text is shuffled,
and a lost executor costs the reading of its files.

Defined results: a null text is an empty one; an empty text, and one that holds
one of the marks, is plain; a null doc_id draws as an empty one; repeated rows
give a row each; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, table

#: Characters of a chunk.
CHUNK = 8192
#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_TOKEN = "[A-Za-z]+|[^A-Za-z]"


def draws(doc_id: Column, seed: str = "1") -> list[Column]:
    """Four numbers below 2**32 from the id: the first 32-bit groups of sha256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def chunks(text: Column, size: int = CHUNK) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def begun(chunk: Column, before: Column) -> Column:
    """How many tokens begin in a chunk; ``before`` is the character ahead of it."""
    # of every run of letters one character stays, and that is ``before`` where the run began there
    return F.length(F.regexp_replace(F.concat(before, chunk), "(?<=[A-Za-z])[A-Za-z]+", "")) - F.length(before)


def _before(parts: str, i: Column) -> Column:
    return F.coalesce(F.right(F.get(parts, i - 1), F.lit(1)), F.lit(""))


def _owner(counts: str, rank: Column) -> Column:
    """(at, base): the chunk in which the token of a rank (from 0) begins, and how many begin before that chunk."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("base"), F.lit(-1).alias("at"))

    def step(s: Column, n: Column) -> Column:
        here = (s["at"] < 0) & (rank < s["base"] + n)
        return F.struct(
            (s["i"] + 1).alias("i"), F.when((s["at"] >= 0) | here, s["base"]).otherwise(s["base"] + n).alias("base"), F.when(here, s["i"]).otherwise(s["at"]).alias("at")
        )

    return F.aggregate(counts, start, step)


def _place(parts: str, owner: str, rank: Column, size: int) -> Column:
    """Characters before the token of a rank: its chunk is read again."""
    at = F.col(owner)["at"]
    chunk, before = F.get(parts, at), _before(parts, at)
    goes_on = F.concat(before, F.left(chunk, F.lit(1))).rlike("^[A-Za-z]{2}$").cast("int")  # the chunk's first token began earlier
    ahead = F.slice(F.regexp_extract_all(chunk, F.lit(_TOKEN), F.lit(0)), F.lit(1), (rank - F.col(owner)["base"]).cast("int") + goes_on)
    return at.cast("long") * size + F.length(F.array_join(ahead, ""))


def fill_in_middle(docs: DataFrame, rate: int = 90, spm: int = 20, size: int = CHUNK, seed: str = "1") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row.

    ``rate`` of 100 documents are transformed, ``spm`` of 100 of these with the
    suffix first; the draws depend on the id alone.
    """
    h = draws(F.col("doc_id"), seed)
    d = documents(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("*", chunks(F.col("text"), size).alias("parts"))
    d = d.select("*", F.transform("parts", lambda c, i: begun(c, _before("parts", i))).alias("counts"))
    d = d.select("*", F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c).alias("n"))
    marks = [F.contains("text", F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)]
    plain = (F.col("text") == "") | marks[0] | marks[1] | marks[2] | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    one, two = (x % (F.col("n") + 1) for x in h[:2])
    d = d.select("*", form.alias("form"), F.least(one, two).alias("first"), F.greatest(one, two).alias("second"))
    d = d.select("*", *(F.when(F.col("form") != "plain", _owner("counts", F.col(r))).alias(f"{r}_owner") for r in ("first", "second")))
    place = lambda r: F.when(F.col(r) >= F.col("n"), F.length("text").cast("long")).otherwise(_place("parts", f"{r}_owner", F.col(r), size))
    cut = F.col("form") != "plain"
    d = d.select("doc_id", "text", "n", "form", F.when(cut, place("first")).alias("a"), F.when(cut, place("second")).alias("b"))
    a, b = F.col("a").cast("int"), F.col("b").cast("int")
    d = d.select("doc_id", "text", "n", "form", "a", "b", F.left("text", a).alias("prefix"), F.substring("text", a + 1, b - a).alias("middle"), F.substring("text", b + 1, F.length("text")).alias("suffix"))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm_form = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm_form)
    return d.select("doc_id", "n", "form", F.col("a").alias("prefix_chars"), (F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text from its output and form alone.

    No part holds a mark, and a mark can't begin in one part and end in the
    next, so the first of each mark is the one that was put there.
    """

    def split(inner: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, F.lit(4), F.length(output))
        first = F.substring_index(body, inner, 1)
        rest = F.substring(body, F.length(first) + 4, F.length(body))
        second = F.substring_index(rest, MIDDLE, 1)
        return first, second, F.substring(rest, F.length(second) + 4, F.length(rest))

    prefix, suffix, middle = split(SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = split(PREFIX)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(prefix, middle, suffix))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    out = out.select("*", restored(F.col("output"), F.col("form")).alias("text"))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha("text").alias("restored_sha256"))


SQL13 = """WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    r AS (SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
    f AS (SELECT doc_id, text, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
    p AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM f)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(text) AS restored_sha256 FROM p"""
