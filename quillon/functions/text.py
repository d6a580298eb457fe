"""Text operators as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunks(df: DataFrame, text: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """A row per window of ``size`` characters, each ``size - overlap`` after the one before; none for empty text."""
    step = size - overlap
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    pieces = F.transform(starts, lambda s: F.substring(F.col(text), s + 1, F.lit(size)))
    return df.select("*", F.posexplode(pieces).alias("chunk_no", "chunk"))


def tokens(text: Column) -> Column:
    """Lower-cased words between white space; none for blank text."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def bm25(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text", k: int = 5, k1: float = 1.5, b: float = 0.75, eps: float = 0.25, digits: int | None = None) -> DataFrame:
    """(key, score): the k best documents by Okapi BM25 (rounded, if digits are given), ties to the smaller key.

    idf is ln((N - df + 0.5) / (df + 0.5)); a negative one counts as ``eps``
    times the mean idf of all words.  Only the query's words are counted per
    document; lengths and document frequencies are aggregates.
    """
    words = docs.select(key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    stats = words.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl"))
    freq = words.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    rated = freq.crossJoin(F.broadcast(stats.select("n"))).withColumn("idf", idf)
    mean = rated.agg(F.avg("idf").alias("mean_idf"))
    asked = [w for w in query.lower().split() if w]
    times = docs.sparkSession.createDataFrame([(w, asked.count(w)) for w in sorted(set(asked))], "term string, times int")
    wanted = rated.join(F.broadcast(times), "term").crossJoin(F.broadcast(mean))
    wanted = wanted.select("term", "times", F.when(F.col("idf") < 0, eps * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    found = words.select(key, F.size("w").alias("dl"), F.explode("w").alias("term")).join(F.broadcast(times.select("term")), "term")
    tf = found.groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))
    part = F.col("idf") * F.col("times") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    rows = tf.join(F.broadcast(wanted), "term").crossJoin(F.broadcast(stats.select("avgdl")))  # as many terms as the query has
    scores = rows.groupBy(key).agg(F.sum(part).alias("score"))
    scores = scores if digits is None else scores.withColumn("score", F.round("score", digits))
    return scores.orderBy(F.desc("score"), key).limit(k)


def keyword_in_context(text: Column, needle: str, reach: int = 200) -> Column:
    """Up to ``reach`` characters on both sides of the first match, line breaks as spaces; null without a match."""
    at = F.locate(needle.lower(), F.lower(text))
    start = F.greatest(at - reach, F.lit(1))
    end = at + len(needle) + reach
    return F.when(at > 0, F.translate(F.substring(text, start, end - start), "\n", " "))


def paragraphs(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select("*", F.posexplode(F.split(text, "\n\n")).alias("paragraph_no", "paragraph"))


def join_paragraphs(df: DataFrame, key: str, paragraph: str = "paragraph", order: str = "paragraph_no") -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(order, paragraph)))
    return df.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r[paragraph]), "\n\n").alias("text"))


# fixed values: commands whose paragraphs hold no prose, file commands, and commands whose argument is prose
_NO_PROSE = ["\\def", "\\newcommand", "\\usepackage", "\\documentclass", "\\bibliographystyle", "\\bibliography"]
_FILES = ["\\input", "\\include", "\\subfile"]
_PROSE = ["\\title", "\\section", "\\subsection", "\\subsubsection", "\\caption", "\\author"]


def worth_translating(p: Column) -> Column:
    """False for blank paragraphs, comments, definitions, figures without a caption, file commands, and a lone command whose argument isn't prose."""
    t = F.regexp_replace(p, r"^\s+|\s+$", "")
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(x, r"^\s+", "")), lambda x: x != "")
    begins = lambda c, names: reduce(or_, (F.startswith(c, F.lit(n)) for n in names))
    lone = t.rlike(r"^\\[a-zA-Z]+\{[^}]+\}$") & ~reduce(or_, (F.contains(t, F.lit(n)) for n in _PROSE))
    figure = F.startswith(t, F.lit("\\begin{figure}")) & ~F.contains(t, F.lit("\\caption"))
    comment = F.forall(lines, lambda x: F.startswith(x, F.lit("%")))
    return ~((t == "") | comment | begins(t, _NO_PROSE) | figure | F.forall(lines, lambda x: begins(x, _FILES)) | lone)


def strip_environment(p: Column) -> tuple[Column, Column, Column]:
    """(opening tag, body, closing tag) of a paragraph that begins or ends with one."""
    head = F.regexp_extract(p, r"^(\s*\\begin\{[^}]*\}(?:\[[^\]]*\])?\s*)", 1)
    rest = F.substring(p, F.length(head) + 1, F.length(p))
    tail = F.regexp_extract(rest, r"(\s*\\end\{[^}]*\}\s*)$", 1)
    return head, F.substring(rest, F.lit(1), F.length(rest) - F.length(tail)), tail


def rewrite_inputs(text: Column, suffix: str = "_ZH") -> Column:
    r"""\input{x}, \include{x.tex} and \subfile{x} name the translated file; those that do already stay."""
    return F.regexp_replace(text, rf"\\(input|include|subfile)\{{\s*((?:(?!{suffix}(?:\.tex)?\s*\}})[^}}])+?)(?:\.tex)?\s*\}}", rf"\\$1{{$2{suffix}}}")


# What an old document class needs to be set by today's programs, as patterns and their replacements in order.
_REVTEX = "\n".join([
    r"\\usepackage{graphicx}", r"\\providecommand{\\draft}{}", r"\\providecommand{\\address}[1]{\\affiliation{#1}}", r"\\newdimen\\epsfxsize",
    r"\\providecommand{\\epsffile}[2][]{\\includegraphics[width=\\epsfxsize]{#2}}", "",
])
_OLD_CLASS = [
    (r"\\documentstyle\[([^\]]*)\]\{revtex\}", r"\\documentclass[$1,twocolumn]{revtex4-2}" + "\n" + _REVTEX),
    (r"\\documentstyle\{revtex\}", r"\\documentclass[twocolumn]{revtex4-2}" + "\n" + _REVTEX),
    (r"\\twocolumn\[\s*\\hsize\s*\\textwidth\s*\\columnwidth\s*\\hsize\s*\\csname\s*@twocolumnfalse\\endcsname", ""),
    (r"\\twocolumn\[[^\]]*@twocolumnfalse\\endcsname", ""),
    (r"(\\pacs\{[^}]+\})\s*\]", "$1"),
    (r"(\\end\{abstract\})\s*\]", "$1"),
    (r"\n\s*\]\s*\n(?=\s*\\section)", "\n"),
]
_ANY_CLASS = [
    (r"\\usepackage\[[^\]]*\]\{pdfcprot\}", r"% \\usepackage{pdfcprot}"),
    (r"\\usepackage\{pdfcprot\}", r"% \\usepackage{pdfcprot}"),
    (
        r"\\pdfximage\s*\{\s*([^}]*[^}\s])\s*\}\s*\\(?:def|edef)\s*\\([a-zA-Z@]+)\s*\{\s*\\the\s*\\pdflastximagepages\s*\}",
        r"\\newcount\\$2count" + "\n" + r"\\ifx\\XeTeXpdfpagecount\\undefined" + "\n" + r"  \\pdfximage{$1}" + "\n" + r"  \\$2count=\\pdflastximagepages" + "\n" + r"\\else" + "\n"
        + r"  \\$2count=\\XeTeXpdfpagecount\"$1\"" + "\n" + r"\\fi" + "\n" + r"\\edef\\$2{\\the\\$2count}" + "\n",
    ),
]


def modern_preamble(text: Column) -> Column:
    """A document of the old class in the new one's terms, and without what other programs lack."""
    out = text
    for pattern, new in _OLD_CLASS:
        out = F.regexp_replace(out, pattern, new)
    out = F.when(F.contains(text, F.lit("\\documentstyle")), out).otherwise(text)
    for pattern, new in _ANY_CLASS:
        out = F.regexp_replace(out, pattern, new)
    return out


def space_after_macro(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\[A-Za-z]+)(?=[^\x00-\x7F])", "$1 ")


def sticky(df: DataFrame, flag: Column, order: str, by: list[str] | None = None, out: str = "after") -> DataFrame:
    """True from the first row on which the flag is set; order tells a group's rows apart."""
    from ..operators.scans import carry_forward

    return carry_forward(df, [order], {out: F.when(flag, F.lit(True))}, by).withColumn(out, F.coalesce(out, F.lit(False)))


def safe_name(text: Column, size: int = 100) -> Column:
    return F.substring(F.regexp_replace(text, "[^A-Za-z0-9]", "_"), 1, size)


def keyword_tags(text: Column, words: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w))


def classify_markdown(line: Column) -> Column:
    """heading, image, list, separator, table, blank or text."""
    t = F.trim(line)
    return (
        F.when(t == "", "blank").when(t.rlike("^#{1,6}\\s"), "heading").when(t.rlike(r"^!\[[^\]]*\]\([^)]*\)$"), "image")
        .when(t.rlike(r"^([-*+]|\d+[.])\s"), "list").when(t.rlike(r"^\|?[\s:|-]*-{3,}[\s:|-]*$"), "separator").when(t.rlike(r"^\|.*\|$"), "table")
        .otherwise("text")
    )


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(F.trim(line), "^(#{1,6})\\s", 1))


def inline_to_latex(text: Column) -> Column:
    """Bold, italic, code and links of Markdown as LaTeX."""
    out = F.regexp_replace(text, r"\*\*([^*]+)\*\*", r"\\textbf{$1}")
    out = F.regexp_replace(out, r"(?<!\*)\*([^*]+)\*(?!\*)", r"\\textit{$1}")
    out = F.regexp_replace(out, "`([^`]+)`", r"\\texttt{$1}")
    return F.regexp_replace(out, r"\[([^\]]+)\]\(([^)]+)\)", r"\\href{$2}{$1}")


def escape_latex(text: Column) -> Column:
    """Characters that LaTeX gives a meaning, as themselves."""
    held = F.replace(text, F.lit("\\"), F.lit("\x00"))  # backslashes first, as the others bring new ones
    out = F.regexp_replace(held, r"([&%$#_{}])", r"\\$1")
    for sign, name in (("~", "asciitilde"), ("^", "asciicircum"), ("\x00", "backslash")):
        out = F.replace(out, F.lit(sign), F.lit(rf"\text{name}{{}}"))
    return out


def key_value(line: Column, key: str) -> Column:
    """The value of ``key: value`` or ``key=value`` in a line, trimmed; null without it."""
    got = F.trim(F.regexp_extract(line, rf"{key}\s*[:=]\s*([^|]*)", 1))
    return F.when(got != "", got)
