"""Readers of the text, CSV and JSON formats; every one returns typed columns with nulls in place of sentinels."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.scans import places


def edge_list(spark: SparkSession, path: str) -> DataFrame:
    """Both directions of the pairs in a text file; blank lines and those that begin with # are skipped."""
    from ..operators.graph import undirected

    rows = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#')")
    parts = F.split("value", r"\s+")
    return undirected(rows.select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst")))


def vertex_count(edges: DataFrame) -> int:
    return (edges.agg(F.max(F.greatest("src", "dst"))).first()[0] or -1) + 1


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, named by the header."""
    return spark.read.csv(path, header=True, inferSchema=False)


def csv_typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(positions, momenta) of a table of particles, whatever other columns its header names."""
    rows = csv_rows(spark, path).select(*(F.col(c).try_cast("double").alias(c) for c in ("x", "y", "z", "px", "py", "pz")))
    return rows.select("x", "y", "z"), rows.select("px", "py", "pz")


def environment(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of ``key=value`` lines, quotes around values left out; of repeated keys the last; # begins a comment line."""
    lines = numbered_records(spark, path).select("file", "line", F.trim("value").alias("v")).where("not startswith(v, '#') and contains(v, '=')")
    pair = F.split("v", "=", 2)
    value = F.regexp_replace(F.trim(pair[1]), "^'+|'+$", "")
    rows = lines.select(F.trim(pair[0]).alias("key"), F.regexp_replace(value, '^"+|"+$', "").alias("value"), F.struct("file", "line").alias("o"))
    return rows.groupBy("key").agg(F.max_by("value", "o").alias("value"))


def numbered_records(spark: SparkSession, path: str, separator: str | None = None, number: str = "line", skip_blank: bool = False) -> DataFrame:
    """(file, number, value) of the records of text files, lines unless a separator is given; numbers count from 0 within each file.

    Spark's reader cuts the records, so a file of several splits is read by several tasks;
    a record's place is that of its split and its place therein.
    """
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    rows = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__at"), "value")
    rows = rows.where(F.trim(F.regexp_replace("value", r"\s", " ")) != "") if skip_blank else rows
    return places(rows, ["file"], ["__start", "__at"], number).select("file", F.col(number).cast("long").alias(number), "value")


def numeric_log(spark: SparkSession, path: str, names: list[str], skip: int = 1) -> DataFrame:
    """(file, line, columns) of numbers between white space; ``skip`` lines at each file's start and comments are left out."""
    lines = numbered_records(spark, path).where(F.col("line") >= skip)
    lines = lines.select("file", "line", F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#')")
    parts = F.split("value", r"\s+")
    return lines.select("file", "line", *(F.get(parts, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)))


def log_header(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(file, value) of each file's last ``key: value`` line."""
    lines = numbered_records(spark, path).where(F.contains("value", F.lit(f"{key}:")))
    return lines.groupBy("file").agg(F.max_by(F.trim(F.regexp_extract("value", rf"{key}:\s*(.*)", 1)), "line").alias("value"))


def key_value_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, key, value) of lines such as ``a=1 | b=2``."""
    lines = numbered_records(spark, path).where(F.contains("value", F.lit("=")))
    pairs = lines.select("file", "line", F.explode(F.split("value", r"\|")).alias("p"))
    return pairs.select("file", "line", F.trim(F.element_at(F.split("p", "=", 2), 1)).alias("key"), F.trim(F.try_element_at(F.split("p", "=", 2), F.lit(2))).alias("value"))


def all_matches(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """Numbers that each match of a pattern captures, in the file's order."""
    text = spark.read.text(path, wholetext=True)
    groups = F.arrays_zip(*(F.regexp_extract_all("value", F.lit(pattern), F.lit(i + 1)).alias(n) for i, n in enumerate(names)))
    return text.select(F.posexplode(groups).alias("match", "m")).select("match", *(F.col("m").getField(name).try_cast("double").alias(name) for name in names))


def final_values(lines: DataFrame, names: list[str], column: str = "value", order: str = "line") -> DataFrame:
    """FINAL_<name> numbers of a program's output, the last of each by the lines' order."""
    pattern = r"FINAL_(\w+)\s*[:=]\s*([-+0-9.eE]+)"
    rows = lines.select(F.col(order).alias("o"), F.regexp_extract(column, pattern, 1).alias("k"), F.regexp_extract(column, pattern, 2).try_cast("double").alias("v"))
    return rows.agg(*(F.max_by("v", F.when((F.col("k") == n) & F.col("v").isNotNull(), F.col("o"))).alias(n) for n in names))


def dump_frames(spark: SparkSession, path: str) -> DataFrame:
    """(file, frame, step, names, body): a row per frame of dump files, numbered within each file."""
    frames = numbered_records(spark, path, "ITEM: TIMESTEP", "frame", skip_blank=True)
    step = F.regexp_extract("value", r"^\s*(\d+)", 1).try_cast("long")
    names = F.split(F.trim(F.regexp_extract("value", r"ITEM: ATOMS([^\n]*)", 1)), r"\s+")
    body = F.regexp_extract("value", r"ITEM: ATOMS[^\n]*\n((?s:.*?))(?=ITEM: |\z)", 1)
    return frames.select("file", "frame", step.alias("step"), names.alias("names"), body.alias("body"))


def dump_atoms(frames: DataFrame) -> DataFrame:
    """(file, frame, step, line, atom): fields as a map by the frame's own column names."""
    atoms = frames.select("file", "frame", "step", "names", F.posexplode(F.split("body", "\n")).alias("line", "value")).where(F.trim("value") != "")
    return atoms.select("file", "frame", "step", "line", F.map_from_arrays("names", F.slice(F.split(F.trim("value"), r"\s+"), F.lit(1), F.size("names"))).alias("atom"))


def lammps_dump(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of each file's last frame."""
    frames = dump_frames(spark, path)
    last = frames.groupBy("file").agg(F.max("frame").alias("frame"))
    return dump_atoms(frames.join(last, ["file", "frame"]))


def lammps_rdf(spark: SparkSession, path: str, last: int = 150) -> DataFrame:
    """(file, line, r, g) of each profile file's last rows; comments and frame headers of two words are skipped."""
    lines = numbered_records(spark, path).select("file", "line", F.split(F.trim("value"), r"\s+").alias("p"), F.trim("value").alias("value"))
    lines = lines.where("value <> '' and not startswith(value, '#')").where(F.size("p") > 2)
    back = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("line")))  # each task sends ``last`` rows a file
    tail = lines.withColumn("__k", back).where(F.col("__k") <= last)
    return tail.select("file", "line", F.col("p")[1].try_cast("double").alias("r"), F.col("p")[2].try_cast("double").alias("g"))


def json_documents(spark: SparkSession, path: str, schema: str, defaults: dict[str, str]) -> DataFrame:
    """A JSON list of records; fields that are missing get their defaults."""
    rows = spark.read.json(path, schema=schema, multiLine=True)
    return rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def scan_folder(spark: SparkSession, path: str, extension: str, keywords: list[str], known: DataFrame | None = None) -> DataFrame:
    """(path, name, length, tags) of the files with an extension and at least one keyword in their name, but for known paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{extension}").load(path)
    files = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    tags = F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower("name"), k))
    files = files.withColumn("tags", tags).where(F.size("tags") > 0)
    return files if known is None else files.join(known.select("path"), "path", "left_anti")


def largest_first(files: DataFrame, suffix: str | None = None) -> DataFrame:
    """Files by falling size, those with a suffix left out."""
    rows = files if suffix is None else files.where(~F.endswith("name", F.lit(suffix)))
    return rows.orderBy(F.desc("length"), "path")


def unpacked(frames: Iterator[pd.DataFrame], extension: str = ".tex") -> Iterator[pd.DataFrame]:
    """Members of the archives (path, content), one at a time as they stream by."""
    import io
    import posixpath
    import tarfile

    for frame in frames:
        for path, content in zip(frame["path"], frame["content"]):
            with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as tar:
                for m in tar:
                    if m.isfile() and m.name.endswith(extension):
                        text = tar.extractfile(m).read().decode("utf-8", "replace")
                        yield pd.DataFrame({"archive": [path], "member": [posixpath.normpath(m.name)], "size": [m.size], "text": [text]})


def archive_members(spark: SparkSession, path: str, extension: str = ".tex") -> DataFrame:
    """(archive, member, size, text) of the members of tar.gz files; archives are dealt to tasks of their own."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(lambda frames: unpacked(frames, extension), "archive string, member string, size long, text string")


def main_members(members: DataFrame, mark: str = "\\begin{document}", without: str = "_ZH.tex") -> DataFrame:
    """Each archive's main member: the largest at the root that holds the mark, else the largest anywhere that does, else the largest."""
    there = F.contains("text", F.lit(mark))
    rank = F.when(there & ~F.contains("member", F.lit("/")), 0).when(there, 1).otherwise(2)
    rows = members.where(~F.endswith("member", F.lit(without)))
    best = F.min_by(F.struct("member", "size", "text"), F.struct(rank, -F.col("size"), "member"))
    return rows.groupBy("archive").agg(best.alias("m")).select("archive", "m.member", "m.size", "m.text")


def first_pages(df: DataFrame, text: str = "text", limit: int = 6000, out: str = "head", extract: Column | None = None) -> DataFrame:
    """The beginning of each text; ``extract`` (a column, for instance a pandas UDF over content) makes the text from a file's bytes."""
    return df.withColumn(out, F.left(F.coalesce(F.col(text) if extract is None else extract, F.lit("")), F.lit(limit)))


def relevant_papers(df: DataFrame, word: str) -> DataFrame:
    """Search results with an identifier or the word in title or summary."""
    hit = F.contains(F.lower(F.concat_ws(" ", "title", "summary")), F.lit(word))
    return df.where(F.coalesce(F.col("arxiv_id") != "", F.lit(False)) | F.coalesce(hit, F.lit(False)))


_ENTRY = "title string, summary string, published string, id string, author array<struct<name: string>>, link array<struct<_title: string, _type: string, _href: string>>"


def feed_entries(responses: DataFrame, xml: str = "xml") -> DataFrame:
    """Saved feeds' entries: the given columns and entry, title, summary, authors, published, pdf_url, with defaults for what is missing."""
    feed = F.from_xml(F.col(xml), f"entry array<struct<{', '.join(f.replace(' ', ': ', 1) for f in _fields(_ENTRY))}>>", {"ignoreNamespace": "true"})
    e = responses.withColumn("__feed", feed).select(*responses.columns, F.posexplode("__feed.entry").alias("entry", "__e"))
    line = lambda c, none: F.coalesce(F.translate(F.trim(F.regexp_replace(F.col(f"__e.{c}"), r"^\s+|\s+$", "")), "\n", " "), F.lit(none))
    links = F.filter("__e.link", lambda x: (x["_title"] == "pdf") | (x["_type"] == "application/pdf"))
    pdf = F.element_at(F.transform(links, lambda x: x["_href"]), -1)
    made = F.concat(F.replace(F.col("__e.id"), F.lit("abs"), F.lit("pdf")), F.lit(".pdf"))
    return e.select(
        *responses.columns, "entry", line("title", "No Title").alias("title"), line("summary", "No Summary").alias("summary"),
        F.coalesce(F.transform("__e.author", lambda a: a["name"]), F.array().cast("array<string>")).alias("authors"), F.coalesce(F.left(F.col("__e.published"), F.lit(10)), F.lit("Unknown")).alias("published"),
        F.coalesce(F.when(F.size(links) > 0, pdf), made, F.lit("")).alias("pdf_url"),
    )


def _fields(schema: str) -> list[str]:
    """The top-level fields of a schema text."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [f.strip() for f in out]


def resolve_case(name: str, folders: list[str], exists) -> str | None:
    """The first of name, folder/name and folder/name.json that exists."""
    for p in [name, *(f"{d}/{name}{end}" for d in folders for end in ("", ".json"))]:
        if exists(p):
            return p
    return None


def last_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The n rows of the highest order: each task sends its own n."""
    return df.orderBy(F.desc(order)).limit(n)
