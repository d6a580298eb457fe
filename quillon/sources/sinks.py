"""Writers; tables are written by Spark's writers, reports are rendered from aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .versions import Store, read_version, write_version


def write_csv(df: DataFrame, path: str, fields: list[str], mode: str = "overwrite") -> None:
    """The given fields in order; those that are missing, and nulls, are empty."""
    columns = [F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields]
    df.select(*columns).write.mode(mode).option("emptyValue", "").csv(path, header=True)


# Columns of the tables that simulations leave, in their order.
STATE = ["x", "y", "z", "px", "py", "pz"]
SERIES = ["Step", "T", "P_virial", "P_wall", "KE", "PE", "TotalE", "MSD"]
PARTICLES = [*STATE, "vx", "vy", "vz", "E", "pol_x", "pol_y", "pol_z"]
GRID = ["cell_idx", "ix", "iy", "iz", "n", "ux", "uy", "uz", "vort_x", "vort_y", "vort_z", "gn_x", "gn_y", "gn_z", "gl_x", "gl_y", "gl_z"]


def write_particles(df: DataFrame, path: str) -> None:
    """Living particles, with velocities from momenta and energies."""
    alive = df.where("alive") if "alive" in df.columns else df
    write_csv(alive.withColumns({f"v{c}": F.col(f"p{c}") / F.col("E") for c in "xyz"}), path, PARTICLES)


def write_grid(df: DataFrame, path: str, side: int) -> None:
    """Cells (cell_idx and their fields) with the three indices that follow from the number."""
    i = F.col("cell_idx")
    write_csv(df.withColumns({"ix": i % side, "iy": F.floor(i / side) % side, "iz": F.floor(i / (side * side))}), path, GRID)


def append_log(df: DataFrame, path: str, fields: list[str]) -> None:
    write_csv(df, path, fields, mode="append")


def write_text(df: DataFrame, path: str, template: str, mode: str = "append") -> None:
    """A line per row, by a printf template over all columns."""
    df.select(F.format_string(template, *df.columns)).write.mode(mode).text(path)


def write_json(df: DataFrame, path: str) -> DataFrame:
    """df as the newest version of the JSON table at path (sources.versions): readers see the old rows or the new ones."""
    return write_version(df, path, "json")


def upsert_json(df: DataFrame, path: str, key: str, order: str) -> DataFrame:
    """Merges rows into a JSON table, the latest per key, as its next version; Conflict if another writer was faster."""
    from ..operators.relations import upsert

    spark = df.sparkSession
    number, _ = Store(spark, path).read()
    old = read_version(spark, path, number) if number else df.limit(0)
    return write_version(upsert(old, df, key, order), path, "json", after=number)


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"))


def markdown_report(title: str, tables: dict[str, DataFrame], limit: int = 1000) -> str:
    """Status counts and the rows of each table (up to ``limit``, as a report is for reading)."""
    out = [f"# {title}", ""]
    for name, df in tables.items():
        out += [f"## {name}", ""]
        if "status" in df.columns:
            out += [", ".join(f"{r.status}: {r.n}" for r in status_counts(df).orderBy("status").collect()), ""]
        out += ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in df.limit(limit).collect()] + [""]
    return "\n".join(out)


def report_lines(title: str, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(section, no, line) of a Markdown report of whole tables, each in the order of a column; a table's rows never meet in one place."""
    from ..operators.scans import row_numbers

    out = None
    for section, (name, (df, order)) in enumerate(tables.items(), 1):
        head = ([f"# {title}", ""] if section == 1 else []) + [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        cells = [F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in df.columns]
        rows = row_numbers(df.withColumn("__line", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))), order, "__no")
        lines = rows.select(F.lit(section).alias("section"), F.col("__no").cast("long").alias("no"), F.col("__line").alias("line"))
        first = df.sparkSession.createDataFrame([(section, i - len(head), line) for i, line in enumerate(head)], "section int, no long, line string")
        part = first.unionByName(lines)
        out = part if out is None else out.unionByName(part)
    return out


def write_report(lines: DataFrame, path: str) -> None:
    """The report as text files, in their names' order."""
    lines.repartitionByRange("section", "no").sortWithinPartitions("section", "no").select("line").write.mode("overwrite").text(path)


def markdown_to_latex(lines: DataFrame, order: str = "line", text: str = "text") -> DataFrame:
    """(line, kind, latex) of Markdown lines; headings, images, list items, tables and inline marks are translated."""
    from ..functions.text import classify_markdown, escape_latex, heading_level, inline_to_latex

    kind, level = classify_markdown(F.col(text)), heading_level(F.col(text))
    body = inline_to_latex(escape_latex(F.trim(F.regexp_replace(F.trim(F.col(text)), r"^(#{1,6}|[-*+]|\d+[.])\s+", ""))))
    section = F.when(level == 1, "section").when(level == 2, "subsection").when(level == 3, "subsubsection").otherwise("paragraph")
    image = F.regexp_extract(text, r"!\[[^\]]*\]\(([^)]*)\)", 1)
    cells = F.array_join(F.transform(F.split(F.regexp_replace(F.trim(F.col(text)), r"^\||\|$", ""), r"\|"), lambda c: escape_latex(F.trim(c))), " & ")
    latex = (
        F.when(kind == "heading", F.concat(F.lit("\\"), section, F.lit("{"), body, F.lit("}"))).when(kind == "image", F.concat(F.lit("\\includegraphics{"), image, F.lit("}")))
        .when(kind == "list", F.concat(F.lit("\\item "), body)).when(kind == "table", F.concat(cells, F.lit(" \\\\"))).when(kind == "separator", F.lit("\\hline"))
        .otherwise(body)
    )
    return lines.select(order, kind.alias("kind"), latex.alias("latex"))
