"""Markdown documents as LaTeX: nested lists and tables from the order of the lines.

A document's lines are dealt to a task in their order, and a state goes along
them: the open lists (indent and kind) and whether a table is open.  A task holds
a line and the state, whatever the documents' number or length.

* An item deeper than the innermost list opens one; a shallower one closes lists down to its indent; another kind at the same indent closes and opens.
* Headings, images and text that isn't indented beyond the innermost list close all lists; indented text goes on with the item; blank lines and table rows leave lists open.
* A line with ``|`` is a table row, ruled rows are left out; any other line but an item closes the table.
* Mathematics between dollars stays as it is; code, bold and italic text are escaped within their commands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_ITEM = re.compile(r"(\s*)([*-]|\d+\.)\s+(.*)")
_HEADING = re.compile(r"(#+)\s+(.*)")
_IMAGE = re.compile(r"!\[(.*?)\]\((.*?)\)")
_RULE = re.compile(r"[|\s:-]+")
_INLINE = re.compile(r"(?P<math>\$.*?\$)|`(?P<code>[^`]+)`|\*\*(?P<bold>[^*]+)\*\*|\*(?P<italic>[^*]+)\*")
_COMMAND = {"code": "texttt", "bold": "textbf", "italic": "textit"}
# What LaTeX gives a meaning, as itself.
_ESCAPE = {c: f"\\{c}" for c in "&%$#_{}"} | {"~": "\\textasciitilde{}", "^": "\\textasciicircum{}", "\\": "\\textbackslash{}"}


def escaped(text: str) -> str:
    return "".join(_ESCAPE.get(c, c) for c in text)


def inline(text: str) -> str:
    out, at = [], 0
    for m in _INLINE.finditer(text):
        out.append(escaped(text[at : m.start()]))
        kind = m.lastgroup
        out.append(m["math"] if kind == "math" else f"\\{_COMMAND[kind]}{{{escaped(m[kind])}}}")
        at = m.end()
    return "".join([*out, escaped(text[at:])])


class Document:
    """The state along a document's lines; every method gives the LaTeX lines that it adds, each with its kind."""

    def __init__(self):
        self.lists: list[tuple[int, str]] = []
        self.table = False

    def _close(self, beyond: int = -1) -> Iterator[tuple[str, str]]:
        while self.lists and self.lists[-1][0] > beyond:
            yield "end", f"\\end{{{self.lists.pop()[1]}}}"

    def _item(self, indent: int, kind: str) -> Iterator[tuple[str, str]]:
        yield from self._close(indent)
        if self.lists and self.lists[-1] != (indent, kind) and self.lists[-1][0] == indent:
            yield from self._close(indent - 1)
        if not self.lists or self.lists[-1][0] < indent:
            self.lists.append((indent, kind))
            yield "begin", f"\\begin{{{kind}}}"

    def line(self, text: str) -> Iterator[tuple[str, str]]:
        item, heading, image = _ITEM.match(text), _HEADING.match(text), _IMAGE.search(text)
        row = "|" in text and not text.strip().startswith("---")
        if item:
            yield from self._item(len(item[1]), "itemize" if item[2] in "*-" else "enumerate")
            yield "item", f"\\item {inline(item[3])}"
            return
        if self.lists and text.strip():
            if image or heading:
                yield from self._close()
            elif not row:
                if len(text) - len(text.lstrip()) > self.lists[-1][0]:
                    yield "more", inline(text.strip())
                    return
                yield from self._close()
        if self.table and not row:
            self.table = False
            yield "end", "\\end{longtable}"
        if heading:
            yield "heading", f"\\{'subsection' if len(heading[1]) == 1 else 'subsubsection'}{{{inline(heading[2])}}}"
        elif image:
            yield "image", f"\\begin{{figure}}[h]\\centering\\includegraphics[width=0.8\\textwidth]{{{image[2].strip('<>')}}}\\caption{{{inline(image[1])}}}\\end{{figure}}"
        elif row:
            if not _RULE.fullmatch(text):
                cells = [inline(c.strip()) for c in text.strip("|").split("|")]
                if not self.table:
                    self.table = True
                    yield "begin", f"\\begin{{longtable}}{{{'|'.join('l' * len(cells))}}}\\hline"
                yield "row", " & ".join(cells) + " \\\\ \\hline"
        else:
            yield ("text", inline(text)) if text.strip() else ("blank", "")

    def end(self) -> Iterator[tuple[str, str]]:
        yield from self._close()
        if self.table:
            self.table = False
            yield "end", "\\end{longtable}"


def _along(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    state, doc, no = None, None, 0
    for frame in frames:
        out = []
        for key, text in zip(frame["key"].tolist(), frame["text"].tolist()):
            if state is None or key != doc:
                if state:
                    for kind, latex in state.end():
                        out.append((doc, no, kind, latex))
                        no += 1
                state, doc, no = Document(), key, 0
            for kind, latex in state.line(text or ""):
                out.append((key, no, kind, latex))
                no += 1
        yield pd.DataFrame(out, columns=["key", "no", "kind", "latex"])
    if state:
        yield pd.DataFrame([(doc, no + i, kind, latex) for i, (kind, latex) in enumerate(state.end())], columns=["key", "no", "kind", "latex"])


def documents_to_latex(lines: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """(key, no, kind, latex) of Markdown lines, by document (a key that isn't null) and in order."""
    rows = lines.selectExpr(f"cast(`{key}` as string) as key", f"`{order}` as line", f"`{text}` as text")
    return rows.repartition("key").sortWithinPartitions("key", "line").select("key", "text").mapInPandas(_along, "key string, no long, kind string, latex string")
