"""Plain text, Markdown and Word files as rows of documents and blocks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.runs import RUN
from ..functions.text import let
from ..operators.structure import running_totals
from .html import RUNS

BLOCK_SCHEMA = "ord long, kind string, level long, depth long, ordered boolean, number long, lang string, callout_kind string, row_idx long, cell_idx long, colspan long, rowspan long, text string"
BLOCK_NAMES = [f.split(" ")[0] for f in BLOCK_SCHEMA.split(", ")]
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
NOTE_KINDS = {"NOTE": "note", "TIP": "info", "INFO": "info", "IMPORTANT": "note", "WARNING": "warning", "CAUTION": "warning"}
ITEM = re.compile(r"^(\s*)(?:([-*+])|(\d{1,9})[.)])\s+(.*)$")
RULE = re.compile(r"^\s{0,3}(?:(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,})$")
TABLE_RULE = re.compile(r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)*\|?\s*$")
HEADING = re.compile(r"^\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$")
DATE_LINE = re.compile(r"^\d{4}\s*\.\s*\d{1,2}\s*\.\s*\d{1,2}\s*\.?$")


def read_texts(spark: SparkSession, path: str, suffix: str = "*") -> DataFrame:
    """Whole files as rows: path, name, format, text. Format is markdown for .md and for text that looks like it."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").text(path)
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    markdown = F.lower(name).rlike(r"\.(md|markdown)$") | T.looks_like_markdown(F.col("value"))
    return files.select(F.col("_metadata.file_path").alias("path"), name.alias("name"), F.when(markdown, "markdown").otherwise("text").alias("format"), F.col("value").alias("text"))


def read_word_files(spark: SparkSession, path: str) -> DataFrame:
    """Word files below a folder: path, doc, content, reason. Lock files are left out; a file that is no zip archive
    has no content and a reason, and the others go on. ``doc`` numbers them by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.docx").load(path)
    real = files.where(~F.element_at(F.split("path", "/"), -1).startswith("~$"))
    zipped = F.substring("content", 1, 2) == F.lit(b"PK")
    # the file names alone are numbered, range by range
    numbered = running_totals(real.select("path"), ["path"], F.lit(1), "__before")
    return real.join(numbered, "path").select("path", F.format_string("doc%03d", F.col("__before") + 1).alias("doc"), F.when(zipped, F.col("content")).alias("content"), F.when(~zipped, "not a Word file (protected or damaged)").alias("reason"))


TABLE_ROW, FENCE = r"^\s*\|.*\|\s*$", r"^\s*(?:```|~~~)"


def literal_line(line: Column) -> Column:
    """A line whose leading mark Markdown would take as a list or quote, with that mark escaped."""
    return F.regexp_replace(F.regexp_replace(T.strip(line), r"^([-*+>#])(\s+)", r"\\$1$2"), r"^(\d{1,9})([.)])(\s+)", r"$1\\$2$3")


def tab_table(rows: Column) -> Column:
    """Tab-separated lines as a Markdown table: the first is the header, later ones are filled up to its width."""
    cells = lambda line: F.transform(F.split(line, "\t", -1), lambda c: F.replace(T.strip(c), F.lit("|"), F.lit("\\|")))

    def table(parts: Column) -> Column:
        width = F.size(F.get(parts, 0))
        row = lambda c: F.concat(F.lit("| "), F.array_join(F.concat(c, F.array_repeat(F.lit(""), F.greatest(width - F.size(c), F.lit(0)))), " | "), F.lit(" |"))
        return F.array_join(F.concat(F.array(row(F.get(parts, 0)), F.concat(F.lit("|"), F.repeat(F.lit("---|"), width))), F.transform(F.slice(parts, F.lit(2), F.size(parts)), row)), "\n")

    return let(F.transform(rows, cells), table)


def plain_to_markdown(text: Column) -> Column:
    """Plain text as Markdown, a fold over its lines.

    Each line is a paragraph of its own, its leading mark escaped. Two lines or more with tabs, none with more than
    the first, are a table; rows between bars stay together; fenced lines stay as they are.
    """
    names = ("units", "block", "width", "fence")
    state = lambda *v: F.struct(*[c.alias(n) for c, n in zip(v, names, strict=True)])
    none, zero = F.array().cast("array<string>"), F.lit(0)
    put = lambda units, unit: F.concat(units, F.array(unit))
    join_last = lambda units, line: F.concat(F.slice(units, F.lit(1), F.size(units) - 1), F.array(F.concat(F.element_at(units, -1), F.lit("\n"), line)))

    def closed(a: Column) -> Column:
        n = F.size(a["block"])
        return F.when(n == 0, a["units"]).when(n == 1, put(a["units"], literal_line(F.get(a["block"], 0)))).otherwise(put(a["units"], tab_table(a["block"])))

    def step(a: Column, line: Column) -> Column:
        def placed(x: Column) -> Column:
            units, tabs = x["units"], x["tabs"]
            fence, blank = line.rlike(FENCE), T.is_blank(line)
            goes_on = ~a["fence"] & (F.size(a["block"]) > 0) & ~blank & tabs.between(1, a["width"])
            after_row = (F.size(units) > 0) & F.element_at(F.concat(F.array(F.lit("")), units), -1).rlike(r"\|\s*$")
            return (
                F.when(a["fence"], state(join_last(units, line), none, zero, ~fence))
                .when(goes_on, state(a["units"], put(a["block"], line), a["width"], F.lit(False)))
                .when(fence, state(put(units, line), none, zero, F.lit(True)))
                .when(blank, state(units, none, zero, F.lit(False)))
                .when(tabs > 0, state(units, F.array(line), tabs, F.lit(False)))
                .when(line.rlike(TABLE_ROW), state(F.when(after_row, join_last(units, line)).otherwise(put(units, line)), none, zero, F.lit(False)))
                .otherwise(state(put(units, literal_line(line)), none, zero, F.lit(False)))
            )

        return let(F.struct(F.when(a["fence"], a["units"]).otherwise(closed(a)).alias("units"), F.regexp_count(line, F.lit("\t")).alias("tabs")), placed)

    lines = F.split(F.regexp_replace(T.filled(text), "\r\n?", "\n"), "\n", -1)
    return F.array_join(F.aggregate(lines, state(none, none, zero, F.lit(False)), step, closed), "\n\n")


def plain_title(text: Column) -> Column:
    """The title of a plain text: a short first line right above a date line; else null."""
    visible = F.filter(T.lines(text), lambda line: ~T.is_blank(line))
    first, second = T.strip(F.try_element_at(visible, F.lit(1))), F.try_element_at(visible, F.lit(2))
    return F.when((F.char_length(first) <= 60) & T.is_date_line(second) & T.typed_marker(first).isNull(), first)


def markdown_blocks(text: str) -> list[tuple]:
    """Blocks of a Markdown text: headings, items, tables, fences, quotes, rules and paragraphs in order."""
    out: list[tuple] = []
    lines, i, para = text.split("\n"), 0, []

    def add(kind: str, body: str = "", **more) -> None:
        out.append((len(out) + 1, kind, *(more.get(k) for k in BLOCK_NAMES[2:-1]), body))

    def end() -> None:
        if para:
            body = " ".join(x.strip() for x in para)
            note = re.match(r"^\[!(\w+)\]\s*", body)
            if note and note.group(1).upper() in NOTE_KINDS:
                add("callout", body[note.end() :], callout_kind=NOTE_KINDS[note.group(1).upper()])
            else:
                add("paragraph", body)
            para.clear()

    while i < len(lines):
        line = lines[i]
        fence = re.match(r"^\s{0,3}(```+|~~~+)\s*(\S*)", line)
        if fence:
            end()
            body, i = [], i + 1
            while i < len(lines) and not lines[i].strip().startswith(fence.group(1)):
                body.append(lines[i])
                i += 1
            add("code", "\n".join(body), lang=fence.group(2) or None)
        elif not line.strip():
            end()
        elif m := HEADING.match(line):
            end()
            add("heading", m.group(2), level=len(m.group(1)))
        elif RULE.match(line) and not para:
            add("hr")
        elif "|" in line and i + 1 < len(lines) and TABLE_RULE.match(lines[i + 1]) and "-" in lines[i + 1]:
            end()
            rows = [line]
            i += 2
            while i < len(lines) and "|" in lines[i] and lines[i].strip():
                rows.append(lines[i])
                i += 1
            i -= 1
            for r, row in enumerate(rows):
                cells = re.split(r"(?<!\\)\|", row.strip().removeprefix("|").removesuffix("|"))
                for c, cell in enumerate(cells):
                    add("cell", cell.strip().replace("\\|", "|"), row_idx=r, cell_idx=c, colspan=1, rowspan=1, level=1 if r == 0 else None)
        elif line.lstrip().startswith(">"):
            end()
            add("callout", line.lstrip()[1:].strip(), callout_kind="quote")
        elif (m := ITEM.match(line)) and not DATE_LINE.match(line.strip()):
            end()
            add("item", m.group(4).strip(), depth=len(m.group(1).expandtabs(4)) // 2, ordered=m.group(3) is not None, number=int(m.group(3)) if m.group(3) else None)
        else:
            para.append(line)
        i += 1
    end()
    return out


def word_blocks(content: bytes) -> list[tuple]:
    """Blocks of a Word file: headings by style, numbered items, table cells with their spans, paragraphs."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    out: list[tuple] = []

    def add(kind: str, text: str, **more) -> None:
        out.append((len(out) + 1, kind, *(more.get(k) for k in BLOCK_NAMES[2:-1]), text))

    def text_of(p) -> str:
        parts = {f"{W}t": lambda e: e.text or "", f"{W}tab": lambda e: "\t", f"{W}br": lambda e: "\n"}
        gone = {id(x) for d in p.iter(f"{W}del") for x in d.iter()}
        return "".join(parts[e.tag](e) for e in p.iter() if e.tag in parts and id(e) not in gone)

    def value(node, name: str) -> str | None:
        found = node.find(f".//{W}{name}")
        return None if found is None else found.get(f"{W}val", "")

    def table(t) -> None:
        merged: dict[int, int] = {}
        rows = t.findall(f"{W}tr")
        for r, row in enumerate(rows):
            column = 0
            for c, cell in enumerate(row.findall(f"{W}tc")):
                props = cell.find(f"{W}tcPr")
                span = int((value(props, "gridSpan") if props is not None else None) or 1)
                merge = None if props is None else props.find(f"{W}vMerge")
                if merge is not None and merge.get(f"{W}val") != "restart" and column in merged:
                    at = merged[column]
                    out[at] = (*out[at][:11], out[at][11] + 1, *out[at][12:])
                else:
                    if merge is not None:
                        merged[column] = len(out)
                    add("cell", "\n".join(text_of(p) for p in cell.findall(f"{W}p")), row_idx=r, cell_idx=c, colspan=span, rowspan=1)
                column += span

    for node in body if body is not None else []:
        if node.tag == f"{W}tbl":
            table(node)
        elif node.tag == f"{W}p":
            style, text = value(node, "pStyle") or "", text_of(node)
            heading = re.match(r"(?i)heading\s*(\d)", style)
            if style.lower() == "title":
                add("title", text)
            elif heading:
                add("heading", text, level=int(heading.group(1)))
            elif node.find(f".//{W}numPr") is not None:
                add("item", text, depth=int(value(node, "ilvl") or 0), ordered=True)
            else:
                add("paragraph" if text.strip() else "blank", text)
    return out


def blocks_of(docs: DataFrame, id_col: str, payload: str, parse) -> DataFrame:
    """A row for each block of each document, by a parser from one payload to block tuples; broken payloads give none."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
        kinds = [types[f.split(" ")[1]] for f in BLOCK_SCHEMA.split(", ")]
        for batch in batches:
            ids, rows = [], []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = parse(value) if value else []
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    found = []
                ids += [key] * len(found)
                rows += found
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=[id_col, *BLOCK_NAMES])

    return docs.select(id_col, payload).mapInArrow(run, f"{id_col} {id_type}, {BLOCK_SCHEMA}")


def read_markdown(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return blocks_of(docs, id_col, text_col, markdown_blocks)


def read_word(docs: DataFrame, id_col: str = "doc", content_col: str = "content") -> DataFrame:
    return blocks_of(docs, id_col, content_col, word_blocks)


#: Inline marks of Markdown in the order in which they are tried: escapes, code, images, links, line ends, emphasis.
INLINE = re.compile(r"\\([!-/:-@\[-`{-~])|(`+)(.+?)(?<!`)\2(?!`)|!\[([^\]]*)\]\(([^()\s]*)\)|\[((?:\\.|[^\[\]\\])*)\]\(([^()\s]*)\)|(<br\s*/?>|  +\n)|(\n)|(\*+|_+|~~)", re.I | re.S)


def markdown_runs(text: str) -> list[tuple]:
    """Runs (text, bold, italic, code, href) of a Markdown line. Marks of emphasis open before a character that is no
    white space and close after one; such a mark without a partner is text. A soft line end is a space, a hard one stays."""
    pieces: list[list] = []  # [text, code, href, mark]; a mark: may open, may close

    def read(part: str, href: str | None) -> None:
        at = 0
        for m in INLINE.finditer(part):
            if m.start() > at:
                pieces.append([part[at : m.start()], False, href, None])
            at = m.end()
            if m[1]:
                pieces.append([m[1], False, href, None])
            elif m[2]:
                pieces.append([m[3], True, href, None])
            elif m[5] is not None:
                pass  # an image is no text
            elif m[7] is not None:
                read(m[6], m[7])
            elif m[8] or m[9]:
                pieces.append(["\n" if m[8] else " ", False, href, None])
            else:
                before, after = part[m.start() - 1 : m.start()] if m.start() else "", part[m.end() : m.end() + 1]
                inside = m[0][0] == "_" and before.isalnum() and after.isalnum()
                pieces.append([m[0], False, href, None if inside else (bool(after.strip()), bool(before.strip()))])
        if at < len(part):
            pieces.append([part[at:], False, href, None])

    read(text, None)
    bold, italic, waiting = [0] * len(pieces), [0] * len(pieces), []
    for i, piece in enumerate(pieces):
        if piece[3] is None:
            continue
        opens, closes = piece[3]
        while closes and piece[0] and (own := [j for j in waiting if pieces[j][0][:1] == piece[0][0]]):
            j = own[-1]
            n = 2 if min(len(pieces[j][0]), len(piece[0])) > 1 else 1
            for k in range(j + 1, i):
                styled = bold if n == 2 and piece[0][0] != "~" else italic
                styled[k] += 1
            pieces[j][0], piece[0] = pieces[j][0][n:], piece[0][n:]
            del waiting[waiting.index(j) + 1 :]
            if not pieces[j][0]:
                waiting.remove(j)
        if opens and piece[0]:
            waiting.append(i)
    out = [(said, bold[i] > 0, italic[i] > 0, code, href) for i, (said, code, href, _) in enumerate(pieces)]
    joined: list[tuple] = []
    for said, *style in out:
        if joined and list(joined[-1][1:]) == style:
            joined[-1] = (joined[-1][0] + said, *style)
        elif said:
            joined.append((said, *style))
    return joined


def with_runs(rows: DataFrame, text_col: str, runs_col: str = "runs") -> DataFrame:
    """``rows`` with the styled runs of a column of Markdown lines; null gives none."""

    @F.arrow_udf(f"array<{RUN}>")
    def parsed(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("text", "bold", "italic", "code", "href"), r, strict=True)) for r in markdown_runs(t.as_py() or "")] for t in texts], RUNS)

    return rows.withColumn(runs_col, parsed(F.col(text_col)))
