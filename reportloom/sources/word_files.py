"""Word files from block rows, and measurement rows from Word files; standard library only."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import stats as S
from .text_files import W

# The parts of a package that Word opens.
CONTENT_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
RELATIONS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
NAMESPACE = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DXA_PER_MM = 56.6929
INDENT_DXA = 400


def paragraph(text: str, props: str = "") -> str:
    lines = [f'<w:t xml:space="preserve">{escape(line)}</w:t>' for line in text.split("\n")]
    return f"<w:p><w:pPr>{props}</w:pPr><w:r>{'<w:br/>'.join(lines)}</w:r></w:p>"


def body_of(blocks: list[dict]) -> str:
    """The body of a document from its blocks in order; runs of cells become tables."""
    out, i = [], 0
    while i < len(blocks):
        b = blocks[i]
        text = b["text"] or ""
        if b["kind"] == "cell":
            rows: list[list[str]] = []
            last = -1
            while i < len(blocks) and blocks[i]["kind"] == "cell" and (blocks[i]["row_idx"] or 0) >= last:
                last = blocks[i]["row_idx"] or 0
                while len(rows) <= last:
                    rows.append([])
                span, down = blocks[i]["colspan"] or 1, blocks[i]["rowspan"] or 1
                props = (f'<w:gridSpan w:val="{span}"/>' if span > 1 else "") + ('<w:vMerge w:val="restart"/>' if down > 1 else "")
                rows[last].append(f"<w:tc><w:tcPr>{props}</w:tcPr>{paragraph(blocks[i]['text'] or '')}</w:tc>")
                i += 1
            out.append("<w:tbl>" + "".join(f"<w:tr>{''.join(r)}</w:tr>" for r in rows if r) + "</w:tbl>")
            continue
        if b["kind"] == "heading":
            out.append(paragraph(text, f'<w:pStyle w:val="Heading{b["level"] or 1}"/>'))
        elif b["kind"] == "title":
            out.append(paragraph(text, '<w:pStyle w:val="Title"/>'))
        elif b["kind"] == "item":
            depth = b["depth"] or 0
            out.append(paragraph(text, f'<w:numPr><w:ilvl w:val="{depth}"/></w:numPr><w:ind w:left="{depth * INDENT_DXA}"/>'))
        elif b["kind"] == "page_break":
            out.append('<w:p><w:r><w:br w:type="page"/></w:r></w:p>')
        else:
            out.append(paragraph(text))
        i += 1
    return "".join(out)


def package(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in (("[Content_Types].xml", CONTENT_TYPES), ("_rels/.rels", RELATIONS), ("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document {NAMESPACE}><w:body>{body}</w:body></w:document>')):
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), content)
    return out.getvalue()


def to_word(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One Word file for each document: id, content. A document's blocks are one group, as its file is."""
    fields = ["ord", "kind", "level", "depth", "row_idx", "colspan", "rowspan", "text"]
    known = blocks.select(id_col, *[F.col(f) if f in blocks.columns else F.lit(None).cast("long").alias(f) for f in fields])
    whole = known.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("blocks"))
    kind = blocks.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [package(body_of(b)) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], names=[id_col, "content"])

    return whole.mapInArrow(run, f"{id_col} {kind}, content binary")


PROBE = "ord long, place string, text string, style string, align string, left_mm double, first_mm double, before_pt double, after_pt double, line double, size_pt double, bold_share double, fill string"


def probe(content: bytes) -> list[tuple]:
    """Measurements of each paragraph: text, style, alignment, indents, spacing, dominant size and share of bold."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    parent = {c: p for p in root.iter() for c in p}
    out = []

    def attribute(p, path: str, name: str, factor: float | None = None):
        node = p.find(path.replace("w:", W))
        value = None if node is None else node.get(f"{W}{name}")
        if value is None or factor is None:
            return value
        try:
            return float(value) * factor
        except ValueError:
            return None

    for p in root.iter(f"{W}p"):
        cell, above = None, parent.get(p)
        while above is not None and cell is None:
            cell, above = (above, above) if above.tag == f"{W}tc" else (None, parent.get(above))
        sizes: dict[float | None, int] = {}
        bold = visible = 0
        text = []
        for r in p.iter(f"{W}r"):
            t = "".join(x.text or "" for x in r.iter(f"{W}t"))
            text.append(t)
            n = len("".join(t.split()))
            size = attribute(r, "w:rPr/w:sz", "val", 0.5)
            sizes[size] = sizes.get(size, 0) + n
            flag = r.find(f"{W}rPr/{W}b")
            bold += n if flag is not None and flag.get(f"{W}val", "1") not in ("0", "false") else 0
            visible += n
        out.append((
            len(out) + 1, "table" if cell is not None else "body", "".join(text), attribute(p, "w:pPr/w:pStyle", "val"), attribute(p, "w:pPr/w:jc", "val"), attribute(p, "w:pPr/w:ind", "left", 1 / DXA_PER_MM),
            attribute(p, "w:pPr/w:ind", "firstLine", 1 / DXA_PER_MM), attribute(p, "w:pPr/w:spacing", "before", 1 / 20), attribute(p, "w:pPr/w:spacing", "after", 1 / 20), attribute(p, "w:pPr/w:spacing", "line", 1 / 240),
            max(sizes, key=lambda s: sizes[s]) if sizes else None, bold / visible if visible else None, attribute(cell, "w:tcPr/w:shd", "fill") if cell is not None else None,
        ))
    return out


def probe_files(files: DataFrame, id_col: str = "doc", content_col: str = "content") -> DataFrame:
    """Measurement rows of Word files; files that cannot be read give none."""
    kind = files.schema[id_col].dataType.simpleString()
    types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    fields = [f.split(" ") for f in PROBE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = probe(value) if value else []
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    found = []
                ids += [key] * len(found)
                rows += found
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *[pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)]], names=[id_col, *[n for n, _ in fields]])

    return files.select(id_col, content_col).mapInArrow(run, f"{id_col} {kind}, {PROBE}")


def layout_profile(paras: DataFrame, doc: str = "doc") -> DataFrame:
    """The commonest layouts of each place: size, line spacing and alignment by text length, with shares."""
    value = F.concat_ws(" ", F.coalesce(F.col("size_pt").cast("string"), F.lit("-")), F.coalesce(F.bround("line", 2).cast("string"), F.lit("-")), F.coalesce("align", F.lit("-")))
    rows = paras.where(~T.is_blank(F.col("text"))).select("place", value.alias("layout"), F.char_length("text").alias("n"))
    return S.top_shares(rows, "layout", ["place"], weight="n")


def dominant_size(paras: DataFrame, doc: str = "doc") -> DataFrame:
    """The size that most of a document's text has, the lesser one on ties."""
    sums = paras.where(F.col("size_pt").isNotNull()).groupBy(doc, "size_pt").agg(F.sum(F.char_length("text")).alias("n"))
    return sums.withColumn("__r", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("n"), "size_pt"))).where("__r = 1").select(doc, "size_pt")
