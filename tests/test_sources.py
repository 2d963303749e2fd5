import io
import zipfile

from pyspark.sql import functions as F

from reportloom.sources import html as H
from reportloom.sources import sinks, text_files
from reportloom.streaming import watch

MARKDOWN = """# 제목

2026. 10. 1

## 현황
- 하나
  - 둘
1. 셋

| a | b |
|---|---|
| 1 | 2 \\| 3 |

> 인용

```sql
SELECT 1
```

글
이어짐
"""


def test_markdown_blocks(spark):
    df = spark.createDataFrame([(1, MARKDOWN), (2, None), (3, "")], "doc_id long, text string")
    found = [(r["kind"], r["text"]) for r in text_files.read_markdown(df).orderBy("ord").collect()]
    assert found == [("heading", "제목"), ("paragraph", "2026. 10. 1"), ("heading", "현황"), ("item", "하나"), ("item", "둘"), ("item", "셋"), ("cell", "a"), ("cell", "b"), ("cell", "1"), ("cell", "2 | 3"), ("callout", "인용"), ("code", "SELECT 1"), ("paragraph", "글 이어짐")]


def test_markdown_round_trip(spark):
    df = spark.createDataFrame([(1, "# T\n\n- a\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\ntext")], "doc_id long, text string")
    once = sinks.to_markdown(text_files.read_markdown(df)).first()["markdown"]
    assert once == "# T\n\n- a\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\ntext"


def test_plain_text(spark):
    df = spark.createDataFrame([("보고서\n2026. 1. 2\n- 항목\n이름\t값\n가\t1",), ("- 항목\n2026. 1. 2",)], "t string")
    got = df.select(text_files.plain_title(F.col("t")), text_files.plain_to_markdown(F.col("t"))).collect()
    assert got[0][0] == "보고서" and got[1][0] is None and "\\- 항목" in got[0][1] and "| 이름 | 값 |\n|---|---|\n| 가 | 1 |" in got[0][1]


def word_file(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_word_blocks(spark, tmp_path):
    p = lambda t, style="": f'<w:p><w:pPr>{style}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{p(t)}</w:tc>"
    table = f'<w:tbl><w:tr>{cell("h", "<w:gridSpan w:val=\"2\"/>")}</w:tr><w:tr>{cell("m", "<w:vMerge w:val=\"restart\"/>")}{cell("x")}</w:tr><w:tr>{cell("", "<w:vMerge/>")}{cell("y")}</w:tr></w:tbl>'
    body = p("제목", '<w:pStyle w:val="Title"/>') + p("현황", '<w:pStyle w:val="Heading1"/>') + p("본문") + table
    (tmp_path / "a.docx").write_bytes(word_file(body))
    (tmp_path / "b.docx").write_bytes(b"no archive")
    (tmp_path / "~$a.docx").write_bytes(b"lock")
    files = text_files.read_word_files(spark, str(tmp_path)).orderBy("doc").collect()
    assert [(r["doc"], r["reason"] is None) for r in files] == [("doc001", True), ("doc002", False)]
    rows = text_files.read_word(text_files.read_word_files(spark, str(tmp_path))).orderBy("ord").collect()
    assert [(r["kind"], r["text"], r["colspan"], r["rowspan"]) for r in rows] == [("title", "제목", None, None), ("heading", "현황", None, None), ("paragraph", "본문", None, None), ("cell", "h", 2, 1), ("cell", "m", 1, 2), ("cell", "x", 1, 1), ("cell", "y", 1, 1)]


def test_html_blocks(spark):
    page = "<html><script>var a='</p>';</script><h2>제목</h2><p>글 <b>굵게<p>다음</p><ul><li>하나<ul><li>둘</li></ul></li></ul><table><tr><th>a</th><td>b</td></tr></table>"
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    rows = H.read_blocks(df, "page_id", "html").orderBy("ord").collect()
    assert [(r["kind"], r["text"], r["depth"]) for r in rows] == [("heading", "제목", None), ("paragraph", "글 굵게", None), ("paragraph", "다음", None), ("item", "하나", 0), ("item", "둘", 1), ("cell", "a", None), ("cell", "b", None)]


def test_html_references_end_with_a_semicolon(spark):
    page = "<title>a &amp;&amp b &am</title><p>&lt;x&gt; &copy 1 &amp;lt; &#65; &#65 &ampx; &</p><a href='?a=1&copy=2'>c &nosuch; &quot;</a>"
    rows = H.read_blocks(spark.createDataFrame([(1, page)], "page_id long, html string"), "page_id", "html").orderBy("ord").collect()
    assert [r["text"] for r in rows] == ["a &&amp b &am", "<x> &copy 1 &lt; A &#65 &ampx; &", 'c &nosuch; "']
    assert rows[2]["runs"][0]["href"] == "?a=1&copy=2"


def test_pages_of_a_batch_come_in_slices(spark):
    df = spark.range(3 * H.SLICE_PAGES + 1).coalesce(1).selectExpr("id AS page_id", "concat('<p>', id, '</p>') AS html")
    rows = H.read_blocks(df, "page_id", "html").collect()
    assert [(r["page_id"], r["text"]) for r in rows] == [(i, str(i)) for i in range(3 * H.SLICE_PAGES + 1)]


def test_watch_converts_each_file_once(spark, tmp_path):
    source, sink, memory = (str(tmp_path / d) for d in ("in", "out", "memory"))
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.txt").write_text("총 12000건을 처리합니다.", encoding="utf-8")
        watch.watch(spark, source, sink, memory, once=True).awaitTermination(120)
        assert [r["converted"] for r in spark.read.parquet(sink).collect()] == ["총 12,000건을 처리함."] * (i + 1)
