from reportloom.sources import text_files, word_files

TEXT = "# 보고\n\n본문 글\n\n- 하나\n  - 둘\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n끝 & <끝>"


def test_word_round_trip(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "# x")], "doc_id long, text string")
    files = word_files.to_word(text_files.read_markdown(docs))
    back = text_files.read_word(files, "doc_id", "content").where("doc_id = 1").orderBy("ord").collect()
    assert [(r["kind"], r["text"], r["depth"], r["row_idx"]) for r in back] == [("heading", "보고", None, None), ("paragraph", "본문 글", None, None), ("item", "하나", 0, None), ("item", "둘", 1, None), ("cell", "a", None, 0), ("cell", "b", None, 0), ("cell", "1", None, 1), ("cell", "2", None, 1), ("paragraph", "끝 & <끝>", None, None)]


def test_probe(spark):
    run = lambda t, props: f"<w:r><w:rPr>{props}</w:rPr><w:t>{t}</w:t></w:r>"
    body = f'<w:p><w:pPr><w:jc w:val="center"/><w:spacing w:before="120" w:line="384"/><w:ind w:left="567"/></w:pPr>{run("굵은", "<w:b/><w:sz w:val=\"28\"/>")}{run("보통 글자들", "<w:sz w:val=\"26\"/>")}</w:p><w:tbl><w:tr><w:tc><w:tcPr><w:shd w:fill="D9D9D9"/></w:tcPr><w:p>{run("칸", "")}</w:p></w:tc></w:tr></w:tbl>'
    files = spark.createDataFrame([("a", bytearray(word_files.package(body))), ("b", bytearray(b"broken")), ("c", None)], "doc string, content binary")
    rows = word_files.probe_files(files)
    first, second = rows.orderBy("ord").collect()
    assert (first["place"], first["text"], first["align"], round(first["left_mm"]), first["before_pt"], first["line"], first["size_pt"]) == ("body", "굵은보통 글자들", "center", 10, 6.0, 1.6, 13.0)
    assert abs(first["bold_share"] - 2 / 7) < 1e-9 and (second["place"], second["fill"]) == ("table", "D9D9D9")
    assert word_files.dominant_size(rows).collect()[0]["size_pt"] == 13.0
    assert {r["place"]: r["share"] for r in word_files.layout_profile(rows).collect()} == {"body": 1.0, "table": 1.0}
