from pyspark.sql import functions as F

from reportloom.functions import headers as H
from reportloom.operators import drafting as D
from reportloom.plans import convert as C


def test_header_candidates(spark):
    rows = [("소요 예산(단위: 천원)", []), ("개선 전 평균 응답시간", ["개선 전 평균 응답시간", "개선 후 평균 응답시간"]), ("비고 및 향후 조치 계획", [])]
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(rows)], "i int, t string, s array<string>")
    got = [r[0] for r in df.orderBy("i").select(H.header_candidates(F.col("t"), F.col("s"))).collect()]
    assert got[0][:2] == ["소요 예산", "예산"]
    assert got[1][:2] == ["개선 전 응답시간", "개선 전"]
    assert "비고" in got[2]


def test_split_long(spark):
    df = spark.createDataFrame([("인력을 충원하고, 일정을 앞당기며, 품질을 높인다",), ("짧다. !",), (None,)], "t string")
    got = [r[0] for r in df.select(H.split_long(F.col("t"), 10)).collect()]
    assert len(got[0]) >= 2 and got[1] == ["짧다. !"] and got[2] == []


def test_answers_are_checked_as_data(spark):
    raw = 'text {"title": "T", "lines": [{"m": "1", "text": "현황"}, {"m": "?", "text": "줄", "src": [1, 9]}], "dropped": []} end'
    df = spark.createDataFrame([(1, raw, 3), (2, "no json", 3)], "k long, raw string, n int")
    read = D.read_answers(df, "raw", "n")
    assert {r["k"]: r["problems"] for r in read.collect()} == {1: ["source out of range"], 2: ["no JSON"]}
    assert [(r["mark"], r["text"]) for r in D.answer_lines(read, ["k"]).orderBy("line_no").collect()] == [("1", "현황"), ("-", "줄")]


def test_fallback_and_passes(spark):
    sentences = spark.createDataFrame([(1, 1, "하나"), (1, 2, "둘")], "k long, sent_no long, text string")
    assert D.render_lines(D.fallback_lines(sentences, ["k"]), ["k"]).first()["text"] == "1. 현황\n□ 하나\n□ 둘"
    lines = spark.createDataFrame([(1, i, m, t) for i, (m, t) in enumerate([("1", "A"), ("-", "앞"), ("□", "기간 : 오늘"), ("□", "참여자 : 모두"), ("→", "x"), ("→", "y")])], "k long, line_no long, mark string, text string")
    assert [r["mark"] for r in D.fix_level_order(D.restrict_arrows(lines, ["k"]), ["k"]).orderBy("line_no").collect()] == ["1", "□", "□", "□", "→", "-"]
    assert [r["text"] for r in D.align_labels(lines, ["k"]).orderBy("line_no").collect()][2] == "기간   : 오늘"


def test_convert_markdown(spark):
    text = "# 보고\n\n## 추진 배경임\n\n2026-07-05에 총 12000건을 처리하였습니다.\n\n- 인덱스를 재설계하였습니다.\n- 확인됩니다.\n"
    out = C.convert_markdown(spark.createDataFrame([(1, text)], "doc_id long, text string"), C.profile("default", headings_as_levels=False)).first()["markdown"]
    assert out == "# 보고\n\n## 추진 배경\n\n2026\\. 7. 5.에 총 12,000건 처리\n\n- 인덱스 재설계 및 확인"


def test_changes_are_logged(spark):
    before = spark.createDataFrame([(1, 1, "paragraph", None, None, "처리합니다."), (1, 2, "paragraph", None, None, " ")], "doc_id long, ord long, kind string, level int, depth int, text string")
    rows = C.changes(before, C.convert_blocks(before)).orderBy("ord").collect()
    assert [(r["before"], r["after"]) for r in rows] == [("처리합니다.", "처리"), (" ", None)]
