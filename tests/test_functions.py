from pyspark.sql import functions as F

from reportloom.functions import facts as K
from reportloom.functions import hangul as G
from reportloom.functions import measure as M
from reportloom.functions import text as T
from reportloom.operators import facts as O
from reportloom.operators import structure as B


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_endings(spark):
    pairs = {"추진합니다.": "추진함.", "검토하였습니다.": "검토하였음.", "확인됩니다.": "확인됨.", "어렵다.": "어려움.", "자료 등": "자료 등", "": "", "먹습니다!": "먹음!", "숫자 12": "숫자 12"}
    assert values(spark, list(pairs), G.formal_text) == list(pairs.values())


def test_noun_endings(spark):
    pairs = {
        "인덱스를 재설계하였습니다.": "인덱스 재설계",
        "모니터링 체계를 보강할 예정입니다.": "모니터링 체계 보강 예정",
        "응답 지연 문제가 지속적으로 발생하였습니다": "응답 지연 문제 지속 발생",
        "주가 변동을 분석합니다.": "주가 변동 분석",
        "줄였습니다.": "줄였음",
    }
    assert values(spark, list(pairs), lambda t: G.formal_text(t, True)) == list(pairs.values())


def test_headings_and_nominal_forms(spark):
    assert values(spark, ["추진 배경임", "추진 배경", None], G.heading_noun_ending) == ["추진 배경", "추진 배경", None]
    assert values(spark, ["만들", "하", "먹", "가", "A", ""], G.nominalize) == ["만듦", "함", "먹음", "감", "A음", ""]


def test_lint_and_fix(spark):
    kinds = values(spark, ["재의뢰했습니다", "연동 지표 선정 어려움", "일단 검토한다."], lambda t: F.transform(G.lint(t), lambda i: i["kind"]))
    assert kinds == [["polite"], [], ["plain", "period", "filler"]]
    assert values(spark, ["연동 지표 선정이 어렵습니다.", "□ 15명 중 12명 확보"], G.style_fix) == ["연동 지표 선정이 어려움", "□ 15명 中 12명 확보"]


def test_notation(spark):
    pairs = {"총 12000건 처리": "총 12,000건 처리", "2026년 목표": "2026년 목표", "2026-07-05 시행": "2026. 7. 5. 시행", "2026년 7월 15일": "2026. 7. 15.", "2026-13-01": "2026-13-01", "0012000건": "12,000건", "가 및나": "가 및 나", "3.14159원": "3.14159원"}
    assert values(spark, list(pairs), K.notation) == list(pairs.values())


def test_numbers_and_money(spark):
    assert values(spark, ["3.50과 007, 1,200", None], K.numbers) == [["3.5", "7", "1200"], []]
    assert values(spark, ["1억 2천만", "300만", "없음"], K.money_value) == [120_000_000.0, 3_000_000.0, None]
    df = spark.createDataFrame([("3천만원과 7명", "3,000만원 확보")], "a string, b string")
    assert df.select(K.missing_numbers(F.col("a"), F.col("b"))).first()[0] == ["7"]
    assert values(spark, ["9.5(토) 시작", "9.5(일)", "2.30(월)"], lambda t: F.size(K.weekday_problems(t, 2026))) == [0, 1, 1]


def test_line_problems(spark):
    rows = spark.createDataFrame([("비용 5명 증가", "비용 4명 감소"), ("그대로", "그대로")], "a string, b string")
    found = [r[0] for r in rows.select(O.line_problems(F.col("a"), F.col("b"))).collect()]
    assert [tuple(p) for p in found[0]] == [("number", "5"), ("opposite", "")] and found[1] == []


def test_sentences_and_classes(spark):
    assert values(spark, ["하나. 둘! 3. 셋", "", None, "  "], T.sentences) == [["하나.", "둘!", "3. 셋"], [], [], []]
    classes = ["~습니다 (합쇼체)", "~다 (서술)", "~요", "~음/함/임 (개조식)", "명사 종결", "수치·기호 종결", "기타"]
    assert values(spark, ["합니다.", "한다", "해요", "성과 개선함", "성과", "12%", "abc"], T.ending_class) == classes
    assert values(spark, ["성과 개선함.", "a", None], T.tail) == ["선함", "", ""]


def test_blanks_markers_widths(spark):
    assert values(spark, ["", " 　", "ㅤ", "​", "가", None], T.is_blank) == [True, True, True, True, False, True]
    marks = values(spark, ["ㆍ입사예정", "1.5배 증가", "- 항목", "○○팀", "□ 제목", "가. 나", "plain"], T.typed_marker)
    assert [tuple(m) if m else None for m in marks] == [("ㆍ", "none"), None, ("-", "space"), None, ("□", "space"), ("가.", "space"), None]
    assert values(spark, ["가a", ""], T.display_width) == [3, 0]
    assert values(spark, ["https://x/wiki/pages/123/t", "https://x/v?pageId=7890", "42", "https://x/x/AbCd"], T.page_id_from_url) == ["123", "7890", "42", None]
    assert values(spark, ["[그림 1]", "[]", "【표】", "가[나]"], T.is_bracket_caption) == [True, False, True, False]
    assert values(spark, ["30mm", "11pt", "x"], M.length_emu) == [1_080_000, 139_700, None]


def wrap(text, size, most):
    lines, used, pending = 1, 0.0, 0.0
    for c in text:
        w = size if "가" <= c <= "힣" else size / 2
        if c == "\n":
            lines, used, pending = lines + 1, 0.0, 0.0
        elif c == " ":
            used, pending = used + pending + w, 0.0
            if used > most:
                lines, used = lines + 1, 0.0
        elif "가" <= c <= "힣":
            used, pending = used + pending, 0.0
            if used + w > most:
                lines, used = lines + 1, 0.0
            used += w
        else:
            pending += w
            if used + pending > most:
                if used > 0:
                    lines, used = lines + 1, 0.0
                if pending > most:
                    lines, pending = lines + int(pending // most), pending % most
    return max(1, lines)


def test_wrap_count(spark):
    texts = ["", "가나다라마바사", "aaaa bbbb cccc", "averyverylongword x", "가 a나\nb", "한글 mixed 글자 words 12345"]
    for most in (40.0, 55.0, 200.0):
        assert values(spark, texts, lambda t, m=most: M.wrap_count(t, 10, m)) == [wrap(t, 10, most) for t in texts]


def test_markers_and_fill(spark):
    df = spark.range(1, 30)
    got = [tuple(r) for r in df.select(B.format_marker("{ROMAN}.", F.col("id")), B.format_marker("({hangul})", F.col("id")), B.format_marker("{circled}", F.col("id"))).collect()]
    assert got[0] == ("I.", "(가)", "①") and got[3][0] == "IV." and got[14] == ("XV.", "(가가)", "⑮") and got[15][2] == "16"
    level = spark.createDataFrame([([1.0, 2.0, 6.0], 12.0), ([5.0, 5.0], 4.0)], "w array<double>, t double").select(M.fill_up(F.col("w"), F.col("t"))).collect()
    assert level[0][0] == [3.0, 3.0, 6.0] and level[1][0] == [5.0, 5.0]


def test_queries_of_stated_cases_keep_all_kinds():
    from reportloom.plans import cases

    sql = cases.oracle_sql()
    assert all(f"{kind}:" in sql["fact_checks"] for kind in ("number", "money", "percent", "date", "weekday", "no_date", "hanja", "latin", "hedge", "bound", "progress", "blocked"))
    assert all(text in sql["formal_noun_endings"] for text in ("지속적으로 발생하였습니다", "측정 기준은 운영 로그입니다", "추가 검토를 해야 합니다", "주가 변동을 분석합니다", "업무 사이 공백을 조정합니다", "그렇게 말했습니다"))
    assert all(text in sql["marker_formats"] for text in ("XL", "⑮"))
