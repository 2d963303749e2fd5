"""Queries of the Korean text functions over the rows of given tables: lines are built from columns, as the tables hold
no Korean, and the SQL builds what must come out from the same columns.

A template is text with SQL in braces. The SQL of lines is common to Spark and DuckDB; that of results is DuckDB's.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import drafts as D
from ..functions import facts as K
from ..functions import hangul as G
from ..functions import headers as H
from ..functions import text as T
from ..operators import facts as O
from ..operators import structure as B
from ..sources import text_files as X

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}
KEYS = {"orders": "o_orderkey", "part": "p_partkey", "customer": "c_custkey"}
#: Pieces of SQL that both sides know.
NAMES = {
    "orders": {
        "k": "CAST(o_orderkey AS STRING)", "y": "CAST(year(o_orderdate) AS STRING)", "m": "CAST(month(o_orderdate) AS STRING)", "d": "CAST(day(o_orderdate) AS STRING)",
        "mm": "lpad(CAST(month(o_orderdate) AS STRING), 2, '0')", "dd": "lpad(CAST(day(o_orderdate) AS STRING), 2, '0')", "w": "CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)",
        "a": "CAST(o_orderkey % 7 + 2 AS STRING)", "b": "CAST(o_orderkey % 7 + 12 AS STRING)", "c": "CAST(o_orderkey % 5 + 31 AS STRING)", "s": "o_orderstatus", "next": "CAST(o_orderkey % 27 + 2 AS STRING)", "day": "CAST(o_orderkey % 27 + 1 AS STRING)",
    },
    "part": {"k": "CAST(p_partkey AS STRING)", "name": "p_name", "brand": "p_brand", "n": "CAST(p_size AS STRING)", "kind": "p_type"},
    "customer": {"k": "CAST(c_custkey AS STRING)", "name": "c_name", "seg": "c_mktsegment"},
}


def literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def spelled(template: str | None, names: dict[str, str]) -> str:
    """A template as SQL; null for none."""
    if template is None:
        return "CAST(NULL AS STRING)"
    parts = re.split(r"\{([^{}]*)\}", template)
    said = [literal(p) if i % 2 == 0 else f"({names.get(p, p)})" for i, p in enumerate(parts) if p or i % 2]
    return " || ".join(said) or "''"


def cases(name: str, table: str, rows: list[tuple], result: Callable[..., Column]) -> None:
    """A query ``name`` with the table's key, input and result (text) for each row of ``table``. The rows of ``rows``, taken in
    turn by the key, hold templates of the function's inputs and, at the end, of the result."""
    key, names = KEYS[table], NAMES[table]

    def chosen(i: int) -> str:
        return f"CASE {key} % {len(rows)} " + " ".join(f"WHEN {j} THEN {spelled(r[i], names)}" for j, r in enumerate(rows)) + " END"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        inputs = [F.expr(chosen(i)).alias(f"x{i}") for i in range(len(rows[0]) - 1)]
        built = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key, *inputs)
        return built.select(key, F.col("x0").alias("input"), result(*[F.col(f"x{i}") for i in range(len(rows[0]) - 1)]).cast("string").alias("result"))

    _queries[name] = run
    _sql[name] = f"SELECT {key}, {chosen(0)} AS input, {chosen(len(rows[0]) - 1)} AS result FROM {table}"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def joined(parts: Column) -> Column:
    return F.array_join(parts, " | ")


def told(problems: Column) -> Column:
    """Kinds and what is shown, as 'kind:shown'."""
    return joined(F.transform(problems, lambda p: F.when(p["shown"] == "", p["kind"]).otherwise(F.concat(p["kind"], F.lit(":"), p["shown"]))))


def commas(sql: str) -> str:
    """DuckDB SQL of a number with commas, without braces."""
    return f"CASE WHEN {sql} < 1000 THEN CAST({sql} AS VARCHAR) ELSE CAST({sql} // 1000 AS VARCHAR) || ',' || lpad(CAST({sql} % 1000 AS VARCHAR), 3, '0') END"


WHOLE = "CAST(floor(o_totalprice) AS BIGINT)"
COMMAS = f"{{{commas(WHOLE)}}}"


def weekday(day: str, month: int = 9, year: int = 2026) -> str:
    return f"{{substr('일월화수목금토', CAST(dayofweek(make_date({year}, {month}, CAST({day} AS INTEGER))) AS INTEGER) + 1, 1)}}"


cases("formal_endings", "orders", [
    ("주문 {k}건을 점검하였습니다.", "주문 {k}건을 점검하였음."), ("주문 {k}번을 출고했습니다.", "주문 {k}번을 출고하였음."), ("{k}번 주문을 취소합니다.", "{k}번 주문을 취소함."), ("{k}번 주문의 담당은 박 과장입니다.", "{k}번 주문의 담당은 박 과장임."),
    ("{k}번 주문은 남은 상자가 없습니다.", "{k}번 주문은 남은 상자가 없음."), ("{k}번 주문은 재포장이 필요하다.", "{k}번 주문은 재포장이 필요함."), ("{k}번 주문의 납기를 연기한다.", "{k}번 주문의 납기를 연기함."), ("{k}번 주문 현황", "{k}번 주문 현황"), (None, None),
], G.formal_text)
cases("formal_noun_endings", "orders", [
    ("{k}번 주문을 재배정하였습니다.", "{k}번 주문 재배정"), ("{k}번 주문의 포장 공정을 증설할 예정입니다.", "{k}번 주문의 포장 공정 증설 예정"), ("{k}번 주문은 현재 배송 중입니다.", "{k}번 주문은 현재 배송 중"),
    ("{k}번 주문의 반품을 접수해야 합니다.", "{k}번 주문의 반품 접수 필요"), ("{k}번 주문의 창고 점검이 완료되었습니다.", "{k}번 주문의 창고 점검 완료"), ("{k}번 주문의 남은 상자를 줄였습니다.", "{k}번 주문의 남은 상자를 줄였음"),
    ("{k}번 주문의 지연 문제가 지속적으로 발생하였습니다.", "{k}번 주문의 지연 문제 지속 발생"), ("{k}번 주문에 사용하지 않는 상자 {a}개를 제거했습니다.", "{k}번 주문에 사용하지 않는 상자 {a}개 제거"), ("{k}번 주문의 측정 기준은 운영 로그입니다.", "{k}번 주문의 측정 기준은 운영 로그"), ("{k}번 주문의 미흡 사항은 4분기 과제로 이관합니다.", "{k}번 주문의 미흡 사항은 4분기 과제로 이관"),
    ("{k}번 주문은 추가 검토를 해야 합니다.", "{k}번 주문은 추가 검토를 해야 함"), ("{k}번 주문의 주가 변동을 분석합니다.", "{k}번 주문의 주가 변동 분석"), ("{k}번 업무 사이 공백을 조정합니다.", "{k}번 업무 사이 공백 조정"), ("{k}번 주문은 그렇게 말했습니다.", "{k}번 주문은 그렇게 말하였음"),
], lambda t: G.formal_text(t, True))
cases("heading_noun_endings", "orders", [("{k}차 출고 개요임", "{k}차 출고 개요"), ("{k}차 출고 성과이다", "{k}차 출고 성과"), ("{k}차 납품 일정입니다", "{k}차 납품 일정"), ("{k}차 출고 현황", "{k}차 출고 현황"), (None, None)], G.heading_noun_ending)
cases("nominal_forms", "part", [("{name} 포장하", "{name} 포장함"), ("{name} 교체되", "{name} 교체됨"), ("{name} 남", "{name} 남음"), ("{name} 줄", "{name} 줆"), ("{name} 모자라", "{name} 모자람"), ("{kind}", "{kind}음")], G.nominalize)
cases("particles_dropped", "part", [("{kind}상자를", "{kind}상자"), ("{kind}부품이", "{kind}부품"), ("{kind}설비가", "{kind}설비"), ("{kind}물량을", "{kind}물량"), ("{kind}사이", "{kind}사이")], G.drop_particle)
cases("style_lint", "orders", [
    ("{k}번 주문을 다시 보냈습니다", "polite"), ("{k}번 주문의 포장을 시작했다", "plain"), ("{k}번 주문 단가 인하 추진.", "period"), ("일단 {k}번 주문 단가 인하 추진", "filler"), ("{k}번 주문의 지연이 굉장히 심함", "adverb"), ("{k}번 주문 : 상자 {a}개 출고, 반품 협의 中", ""), ("일단 {k}번 주문을 점검한다.", "plain | period | filler"),
], lambda t: joined(F.transform(G.lint(t), lambda i: i["kind"])))
cases("style_hard_issues", "orders", [("{k}번 주문을 다시 보냈습니다", "polite"), ("일단 {k}번 주문 단가 인하 추진", ""), ("{k}번 주문의 지연이 굉장히 심함", ""), ("저는 {k}번 주문이 늦다고 봅니다", "polite | speaker")], lambda t: joined(F.transform(G.hard_issues(t), lambda i: i["kind"])))
cases("style_fixes", "orders", [
    ("{k}번 주문은 상자 {b}개를 요청했는데 {a}개밖에 보내지 못했습니다.", "{k}번 주문은 상자 {b}개를 요청했는데 {a}개밖에 보내지 못하였음"), ("일단 {k}번 주문의 단가를 {a}만 원에서 {b}만 원으로 올립니다", "{k}번 주문의 단가를 {a}만원에서 {b}만원으로 올림"),
    ("주문 {b}건 중 {a}건을 골랐습니다.", "주문 {b}건 中 {a}건을 골랐음"), ("- {k}번 주문의 상자를 옮겼습니다.", "- {k}번 주문의 상자를 옮겼음"), ("□ {k}번 주문 : 상자 {a}개", "□ {k}번 주문 : 상자 {a}개"), ("반품 협의 중", "반품 협의 中"),
], G.style_fix)
cases("notation_rules", "orders", [
    ("주문액 {w}원 확인", f"주문액 {COMMAS}원 확인"), ("주문일은 {y}-{mm}-{dd} 오전", "주문일은 {y}. {m}. {d}. 오전"), ("{y}년 {m}월 {d}일 접수", "{y}. {m}. {d}. 접수"), ("{y}년 물량", "{y}년 물량"), ("{y}-13-{dd}", "{y}-13-{dd}"), ("상자 {a}개 및{b}개", "상자 {a}개 및 {b}개"),
], K.notation)
cases("long_sentences_split", "orders", [
    ("{k}번 주문의 상자를 다시 점검하고, 창고에 남은 물량을 모두 확인하여 다음 주까지 고객에게 순서대로 보낼 계획임.", "{k}번 주문의 상자를 다시 점검하고. | 창고에 남은 물량을 모두 확인하여 다음 주까지 고객에게 순서대로 보낼 계획임."), ("{k}번 접수. 출고는 {a}일 뒤. ?", "{k}번 접수. | 출고는 {a}일 뒤. ?"), ("출고일은 {y}. {m}. {d}.부터임.", "출고일은 {y}. {m}. {d}.부터임."), ("", ""),
], lambda t: joined(H.split_long(t, 50)))
cases("header_short_forms", "orders", [
    ("배송 수량(단위: {k}개)", "", "배송 수량 | 배송수량"), ("배송 수량[단위: {k}개]", "", "배송 수량 | 배송수량"), ("{k}차 점검 후 남은 상자", "구분;{k}차 점검 후 남은 상자;{k}차 점검 전 남은 상자", "{k}차 점검 후 | {k}차점검후"), ("구분", "", ""),
], lambda t, s: joined(H.header_candidates(t, F.split(s, ";"))))
cases("fact_checks", "orders", [
    ("{k}번 주문 상자 {a}개", "{k}번 주문은 상자 {b}개입니다.", "number:{a}"), ("배송비 {a}억원", "배송비는 {b}억 원입니다.", "money:{a}억원"), ("배송비 {a}억원", "배송비는 {a}억 원입니다.", ""), ("출고율 {a}%", "출고율은 {b}%입니다.", "percent:{a}%"),
    ("9.{next}까지 출고", "9월 {day}일까지 출고합니다.", "date:9.{next}"), ("9.{day}까지 출고", "9월 {day}일까지 출고합니다.", ""), ("9.{day} 출고", "9월 {day}일에 출고합니다.", ""), ("2.30(월) 출고", "2월 30일 출고", "no_date:2.30(월)"),
    ("{k}번 주문 배송비 하락", "{k}번 주문은 배송비가 올랐습니다", "opposite"), ("{k}번 주문 인상 확정", "{k}번 주문은 인상안을 검토하고 있습니다", "settled"), ("{k}번 주문 상자 多", "{k}번 주문은 상자가 많습니다", "hanja:多"), ("{k}번 주문 SKU 반영", "{k}번 주문에 반영", "latin:sku"),
    ("{k}번 기한 ~10.15일, 300만원 → 500만원, 1억 2천만원, 경쟁사(2개), 9월 2주차, 8.22(토) ~23(일)", "{k}번은 10월 15일까지 4명, 300만 원에서 500만 원으로, 약 1억 2천만 원, 경쟁사 두 곳, 9월 둘째 주, 8월 22일부터 이틀간", ""), ("{k}번 설계 {c}명 中 {a}명 확보", "{k}번 설계는 {c}명을 계획했는데 {b}명밖에 확보하지 못했습니다.", "number:{a}"),
    ("{k}번 9.5(금) 확정", "{k}번은 9월 5일 확정 예정.", "weekday:9.5(금)"), ("{k}번 9.5(토) ~6(토) 확정", "{k}번은 9월 5일부터 이틀간 확정", "weekday:~6(토)"), ("{k}번 Calibration 반영", "{k}번에 캘리브레이션을 반영", ""), ("{k}번 : 연차 물가 연동 조정", "{k}번은 매년 물가 연동으로 조정합니다.", "blocked:연차"),
    ("{k}번 부담액 : 연 {a},000만원 이상 발생 사례 다수", "{k}번의 일부는 연 {a}천만 원 이상을 부담하고 있습니다.", "opposite"), ("{k}번 부담액 : 연 {a},000만원 이상 발생 사례 일부", "{k}번의 일부는 연 {a}천만 원 이상을 부담하고 있습니다.", ""),
    ("{k}번의 최종 비용은 환율 변동에 따라 상이", "{k}번의 최종 비용은 환율에 따라 달라질 수 있습니다.", "hedge:{substr(CAST(o_orderkey AS STRING) || '번의 최종 비용은 환율에 따라 달라질 수 있습니다', 1, 24)}"), ("{k}번의 최종 비용은 환율에 따라 변동 가능", "{k}번의 최종 비용은 환율에 따라 달라질 수 있습니다.", ""),
    ("{k}번 경력자 부족으로 {a}개월 공석 2개", "{k}번은 경력자가 없어서 {a}개월 넘게 공석인 포지션이 두 개 있습니다.", "bound:{a}개월 넘"), ("{k}번 경력자 부족으로 {a}개월 이상 공석 2개", "{k}번은 경력자가 없어서 {a}개월 넘게 공석인 포지션이 두 개 있습니다.", ""),
    ("{k}번 법무 검토 및 노조 협의 中", "{k}번은 법무 검토와 노조 협의를 거쳐 도입합니다", "progress:협의"), ("{k}번 노조 협의 中", "{k}번은 노조와 협의하고 있습니다", ""), ("{k}번 (1안) 우선 추진", "{k}번은 첫째 안을 우선 추진", ""),
], lambda line, source: told(O.line_problems(line, source, 2026)))
cases("coined_words", "orders", [("{k}번 나눠보관 확대", "{k}번 나눠서 보관하는 방식", "나눠보관"), ("{k}번 상자폭 확대", "{k}번 상자 폭 확대", ""), ("", "", "")], lambda line, source: joined(K.coined_words(line, source)))
cases("numbers_left_out", "orders", [("상자 {c}개 중 {b}개 출고, {a}개는 대기", "출고 {b}개 / 총 {c}개", "{a}"), ("작년 배송은 {b}%였고 올해는 {c}%입니다", "배송 {c}%", "{b}"), ("배송비는 {a}천만 원 이상", "배송비 {a},000만원 이상", "")], lambda source, line: joined(K.missing_numbers(source, line)))
cases("money_values", "orders", [("{a}억 {b}00만", "{CAST(CAST((o_orderkey % 7 + 2) * 100000000.0 + (o_orderkey % 7 + 12) * 1000000.0 AS BIGINT) AS VARCHAR)}"), ("{b}만", "{CAST((o_orderkey % 7 + 12) * 10000 AS VARCHAR)}"), ("{a}천만", "{CAST((o_orderkey % 7 + 2) * 10000000 AS VARCHAR)}"), ("단가 미정", None)], lambda t: K.money_value(t).cast("long"))
cases("typed_markers", "part", [("ㆍ{name}", "ㆍ none"), ("{n}.5배 증가", None), ("- {name}", "- space"), ("○○{name}", None), ("□ {name}", "□ space"), ("가. {name}", "가. space"), ("{name}", None)], lambda t: F.when(T.typed_marker(t).isNotNull(), F.concat_ws(" ", T.typed_marker(t)["mark"], T.typed_marker(t)["sep"])))
cases("sentence_endings", "part", [("{name} 출고합니다.", "~습니다 (합쇼체)"), ("{name} 출고한다", "~다 (서술)"), ("{name} 보내요", "~요"), ("{name} 재고 확보함", "~음/함/임 (개조식)"), ("{name} 재고", "명사 종결"), ("{name} {n}%", "수치·기호 종결"), ("{name}", "기타"), (None, "기타")], T.ending_class)
cases("blank_texts", "part", [("{repeat(' ', p_size)}", "true"), ("{repeat('ㅤ', p_size)}", "true"), ("​{repeat('　', p_size)}", "true"), ("{name}", "false"), (None, "true")], T.is_blank)
cases("page_ids", "part", [("https://wiki.example/wiki/pages/{k}/t", "{k}"), ("https://wiki.example/v?pageId={k}", "{k}"), ("{k}", "{k}"), ("https://wiki.example/x/{name}", None)], T.page_id_from_url)
cases("bracket_captions", "part", [("[{name}]", "true"), ("[]", "false"), ("【{name}】", "true"), ("{name}[{n}]", "false")], T.is_bracket_caption)
cases("plain_text_as_markdown", "part", [
    ("{name}\n{brand}", "{name}\n\n{brand}"), ("- {name}\n{n}. {brand}", "\\- {name}\n\n{n}\\. {brand}"), ("이름\t수량\n{name}\t{n}\n끝", "| 이름 | 수량 |\n|---|---|\n| {name} | {n} |\n\n끝"), ("이름\t수량\t값\n{name}\t{n}", "| 이름 | 수량 | 값 |\n|---|---|---|\n| {name} | {n} |  |"),
    ("```\n- {name}\t{n}\n```\n끝", "```\n- {name}\t{n}\n```\n\n끝"), ("| {name} | {n} |\n| a | b |", "| {name} | {n} |\n| a | b |"),
], X.plain_to_markdown)
LETTERS = {"hangul": "substr('가나다라마바사아자차카타파하', CAST((p_size - 1) % 14 AS INTEGER) + 1, 1)", "alpha": "chr(CAST(97 + (p_size - 1) % 26 AS INTEGER))"}
#: DuckDB SQL of a size as a Roman numeral and as a circled number.
ROMAN = "CASE WHEN p_size < 1 THEN 'I' ELSE repeat('M', CAST(p_size // 1000 AS INTEGER)) || " + " || ".join(f"string_split('{signs}', ',')[CAST(p_size // {unit} % 10 AS INTEGER) + 1]" for unit, signs in ((100, ",C,CC,CCC,CD,D,DC,DCC,DCCC,CM"), (10, ",X,XX,XXX,XL,L,LX,LXX,LXXX,XC"), (1, ",I,II,III,IV,V,VI,VII,VIII,IX"))) + " END"
CIRCLED = "CASE WHEN p_size BETWEEN 1 AND 15 THEN substr('①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮', CAST(p_size AS INTEGER), 1) ELSE CAST(p_size AS VARCHAR) END"
cases("marker_formats", "part", [("{n}", "{n}. {repeat(" + LETTERS["hangul"] + ", CAST((p_size - 1) // 14 + 1 AS INTEGER))}. {repeat(" + LETTERS["alpha"] + ", CAST((p_size - 1) // 26 + 1 AS INTEGER))}. {" + ROMAN + "}. {" + CIRCLED + "}")], lambda n: F.concat_ws(" ", *[B.format_marker(t, n.cast("int")) for t in ("{n}.", "{hangul}.", "{alpha}.", "{ROMAN}.", "{circled}")]))


def cells(table: Column) -> Column:
    """'a|b;c|d' as rows of cells, '/' as a line end."""
    return F.transform(F.split(table, ";", -1), lambda r: F.split(F.translate(r, "/", "\n"), r"\|", -1))


def table_text(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, "|")), ";")


DAY, NEXT = "o_orderkey % 27 + 1", "o_orderkey % 27 + 2"
cases("weekdays_added", "orders", [
    ("{k}번 출고 : 9.{day} 창고", "{k}번 주문은 9월 {day}일 창고에서 출고합니다.", f"{{k}}번 출고 : 9.{{day}}({weekday(DAY)}) 창고"), ("평점 4.3점", "평점은 4.3점입니다.", "평점 4.3점"), ("기한 (~9.{day}일)", "9월 {day}일까지", "기한 (~9.{day}일)"), ("2.30 출고", "2월 30일 출고", "2.30 출고"), (None, None, ""),
], lambda line, source: D.weekdays_added(line, source, 2026))
cases("dates_tidied", "orders", [("{k}번 출고 9.{day}. 창고", "{k}번 주문은 9월 {day}일에 출고합니다.", "{k}번 출고 9.{day} 창고"), ("평점 4.3점", "평점은 4.3점입니다.", "평점 4.3점"), ("{k}판 3.1. 공개", "9월 {day}일 공개", "{k}판 3.1. 공개")], D.dates_tidied)
cases("dates_read", "orders", [("{y}. {m}. {d}", "{CAST(CAST(o_orderdate AS DATE) AS VARCHAR)}"), ("접수 {y}년 {m}월 {d}일", "{CAST(CAST(o_orderdate AS DATE) AS VARCHAR)}"), ("{y}-13-01", None), ("{y}/2/30", None), ("{k}번", None)], D.date_in)
cases("changes_mended", "orders", [("납기 : {b}주 (기존 {a}주 → {k}번 창고 정전 영향)", "납기 : 기존 {a}주 → {b}주 ({k}번 창고 정전 영향)"), ("{b}주 (기존 {a}주 → {c}주)", "{b}주 (기존 {a}주 → {c}주)"), ("- 요금 : {b}억원 (당초 {a}억원 → 환율 상승)", "- 요금 : 당초 {a}억원 → {b}억원 (환율 상승)"), ("{k}번 그대로", "{k}번 그대로")], D.changes_mended)
cases("number_phrases", "orders", [("창고 상자 {b}개가 남음", "{b}", "상자 {b}개가"), ("창고 상자 {b}개 남음", "{b}", "상자 {b}개"), ("재고율 {a}.5% 상승", "{a}.5", "재고율 {a}.5%"), ("없음", "{k}", "{k}")], D.number_phrase)
cases("opener_cases", "part", [("【{name}】", "꺾쇠로 시작"), (" (주){name}", "괄호로 시작"), ("2026. 7. {n}. {name}", "날짜로 시작"), ("{n}건", "숫자로 시작"), ("{name}", "글자로 시작"), (" ", "기타"), (None, "기타")], D.opener_class)
cases("table_neighbours", "part", [(" ", None, "빈 줄"), ("<표 {n}>", None, "표 번호"), ("【{name}】", None, "꺾쇠 제목"), ("※ {name}", "※", "※ 주석"), ("* {name}", None, "※ 주석"), ("□ {name}", "□", "말머리 □"), ("{name}", None, "문단(말머리 없음)")], D.neighbour_kind)
cases("alternatives", "part", [("고를 방법은 네 가지임: {name}.", "true"), ("첫째는 {name}. 둘째는 {brand}.", "true"), ("첫째는 {name}.", "false"), ("{n}개의 상자가 남았습니다", "false"), (None, "false")], D.has_alternatives)
cases("nested_marks", "part", [("□ ① {name}", "① {name}"), ("- (1) {name}", "(1) {name}"), ("□ - {name}", "□ - {name}"), ("-{n}% 하락", "-{n}% 하락"), ("① {name}", "① {name}"), ("", "")], D.nested_marks_collapsed)
cases("annotation_marks", "part", [("＊ {name}", "* {name}"), (" (주석) {name}", "* {name}"), ("* {name}", "* {name}"), ("∗{name}", "* {name}"), ("{name}", "{name}"), (None, None)], D.annotation_marks_unified)
cases("page_titles", "part", [("(첨부 {n}) {name}", "{name}"), ("[첨부{n}] {name}", "{name}"), ("첨부 {n}. {name}", "{name}"), ("첨부 {name}", "첨부 {name}"), ("(첨부 {n})", "(첨부 {n})"), (None, None)], D.page_title_cleaned)
cases("typed_lines", "part", [("{n}. {name}", "{n}. 0 {name}"), ("□ {name}", "□ 0 {name}"), ("- {name}", "- 1 {name}"), ("   - {name}", "- 1 {name}"), ("\t\t· {name}", "· 3 {name}"), ("-{n}%", " 0 -{n}%"), ("{name} ", " 0 {name}")], lambda t: F.concat_ws(" ", D.typed_parts(t)["mark"], D.typed_parts(t)["depth"], D.typed_parts(t)["body"]))
cases("levels_by_order", "part", [("{n}. □ - □ -", "0 1 2 1 2"), ("□ - □{repeat(' -', p_size % 3)}", "1 2 1{repeat(' 2', p_size % 3)}"), ("□ (1) - ② {n}.", "1 2 3 2 0"), ("1. - {n}. □ -", "0 1 0 1 2")], lambda t: F.array_join(D.levels_by_order(F.transform(F.split(t, " ", -1), D.mark_kind)).cast("array<string>"), " "))
cases("titled_sentences", "orders", [("{k}번 주문\n\n상자를 옮겼습니다. 창고를\n비웠습니다.\n\n끝.", "{k}번 주문 / 상자를 옮겼습니다. | 창고를 비웠습니다. | 끝."), ("{k}번 주문을 보냈습니다.\n\n끝.\n뒤", " / {k}번 주문을 보냈습니다. | 끝. | 뒤"), ("", " / ")], lambda t: F.concat(D.titled_sentences(t)["title"], F.lit(" / "), joined(D.titled_sentences(t)["sentences"])))
cases("requests_cleaned", "part", [("  {name} 비교 \n\n \n{n}줄로  ", "{name} 비교\n{n}줄로"), ("{repeat('가', 980 + p_size)}", "{repeat('가', least(1000, 980 + p_size))}"), (None, "")], D.request_cleaned)
cases("pages_to_chars", "part", [("{n} {CAST(p_size + 1 AS STRING)}", "{CAST(greatest(p_size, 1) * 660 AS VARCHAR)} {CAST((p_size + 1) * 1100 AS VARCHAR)}")], lambda t: F.concat_ws(" ", *(D.page_chars(F.get(F.split(t, " "), 0).cast("int"), F.get(F.split(t, " "), 1).cast("int"))[k].cast("string") for k in ("least", "most"))))
cases("half_mm", "part", [("{n}.2", "{CAST(p_size AS VARCHAR)}.0"), ("{n}.6", "{CAST(p_size AS VARCHAR)}.5"), ("{n}.8", "{CAST(p_size + 1 AS VARCHAR)}.0"), ("-{n}.3", "-{CAST(p_size AS VARCHAR)}.5"), (None, None)], lambda t: D.half_mm(t.cast("double")))
cases("tables_unflattened", "part", [("표 '비교' = {name} -> 납기 = {n}주; 요금 = 5억원", "{name} : 납기 {n}주, 요금 5억원"), ("표 '비교' = {name} → 납기 = ", "{name}"), ("표 {name}", None), (None, None)], D.unflattened)
cases("tables_oriented", "part", [("구분|장점|단점;1안|{name}|비쌈;2안|쌈|{n}일", "구분|1안|2안;장점|{name}|쌈;단점|비쌈|{n}일"), ("구분|1안|2안;장점|{name}|쌈;단점|비쌈|{n}일", "구분|1안|2안;장점|{name}|쌈;단점|비쌈|{n}일"), ("가|{name};다|{n}", "가|{name};다|{n}")], lambda t: table_text(D.table_oriented(cells(t))))
cases("tables_as_ordinals", "part", [
    ("구분|(1안) 확대|(2안) 축소|(3안) 유지;내용|- {name}/- {n}개|다|라;비용|- |1억|없음", "① 확대 | - 내용 : {name}, {n}개 | ② 축소 | - 내용 : 다 | - 비용 : 1억 | ③ 유지 | - 내용 : 라 | - 비용 : 없음"), ("구분|1안|2안;내용|{name}|{n}개", "① 1안 | - 내용 : {name} | ② 2안 | - 내용 : {n}개"), ("구분|1안|2안;장점|{name}|나;단점|다|라", None),
], lambda t: joined(F.transform(D.table_as_ordinals(cells(t)), lambda x: F.concat(x["mark"], F.lit(" "), x["text"]))))
