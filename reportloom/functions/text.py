"""Column functions over text: sentences, endings, blanks, markers, widths. All built from Spark SQL functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and patterns that decide results.
CLOSERS = " \t\n.!?)]}>」』】〕〉》\"'”’…"
NOUNISH_ENDS = "음함임됨"
BLANK_CHARS = r"\x{3164}\x{115F}\x{1160}\x{2800}\x{17B4}\x{17B5}\x{034F}"
SENTENCE_END = r"(?U)(?<=[.!?])(?<![0-9][.!?])\s+"
WIDE = r"[\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{33FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A000}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}]"
SYMBOL_MARKS = r"[□■○●◦▪▫◆◇▶▷▲△※•‧·ㆍ\x{119E}➢➤►✓]|\([0-9]{1,2}\)|\([가-힣a-zA-Z]\)|[①-⑳❶-❿⓵-⓾]"
WORDY_MARKS = r"ㅇ|[-–—*]|[0-9]{1,2}[.)]|[가-힣a-zA-Z][.)]|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ][.)]?"
DATE_LINE = r"(?U)^\d{4}\s*\.\s*\d{1,2}\s*\.\s*\d{1,2}\s*\.?$"
BRACKET_PAIRS = ("[]", "［］", "【】", "〔〕", "〈〉", "《》")
DATE_FORMS = {
    "YYYY.M.D.": r"(?U)\b(?:19|20)\d{2}\s*\.\s*\d{1,2}\s*\.\s*\d{1,2}\s*\.",
    "YYYY-MM-DD": r"(?U)\b(?:19|20)\d{2}-\d{1,2}-\d{1,2}\b",
    "YY.M.D.": r"(?U)(?<!\d)\d{2}\s*\.\s*\d{1,2}\s*\.\s*\d{1,2}\s*\.(?!\d)",
    "YYYY년 M월 D일": r"(?U)(?:19|20)\d{2}\s*년\s*\d{1,2}\s*월\s*\d{1,2}\s*일",
    "M/D": r"(?U)(?<![\d/])\d{1,2}/\d{1,2}(?![\d/])",
}
NUMBER_FORMS = {
    "%p": r"(?U)\d\s*%p",
    "%": r"(?U)\d\s*%(?!p)",
    "억원": r"(?U)\d\s*억\s*원?",
    "백만원": r"(?U)\d\s*백만\s*원",
    "천단위 콤마": r"(?U)\d{1,3}(?:,\d{3})+",
    "▲/△ 증감": r"(?U)[▲△▼▽]\s*\d",
}


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once, however often ``then`` uses it.

    Not ``[0]``: Spark works out the type of what that is taken from anew for each row, over the whole of ``then``.
    """
    return F.element_at(F.transform(F.array(value), then), 1)


def filled(text: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(text, F.lit(""))


def lines(text: Column) -> Column:
    return F.split(filled(text), "\n", -1)


def strip(text: Column) -> Column:
    """Without white space at either end, Unicode white space included."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def sentences(text: Column) -> Column:
    """Non-blank sentences: cut after . ! ? and white space, but not where a digit stands before the stop."""
    return F.filter(F.split(filled(text), SENTENCE_END, -1), lambda s: strip(s) != "")


def core(sentence: Column) -> Column:
    """A sentence without the closing characters at its end."""
    return F.rtrim(sentence, F.lit(CLOSERS))


def ending_class(sentence: Column) -> Column:
    """How a sentence ends: polite, plain, colloquial, nominal, noun, number or other."""
    c = core(sentence)
    last = F.right(c, F.lit(1))
    return (
        F.when(c == "", "기타")
        .when(c.endswith("니다"), "~습니다 (합쇼체)")
        .when(last == "다", "~다 (서술)")
        .when(last == "요", "~요")
        .when(last.isin(list(NOUNISH_ENDS)), "~음/함/임 (개조식)")
        .when(last.rlike("[가-힣]"), "명사 종결")
        .when(last.rlike(r"(?U)[\d%)]"), "수치·기호 종결")
        .otherwise("기타")
    )


def tail(sentence: Column) -> Column:
    """The last two characters before the closers, '' where there are fewer."""
    c = core(sentence)
    return F.when(F.char_length(c) >= 2, F.right(c, F.lit(2))).otherwise("")


def is_blank(text: Column) -> Column:
    """Nothing visible: white space, format and control characters, and letters that render as nothing."""
    return filled(text).rlike(rf"(?U)^[\s\p{{Cf}}\p{{Cc}}\p{{Z}}{BLANK_CHARS}]*$")


def invisible_codes(text: Column) -> Column:
    """Sorted distinct U+XXXX of invisible characters other than white space."""
    marks = F.filter(F.split(filled(text), "", -1), lambda c: c.rlike(rf"(?U)^[\p{{Cf}}\p{{Cc}}\p{{Z}}{BLANK_CHARS}]$") & ~c.rlike(r"(?U)^\s$"))
    return F.sort_array(F.array_distinct(F.transform(marks, lambda c: F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(c)), 4, "0")))))


def display_width(text: Column) -> Column:
    """Columns on a fixed-pitch screen: wide letters count two."""
    return F.char_length(filled(text)) + F.char_length(F.regexp_replace(filled(text), WIDE.replace("[", "[^", 1), ""))


def width_without_spaces(text: Column) -> Column:
    return F.char_length(F.regexp_replace(filled(text), r"(?U)\s", ""))


def typed_marker(text: Column) -> Column:
    """STRUCT<mark, sep> of a line's leading list mark, null where it has none.

    Symbols may touch the text, wordy marks need a separator; a mark repeated right after itself is a placeholder.
    """
    t = filled(text)
    symbol = F.regexp_extract(t, rf"^[ 　\t]*({SYMBOL_MARKS})", 1)
    wordy = F.regexp_extract(t, rf"^[ 　\t]*({WORDY_MARKS})", 1)
    mark = F.when(symbol != "", symbol).otherwise(wordy)
    rest = F.substring(F.regexp_replace(t, r"^[ 　\t]*", ""), F.char_length(mark) + 1, F.lit(2_000_000_000))
    first = F.substring(rest, 1, 1)
    sep = F.when(first == "\t", "tab").when(first.isin(" ", "　"), "space").otherwise("none")
    ok = (mark != "") & ~is_blank(t) & ((symbol != "") | (sep != "none")) & ~((first != "") & (first == F.right(mark, F.lit(1))))
    return F.when(ok, F.struct(mark.alias("mark"), sep.alias("sep")))


def is_date_line(text: Column) -> Column:
    return strip(filled(text)).rlike(DATE_LINE)


def is_bracket_caption(text: Column) -> Column:
    """A line that one pair of brackets encloses, with something inside."""
    t = strip(filled(text))
    return reduce(lambda a, b: a | b, [t.startswith(p[0]) & t.endswith(p[1]) & (strip(F.substring(t, F.lit(2), F.char_length(t) - 2)) != "") for p in BRACKET_PAIRS])


def looks_like_markdown(text: Column) -> Column:
    """A heading, fence or table rule at the start of any line."""
    return filled(text).rlike(r"(?m)^(?:#{1,6}\s|```|~~~|\s*\|?\s*:?-{3,}:?\s*\|)")


def form_counts(text: Column, forms: dict[str, str]) -> list[Column]:
    """How often each form occurs in a text, a column for each form."""
    return [F.regexp_count(filled(text), F.lit(rx)).alias(name) for name, rx in forms.items()]


def page_id_from_url(url: Column) -> Column:
    """The wiki page id in an address: a path part after /pages/, a pageId parameter, or digits alone; else null."""
    u = filled(url)
    found = [F.regexp_extract(u, r"/pages/(\d+)(?:/|$)", 1), F.regexp_extract(u, r"[?&]pageId=(\d+)", 1), F.regexp_extract(u, r"^(\d+)$", 1)]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found])


def base_url(url: Column) -> Column:
    """A service address without closing slashes and without its REST path."""
    return F.regexp_replace(F.rtrim(url, F.lit("/")), r"(?i)/rest/api/?$", "")


def safe_name(title: Column, most: int = 60) -> Column:
    """A title as a file name: what file systems refuse becomes a space, white space one underscore."""
    name = F.regexp_replace(strip(F.regexp_replace(filled(title), r'[\\/:*?"<>|]', " ")), r"(?U)\s+", "_")
    return F.coalesce(F.nullif(F.left(F.trim(name, F.lit("._")), F.lit(most)), F.lit("")), F.lit("보고서"))
