"""What drafts need of lines, sentences and small tables, as Spark columns: dates with weekdays, changes of values,
phrases of numbers, openings, typed marks and their levels, comparison tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .facts import WEEKDAYS, found_in
from .headers import sentence_parts
from .text import filled, let, strip

# Patterns, words and limits that decide results.
NAMED_WEEKDAY = rf"\([{WEEKDAYS}]\)"
BARE_DATE = r"(?<![\d.])\d{1,2}\.\d{1,2}(?![\d.%]|\s*\(|일|점|배|명|건|개|회|시간|년)"
OPEN_RANGE = rf"(?<![\d.])\d{{1,2}}\.\d{{1,2}}{NAMED_WEEKDAY}\s*~\s*\d{{1,2}}(?![\d.월일]|{NAMED_WEEKDAY})"
POINTED_DATE = r"(?<![\d.])\d{1,2}\.\d{1,2}\.(?!\d)"
DATE_RANGE = rf"(?<![\d.])\d{{1,2}}\.\d{{1,2}}(?:{NAMED_WEEKDAY})?\s*~\s*\d{{1,2}}\.?(?:{NAMED_WEEKDAY})?(?![\d.월일])"
FULL_DATE = r"(\d{4})\s*[.\-/년]\s*(\d{1,2})\s*[.\-/월]\s*(\d{1,2})"
CHANGE = r"(\S[^()]*?)\s*\(\s*(기존|당초|종전|이전)\s*([^()→]*?\d[^()→]*?)\s*→\s*([^()]+?)\s*\)"
VALUE = r"^[~약\s]*[\d,.]+\s*(?:%p?|[가-힣]{0,3})\s*$"
LABEL_HEAD = r"^(?:\s*-\s+)?(?:.*?:\s*)?"
PARTICLE_ENDS = "은|는|이|가|을|를|에|의|로|와|과|도|만"
OPENERS = "[［【〔〈《「『"
OPENING_DATE = r"^[’']?\d{2,4}\s*[.\-/년]\s*\d{1,2}\s*[.\-/월]"
STRONG_CUES = (r"(?:방안|방법|대안|안)[은는이가]?\s*(?:크게\s*)?(?:두|세|네)\s*가지",)
CUES = (*STRONG_CUES, r"첫째[는은,]", r"둘째[는은,]", r"[12１２]\s*안[은는]", r"[AB]\s*안[은는]")
SYMBOLS = "□■◻ㅁ○●◦◆◇▶▷►※–—·ㆍᆞ‧∙•"
OUTER_MARK = rf"^\s*(?:([{SYMBOLS}①-⑳])(?!\1)|[-.](?=\s))\s*"
ENUMERATOR = r"^(?:\(\d{1,2}\)|[①-⑳])"
ANNOTATIONS = ("*", "＊", "∗", "(주석)")
TITLE_TAGS = (r"^\s*[\(\[<【〈［（]\s*첨부\s*[0-9#]*\s*[\)\]>】〉］）]\s*[.:·\-]?\s*", r"^\s*첨부\s*[0-9]+\s*[.:)\-]\s*")
TYPED = r"^([ \t　]*)(\d{1,2}\.(?=\s)|\(\d{1,2}\)|[①-⑳]|[□■ㅁ○●◦◆◇▶▷►※→∙·ㆍ‧•*＊]|[-–—](?=\s))\s*(\S.*)$"
TYPED_DEPTHS = {"□": 0, "■": 0, "ㅁ": 0, "○": 0, "①": 0, "-": 1, "–": 1, "—": 1, "→": 1, "∙": 2, "·": 2, "ㆍ": 2, "•": 2}
FLAT_ROW, FLAT_PAIR = r"^\s*표\s*'([^']*)'\s*=\s*(.*?)\s*(?:→|->)\s*(.+)$", r"\s*([^=;]+?)\s*=\s*([^;]*?)\s*(?:;|$)"
ATTRIBUTE = r"장점|단점|효과|기대|이점|고려|조건|한계|제약|비용|리스크|위험|난점|내용|요건|일정|개요|방식|시행|기간"
OPTION = r"안\)|안$|^\(?\d안|첫째|둘째|셋째|[①-⑳]|^[A-C]안"
PROS, CONS = r"장점|효과|기대|이점", r"단점|고려|한계|제약|리스크|위험"
ORDINALS = "①②③④⑤⑥⑦⑧⑨"
FEW_ITEMS = 3
TITLE_CHARS, REQUEST_CHARS, PAGE_CHARS = 40, 1000, 1100


def replaced(text: Column, pattern: str, other) -> Column:
    """``text`` with each match of ``pattern`` as ``other(match)``, which may use further columns of the row."""
    hits = found_in(filled(text), pattern)
    return F.array_join(F.zip_with(F.split(filled(text), pattern, -1), hits, lambda gap, hit: F.concat(gap, F.when(hit.isNull(), "").otherwise(other(hit)))), "")


def part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, f"(?U){pattern}", group)


def named_in(source: Column, month: Column, day: Column) -> Column:
    """Whether a source has 'month월 day일'."""
    number = lambda c: c.cast("int").cast("string")
    return F.regexp_like(filled(source), F.concat(F.lit(r"(?U)(?<!\d)"), number(month), F.lit(r"\s*월\s*"), number(day), F.lit(r"\s*일")))


def weekday_of(year: int, month: Column, day: Column) -> Column:
    """'(토)' of a date, null where the calendar has none such."""
    date = F.try_to_date(F.concat_ws("-", F.lit(f"{year:04d}"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))
    return F.concat(F.lit("("), F.substring(F.lit(WEEKDAYS), F.weekday(date) + 1, F.lit(1)), F.lit(")"))


def weekdays_added(line: Column, source: Column, year: int) -> Column:
    """'9.5' as '9.5(토)' where the source names that day, and the ends of ranges that begin with a weekday."""
    start = r"^(\d{1,2})\.(\d{1,2})"

    def dated(hit: Column) -> Column:
        month, day = part(hit, start, 1), part(hit, start, 2)
        return F.concat(hit, F.when(named_in(source, month, day), F.coalesce(weekday_of(year, month, day), F.lit(""))).otherwise(""))

    ended = lambda hit: F.concat(hit, F.coalesce(weekday_of(year, part(hit, start, 1), part(hit, r"~\s*(\d{1,2})$", 1)), F.lit("")))
    return let(replaced(line, f"(?U){BARE_DATE}", dated), lambda t: replaced(t, f"(?U){OPEN_RANGE}", ended))


def dates_tidied(line: Column, source: Column) -> Column:
    """'8.22.~23.' as '8.22 ~ 23' for dates that the source names; others, such as decimals, stay."""
    start, whole = r"^(\d{1,2})\.(\d{1,2})", rf"^(\d{{1,2}}\.\d{{1,2}})({NAMED_WEEKDAY})?\s*~\s*(\d{{1,2}})\.?({NAMED_WEEKDAY})?$"
    known = lambda hit: named_in(source, part(hit, start, 1), part(hit, start, 2))
    pointless = lambda hit: F.when(known(hit), F.regexp_replace(hit, r"\.$", "")).otherwise(hit)
    ranged = lambda hit: F.when(known(hit), F.concat(part(hit, whole, 1), part(hit, whole, 2), F.lit(" ~ "), part(hit, whole, 3), part(hit, whole, 4))).otherwise(hit)
    return let(replaced(line, f"(?U){POINTED_DATE}", pointless), lambda t: replaced(t, f"(?U){DATE_RANGE}", ranged))


def date_in(text: Column) -> Column:
    """The first full date of a text; null without one, or where the calendar has it not."""
    whole = lambda i: part(filled(text), FULL_DATE, i)
    return F.when(whole(1) != "", F.try_to_date(F.concat_ws("-", whole(1), F.lpad(whole(2), 2, "0"), F.lpad(whole(3), 2, "0"))))


def changes_mended(line: Column) -> Column:
    """'28주 (기존 26주 → 사유)' as '기존 26주 → 28주 (사유)': an arrow stands between two values. What follows the
    arrow must be no value, the new value must hold a digit; a leading '-' and a label before ':' stay in front."""

    def mend(hit: Column) -> Column:
        new, was, old, why = (strip(part(hit, f"^{CHANGE}$", i)) for i in (1, 2, 3, 4))
        kept = ~new.rlike(r"(?U)\d") | why.rlike(f"(?U){VALUE}")
        return F.when(kept, hit).otherwise(F.concat(was, F.lit(" "), old, F.lit(" → "), new, F.lit(" ("), why, F.lit(")")))

    head = part(filled(line), LABEL_HEAD, 0)
    return F.concat(head, replaced(F.substring(filled(line), F.char_length(head) + 1, F.char_length(filled(line))), f"(?U){CHANGE}", mend))


def number_phrase(sentence: Column, number: Column) -> Column:
    """A number with its unit and the word before it ('응답자 312명'); a longer word with a particle is left out, and
    where the sentence has no such number it stands alone."""
    digits = F.array_join(F.transform(F.filter(F.split(number, "", -1), lambda c: c != ""), lambda c: F.when(c == ".", r"\.").otherwise(c)), ",?")
    pattern = F.concat(F.lit(r"(?U)(?:([가-힣A-Za-z&]{1,8})\s+)?("), digits, F.lit(r"[가-힣%]{0,2}(?:\s?원)?)"))
    first = lambda i: F.get(F.regexp_extract_all(filled(sentence), pattern, F.lit(i)), 0)

    def phrase(x: Column) -> Column:
        word = F.when(x["word"].rlike(f"(?:{PARTICLE_ENDS})$") & (F.char_length(x["word"]) > 2), "").otherwise(x["word"])
        return F.when(x["value"].isNull(), number).otherwise(strip(F.concat(word, F.lit(" "), F.regexp_replace(x["value"], r"(?U)\s+원$", "원"))))

    return let(F.struct(first(1).alias("word"), first(2).alias("value")), phrase)


def opener_class(text: Column) -> Column:
    """What a line opens with: a bracket, a parenthesis, a date, a digit or a letter."""
    t = strip(filled(text))
    first = F.left(t, F.lit(1))
    return (
        F.when(t == "", "기타").when(F.contains(F.lit(OPENERS), first), "꺾쇠로 시작").when(first.isin("(", "（"), "괄호로 시작")
        .when(t.rlike(f"(?U){OPENING_DATE}"), "날짜로 시작").when(first.rlike(r"(?U)\d"), "숫자로 시작").otherwise("글자로 시작")
    )


def neighbour_kind(text: Column, mark: Column) -> Column:
    """What stands next to a table: a blank line, its number, a bracketed title, a note, a marked or a plain line."""
    t = strip(filled(text))
    return (
        F.when(t == "", "빈 줄").when(t.rlike("^(?:<표|〈표|표 )"), "표 번호").when(F.contains(F.lit(OPENERS), F.left(t, F.lit(1))), "꺾쇠 제목")
        .when(t.startswith("*") | (filled(mark) == "※"), "※ 주석").when(filled(mark) != "", F.concat(F.lit("말머리 "), mark)).otherwise("문단(말머리 없음)")
    )


def has_alternatives(text: Column) -> Column:
    """Whether a text weighs alternatives: one strong cue, or two of the others."""
    t = filled(text)
    some = lambda cues: sum((t.rlike(f"(?U){c}").cast("int") for c in cues[1:]), t.rlike(f"(?U){cues[0]}").cast("int"))
    return (some(STRONG_CUES) >= 1) | (some(CUES) >= 2)


def nested_marks_collapsed(text: Column) -> Column:
    """'□ ① 가' as '① 가': an outer mark goes where an enumerator follows."""
    rest = F.regexp_replace(filled(text), f"(?U){OUTER_MARK}", "")
    return F.when(rest.rlike(f"(?U){ENUMERATOR}"), rest).otherwise(text)


def annotation_marks_unified(text: Column, mark: str = "*") -> Column:
    """Annotations of any mark as '* ...'; the first mark of the list that fits counts."""
    bare = F.regexp_replace(filled(text), r"(?U)^\s+", "")
    out = None
    for m in ANNOTATIONS:
        new = text if m == mark else F.concat(F.lit(f"{mark} "), F.regexp_replace(F.substring(bare, F.lit(len(m) + 1), F.char_length(bare)), r"(?U)^\s+", ""))
        out = F.when(bare.startswith(m), new) if out is None else out.when(bare.startswith(m), new)
    return out.otherwise(text)


def page_title_cleaned(title: Column) -> Column:
    """A page title without '(첨부 1)' and the like before it; a title of nothing else stays."""
    t = filled(title)
    for tag in TITLE_TAGS:
        t = F.regexp_replace(t, f"(?U){tag}", "")
    return F.when((strip(t) == "") | (strip(t) == strip(filled(title))), title).otherwise(strip(t))


def typed_parts(text: Column) -> Column:
    """STRUCT<mark, body, depth> of a line: its depth from the blanks before the mark, two for each level (a tab counts
    four, a wide blank two), else from the kind of mark; a line without a mark is all body."""
    t = F.regexp_replace(filled(text), "\n", " ")
    lead, mark, body = (part(t, TYPED, i) for i in (1, 2, 3))
    blanks = F.char_length(lead) + 3 * F.regexp_count(lead, F.lit("\t")) + F.regexp_count(lead, F.lit("　"))
    depths = F.create_map(*[F.lit(x) for pair in TYPED_DEPTHS.items() for x in pair])
    depth = F.when((mark == "") | mark.rlike(r"^\d"), 0).when(blanks > 0, F.floor((blanks - 1) / 2)).otherwise(F.coalesce(F.try_element_at(depths, mark), F.lit(1)))
    return F.struct(mark.alias("mark"), F.when(mark == "", strip(filled(text))).otherwise(strip(body)).alias("body"), depth.cast("int").alias("depth"))


def mark_kind(mark: Column) -> Column:
    """Marks that share a level: numbers as '1.', enumerators as '①', symbols as themselves."""
    return F.when(mark.rlike(r"(?U)^\d"), "1.").when(mark.rlike(f"(?U){ENUMERATOR}"), "①").otherwise(mark)


def levels_by_order(kinds: Column) -> Column:
    """The level of each mark of a document in the order in which kinds first appear: a new kind goes one deeper, a
    known one back up to its level, which forgets those below. Where no number comes first its level stays free."""
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<int>").alias("levels"))

    def step(a: Column, kind: Column) -> Column:
        def placed(stack: Column) -> Column:
            at = F.array_position(stack, kind).cast("int")
            return F.struct(
                F.when(at > 0, F.slice(stack, F.lit(1), at)).otherwise(F.array_append(stack, kind)).alias("stack"),
                F.array_append(a["levels"], F.when(at > 0, at - 1).otherwise(F.size(stack))).alias("levels"),
            )

        return let(F.when((F.size(a["stack"]) == 0) & (kind != "1."), F.array(F.lit("1."))).otherwise(a["stack"]), placed)

    return F.aggregate(kinds, start, step, lambda a: a["levels"])


def titled_sentences(text: Column) -> Column:
    """STRUCT<title, sentences> of prose: a first line of at most forty characters without a stop, a blank line below
    it, is its title; lines of a paragraph are joined before it is cut into sentences."""
    lines = F.transform(F.split(strip(filled(text)), r"\r\n|\n|\r", -1), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))

    def split(x: Column) -> Column:
        first = F.get(x, 0)
        titled = (F.size(x) > 2) & (first != "") & (F.get(x, 1) == "") & (F.char_length(first) <= TITLE_CHARS) & ~first.rlike(r"[.!?]$")
        rest = F.array_join(F.when(titled, F.slice(x, F.lit(3), F.size(x))).otherwise(x), "\n")
        flat = lambda p: F.array_join(F.filter(F.transform(F.split(p, "\n", -1), strip), lambda y: y != ""), " ")
        sentences = F.flatten(F.transform(F.split(rest, r"(?U)\n\s*\n", -1), lambda p: sentence_parts(flat(p))))
        return F.struct(F.when(titled, strip(first)).otherwise("").alias("title"), F.filter(F.transform(sentences, strip), lambda y: y != "").alias("sentences"))

    return let(lines, split)


def request_cleaned(request: Column) -> Column:
    """A request without blank lines and blanks at line ends, at most ``REQUEST_CHARS`` long."""
    lines = F.transform(F.split(strip(filled(request)), r"\r\n|\n|\r", -1), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
    return F.left(F.array_join(F.filter(lines, lambda x: x != ""), "\n"), F.lit(REQUEST_CHARS))


def page_chars(low: Column, high: Column) -> Column:
    """STRUCT<least, most> visible characters of a report of ``low`` to ``high`` pages."""
    return F.struct(F.floor(PAGE_CHARS * F.greatest(low, F.lit(1)) * 0.6).alias("least"), F.floor(PAGE_CHARS * high).alias("most"))


def half_mm(length: Column) -> Column:
    """Millimetres in steps of a half, half-even."""
    return F.bround(length * 2, 0) / 2


def row_sentence(label: Column, pairs: Column) -> Column:
    """'label : name value, name value' of a table row; ``pairs`` is ARRAY<STRUCT<name, value>>, empty values go."""
    body = F.array_join(F.transform(F.filter(pairs, lambda p: p["value"] != ""), lambda p: strip(F.concat(p["name"], F.lit(" "), p["value"]))), ", ")
    return F.when((label != "") & (body != ""), F.concat(label, F.lit(" : "), body)).otherwise(F.when(label != "", label).otherwise(body))


def unflattened(text: Column) -> Column:
    """"표 '항목' = 행 -> 열 = 값; 열 = 값" as the sentence of that row; null for other texts."""
    t = filled(text)
    names, values = (F.transform(found_in(part(t, FLAT_ROW, 3), f"(?U){FLAT_PAIR}", i), strip) for i in (1, 2))
    pairs = F.filter(F.zip_with(names, values, lambda a, b: F.struct(a.alias("name"), b.alias("value"))), lambda p: p["name"] != "")
    return F.when(t.rlike(f"(?U){FLAT_ROW}"), F.nullif(row_sentence(strip(part(t, FLAT_ROW, 2)), pairs), F.lit("")))


def rectangular(rows: Column) -> Column:
    return F.size(F.array_distinct(F.transform(rows, F.size))) == 1


def transposed(rows: Column) -> Column:
    """Columns of a rectangular ARRAY<ARRAY<STRING>> as rows."""
    return F.transform(F.sequence(F.lit(0), F.size(F.get(rows, 0)) - 1), lambda j: F.transform(rows, lambda r: F.get(r, j)))


def behind_first(array: Column) -> Column:
    return F.slice(array, F.lit(2), F.greatest(F.size(array) - 1, F.lit(0)))


def table_oriented(rows: Column) -> Column:
    """A comparison with attributes across and options down is turned, so that options are its columns."""
    head, side = behind_first(F.get(rows, 0)), F.transform(behind_first(rows), lambda r: F.get(r, 0))
    matching = lambda cells, pattern: F.size(F.filter(cells, lambda c: strip(c).rlike(f"(?U){pattern}")))
    turned = (F.size(rows) >= 2) & rectangular(rows) & (F.size(F.get(rows, 0)) >= 3) & (matching(head, ATTRIBUTE) >= 2) & (matching(side, OPTION) >= 2) & (matching(side, ATTRIBUTE) == 0)
    return F.when(turned, transposed(rows)).otherwise(rows)


def table_as_ordinals(rows: Column) -> Column:
    """A comparison of options as ARRAY<STRUCT<mark, text>>: '① option' and '- attribute : contents' below it; null
    where the table stays one: no options across, more than nine, or two whose pros and cons are compared or where an
    option has more than ``FEW_ITEMS`` contents."""
    options, body = behind_first(F.get(rows, 0)), behind_first(rows)
    pieces = lambda cell: F.filter(F.split(cell, "\n", -1), lambda p: F.regexp_replace(p, "[ -]", "") != "")
    flat = lambda cell: F.regexp_replace(cell, "\n", " ")
    labels = F.transform(body, lambda r: flat(F.get(r, 0)))
    weighed = F.exists(labels, lambda x: x.rlike(PROS)) & F.exists(labels, lambda x: x.rlike(CONS))
    items = lambda j: F.aggregate(body, F.lit(0), lambda n, r: n + F.size(pieces(F.get(r, j))))
    n = F.size(options)
    compared = F.coalesce(rectangular(rows) & n.between(2, len(ORDINALS)) & (F.size(F.filter(options, lambda c: strip(c).rlike(f"(?U){OPTION}"))) >= 2), F.lit(False))
    stays = (n == 2) & (weighed | (F.greatest(items(1), items(2)) > FEW_ITEMS))

    def option_lines(option: Column, j: Column) -> Column:
        bare = strip(F.regexp_replace(flat(option), r"(?U)^\(?\s*(?:\d|[A-C])\s*안\s*\)?\s*", ""))
        head = F.struct(F.substring(F.lit(ORDINALS), j + 1, F.lit(1)).alias("mark"), F.when(bare == "", option).otherwise(bare).alias("text"))
        told = F.filter(body, lambda r: F.size(pieces(F.get(r, j + 1))) > 0)
        line = lambda r: F.concat(strip(flat(F.get(r, 0))), F.lit(" : "), F.array_join(F.transform(pieces(F.get(r, j + 1)), lambda p: strip(F.regexp_replace(p, r"(?U)^\s*-\s*", ""))), ", "))
        return F.concat(F.array(head), F.transform(told, lambda r: F.struct(F.lit("-").alias("mark"), line(r).alias("text"))))

    return F.when(compared & ~stays, F.flatten(F.transform(options, option_lines)))
