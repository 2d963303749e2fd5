"""Dates, numbers, money and other facts of a text as Spark columns, and their differences between texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import filled, let, strip

# Units, notation and date rules.
UNITS = ("원", "명", "건", "개", "대", "회", "시간", "일", "월", "km", "kg", "MB", "GB", "TB")
STRIPPED = (r"(?U)Unknown macro:\s*\{[^}]*\}", r"\[edit\]", r"\(edit\)", r"(?U)!\[\]\(\s*\)", r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]")
LITERALS = (("：", ": "), ("，", ", "), ("∼", "~"), ("º", "°"), (" ,", ","), (" .", "."))
SPACING = ((r"(?U)\s*및\s*", " 및 "), (r"(?U)\s*등\s*의\s*", " 등의 "), (r"(?U)\(\s+", "("), (r"(?U)\s+\)", ")"), (r"(?U)\s{2,}", " "))
#: What a text has where any of STRIPPED, of the rules of dates and thousands, or of SPACING finds something.
STRIPPED_SIGN, DIGITS_SIGN, SPACING_SIGN = r"Unknown macro:|\[edit\]|\(edit\)|!\[\]\(|" + STRIPPED[-1], r"(?U)\d{4}", r"(?U)[및등]|\(\s|\s\)|\s{2}"
MONEY_UNITS = {"조": 1e12, "억": 1e8, "천만": 1e7, "백만": 1e6, "만": 1e4, "천": 1e3}
NUMBER = r"\d+(?:\.\d+)?"
MONEY = rf"(?U)((?:{NUMBER}\s*(?:조|억|천만|백만|만|천)\s*)+(?:{NUMBER}\s*)?|{NUMBER}\s*)원"
# What words stand for, what is allowed, and what softens, bounds or continues a statement.
NUMBER_WORDS = {"하나": 1, "하루": 1, "한": 1, "첫째": 1, "첫": 1, "둘": 2, "두": 2, "둘째": 2, "세": 3, "셋": 3, "셋째": 3, "네": 4, "넷": 4, "넷째": 4, "다섯": 5, "여섯": 6, "일곱": 7, "여덟": 8, "아홉": 9, "열": 10}
DURATION_DAYS = {"이틀": 2, "사흘": 3, "나흘": 4, "닷새": 5}
TERMS = {"캘리브레이션": "Calibration", "워크숍": "워크샵", "프로젝트": "과제"}
ALLOWED_HANJA = "高低中現可必時順內人月年日前後外約無有要未對比增減新全各上下"
HEDGES = ("수 있", "우려", "가능성", "것으로 보", "듯")
HEDGED_LINE = ("수 있", "우려", "가능성", "예상", "전망", "소지", "可", "가능", "약 ", "추정")
HEDGE_PREDICATES = {"어려": ("어려", "곤란", "난항", "차질", "미달"), "달라": ("달라", "상이", "변동", "차이"), "커": ("커", "증가", "확대", "가중", "高"), "늘": ("늘", "증가", "확대", "증원", "증액"), "줄": ("줄", "감소", "축소"), "생기": ("생기", "발생"), "발생": ("발생",), "지연": ("지연", "늦")}
HEDGE_STOPWORDS = ("있습", "있어", "있는", "것으", "필요", "합니", "됩니", "보입", "때문", "정도", "경우", "이번", "현재")
HEDGE_OVERLAP = 2
BOUNDS, BOUNDS_KEPT = ("이상", "이하", "미만", "초과", "넘"), ("이상", "이하", "미만", "초과", "넘", "↑", "+", "以上")
PROGRESS, PROGRESS_SHOWN = ("中", "중"), ("중", "하고 있", "하는 중", "진행하고", "진행 중", "검토하고", "협의하고", "운영하고", "있습니다")
VERBAL_TAILS = ("서", "고", "며", "면", "는", "아", "어", "여", "해", "하", "한", "할", "함", "했", "던", "든", "지", "게", "기", "도록", "니", "으며", "으면")
KOREAN_DATE = r"(?U)(\d{1,2})\s*월\s*(\d{1,2})\s*일"
DOTTED_DATE = r"(?<![\d.])(\d{1,2})\.(\d{1,2})(?![\d%])"
SPACED_DATE = r"(?U)(?:(?<!\d)\d{4}\s*\.\s*|~\s*)(\d{1,2})\s*\.\s*(\d{1,2})(?![\d%])"
MONTH, DAY = r"0?([1-9]|1[0-2])", r"0?([1-9]|[12]\d|3[01])"
WEEKDAYS = "월화수목금토일"


def where_has(text: Column, sign: str, found: Column, kind: str = "array<string>") -> Column:
    """The array ``found`` where ``text`` has ``sign``, which all of its finds hold; else none, without a search."""
    return F.when(F.contains(text, F.lit(sign)), found).otherwise(F.array().cast(kind))


def replaced(text: Column, sign: str, pattern: str, other: str) -> Column:
    """``text`` (named thrice, so a plain column) with ``pattern`` replaced, searched for only where ``sign`` is, which
    all of its finds hold."""
    return F.when(F.contains(text, F.lit(sign)), F.regexp_replace(text, pattern, other)).otherwise(text)


def dates(text: Column, form: str = "$1. $2. $3.") -> Column:
    """Dates such as 2026-07-05, 2026/7/5 or 2026년 7월 5일 in one form; impossible ones stay."""
    t = F.regexp_replace(text, rf"(?U)(?<!\d)(\d{{4}})\s*[-./]\s*{MONTH}\s*[-./]\s*{DAY}\.?(?!\d)", form)
    return F.regexp_replace(t, rf"(?U)(?<!\d)(\d{{4}})\s*년\s*{MONTH}\s*월\s*{DAY}\s*일", form)


def thousands(text: Column, units: tuple[str, ...] = UNITS) -> Column:
    """Thousands separators in numbers of four digits or more that a unit follows; leading zeros are dropped."""
    unit = "|".join(units)
    start = r"(?<![\d,.])"
    t = F.regexp_replace(text, rf"(?U){start}0+(?=[1-9]\d{{3,}}\s*(?:{unit}))", "")
    return F.regexp_replace(t, rf"(?U)(?<=\d)(?<![,.]\d{{1,15}})(?=(?:\d{{3}})+(?!\d)\s*(?:{unit}))", ",")


def notation(text: Column) -> Column:
    """All notation rules in their order: remains stripped, literals, dates, thousands, spacing, ends trimmed."""
    folded = lambda t, rules: reduce(lambda u, r: F.regexp_replace(u, *r), rules, t)
    where = lambda t, sign, then: F.when(t.rlike(sign), then).otherwise(t)
    spaced = lambda t: where(t, SPACING_SIGN, folded(t, SPACING))
    t = where(filled(text), STRIPPED_SIGN, folded(filled(text), [(pattern, "") for pattern in STRIPPED]))
    for before, after in LITERALS:
        t = F.replace(t, F.lit(before), F.lit(after))
    t = let(let(t, lambda t: where(t, DIGITS_SIGN, thousands(dates(t)))), spaced)
    return F.when(strip(filled(text)) == "", text).otherwise(strip(t))


def clean_numbers(text: Column) -> Column:
    """Without the commas between thousands."""
    return replaced(filled(text), ",", r"(?<=\d),(?=\d{3})", "")


def plain_number(number: Column) -> Column:
    """A number in its shortest form: no leading zeros, no zeros behind the last decimal, no bare point."""
    whole = F.when(number.startswith("0"), F.regexp_replace(number, r"^0+(?=\d)", "")).otherwise(number)
    return F.when(F.contains(number, F.lit(".")), F.regexp_replace(F.regexp_replace(whole, "0+$", ""), r"\.$", "")).otherwise(whole)


def numbers(text: Column) -> Column:
    """Distinct plain numbers of a text in order of appearance."""
    return numbers_in(clean_numbers(text))


def numbers_in(clean: Column) -> Column:
    return F.array_distinct(F.transform(found_in(clean, NUMBER), plain_number))


def percents_in(clean: Column) -> Column:
    """Distinct percents of a text without commas between thousands."""
    return F.array_distinct(F.transform(where_has(clean, "%", found_in(clean, rf"(?U)({NUMBER})\s*%", 1)), lambda x: x.cast("double")))


def money_value(phrase: Column) -> Column:
    """The value of a phrase of numbers and units; null without a number."""
    parts = F.regexp_extract_all(filled(phrase), F.lit(rf"(?U)({NUMBER}\s*(?:조|억|천만|백만|만|천)?)"), F.lit(1))
    units = F.create_map(*[F.lit(x) for pair in MONEY_UNITS.items() for x in pair])

    def value(part: Column) -> Column:
        unit = F.regexp_extract(part, "(조|억|천만|백만|만|천)$", 1)
        return F.regexp_extract(part, f"({NUMBER})", 1).cast("double") * F.when(unit == "", F.lit(1.0)).otherwise(F.try_element_at(units, unit))

    return let(F.transform(parts, value), lambda p: F.when(F.size(p) > 0, F.aggregate(p, F.lit(0.0), lambda a, b: a + b)))


def money_in(clean: Column) -> Column:
    """Distinct amounts of a text without commas between thousands."""
    return F.array_distinct(F.transform(where_has(clean, "원", found_in(clean, MONEY, 1)), money_value))


def day_pairs_in(clean: Column) -> Column:
    """Distinct 'month.day' of Korean, dotted and spaced dates, in that order, then the further days of spans such as
    '8월 22일부터 이틀간', of a text without commas between thousands."""

    def dated(sign: str, pattern: str) -> Column:
        def pair(date: Column) -> Column:
            month, day = (F.regexp_extract(date, pattern, i).cast("int") for i in (1, 2))
            told = F.concat(month.cast("string"), F.lit("."), day.cast("string"))
            return F.when(month.between(1, 12), told) if pattern == SPACED_DATE else told

        return F.filter(F.transform(where_has(clean, sign, found_in(clean, pattern)), pair), lambda x: x.isNotNull())

    found = [dated("월", KOREAN_DATE), dated(".", DOTTED_DATE), dated(".", SPACED_DATE)]
    spans = where_has(clean, "부터", found_in(clean, rf"{KOREAN_DATE}\s*부터\s*(?:{'|'.join(DURATION_DAYS)})간"))
    return F.array_distinct(F.concat(*found, F.flatten(F.transform(spans, further_days))))


def further_days(span: Column) -> Column:
    """'month.day' of the second day and those after it of a span of days."""
    month, first = (F.regexp_extract(span, KOREAN_DATE, i).cast("int") for i in (1, 2))
    days = None
    for word, n in DURATION_DAYS.items():
        days = F.when(F.contains(span, F.lit(word)), n) if days is None else days.when(F.contains(span, F.lit(word)), n)
    return F.transform(F.sequence(F.lit(1), days - 1), lambda k: F.concat(month.cast("string"), F.lit("."), (first + k).cast("string")))


def known_numbers(text: Column, clean: Column, days: Column) -> Column:
    """Plain numbers that a text states: written ones, months and days of its dates, and number words. ``clean`` and
    ``days``: the text without commas between thousands, and its dates."""
    # of words that begin alike all stand for one number, so the first that fits tells it
    values = F.create_map(*[F.lit(x) for word, n in NUMBER_WORDS.items() for x in (word, str(n))])
    words = F.transform(found_in(text, rf"(?U)(?:^|[\s(])({'|'.join(NUMBER_WORDS)})", 1), lambda w: F.try_element_at(values, w))
    return F.array_union(numbers_in(clean), F.array_union(F.flatten(F.transform(days, lambda d: F.split(d, r"\."))), words))


def found_in(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def day_of(date: Column, pattern: str) -> Column:
    """'month.day' of one date of the form ``pattern``."""
    return F.concat_ws(".", *(F.regexp_extract(date, pattern, i).cast("int").cast("string") for i in (1, 2)))


def stated(text: Column) -> Column:
    """STRUCT<percents, money, days, known> of a text."""

    def told(x: Column) -> Column:
        text, clean = x["text"], x["clean"]
        return let(day_pairs_in(clean), lambda d: F.struct(percents_in(clean).alias("percents"), money_in(clean).alias("money"), d.alias("days"), known_numbers(text, clean, d).alias("known")))

    return let(F.struct(filled(text).alias("text"), clean_numbers(text).alias("clean")), told)


def missing_numbers(source: Column, output: Column) -> Column:
    """Numbers of ``source`` that ``output`` has not, rising; amounts, percents and dates carried over by value are
    there."""

    def missing(x: Column) -> Column:
        text, have = x["text"], x["have"]
        kept_money = F.filter(where_has(text, "원", found_in(text, MONEY)), lambda m: F.array_contains(have["money"], money_value(m)))
        kept_percent = F.filter(where_has(text, "%", found_in(text, rf"(?U){NUMBER}\s*%")), lambda p: F.array_contains(have["percents"], F.regexp_extract(p, f"({NUMBER})", 1).cast("double")))
        kept_dates = F.filter(where_has(text, "월", found_in(text, KOREAN_DATE)), lambda d: F.array_contains(have["days"], day_of(d, KOREAN_DATE)))
        masked = F.aggregate(F.concat(kept_money, kept_percent, kept_dates), text, lambda t, span: F.replace(t, span, F.lit(" ")))
        return F.array_sort(F.array_except(numbers(masked), have["known"]), lambda a, b: F.when(a.cast("double") < b.cast("double"), -1).when(a.cast("double") > b.cast("double"), 1).otherwise(0))

    return let(F.struct(clean_numbers(source).alias("text"), stated(output).alias("have")), missing)


PROBLEMS = "array<struct<kind:string,shown:string>>"


def problems(kind: str, shown: Column) -> Column:
    """ARRAY<STRUCT<kind, shown>> of the strings ``shown``."""
    return F.transform(shown, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("shown")))


def invented_facts(line: Column, source: Column) -> Column:
    """Percents, amounts, dates and numbers of ``line`` that its ``source`` has not, as ARRAY<STRUCT<kind, shown>>.

    Each kind is compared by value with its own kind, and what one kind has claimed is no match for the next.
    Option numbers such as (1안) are exempt.
    """

    percent = rf"(?U){NUMBER}\s*%"

    def left(text: Column, done: tuple, after) -> Column:
        """``after`` with ``done`` and the text, then the text without each kind's finds."""
        if len(done) == 4:
            return after((*done, text))
        sign, pattern = (("%", percent), ("원", MONEY), (".", DOTTED_DATE), ("월", KOREAN_DATE))[len(done)]
        return let(text, lambda t: left(replaced(t, sign, pattern, " "), (*done, t), after))

    def compared(x: Column) -> Column:
        have = x["have"]
        new_date = lambda d, form: ~F.array_contains(have["days"], day_of(d, form))
        new_number = lambda n: ~F.array_contains(have["known"], plain_number(n))

        def shown(rest: tuple) -> Column:
            return F.concat(
                problems("percent", F.filter(where_has(rest[0], "%", found_in(rest[0], percent)), lambda p: ~F.array_contains(have["percents"], F.regexp_extract(p, f"({NUMBER})", 1).cast("double")))),
                problems("money", F.transform(F.filter(where_has(rest[1], "원", found_in(rest[1], MONEY)), lambda m: ~F.array_contains(have["money"], money_value(m))), strip)),
                problems("date", F.filter(where_has(rest[2], ".", found_in(rest[2], DOTTED_DATE)), lambda d: new_date(d, DOTTED_DATE) & new_number(d))),
                problems("date", F.filter(where_has(rest[3], "월", found_in(rest[3], KOREAN_DATE)), lambda d: new_date(d, KOREAN_DATE))),
                problems("number", F.array_distinct(F.filter(found_in(rest[4], NUMBER), new_number))),
            )

        return left(replaced(x["line"], "안", r"(?U)\(?\d+\s*안\)?", " "), (), shown)

    # without a digit a line states no fact, and its source needs no look
    read = lambda t: let(F.struct(t.alias("line"), stated(source).alias("have")), compared)
    return let(clean_numbers(line), lambda t: F.when(t.rlike(r"(?U)\d"), read(t)).otherwise(F.array().cast(PROBLEMS)))


def invented_numbers(line: Column, source: Column) -> Column:
    """What ``invented_facts`` shows, in its order."""
    return F.transform(invented_facts(line, source), lambda p: p["shown"])


def foreign_words(line: Column, source: Column) -> Column:
    """Latin words of ``line`` that ``source`` has not, whatever their case; the report's words for terms of the source
    are no foreign ones."""
    words = lambda t: F.transform(found_in(t, "[A-Za-z][A-Za-z&]*"), F.lower)
    allowed = words(filled(source))
    for term, other in TERMS.items():
        allowed = F.concat(allowed, F.when(F.contains(filled(source), F.lit(term)), words(F.lit(other))).otherwise(F.array().cast("array<string>")))
    return F.when(filled(line).rlike("[A-Za-z]"), F.array_except(words(filled(line)), allowed)).otherwise(F.array().cast("array<string>"))


def foreign_hanja(line: Column, source: Column) -> Column:
    """Chinese characters of ``line`` that are neither allowed nor in ``source``, in order."""
    return F.filter(F.array_distinct(found_in(filled(line), "[一-鿿]")), lambda c: ~F.contains(F.lit(ALLOWED_HANJA), c) & ~F.contains(filled(source), c))


def stems(text: Column) -> Column:
    """The first two letters of Korean words, without those that carry no meaning."""
    return F.filter(F.array_distinct(F.transform(found_in(text, "[가-힣]{2,}"), lambda w: F.left(w, F.lit(2)))), lambda w: ~w.isin(*HEDGE_STOPWORDS))


def unhedged(line: Column, source: Column) -> Column:
    """The clauses of ``source`` that call something possible which ``line`` states flatly; at most the first."""

    def told(x: Column) -> Column:
        clause, text = x["clause"], x["line"]
        words = F.filter(F.split(F.regexp_extract(clause, rf"(?s)^(.*?)(?:{'|'.join(HEDGES)})", 1), r"(?U)\s+", -1), lambda w: w != "")
        predicate = F.regexp_replace(F.element_at(words, -1), "[ㄹ을를]$", "")
        same = None
        for start, forms in HEDGE_PREDICATES.items():
            hit = text.rlike("|".join(forms))
            same = F.when(predicate.startswith(start), hit) if same is None else same.when(predicate.startswith(start), hit)
        same = same.otherwise(F.contains(text, F.left(predicate, F.lit(2))))
        return F.when(F.size(words) == 0, False).otherwise(same) & (F.size(F.array_intersect(stems(text), stems(clause))) >= HEDGE_OVERLAP)

    text = clean_numbers(line)
    clauses = F.filter(F.split(clean_numbers(source), r"(?U)[,，.]|(?<=[고며서만])\s", -1), lambda c: c.rlike("|".join(HEDGES)))
    flat = F.filter(clauses, lambda c: let(F.struct(c.alias("clause"), text.alias("line")), told))
    settled = ~filled(source).rlike("|".join(HEDGES)) | text.rlike("|".join(HEDGED_LINE))
    return F.when(settled, F.array().cast("array<string>")).otherwise(F.transform(F.slice(flat, 1, 1), lambda c: F.left(strip(c), F.lit(24))))


def lost_bounds(line: Column, source: Column) -> Column:
    """Numbers with a bound ('3개월 이상') of ``source`` that ``line`` carries without one."""
    text, pattern = clean_numbers(line), rf"(?U)({NUMBER})\s*([가-힣]{{0,3}})\s*(?:{'|'.join(BOUNDS)})"
    kept = "|".join(b.replace("+", r"\+") for b in BOUNDS_KEPT)

    def lost(shown: Column) -> Column:
        number, unit = F.regexp_extract(shown, pattern, 1), F.regexp_extract(shown, pattern, 2)
        bare = F.concat(F.lit(r"(?U)(?<![\d.])"), F.replace(number, F.lit("."), F.lit(r"\.")), F.lit(r"\s*"), unit, F.lit(rf"(?!\s*[가-힣]{{0,3}}\s*(?:{kept}))"))
        return F.regexp_like(text, bare)

    return F.filter(found_in(clean_numbers(source), pattern), lost)


def unshown_progress(line: Column, source: Column) -> Column:
    """Words that ``line`` calls under way ('협의 中') where ``source`` names them without saying so near them."""
    found = rf"(?U)([가-힣]{{2,}})\s*(?:{'|'.join(PROGRESS)})(?=\s*(?:[)\]\-,/·]|\d|$))"

    def unshown(word: Column) -> Column:
        near = F.concat(F.lit("(?s)(?=("), F.left(word, F.lit(2)), F.lit(".{0,"), (F.char_length(word) + 10).cast("string"), F.lit("}))"))
        windows = F.regexp_extract_all(clean_numbers(source), near, F.lit(1))
        return (F.size(windows) > 0) & ~F.exists(windows, lambda w: w.rlike("|".join(PROGRESS_SHOWN)))

    return F.when(filled(line).rlike("|".join(PROGRESS)), F.filter(found_in(clean_numbers(line), found, 1), unshown)).otherwise(F.array().cast("array<string>"))


def coined_words(line: Column, source: Column) -> Column:
    """Words in ``line`` made of the beginnings of two neighbouring verb forms of ``source`` that it has not itself."""
    words, tokens = found_in(filled(source), "[가-힣]+"), found_in(filled(line), "[가-힣]+")

    def beginnings(word: Column) -> Column:
        places = F.when(F.char_length(word) > 1, F.sequence(F.lit(1), F.char_length(word) - 1)).otherwise(F.array().cast("array<int>"))
        verbal = F.filter(places, lambda k: F.substring(word, k + 1, F.char_length(word)).rlike(f"^(?:{'|'.join(VERBAL_TAILS)})"))
        return F.transform(verbal, lambda k: F.left(word, k))

    def found(x: Column) -> Column:
        pairs = F.zip_with(x["words"], F.slice(x["words"], 2, F.greatest(F.size(x["words"]) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        made = F.flatten(F.transform(F.filter(pairs, lambda p: p["b"].isNotNull()), lambda p: F.flatten(F.transform(beginnings(p["a"]), lambda h: F.transform(beginnings(p["b"]), lambda t: F.concat(h, t))))))
        fits = lambda m: (F.char_length(m) >= 3) & ~F.contains(x["flat"], m) & F.exists(x["tokens"], lambda t: F.contains(t, m))
        return F.array_distinct(F.filter(made, fits))

    return let(F.struct(words.alias("words"), tokens.alias("tokens"), F.regexp_replace(filled(source), r"(?U)\s", "").alias("flat")), found)


def weekday_problems(text: Column, year: int) -> Column:
    """Weekdays in '9.5(토)', and in range ends '~ 23(일)' of the last month named so, that the year's calendar
    contradicts ('weekday'), and dates that it has not ('no_date'), as ARRAY<STRUCT<kind, shown>>."""
    day_form, end_form = rf"(?U)(?<![\d.])(\d{{1,2}})\.(\d{{1,2}})\s*\(([{WEEKDAYS}])\)", rf"(?U)~\s*(\d{{1,2}})\s*\(([{WEEKDAYS}])\)"

    def problem(shown: Column, month: Column, day: Column, named: Column) -> Column:
        date = F.try_to_date(F.concat_ws("-", F.lit(str(year)), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))
        actual = F.substring(F.lit(WEEKDAYS), F.weekday(date) + 1, F.lit(1))
        return F.when(date.isNull(), F.struct(F.lit("no_date").alias("kind"), shown.alias("shown"))).when(actual != named, F.struct(F.lit("weekday").alias("kind"), shown.alias("shown")))

    def found(t: Column) -> Column:
        last_month = F.element_at(F.concat(F.array(F.lit("")), found_in(t, day_form, 1)), -1)
        days = F.transform(found_in(t, rf"{day_form}"), lambda s: problem(s, *(F.regexp_extract(s, day_form, i) for i in (1, 2, 3))))
        ends = F.transform(found_in(t, end_form), lambda s: F.when(last_month != "", problem(s, last_month, F.regexp_extract(s, end_form, 1), F.regexp_extract(s, end_form, 2))))
        return F.filter(F.concat(days, ends), lambda p: p.isNotNull())

    return let(clean_numbers(text), lambda t: where_has(t, "(", found(t), PROBLEMS))


def date_shapes(text: Column) -> Column:
    """Dates of any form in a text with every digit as 9."""
    any_date = r"(?U)((?:19|20)?\d{2}\s*[.\-/년]\s*\d{1,2}\s*[.\-/월]\s*\d{1,2}\s*[.일]?)"
    return F.transform(F.regexp_extract_all(filled(text), F.lit(any_date), F.lit(1)), lambda d: F.regexp_replace(d, r"\d", "9"))
