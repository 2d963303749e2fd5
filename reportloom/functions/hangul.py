"""Formal Korean endings as Spark columns: rule lists are folded into first-match-wins CASE expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SENTENCE_END, filled, let, strip

# Rule lists in their order, the first match wins.
SUFFIXES = (
    ("하였습니다", "하였음"), ("했습니다", "하였음"), ("드렸습니다", "드렸음"), ("입니다", "임"), ("아닙니다", "아님"),
    ("습니다", "음"), ("합니다", "함"), ("됩니다", "됨"), ("봅니다", "봄"), ("옵니다", "옴"), ("갑니다", "감"),
    ("바랍니다", "바람"), ("드립니다", "드림"), ("주십시오", "요청함"), ("주시기 바랍니다", "요청함"),
    ("해 주세요", "요청함"), ("하세요", "요청함"), ("하였다", "하였음"), ("했다", "하였음"), ("한다", "함"),
    ("된다", "됨"), ("되었다", "되었음"), ("됐다", "되었음"), ("이다", "임"), ("있다", "있음"), ("없다", "없음"),
    ("같다", "같음"), ("많다", "많음"), ("적다", "적음"), ("높다", "높음"), ("낮다", "낮음"), ("크다", "큼"),
    ("작다", "작음"), ("빠르다", "빠름"), ("느리다", "느림"), ("쉽다", "쉬움"), ("어렵다", "어려움"), ("좋다", "좋음"),
    ("나쁘다", "나쁨"), ("다르다", "다름"), ("필요하다", "필요함"), ("가능하다", "가능함"), ("예정이다", "예정임"),
    ("계획이다", "계획임"), ("보인다", "보임"), ("생각된다", "판단됨"), ("판단된다", "판단됨"), ("예상된다", "예상됨"),
    ("요구된다", "요구됨"), ("기대된다", "기대됨"),
)
NOMINAL = ("하였습니다", "했습니다", "였습니다", "았습니다", "었습니다", "습니다", "하였다", "였다", "았다", "었다", "한다", "는다", "ㄴ다")
KEPT = ("등", "외", "님")
NOUN_ENDINGS = (
    ("해야 합니다", " 필요"), ("해야 함", " 필요"), ("할 예정입니다", " 예정"), ("할 예정임", " 예정"),
    ("할 예정이다", " 예정"), ("될 예정입니다", " 예정"), ("될 예정임", " 예정"), (" 중입니다", " 중"), (" 중임", " 중"),
    ("하고 있습니다", " 중"), ("하고 있음", " 중"), ("하였습니다", ""), ("했습니다", ""), ("하였음", ""), ("했음", ""),
    ("하였다", ""), ("했다", ""), ("합니다", ""), ("한다", ""), ("함", ""), ("되었습니다", ""), ("됐습니다", ""),
    ("되었음", ""), ("되었다", ""), ("됩니다", ""), ("된다", ""), ("됨", ""), ("입니다", ""), ("이다", ""), ("임", ""),
)
PARTICLES = ("을", "를", "이", "가")
ADVERB = "적으로"
REPLACED = (
    ("하고 있습니다", "하고 있음"), ("하고 있음.", "중임."), ("인 것 같습니다", "로 판단됨"), ("인 것 같음", "로 판단됨"),
    ("할 예정입니다", "할 예정임"), ("감사합니다.", ""), ("수고하셨습니다.", ""), ("참고 부탁드립니다.", "참고 요망"),
    ("확인 부탁드립니다.", "확인 요망"), ("   ", " "), ("  ", " "),
)
CONNECTIVES = ("하고", "하며", "되며", "이며", "이고", "지만", "으나", "라서", "따라서")
FIRST, LAST = 0xAC00, 0xD7A3
FINAL_RIEUL, FINAL_RIEUL_MIEUM, FINAL_MIEUM, FINAL_BIEUP = 8, 10, 16, 17


def letter(code: Column) -> Column:
    """The character of a code point below U+10000."""
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 4, "0")), "UTF-16BE")


def without_end(text: Column, n: Column | int) -> Column:
    return F.substring(text, F.lit(1), F.char_length(text) - n)


def last_code(text: Column) -> Column:
    return F.ascii(F.right(text, F.lit(1)))


def is_syllable(code: Column) -> Column:
    return code.between(FIRST, LAST)


def final_of(code: Column) -> Column:
    """The number of a syllable's final consonant, 0 for none."""
    return F.pmod(code - FIRST, F.lit(28))


def nominalize(stem: Column) -> Column:
    """A stem with the nominal ending: a final ㅁ after a vowel, ㄻ for ㄹ, else 음 behind."""
    s = F.regexp_replace(stem, r"(?U)\s+$", "")
    code = last_code(s)
    return (
        F.when(s == "", s)
        .when(~is_syllable(code), F.concat(s, F.lit("음")))
        .when(final_of(code) == 0, F.concat(without_end(s, 1), letter(code + FINAL_MIEUM)))
        .when(final_of(code) == FINAL_RIEUL, F.concat(without_end(s, 1), letter(code - FINAL_RIEUL + FINAL_RIEUL_MIEUM)))
        .otherwise(F.concat(s, F.lit("음")))
    )


def drop_particle(word: Column) -> Column:
    """A word without its object or subject particle, where one fits the syllable before it."""
    rest, code = without_end(word, 1), last_code(without_end(word, 1))
    fits = F.when(F.right(word, F.lit(1)).isin("을", "이"), final_of(code) != 0).otherwise(final_of(code) == 0)
    ends = F.right(word, F.lit(1)).isin(*PARTICLES)
    return F.when(ends & (F.char_length(rest) >= 2) & is_syllable(code) & fits, rest).otherwise(word)


def tidy_before_noun(words: Column) -> Column:
    """Words before the last one: adverbs in ADVERB become nouns, going left, then one particle is dropped."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(False).alias("stop"))
    left = F.reverse(F.slice(words, F.lit(1), F.size(words) - 1))

    def step(state: Column, word: Column) -> Column:
        adverb = word.endswith(ADVERB) & (F.char_length(word) > len(ADVERB) + 1)
        kept = F.when(state["stop"], word).when(adverb, without_end(word, len(ADVERB))).otherwise(drop_particle(word))
        return F.struct(F.concat(F.array(kept), state["done"]).alias("done"), (state["stop"] | ~adverb).alias("stop"))

    return F.concat(F.aggregate(left, start, step, lambda s: s["done"]), F.slice(words, -1, 1))


def noun_phrase(core: Column) -> Column:
    """A sentence ended by its noun; null where the first fitting ending leaves no noun of two syllables."""
    which = None
    for i, (end, _) in enumerate(NOUN_ENDINGS):
        which = F.when(core.endswith(end), i) if which is None else which.when(core.endswith(end), i)
    ends, tails = (F.array(*[F.lit(e[k]) for e in NOUN_ENDINGS]) for k in (0, 1))

    def named(p: Column) -> Column:
        last = F.element_at(p["words"], -1)
        good = (p["stem"] != "") & ~p["stem"].rlike(r"(?U)\s$") & (F.char_length(last) >= 2) & is_syllable(last_code(last))
        return F.when(good, F.concat(F.array_join(tidy_before_noun(p["words"]), " "), p["tail"]))

    def cut(i: Column) -> Column:
        stem = without_end(core, F.char_length(F.get(ends, i)))
        return F.when(i.isNotNull(), let(F.struct(stem.alias("stem"), F.split(stem, " ", -1).alias("words"), F.get(tails, i).alias("tail")), named))

    return let(which, cut)


def formal_sentence(sentence: Column, noun_ending: bool = False) -> Column:
    """One sentence in formal nominal style; with ``noun_ending`` nouns come first and stops are dropped."""

    def ended(p: Column) -> Column:
        core, punct, trailing = p["core"], p["punct"], p["trailing"]
        out = F.when((core == "") | core.rlike(f"(?:{'|'.join(KEPT)})$"), p["whole"])
        if noun_ending:
            out = out.when(p["noun"].isNotNull(), F.concat(p["noun"], trailing))
        for end, other in SUFFIXES:
            out = out.when(core.endswith(end), F.concat(without_end(core, len(end)), F.lit(other), punct, trailing))
        for end in NOMINAL:
            out = out.when(core.endswith(end) & (F.char_length(core) > len(end)), F.concat(nominalize(without_end(core, len(end))), punct, trailing))
        return out.otherwise(p["whole"])

    def parts(s: Column) -> Column:
        body = F.regexp_replace(s, r"(?U)\s+$", "")
        punct = F.lit("") if noun_ending else F.regexp_extract(body, r"([.!?]*)$", 1)
        trailing = F.regexp_extract(s, r"(?U)(\s*)$", 1)
        core = F.regexp_replace(F.regexp_replace(body, r"[.!?]+$", ""), r"(?U)\s+$", "")
        return F.struct(s.alias("whole"), core.alias("core"), punct.alias("punct"), trailing.alias("trailing"))

    def with_noun(p: Column) -> Column:
        noun = noun_phrase(p["core"]) if noun_ending else F.lit(None).cast("string")
        return F.struct(p["whole"].alias("whole"), p["core"].alias("core"), p["punct"].alias("punct"), p["trailing"].alias("trailing"), noun.alias("noun"))

    return let(sentence, lambda s: let(parts(s), lambda p: let(with_noun(p), ended)))


def formal_text(text: Column, noun_ending: bool = False) -> Column:
    """A text in formal nominal style: replacements anywhere, then sentence by sentence; blank texts stay."""

    def convert(t: Column) -> Column:
        u = t
        for before, after in REPLACED:
            u = F.replace(u, F.lit(before), F.lit(after))
        parts = F.transform(F.split(u, SENTENCE_END, -1), lambda s: formal_sentence(s, noun_ending))
        return F.when(strip(t) == "", t).otherwise(strip(F.array_join(F.filter(parts, lambda s: strip(s) != ""), " ")))

    return F.when(text.isNotNull(), let(filled(text), convert))


def heading_noun_ending(text: Column) -> Column:
    """A heading ended by its noun; headings that no noun ending fits stay as they are."""

    def convert(t: Column) -> Column:
        trailing = F.regexp_extract(t, r"(?U)(\s*)$", 1)
        kept = lambda core: F.when((core == "") | core.rlike(f"(?:{'|'.join(KEPT)})$"), t).otherwise(F.coalesce(F.concat(noun_phrase(core), trailing), t))
        return let(F.regexp_replace(t, r"(?U)\s+$", ""), kept)

    return F.when(text.isNotNull(), let(filled(text), convert))


def bieup_to_mieum(text: Column) -> Column:
    """~ㅂ니다 as a noun: the final ㅂ of the syllable before 니다 becomes ㅁ."""
    code = F.ascii(F.substring(text, F.char_length(text) - 2, F.lit(1)))
    fits = text.endswith("니다") & (F.char_length(text) >= 3) & is_syllable(code) & (final_of(code) == FINAL_BIEUP)
    return F.when(fits, F.concat(without_end(text, 3), letter(code - 1))).otherwise(text)


@dataclass(frozen=True)
class StyleRules:
    """Fixed values of the style check: what ends, opens or fills a line that is no report line."""

    line_chars: int = 45
    connectives_max: int = 2
    polite: tuple[str, ...] = ("니다", "어요", "아요", "해요", "에요", "예요", "세요", "군요", "네요", "죠", "거든요", "는데요", "인데요")
    speaker: tuple[str, ...] = ("저는", "제가", "저희", "우리가", "생각합니다", "생각됩니다", "보고드립니다", "제안드립니다", "건의드립니다", "것 같", "듯합니다", "싶습니다", "보입니다", "봅니다", "하려고 합니다", "할 계획입니다")
    fillers: tuple[str, ...] = ("일단", "사실", "그리고", "그래서", "또한", "참고로", "한편", "아무래도", "그런데", "그러므로", "그러나")
    adverbs: tuple[str, ...] = ("굉장히", "아주", "너무", "꽤", "정말", "엄청", "매우", "상당히", "좀", "조금", "거의")
    connectives: tuple[str, ...] = ("는데", "인데", "했고", "하고", "했으며", "하며", "이며", "지만", "라서", "해서", "아서", "어서", "으니", "니까", "면서", "다가", "는데도", "기 때문에", "때문에", "것인데", "고 있는데")
    irregular: tuple[tuple[str, str], ...] = (("어렵음", "어려움"), ("쉽음", "쉬움"), ("가깝음", "가까움"), ("무겁음", "무거움"), ("가볍음", "가벼움"), ("덥음", "더움"), ("춥음", "추움"), ("아름답음", "아름다움"), ("어두웁음", "어두움"), ("고맙음", "고마움"))
    notation: tuple[tuple[str, str], ...] = (
        (r"(?U)(\d)\s*([조억만천])\s+원", "$1$2원"),
        (r"(?U)(?<=[만억천])\s+원", "원"),
        (r"(?U)(\d[\d,]*명)\s*중\s*(?=\d)", "$1 中 "),
        (r"(?U)(\d[\d,]*건)\s*중\s*(?=\d)", "$1 中 "),
        (r"(?U)((?:협의|검토|진행|논의|준비|조율|확인|심사|선발))\s*중(?=[\s,)]|$)", "$1 中"),
        (r"(?U)(\d)\s*퍼센트", "$1%"),
        (r"(?U)\s+%", "%"),
        (r"[ \t]{2,}", " "),
        (r"(?U)\s+([,.)])", "$1"),
    )


STYLE = StyleRules()
HEAD = r"^(?U:\s*(?:□|-|∙|→|※|\*|[①-⑳]|\d+\.)\s*)"


def has_polite_or_plain_end(body: Column, rules: StyleRules = STYLE) -> tuple[Column, Column]:
    tail = F.regexp_replace(body, r"(?U)[\s.!?。]+$", "")
    return tail.rlike(f"(?:{'|'.join(rules.polite)})$"), tail.rlike("[가-힣]다$")


def lint(text: Column, rules: StyleRules = STYLE) -> Column:
    """ARRAY<STRUCT<kind, hard>> of what a line has that report style has not, in a fixed order."""

    def issues(body: Column) -> Column:
        polite, plain = has_polite_or_plain_end(body, rules)
        connectives = F.size(F.filter(F.array(*[F.lit(c) for c in rules.connectives]), lambda c: F.contains(body, c)))
        found = [
            (polite, "polite", True),
            (~polite & plain, "plain", True),
            (body.rlike("|".join(rules.speaker)), "speaker", True),
            (body.rlike(r"(?U)[.!?。]\s*$"), "period", True),
            (body.rlike(rf"(?U)^(?:{'|'.join(rules.fillers)})[\s,]"), "filler", False),
            (F.char_length(F.regexp_replace(body, r"(?U)\s", "")) > rules.line_chars, "long", False),
            (connectives > rules.connectives_max, "connectives", False),
            (body.rlike(rf"(?U)(?:^|\s)(?:{'|'.join(rules.adverbs)})\s"), "adverb", False),
        ]
        return F.filter(F.array(*[F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(hard).alias("hard"))) for test, kind, hard in found]), lambda i: i.isNotNull())

    return let(F.regexp_replace(strip(filled(text)), HEAD, ""), issues)


def hard_issues(text: Column, rules: StyleRules = STYLE) -> Column:
    return F.filter(lint(text, rules), lambda i: i["hard"])


def style_fix(text: Column, rules: StyleRules = STYLE) -> Column:
    """A line with fillers, loose notation and spoken endings put right; its leading mark stays."""

    def noun_end(body: Column) -> Column:
        polite, plain = has_polite_or_plain_end(body, rules)
        bare = F.regexp_replace(body, r"(?U)[\s.!?。]+$", "")
        ended = let(F.regexp_replace(formal_text(bare, True), r"(?U)[\s.!?。]+$", ""), bieup_to_mieum)
        return F.regexp_replace(F.regexp_replace(F.when(polite | plain, ended).otherwise(body), r"[.!?。]+$", ""), r"(?U)\s+$", "")

    def regular(body: Column) -> Column:
        out = None
        for wrong, right in rules.irregular:
            value = F.concat(without_end(body, len(wrong)), F.lit(right))
            out = F.when(body.endswith(wrong), value) if out is None else out.when(body.endswith(wrong), value)
        return strip(out.otherwise(body))

    def fixed(line: Column) -> Column:
        body = F.substring(line["whole"], F.char_length(line["head"]) + 1, F.lit(2_000_000_000))
        for filler in rules.fillers:
            body = F.regexp_replace(body, rf"(?U)^{filler}[\s,]+", "")
        for pattern, other in rules.notation:
            body = F.regexp_replace(body, pattern, other)
        return F.concat(line["head"], let(let(body, noun_end), regular))

    return let(F.struct(filled(text).alias("whole"), F.regexp_extract(filled(text), f"({HEAD})", 1).alias("head")), fixed)
