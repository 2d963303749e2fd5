"""Shorter forms of table headers, and sentences cut into shorter parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hangul import CONNECTIVES, formal_sentence
from .text import SENTENCE_END, filled, let, strip

# Words left out, abbreviations, and what ends the part that is kept.
DROPPED = ("평균", "향후", "주요", "세부", "관련", "전체", "해당")
SHORTER = (("담당 부서", "담당"), ("협조 부서", "협조"), ("소요 예산", "예산"), ("추진 일정", "일정"), ("기대 효과", "효과"), ("조치 계획", "조치"))
KEPT_BEFORE = (" 및 ", "/", "·", ", ")
PARENTHESES = r"(?U)\s*[(\[（][^)\]）]*[)\]）]"


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+", -1), lambda w: w != "")


def tidy(text: Column, other: Column) -> Column:
    """White space made single; ``other`` where nothing is left."""
    return F.coalesce(F.nullif(F.array_join(words(text), " "), F.lit("")), other)


def without_parentheses(text: Column) -> Column:
    return tidy(F.regexp_replace(text, PARENTHESES, ""), text)


def without_fillers(text: Column) -> Column:
    return tidy(F.array_join(F.filter(words(text), lambda w: ~w.isin(*DROPPED)), " "), text)


def abbreviated(text: Column) -> Column:
    out = text
    for before, after in SHORTER:
        out = F.replace(out, F.lit(before), F.lit(after))
    return tidy(out, text)


def without_shared_suffix(text: Column, peers: Column) -> Column:
    """Without the words at the end that it shares with another header of the row; one word stays at least."""

    def shared(own: Column, peer: Column) -> Column:
        a, b = F.reverse(own), F.reverse(words(peer))
        most = F.least(F.size(a), F.size(b)) - 1
        start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("go"))
        places = F.when(most > 0, F.sequence(F.lit(0), most - 1)).otherwise(F.array().cast("array<int>"))
        step = lambda s, i: F.struct((s["n"] + (s["go"] & (F.get(a, i) == F.get(b, i))).cast("int")).alias("n"), (s["go"] & (F.get(a, i) == F.get(b, i))).alias("go"))
        return F.aggregate(places, start, step, lambda s: s["n"])

    def cut(own: Column) -> Column:
        best = F.coalesce(F.array_max(F.transform(peers, lambda p: shared(own, p))), F.lit(0))
        return F.array_join(F.slice(own, F.lit(1), F.size(own) - best), " ")

    return let(words(text), cut)


def first_part(text: Column) -> Column:
    """What stands before the first separator of KEPT_BEFORE that has something before it."""
    out = None
    for sep in KEPT_BEFORE:
        head = F.substring_index(text, sep, 1)
        hit = F.contains(text, F.lit(sep)) & (strip(head) != "")
        out = F.when(hit, head) if out is None else out.when(hit, head)
    return tidy(out.otherwise(text), text)


def header_candidates(text: Column, siblings: Column) -> Column:
    """Ever shorter forms of a header, each step on top of the one before; forms that change nothing are left out."""
    basic = lambda t: let(let(without_parentheses(t), without_fillers), abbreviated)
    peers = F.transform(F.filter(siblings, lambda s: s != text), basic)

    def chain(a: Column) -> Column:
        def with_b(b: Column) -> Column:
            def with_c(c: Column) -> Column:
                def with_d(d: Column) -> Column:
                    def with_e(e: Column) -> Column:
                        steps = F.array(filled(text), a, b, c, d, e, F.replace(e, F.lit(" "), F.lit("")))
                        changed = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.when(F.get(steps, i) != F.get(steps, i - 1), F.get(steps, i)))
                        return F.filter(changed, lambda x: x.isNotNull() & (x != ""))

                    return let(first_part(d), with_e)

                return let(without_shared_suffix(c, peers), with_d)

            return let(abbreviated(b), with_c)

        return let(without_fillers(a), with_b)

    return let(without_parentheses(filled(text)), chain)


def sentence_parts(text: Column) -> Column:
    """Sentences of a text; parts without any letter or digit join the next sentence, at the end the last one."""
    parts = F.filter(F.split(filled(text), SENTENCE_END, -1), lambda s: strip(s) != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))
    joined = lambda held, s: F.when(held == "", s).otherwise(strip(F.concat(held, F.lit(" "), s)))

    def step(a: Column, s: Column) -> Column:
        bare, whole = ~s.rlike("[0-9A-Za-z가-힣]"), joined(a["held"], s)
        return F.struct(F.when(bare, a["done"]).otherwise(F.concat(a["done"], F.array(whole))).alias("done"), F.when(bare, whole).otherwise("").alias("held"))

    def end(a: Column) -> Column:
        n = F.size(a["done"])
        last = F.when(n == 0, F.array(a["held"])).otherwise(F.concat(F.slice(a["done"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(strip(F.concat(F.get(a["done"], n - 1), F.lit(" "), a["held"])))))
        return F.when(a["held"] == "", a["done"]).otherwise(last)

    return F.aggregate(parts, start, step, end)


def split_at_connective(sentence: Column, most: int) -> Column:
    """A sentence over ``most`` characters cut once behind the first connective of the list with a comma after it:
    its head in formal style and the rest; else the sentence alone."""
    found = F.when(F.char_length(sentence) <= most, F.lit(None))
    for c in CONNECTIVES:
        mark = f"{c}, "
        at = F.instr(sentence, mark)
        fits = (at > 1) & (at - 1 < F.char_length(sentence) - len(mark))
        found = found.when(fits, F.struct((at - 1 + len(c)).alias("head"), (at + len(mark)).alias("rest")))

    # the formal style is a large expression: one for all connectives
    def cut(place: Column) -> Column:
        head = formal_sentence(F.concat(F.substring(sentence, F.lit(1), place["head"]), F.lit(".")))
        return F.when(place.isNull(), F.array(sentence)).otherwise(F.array(head, F.substring(sentence, place["rest"], F.lit(2_000_000_000))))

    return let(found, cut)


def split_long(text: Column, most: int = 60) -> Column:
    """A text as parts: sentences, and those over ``most`` characters cut at connectives. A head that is cut off is
    final; the rest is cut on while it is too long and has a connective, so a sentence takes at most as many steps as
    it has connectives with a comma."""
    if most <= 0:
        return sentence_parts(text)

    def cut(sentence: Column) -> Column:
        marks = F.regexp_count(sentence, F.lit(f"(?:{'|'.join(CONNECTIVES)}), "))
        steps = F.when(marks > 0, F.sequence(F.lit(1), marks)).otherwise(F.array().cast("array<int>"))
        start = F.struct(F.array().cast("array<string>").alias("done"), sentence.alias("rest"))
        taken = lambda a, two: F.struct(F.concat(a["done"], F.slice(two, F.lit(1), F.size(two) - 1)).alias("done"), F.element_at(two, -1).alias("rest"))
        step = lambda a, _: let(split_at_connective(a["rest"], most), lambda two: taken(a, two))
        return F.aggregate(steps, start, step, lambda a: F.concat(a["done"], F.array(a["rest"])))

    return F.flatten(F.transform(sentence_parts(text), cut))


def split_clauses(sentence: Column, least: int = 6) -> Column:
    """A sentence cut at commas and behind connective endings; fragments under ``least`` characters join the next."""
    pieces = F.filter(F.split(filled(sentence), r"(?U)[,，]\s*|(?<=[고며서만])\s", -1), lambda s: strip(s) != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def step(a: Column, s: Column) -> Column:
        whole = F.when(a["held"] == "", s).otherwise(F.concat(a["held"], F.lit(" "), s))
        short = F.char_length(whole) < least
        return F.struct(F.when(short, a["done"]).otherwise(F.concat(a["done"], F.array(whole))).alias("done"), F.when(short, whole).otherwise("").alias("held"))

    return F.aggregate(pieces, start, step, lambda a: F.when(a["held"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["held"]))))
