"""Texts held as styled runs: arrays of (text, bold, italic, code, href), and rewrites that keep their borders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

RUN = "struct<text:string,bold:boolean,italic:boolean,code:boolean,href:string>"
STYLE = ("bold", "italic", "code", "href")


def run(text: Column | str, bold: bool = False, italic: bool = False, code: bool = False, href: Column | None = None) -> Column:
    """One run. ``text`` is a column, or a literal string."""
    said = F.lit(text) if isinstance(text, str) else text
    flags = [F.lit(v).alias(n) for n, v in (("bold", bold), ("italic", italic), ("code", code))]
    return F.struct(said.alias("text"), *flags, (F.lit(None).cast("string") if href is None else href).alias("href"))


def with_text(r: Column, text: Column) -> Column:
    return F.struct(text.alias("text"), *[r[n].alias(n) for n in STYLE])


def alike(a: Column, b: Column) -> Column:
    """Whether two runs have the same style."""
    same = F.lit(True)
    for n in STYLE:
        same = same & a[n].eqNullSafe(b[n])
    return same


def plain(runs: Column) -> Column:
    """The text of runs without their styles; '' for none."""
    return F.coalesce(F.array_join(F.transform(runs, lambda r: r["text"]), ""), F.lit(""))


def uniform(runs: Column) -> Column:
    """Whether all runs have one style; true for none."""
    return F.coalesce(let(runs, lambda x: F.forall(x, lambda r: alike(r, F.get(x, 0)))), F.lit(True))


def filled_only(runs: Column) -> Column:
    return F.filter(runs, lambda r: r["text"] != "")


def merged(runs: Column) -> Column:
    """Neighbours of one style as one run; empty runs are left out."""

    def step(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joins = (F.size(done) > 0) & alike(last, r)
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(with_text(last, F.concat(last["text"], r["text"]))))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(filled_only(runs), F.array().cast(f"array<{RUN}>"), step)


def trimmed(runs: Column) -> Column:
    """Runs without white space at the start of the first and the end of the last; runs left empty go."""

    def cut(x: Column) -> Column:
        left = lambda i, t: F.when(i == 0, F.regexp_replace(t, r"(?U)^\s+", "")).otherwise(t)
        right = lambda i, t: F.when(i == F.size(x) - 1, F.regexp_replace(t, r"(?U)\s+$", "")).otherwise(t)
        return filled_only(F.transform(x, lambda r, i: with_text(r, right(i, left(i, r["text"])))))

    return let(runs, cut)


def lines(runs: Column) -> Column:
    """Runs parted at line ends: an array of runs for each line that holds more than white space."""
    pieces = F.flatten(F.transform(runs, lambda r: F.transform(F.split(r["text"], "\n", -1), lambda t, i: F.struct((i > 0).alias("starts"), with_text(r, t).alias("run")))))
    empty = F.array().cast(f"array<array<{RUN}>>")

    def step(done: Column, p: Column) -> Column:
        opened = p["starts"] | (F.size(done) == 0)
        last = F.coalesce(F.try_element_at(done, F.lit(-1)), F.array().cast(f"array<{RUN}>"))
        grown = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(last, F.array(p["run"]))))
        return F.when(opened, F.concat(done, F.array(F.array(p["run"])))).otherwise(grown)

    parted = F.transform(F.aggregate(pieces, empty, step), filled_only)
    return F.filter(parted, lambda x: plain(x).rlike(r"(?U)\S"))


def without_start(runs: Column, count: Column) -> Column:
    """Runs without their first ``count`` characters, over as many runs as these take."""
    start = F.struct(count.cast("int").alias("left"), F.array().cast(f"array<{RUN}>").alias("done"))

    def step(s: Column, r: Column) -> Column:
        rest = F.substr(r["text"], F.greatest(s["left"], F.lit(0)) + 1)
        return F.struct((s["left"] - F.char_length(r["text"])).cast("int").alias("left"), F.concat(s["done"], F.array(with_text(r, rest))).alias("done"))

    return filled_only(F.aggregate(runs, start, step, lambda s: s["done"]))


def rewritten(runs: Column, rule: Callable[[Column], Column], ending: Callable[[Column], Column] | None = None) -> Column:
    """Runs after a text rule. Runs of one style are one text, trimmed; mixed runs are rewritten one by one, so that their
    borders stay, each with its outer white space; code stays. ``ending`` follows at the end of the text only, in
    mixed runs in the last one."""
    whole = lambda t: ending(rule(t)) if ending else rule(t)

    def within(t: Column, last: Column) -> Column:
        def inside(x: Column) -> Column:
            body = F.when(last, whole(x["body"])).otherwise(rule(x["body"])) if ending else rule(x["body"])
            return F.concat(x["lead"], body, x["trail"])

        parts = F.struct(F.regexp_extract(t, r"(?U)^(\s*)", 1).alias("lead"), F.regexp_replace(t, r"(?U)^\s+|\s+$", "").alias("body"), F.when(t.rlike(r"(?U)\S"), F.regexp_extract(t, r"(?U)(\s*)$", 1)).otherwise("").alias("trail"))
        return let(parts, inside)

    def change(x: Column) -> Column:
        one = let(whole(F.regexp_replace(plain(x), r"(?U)^\s+|\s+$", "")), lambda t: F.when(t == "", F.array().cast(f"array<{RUN}>")).otherwise(F.array(with_text(F.get(x, 0), t))))
        each = F.transform(x, lambda r, i: F.when(r["code"], r).otherwise(with_text(r, within(r["text"], i == F.size(x) - 1))))
        return F.when(F.size(x) == 0, x).when(uniform(x), one).otherwise(filled_only(each))

    return let(runs, change)


def common_start(a: Column, b: Column) -> Column:
    """How many first characters two texts share."""
    same = F.zip_with(F.split(a, "", -1), F.split(b, "", -1), lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    return let(same, lambda s: F.when(F.array_position(s, F.lit(False)) > 0, F.array_position(s, F.lit(False)).cast("int") - 1).otherwise(F.least(F.char_length(a), F.char_length(b))))


def carried(runs: Column, text: Column) -> Column:
    """Runs whose plain text becomes ``text``: what both texts share at their start and their end keeps its style, and
    what is new between gets the style of the run in which the change begins."""

    def edit(x: Column) -> Column:
        old, new, size = x["old"], x["new"], F.char_length(x["old"])

        def headed(head: Column) -> Column:
            room = F.least(size, F.char_length(new)) - head
            tail = F.least(common_start(F.reverse(old), F.reverse(new)), room)
            return let(F.struct(head.alias("head"), tail.cast("int").alias("tail")), spans)

        def spans(h: Column) -> Column:
            head, tail = h["head"], h["tail"]
            start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("placed"), F.array().cast(f"array<{RUN}>").alias("done"))

            def step(s: Column, r: Column) -> Column:
                n = F.char_length(r["text"])
                before = F.substr(r["text"], F.lit(1), F.greatest(F.least(n, head - s["at"]), F.lit(0)))
                kept = F.greatest(F.least(n, s["at"] + n - (size - tail)), F.lit(0))
                after = F.when(kept > 0, F.substr(r["text"], n - kept + 1)).otherwise("")
                here = ~s["placed"] & ((s["at"] + n > head) | ((s["at"] + n >= size) & (head >= size)))
                middle = F.when(here, F.substr(new, head + 1, F.char_length(new) - head - tail)).otherwise("")
                return F.struct((s["at"] + n).cast("int").alias("at"), (s["placed"] | here).alias("placed"), F.concat(s["done"], F.array(with_text(r, F.concat(before, middle, after)))).alias("done"))

            return filled_only(F.aggregate(x["runs"], start, step, lambda s: s["done"]))

        return let(common_start(old, new).cast("int"), headed)

    return let(F.struct(runs.alias("runs"), plain(runs).alias("old"), text.alias("new")), edit)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\*_`])", r"\\$1")


def inline_markdown(runs: Column) -> Column:
    """Runs as Markdown: code in backquotes, italics within bold within a link, outer white space outside the marks."""

    def one(r: Column) -> Column:
        body = escaped(F.regexp_replace(r["text"], r"(?U)^\s+|\s+$", ""))
        body = F.when(r["italic"], F.concat(F.lit("*"), body, F.lit("*"))).otherwise(body)
        body = F.when(r["bold"], F.concat(F.lit("**"), body, F.lit("**"))).otherwise(body)
        body = F.when(F.coalesce(r["href"], F.lit("")) != "", F.concat(F.lit("["), body, F.lit("]("), r["href"], F.lit(")"))).otherwise(body)
        outer = F.concat(F.regexp_extract(r["text"], r"(?U)^(\s*)", 1), body, F.regexp_extract(r["text"], r"(?U)(\s*)$", 1))
        return F.when(r["code"], F.concat(F.lit("`"), r["text"], F.lit("`"))).when(~r["text"].rlike(r"(?U)\S"), r["text"]).otherwise(outer)

    return F.array_join(F.transform(filled_only(runs), one), "")
