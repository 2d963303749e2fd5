"""Text widths without font files: wide letters are one em, others half (fixed pitch) or a table value (fallback)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WIDE, display_width, filled

EMU_PER_PT, EMU_PER_MM, EMU_PER_DXA = 12_700, 36_000, 635
BOLD = 1.04


def length_emu(value: Column) -> Column:
    """A length such as '30mm', '11pt', '2.5cm' or '1in' in EMU, rounded half-even; null where it is none."""
    number = F.regexp_extract(F.trim(value), r"(?i)^(-?\d+(?:\.\d+)?)\s*(mm|cm|pt|in|dxa|emu)$", 1)
    unit = F.lower(F.regexp_extract(F.trim(value), r"(?i)^(-?\d+(?:\.\d+)?)\s*(mm|cm|pt|in|dxa|emu)$", 2))
    factor = F.when(unit == "mm", EMU_PER_MM).when(unit == "cm", 10 * EMU_PER_MM).when(unit == "pt", EMU_PER_PT).when(unit == "in", 914_400).when(unit == "dxa", EMU_PER_DXA).otherwise(1)
    return F.when(number != "", F.bround(F.nullif(number, F.lit("")).cast("double") * factor, 0).cast("long"))


def ratio_of(value: Column) -> Column:
    """'160%' as 1.6, bare numbers as they are."""
    number = F.nullif(F.regexp_extract(F.trim(value), r"^(\d+(?:\.\d+)?)\s*%?$", 1), F.lit("")).cast("double")
    return F.when(F.trim(value).endswith("%"), number / 100).otherwise(number)


def text_width(text: Column, size_emu: int, bold: bool = False, scale: float = 1.0) -> Column:
    """Width of a text on one line in EMU under the fixed-pitch model."""
    return display_width(text) * F.lit(0.5 * size_emu * (BOLD if bold else 1.0) * scale)


def longest_word_width(text: Column, size_emu: int) -> Column:
    """Width of the longest piece that a line cannot break: a wide letter, or a run of others."""
    runs = F.split(F.regexp_replace(filled(text), WIDE, " "), r"(?U)\s+", -1)
    narrow = F.array_max(F.transform(runs, F.char_length)) * F.lit(0.5 * size_emu)
    wide = F.when(filled(text).rlike(WIDE), F.lit(float(size_emu))).otherwise(F.lit(0.0))
    return F.greatest(narrow, wide)


def wrap_count(text: Column, size_emu: int, max_width: Column | float) -> Column:
    """Lines that a text takes within ``max_width``: wide letters break anywhere, other words are kept whole and
    moved down, words longer than a line are cut. Without any width it is one line."""
    most = max_width if isinstance(max_width, Column) else F.lit(float(max_width))
    return F.when(most > 0, lines_within(text, F.lit(0.5 * size_emu), F.lit(float(size_emu)), most)).otherwise(F.lit(1))


def lines_within(text: Column, half: Column, full: Column, most: Column) -> Column:
    start = F.struct(F.lit(1).alias("n"), F.lit(0.0).alias("used"), F.lit(0.0).alias("word"))

    def state(n: Column, used: Column, word: Column) -> Column:
        return F.struct(n.cast("int").alias("n"), used.alias("used"), word.alias("word"))

    def step(s: Column, c: Column) -> Column:
        after_space = s["used"] + s["word"] + half
        after_word = s["used"] + s["word"]
        over_wide = after_word + full > most
        longer = s["word"] + half
        over = s["used"] + longer > most
        broken = F.when(s["used"] > 0, s["n"] + 1).otherwise(s["n"])
        return (
            F.when(c == "\n", state(s["n"] + 1, F.lit(0.0), F.lit(0.0)))
            .when(c.rlike(r"(?U)^\s$"), F.when(after_space > most, state(s["n"] + 1, F.lit(0.0), F.lit(0.0))).otherwise(state(s["n"], after_space, F.lit(0.0))))
            .when(c.rlike(WIDE), F.when(over_wide, state(s["n"] + 1, full, F.lit(0.0))).otherwise(state(s["n"], after_word + full, F.lit(0.0))))
            .when(over & (longer > most), state(broken + F.floor(longer / most), F.lit(0.0), longer % most))
            .when(over, state(broken, F.lit(0.0), longer))
            .otherwise(state(s["n"], s["used"], longer))
        )

    return F.aggregate(F.filter(F.split(filled(text), "", -1), lambda c: c != ""), start, step, lambda s: F.greatest(F.lit(1), s["n"]))


def fill_up(widths: Column, target: Column) -> Column:
    """Column widths raised to one common level until they sum to ``target``; wider ones stay. No-op if too wide."""
    ordered = F.array_sort(widths)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    levels = F.transform(F.sequence(F.lit(1), F.size(ordered)), lambda k: (target - total(F.slice(ordered, k + 1, F.size(ordered)))) / k)
    fits = F.filter(F.arrays_zip(levels.alias("level"), ordered.alias("own"), F.concat(F.slice(ordered, 2, F.size(ordered)), F.array(F.lit(float("inf")))).alias("next")), lambda z: (z["level"] >= z["own"]) & (z["level"] <= z["next"]))
    level = F.try_element_at(fits, F.lit(1))["level"]
    return F.when(level.isNull(), widths).otherwise(F.transform(widths, lambda w: F.greatest(w, level)))
