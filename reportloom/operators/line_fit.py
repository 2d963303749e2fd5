"""Texts cut into lines: at word ends, with letters drawn closer where that saves a word, and rather behind a comma where a
sentence goes on. Lengths are in EMU; widths are those of the fixed-pitch model."""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LineRules:
    """Letters of ``size``; room of the first and of later lines; how much a letter may be drawn closer at most, in which
    steps, and steps kept as a reserve (``pad``); share of the room left free; characters to cut behind, if the line
    stays so long a share of what it could be; and the gap where wide letters meet Latin ones."""

    size: int = 152_400
    first: int = 5_000_000
    later: int = 5_000_000
    closer: int = 0
    step: int = 1_270
    pad: int = 0
    margin: float = 0.0
    cut_behind: str = ",，"
    least_cut: float = 0.5
    gap: int = 0
    keep_label: bool = False


def is_wide(c: str) -> bool:
    return unicodedata.east_asian_width(c) in "WF"


def widths_of(text: str, rules: LineRules) -> list[float]:
    """Width of each letter, with the gap before a letter that follows one of the other kind."""
    own = [rules.size * (1.0 if is_wide(c) else 0.5) for c in text]
    meets = lambda a, b: (is_wide(a) and b.isascii() and b.isalnum()) or (is_wide(b) and a.isascii() and a.isalnum())
    return [w + (rules.gap if i and meets(text[i - 1], text[i]) else 0) for i, w in enumerate(own)]


def cut_lines(text: str, rules: LineRules) -> list[tuple[int, int, int, float]]:
    """Lines of a text without line ends: start, end, steps by which its letters are closer, and how much closer they
    would have to be for one more word (0: none is left, or the line was cut behind a comma)."""
    n, widths = len(text), widths_of(text, rules)
    label = text.find(" : ") if rules.keep_label else -1
    upto = [0.0, *accumulate(widths)]
    gives = [0, *accumulate(int(i >= label) for i in range(n))]  # letters of a label stay as they are
    ends = [i for i in range(1, n + 1) if i == n or text[i] == " "]
    lines, pos, at = [], 0, 0
    while True:
        while pos < n and text[pos] == " ":
            pos += 1
        if pos >= n:
            return lines
        room = max((rules.later if lines else rules.first) * (1 - rules.margin), widths[pos])
        while at < len(ends) and ends[at] <= pos:
            at += 1
        best = comma = None
        need = 0.0
        for end in ends[at:]:
            over, letters = upto[end] - upto[pos] - room, gives[end] - gives[pos]
            if over <= 1e-6:
                best = end, 0
                comma = end if text[end - 1] in rules.cut_behind else comma
            elif rules.closer and over <= rules.closer * letters:
                steps = max(1, math.ceil(over / letters / rules.step - 1e-9))
                steps = min(steps + math.ceil(rules.pad / rules.step - 1e-9), int(rules.closer / rules.step + 1e-9)) if rules.pad else steps
                best = end, steps
            else:
                need = over / max(letters, 1e-9)
                break
        if best and comma and comma < best[0] < n and comma - pos >= rules.least_cut * (best[0] - pos):
            best, need = (comma, 0), 0.0
        if best is None:  # a word longer than the line
            end = pos + 1
            while end < n and upto[end + 1] - upto[pos] <= room:
                end += 1
            best, need = (end, 0), 0.0
        lines.append((pos, best[0], best[1], need))
        pos = best[0]


def fit_lines(text: str, rules: LineRules) -> list[tuple[int, int, int, float]]:
    """Lines of a text; a line end in the text ends a line, and only the first line of all has the room of a first one."""
    out, start = [], 0
    for i, part in enumerate(text.split("\n")):
        own = rules if i == 0 else LineRules(**{**vars(rules), "first": rules.later})
        out += [(start + a, start + b, steps, need) for a, b, steps, need in cut_lines(part, own)]
        start += len(part) + 1
    return out


def with_lines(rows: DataFrame, text_col: str, rules: LineRules, name: str = "lines") -> DataFrame:
    """``rows`` with an array of lines: start and end (characters from 0), steps and need. Null and blank texts have none."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("steps", pa.int32()), ("need", pa.float64())]))

    @F.arrow_udf("array<struct<start:int,end:int,steps:int,need:double>>")
    def fitted(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("start", "end", "steps", "need"), x, strict=True)) for x in fit_lines(t.as_py() or "", rules)] for t in texts], kind)

    return rows.withColumn(name, fitted(F.col(text_col)))


def closest(rows: DataFrame, text_col: str, rules: LineRules, most_lines: int, name: str = "closer") -> DataFrame:
    """``rows`` with the least closeness, in steps up to ``rules.closer``, at which a text takes ``most_lines`` lines; null if
    none does."""

    @F.arrow_udf("int")
    def least(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            low, high = 0, rules.closer // rules.step + 1
            while low < high:  # closer letters never make more lines
                middle = (low + high) // 2
                fits = len(fit_lines(t.as_py() or "", LineRules(**{**vars(rules), "closer": middle * rules.step, "cut_behind": ""}))) <= most_lines
                low, high = (low, middle) if fits else (middle + 1, high)
            out.append(low if low <= rules.closer // rules.step else None)
        return pa.array(out, pa.int32())

    return rows.withColumn(name, least(F.col(text_col)))
