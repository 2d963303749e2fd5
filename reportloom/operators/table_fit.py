"""Fitting tables to a page: the first layout of a lattice (page, size and scale of letters, cell margin) whose column
widths and numbers of lines hold, then what single cells and columns get on top. Lengths are in EMU.

Widths are in proportion to size and scale, so columns are measured once for letters of size 1. For each table the
widths at all points of the lattice are one array; each cell tells in the bits of a number at which points its lines
hold, and a table's answer is the bitwise and of its cells: one grouped aggregate, no table is gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measure as M
from ..functions import text as T
from ..functions.text import let
from . import tables as TB


@dataclass(frozen=True)
class Rules:
    """sizes and scales of letters, cell margins from wide to narrow, widths of pages as multiples of the room (portrait
    first), border, safety (share of the room left free), lines of a line of a cell at most (0: any), columns that only
    hold notes (by header) with their size, scales and share of the width at most, and how even a table is to look."""

    sizes: tuple[int, ...] = (12 * M.EMU_PER_PT, 11 * M.EMU_PER_PT, 10 * M.EMU_PER_PT, 9 * M.EMU_PER_PT)
    scales: tuple[float, ...] = (1.0, 0.9)
    margins: tuple[int, ...] = (60_000,)
    pages: tuple[float, ...] = (1.0,)
    border: int = 0
    safety: float = 0.0
    most_lines: int = 3
    equal_columns: bool = False
    note_columns: tuple[str, ...] = ()
    note_size: int | None = None
    note_scales: tuple[float, ...] = ()
    note_share: float = 0.3
    spread: int | None = None
    uniform: bool = False
    list_marks: tuple[str, ...] = ()
    header_lines: int = 0

    def steps(self) -> list[tuple[int, float]]:
        """Sizes and scales by falling width of a letter, larger sizes first."""
        return sorted({(s, c) for s in self.sizes for c in self.scales}, key=lambda s: (-s[0] * s[1], -s[0]))

    def points(self) -> list[tuple[int, int, float, int]]:
        """The lattice in the order in which it is tried: page, size, scale, margin."""
        found = [(p, *s, m) for p in range(len(self.pages)) for s in self.steps() for m in self.margins]
        if len(found) > 62:
            raise ValueError("a lattice has 62 points at most")
        return found


def cell_lines(text: Column) -> Column:
    """The lines of a cell that hold text; one empty line if none does."""
    kept = F.filter(F.transform(F.split(T.filled(text), "\n", -1), T.strip), lambda x: x != "")
    return let(kept, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit(""))))


def most_of(lines: Column, width) -> Column:
    return F.array_max(F.transform(lines, lambda t: width(t).cast("double")))


def wrapped(text: Column, size: Column, width: Column) -> Column:
    """Lines of a text in letters of width ``size`` (size times scale)."""
    return F.when(width > 0, M.lines_within(text, 0.5 * size, size * 1.0, width)).otherwise(1)


def unit_demands(cells: DataFrame) -> DataFrame:
    """The least and the wished width of each column for letters of size 1. A header over a body only asks for its longest
    word, so that contents make the widths."""
    lines = F.col("__lines")
    least, wished = most_of(lines, lambda t: M.longest_word_width(t, 1)), most_of(lines, lambda t: M.text_width(t, 1))
    word = most_of(lines, lambda t: F.coalesce(F.array_max(F.transform(F.split(t, r"(?U)\s+"), lambda w: M.text_width(w, 1))), F.lit(0.0)))
    head = F.col("__has_body") & F.col("is_header")
    return TB.column_demands(cells, F.when(head, F.greatest(least, word)).otherwise(least), F.when(head, F.greatest(least, word)).otherwise(wished))


def note_plan(rules: Rules, wished: Column, size: Column, usable: Column, notes: Column) -> tuple[Column, Column, Column]:
    """Size, scale and together wished width of the note columns: the first scale at which they keep to their share."""
    note_size, scales = F.least(F.lit(rules.note_size), size) if rules.note_size else size, rules.note_scales or (1.0,)
    units = TB.total(F.zip_with(wished, notes, lambda w, n: F.when(n, w).otherwise(0.0)))
    fits = F.filter(F.array(*map(F.lit, scales)), lambda c: units * note_size * c <= rules.note_share * usable)
    scale = F.coalesce(F.get(fits, 0), F.lit(scales[-1]))
    return note_size, scale, units * note_size * scale


def equal_widths(rules: Rules, x: Column, mins: Column, maxs: Column, usable: Column, size: Column) -> Column:
    """One width for all columns of values, and their share at most for note columns; null where that does not hold."""
    notes = x["notes"]
    note_size, scale, natural = note_plan(rules, x["wished"], size, usable, notes)
    some = F.exists(notes, lambda n: n)
    data = F.size(F.filter(notes, lambda n: ~n))
    factor = F.when(natural > 0, F.least(F.lit(1.0), rules.note_share * usable / natural)).otherwise(1.0)
    of_note = lambda w: w * note_size * scale * factor
    equal = (usable - F.when(some, natural * factor).otherwise(0.0)) / data
    narrow = F.exists(F.arrays_zip(notes.alias("n"), x["wished"].alias("w"), x["least"].alias("l")), lambda z: z["n"] & (of_note(z["w"]) + 1e-6 < z["l"] * note_size * scale))
    widest = F.array_max(F.zip_with(maxs, notes, lambda w, n: F.when(n, 0.0).otherwise(w)))
    holds = ((data >= 2) | some) & (data >= 1) & ~x["spanned"] & ~narrow & (equal + 1e-6 >= widest)
    return F.when(holds, F.zip_with(notes, x["wished"], lambda n, w: F.when(n, of_note(w)).otherwise(equal)))


def lattice(rules: Rules, x: Column) -> Column:
    """For each point: idx, size times scale, and the widths of contents; null widths where they do not hold. ``x``: least,
    wished, notes, spanned, available of a table."""
    tried = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(rules.pages[p]).alias("wide"), F.lit(s).alias("size"), F.lit(c).alias("scale"), F.lit(m).alias("margin")) for i, (p, s, c, m) in enumerate(rules.points())])

    def point(p: Column) -> Column:
        columns, letter = F.size(x["least"]), p["size"] * p["scale"]
        usable = F.floor(F.floor(x["available"] * p["wide"]) * (1 - rules.safety)) - columns * (2 * p["margin"]) - (columns + 1) * rules.border

        def widths(v: Column) -> Column:
            mins, maxs = v["mins"], v["maxs"]
            fit = TB.fitted_widths(mins, maxs, v["usable"])
            fit = F.coalesce(equal_widths(rules, x, mins, maxs, v["usable"], p["size"]), fit) if rules.equal_columns else fit
            return F.when((v["usable"] > 0) & (TB.total(mins) <= v["usable"]), fit)

        asked = F.struct(*[F.transform(x[n], lambda w: w * letter).alias(a) for n, a in (("least", "mins"), ("wished", "maxs"))], usable.cast("double").alias("usable"))
        return F.struct(p["idx"].alias("idx"), letter.alias("letter"), let(asked, widths).alias("widths"))

    return F.transform(tried, point)


def prepared(cells: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """Cells with their lines and whether their column holds notes, and tables with their columns measured at size 1."""
    head = F.coalesce(F.col("is_header"), F.lit(False))
    own = cells.withColumn("is_header", head).withColumn("__lines", cell_lines(F.col("text")))
    names = [n.replace(" ", "") for n in rules.note_columns]
    title = F.replace(F.array_join("__lines", ""), F.lit(" "), F.lit(""))
    is_title = head & (F.col("colspan") == 1) & title.isin(names) if names else F.lit(False)
    about = own.groupBy("table_id").agg(F.bool_or(~head).alias("__has_body"), F.bool_or(F.col("colspan") > 1).alias("spanned"), F.max("available").alias("available"), F.collect_set(F.when(is_title, F.col("grid_col").cast("int"))).alias("__titles"))
    own = own.join(about.select("table_id", "__has_body", "__titles"), "table_id").withColumn("__note", F.array_contains("__titles", F.col("grid_col").cast("int"))).drop("__titles")
    columns = unit_demands(own).groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("column", "least", "wished"))).alias("__c"))
    part = lambda n: F.transform("__c", lambda c: c[n])
    notes = F.transform("__c", lambda c: F.array_contains("__titles", c["column"].cast("int")))
    tables = columns.join(about, "table_id").select("table_id", part("least").alias("least"), part("wished").alias("wished"), notes.alias("notes"), "spanned", "available")
    return own, tables


def span_width(widths: Column) -> Column:
    return TB.total(F.slice(widths, F.col("grid_col").cast("int") + 1, F.greatest(F.col("colspan").cast("int"), F.lit(1))))


def fit_tables(cells: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """Layouts of tables, and what differs in their cells.

    ``cells``: table_id, row_idx, cell_idx, grid_col, colspan, is_header, text (lines parted by line ends), align (null:
    not stated), available (width of the room, the same in all cells of a table). Layouts: table_id, page (number),
    size, scale, margin, widths (whole cells), point (of the lattice; null where none holds) and overflow. The first
    point at which all lines of cells keep to ``most_lines``; else the narrowest letters on the first page on which
    widths hold; else these, scaled down on the last page. Widths fill the room but on wider pages and where scaled.

    Cells: table_id, row_idx, cell_idx, cell_size and cell_scale (null: as the table), cell_align (null: as stated),
    header_text (a shorter header, null: as it is). Tables without cells give no row; null texts are empty.
    """
    own, tables = prepared(cells, rules)
    points, steps = rules.points(), rules.steps()
    at = tables.withColumn("__points", let(F.struct("least", "wished", "notes", "spanned", "available"), lambda x: lattice(rules, x)))
    met = own.where("not (is_header and __has_body)").join(at.select("table_id", "__points"), "table_id")
    # a line that fits as it is needs no look, nor does one that its lines cannot hold even with a space lost at each end
    met = met.withColumn("__wide", most_of(F.col("__lines"), lambda t: M.text_width(t, 1)))
    wraps = lambda letter, room: F.forall("__lines", lambda t: wrapped(t, letter, room) <= rules.most_lines)

    def holds(p: Column) -> Column:
        def told_by(x: Column) -> Column:
            wide = F.col("__wide") * p["letter"]
            over = wide - rules.most_lines * (x + 0.5 * p["letter"])
            return F.when(wide <= x, True).when((x > 0) & (over > 1), False).otherwise(wraps(p["letter"], x))

        return F.when(p["widths"].isNull(), False).otherwise(let(span_width(p["widths"]), told_by))

    bits = F.aggregate("__points", F.lit(0).cast("long"), lambda m, p: F.when(holds(p), m.bitwiseOR(F.pow(F.lit(2), p["idx"]).cast("long"))).otherwise(m))
    every = F.lit((1 << len(points)) - 1).cast("long")
    told = met.withColumn("__bits", F.when(F.col("__note"), every).otherwise(bits) if rules.most_lines else every).groupBy("table_id").agg(F.bit_and("__bits").alias("__bits"))
    last = len(rules.margins) * len(steps)
    narrow = [p * last + last - 1 for p in range(len(rules.pages))]  # the narrowest letters and margins of each page
    valid = lambda i: F.col("__points")[i]["widths"].isNotNull()
    good = F.filter("__points", lambda p: p["widths"].isNotNull() & (F.coalesce(F.col("__bits"), every).bitwiseAND(F.pow(F.lit(2), p["idx"]).cast("long")) != 0))
    first = F.coalesce(F.get(good, 0)["idx"], *[F.when(valid(i), i) for i in narrow])
    point = at.join(told, "table_id", "left").withColumn("point", first)
    chosen = F.array(*[F.struct(F.lit(p).alias("page"), F.lit(s).alias("size"), F.lit(c).alias("scale"), F.lit(m).alias("margin")) for p, s, c, m in points])
    layout = point.withColumn("__p", F.get(chosen, F.coalesce("point", F.lit(len(points) - 1))))
    page, size, scale, margin = points[-1]
    forced = F.greatest(F.floor(F.floor(F.col("available") * rules.pages[page]) * (1 - rules.safety)) - F.size("least") * (2 * margin) - (F.size("least") + 1) * rules.border, F.size("least")).cast("double")
    squeezed = F.transform("least", lambda w: F.coalesce(F.try_divide(w * forced, TB.total(F.col("least"))), forced / F.size("least")))
    contents = F.when(F.col("point").isNull(), squeezed).otherwise(F.get("__points", F.col("point"))["widths"])
    whole = F.transform(contents, lambda w: F.bround(w).cast("long") + 2 * F.col("__p.margin"))
    layout = layout.select("table_id", "point", "__p.*", whole.alias("widths"), F.col("point").isNull().alias("overflow"), "available", "notes", "wished")

    sum_of = lambda w: F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + x)
    styled = cell_styles(own, layout, rules)
    balanced = lowered(layout, styled, rules)
    room = F.floor("available")

    def filled(w: Column) -> Column:
        wide = F.transform(w, lambda x: F.floor(x * room / sum_of(w)).cast("long"))
        return F.transform(wide, lambda x, i: F.when(i == F.size(w) - 1, x + room - sum_of(wide)).otherwise(x))

    stretch = (F.col("page") == 0) & ~F.col("overflow") & (sum_of(F.col("widths")) > 0) & (sum_of(F.col("widths")) < room)
    final = balanced.select("table_id", "page", F.col("table_size").alias("size"), "scale", "margin", F.when(stretch, let(F.col("widths"), filled)).otherwise(F.col("widths")).alias("widths"), "point", "overflow")
    looks = uniform_cells(styled, balanced, rules)
    return final, looks


def cell_styles(own: DataFrame, layout: DataFrame, rules: Rules) -> DataFrame:
    """Cells with their own letters and alignment, on top of their table's: notes small, long cells small and to the left,
    alike down a column."""
    steps = rules.steps()
    contents = F.transform("widths", lambda w: w - 2 * F.col("margin"))
    cells = own.join(layout.select("table_id", "size", "scale", "margin", "widths", "notes", "wished", "point"), "table_id").withColumn("__room", span_width(contents).cast("double"))
    letter = F.col("size") * F.col("scale")
    count = lambda x: F.aggregate("__lines", F.lit(0), lambda a, t: a + wrapped(t, x, F.col("__room")).cast("int"))
    body, single = ~F.col("is_header"), F.col("colspan") == 1
    cells = cells.withColumn("__total", F.when(body, count(letter)).otherwise(0))
    smaller = F.filter(F.array(*[F.struct(F.lit(s).alias("size"), F.lit(c).alias("scale")) for s, c in steps]), lambda s: s["size"] * s["scale"] < letter)
    if rules.most_lines:
        fits = F.filter(smaller, lambda s: count(s["size"] * s["scale"]) <= rules.most_lines)
        own_step = F.when(body & ~F.col("__note") & (F.col("__total") > rules.most_lines), F.coalesce(F.get(fits, 0), F.try_element_at(smaller, F.lit(-1))))
        long = body & (F.col("__total") >= rules.most_lines)
    else:
        own_step, long = F.lit(None).cast("struct<size:int,scale:double>"), F.lit(False)
    if rules.equal_columns and rules.note_columns:
        usable = F.aggregate(contents, F.lit(0.0), lambda a, w: a + w)
        note_size, note_scale, _ = note_plan(rules, F.col("wished"), F.col("size"), usable, F.col("notes"))
        note = F.struct(note_size.alias("size"), note_scale.alias("scale"))
        own_step = F.when(F.col("__note") & single & (note["size"] * note["scale"] < letter), note).otherwise(own_step)
    starts = lambda t: F.coalesce(F.array_max(F.array(*[t.startswith(f"{m} ") for m in rules.list_marks])), F.lit(False)) if rules.list_marks else F.lit(False)
    listed = F.exists("__lines", starts) & body & (F.col("grid_col") > 0)
    cells = cells.withColumn("__step", own_step).withColumn("__long", long).withColumn("__listed", listed)
    # what holds for one cell of a column holds for all cells of its body
    least = F.min(F.when(body & single & F.col("__step").isNotNull(), F.struct((F.col("__step.size") * F.col("__step.scale")).alias("letter"), "__step")))
    column = cells.groupBy("table_id", "grid_col").agg(least.alias("__least"), F.bool_or(F.col("__long") & single).alias("__long_col"), F.bool_or(F.col("__listed") & single).alias("__listed_col"))
    met = cells.join(column, ["table_id", "grid_col"])
    step = F.when(body & single & F.col("__least").isNotNull(), F.col("__least.__step")).otherwise(F.col("__step"))
    left = body & F.col("align").isNull() & (F.col("__long") | (single & F.col("__long_col")) | ((F.col("grid_col") > 0) & (F.when(single, F.col("__listed_col")).otherwise(F.col("__listed")))))
    header = F.lit(None).cast("string")
    if rules.header_lines:
        titles = own.where("is_header").groupBy("table_id", "row_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell_idx", F.array_join("__lines", " ").alias("t")))), lambda x: x["t"]).alias("__row"))
        met = met.join(titles, ["table_id", "row_idx"], "left")
        # a letter's width enters by scaling the room instead
        short = TB.fitting_header(F.col("__lines")[0], F.coalesce("__row", F.array().cast("array<string>")), 1, F.col("__room") / letter, rules.header_lines)
        header = F.when(F.col("is_header") & F.col("__has_body") & (F.size("__lines") == 1) & (short != F.col("__lines")[0]), short)
    return met.select("table_id", "row_idx", "cell_idx", "grid_col", "is_header", "align", "__note", step.alias("__step"), left.alias("__left"), header.alias("header_text"))


def lowered(layout: DataFrame, styled: DataFrame, rules: Rules) -> DataFrame:
    """Layouts with ``table_size``: lowered where the smallest cell is more than ``spread`` below the table's size."""
    if not rules.spread:
        return layout.withColumn("table_size", F.col("size"))
    least = styled.groupBy("table_id").agg(F.min("__step.size").alias("__least"))
    target = F.lit(min(rules.sizes))
    for size in sorted(rules.sizes):
        target = F.when(F.lit(size) <= F.col("__least") + rules.spread, size).otherwise(target)
    lower = F.coalesce(F.col("size") - F.col("__least") > rules.spread, F.lit(False))
    return layout.join(least, "table_id", "left").withColumn("table_size", F.when(lower, F.least(target, F.col("size"))).otherwise(F.col("size"))).drop("__least")


def uniform_cells(styled: DataFrame, layout: DataFrame, rules: Rules) -> DataFrame:
    """Cells with letters and alignment as they end up: with ``uniform``, one scale and one side for the body of a table."""
    cells = styled.join(layout.select("table_id", "table_size", "scale"), "table_id")
    if rules.uniform:
        note = F.col("__note") if rules.equal_columns else F.lit(False)
        same = F.col("__step.size") == F.col("table_size")
        of = cells.groupBy("table_id").agg(F.min(F.when(same, F.col("__step.scale"))).alias("__target"), F.bool_or("__left").alias("__any_left"), F.bool_or(~F.col("is_header") & ~note).alias("__body"))
        cells = cells.join(of, "table_id")
        inside = ~F.col("is_header") & ~note
        one = inside & F.coalesce(F.col("__target") < F.col("scale"), F.lit(False)) & F.coalesce(same, F.lit(True))
        step = F.when(one, F.struct(F.col("table_size").alias("size"), F.col("__target").alias("scale"))).otherwise(F.col("__step"))
        cells = cells.withColumn("__step", step).withColumn("__left", F.col("__left") | (inside & F.col("align").isNull() & F.col("__any_left")))
    kept = F.col("__step.size") * F.col("__step.scale") < F.col("table_size") * F.col("scale")
    return cells.select("table_id", "row_idx", "cell_idx", F.when(kept, F.col("__step.size")).alias("cell_size"), F.when(kept, F.col("__step.scale")).alias("cell_scale"), F.when(F.col("__left"), "left").alias("cell_align"), "header_text")
