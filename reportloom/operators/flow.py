"""Where blocks fall on pages: heights, a running position that jumps at page ends, lines drawn closer so that a table
stays on its page, and room that is left. Lengths are in EMU.

A position depends on every jump before it, so no window gives it. Blocks are dealt by document and sorted within their
partition, and one Arrow pass carries the position; it holds the blocks of the current page at most.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measure as M

#: Height of a line over its size; share of a page that stays free when spacing is widened.
LINE_FACTOR, SAFETY = 1.2, 0.10


@dataclass(frozen=True)
class Font:
    size: int = 11 * M.EMU_PER_PT
    spacing: float = 1.0
    before: int = 0
    after: int = 0

    @property
    def line(self) -> float:
        return self.size * self.spacing * LINE_FACTOR


@dataclass(frozen=True)
class Level:
    """Indents and the space after an item: before one of its level, a higher, a lower one, and anything else; each
    with the wider space used where a page has room."""

    indent: int = 0
    before: int = 0
    same: int = 0
    up: tuple[int, int] = (0, 0)
    down: tuple[int, int] = (0, 0)
    change: tuple[int, int] = (0, 0)


@dataclass(frozen=True)
class Page:
    width: int = 160 * M.EMU_PER_MM
    height: int = 240 * M.EMU_PER_MM
    body: Font = Font()
    headings: dict[int, Font] = field(default_factory=dict)
    code: Font = Font()
    levels: tuple[Level, ...] = (Level(),)
    table_after: int = 0


def by_depth(page: Page, value) -> Column:
    """A number of the level at the row's depth; deeper ones are as the last."""
    own = F.array(*[F.lit(value(x)) for x in page.levels])
    return F.element_at(own, F.least(F.coalesce("depth", F.lit(0)).cast("int"), F.lit(len(page.levels) - 1)) + 1)


def block_heights(blocks: DataFrame, page: Page, id_col: str = "doc_id") -> DataFrame:
    """``blocks`` (id, ord, kind, level, depth, text) with ``lines_height`` (what closer lines shrink), ``fixed`` and
    ``extra`` (what wider spacing adds). Items have spaces by how the level changes to the next one. Tables and pages
    breaks have no height here."""
    w = Window.partitionBy(id_col).orderBy("ord")
    near = {n: (F.lag(c).over(w), F.lead(c).over(w)) for n, c in (("kind", "kind"), ("depth", "depth"))}
    rows = blocks.withColumns({f"__{side}_{n}": c for n, pair in near.items() for side, c in zip(("last", "next"), pair, strict=True)})
    item, next_item = F.col("kind") == "item", F.coalesce(F.col("__next_kind") == "item", F.lit(False))
    headings = {k: f for k, f in page.headings.items()}

    def of_font(value) -> Column:
        out = F.lit(value(page.body))
        for k, f in headings.items():
            out = F.when((F.col("kind") == "heading") & (F.col("level") == k), value(f)).otherwise(out)
        return F.when(F.col("kind") == "code", value(page.code)).otherwise(out)

    half, room = of_font(lambda f: 0.5 * f.size), F.lit(float(page.width)) - F.when(item, by_depth(page, lambda x: x.indent)).otherwise(0)
    wrapped = F.when(room > 0, M.lines_within(F.col("text"), half, half * 2, room)).otherwise(0)
    count = F.when(F.col("kind") == "code", F.size(F.split(F.coalesce("text", F.lit("")), "\n"))).when(F.col("kind").isin("blank", "hr"), 1).when(F.col("kind").isin("table", "page_break"), 0).otherwise(wrapped)
    step = lambda wide: (
        F.when(next_item & (F.col("__next_depth") == F.col("depth")), by_depth(page, lambda x: x.same)).when(next_item & (F.col("__next_depth") < F.col("depth")), by_depth(page, lambda x: x.up[wide]))
        .when(next_item, by_depth(page, lambda x: x.down[wide])).otherwise(by_depth(page, lambda x: x.change[wide]))
    )
    lifted = F.when((F.col("__last_kind") == "item") & (F.col("__last_depth") > F.col("depth")), by_depth(page, lambda x: x.before)).otherwise(0)
    before = F.when(F.col("__last_kind") == "table", F.greatest(lifted, F.lit(page.table_after))).otherwise(lifted)
    own = F.when(F.col("kind").isin("blank", "hr", "table", "page_break"), 0).otherwise(of_font(lambda f: f.before) + of_font(lambda f: f.after))
    fixed = own + F.when(item, step(0) + before).otherwise(0)
    return rows.select(*blocks.columns, (count * of_font(lambda f: f.line)).alias("lines_height"), fixed.cast("long").alias("fixed"), F.when(item, F.greatest(step(1) - step(0), F.lit(0))).otherwise(0).cast("long").alias("extra"))


class Flow:
    """The position in one document. ``place`` takes blocks in order and gives those that nothing can change any more."""

    def __init__(self, usable: int, margin: int, least: float):
        self.usable, self.margin, self.least = usable, margin, least
        self.y = self.start = 0
        self.waiting: deque[list] = deque()  # blocks whose lines can still be drawn closer: row, start, lines, fixed
        self.rows: deque[dict] = deque()

    def closer(self, window: list[list], overflow: int) -> tuple[int, float | None]:
        """The weakest scale, in hundredths, that wins ``overflow``, and what it wins."""
        for hundredths in range(99, math.ceil(self.least * 100 - 1e-9) - 1, -1) if window and self.least < 1 else ():
            won = sum(b[0]["height"] - int(b[2] * (hundredths / 100) + b[3]) for b in window)
            if won >= overflow:
                return won, hundredths / 100
        return 0, None

    def place(self, ord_: int, kind: str, lines: float, fixed: int, stays: bool) -> Iterator[dict]:
        row = {"ord": ord_, "height": int(lines + fixed), "scale": 1.0, "moved": False, "left_empty": 0}
        if kind == "page_break" and self.y % self.usable:
            self.y = (self.y // self.usable + 1) * self.usable
        page_end = (self.y // self.usable + 1) * self.usable
        if kind == "table" and stays and 0 < row["height"] <= self.usable and self.y + row["height"] > page_end:
            window = [b for b in self.waiting if b[1] >= page_end - self.usable]
            won, scale = self.closer(window, self.y + row["height"] - page_end + self.margin)
            if scale is None:
                row |= {"moved": True, "left_empty": page_end - self.y}
                self.y = page_end
            else:
                for b in window:
                    b[0] |= {"scale": scale, "height": int(b[2] * scale + b[3])}
                self.y, self.start = self.y - won, self.start - won
                self.waiting.clear()
        row |= {"y": self.y, "page": self.y // self.usable}
        if kind in ("paragraph", "item"):
            self.waiting.append([row, self.start, lines, fixed])
        self.rows.append(row)
        self.y, self.start = self.y + row["height"], self.start + row["height"]
        while self.waiting and self.waiting[0][1] < self.y // self.usable * self.usable:
            self.waiting.popleft()
        while self.rows and not (self.waiting and self.rows[0] is self.waiting[0][0]):
            yield self.rows.popleft()


def page_flow(blocks: DataFrame, usable: int, margin: int = 0, least_scale: float = 1.0, id_col: str = "doc_id", stays: bool = True) -> DataFrame:
    """Columns id, ord, y (from the top of the first page, all pages in a row), page (from 0), height, scale, moved,
    left_empty: a row for each block.

    ``blocks``: id, ord, kind, lines_height, fixed. A page break goes on at the next page. With ``stays``, a table that
    would cross a page end, but fits a page, is kept whole: paragraphs and items that began on the page are drawn
    closer by the weakest scale of 0.99, 0.98 to ``least_scale`` that makes ``margin`` more room than is needed; if none
    does, the table moves to the next page and leaves the rest of its own empty. Ties of ord are taken in any order.
    """
    id_type = blocks.schema[id_col].dataType.simpleString()
    names = ["ord", "y", "page", "height", "scale", "moved", "left_empty"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flow, current = None, object()
        for batch in batches:
            ids, out = [], []
            for key, *block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != current:
                    if flow:
                        ids += [current] * len(flow.rows)
                        out += flow.rows
                    flow, current = Flow(usable, margin, least_scale), key
                found = list(flow.place(*block, stays))
                ids += [key] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *[pa.array([r[n] for r in out], k) for n, k in zip(names, kinds, strict=True)]], names=[id_col, *names])
        if flow:
            rows = list(flow.rows)
            yield pa.RecordBatch.from_arrays([pa.array([current] * len(rows), batch.column(0).type), *[pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)]], names=[id_col, *names])

    picked = blocks.select(id_col, F.col("ord").cast("long").alias("ord"), "kind", F.col("lines_height").cast("double").alias("lines_height"), F.col("fixed").cast("long").alias("fixed"))
    ordered = picked.repartition(id_col).sortWithinPartitions(id_col, "ord")
    return ordered.mapInArrow(run, f"{id_col} {id_type}, ord long, y long, page long, height long, scale double, moved boolean, left_empty long")


def with_extra(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("fixed", F.col("fixed") + F.col("extra"))


def flow_plan(blocks: DataFrame, usable: int, margin: int = 0, least_scale: float = 1.0, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The placed blocks as of ``page_flow``, and for each document: height, pages, spare and whether it is relaxed.

    A document is relaxed, its spaces wide, if the room left on its last page holds what these add and ``SAFETY`` of a page
    more, unless wide spaces would push a table to the next page.
    """
    total = blocks.groupBy(id_col).agg(F.sum(F.expr("cast(lines_height + fixed as long)")).alias("height"), F.sum("extra").alias("__extra"))
    pages = F.greatest(F.ceil(F.col("height") / usable), F.lit(1))
    room = total.withColumn("pages", pages).withColumn("spare", F.col("pages") * usable - F.col("height"))
    wished = room.withColumn("__wide", (F.col("__extra") > 0) & (F.col("spare") - F.col("__extra") > usable * SAFETY))
    tried = page_flow(with_extra(blocks.join(wished.where("__wide").select(id_col), id_col, "left_semi")), usable, margin, least_scale, id_col)
    broken = tried.where("moved").select(id_col).distinct().withColumn("__broken", F.lit(True))
    plan = wished.join(broken, id_col, "left").select(id_col, "height", "pages", "spare", (F.col("__wide") & F.col("__broken").isNull()).alias("relaxed"))
    chosen = blocks.join(plan.select(id_col, "relaxed"), id_col).withColumn("fixed", F.col("fixed") + F.when(F.col("relaxed"), F.col("extra")).otherwise(0))
    return page_flow(chosen, usable, margin, least_scale, id_col), plan


def stretched_rows(placed: DataFrame, usable: int, target: float, most: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """Columns id, ord, per_row: what each row of the tables on a page gains so that the page is ``target`` full; pages that
    are fuller, and tables without rows, gain nothing. ``placed``: page, y, height, kind, table_rows."""
    used = F.least(F.max(F.col("y") + F.col("height")), (F.col("page") + 1) * usable) - F.col("page") * usable
    pages = placed.groupBy(id_col, "page").agg(used.alias("__used"), F.sum(F.when(F.col("kind") == "table", F.col("table_rows"))).alias("__rows"))
    need = F.lit(int(target * usable)) - F.col("__used")
    per_row = F.expr("cast(__need div __rows as long)")
    gains = pages.withColumn("__need", need).where("__need > 0 and __rows > 0").withColumn("per_row", F.least(per_row, F.lit(most)) if most is not None else per_row)
    return placed.where("kind = 'table'").join(gains.where("per_row > 0").select(id_col, "page", "per_row"), [id_col, "page"]).select(id_col, "ord", "per_row")
