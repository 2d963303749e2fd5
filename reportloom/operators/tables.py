"""Widths of table columns from what their cells need, and headers that fit them. Lengths are in EMU."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import headers as H
from ..functions import measure as M
from ..functions.text import let


def total(widths: Column) -> Column:
    return F.aggregate(widths, F.lit(0.0), lambda a, x: a + x)


def column_demands(cells: DataFrame, least: Column, wished: Column) -> DataFrame:
    """The least and the wished width of each grid column: table_id, column, least, wished.

    ``cells``: table_id, row_idx, cell_idx, grid_col, colspan. Cells of one column give the greatest widths; spanned
    cells follow in table order and add to each column they cover an equal part of what these lack together. So a
    table's spans are folded over its columns; columns without a cell have width 0.
    """
    sized = cells.select("table_id", "row_idx", "cell_idx", F.col("grid_col").cast("int").alias("at"), F.greatest(F.col("colspan").cast("int"), F.lit(1)).alias("span"), least.cast("double").alias("least"), wished.cast("double").alias("wished"))
    single = sized.where("span = 1").groupBy("table_id", "at").agg(F.max("least").alias("least"), F.max("wished").alias("wished"))
    alone = single.groupBy("table_id").agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct("least", "wished")))).alias("__own"))
    spans = F.array_sort(F.collect_list(F.when(F.col("span") > 1, F.struct("row_idx", "cell_idx", "at", "span", "least", "wished"))))
    tables = sized.groupBy("table_id").agg(F.max(F.col("at") + F.col("span")).alias("__n"), spans.alias("__spans")).join(alone, "table_id", "left")

    def spread(widths: Column, s: Column, wanted: Column) -> Column:
        lack = F.greatest((wanted - total(F.slice(widths, s["at"] + 1, s["span"]))) / s["span"], F.lit(0.0))
        return F.transform(widths, lambda w, i: F.when(i.between(s["at"], s["at"] + s["span"] - 1), w + lack).otherwise(w))

    own = lambda which: F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda i: F.coalesce(F.try_element_at("__own", i)[which], F.lit(0.0)))
    start = F.struct(own("least").alias("least"), own("wished").alias("wished"))
    step = lambda a, s: F.struct(spread(a["least"], s, s["least"]).alias("least"), spread(a["wished"], s, s["wished"]).alias("wished"))
    folded = tables.select("table_id", F.aggregate("__spans", start, step).alias("__d"))
    rows = folded.select("table_id", F.posexplode(F.arrays_zip(F.col("__d.least").alias("least"), F.col("__d.wished").alias("wished"))).alias("column", "__w"))
    return rows.select("table_id", F.col("column").cast("long").alias("column"), "__w.least", F.greatest("__w.wished", "__w.least").alias("wished"))


def level_for(breaks: Column, total_at, target: Column) -> Column:
    """The level at which the rising, piecewise linear ``total_at`` reaches ``target``; it bends at ``breaks`` only."""

    def between(points: Column) -> Column:
        pairs = F.zip_with(points, F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        hit = F.filter(pairs, lambda p: p["b"].isNotNull() & (p["b"]["total"] >= target))
        at = lambda p: p["a"]["level"] + (p["b"]["level"] - p["a"]["level"]) * F.coalesce(F.try_divide(target - p["a"]["total"], p["b"]["total"] - p["a"]["total"]), F.lit(0.0))
        return at(F.try_element_at(hit, F.lit(1)))

    return between(F.transform(F.array_sort(F.array_distinct(breaks)), lambda x: F.struct(x.alias("level"), total_at(x).alias("total"))))


def fitted_widths(least: Column, wished: Column, target: Column) -> Column:
    """Widths that sum to ``target``: with room left the narrow columns are filled up to one level; else the wide ones
    are cut down to one level, none below its least; where even the least widths are too wide, these are scaled."""

    def fit(x: Column) -> Column:
        mins, maxs, room = x["least"], x["wished"], x["target"]
        raised = lambda level: F.transform(maxs, lambda w: F.greatest(w, level))
        cut = lambda level: F.zip_with(mins, maxs, lambda lo, hi: F.greatest(lo, F.least(hi, level)))
        zero = F.array(F.lit(0.0))
        up = level_for(F.concat(zero, maxs, F.array(room)), lambda v: total(raised(v)), room)
        down = level_for(F.concat(zero, mins, maxs), lambda v: total(cut(v)), room)
        return (
            F.when(total(maxs) <= room, let(up, raised))
            .when(total(mins) <= room, let(down, cut))
            .otherwise(F.transform(mins, lambda w: w * room / total(mins)))
        )

    return let(F.struct(least.alias("least"), wished.alias("wished"), target.cast("double").alias("target")), fit)


def column_widths(demands: DataFrame, target: int) -> DataFrame:
    """``demands`` with each column's ``width`` in a table of width ``target`` and whether it is too narrow."""
    tables = demands.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("column", "least", "wished"))).alias("__c"))
    part = lambda name: F.transform("__c", lambda c: c[name])
    fitted = tables.select("table_id", "__c", fitted_widths(part("least"), part("wished"), F.lit(float(target))).alias("__w"), (total(part("least")) > target).alias("overflow"))
    return fitted.select("table_id", F.explode(F.arrays_zip("__c", "__w")).alias("__z"), "overflow").select("table_id", "__z.__c.*", F.col("__z.__w").alias("width"), "overflow")


def fitting_header(text: Column, siblings: Column, size_emu: int, width: Column, most_lines: int = 2) -> Column:
    """A header that takes at most ``most_lines`` lines within ``width``: itself, else its first shorter form that
    does, else the form with the fewest lines, the longest on ties."""

    def choose(x: Column) -> Column:
        lines = lambda t: M.wrap_count(t, size_emu, x["width"])
        counted = F.transform(H.header_candidates(x["text"], x["siblings"]), lambda t: F.struct(t.alias("text"), lines(t).alias("lines")))

        def best(forms: Column) -> Column:
            fits = F.filter(forms, lambda f: f["lines"] <= most_lines)
            fewest = F.filter(forms, lambda f: f["lines"] == F.array_min(F.transform(forms, lambda g: g["lines"])))
            return F.coalesce(F.get(fits, 0)["text"], F.get(fewest, 0)["text"], x["text"])

        return F.when(lines(x["text"]) <= most_lines, x["text"]).otherwise(let(counted, best))

    return let(F.struct(text.alias("text"), siblings.alias("siblings"), width.cast("double").alias("width")), choose)
