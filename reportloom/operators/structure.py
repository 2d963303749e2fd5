"""Structure passes over block rows (doc_id, ord, kind, ...): windows that carry state down a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

from .lineage import step

DOC, ORD = "doc_id", "ord"
HANGUL_LETTERS = "가나다라마바사아자차카타파하"
ROMAN_SIGNS = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def in_order(doc: str = DOC) -> Window:
    return Window.partitionBy(doc).orderBy(ORD)


def so_far(doc: str = DOC) -> Window:
    return in_order(doc).rowsBetween(Window.unboundedPreceding, 0)


def before(doc: str = DOC) -> Window:
    return in_order(doc).rowsBetween(Window.unboundedPreceding, -1)


def settle_blank_lines(blocks: DataFrame, keep: bool = True) -> DataFrame:
    """Blank blocks dropped, or one kept in each gap: none at the ends, beside page breaks, after tables, or between
    a bracket caption and its table. Callout children lose all. ``blocks``: doc_id, ord, kind, text[, parent_role]."""
    is_blank = F.col("kind") == "blank"
    if not keep:
        return blocks.where(~is_blank)
    after = in_order().rowsBetween(1, Window.unboundedFollowing)
    visible = F.when(~is_blank, F.struct("kind", "text"))
    seen = blocks.withColumns({"__prev": F.last(visible, True).over(before()), "__next": F.first(visible, True).over(after), "__lag": F.lag("kind").over(in_order())})
    caption = (F.col("__prev.kind") == "paragraph") & T.is_bracket_caption(F.col("__prev.text")) & (F.col("__next.kind") == "table")
    kept = (F.col("__lag") != "blank") & ~F.col("__prev.kind").isin("page_break", "table") & (F.col("__next.kind") != "page_break") & ~caption
    if "parent_role" in blocks.columns:
        kept = kept & (F.coalesce(F.col("parent_role"), F.lit("root")) != "callout")
    return seen.where(~is_blank | F.coalesce(kept, F.lit(False))).select(*blocks.columns)


def drop_blank_blocks(blocks: DataFrame) -> DataFrame:
    """Headings, paragraphs and items without anything visible are dropped."""
    return blocks.where(~(F.col("kind").isin("heading", "paragraph", "item") & T.is_blank(F.col("text"))))


def blank_block_changes(blocks: DataFrame) -> DataFrame:
    """A change row for each dropped block that held invisible characters: doc_id, ord, before, after, rule."""
    codes = T.invisible_codes(F.col("text"))
    dropped = blocks.where(F.col("kind").isin("heading", "paragraph", "item") & T.is_blank(F.col("text")) & (F.size(codes) > 0))
    return dropped.select(DOC, ORD, F.array_join(codes, " ").alias("before"), F.lit("").alias("after"), F.lit("빈 문단").alias("rule"))


def soften_hard_breaks(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("text", F.when(F.col("kind") == "code", F.col("text")).otherwise(F.replace("text", F.lit("\n"), F.lit(" "))))


def merge_short_items(blocks: DataFrame, most: int = 60, joiner: str = " 및 ") -> DataFrame:
    """Neighbouring items of one depth whose joined text fits ``most`` become one, pair by pair from the top.

    Pairs are the odd edges of each run of eligible edges, which is what a greedy pass from the top takes.
    """
    w = in_order()
    fits = (F.col("kind") == "item") & (F.lead("kind").over(w) == "item") & (F.lead("depth").over(w) == F.col("depth")) & (F.char_length("text") + F.lead(F.char_length("text")).over(w) + len(joiner) <= most)
    edges = blocks.withColumns({"__edge": F.coalesce(fits, F.lit(False)), "__text": F.lead("text").over(w)})
    runs = edges.withColumn("__run", F.coalesce(F.sum((~F.col("__edge")).cast("int")).over(before()), F.lit(0)))
    take = F.col("__edge") & (F.row_number().over(Window.partitionBy(DOC, "__run").orderBy(ORD)) % 2 == 1)
    taken = runs.withColumn("__take", take)
    eaten = taken.withColumn("__eaten", F.coalesce(F.lag("__take").over(w), F.lit(False))).where(~F.col("__eaten"))
    return eaten.withColumn("text", F.when(F.col("__take"), F.concat("text", F.lit(joiner), "__text")).otherwise(F.col("text"))).select(*blocks.columns)


def fold_levels(blocks: DataFrame, most: int = 4) -> DataFrame:
    """Headings as items: a heading of level n has depth n minus the least heading level; an item hangs below the
    heading before it. Depths are shifted to begin at 0 in each document and cut at ``most``."""
    whole = Window.partitionBy(DOC)
    base = F.min(F.when(F.col("kind") == "heading", F.col("level"))).over(whole)
    heading = F.last(F.when(F.col("kind") == "heading", F.col("level") - F.col("__base")), True).over(so_far())
    seen = blocks.withColumn("__base", base).withColumn("__heading", heading)
    depth = F.when(F.col("kind") == "heading", F.col("__heading")).when(F.col("kind") == "item", F.coalesce(F.col("__heading") + 1, F.lit(0)) + F.coalesce(F.col("depth"), F.lit(0)))
    folded = seen.withColumn("__depth", depth)
    shifted = F.least(F.col("__depth") - F.min("__depth").over(whole), F.lit(most))
    return folded.withColumns({"from_heading": F.col("kind") == "heading", "depth": shifted.cast("int"), "kind": F.when(F.col("kind") == "heading", "item").otherwise(F.col("kind"))}).select(*blocks.columns, *([] if "from_heading" in blocks.columns else ["from_heading"]))


def number_items(blocks: DataFrame, depths: int = 5) -> DataFrame:
    """``number``: each item's place among items of its depth since the last shallower item (or any other block).

    For each of the ``depths`` depths (items below them are not numbered) a running count is taken and what it was at
    the last reset; all windows share one order, so the blocks are shuffled and sorted once.
    """
    out = blocks.withColumn("__item", F.col("kind") == "item")
    own = lambda d: F.col("__item") & (F.col("depth") == d)
    out = out.withColumns({f"__n{d}": F.count_if(F.coalesce(own(d), F.lit(False))).over(so_far()) for d in range(depths)})
    reset = lambda d: ~F.col("__item") | (F.col("depth") < d)
    out = out.withColumns({f"__base{d}": F.coalesce(F.last(F.when(reset(d), F.col(f"__n{d}")), True).over(so_far()), F.lit(0)) for d in range(depths)})
    value = F.coalesce(*[F.when(own(d), F.col(f"__n{d}") - F.col(f"__base{d}")) for d in range(depths)])
    return out.withColumn("number", value.cast("long")).select(*blocks.columns, "number")


def cycled(letters: str, n: Column) -> Column:
    """The n-th letter; beyond the last, letters are doubled, tripled and so on."""
    k = F.greatest(n, F.lit(1)) - 1
    return F.repeat(F.substring(F.lit(letters), F.pmod(k, F.lit(len(letters))) + 1, F.lit(1)), (F.floor(k / len(letters)) + 1).cast("int"))


def roman(n: Column) -> Column:
    """Roman numerals, 'I' for numbers under 1."""
    signs = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in ROMAN_SIGNS])
    start = F.struct(n.cast("long").alias("left"), F.lit("").alias("out"))
    step = lambda a, x: F.struct((a["left"] % x["v"]).alias("left"), F.concat(a["out"], F.repeat(x["s"], F.floor(a["left"] / x["v"]).cast("int"))).alias("out"))
    return F.when(n < 1, "I").otherwise(F.aggregate(signs, start, step, lambda a: a["out"]))


def format_marker(template: str, n: Column) -> Column:
    """A marker template with its placeholder filled: {n} {hangul} {alpha} {ALPHA} {roman} {ROMAN} {circled}."""
    kinds = {
        "{n}": n.cast("string"),
        "{hangul}": cycled(HANGUL_LETTERS, n),
        "{alpha}": cycled("abcdefghijklmnopqrstuvwxyz", n),
        "{ALPHA}": cycled("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n),
        "{roman}": F.lower(roman(n)),
        "{ROMAN}": roman(n),
        "{circled}": F.when(n.between(1, 15), F.substring(F.lit("①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮"), n.cast("int"), F.lit(1))).otherwise(n.cast("string")),
    }
    out = F.lit(template)
    for name, value in kinds.items():
        if name in template:
            out = F.replace(out, F.lit(name), value)
    return out


def attach_captions(blocks: DataFrame) -> DataFrame:
    """A bracket-caption paragraph right before a table becomes its caption and is dropped."""
    w = in_order()
    caption = (F.col("kind") == "paragraph") & T.is_bracket_caption(F.col("text")) & (F.lead("kind").over(w) == "table")
    seen = blocks.withColumn("__caption", F.coalesce(caption, F.lit(False)))
    own = F.when((F.col("kind") == "table") & F.lag("__caption").over(w), T.strip(F.lag("text").over(w)))
    return seen.withColumn("caption", own).where(~F.col("__caption")).drop("__caption")


def attach_notes(blocks: DataFrame, marks: tuple[str, ...] = ("*", "※", "주)", "주:")) -> DataFrame:
    """Note paragraphs directly after a table, and after its other notes, move into its ``notes`` in order."""
    is_note = F.col("kind").isin("paragraph", "item") & F.ltrim("text").rlike("^(?:" + "|".join(m.replace("*", r"\*").replace(")", r"\)") for m in marks) + ")")
    other = F.last(F.when(~F.col("__note"), F.struct("kind", ORD)), True).over(so_far())
    seen = blocks.withColumn("__note", F.coalesce(is_note, F.lit(False))).withColumn("__owner", other)
    moved = seen.withColumn("__moved", F.col("__note") & F.coalesce(F.col("__owner.kind") == "table", F.lit(False)))
    notes = moved.where("__moved").groupBy(DOC, F.col("__owner.ord").alias("__table")).agg(F.array_sort(F.collect_list(F.struct(ORD, "text"))).alias("__n"))
    kept = moved.where("not __moved").drop("__note", "__owner", "__moved")
    return kept.join(notes.withColumnRenamed("__table", ORD), [DOC, ORD], "left").withColumn("notes", F.when(F.col("kind") == "table", F.coalesce(F.transform("__n", lambda n: n["text"]), F.array().cast("array<string>")))).drop("__n")


#: Boundaries that deal rows into ranges of an order: rows looked at, and so ranges at most.
RANGES = 256


def running_totals(rows: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over all rows before, in the order of the columns ``order``.

    Rows are dealt into ranges by at most ``RANGES`` boundaries (rows picked by a hash). Each range is summed, the few
    sums are added up in order, and a window numbers within each range: no task sees all rows.
    """
    key = F.struct(*order)
    cuts = rows.select(key.alias("k"), F.xxhash64(*order).alias("h")).orderBy("h", "k").limit(RANGES).agg(F.array_sort(F.collect_set("k")).alias("__cuts"))
    ranged = rows.withColumn("__value", value).join(F.broadcast(cuts)).withColumn("__range", F.size(F.filter("__cuts", lambda c: c <= key))).drop("__cuts")
    sums = ranged.groupBy("__range").agg(F.sum("__value").alias("__sum"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(starts), "__range").withColumn(name, F.col("__start") + F.coalesce(F.sum("__value").over(within), F.lit(0)))
    return placed.drop("__range", "__value", "__start")


def merge_documents(blocks: DataFrame, order: str, breaks: bool = False) -> DataFrame:
    """All documents as one stream of blocks: position in all, a page break or section heading before each document.

    Positions come from each document's length summed over the documents before it, range by range
    (``running_totals``). ``order`` is a document-level column.
    """
    sizes = blocks.groupBy(DOC, order).agg(F.count("*").alias("__size"))
    at = running_totals(sizes, [order, DOC], F.col("__size") + 1, "__at").select(DOC, "__at")
    own = blocks.withColumn("__no", F.row_number().over(in_order()))
    body = own.join(at, DOC).select(DOC, (F.col("__at") + F.col("__no") + 1).cast("long").alias("position"), "kind", "text")
    head = at.select(DOC, (F.col("__at") + 1).cast("long").alias("position"), F.lit("page_break" if breaks else "heading").alias("kind"), F.lit("" if breaks else None).cast("string").alias("text"))
    return body.unionByName(head)


def grid_columns(cells: DataFrame) -> DataFrame:
    """``grid_col`` of table cells under rowspans and colspans: cells (table_id, row_idx, cell_idx, colspan, rowspan).

    Which column a cell starts in depends on all cells above it, so each table is placed by one call.
    """
    import pandas as pd

    schema = cells.withColumn("grid_col", F.lit(0).cast("long")).schema

    def place(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["row_idx", "cell_idx"])
        taken, starts = set(), []
        for r, w, h in zip(table["row_idx"], table["colspan"], table["rowspan"], strict=True):
            c = 0
            while (r, c) in taken:
                c += 1
            starts.append(c)
            taken.update((r + i, c + j) for i in range(max(1, h)) for j in range(max(1, w)))
        return table.assign(grid_col=starts)

    return cells.groupBy("table_id").applyInPandas(place, schema)


def first_paths(edges: DataFrame, depth: int, most: int) -> DataFrame:
    """Pages reached from each root within ``depth`` inclusions: root, page, depth, path (pages), key (positions); at most
    ``most`` a root. ``edges``: page, includes, position. Each level is written once, so no level is computed anew."""
    hop = edges.select(F.col("page").alias("__from"), F.col("includes").alias("__to"), place(F.col("position")).alias("__p"))

    def first(paths: DataFrame) -> DataFrame:
        """Of all paths of one length to a page the first: what comes behind it depends on the page alone."""
        return step(paths.groupBy("root", "page", "depth").agg(F.min_by(F.struct("path", "key"), "key").alias("__first")).select("root", "page", "depth", "__first.*"))

    level = first(hop.where("__from != __to").select(F.col("__from").alias("root"), F.col("__to").alias("page"), F.lit(1).alias("depth"), F.array("__from", "__to").alias("path"), F.col("__p").alias("key")))
    found = level
    for d in range(2, depth + 1):
        on = level.join(hop, level["page"] == hop["__from"]).where(~F.array_contains("path", F.col("__to")))
        level = first(on.select("root", F.col("__to").alias("page"), F.lit(d).alias("depth"), F.concat("path", F.array("__to")).alias("path"), F.concat_ws("/", "key", "__p").alias("key")))
        found = found.unionByName(level)
    of_page = found.groupBy("root", "page").agg(F.min_by(F.struct("depth", "path", "key"), "key").alias("__first")).select("root", "page", "__first.*")
    return of_page.withColumn("__r", F.row_number().over(Window.partitionBy("root").orderBy("key"))).where(F.col("__r") <= most).drop("__r")


def place(position: Column) -> Column:
    """A position as text that sorts like its number."""
    return F.lpad(position.cast("string"), 6, "0")


def page_closure(edges: DataFrame, depth: int = 4, most: int = 40) -> DataFrame:
    """Pages reached from each root within ``depth`` inclusions: root, page, depth, path; at most ``most`` a root.

    ``edges``: page, includes, position. A page is met once, on its first path in document order; paths never
    repeat a page.
    """
    return first_paths(edges, depth, most).select("root", "page", F.col("depth").cast("long").alias("depth"), F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


def spliced_pages(blocks: DataFrame, depth: int = 4, most: int = 40, roots: DataFrame | None = None) -> DataFrame:
    """Each page with the pages that it includes put in place: root, position, page, depth, kind, text, target.

    ``blocks``: page, ord, kind, text, target (the page that a block of kind ``include`` stands for). An included page
    begins on a new page with its title (the text of its first block of kind ``title``, else its id); its blocks follow,
    and so on down to ``depth`` inclusions and ``most`` pages. A page is put in once, on its first path in document
    order. An inclusion that is not followed stays as a block of kind ``note`` whose text says why: ``missing`` (no such
    page), ``cycle`` (it stands around this one), ``again`` (it is put in elsewhere), ``depth`` or ``most``. ``roots``
    (page): pages to build, all if none. Inclusions without a target are missing; repeated positions go in any order.
    """
    names = blocks.select("page").distinct()
    edges = blocks.where("kind = 'include' and target is not null").select("page", F.col("target").alias("includes"), F.col("ord").alias("position"))
    known = edges.join(names.select(F.col("page").alias("__known")), F.col("includes") == F.col("__known"), "left_semi")
    start = names if roots is None else names.join(roots.select("page").distinct(), "page", "left_semi")
    paths = first_paths(known, depth, most)
    paths = paths if roots is None else paths.join(start.select(F.col("page").alias("root")), "root", "left_semi")
    inside = step(start.select(F.col("page").alias("root"), "page", F.lit(0).alias("depth"), F.array("page").alias("path"), F.lit("").alias("key")).unionByName(paths))
    of_page = inside.join(blocks, "page").withColumn("__at", F.concat(F.when(F.col("key") == "", "").otherwise(F.concat("key", F.lit("/"))), place(F.col("ord"))))

    put = inside.where("depth > 0").select("root", F.col("key").alias("__at"), F.lit(True).alias("__put"))
    met = inside.select("root", F.col("page").alias("target"), F.lit(True).alias("__met"))
    refs = of_page.where("kind = 'include'").join(put, ["root", "__at"], "left").where("__put is null").drop("__put")
    refs = refs.join(met, ["root", "target"], "left").join(names.select(F.col("page").alias("target"), F.lit(True).alias("__there")), "target", "left")
    why = F.when(F.col("__there").isNull(), "missing").when(F.array_contains("path", F.col("target")), "cycle").when(F.col("__met"), "again").when(F.col("depth") >= depth, "depth").otherwise("most")
    columns = ["root", "__at", "page", "depth", "kind", "text", "target"]
    notes = refs.select("root", "__at", "page", "depth", F.lit("note").alias("kind"), why.alias("text"), "target")
    nothing = F.lit(None).cast(blocks.schema["target"].dataType)
    body = of_page.where("kind != 'include'").select("root", "__at", "page", "depth", "kind", "text", nothing.alias("target"))
    titles = blocks.where("kind = 'title'").groupBy("page").agg(F.min_by("text", "ord").alias("__title"))
    heads = inside.where("depth > 0").join(titles, "page", "left").select("root", "page", "depth", "key", F.explode(F.array(F.struct(F.lit("page_break").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit("").alias("after")), F.struct(F.lit("heading").alias("kind"), F.coalesce("__title", F.col("page").cast("string")).alias("text"), F.lit("/").alias("after")))).alias("h"))
    heads = heads.select("root", F.concat("key", "h.after").alias("__at"), "page", "depth", "h.kind", "h.text", nothing.alias("target"))
    rows = body.where("not (kind = 'title' and depth > 0)").select(columns).unionByName(notes).unionByName(heads)
    position = F.row_number().over(Window.partitionBy("root").orderBy("__at"))
    return rows.select("root", position.cast("long").alias("position"), "page", F.col("depth").cast("long").alias("depth"), "kind", "text", "target")
