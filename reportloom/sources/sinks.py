"""Block rows as Markdown texts, and tables of results as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import runs as R
from ..functions import text as T


def escape_start(text: Column) -> Column:
    """A line whose start Markdown would take as a heading, list, quote or number, escaped."""
    t = F.regexp_replace(T.filled(text), r"^([#>+*-])(\s)", r"\\$1$2")
    return F.regexp_replace(t, r"^(\d{1,9})([.)])(\s)", r"$1\\$2$3")


def block_markdown(styled: bool = False) -> Column:
    """One block as Markdown: heading marks, item marks with two ideographic spaces for each depth, fences, rules. With
    ``styled``, texts come from the column runs, but for code and blocks without runs."""
    text = F.when((F.col("kind") == "code") | (F.coalesce(F.size("runs"), F.lit(0)) < 1), F.col("text")).otherwise(R.inline_markdown(F.col("runs"))) if styled else F.col("text")
    mark = F.coalesce(F.when(F.col("ordered"), F.concat(F.coalesce(F.col("number"), F.lit(1)).cast("string"), F.lit("."))), F.lit("-"))
    return (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce(F.col("level"), F.lit(1)).cast("int")), F.lit(" "), text))
        .when(F.col("kind") == "item", F.concat(F.repeat(F.lit("　　"), F.coalesce(F.col("depth"), F.lit(0)).cast("int")), mark, F.lit(" "), text))
        .when(F.col("kind") == "code", F.concat(F.lit("```"), F.coalesce("lang", F.lit("")), F.lit("\n"), text, F.lit("\n```")))
        .when(F.col("kind") == "callout", F.concat(F.lit("> "), text))
        .when(F.col("kind") == "hr", "---")
        .when(F.col("kind") == "blank", "")
        .otherwise(escape_start(text))
    )


def table_rows(blocks: DataFrame, id_col: str) -> DataFrame:
    """Cells gathered into one block for each table row: '| a | b |', with a rule under the first row."""
    cells = blocks.where("kind = 'cell'")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell_idx", "text"))), lambda c: F.replace(F.replace(c["text"], F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))), " | ")
    rows = cells.groupBy(id_col, "row_idx", F.col("ord") - F.col("cell_idx")).agg(F.min("ord").alias("ord"), body.alias("line"), F.count("*").alias("__n"))
    rule = F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.col("__n").cast("int")))
    line = F.concat(F.lit("| "), "line", F.lit(" |"), F.when(F.col("row_idx") == 0, rule).otherwise(""))
    return rows.select(id_col, "ord", line.alias("line"), F.lit(True).alias("is_row"))


def to_markdown(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One Markdown text for each document: id, markdown. Blocks are parted by an empty line, table rows by none. Blocks
    with a column runs keep their bold, italic, code and links."""
    lines = blocks.where("kind != 'cell'").select(id_col, "ord", block_markdown("runs" in blocks.columns).alias("line"), F.lit(False).alias("is_row")).unionByName(table_rows(blocks, id_col))
    gathered = F.array_sort(F.collect_list(F.struct("ord", "line", "is_row")))
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("row"))
    step = lambda a, b: F.struct(F.concat(a["out"], F.when(a["out"] == "", "").when(a["row"] & b["is_row"], "\n").otherwise("\n\n"), b["line"]).alias("out"), b["is_row"].alias("row"))
    return lines.groupBy(id_col).agg(F.aggregate(gathered, start, step, lambda a: a["out"]).alias("markdown"))


def change_report(changes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One report for each document from its change rows (ord, before, after, rule)."""
    line = F.format_string("- [%s] %s → %s", "rule", "before", "after")
    return changes.select(id_col, "ord", line.alias("line")).groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("report"))


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """Rows as JSON lines, in one folder for each value of ``by``."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)
