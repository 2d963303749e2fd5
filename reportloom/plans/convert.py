"""Conversion of documents to report style as one plan: an ordered list of passes over block rows."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import facts as K
from ..functions import hangul as G
from ..functions import text as T
from ..operators import structure as B
from ..sources import sinks, text_files


@dataclass(frozen=True)
class Profile:
    """What a conversion does; the three named profiles differ in these values alone."""

    polish: str = "rules"
    noun_ending: bool = True
    merge_short: bool = True
    most_chars: int = 60
    keep_blank_lines: bool = False
    headings_as_levels: bool = True
    note_marks: tuple[str, ...] = ("*", "※", "주)", "주:")


PROFILES = {
    "default": Profile(),
    "confluence": Profile(polish="none", merge_short=False, noun_ending=False, keep_blank_lines=True),
    "formal": Profile(polish="none", merge_short=False, note_marks=("주)", "주:")),
}


def profile(name: str = "default", **changes) -> Profile:
    return replace(PROFILES[name], **changes)


def auto_profile(source):
    """'confluence' for web addresses, 'default' for anything else, as a column."""
    return F.when(T.filled(source).rlike("^https?://"), "confluence").otherwise("default")


def text_rules(blocks: DataFrame, p: Profile) -> DataFrame:
    """Notation everywhere but in code; endings in paragraphs and items; headings end in nouns; table cells keep theirs."""
    note = K.notation(F.col("text"))
    sentence = G.formal_text(note, p.noun_ending)
    heading = G.heading_noun_ending(note) if p.noun_ending else note
    text = F.when(F.col("kind") == "code", F.col("text")).when(F.col("kind") == "heading", heading).when(F.col("kind").isin("paragraph", "item") & ~T.is_date_line(F.col("text")), sentence).otherwise(note)
    return blocks.withColumn("text", text)


def convert_blocks(blocks: DataFrame, p: Profile = PROFILES["default"]) -> DataFrame:
    """Passes in the order that later ones rely on: blanks settle, blank blocks go, breaks soften, text rules, table
    notes, captions, short items merge, headings fold into levels."""
    out = B.settle_blank_lines(blocks, p.keep_blank_lines)
    out = B.soften_hard_breaks(B.drop_blank_blocks(out))
    if p.polish != "none":
        out = text_rules(out, p)
    out = B.attach_captions(B.attach_notes(out, p.note_marks))
    if p.merge_short:
        out = B.merge_short_items(out, p.most_chars)
    return B.fold_levels(out) if p.headings_as_levels else out


def changes(before: DataFrame, after: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Change rows (id, ord, before, after, rule) of blocks whose text a conversion altered or dropped."""
    old = before.select(id_col, "ord", F.col("text").alias("before"))
    new = after.select(id_col, "ord", F.col("text").alias("after"))
    joined = old.join(new, [id_col, "ord"], "left")
    return joined.where(~F.col("before").eqNullSafe(F.col("after"))).withColumn("rule", F.when(F.col("after").isNull(), "삭제·병합").otherwise("문체"))


def convert_markdown(docs: DataFrame, p: Profile = PROFILES["default"], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Markdown documents as Markdown in report style: id, markdown."""
    blocks = text_files.read_markdown(docs, id_col, text_col).withColumnRenamed(id_col, "doc_id")
    return sinks.to_markdown(convert_blocks(blocks, p), "doc_id").withColumnRenamed("doc_id", id_col)
