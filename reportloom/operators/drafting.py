"""Drafts without a model: answers read and checked as data, fallback structures, and passes that tidy lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import facts as K
from ..functions import hangul as G
from ..functions import text as T
from .facts import line_problems

ANSWER = "title string, lines array<struct<m:string,text:string,src:array<int>,rows:array<array<string>>>>, dropped array<int>"
MARKS = ("1", "□", "-", "∙", "→", "※", "*")


def json_part(raw: Column) -> Column:
    """What stands between the first brace and the last one; null without both."""
    return F.nullif(F.regexp_extract(T.filled(raw), r"(?s)(\{.*\})", 1), F.lit(""))


def read_answers(answers: DataFrame, raw: str, count: str) -> DataFrame:
    """Model answers as a struct ``answer`` and an array ``problems``: broken JSON, unknown sources, empty lines and
    thin tables are problems of the row, not errors of the job. ``count`` is the number of source sentences."""
    read = answers.withColumn("answer", F.from_json(json_part(F.col(raw)), ANSWER))
    lines = F.coalesce("answer.lines", F.array().cast("array<struct<m:string,text:string,src:array<int>,rows:array<array<string>>>>"))
    cited = F.flatten(F.transform(lines, lambda x: F.coalesce(x["src"], F.array().cast("array<int>"))))
    problems = F.array(
        F.when(F.col("answer.lines").isNull(), "no JSON"),
        F.when(F.exists(cited, lambda i: (i < 1) | (i > F.col(count))), "source out of range"),
        F.when(F.exists(lines, lambda x: (T.strip(T.filled(x["text"])) == "") & x["rows"].isNull()), "empty line"),
        F.when(F.exists(lines, lambda x: x["rows"].isNotNull() & (F.size(x["rows"]) < 2)), "table of one row"),
    )
    return read.withColumn("problems", F.filter(problems, lambda p: p.isNotNull()))


def answer_lines(answers: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each line of read answers: keys, line_no, mark (unknown ones as '-'), text, src."""
    rows = answers.select(*keys, F.posexplode("answer.lines").alias("__n", "__l"))
    mark = F.when(F.col("__l.m").isin(*MARKS), F.col("__l.m")).otherwise("-")
    return rows.select(*keys, (F.col("__n") + 1).cast("long").alias("line_no"), mark.alias("mark"), F.col("__l.text").alias("text"), F.col("__l.src").alias("src"))


def exact_cover(ids: Column, count: Column) -> Column:
    """Whether an array has each number from 1 to ``count`` once, in order."""
    return F.when(count > 0, ids == F.sequence(F.lit(1), count.cast("int"))).otherwise(F.size(ids) == 0)


def fallback_lines(sentences: DataFrame, keys: list[str], title: str = "현황") -> DataFrame:
    """The structure without a model: one section, and each sentence a line that cites itself."""
    head = sentences.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("line_no"), F.lit("1").alias("mark"), F.lit(title).alias("text"), F.array().cast("array<int>").alias("src"))
    body = sentences.select(*keys, F.col("sent_no").cast("long").alias("line_no"), F.lit("□").alias("mark"), F.col("text"), F.array(F.col("sent_no").cast("int")).alias("src"))
    return head.unionByName(body)


def render_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines as one text for each document: sections renumbered, other lines indented by their mark's depth."""
    depth = F.when(F.col("mark") == "-", 1).when(F.col("mark") == "∙", 2).otherwise(0)
    section = F.sum((F.col("mark") == "1").cast("int")).over(Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    shown = lines.withColumn("__s", section)
    line = F.when(F.col("mark") == "1", F.concat(F.col("__s").cast("string"), F.lit(". "), "text")).otherwise(F.concat(F.repeat(F.lit("  "), depth), "mark", F.lit(" "), "text"))
    return shown.select(*keys, "line_no", line.alias("__line")).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "__line"))), lambda x: x["__line"]), "\n").alias("text"))


def restrict_arrows(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Of each section's arrow lines the first stays an arrow, later ones become '-'."""
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("__s", F.sum((F.col("mark") == "1").cast("int")).over(w))
    nth = F.sum((F.col("mark") == "→").cast("int")).over(Window.partitionBy(*keys, "__s").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("__k", nth).withColumn("mark", F.when((F.col("mark") == "→") & (F.col("__k") > 1), "-").otherwise(F.col("mark"))).drop("__s", "__k")


def fix_level_order(lines: DataFrame, keys: list[str]) -> DataFrame:
    """A '-' before the first '□' of its section is lifted to '□'."""
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("__s", F.sum((F.col("mark") == "1").cast("int")).over(w))
    first = F.min(F.when(F.col("mark") == "□", F.col("line_no"))).over(Window.partitionBy(*keys, "__s"))
    early = (F.col("mark") == "-") & (F.col("line_no") < F.coalesce(F.col("__first"), F.lit(1 << 60)))
    return placed.withColumn("__first", first).withColumn("mark", F.when(early, "□").otherwise(F.col("mark"))).drop("__s", "__first")


def align_labels(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Labels before ' : ' in runs of lines with one mark are padded to the widest label of the run."""
    label = F.regexp_extract("text", r"^(\S[^:]*?) : ", 1)
    w = Window.partitionBy(*keys).orderBy("line_no")
    marked = lines.withColumn("__label", label).withColumn("__new", F.coalesce((F.lag("mark").over(w) != F.col("mark")) | (F.lag("__label").over(w) == "") | (F.col("__label") == ""), F.lit(True)))
    runs = marked.withColumn("__run", F.sum(F.col("__new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    width = T.display_width(F.col("__label"))
    wide = runs.withColumn("__wide", F.max(width).over(Window.partitionBy(*keys, "__run")))
    padded = F.concat("__label", F.repeat(F.lit(" "), F.col("__wide") - width), F.substring("text", F.char_length("__label") + 1, F.lit(2_000_000_000)))
    return wide.withColumn("text", F.when(F.col("__label") == "", F.col("text")).otherwise(padded)).drop("__label", "__new", "__run", "__wide")


def length_ratio(drafts: DataFrame, text: str, source: str) -> Column:
    """Visible characters of a draft over those of its source, rounded to three places."""
    return F.bround(F.try_divide(T.width_without_spaces(F.col(text)), T.width_without_spaces(F.col(source))), 3)


#: A line that restates so much of its section's title says nothing new; characters of a summary at most.
ECHO, MOST_SUMMARY = 0.6, 60


def best_overlap(rows: DataFrame, targets: DataFrame, scope: list[str], row_id: str, target_id: str, tokens: str = "tokens", least: int = 1) -> DataFrame:
    """Each row with the one target of its scope that shares most tokens with it: scope, row_id, target_id, overlap.

    ``rows`` and ``targets`` hold arrays of tokens. Both meet by token within their scope (a document, a table), and
    shared tokens are counted by pair. Where several targets share as many, or none shares ``least``, the target is null.
    Repeated tokens count once; rows of one id are one row.
    """
    spread = lambda df, key: df.select(*scope, key, F.explode(tokens).alias("__token")).distinct()
    shared = spread(rows, row_id).join(spread(targets, target_id), [*scope, "__token"]).groupBy(*scope, row_id, target_id).agg(F.count("*").alias("overlap")).where(F.col("overlap") >= least)
    level = shared.groupBy(*scope, row_id, "overlap").agg(F.count("*").alias("__n"), F.min(target_id).alias(target_id))
    best = level.groupBy(*scope, row_id).agg(F.max(F.struct("overlap", "__n", target_id)).alias("__b"))
    met = rows.select(*scope, row_id).distinct().join(best, [*scope, row_id], "left")
    return met.select(*scope, row_id, F.when(F.col("__b.__n") == 1, F.col(f"__b.{target_id}")).alias(target_id), F.coalesce("__b.overlap", F.lit(0)).cast("long").alias("overlap"))


def echo_share(title: Column, text: Column) -> Column:
    """The share of a title's stems that a text has; null for a title without stems."""
    own = K.stems(T.filled(title))
    return F.try_divide(F.size(F.array_intersect(own, K.stems(T.filled(text)))), F.size(own))


def drop_echoes(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines without those right below a section's title that only restate it: ``ECHO`` of its stems, no number, and a
    further line in the section."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    title = F.lag(F.when(F.col("mark") == "1", F.col("text"))).over(w)
    more = F.coalesce(F.lead("mark").over(w) != "1", F.lit(False))
    echo = (F.col("mark") != "1") & (echo_share(title, F.col("text")) >= ECHO) & (F.size(K.numbers(F.col("text"))) == 0) & more
    return lines.withColumn("__echo", F.coalesce(echo, F.lit(False))).where("not __echo").drop("__echo")


def problems_of(text: Column, source: Column, year: int, summary: Column | None = None) -> Column:
    """What is wrong with a line: facts that its source does not bear out, hard faults of style, too long a summary; as
    (kind, shown)."""
    shown = lambda kind, what: F.struct(kind.alias("kind"), what.alias("shown"))
    facts = F.transform(line_problems(text, source, year), lambda p: shown(p["kind"], p["shown"]))
    style = F.transform(G.hard_issues(text), lambda i: shown(F.concat(F.lit("style:"), i["kind"]), F.lit("")))
    long = F.when(F.char_length(text) > MOST_SUMMARY, F.array(shown(F.lit("long"), F.lit("")))).otherwise(F.array().cast("array<struct<kind:string,shown:string>>"))
    return F.concat(facts, style, F.when(summary, long).otherwise(F.array().cast("array<struct<kind:string,shown:string>>")) if summary is not None else F.array().cast("array<struct<kind:string,shown:string>>"))


def review(lines: DataFrame, keys: list[str], year: int) -> DataFrame:
    """The problems of a rewrite as rows: keys, line_no, kind, shown. ``lines``: keys, line_no, text, source (the text of the
    sentences that a line cites; null for none)."""
    found = lines.select(*keys, "line_no", F.explode(problems_of(F.col("text"), T.filled(F.col("source")), year)).alias("p"))
    return found.select(*keys, "line_no", "p.kind", "p.shown")


def mended(lines: DataFrame, keys: list[str], year: int, summaries: str | None = None) -> DataFrame:
    """``lines`` with texts that can be answered for, and ``action``, ``problems`` (kinds that stay, in order).

    A line without problems is ``kept``. Else its style is mended by rule, and if nothing is wrong then, it is ``fixed``.
    Else it is ``restored``: the sentences that it cites, by rule in report style. A line that cites none, and a summary
    (where the column ``summaries`` is true), is ``dropped`` instead: its text becomes null. What comes out is checked
    again; a restored line may keep faults that its source has itself.
    """
    summary = F.coalesce(F.col(summaries), F.lit(False)) if summaries else F.lit(False)
    kinds = lambda t, s, y: F.transform(problems_of(t, s, year, y), lambda p: p["kind"])
    c = {n: F.col(f"__{n}") for n in ("text", "source", "summary", "found", "fixed", "left", "whole", "last")}
    # a column for each attempt, null where an earlier one is good; not one nested expression, which Spark resolves a level at a time
    tried = lines.withColumns({"__text": T.filled(F.col("text")), "__source": T.filled(F.col("source")), "__summary": summary})
    tried = tried.withColumn("__found", kinds(c["text"], c["source"], c["summary"]))
    tried = tried.withColumn("__fixed", F.when(F.size(c["found"]) > 0, G.style_fix(c["text"])))
    tried = tried.withColumn("__left", F.when(c["fixed"].isNotNull(), kinds(c["fixed"], c["source"], c["summary"])))
    lost = (c["source"] == "") | c["summary"]
    again = c["left"].isNotNull() & (F.size(c["left"]) > 0)
    tried = tried.withColumn("__whole", F.when(again & ~lost, G.formal_text(K.notation(c["source"]), True)))
    tried = tried.withColumn("__last", F.when(c["whole"].isNotNull(), kinds(c["whole"], c["source"], c["summary"])))
    which = lambda kept, fixed, dropped, restored: F.when(F.size(c["found"]) == 0, kept).when(~again, fixed).when(lost, dropped).otherwise(restored)
    none = F.array().cast("array<string>")
    done = {"text": which(c["text"], c["fixed"], F.lit(None).cast("string"), c["whole"]), "action": which(F.lit("kept"), F.lit("fixed"), F.lit("dropped"), F.lit("restored")), "problems": which(none, none, c["found"], c["last"])}
    return tried.withColumns(done).drop(*[f"__{n}" for n in c])


def residue(sentences: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Sentences that no line cites, with the numbers that only they hold: keys, sent_no, text, numbers.

    ``sentences``: keys, sent_no, text; ``lines``: keys, text, src. Lines without a text cite nothing.
    """
    live = lines.where("text is not null")
    cited = live.select(*keys, F.explode(F.col("src").cast("array<bigint>")).alias("sent_no")).distinct()
    left = sentences.withColumn("sent_no", F.col("sent_no").cast("long")).join(cited, [*keys, "sent_no"], "left_anti")
    said = live.select(*keys, F.explode(K.numbers(F.col("text"))).alias("number")).distinct()
    numbers = left.select(*keys, "sent_no", F.explode(K.numbers(F.col("text"))).alias("number")).join(said, [*keys, "number"], "left_anti")
    kept = numbers.groupBy(*keys, "sent_no").agg(F.array_sort(F.collect_set("number")).alias("numbers"))
    return left.join(kept, [*keys, "sent_no"], "left").withColumn("numbers", F.coalesce("numbers", F.array().cast("array<string>")))
