"""Checks of rewritten lines against the sentences they cite, as joins and anti joins over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import facts as K
from ..functions import text as T

# Words of opposite direction, possibility and quantity.
OPPOSITES = (
    (("증가", "늘", "상승", "상향", "확대", "올라", "올랐", "올리", "올려", "오르", "높", "高", "↑", "증액", "인상"), ("감소", "줄", "하락", "하향", "축소", "내려", "내리", "낮", "低", "↓", "감액", "인하")),
    (("가능", "可", "수 있"), ("불가", "어려", "어렵", "곤란", "난이도 高", "난항", "쉽지 않")),
    (("다수", "대다수", "대부분", "전원", "모두", "전부", "多"), ("일부", "소수", "몇몇", "일부만")),
)
# Words of settled matters, what must not follow them, and what settles them in a source.
SETTLED, PENDING = ("확정", "완료", "결정", "마무리"), ("필요", "예정", "요", "검토", "추진", "전", "할", "하", "시")
SETTLED_SOURCE = ("확정", "완료", "결정", "마무리", "했", "됐", "되었", "하였", "끝")
BLOCKED = ("연차", "미채움")


def cited_text(lines: DataFrame, keys: list[str]) -> DataFrame:
    """For each cited sentence all text of the lines that cite it: keys, sent_no, cited. ``lines``: keys, line_no,
    text, src (array of sentence numbers)."""
    edges = lines.select(*keys, "line_no", "text", F.explode(F.array_distinct(F.col("src").cast("array<bigint>"))).alias("sent_no"))
    return edges.groupBy(*keys, "sent_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("cited"))


def uncovered_by_source(sentences: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Cited sentences with numbers that no citing line has: keys, sent_no, missing."""
    joined = sentences.join(cited_text(lines, keys), [*keys, "sent_no"])
    # a filter on the result would be computed a second time, in the join; none or one are spread instead
    some = F.filter(F.array(K.missing_numbers(F.col("text"), F.col("cited"))), lambda m: F.size(m) > 0)
    return joined.select(*keys, "sent_no", F.explode(some).alias("missing"))


def uncited_sentences(sentences: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Sentences that no line cites."""
    return sentences.join(lines.select(*keys, F.explode(F.col("src").cast("array<bigint>")).alias("sent_no")), [*keys, "sent_no"], "left_anti")


def lost_groups(groups: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Topic groups (keys, group_no, sent_no) of which no sentence is cited."""
    cited = lines.select(*keys, F.explode(F.col("src").cast("array<bigint>")).alias("sent_no")).distinct().withColumn("__cited", F.lit(1))
    return groups.join(cited, [*keys, "sent_no"], "left").groupBy(*keys, "group_no").agg(F.count("__cited").alias("__n")).where("__n = 0").drop("__n")


def polarity_flips(line: Column, source: Column, pairs=OPPOSITES) -> Column:
    """Whether a line says only one direction where its source says only the other."""
    has = lambda text, words: T.filled(text).rlike("|".join(words))
    out = F.lit(False)
    for up, down in pairs:
        for mine, other in ((up, down), (down, up)):
            out = out | (has(line, mine) & ~has(line, other) & has(source, other) & ~has(source, mine))
    return out


def unearned_settlement(line: Column, source: Column) -> Column:
    """Whether a line calls a matter settled that its source does not."""
    return T.filled(line).rlike(rf"(?U)(?:{'|'.join(SETTLED)})(?!\s*(?:{'|'.join(PENDING)}))") & ~T.filled(source).rlike("|".join(SETTLED_SOURCE))


def blocked_terms(line: Column, source: Column) -> Column:
    """Terms of BLOCKED in a line that its source has not."""
    return F.filter(F.array(*[F.lit(t) for t in BLOCKED]), lambda t: F.contains(T.filled(line), t) & ~F.contains(T.filled(source), t))


def line_problems(line: Column, source: Column, year: int | None = None) -> Column:
    """All problems of a line against its source as ARRAY<STRUCT<kind, shown>>, in a fixed order.

    Kinds: percent, money, date, number (not in the source), weekday, no_date (with a ``year``), latin, hanja (not in
    the source), opposite, settled, hedge (possible made certain), bound (left out), progress (not shown), blocked.
    """
    flag = lambda kind, test: F.when(test, F.array(F.struct(F.lit(kind).alias("kind"), F.lit("").alias("shown")))).otherwise(F.array().cast("array<struct<kind:string,shown:string>>"))
    parts = [
        K.invented_facts(line, source),
        *([K.weekday_problems(line, year)] if year else []),
        K.problems("latin", K.foreign_words(line, source)),
        K.problems("hanja", K.foreign_hanja(line, source)),
        flag("opposite", polarity_flips(line, source)),
        flag("settled", unearned_settlement(line, source)),
        K.problems("hedge", K.unhedged(line, source)),
        K.problems("bound", K.lost_bounds(line, source)),
        K.problems("progress", K.unshown_progress(line, source)),
        K.problems("blocked", blocked_terms(line, source)),
    ]
    return F.concat(*parts)


def best_attempt(attempts: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """Of each group the row with the least score, the earliest on ties."""
    columns = F.struct(*[c for c in attempts.columns if c not in keys])
    return attempts.groupBy(*keys).agg(F.min_by(columns, F.struct(score, order)).alias("__row")).select(*keys, "__row.*")


def triage(notes: DataFrame, rules: list[tuple[str, str, str]], note: str = "note") -> DataFrame:
    """Each note's first matching rule (name, pattern, severity) as columns rule and severity; others are 'other'.

    Rules are folded into one CASE in their order, so no join on patterns takes place.
    """
    names, grades = F, F
    name = grade = None
    for rule, pattern, severity in rules:
        hit = T.filled(F.col(note)).rlike(pattern)
        name = names.when(hit, rule) if name is None else name.when(hit, rule)
        grade = grades.when(hit, severity) if grade is None else grade.when(hit, severity)
    return notes.withColumns({"rule": name.otherwise("other"), "severity": grade.otherwise("info")})


def ordered_documents(docs: DataFrame, key: str, date: str, order: str) -> DataFrame:
    """Documents with their place: by date where all of a ``key`` have one, else in input order."""
    dated = F.min(F.col(date).isNotNull()).over(Window.partitionBy(key))
    seen = docs.withColumn("__dated", dated)
    w = Window.partitionBy(key).orderBy(F.when(F.col("__dated"), F.col(date)), order)
    return seen.withColumn("place", F.row_number().over(w).cast("long")).drop("__dated")


def table_sentences(rows: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Table rows as sentences 'label : column value, ...' without empty values, in a column ``sentence``."""
    parts = [F.when(T.strip(T.filled(F.col(c).cast("string"))) != "", F.concat(F.lit(f"{c} "), T.strip(F.col(c).cast("string")))) for c in columns]
    return rows.withColumn("sentence", F.concat(F.col(label).cast("string"), F.lit(" : "), F.concat_ws(", ", *parts)))
