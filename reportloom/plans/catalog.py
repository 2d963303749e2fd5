"""All queries by name, each over its whole tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import drafts as D
from ..functions import facts as K
from ..functions import measure as M
from ..functions import runs as R
from ..functions import text as T
from ..operators import drafting as DR
from ..operators import facts as O
from ..operators import flow as FL
from ..operators import line_fit as LF
from ..operators import stats as S
from ..operators import structure as B
from ..operators import table_fit as TF
from ..operators import tables as TB
from ..operators.lineage import dealt
from ..sources import html as H
from ..sources import text_files as X
from . import cases
from . import profiles as PF

FLAGSHIP = "ending_class_topk"
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _queries | cases.queries()


def oracle_sql() -> dict[str, str]:
    return _sql | cases.oracle_sql()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.line_rows(table(spark, sf_dir, "documents"), ["doc_id"])


# SQL pieces: white space as Unicode has it, sentences without lookbehind, closing characters.
WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SENTENCES = rf"list_filter(string_split(regexp_replace(coalesce(text, ''), '(^|[^0-9])([.!?]){WS}+', '\1\2' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '{WS}+', '', 'g') <> '')"
CLOSERS_SQL = "' ' || chr(9) || chr(10) || '.!?)]}>」』】〕〉》\"''”’…'"
CORE = f"rtrim(s, {CLOSERS_SQL})"
CLASS = f"""CASE WHEN {CORE} = '' THEN '기타' WHEN {CORE} LIKE '%니다' THEN '~습니다 (합쇼체)' WHEN right({CORE}, 1) = '다' THEN '~다 (서술)'
  WHEN right({CORE}, 1) = '요' THEN '~요' WHEN right({CORE}, 1) IN ('음', '함', '임', '됨') THEN '~음/함/임 (개조식)'
  WHEN regexp_matches(right({CORE}, 1), '[가-힣]') THEN '명사 종결' WHEN regexp_matches(right({CORE}, 1), '[0-9%)]') THEN '수치·기호 종결' ELSE '기타' END"""
TAIL = f"CASE WHEN length({CORE}) >= 2 THEN right({CORE}, 2) ELSE '' END"
LINES = "SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS ord FROM documents"
BLANK = rf"regexp_full_match(line, '({WS}|\p{{Cf}}|\p{{Cc}}|\p{{Z}}|[\x{{3164}}\x{{115F}}\x{{1160}}\x{{2800}}\x{{17B4}}\x{{17B5}}\x{{034F}}])*')"


def shares_sql(source: str, by: str, value: str, n: int) -> str:
    return f"""
WITH v AS ({source}), c AS (SELECT {by}, {value} AS value, count(*) AS n FROM v GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, value) AS k, sum(n) OVER (PARTITION BY {by}) AS total FROM c)
SELECT {by}, value, CAST(n AS BIGINT) AS count, round_even(n / total, 3) AS share, CAST(k AS BIGINT) AS rank FROM r WHERE k <= {n}"""


def dist_sql(source: str, by: str, value: str) -> str:
    at = lambda q: f"round_even(CAST(l[least(len(l) - 1, CAST(floor({q} * len(l)) AS BIGINT)) + 1] AS DOUBLE), 2)"
    return f"""
WITH v AS ({source}), g AS (SELECT {by}, list_sort(list({value})) AS l FROM v WHERE {value} IS NOT NULL GROUP BY 1)
SELECT {by}, CAST(len(l) AS BIGINT) AS n, {at(0)} AS min, {at(0.25)} AS p25, {at(0.5)} AS p50, {at(0.75)} AS p75, {at(0.9)} AS p90, {at(1)} AS max FROM g"""


SENTENCE_SQL = f"SELECT lang, doc_id, unnest({SENTENCES}) AS s FROM documents"


@query(shares_sql(f"SELECT lang, {CLASS} || ' ' || {TAIL} AS value FROM ({SENTENCE_SQL})", "lang", "value", 8))
def ending_class_topk(spark, sf_dir):
    """The commonest sentence endings of each language with their shares."""
    return S.ending_shares(table(spark, sf_dir, "documents"))


@query(shares_sql(f"SELECT source, {CLASS} AS value FROM (SELECT source, unnest({SENTENCES}) AS s FROM documents)", "source", "value", 8))
def ending_class_by_source(spark, sf_dir):
    rows = S.sentence_rows(table(spark, sf_dir, "documents"), ["source"]).select("source", T.ending_class(F.col("sentence")).alias("value"))
    return S.top_shares(rows, "value", ["source"])


@query(dist_sql(f"SELECT lang, length(s) AS n FROM ({SENTENCE_SQL})", "lang", "n"))
def text_dist_by_lang(spark, sf_dir):
    rows = S.sentence_rows(table(spark, sf_dir, "documents"), ["lang"]).select("lang", F.char_length("sentence").alias("chars"))
    return S.distribution(rows, "chars", ["lang"])


@query(f"SELECT doc_id, CAST(len({SENTENCES}) AS BIGINT) AS sentences FROM documents")
def sentence_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("sentences"))


@query(dist_sql(f"SELECT lang, len({SENTENCES}) AS n FROM documents", "lang", "n"))
def sentences_per_item(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", F.size(T.sentences(F.col("text"))).alias("n"))
    return S.distribution(rows, "n", ["lang"])


@query(f"SELECT lang, round_even(count(*) FILTER (WHERE regexp_matches(s, '[.!?。]{WS}*$')) / count(*), 3) AS period_share, CAST(count(*) AS BIGINT) AS sentences FROM ({SENTENCE_SQL}) GROUP BY 1")
def period_share(spark, sf_dir):
    rows = S.sentence_rows(table(spark, sf_dir, "documents"), ["lang"])
    return rows.groupBy("lang").agg(S.ratio(F.count_if(F.col("sentence").rlike(r"(?U)[.!?。]\s*$")), F.count("*")).alias("period_share"), F.count("*").alias("sentences"))


RUNS_SQL = f"""
WITH l AS (SELECT doc_id, ord, {BLANK} AS blank FROM ({LINES})),
m AS (SELECT *, sum(CASE WHEN blank THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM l),
r AS (SELECT doc_id, k, count(*) FILTER (WHERE blank) AS length, max(k) OVER (PARTITION BY doc_id) AS last FROM m GROUP BY doc_id, k)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS run_no, CAST(length AS BIGINT) AS length FROM r WHERE length > 0 AND k < last"""


@query(RUNS_SQL)
def blank_runs(spark, sf_dir):
    return S.blank_runs(lines_of(spark, sf_dir))


@query(f"SELECT line, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs, CAST(count(*) AS BIGINT) AS occurrences FROM ({LINES}) WHERE line <> '' GROUP BY line HAVING count(DISTINCT doc_id) >= 2")
def line_repeat(spark, sf_dir):
    return S.shared_phrases(lines_of(spark, sf_dir).where("line <> ''"), "line", "doc_id")


WORD_SQL = "SELECT doc_id, unnest(string_split(replace(coalesce(text, ''), chr(10), ' '), ' ')) AS word FROM documents"


@query(f"SELECT word, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs, CAST(count(*) AS BIGINT) AS occurrences FROM ({WORD_SQL}) WHERE word <> '' GROUP BY word HAVING count(DISTINCT doc_id) >= 2")
def phrases_multi_doc(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    words = docs.select("doc_id", F.explode(F.split(F.replace(T.filled(F.col("text")), F.lit("\n"), F.lit(" ")), " ", -1)).alias("word"))
    return S.shared_phrases(words.where("word <> ''"), "word", "doc_id")


def forms_sql(forms: dict[str, str]) -> str:
    each = [f"SELECT '{name}' AS form, len(regexp_extract_all(coalesce(text, ''), '{rx}')) AS n FROM documents" for name, rx in forms.items()]
    return f"SELECT form, CAST(sum(n) AS BIGINT) AS occurrences, CAST(count(*) FILTER (WHERE n > 0) AS BIGINT) AS docs FROM ({' UNION ALL '.join(each)}) GROUP BY form"


@query(forms_sql({"%p": r"[0-9]\s*%p", "억원": r"[0-9]\s*억\s*원?", "백만원": r"[0-9]\s*백만\s*원", "천단위 콤마": r"[0-9]{1,3}(?:,[0-9]{3})+", "▲/△ 증감": r"[▲△▼▽]\s*[0-9]"}))
def number_forms(spark, sf_dir):
    forms = {k: v for k, v in T.NUMBER_FORMS.items() if k != "%"}
    return S.form_totals(table(spark, sf_dir, "documents"), forms)


# every character but a digit is doubled, so that one half ends a match and the other may begin the next: RE2 looks
# neither back nor ahead
DOUBLED = r"regexp_replace(coalesce(text, ''), '([^0-9])', '\1\1', 'g')"
SPACES2 = rf"(?:{WS}{WS})*"
EDGE_BEFORE, EDGE_AFTER = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
DATE_FORMS_SQL = {
    "YYYY.M.D.": rf"{EDGE_BEFORE}(?:19|20)[0-9]{{2}}{SPACES2}\.\.{SPACES2}[0-9]{{1,2}}{SPACES2}\.\.{SPACES2}[0-9]{{1,2}}{SPACES2}\.\.",
    "YYYY-MM-DD": rf"{EDGE_BEFORE}(?:19|20)[0-9]{{2}}--[0-9]{{1,2}}--[0-9]{{1,2}}{EDGE_AFTER}",
    "YY.M.D.": rf"(?:^|[^0-9])[0-9]{{2}}{SPACES2}\.\.{SPACES2}[0-9]{{1,2}}{SPACES2}\.\.{SPACES2}[0-9]{{1,2}}{SPACES2}\.\.(?:$|[^0-9])",
    "YYYY년 M월 D일": rf"(?:19|20)[0-9]{{2}}{SPACES2}년년{SPACES2}[0-9]{{1,2}}{SPACES2}월월{SPACES2}[0-9]{{1,2}}{SPACES2}일일",
    "M/D": r"(?:^|[^0-9/])[0-9]{1,2}//[0-9]{1,2}(?:$|[^0-9/])",
    "%": rf"[0-9]{SPACES2}%%(?:$|[^p])",
}


@query(forms_sql(DATE_FORMS_SQL).replace("coalesce(text, '')", DOUBLED))
def date_forms(spark, sf_dir):
    return S.form_totals(table(spark, sf_dir, "documents"), T.DATE_FORMS | {"%": T.NUMBER_FORMS["%"]})


ORDER_DATE = "strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d')"


@query(shares_sql(f"SELECT o_orderstatus, regexp_replace({ORDER_DATE} || '', '[0-9]', '9', 'g') AS value FROM orders", "o_orderstatus", "value", 10))
def date_shapes(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", F.explode(K.date_shapes(F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd"))).alias("value"))
    return S.top_shares(rows, "value", ["o_orderstatus"], 10)


@query("SELECT o_orderkey, '기한 ' || year(CAST(o_orderdate AS DATE)) || '. ' || month(CAST(o_orderdate AS DATE)) || '. ' || day(CAST(o_orderdate AS DATE)) || '.까지' AS line FROM orders")
def notation_dates(spark, sf_dir):
    raw = F.concat(F.lit("기한 "), F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd"), F.lit("까지"))
    return table(spark, sf_dir, "orders").select("o_orderkey", K.dates(raw, "$1. $2. $3.").alias("line"))


@query("SELECT o_orderkey, '총 ' || format('{:,}', o_orderkey * 1000 + 7) || '건' AS line FROM orders")
def thousands_units(spark, sf_dir):
    raw = F.concat(F.lit("총 "), (F.col("o_orderkey") * 1000 + 7).cast("string"), F.lit("건"))
    return table(spark, sf_dir, "orders").select("o_orderkey", K.thousands(raw).alias("line"))


CHARS = rf"regexp_replace(coalesce(text, ''), '{WS}', '', 'g')"


def charset_sql() -> str:
    count = lambda cls: f"sum(length(regexp_replace({CHARS}, '[^{cls}]', '', 'g')))"
    parts = ", ".join(f"round_even(CAST({count(c)} AS DOUBLE) / sum(length({CHARS})), 3) AS {k}_share" for k, c in {"hangul": "가-힣ㄱ-ㅎㅏ-ㅣ", "hanja": "一-鿿", "latin": "A-Za-z", "digits": "0-9"}.items())
    return f"SELECT lang, CAST(sum(length({CHARS})) AS BIGINT) AS chars, {parts} FROM documents GROUP BY lang"


@query(charset_sql())
def charset_share(spark, sf_dir):
    return S.charset(table(spark, sf_dir, "documents"), "lang")


MARKED = rf"""
SELECT *, CASE WHEN mark <> '' AND NOT blank AND (symbol <> '' OR sep <> 'none') AND NOT (first <> '' AND first = right(mark, 1)) THEN mark END AS found FROM (
  SELECT *, CASE WHEN first = chr(9) THEN 'tab' WHEN first IN (' ', '　') THEN 'space' ELSE 'none' END AS sep FROM (
    SELECT *, substr(regexp_replace(line, '^[ 　\t]*', ''), length(mark) + 1, 1) AS first FROM (
      SELECT *, CASE WHEN symbol <> '' THEN symbol ELSE regexp_extract(line, '^[ 　\t]*({T.WORDY_MARKS})', 1) END AS mark FROM (
        SELECT *, regexp_extract(line, '^[ 　\t]*({T.SYMBOL_MARKS})', 1) AS symbol, {BLANK} AS blank FROM ({LINES})))))"""
MARKER_SQL = f"""
WITH m AS (SELECT *, coalesce(lag(blank) OVER (PARTITION BY doc_id ORDER BY ord), false) AS spaced FROM ({MARKED}))
SELECT found AS mark, CAST(count(*) AS BIGINT) AS lines, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs, array_to_string(list_sort(list(DISTINCT sep)), ',') AS seps,
  round_even(avg(length(line)), 2) AS mean_len, round_even(count(*) FILTER (WHERE spaced) / count(*), 3) AS spaced_share FROM m WHERE found IS NOT NULL GROUP BY found"""


@query(MARKER_SQL)
def marker_profile(spark, sf_dir):
    return S.marker_profile(lines_of(spark, sf_dir))


STRIPPED = f"regexp_replace(regexp_replace(line, '^{WS}+', ''), '{WS}+$', '')"
CAPTION = " OR ".join(f"(starts_with(t, '{a}') AND ends_with(t, '{b}') AND regexp_replace(substr(t, 2, length(t) - 2), '{WS}', '', 'g') <> '')" for a, b in T.BRACKET_PAIRS)
SKELETON_SQL = rf"""
WITH v AS (SELECT doc_id, ord, CASE WHEN regexp_matches(t, '^[0-9]{{4}}{WS}*\.{WS}*[0-9]{{1,2}}{WS}*\.{WS}*[0-9]{{1,2}}{WS}*\.?$') THEN 'date' WHEN {CAPTION} THEN 'caption' WHEN found IS NOT NULL THEN found
  ELSE 'text' || least(length(line) // 20, 5) END AS shape FROM (SELECT *, {STRIPPED} AS t FROM ({MARKED})) WHERE NOT blank),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY ord DESC) AS z FROM v)
SELECT doc_id, string_agg(shape, '·' ORDER BY ord) AS skeleton FROM p WHERE a <= 6 OR z <= 3 GROUP BY doc_id"""


@query(SKELETON_SQL)
def line_skeleton(spark, sf_dir):
    return S.skeleton(lines_of(spark, sf_dir))


def items_of(spark, sf_dir):
    """Document lines as blocks: blank lines, short lines as items of depth length mod 2, others as paragraphs."""
    kind = F.when(F.col("line") == "", "blank").when(F.char_length("line") <= 40, "item").otherwise("paragraph")
    return lines_of(spark, sf_dir).select("doc_id", "ord", kind.alias("kind"), (F.char_length("line") % 2).cast("int").alias("depth"), F.col("line").alias("text"))


ITEMS = f"SELECT doc_id, ord, CASE WHEN line = '' THEN 'blank' WHEN length(line) <= 40 THEN 'item' ELSE 'paragraph' END AS kind, CAST(length(line) % 2 AS INTEGER) AS depth, line AS text FROM ({LINES})"
MERGE_SQL = f"""
WITH b AS ({ITEMS}),
e AS (SELECT *, lead(text) OVER w AS next, coalesce(kind = 'item' AND lead(kind) OVER w = 'item' AND lead(depth) OVER w = depth AND length(text) + lead(length(text)) OVER w + 3 <= 60, false) AS edge FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
g AS (SELECT *, coalesce(sum(CASE WHEN edge THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM e),
t AS (SELECT *, edge AND row_number() OVER (PARTITION BY doc_id, run ORDER BY ord) % 2 = 1 AS take FROM g),
x AS (SELECT *, coalesce(lag(take) OVER (PARTITION BY doc_id ORDER BY ord), false) AS eaten FROM t)
SELECT doc_id, CAST(ord AS BIGINT) AS ord, kind, depth, CASE WHEN take THEN text || ' 및 ' || next ELSE text END AS text FROM x WHERE NOT eaten"""


@query(MERGE_SQL)
def greedy_pair_merge(spark, sf_dir):
    return B.merge_short_items(items_of(spark, sf_dir)).withColumn("ord", F.col("ord").cast("long"))


SETTLE_SQL = f"""
WITH b AS ({ITEMS}),
e AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY ord) AS p, min(CASE WHEN kind <> 'blank' THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM b)
SELECT doc_id, CAST(ord AS BIGINT) AS ord, kind, depth, text FROM e WHERE kind <> 'blank' OR (p <> 'blank' AND after IS NOT NULL)"""


@query(SETTLE_SQL)
def blank_line_settle(spark, sf_dir):
    return B.settle_blank_lines(items_of(spark, sf_dir)).withColumn("ord", F.col("ord").cast("long"))


def star_blocks(spark, sf_dir):
    """Regions as documents of headings (nations) and items (suppliers)."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    heads = nation.select(F.col("n_regionkey").cast("long").alias("doc_id"), (F.col("n_nationkey") * 1_000_000).cast("long").alias("ord"), F.lit("heading").alias("kind"), F.lit(2).alias("level"), F.lit(None).cast("int").alias("depth"), F.col("n_name").alias("text"))
    items = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(F.col("n_regionkey").cast("long").alias("doc_id"), (F.col("n_nationkey") * 1_000_000 + F.col("s_suppkey") + 1).cast("long").alias("ord"), F.lit("item").alias("kind"), F.lit(None).cast("int").alias("level"), F.lit(0).alias("depth"), F.col("s_name").alias("text"))
    return heads.unionByName(items)


STAR = """SELECT CAST(n_regionkey AS BIGINT) AS doc_id, CAST(n_nationkey AS BIGINT) * 1000000 AS ord, 'heading' AS kind, n_name AS text FROM nation
UNION ALL SELECT n_regionkey, CAST(n_nationkey AS BIGINT) * 1000000 + s_suppkey + 1, 'item', s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
FOLD_SQL = f"""
WITH b AS ({STAR}), d AS (SELECT *, CASE WHEN kind = 'heading' THEN 0 ELSE coalesce(max(CASE WHEN kind = 'heading' THEN 1 END) OVER (PARTITION BY doc_id ORDER BY ord), 0) END AS d FROM b)
SELECT doc_id, ord, 'item' AS kind, text, kind = 'heading' AS from_heading, CAST(d - min(d) OVER (PARTITION BY doc_id) AS INTEGER) AS depth FROM d"""


@query(FOLD_SQL)
def level_fold_windows(spark, sf_dir):
    return B.fold_levels(star_blocks(spark, sf_dir)).select("doc_id", "ord", "kind", "text", "from_heading", "depth")


COUNTER_SQL = f"""
WITH f AS ({FOLD_SQL}), g AS (SELECT *, sum(CASE WHEN depth = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS part FROM f)
SELECT doc_id, ord, depth, CAST(row_number() OVER (PARTITION BY doc_id, depth, CASE WHEN depth = 0 THEN 0 ELSE part END ORDER BY ord) AS BIGINT) AS number FROM g"""


@query(COUNTER_SQL)
def marker_counters(spark, sf_dir):
    return B.number_items(B.fold_levels(star_blocks(spark, sf_dir))).select("doc_id", "ord", "depth", "number")


DIGITS = lambda one, five, ten: f"['', '{one}', '{one}{one}', '{one}{one}{one}', '{one}{five}', '{five}', '{five}{one}', '{five}{one}{one}', '{five}{one}{one}{one}', '{one}{ten}']"
ROMAN_SQL = f"repeat('M', number // 1000) || {DIGITS('C', 'D', 'M')}[number // 100 % 10 + 1] || {DIGITS('X', 'L', 'C')}[number // 10 % 10 + 1] || {DIGITS('I', 'V', 'X')}[number % 10 + 1]"
TEXTS_SQL = f"""
SELECT c.doc_id, c.ord, CASE WHEN depth = 0 THEN {ROMAN_SQL} || '.' ELSE repeat(substr('{B.HANGUL_LETTERS}', (number - 1) % {len(B.HANGUL_LETTERS)} + 1, 1), (number - 1) // {len(B.HANGUL_LETTERS)} + 1) || '.' END || ' ' || s.text AS line
FROM ({COUNTER_SQL}) c JOIN ({STAR}) s ON c.doc_id = s.doc_id AND c.ord = s.ord"""


@query(TEXTS_SQL)
def marker_texts(spark, sf_dir):
    numbered = B.number_items(B.fold_levels(star_blocks(spark, sf_dir)))
    mark = F.when(F.col("depth") == 0, B.format_marker("{ROMAN}.", F.col("number"))).when(F.col("depth") == 1, B.format_marker("{hangul}.", F.col("number"))).otherwise(B.format_marker("{circled}", F.col("number")))
    return numbered.select("doc_id", "ord", F.concat(mark, F.lit(" "), "text").alias("line"))


NUMS = r"list_transform(regexp_extract_all(regexp_replace(coalesce({c}, ''), '([0-9]),([0-9]{{3}})', '\1\2', 'g'), '[0-9]+(?:\.[0-9]+)?'), lambda x: CASE WHEN contains(x, '.') THEN rtrim(rtrim(regexp_replace(x, '^0+([0-9])', '\1'), '0'), '.') ELSE regexp_replace(x, '^0+([0-9])', '\1') END)"


def turn_pairs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns.select("conv_id", "turn", F.lag("text").over(w).alias("source"), F.col("text").alias("line")).where("source is not null")


def order_statements(spark, sf_dir):
    """Each order as a Korean sentence (quantity, discount, amount, date) and a report line on it, in the report's
    notation, in which every second to seventh order has one of its facts changed."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    changed = lambda n: (k % n == 0).cast("int")
    source = F.format_string("수량 %d개, 할인 %d%%, 금액 %d만 원, 기한 %d월 %d일입니다", k % 50 + 100, k % 10 + 1, k % 90 + 10, F.month(day), F.day(day))
    line = F.format_string("수량 %d개, 할인 %d%%, 금액 %d만원, 기한 %d.%d", k % 50 + 100 + changed(2), k % 10 + 1 + changed(7), k % 90 + 10 + changed(3), F.month(day), F.when(k % 5 == 0, F.day(day) % 28 + 1).otherwise(F.day(day)))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", source.alias("source"), line.alias("line"))


STATED = """SELECT o_orderkey, o_custkey, k % 50 + 100 AS q, k % 10 + 1 AS d, k % 90 + 10 AS m, month(t) AS mo, day(t) AS da,
  k % 50 + 100 + CAST(k % 2 = 0 AS INT) AS q2, k % 10 + 1 + CAST(k % 7 = 0 AS INT) AS d2, k % 90 + 10 + CAST(k % 3 = 0 AS INT) AS m2, CASE WHEN k % 5 = 0 THEN day(t) % 28 + 1 ELSE day(t) END AS da2
  FROM (SELECT o_orderkey, o_custkey, o_orderkey AS k, CAST(o_orderdate AS DATE) AS t FROM orders)"""
MISSING_SQL = f"""SELECT o_orderkey, o_custkey, array_to_string(list_sort(list_distinct(list_filter(
  list_concat([q], CASE WHEN d <> d2 THEN [d] ELSE [] END, CASE WHEN m <> m2 THEN [m] ELSE [] END, CASE WHEN da <> da2 THEN [mo, da] ELSE [] END),
  lambda x: NOT list_contains([q2, d2, m2, mo, da2], x)))), ',') AS missing FROM ({STATED})"""


@query(f"""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN d <> d2 THEN d2 || '%' END, CASE WHEN m <> m2 THEN m2 || '만원' END,
  CASE WHEN da <> da2 THEN mo || '.' || da2 END, CASE WHEN q <> q2 THEN q2 || '' END], lambda x: x IS NOT NULL), ',') AS invented FROM ({STATED})""")
def invented_numbers(spark, sf_dir):
    """Percents, amounts, dates and numbers of each line that its source has not."""
    return order_statements(spark, sf_dir).select("o_orderkey", F.array_join(K.invented_numbers(F.col("line"), F.col("source")), ",").alias("invented"))


@query(f"SELECT o_orderkey, missing FROM ({MISSING_SQL})")
def missing_numbers(spark, sf_dir):
    """Numbers of each source that its line does not carry over."""
    return order_statements(spark, sf_dir).select("o_orderkey", F.array_join(K.missing_numbers(F.col("source"), F.col("line")), ",").alias("missing"))


@query(f"SELECT lang, doc_id, array_to_string(list_sort(list_distinct({NUMS.format(c='text')})), ',') AS numbers FROM documents")
def number_sets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", "doc_id", F.array_join(F.array_sort(K.numbers(F.col("text"))), ",").alias("numbers"))


TURNS = "SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS source FROM conversations"
WORDS = "list_transform(regexp_extract_all(coalesce({c}, ''), '[A-Za-z][A-Za-z&]*'), lambda x: lower(x))"


@query(f"SELECT conv_id, turn, CAST(len(list_filter(list_distinct({WORDS.format(c='text')}), lambda x: NOT list_contains({WORDS.format(c='source')}, x))) AS BIGINT) AS foreign_words FROM ({TURNS}) WHERE source IS NOT NULL")
def foreign_words(spark, sf_dir):
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", F.size(K.foreign_words(F.col("line"), F.col("source"))).cast("long").alias("foreign_words"))


@query("""
WITH c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS m FROM conversations)
SELECT conv_id, CAST(n AS BIGINT) AS sent_no, text FROM c WHERE n % 2 = 0""")
def uncited_sentences(spark, sf_dir):
    """Turns as sentences, where each odd turn is a line that cites itself: even turns stay uncited."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("sent_no"), "text")
    lines = turns.where("sent_no % 2 = 1").select("conv_id", F.col("sent_no").alias("line_no"), "text", F.array("sent_no").alias("src"))
    return O.uncited_sentences(turns, lines, ["conv_id"])


@query(f"SELECT o_custkey, o_orderkey AS sent_no, missing FROM ({MISSING_SQL}) WHERE missing <> ''")
def uncovered_by_source(spark, sf_dir):
    """The orders of a customer as sentences, each cited by its line: numbers that no citing line carries over."""
    stated = order_statements(spark, sf_dir)
    sentences = stated.select("o_custkey", F.col("o_orderkey").alias("sent_no"), F.col("source").alias("text"))
    lines = stated.select("o_custkey", F.col("o_orderkey").alias("line_no"), F.col("line").alias("text"), F.array("o_orderkey").alias("src"))
    return O.uncovered_by_source(sentences, lines, ["o_custkey"]).withColumn("missing", F.array_join("missing", ","))


@query("SELECT n_nationkey, n_name || ' : n_regionkey ' || n_regionkey || CASE WHEN trim(r_name) <> '' THEN ', r_name ' || trim(r_name) ELSE '' END AS sentence FROM nation JOIN region ON n_regionkey = r_regionkey")
def flatten_table_sentences(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return O.table_sentences(rows, "n_name", ["n_regionkey", "r_name"]).select("n_nationkey", "sentence")


@query("SELECT p_partkey, CAST(length(coalesce(p_name, '')) * 0.5 * 152400 AS DOUBLE) AS width FROM part")
def text_widths(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", M.text_width(F.col("p_name"), 12 * M.EMU_PER_PT).alias("width"))


# the wrapping of a text without wide letters as a fold over its characters; 76200 is half an em of 12 pt
WRAP_SQL = """
SELECT p_partkey, CAST(list_reduce(string_split(p_name, ''), lambda s, c: CASE
    WHEN c = ' ' AND s.used + s.word + 76200 > 1000000 THEN {'n': s.n + 1, 'used': 0.0::DOUBLE, 'word': 0.0::DOUBLE}
    WHEN c = ' ' THEN {'n': s.n, 'used': s.used + s.word + 76200, 'word': 0.0::DOUBLE}
    WHEN s.used + s.word + 76200 > 1000000 AND s.word + 76200 > 1000000 THEN {'n': CASE WHEN s.used > 0 THEN s.n + 1 ELSE s.n END + CAST(floor((s.word + 76200) / 1000000) AS INT), 'used': 0.0::DOUBLE, 'word': (s.word + 76200) % 1000000}
    WHEN s.used + s.word + 76200 > 1000000 THEN {'n': CASE WHEN s.used > 0 THEN s.n + 1 ELSE s.n END, 'used': 0.0::DOUBLE, 'word': s.word + 76200}
    ELSE {'n': s.n, 'used': s.used, 'word': s.word + 76200} END, {'n': 1, 'used': 0.0::DOUBLE, 'word': 0.0::DOUBLE}).n AS INTEGER) AS lines,
  CAST(list_max(list_transform(string_split(p_name, ' '), lambda w: length(w))) * 76200 AS DOUBLE) AS longest FROM part"""


@query(WRAP_SQL)
def wrap_counts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", M.wrap_count(F.col("p_name"), 12 * M.EMU_PER_PT, 1_000_000.0).alias("lines"), M.longest_word_width(F.col("p_name"), 12 * M.EMU_PER_PT).alias("longest"))


def nation_cells(spark, sf_dir):
    """A table for each region: a title over both columns, then a row for each nation (name, key), of which the first
    name takes two rows, so that the next row has its key cell alone."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    title = region.select(F.col("r_regionkey").cast("long").alias("table_id"), F.lit(0).alias("row_idx"), F.lit(0).alias("cell_idx"), F.concat(F.col("r_name"), F.lit(" "), F.repeat(F.col("r_name"), F.col("r_regionkey").cast("int"))).alias("text"), F.lit(2).alias("colspan"), F.lit(1).alias("rowspan"))
    n = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    rows = nation.withColumn("n", n).select(F.col("n_regionkey").cast("long").alias("table_id"), F.col("n").alias("row_idx"), F.posexplode(F.array("n_name", F.col("n_nationkey").cast("string"))).alias("cell_idx", "text"))
    kept = rows.where("not (row_idx = 2 and cell_idx = 0)")
    return title.unionByName(kept.withColumns({"colspan": F.lit(1), "rowspan": F.when((F.col("row_idx") == 1) & (F.col("cell_idx") == 0), 2).otherwise(1)}))


DEMAND_SQL = """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS n FROM nation),
one AS (SELECT n_regionkey AS t, max(CASE WHEN n <> 2 THEN length(n_name) ELSE 0 END) * 76200.0 AS a, max(length(n_nationkey || '')) * 76200.0 AS b,
  max(CASE WHEN n <> 2 THEN list_max(list_transform(string_split(n_name, ' '), lambda w: length(w))) ELSE 0 END) * 76200.0 AS la FROM n GROUP BY 1),
two AS (SELECT *, (length(r_name) * (1 + r_regionkey) + 1) * 76200.0 AS w, list_max(list_transform(string_split(r_name || ' ' || repeat(r_name, r_regionkey), ' '), lambda w: length(w))) * 76200.0 AS l FROM one JOIN region ON t = r_regionkey),
d AS (SELECT t, la + greatest(0, (l - la - b) / 2) AS l0, b + greatest(0, (l - la - b) / 2) AS l1, a + greatest(0, (w - a - b) / 2) AS w0, b + greatest(0, (w - a - b) / 2) AS w1 FROM two)
SELECT CAST(t AS BIGINT) AS table_id, CAST(k AS BIGINT) AS "column", CAST(CASE k WHEN 0 THEN l0 ELSE l1 END AS DOUBLE) AS least, CAST(CASE k WHEN 0 THEN greatest(w0, l0) ELSE greatest(w1, l1) END AS DOUBLE) AS wished
FROM d, (VALUES (0), (1)) AS k(k)"""


def nation_demands(spark, sf_dir):
    size = 12 * M.EMU_PER_PT
    return TB.column_demands(B.grid_columns(nation_cells(spark, sf_dir)), M.longest_word_width(F.col("text"), size), M.text_width(F.col("text"), size))


@query(DEMAND_SQL)
def column_demands(spark, sf_dir):
    """The least and wished width of each column, with cells over two columns and over two rows."""
    return nation_demands(spark, sf_dir)


# two columns: filled up to one level, cut down to one level, or scaled
WIDTH_SQL = f"""
WITH d AS (SELECT table_id, max(CASE WHEN "column" = 0 THEN least END) AS l0, max(CASE WHEN "column" = 1 THEN least END) AS l1, max(CASE WHEN "column" = 0 THEN wished END) AS w0, max(CASE WHEN "column" = 1 THEN wished END) AS w1 FROM ({DEMAND_SQL}) GROUP BY 1),
f AS (SELECT *, CASE WHEN w0 + w1 <= 2000000 THEN CASE WHEN greatest(w0, w1) <= 1000000 THEN 1000000 WHEN w0 >= w1 THEN w0 ELSE 2000000 - w1 END
  WHEN l0 + l1 <= 2000000 THEN CASE WHEN w0 <= 1000000 THEN w0 WHEN w1 <= 1000000 THEN 2000000 - w1 WHEN l0 > 1000000 THEN l0 WHEN l1 > 1000000 THEN 2000000 - l1 ELSE 1000000 END
  ELSE l0 * 2000000 / (l0 + l1) END AS x FROM d)
SELECT table_id, CAST(k AS BIGINT) AS "column", CAST(round(CASE k WHEN 0 THEN x ELSE 2000000 - x END, 0) AS BIGINT) AS width, l0 + l1 > 2000000 AS overflow FROM f, (VALUES (0), (1)) AS k(k)"""


@query(WIDTH_SQL)
def table_column_widths(spark, sf_dir):
    """Column widths of the same tables in 2,000,000 EMU."""
    widths = TB.column_widths(nation_demands(spark, sf_dir), 2_000_000)
    return widths.select("table_id", "column", F.round("width", 0).cast("long").alias("width"), "overflow")


@query(r"""SELECT page_id, CAST(len(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS BIGINT) AS links, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1))), ' '), '') AS targets FROM pages""")
def html_links(spark, sf_dir):
    links = H.links(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).cast("long").alias("links"), F.array_join(F.array_sort(F.array_distinct(links)), " ").alias("targets"))


PAGE_BLOCKS = "'<title>([^<]*)|<li>\\s*<a[^>]*>([^<]*)|<div class=\"[^\"]*\">([^<]*)|<h1>([^<]*)|<p>(?:<b>)?([^<]*)|<footer>([^<]*)'"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def decoded(sql: str) -> str:
    """SQL of a text from html: character references as characters, white space as one space, trimmed."""
    for name, letter in ENTITIES:
        sql = f"replace({sql}, '{name}', '{letter}')"
    return rf"trim(regexp_replace({sql}, '\s+', ' ', 'g'))"


@query(f"""
WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, {PAGE_BLOCKS})) AS tag, {", ".join(f"unnest(regexp_extract_all(html, {PAGE_BLOCKS}, {g})) AS g{g}" for g in range(1, 7))}, unnest(range(1, len(regexp_extract_all(html, {PAGE_BLOCKS})) + 1)) AS n FROM pages),
t AS (SELECT page_id, n, CASE WHEN tag LIKE '<title%' THEN 'title' WHEN tag LIKE '<li%' THEN 'item' WHEN tag LIKE '<h1%' THEN 'heading' ELSE 'paragraph' END AS kind, {decoded("concat(g1, g2, g3, g4, g5, g6)")} AS text FROM b)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n) AS ord, kind, CASE WHEN kind = 'heading' THEN 1::BIGINT END AS level, CASE WHEN kind = 'item' THEN 0::BIGINT END AS depth, CASE WHEN kind = 'item' THEN false END AS ordered,
  NULL::BIGINT AS row_idx, NULL::BIGINT AS cell_idx, NULL::VARCHAR AS callout_kind, text FROM t WHERE text <> ''""")
def html_blocks(spark, sf_dir):
    return H.read_blocks(table(spark, sf_dir, "pages"), "page_id", "html").drop("runs")


HOSTS = r"lower(regexp_extract(url, '//([^/:?#]*)', 1))"


@query(shares_sql(rf"SELECT regexp_extract({HOSTS}, '([^.]*)$', 1) AS tld, {HOSTS} AS value FROM pages", "tld", "value", 8))
def host_shares(spark, sf_dir):
    host = F.lower(F.regexp_extract("url", "//([^/:?#]*)", 1))
    return S.top_shares(table(spark, sf_dir, "pages").select(F.regexp_extract(host, r"([^.]*)$", 1).alias("tld"), host.alias("value")), "value", ["tld"])


CLOSURE_SQL = """
WITH RECURSIVE e AS (SELECT CAST(page_id AS BIGINT) AS page, unnest([page_id * 2 + 1, page_id * 2 + 2, page_id // 2]) AS includes, unnest([1, 2, 3]) AS position FROM pages),
k AS (SELECT e.page, e.includes, lpad(CAST(position AS VARCHAR), 6, '0') AS p FROM e WHERE includes IN (SELECT page_id FROM pages)),
r AS (SELECT page AS root, includes AS page, 1 AS depth, [page, includes] AS path, p AS key FROM k WHERE page <> includes
  UNION ALL SELECT root, k.includes, depth + 1, list_append(path, k.includes), key || '/' || p FROM r JOIN k ON r.page = k.page WHERE depth < 4 AND NOT list_contains(path, k.includes)),
f AS (SELECT *, row_number() OVER (PARTITION BY root, page ORDER BY key) AS n FROM r),
g AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY key) AS m FROM f WHERE n = 1)
SELECT root, page, CAST(depth AS BIGINT) AS depth, array_to_string(path, '>') AS path FROM g WHERE m <= 40"""


@query(CLOSURE_SQL)
def page_ref_closure(spark, sf_dir):
    """Pages that include others, as a tree of ids with links back: all inclusions within four steps."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page"))
    targets = F.array(F.col("page") * 2 + 1, F.col("page") * 2 + 2, F.floor(F.col("page") / 2))
    edges = pages.select("page", F.posexplode(targets).alias("position", "includes")).withColumn("position", F.col("position") + 1)
    known = edges.join(pages.select(F.col("page").alias("__p")), F.col("includes") == F.col("__p"), "left_semi")
    return B.page_closure(known)


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS n FROM orders)
SELECT o_custkey, o_orderkey, o_totalprice FROM r WHERE n = 1""")
def best_of_n(spark, sf_dir):
    return O.best_attempt(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey")


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS place FROM orders")
def ordered_docs(spark, sf_dir):
    return O.ordered_documents(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "place")


TRIAGE = [("view", "^(?:view|page)", "benign"), ("buy", "purchase|buy|order", "bad"), ("click", "click", "benign")]


@query("""
SELECT rule, severity, CAST(count(*) AS BIGINT) AS notes FROM (SELECT
  CASE WHEN regexp_matches(event_type, '^(?:view|page)') THEN 'view' WHEN regexp_matches(event_type, 'purchase|buy|order') THEN 'buy' WHEN regexp_matches(event_type, 'click') THEN 'click' ELSE 'other' END AS rule,
  CASE WHEN regexp_matches(event_type, '^(?:view|page)') THEN 'benign' WHEN regexp_matches(event_type, 'purchase|buy|order') THEN 'bad' WHEN regexp_matches(event_type, 'click') THEN 'benign' ELSE 'info' END AS severity FROM events) GROUP BY 1, 2""")
def note_triage(spark, sf_dir):
    notes = table(spark, sf_dir, "events").select(F.col("event_type").alias("note"))
    return O.triage(notes, TRIAGE).groupBy("rule", "severity").agg(F.count("*").alias("notes"))


@query("SELECT CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars, lang, CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(string_split(coalesce(text, ''), chr(10)))) AS BIGINT) AS lines FROM documents GROUP BY lang")
def document_totals(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.sum(F.char_length(T.filled(F.col("text")))).alias("chars"), F.count("*").alias("docs"), F.sum(F.size(T.lines(F.col("text")))).alias("lines"))


OPENER_SQL = rf"""
WITH v AS (SELECT lang, regexp_replace(line, '^{WS}+', '') AS t FROM (SELECT lang, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents))
SELECT lang, CASE WHEN t = '' THEN '기타' WHEN regexp_matches(t, '^[\[［【〔〈《「『]') THEN '꺾쇠로 시작' WHEN regexp_matches(t, '^[(（]') THEN '괄호로 시작'
  WHEN regexp_matches(t, '^[’'']?[0-9]{{2,4}}{WS}*[-./년]{WS}*[0-9]{{1,2}}{WS}*[-./월]') THEN '날짜로 시작' WHEN regexp_matches(t, '^[0-9]') THEN '숫자로 시작' ELSE '글자로 시작' END AS opener, count(*) AS lines
FROM v GROUP BY ALL"""


@query(OPENER_SQL)
def line_openers(spark, sf_dir):
    """How the lines of all documents open, counted by language."""
    rows = table(spark, sf_dir, "documents").select("lang", F.explode(T.lines(F.col("text"))).alias("line"))
    return rows.groupBy("lang", D.opener_class(F.col("line")).alias("opener")).agg(F.count("*").alias("lines"))


PAGE_RUNS_SQL = rf"""
WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '<b>([^<]*)', 1)) AS t, unnest(range(1, len(regexp_extract_all(html, '<b>([^<]*)', 1)) + 1)) AS n FROM pages),
a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2)) AS t,
  unnest(range(1, len(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>')) + 1)) AS n FROM pages)
SELECT page_id, 'bold' AS style, n AS number, {decoded("t")} AS text, '**' || regexp_replace({decoded("t")}, '([\\*_`])', '\\\1', 'g') || '**' AS markdown FROM b
UNION ALL SELECT page_id, 'link', n, {decoded("t")}, '[' || regexp_replace({decoded("t")}, '([\\*_`])', '\\\1', 'g') || '](' || href || ')' FROM a"""


@query(PAGE_RUNS_SQL)
def page_runs(spark, sf_dir):
    """Bold runs and links of each page in order, as text and as Markdown."""
    blocks = H.read_blocks(table(spark, sf_dir, "pages"), "page_id", "html")
    runs = blocks.select("page_id", "ord", F.posexplode("runs").alias("at", "run")).where("run.bold or run.href is not null")
    style = F.when(F.col("run.bold"), "bold").otherwise("link")
    number = F.row_number().over(Window.partitionBy("page_id", "style").orderBy("ord", "at")).cast("long")
    return runs.withColumn("style", style).select("page_id", "style", number.alias("number"), F.col("run.text").alias("text"), R.inline_markdown(F.array("run")).alias("markdown"))


PART_RUNS_SQL = """
SELECT p_partkey, '**' || p_brand || '** 가격 *' || CASE WHEN w < 1000 THEN w::VARCHAR ELSE (w // 1000)::VARCHAR || ',' || lpad((w % 1000)::VARCHAR, 3, '0') END || '원* 및 `' || w || '원` [' || p_name || '](p/' || p_partkey || ')' AS markdown,
  p_brand || ' 값 ' || w || '원 및 ' || w || '원 ' || p_name AS carried, len(p_brand) AS bold_chars, len(' 값 ') AS between_chars
FROM (SELECT *, CAST(floor(p_retailprice) AS BIGINT) AS w FROM part)"""


@query(PART_RUNS_SQL)
def part_runs(spark, sf_dir):
    """A styled line for each part: read from Markdown, notation mended within its runs, written again; and a word
    replaced in the plain text with the styles carried over."""
    part = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", F.floor("p_retailprice").cast("string").alias("w")), "p_partkey")
    line = F.concat(F.lit("__"), "p_brand", F.lit("__ 가격 *"), "w", F.lit("원* 및 `"), "w", F.lit("원` ["), "p_name", F.lit("](p/"), F.col("p_partkey").cast("string"), F.lit(")"))
    read = X.with_runs(part.withColumn("line", line), "line")
    carried = R.carried(F.col("runs"), F.replace(R.plain(F.col("runs")), F.lit("가격"), F.lit("값")))
    sizes = [F.char_length(F.col("c")[k]["text"]).cast("long") for k in (0, 1)]
    return read.withColumn("c", carried).select("p_partkey", R.inline_markdown(R.rewritten(F.col("runs"), K.notation)).alias("markdown"), R.plain(F.col("c")).alias("carried"), sizes[0].alias("bold_chars"), sizes[1].alias("between_chars"))


FLOW_PAGE, FLOW_WIDTH, FLOW_LINE = 3_000_000, 2_000_000, 152_400
FLOW_SQL = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, ord, CASE WHEN line = '' THEN 'blank' WHEN contains(line, '|') THEN 'table' ELSE 'paragraph' END AS kind,
    {FLOW_LINE} * greatest(1, CAST(ceil(length(line) * 69850.0 / {FLOW_WIDTH}) AS BIGINT)) * CASE WHEN contains(line, '|') THEN 2 ELSE 1 END AS h FROM ({LINES})),
flow AS (
  SELECT doc_id, ord, kind, h, 0::BIGINT AS y, h AS after, false AS moved FROM l WHERE ord = 1
  UNION ALL
  SELECT doc_id, ord, kind, h, top AS y, top + h, top > after FROM (
    SELECT l.doc_id, l.ord, l.kind, l.h, f.after,
      CASE WHEN l.kind = 'table' AND l.h <= {FLOW_PAGE} AND f.after + l.h > (f.after // {FLOW_PAGE} + 1) * {FLOW_PAGE} THEN (f.after // {FLOW_PAGE} + 1) * {FLOW_PAGE} ELSE f.after END AS top
    FROM flow f JOIN l ON l.doc_id = f.doc_id AND l.ord = f.ord + 1))
SELECT doc_id, ord, y, y // {FLOW_PAGE} AS page, h AS height, moved FROM flow"""


def flow_blocks(spark, sf_dir):
    """The lines of documents as blocks: those with a bar are tables of two rows, empty ones blanks, others paragraphs."""
    rows = lines_of(spark, sf_dir)
    lines = F.greatest(F.ceil(F.char_length("line") * F.lit(69850.0) / FLOW_WIDTH), F.lit(1))
    table_line = F.col("line").contains("|")
    return rows.select("doc_id", "ord", F.when(F.col("line") == "", "blank").when(table_line, "table").otherwise("paragraph").alias("kind"), (lines * FLOW_LINE * F.when(table_line, 2).otherwise(1)).alias("lines_height"), F.lit(0).alias("fixed"))


@query(FLOW_SQL)
def page_flow(spark, sf_dir):
    """Page and position of each line of the documents; lines with bars stay whole on a page."""
    return FL.page_flow(flow_blocks(spark, sf_dir), FLOW_PAGE).select("doc_id", "ord", "y", "page", "height", "moved")


@query(f"SELECT page, CAST(count(*) AS BIGINT) AS blocks, CAST(count(*) FILTER (WHERE moved) AS BIGINT) AS moved, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs FROM ({FLOW_SQL}) GROUP BY page")
def page_flow_totals(spark, sf_dir):
    """Blocks, tables that moved, and documents on each page number."""
    return page_flow(spark, sf_dir).groupBy("page").agg(F.count("*").alias("blocks"), F.count_if("moved").alias("moved"), F.count_distinct("doc_id").alias("docs"))


FIT = TF.Rules(sizes=(152_400, 127_000, 101_600), scales=(1.0, 0.9), margins=(60_000, 30_000), pages=(1.0, 1.4), most_lines=3)


def fit_cells(spark, sf_dir):
    """A table for each size of parts: name, type and a remark of one to six names, under a header; the room grows with
    the size."""
    remark = F.array_join(F.array_repeat("p_name", (1 + F.col("p_partkey") % 6).cast("int")), " ")
    rows = dealt(table(spark, sf_dir, "part").select("p_size", "p_partkey", "p_name", "p_type"), "p_partkey")
    part = rows.select(F.col("p_size").cast("long").alias("table_id"), (F.col("p_partkey") + 1).alias("row_idx"), F.posexplode(F.array("p_name", "p_type", remark)).alias("cell_idx", "text"), F.lit(False).alias("is_header"))
    head = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("table_id")).distinct().select("table_id", F.lit(0).cast("long").alias("row_idx"), F.posexplode(F.array(F.lit("name"), F.lit("type"), F.lit("remarks of clerks"))).alias("cell_idx", "text"), F.lit(True).alias("is_header"))
    return part.unionByName(head).withColumns({"grid_col": F.col("cell_idx"), "colspan": F.lit(1), "align": F.lit(None).cast("string"), "available": F.lit(1_200_000) + F.col("table_id") * 60_000})


def wrap_sql(text: str, half: str, most: str) -> str:
    """Lines of a text of narrow letters within a width."""
    state = lambda n, used, word: f"{{'n': {n}, 'used': {used}, 'word': {word}}}"
    zero, grown = "0.0::DOUBLE", f"s.word + {half}"
    broken = "CASE WHEN s.used > 0 THEN s.n + 1 ELSE s.n END"
    return f"""list_reduce(string_split({text}, ''), lambda s, c: CASE
    WHEN c = ' ' AND s.used + {grown} > {most} THEN {state("s.n + 1", zero, zero)} WHEN c = ' ' THEN {state("s.n", f"s.used + {grown}", zero)}
    WHEN s.used + {grown} > {most} AND {grown} > {most} THEN {state(f"{broken} + CAST(floor(({grown}) / {most}) AS INT)", zero, f"({grown}) % {most}")}
    WHEN s.used + {grown} > {most} THEN {state(broken, zero, grown)} ELSE {state("s.n", "s.used", grown)} END, {state(1, zero, zero)}).n"""


def fit_sql() -> str:
    points = ", ".join(f"({i}, {p}, {s}, {c}::DOUBLE, {m}, {FIT.pages[p]}::DOUBLE)" for i, (p, s, c, m) in enumerate(FIT.points()))
    last = len(FIT.points()) // 2 - 1
    level = lambda total: f"""(SELECT CASE WHEN i = 1 THEN b[1] ELSE b[i - 1] + (b[i] - b[i - 1]) * coalesce((usable - {total('b[i - 1]')}) / nullif({total('b[i]')} - {total('b[i - 1]')}, 0), 0) END
      FROM (SELECT bends AS b, list_position(list_transform(bends, lambda v: {total('v')} >= usable), true) AS i))"""  # noqa: E731
    raised = lambda v: f"list_sum(list_transform(wished, lambda w: greatest(w, {v})))"
    cut = lambda v: f"list_sum(list_transform(range(1, 4), lambda k: greatest(least[k], least(wished[k], {v}))))"
    return f"""
WITH cells AS (
  SELECT p_size::BIGINT AS t, p_partkey + 1 AS r, unnest([0, 1, 2]) AS k, unnest([p_name, p_type, array_to_string(list_transform(range(1 + p_partkey % 6), lambda i: p_name), ' ')]) AS x FROM part),
word AS (SELECT *, list_max(list_transform(string_split(x, ' '), lambda w: len(w))) * 0.5 AS word FROM cells),
cols AS (SELECT t, k, max(word) AS least, max(len(x)) * 0.5 AS wished FROM (SELECT t, k, word, x FROM word UNION ALL SELECT DISTINCT t, k, CASE k WHEN 2 THEN 3.5 ELSE 2.0 END, CASE k WHEN 2 THEN 'remarks' ELSE 'name' END FROM cells) GROUP BY t, k),
tabs AS (SELECT t, 1200000 + 60000 * t AS room, list(least ORDER BY k) AS l, list(greatest(wished, least) ORDER BY k) AS w FROM cols GROUP BY t),
pts AS (
  SELECT t, room, idx, page, size, scale, margin, floor(room * wide) - 6 * margin AS usable, list_transform(l, lambda v: v * (size * scale)) AS least, list_transform(w, lambda v: v * (size * scale)) AS wished
  FROM tabs, (VALUES {points}) AS p(idx, page, size, scale, margin, wide)),
bent AS (SELECT *, list_sort(list_distinct(CASE WHEN list_sum(wished) <= usable THEN [0.0, usable] || wished ELSE [0.0] || least || wished END)) AS bends FROM pts WHERE list_sum(least) <= usable),
levels AS (SELECT *, list_sum(wished) <= usable AS wide, CASE WHEN list_sum(wished) <= usable THEN {level(raised)} ELSE {level(cut)} END AS lv FROM bent),
sized AS (SELECT *, list_transform(range(1, 4), lambda k: CASE WHEN wide THEN greatest(wished[k], lv) ELSE greatest(least[k], least(wished[k], lv)) END) AS widths FROM levels),
worst AS (SELECT z.t, z.idx, max({wrap_sql('c.x', '(0.5 * (size * scale))', 'z.widths[c.k + 1]')}) AS lines FROM sized z JOIN cells c ON c.t = z.t GROUP BY z.t, z.idx),
pick AS (SELECT t, coalesce(min(idx) FILTER (WHERE lines <= 3), min(idx) FILTER (WHERE idx IN ({last}, {2 * last + 1}))) AS point FROM worst GROUP BY t),
best AS (SELECT z.*, list_transform(widths, lambda w: CAST(round_even(w, 0) AS BIGINT) + 2 * margin) AS v FROM pick JOIN sized z ON z.t = pick.t AND z.idx = pick.point),
fill AS (SELECT *, page = 0 AND list_sum(v) < room AS fills, list_transform(v, lambda w: CAST(floor(w * room / list_sum(v)) AS BIGINT)) AS f FROM best)
SELECT t AS table_id, page, size, scale, margin, idx AS point, array_to_string(CASE WHEN fills THEN [f[1], f[2], CAST(f[3] + room - list_sum(f) AS BIGINT)] ELSE v END, ' ') AS widths FROM fill"""


@query(fit_sql())
def table_fit(spark, sf_dir):
    """The first layout that holds for a table of each size of parts, with its widths."""
    layouts, _ = TF.fit_tables(fit_cells(spark, sf_dir), FIT)
    return layouts.select("table_id", "page", "size", "scale", "margin", "point", F.array_join(F.col("widths").cast("array<string>"), " ").alias("widths"))


SPLICED_SQL = f"""
WITH b AS (
  SELECT CAST(page_id AS BIGINT) AS page, unnest([1, 2, 3, 4, 5, 6]) AS ord, unnest(['title', 'include', 'paragraph', 'include', 'include', 'include']) AS kind,
    unnest([url, NULL, 'page ' || page_id, NULL, NULL, NULL]) AS text, unnest([NULL, page_id * 2 + 1, NULL, page_id * 2 + 2, page_id // 2, page_id + 1000000]) AS target FROM pages),
n AS (SELECT DISTINCT page FROM b),
e AS (SELECT page, target AS includes, lpad(CAST(ord AS VARCHAR), 6, '0') AS p FROM b WHERE kind = 'include' AND target IN (SELECT page FROM n)),
r AS (
  WITH RECURSIVE r AS (SELECT page AS root, includes AS page, 1 AS depth, [page, includes] AS path, p AS key FROM e WHERE page <> includes
    UNION ALL SELECT root, e.includes, depth + 1, list_append(path, e.includes), key || '/' || p FROM r JOIN e ON r.page = e.page WHERE depth < 3 AND NOT list_contains(path, e.includes))
  SELECT * FROM r),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root, page ORDER BY key) AS k FROM r) WHERE k = 1),
i AS (SELECT root, page, depth, path, key FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY key) AS m FROM f) WHERE m <= 9 UNION ALL SELECT page, page, 0, [page], '' FROM n),
o AS (SELECT i.root, i.page, i.depth, i.path, b.kind, b.text, b.target, CASE WHEN key = '' THEN '' ELSE key || '/' END || lpad(CAST(ord AS VARCHAR), 6, '0') AS at_ FROM i JOIN b ON b.page = i.page),
x AS (
  SELECT root, at_, page, depth, kind, text, NULL::BIGINT AS target FROM o WHERE kind = 'paragraph' OR (kind = 'title' AND depth = 0)
  UNION ALL SELECT root, at_, page, depth, 'note', CASE WHEN target NOT IN (SELECT page FROM n) THEN 'missing' WHEN list_contains(path, target) THEN 'cycle'
    WHEN EXISTS (SELECT 1 FROM i WHERE i.root = o.root AND i.page = o.target) THEN 'again' WHEN depth >= 3 THEN 'depth' ELSE 'most' END, target
    FROM o WHERE kind = 'include' AND NOT EXISTS (SELECT 1 FROM i WHERE i.root = o.root AND i.key = o.at_ AND i.depth > 0)
  UNION ALL SELECT root, key, page, depth, 'page_break', NULL, NULL FROM i WHERE depth > 0
  UNION ALL SELECT root, key || '/', i.page, depth, 'heading', url, NULL FROM i JOIN pages ON page_id = i.page WHERE depth > 0)
SELECT root, row_number() OVER (PARTITION BY root ORDER BY at_) AS position, page, CAST(depth AS BIGINT) AS depth, kind, text, target FROM x"""


@query(SPLICED_SQL)
def pages_spliced(spark, sf_dir):
    """Pages that include others by rules on their ids, each with the others put in place, three deep and nine at most."""
    parts = [("title", F.col("url"), None), ("include", None, F.col("page") * 2 + 1), ("paragraph", F.concat(F.lit("page "), F.col("page").cast("string")), None), ("include", None, F.col("page") * 2 + 2), ("include", None, F.floor(F.col("page") / 2)), ("include", None, F.col("page") + 1_000_000)]
    null = lambda c, kind: (F.lit(None) if c is None else c).cast(kind)
    each = F.posexplode(F.array(*[F.struct(F.lit(k).alias("kind"), null(t, "string").alias("text"), null(to, "long").alias("target")) for k, t, to in parts])).alias("ord", "b")
    blocks = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page"), "url").select("page", each).select("page", (F.col("ord") + 1).alias("ord"), "b.*")
    return B.spliced_pages(blocks, 3, 9)


ORDER_LINES = "SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord, CASE WHEN o_orderstatus = 'F' THEN repeat(' ', o_orderkey % 3) ELSE o_orderpriority END AS line FROM orders"


@query(RUNS_SQL.replace(LINES, ORDER_LINES).replace("doc_id", "o_custkey"))
def blank_runs_of_orders(spark, sf_dir):
    """Runs of blank lines in lists of each customer's orders, where filled orders are blank."""
    line = F.when(F.col("o_orderstatus") == "F", F.repeat(F.lit(" "), (F.col("o_orderkey") % 3).cast("int"))).otherwise(F.col("o_orderpriority"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("ord"), line.alias("line"))
    return S.blank_runs(rows, "o_custkey")


TOKENS_SQL = "list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{4,}'), lambda w: lower(w)))"


@query(f"""
WITH t AS (SELECT conv_id, turn, role, {TOKENS_SQL} AS w FROM conversations),
a AS (SELECT DISTINCT conv_id, turn AS answer FROM t WHERE role = 'assistant'),
p AS (SELECT x.conv_id, x.turn AS answer, y.turn AS question, len(list_intersect(x.w, y.w)) AS overlap FROM t x JOIN t y ON x.conv_id = y.conv_id WHERE x.role = 'assistant' AND y.role = 'user' AND len(list_intersect(x.w, y.w)) >= 2),
b AS (SELECT conv_id, answer, max(overlap) AS overlap FROM p GROUP BY 1, 2),
n AS (SELECT p.conv_id, p.answer, count(*) AS n, min(question) AS question FROM p JOIN b ON p.conv_id = b.conv_id AND p.answer = b.answer AND p.overlap = b.overlap GROUP BY 1, 2)
SELECT a.conv_id, a.answer, CASE WHEN n = 1 THEN question END AS question, CAST(coalesce(b.overlap, 0) AS BIGINT) AS overlap FROM a LEFT JOIN b USING (conv_id, answer) LEFT JOIN n USING (conv_id, answer)""")
def answers_assigned(spark, sf_dir):
    """Each answer of a conversation with the question that shares most words with it; ties and weak ones with none."""
    tokens = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]{4,}"), F.lit(0)), F.lower)
    turns = table(spark, sf_dir, "conversations").withColumn("tokens", tokens)
    answers = turns.where("role = 'assistant'").withColumnRenamed("turn", "answer")
    return DR.best_overlap(answers, turns.where("role = 'user'").withColumnRenamed("turn", "question"), ["conv_id"], "answer", "question", least=2)


DRAFTS = (
    # line, source, action, text, problems that stay
    ("{k}번 주문 상자 {a}개", "{k}번 주문은 상자 {a}개입니다.", "kept", "{k}번 주문 상자 {a}개", ""), ("{k}번 주문 상자 {b}개", "{k}번 주문의 상자 {a}개를 점검하였습니다.", "restored", "{k}번 주문의 상자 {a}개 점검", ""),
    ("{k}번 주문의 상자를 옮겼습니다", "{k}번 주문의 상자를 옮겼습니다.", "fixed", "{k}번 주문의 상자를 옮겼음", ""), ("{k}번 주문 배송비 {b}억원", None, "dropped", None, "money,number"), (None, "{k}번 주문", "kept", "", ""),
)


def drafts_sql() -> str:
    names = cases.NAMES["orders"]
    pick = lambda i: f"CASE o_orderkey % {len(DRAFTS)} " + " ".join(f"WHEN {j} THEN {cases.spelled(d[i], names)}" for j, d in enumerate(DRAFTS)) + " END"
    return f"SELECT o_orderkey, {pick(2)} AS action, {pick(3)} AS text, {pick(4)} AS problems FROM orders"


@query(drafts_sql())
def drafts_mended(spark, sf_dir):
    """Lines of drafts about orders against their sources: kept, mended by rule, restored or dropped."""
    names = cases.NAMES["orders"]
    pick = lambda i, name: F.expr(f"CASE o_orderkey % {len(DRAFTS)} " + " ".join(f"WHEN {j} THEN {cases.spelled(d[i], names)}" for j, d in enumerate(DRAFTS)) + " END").alias(name)
    lines = dealt(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", F.lit(1).alias("line_no"), pick(0, "text"), pick(1, "source"))
    return DR.mended(lines, ["o_orderkey"], 2026).select("o_orderkey", "action", "text", F.array_join("problems", ",").alias("problems"))


LINE_RULES = LF.LineRules(size=152_400, first=2_000_000, later=1_700_000, closer=12_700, cut_behind=",")
LINE_FIT_SQL = """
WITH RECURSIVE p AS (SELECT p_partkey, array_to_string(list_transform(range(1 + p_partkey % 9), lambda i: p_name), ', ') AS t FROM part),
e AS (SELECT *, len(t) AS n, list_filter(range(1, len(t) + 1), lambda i: i = len(t) OR t[i + 1] = ' ') AS ends FROM p),
step AS (
  SELECT p_partkey, t, n, ends, 0::BIGINT AS line_no, 0::BIGINT AS start, 0::BIGINT AS stop, 0::BIGINT AS steps FROM e
  UNION ALL
  SELECT p_partkey, t, n, ends, line_no + 1, pos, stop, CASE WHEN stop = best THEN greatest(0, CAST(ceil(((stop - pos) * 76200.0 - room) / (stop - pos) / 1270 - 1e-9) AS BIGINT)) ELSE 0 END FROM (
    SELECT *, CASE WHEN best IS NULL THEN least(n, pos + greatest(1, CAST(floor(room / 76200) AS BIGINT))) WHEN comma < best AND best < n AND comma - pos >= 0.5 * (best - pos) THEN comma ELSE best END AS stop FROM (
      SELECT *, list_max(list_filter(ends, lambda i: i > pos AND (i - pos) * 76200.0 - room <= 12700 * (i - pos))) AS best,
        list_max(list_filter(ends, lambda i: i > pos AND (i - pos) * 76200.0 <= room AND t[i] = ',')) AS comma FROM (
        SELECT p_partkey, t, n, ends, line_no, stop + CASE WHEN t[stop + 1] = ' ' THEN 1 ELSE 0 END AS pos, CASE WHEN line_no = 0 THEN 2000000.0 ELSE 1700000.0 END AS room FROM step WHERE stop < n))))
SELECT p_partkey, line_no, start, stop AS "end", steps FROM step WHERE line_no > 0"""


@query(LINE_FIT_SQL)
def line_fit(spark, sf_dir):
    """Lists of a part's name cut into lines: closer letters where that saves a word, cuts behind commas."""
    text = F.array_join(F.array_repeat("p_name", (1 + F.col("p_partkey") % 9).cast("int")), ", ")
    fitted = LF.with_lines(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "text", LINE_RULES)
    rows = fitted.select("p_partkey", F.posexplode("lines").alias("n", "line"))
    return rows.select("p_partkey", (F.col("n") + 1).cast("long").alias("line_no"), F.col("line.start").cast("long").alias("start"), F.col("line.end").cast("long").alias("end"), F.col("line.steps").cast("long").alias("steps"))


PROFILES_SQL = """
WITH RECURSIVE p AS (SELECT c_custkey AS name, CASE WHEN c_custkey = 0 THEN NULL WHEN c_custkey % 100 = 7 THEN c_custkey + 1 WHEN c_custkey % 100 = 8 THEN c_custkey - 1 WHEN c_custkey % 100 = 9 THEN -1 ELSE c_custkey // 3 END AS extends, c_nationkey FROM customer),
c AS (
  SELECT name, name AS ancestor, 0 AS depth, [name] AS path, NULL::VARCHAR AS problem FROM p
  UNION ALL
  SELECT c.name, p.extends, depth + 1, list_append(path, p.extends), CASE WHEN list_contains(path, p.extends) THEN 'cycle' WHEN p.extends NOT IN (SELECT c_custkey FROM customer) THEN 'missing' END
  FROM c JOIN p ON p.name = c.ancestor WHERE problem IS NULL AND p.extends IS NOT NULL),
bad AS (SELECT name, max(problem) AS problem FROM c WHERE problem IS NOT NULL GROUP BY name),
said AS (
  SELECT c.name, depth, unnest(['page.width', 'page.margin', 'fonts.n' || c_nationkey % 4, 'levels']) AS path, unnest([CAST(ancestor AS VARCHAR), CASE WHEN ancestor % 2 = 0 THEN CAST(ancestor % 50 AS VARCHAR) END, '"' || c_nationkey || '"', CASE WHEN ancestor % 5 = 0 THEN '[' || ancestor || ', 1]' END]) AS value
  FROM c JOIN p ON p.name = c.ancestor WHERE c.name NOT IN (SELECT name FROM bad))
SELECT name, path, min_by(value, depth) AS value, NULL AS problem FROM said WHERE value IS NOT NULL GROUP BY name, path
UNION ALL SELECT name, NULL, NULL, problem FROM bad"""


@query(PROFILES_SQL)
def profiles_resolved(spark, sf_dir):
    """Profiles that extend each other by rules on customers' keys, with some cycles and missing ones, resolved as rows."""
    key, text = F.col("c_custkey"), lambda c: c.cast("string")
    extends = F.when(key == 0, None).when(key % 100 == 7, key + 1).when(key % 100 == 8, key - 1).when(key % 100 == 9, -1).otherwise(F.floor(key / 3))
    margin = F.when(key % 2 == 0, F.concat(F.lit(', "margin": '), text(key % 50))).otherwise("")
    levels = F.when(key % 5 == 0, F.concat(F.lit(', "levels": ['), text(key), F.lit(", 1]"))).otherwise("")
    body = F.concat(F.lit('{"page": {"width": '), text(key), margin, F.lit('}, "fonts": {"n'), text(F.col("c_nationkey") % 4), F.lit('": "'), text(F.col("c_nationkey")), F.lit('"}'), levels, F.lit("}"))
    return PF.profile_rows(table(spark, sf_dir, "customer").select(key.alias("name"), extends.cast("long").alias("extends"), body.alias("body")))
