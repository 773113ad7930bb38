"""Registry of the engine's own queries and their SQL twins.

Rules are chosen for the tables at hand; Chinese texts come from small fixtures. Every query runs
over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import completeness as C
from .operators import detect as D
from .operators import evaluate as E
from .operators import incremental, prompts, report, scoring, segment, similarity
from .plans.rubric import Completeness, Detection, Dimension, Scale, Section, Similarity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; dealt out if they come in fewer parts than there are cores, as one small file does."""
    found, cores = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.sparkContext.defaultParallelism
    return found.repartition(cores) if found.rdd.getNumPartitions() < cores else found


def lit(x) -> str:
    """A value as an SQL literal."""
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(lit, x)) + "]"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def values(name: str, schema: str, rows: list[tuple]) -> str:
    columns = [c.strip().split(" ")[0] for c in schema.split(", ")]
    return f"{name}({', '.join(columns)}) AS (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)})"


#: The beginning of a document's text, as something of the data in what the queries below take apart.
HEAD = "left(coalesce(text, ''), 60)"


def drawn(templates: list[tuple], by: str, value: str, table: str = "documents", name: str = "t") -> str:
    """SQL: (id, `name`) of each row of a table, the template that its number `by` falls on, with `value` for each §."""
    return f"f AS (SELECT {by} AS id, replace({lit([t[-1] for t in templates])}[CAST({by} % {len(templates)} AS INT) + 1], '§', {value}) AS {name} FROM {table})"


def draw(rows: DataFrame, templates: list[tuple], by: str, value: Column, name: str = "t") -> DataFrame:
    """The same in Spark."""
    one = F.get(F.array(*[F.lit(t[-1]) for t in templates]), F.pmod(F.col(by), F.lit(len(templates))).cast("int"))
    return rows.select(F.col(by).alias("id"), F.replace(one, F.lit("§"), value).alias(name))


def head() -> Column:
    return F.left(F.coalesce("text", F.lit("")), F.lit(60))


# Parts of the SQL twins
W = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{W}+|{W}+\z', '', 'g')"


def count(x: str, pattern: str, flags: str = "") -> str:
    p = pattern.replace("'", "''")
    return f"CAST(len(regexp_extract_all({x}, '{flags}{p}')) AS BIGINT)"


FILLED = f"list_filter(string_split(t, chr(10)), lambda x: {strip('x')} <> '')"
CLEAN = f"list_filter(list_transform(string_split(t, chr(10)), lambda x: {strip('x')}), lambda x: x <> '')"
WORDS = f"({count('t', T.HAN)} + {count('t', '[a-zA-Z]+')})"
DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
fix = lambda x, n: f"floor(({x}) * {10**n} + 0.5) / {10**n}"

# Features


@query(
    f"""WITH {DOCS} SELECT doc_id, {WORDS} AS words, CAST(len({FILLED}) AS BIGINT) AS paragraphs, md5(array_to_string({CLEAN}, chr(10))) AS clean_md5,
    coalesce(list_filter({FILLED}, lambda x: length(x) < 100 AND NOT regexp_matches(x, '(?i)^(?:{T.TITLE_LABEL})'))[1], '{T.NO_TITLE}') AS title FROM d"""
)
def doc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return docs(spark, sf_dir).select("doc_id", T.word_count(t).alias("words"), T.paragraph_count(t).alias("paragraphs"), F.md5(T.clean_text(t)).alias("clean_md5"), T.title(T.filled_lines(t)).alias("title"))


NAMES = [("cs_se_class1_2021000§_张三.docx",), ("2021000§_李四.pdf",), ("王五_论文题目.doc",), ("赵六.docx",), ("a-12345-bob.docx",), ("/in/x_2021000333.pdf",), ("20210004_9_x.docx",), ("20210001_20210005_陈 七_孙八.docx",), ("1_2_3.pdf",), ("noext",), ("archive.tar.gz",)]


@query(
    f"""WITH {drawn(NAMES, 'doc_id', 'CAST(doc_id AS VARCHAR)', name='name')}, s AS (SELECT name, regexp_extract(name, '([^/]*)/*$', 1) AS base FROM f),
    p AS (SELECT name, coalesce(nullif(regexp_extract(base, '^(.+)\\.[^.]+$', 1), ''), base) AS stem FROM s),
    q AS (SELECT name, stem, list_filter(regexp_split_to_array(stem, '(?:[_-]|{W})+'), lambda x: x <> '') AS parts FROM p),
    r AS (SELECT *, list_filter(range(1, len(parts) + 1), lambda i: regexp_matches(parts[i], '^\\d+$') AND length(parts[i]) >= 6) AS ids,
                 list_filter(range(1, len(parts) + 1), lambda i: NOT regexp_matches(parts[i], '^\\d+$') AND length(parts[i]) >= 2) AS names FROM q)
    SELECT name, CASE WHEN len(ids) > 0 THEN parts[ids[len(ids)]] || '-' || coalesce(parts[list_filter(names, lambda i: i > ids[len(ids)])[1]], parts[len(parts)])
                      ELSE coalesce(parts[names[1]], stem) END AS author FROM r"""
)
def author_key_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw(docs(spark, sf_dir), NAMES, "doc_id", F.col("doc_id").cast("string"), "name").select("name", T.author_key(F.col("name")).alias("author"))


REFERENCES = [(1, "[1] §\n[2] b [12]"), (2, "§\n\n  \nb\n"), (3, ""), (4, None), (5, "　\n[x]\nabc"), (6, "[1][2][3]")]


@query(
    f"""WITH {drawn(REFERENCES, 'doc_id', HEAD)} SELECT id, CASE WHEN coalesce(t, '') = '' THEN 0 WHEN len(regexp_extract_all(t, '\\[\\d+\\]')) > 0 THEN CAST(len(regexp_extract_all(t, '\\[\\d+\\]')) AS BIGINT)
    ELSE CAST(len({FILLED}) AS BIGINT) END AS n FROM f"""
)
def reference_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw(docs(spark, sf_dir), REFERENCES, "doc_id", head()).select("id", T.reference_count(F.col("t")).alias("n"))


COMMENTS = [(1, "[第1章] §\n[第2章] bad\r\n[全文] fine"), (2, ""), (3, None), (4, "plain [x] §")]


@query(f"""WITH {drawn(COMMENTS, 'doc_id', HEAD)} SELECT id, {strip("regexp_replace(replace(replace(t, chr(10), ' '), chr(13), ''), '(\\[[第全])', chr(10) || '\\1', 'g')")} AS comment FROM f""")
def comment_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw(docs(spark, sf_dir), COMMENTS, "doc_id", head()).select("id", T.comment(F.col("t")).alias("comment"))


@query("SELECT doc_id, md5(CASE WHEN length(text) > 3000 THEN left(text, 3000) || '...' ELSE text END) AS short_md5, least(length(text), 15000) AS kept FROM documents")
def prompt_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(T.shortened(F.col("text"), 3000, "...")).alias("short_md5"), F.least(F.length("text").cast("long"), F.lit(15000)).alias("kept"))


# Sections, with headings that the tables have
HEADS = {"abstract": "The", "introduction": "Licensed", "body": "Of|And", "conclusion": "Released"}
CASES = " ".join(f"WHEN regexp_matches(x, '(?i)^(?:{p})') THEN '{c}'" for c, p in HEADS.items())
RUNS = f"""d AS (SELECT doc_id, {CLEAN} AS l FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
    e AS (SELECT doc_id, i, l[i] AS x FROM d, unnest(range(1, len(l) + 1)) AS u(i)),
    h AS (SELECT doc_id, i, x, CASE {CASES} END AS c FROM e),
    r AS (SELECT *, sum(CASE WHEN c IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM h),
    g AS (SELECT doc_id, run, coalesce(max(c), 'header') AS cls, string_agg(x, chr(10) ORDER BY i) FILTER (WHERE c IS NULL) AS content FROM r GROUP BY doc_id, run)"""


@query(f"WITH {RUNS} SELECT doc_id, cls, length(content) AS length, md5(content) AS content_md5 FROM g WHERE content IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, cls ORDER BY run DESC) = 1")
def section_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment.sections(docs(spark, sf_dir), headings=HEADS)
    return found.select("doc_id", "cls", F.length("content").cast("long").alias("length"), F.md5("content").alias("content_md5"))


@query(f"WITH {RUNS} SELECT doc_id, CAST(count(*) AS BIGINT) AS runs, CAST(count(*) FILTER (WHERE cls = 'body') AS BIGINT) AS bodies FROM g WHERE content IS NOT NULL GROUP BY doc_id")
def section_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = docs(spark, sf_dir).select("doc_id", segment.runs(F.coalesce("text", F.lit("")), HEADS).alias("r"))
    return cut.where(F.size("r") > 0).select("doc_id", F.size("r").cast("long").alias("runs"), F.size(F.filter("r", lambda x: x["cls"] == "body")).cast("long").alias("bodies"))


@query(
    f"""WITH c AS (SELECT conv_id, turn, {strip("coalesce(text, '')")} AS x FROM conversations), h AS (SELECT *, CASE {CASES} END AS k FROM c)
    SELECT conv_id, turn, coalesce(last_value(k IGNORE NULLS) OVER w, 'header') AS section,
    md5(CASE WHEN x <> '' THEN left(x, 200) WHEN length(lead(x) OVER w) BETWEEN 1 AND 199 THEN lead(x) OVER w ELSE coalesce(last_value(k IGNORE NULLS) OVER w, 'header') END) AS caption_md5
    FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""
)
def carry_forward_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment.carried(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "text", HEADS)
    return rows.select("conv_id", "turn", "section", F.md5("caption").alias("caption_md5"))


# Completeness
RULES = Completeness(
    sections=(Section("license", ("licen[sc]e", "GNU"), 4), Section("secret", ('token = "', "@"), 5), Section("number", ("[0-9]{3}",), 3), Section("article", (" the ", " der ", " las? "), 8)),
    sections_weight=40.0,
    min_words=250,
    words_weight=25.0,
    min_references=2,
    references_weight=5.0,
    min_figures=1,
    figures_weight=15.0,
    min_paragraphs=4,
    max_long_share=0.2,
    format_weight=10.0,
)


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the features that the rules read; marked lines stand in for figures, license lines for references."""
    t = F.coalesce("text", F.lit(""))
    return docs(spark, sf_dir).select(
        "doc_id",
        t.alias("text"),
        T.word_count(t).alias("words"),
        T.paragraph_count(t).alias("paragraphs"),
        F.regexp_count(t, F.lit("(?i)licen[sc]e")).cast("long").alias("references"),
        F.regexp_count(t, F.lit(r" \| ")).cast("long").alias("figures"),
    )


def _completeness_sql() -> str:
    r = RULES
    miss = [f"CASE WHEN NOT regexp_matches(t, '{'|'.join(f'(?:{p})' for p in s.patterns)}', 'i') THEN '{s.name}' END" for s in r.sections]
    total = sum(s.weight for s in r.sections)
    lost = " - ".join(f"CASE WHEN list_contains(missing, '{s.name}') THEN {r.sections_weight * (s.weight / total)!r} ELSE 0.0 END" for s in r.sections)
    part = lambda c, least, w: f"CASE WHEN {c} >= {least} THEN {w}::DOUBLE ELSE {w}::DOUBLE * {c} / {least}::DOUBLE END"
    long = "list_filter(string_split(t, chr(10)), lambda x: length(x) > 500)"
    return f"""{DOCS}, f AS (SELECT doc_id, t, {WORDS} AS words, CAST(len({FILLED}) AS BIGINT) AS paragraphs, {count('t', 'licen[sc]e', '(?i)')} AS refs, {count('t', ' \\| ')} AS figures,
        list_filter([{', '.join(miss)}], lambda x: x IS NOT NULL) AS missing FROM d),
    c AS (SELECT *, greatest(0.0::DOUBLE, {r.sections_weight}::DOUBLE - {lost}) AS s_sections, {part('words', r.min_words, r.words_weight)} AS s_words, {part('refs', r.min_references, r.references_weight)} AS s_references,
        {part('figures', r.min_figures, r.figures_weight)} AS s_figures,
        greatest(0.0::DOUBLE, {r.format_weight}::DOUBLE - CASE WHEN paragraphs < {r.min_paragraphs} THEN {r.format_weight * 0.4}::DOUBLE ELSE 0.0::DOUBLE END
            - CASE WHEN t <> '' AND len({long})::DOUBLE / len(string_split(t, chr(10)))::DOUBLE > {r.max_long_share}::DOUBLE THEN {r.format_weight * 0.4}::DOUBLE ELSE 0.0::DOUBLE END) AS s_format FROM f),
    k AS (SELECT *, {fix(f"(s_sections + s_words + s_references + s_figures + s_format) * 100.0::DOUBLE / {r.total}::DOUBLE * (CASE WHEN len(missing) > 0 THEN greatest({r.penalty_floor}::DOUBLE, 1 - len(missing)::DOUBLE * {r.penalty}::DOUBLE) ELSE 1.0::DOUBLE END)", 1)} AS score FROM c)"""


COMPLETE = _completeness_sql()


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.check(measured(spark, sf_dir), RULES)


@query(f"WITH {COMPLETE} SELECT doc_id, s_sections, array_to_string(missing, ', ') AS missing FROM k")
def completeness_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).select("doc_id", "s_sections", F.array_join("missing", ", ").alias("missing"))


@query(f"WITH {COMPLETE} SELECT doc_id, words, s_words FROM k")
def completeness_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).select("doc_id", "words", "s_words")


@query(f'WITH {COMPLETE} SELECT doc_id, refs AS "references", s_references FROM k')
def completeness_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).select("doc_id", "references", "s_references")


@query(f"WITH {COMPLETE} SELECT doc_id, figures, s_figures FROM k")
def completeness_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).select("doc_id", "figures", "s_figures")


@query(f"WITH {COMPLETE} SELECT doc_id, paragraphs, s_format FROM k")
def completeness_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).select("doc_id", "paragraphs", "s_format")


@query(f"WITH {COMPLETE} SELECT doc_id, score, score >= 60 AND len(missing) <= 2 AS is_complete, CAST(len(missing) AS BIGINT) AS n_missing FROM k")
def completeness_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).select("doc_id", "score", "is_complete", F.size("missing").cast("long").alias("n_missing"))


@query(f"WITH {COMPLETE}, m AS (SELECT unnest(missing) AS section FROM k) SELECT section, count(*) AS documents FROM m GROUP BY section")
def missing_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).select(F.explode("missing").alias("section")).groupBy("section").agg(F.count("*").alias("documents"))


# Detection, with phrases that the tables have
SIGNS = (r" of the ", r"the [a-z]+ and", r"und der", r"licensed under", r"de la", r"que [a-z]+, ", r"([0-9]+)\.([0-9]+)", r"token = ")
FOUND = Detection(patterns=SIGNS)
ALL = D.PHRASES + SIGNS


def _hits(p: str) -> str:
    return count("t", p, "(?i)")


@query(f"WITH {DOCS}, n AS (SELECT doc_id, unnest([{', '.join(_hits(p) for p in ALL)}]) AS hits, unnest(range(0, {len(ALL)})) AS pattern_no FROM d) SELECT CAST(pattern_no AS BIGINT) AS pattern_no, CAST(sum(hits) AS BIGINT) AS hits, count(*) FILTER (WHERE hits > 0) AS documents FROM n GROUP BY pattern_no")
def pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = docs(spark, sf_dir).select(F.posexplode(D.pattern_counts(F.coalesce("text", F.lit("")), ALL)).alias("pattern_no", "hits"))
    return counts.groupBy(F.col("pattern_no").cast("long")).agg(F.sum("hits").cast("long").alias("hits"), F.count_if(F.col("hits") > 0).alias("documents"))


@query(
    f"""WITH {DOCS}, n AS (SELECT doc_id, t, unnest([{', '.join(f"regexp_extract_all(t, '(?i){p}')[1:3]" for p in SIGNS)}]) AS found, unnest(range(0, {len(SIGNS)})) AS pattern_no FROM d),
    m AS (SELECT doc_id, t, pattern_no, unnest(found) AS hit, unnest(range(0, len(found))) AS match_no FROM n), s AS (SELECT *, instr(t, hit) AS pos FROM m)
    SELECT doc_id, CAST(pattern_no AS BIGINT) AS pattern_no, CAST(match_no AS BIGINT) AS match_no, replace(substring(t, greatest(pos - 20, 1), pos + length(hit) + 20 - greatest(pos - 20, 1)), chr(10), ' ') AS context FROM s"""
)
def pattern_contexts_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.contexts(docs(spark, sf_dir), SIGNS).select("doc_id", F.col("pattern_no").cast("long"), F.col("match_no").cast("long"), "context")


FORMATS = f"{count('t', chr(92) + 'n{3,}')} AS blank_runs, {count('t', D.MIXED)} AS mixed, {count('t', D.INVISIBLE)} AS invisible"
ISSUES = "CAST((blank_runs > 10)::INT + (mixed > 5)::INT + (invisible > 0)::INT AS BIGINT)"


@query(f"WITH {DOCS}, f AS (SELECT doc_id, {FORMATS} FROM d) SELECT *, {ISSUES} AS issues FROM f")
def format_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = D.format_counts(F.coalesce("text", F.lit("")))
    rows = docs(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in counts.items()])
    return rows.withColumn("issues", D.format_issues({n: F.col(n) for n in counts}))


LENGTHS = f"list_transform(list_filter(list_transform(regexp_split_to_array(t, '{D.ENDS}'), lambda x: {strip('x')}), lambda x: x <> ''), lambda x: length(x))"
UNIFORM = "sentences > 5 AND sentences * squares - total * total < 50 * sentences * sentences AND total > 10 * sentences"


@query(
    f"""WITH {DOCS}, l AS (SELECT doc_id, {LENGTHS} AS l FROM d), s AS (SELECT doc_id, CAST(len(l) AS BIGINT) AS sentences, CAST(coalesce(list_sum(l), 0) AS BIGINT) AS total, CAST(coalesce(list_sum(list_transform(l, lambda x: x * x)), 0) AS BIGINT) AS squares FROM l)
    SELECT *, {UNIFORM} AS uniform FROM s"""
)
def sentence_uniformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in D.uniform(F.coalesce("text", F.lit(""))).items()])


HAN_TEXTS = [(1, "本文提出一种方法。" * 40), (2, "各不相同的句子很多很多，" * 3 + "天地玄黄宇宙洪荒日月盈昃辰宿列张" * 30), (3, "only §"), (4, ""), (5, "§首先，我们需要明确问题。综上所述，值得注意的是结果。近年来，技术得到了广泛关注。")]
CHUNKS = f"regexp_extract_all(t, '{D.CHUNK}')"


@query(f"""WITH {drawn(HAN_TEXTS, 'doc_id', HEAD)}, c AS (SELECT id, CAST(len({CHUNKS}) AS BIGINT) AS chunks, CAST(len(list_distinct({CHUNKS})) AS BIGINT) AS distinct_chunks FROM f) SELECT *, chunks > 100 AND distinct_chunks * 10 < chunks * 3 AS repetitive FROM c""")
def lexical_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = draw(docs(spark, sf_dir), HAN_TEXTS, "doc_id", head())
    return rows.select("id", *[c.alias(n) for n, c in D.repetitive(F.col("t")).items()])


@query(f"WITH {drawn(HAN_TEXTS, 'doc_id', HEAD)} SELECT id, {' + '.join(_hits(p) for p in D.PHRASES)} AS hits, {WORDS} AS words FROM f")
def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = draw(docs(spark, sf_dir), HAN_TEXTS, "doc_id", head())
    total = F.aggregate(D.pattern_counts(F.col("t"), D.PHRASES), F.lit(0), lambda a, x: a + x)
    return rows.select("id", total.cast("long").alias("hits"), T.word_count(F.col("t")).alias("words"))


RISK = f"""{DOCS}, n AS (SELECT doc_id, [{', '.join(_hits(p) for p in ALL)}] AS h, {LENGTHS} AS l, {FORMATS}, {CHUNKS} AS c FROM d),
    u AS (SELECT doc_id, CAST(list_sum(h) AS BIGINT) AS hits, list_sum(list_transform(h, lambda x: least(x, 3))) AS top, {ISSUES} AS format_issues,
          len(l) AS sentences, coalesce(list_sum(l), 0) AS total, coalesce(list_sum(list_transform(l, lambda x: x * x)), 0) AS squares, len(c) AS chunks, len(list_distinct(c)) AS dc FROM n),
    v AS (SELECT *, CAST(top + ({UNIFORM})::INT + (chunks > 100 AND dc * 10 < chunks * 3)::INT AS BIGINT) AS segments FROM u),
    w AS (SELECT *, least(CASE WHEN hits > 15 THEN 0.5::DOUBLE WHEN hits > 10 THEN 0.4::DOUBLE WHEN hits > 5 THEN 0.25::DOUBLE WHEN hits > 2 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END + format_issues * 0.15::DOUBLE + 0.0::DOUBLE + least(segments * 0.08::DOUBLE, 0.4::DOUBLE), 1.0::DOUBLE) AS probability FROM v),
    risk AS (SELECT doc_id, hits, format_issues, segments, {fix('probability', 4)} AS probability, probability >= 0.6::DOUBLE AS suspicious, CASE {' '.join(f"WHEN probability >= {p}::DOUBLE THEN '{n}'" for p, n in D.RISKS)} ELSE '{D.NO_RISK}' END AS risk FROM w)"""


@query(f"WITH {RISK} SELECT * FROM risk")
def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.detect(docs(spark, sf_dir), FOUND).withColumn("probability", T.fixed(F.col("probability"), 4))


@query(f"WITH {RISK} SELECT risk, count(*) AS documents FROM risk GROUP BY risk")
def risk_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.detect(docs(spark, sf_dir), FOUND).groupBy("risk").agg(F.count("*").alias("documents"))


#: Turns of conversations stand in for images.
ISSUE_LISTS = [["模糊", "分析失败", "x"], ["模糊", "偏色", "x"], [], None]
IMAGES = f"f AS (SELECT conv_id AS id, conv_id % 26 AS figures, (conv_id * 37) % 2000 AS words, CASE WHEN conv_id % 5 > 0 THEN turn END AS image, role = 'assistant' AS likely, (length(text) % 100) / 100.0::DOUBLE AS confidence, {lit(ISSUE_LISTS)}[CAST(turn % 4 AS INT) + 1] AS issues FROM conversations)"


@query(
    f"""WITH {IMAGES}, e AS (SELECT id, figures, words, count(image) AS n, coalesce(sum((likely AND confidence > 0.5)::INT + coalesce(len(list_filter(issues[1:2], lambda x: x <> '{D.FAILED}')), 0)) FILTER (WHERE image IS NOT NULL), 0) AS seen FROM f GROUP BY id, figures, words)
    SELECT id, CAST(CASE WHEN n > 0 THEN seen WHEN figures > 0 THEN (figures > 20)::INT + (words < 1000 AND figures > 5)::INT ELSE 0 END AS BIGINT) AS issues FROM e"""
)
def image_issue_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.get(F.array(*[F.array(*map(F.lit, x)).cast("array<string>") if x is not None else F.lit(None).cast("array<string>") for x in ISSUE_LISTS]), (F.col("turn") % 4).cast("int"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = turns.select(F.col("conv_id").alias("id"), (F.col("conv_id") % 26).alias("figures"), (F.col("conv_id") * 37 % 2000).alias("words"), F.when(F.col("conv_id") % 5 > 0, F.col("turn")).alias("image"), (F.col("role") == "assistant").alias("likely"), (F.length("text") % 100 / 100.0).alias("confidence"), listed.alias("quality_issues"))
    held = rows.groupBy("id", "figures", "words").agg(F.collect_list(F.when(F.col("image").isNotNull(), F.struct("image", "likely", "confidence", "quality_issues"))).alias("images"))
    return held.select("id", D.image_issues(F.col("images"), F.col("figures"), F.col("words")).alias("issues"))


# Similarity
TEMPLATED = [(1, "标题\n目录\n正文在此\n参考文献\n[1] x\n"), (2, "封面\n致谢\n第一章 附录\nbody"), (3, "Reference\n§"), (4, "§\n致谢\n§"), (5, "")]
HEAD_WORDS = "|".join(similarity.TEMPLATE)
STRIPPED = rf"regexp_replace(t, '(?i)(?:\A|\n)\s*(?:第.+(?:章|节)\s+)?(?:{HEAD_WORDS})\s*\n', chr(10), 'g')"


@query(f"WITH {drawn(TEMPLATED, 'doc_id', HEAD)} SELECT id, {STRIPPED} AS stripped FROM f")
def template_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw(docs(spark, sf_dir), TEMPLATED, "doc_id", head()).select("id", similarity.without_template(F.col("t")).alias("stripped"))


KEPT = rf"regexp_replace({STRIPPED}, '[^a-zA-Z0-9\x{{4E00}}-\x{{9FFF}}]', '', 'g')"
TOKENS = rf"regexp_extract_all({STRIPPED}, '[a-zA-Z0-9]+|[\x{{4E00}}-\x{{9FFF}}]')"
SETS = f"""{DOCS}, ks AS (SELECT doc_id, {KEPT} AS k, {TOKENS} AS w FROM d),
    cg AS (SELECT DISTINCT doc_id, substring(k, i, 8) AS g FROM ks, unnest(range(1, length(k) - 6)) AS u(i)),
    wg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ':') AS g FROM ks, unnest(range(1, len(w) - 1)) AS u(i))"""


@query(f"WITH {SETS}, c AS (SELECT doc_id, count(*) AS n FROM cg GROUP BY doc_id) SELECT doc_id, coalesce(n, 0) AS grams FROM d LEFT JOIN c USING (doc_id)")
def char_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = similarity.without_template(F.coalesce("text", F.lit("")))
    return docs(spark, sf_dir).select("doc_id", F.size(similarity.char_grams(clean, 8)).cast("long").alias("grams"))


@query(f"WITH {SETS}, c AS (SELECT doc_id, count(*) AS n FROM wg GROUP BY doc_id) SELECT doc_id, coalesce(n, 0) AS grams FROM d LEFT JOIN c USING (doc_id)")
def word_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = similarity.without_template(F.coalesce("text", F.lit("")))
    return docs(spark, sf_dir).select("doc_id", F.size(similarity.word_grams(clean, 3)).cast("long").alias("grams"))


PAIRS_AT = Similarity(hashes=16)
SIGNED = f"""{SETS}, mh AS (SELECT doc_id, s, min(left(md5(s::VARCHAR || g), 16)) AS h FROM cg, unnest(range(0, 16)) AS u(s) GROUP BY doc_id, s),
    sig AS (SELECT doc_id, s, coalesce(h, 'ffffffffffffffff') AS h FROM (SELECT doc_id, s FROM d, unnest(range(0, 16)) AS u(s)) LEFT JOIN mh USING (doc_id, s))"""


@query(f"WITH {SIGNED} SELECT doc_id, string_agg(h, ',' ORDER BY s) AS signature FROM sig GROUP BY doc_id")
def minhash_signature_k16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.signatures(docs(spark, sf_dir), PAIRS_AT).select("doc_id", F.array_join("signature", ",").alias("signature"))


# every two documents, as they are
SIMILAR = f"""{SIGNED}, nc AS (SELECT doc_id, count(g) AS n FROM d LEFT JOIN cg USING (doc_id) GROUP BY doc_id), nw AS (SELECT doc_id, count(g) AS n FROM d LEFT JOIN wg USING (doc_id) GROUP BY doc_id),
    sc AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM cg x JOIN cg y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
    sw AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS w FROM wg x JOIN wg y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
    sm AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM sig x JOIN sig y ON x.s = y.s AND x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
    parts AS (SELECT a, b, coalesce(c, 0) AS c, coalesce(w, 0) AS w, coalesce(m, 0) AS m FROM sc FULL JOIN sw USING (a, b) FULL JOIN sm USING (a, b)),
    every AS (SELECT a, b, {fix("(CASE WHEN c = 0 THEN 0.0::DOUBLE ELSE c::DOUBLE / (ca.n + cb.n - c)::DOUBLE END + CASE WHEN w = 0 THEN 0.0::DOUBLE ELSE w::DOUBLE / (wa.n + wb.n - w)::DOUBLE END + m::DOUBLE / 16::DOUBLE) / 3::DOUBLE", 4)} AS similarity
        FROM parts JOIN nc ca ON ca.doc_id = a JOIN nc cb ON cb.doc_id = b JOIN nw wa ON wa.doc_id = a JOIN nw wb ON wb.doc_id = b),
    sus AS (SELECT * FROM every WHERE similarity >= 0.4::DOUBLE),
    marks AS (SELECT doc_id, CASE WHEN nc.n + nw.n = 0 THEN '#' || doc_id ELSE coalesce((SELECT string_agg(g, '|' ORDER BY g) FROM cg WHERE cg.doc_id = d.doc_id), '') || '#' || coalesce((SELECT string_agg(g, '|' ORDER BY g) FROM wg WHERE wg.doc_id = d.doc_id), '') END AS m FROM d JOIN nc USING (doc_id) JOIN nw USING (doc_id)),
    mem AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(m)) AS class, count(*) OVER (PARTITION BY md5(m)) AS copies FROM marks)"""
GRADE = f"CASE {' '.join(f'WHEN similarity >= {p}::DOUBLE THEN {lit(n)}' for p, n in similarity.GRADES)} ELSE '{similarity.NO_GRADE}' END"


@query(f"WITH {SIMILAR} SELECT a, b, similarity, {GRADE} AS severity FROM sus WHERE a IN (SELECT class FROM mem) AND b IN (SELECT class FROM mem)")
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similar_pairs(docs(spark, sf_dir), PAIRS_AT)


@query(f"WITH {SIMILAR} SELECT doc_id, class, copies FROM mem")
def similar_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.memberships(docs(spark, sf_dir), PAIRS_AT).select("doc_id", "class", "copies")


def _rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets, members = similarity.classes(docs(spark, sf_dir), PAIRS_AT)
    return similarity.rollup(members, similarity.compared(sets, PAIRS_AT), PAIRS_AT)


ROLLED = f"""{SIMILAR}, ways AS (SELECT a AS doc_id, b AS other, similarity FROM sus UNION ALL SELECT b, a, similarity FROM sus),
    top AS (SELECT doc_id, max(similarity) AS highest, CAST(count(*) AS BIGINT) AS links FROM ways GROUP BY doc_id), near AS (SELECT doc_id, min(other) AS partner FROM ways JOIN top USING (doc_id) WHERE similarity = highest GROUP BY doc_id),
    rolled AS (SELECT doc_id, coalesce(highest, 0.0) AS highest, coalesce(partner, -1) AS partner, coalesce(links, 0) AS links FROM d LEFT JOIN top USING (doc_id) LEFT JOIN near USING (doc_id))"""


@query(f"WITH {ROLLED} SELECT * FROM rolled")
def similar_author_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled(spark, sf_dir)


@query(f"WITH {ROLLED} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM rolled WHERE highest >= 0.4::DOUBLE) AS suspected, (SELECT count(*) FROM sus) AS pairs, (SELECT count(*) FROM rolled WHERE highest = 1) AS copied")
def similarity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _rolled(spark, sf_dir).agg(F.count("*").alias("documents"), F.count_if(F.col("highest") >= 0.4).alias("suspected"), F.coalesce(F.sum("links"), F.lit(0)).alias("links"), F.count_if(F.col("highest") == 1).alias("copied"))
    return found.select("documents", "suspected", (F.col("links") / 2).cast("long").alias("pairs"), "copied")


PAIRED = f"""{SIMILAR}, pairs AS MATERIALIZED (SELECT a, b FROM sus WHERE a IN (SELECT class FROM mem) AND b IN (SELECT class FROM mem)), plain AS MATERIALIZED (SELECT doc_id, {STRIPPED} AS t FROM d)"""
PICKED = "list_reduce(list_transform(open, lambda o: o), lambda p, o: CASE WHEN o.n > p.n OR o.n = p.n AND (o.x < p.x OR o.x = p.x AND o.y < p.y) THEN o ELSE p END)"


@query(
    f"""WITH RECURSIVE {PAIRED},
    grams AS MATERIALIZED (SELECT doc_id, i, substring(t, i, 30) AS g FROM plain, unnest(range(1, length(t) - 28)) AS u(i) WHERE doc_id IN (SELECT a FROM pairs UNION SELECT b FROM pairs)),
    firsts AS MATERIALIZED (SELECT a, b, i, g FROM pairs JOIN grams ON doc_id = a),
    hits AS (SELECT a, b, x.i AS x, y.i - x.i AS d FROM firsts x JOIN grams y ON y.doc_id = b AND y.g = x.g),
    blocks AS (SELECT a, b, min(x) AS x, min(x) + d AS y, count(*) + 29 AS n FROM (SELECT *, x - row_number() OVER (PARTITION BY a, b, d ORDER BY x) AS island FROM hits) GROUP BY a, b, d, island),
    steps(a, b, no, open, best) AS (
        SELECT a, b, 0, list({{'x': x, 'y': y, 'n': n}}), {{'x': 0::BIGINT, 'y': 0::BIGINT, 'n': 0::BIGINT}} FROM blocks GROUP BY a, b
        UNION ALL
        SELECT a, b, no + 1, list_filter(flatten(list_transform(open, lambda c: [{{'x': c.x, 'y': c.y, 'n': least(c.n, p.x - c.x, p.y - c.y)}},
            {{'x': c.x + greatest(0, p.x + p.n - c.x, p.y + p.n - c.y), 'y': c.y + greatest(0, p.x + p.n - c.x, p.y + p.n - c.y), 'n': c.n - greatest(0, p.x + p.n - c.x, p.y + p.n - c.y)}}])), lambda c: c.n >= 30), p
        FROM (SELECT a, b, no, open, {PICKED} AS p FROM steps WHERE len(open) > 0 AND no < 10))
    SELECT a, b, CAST(no AS BIGINT) AS segment_no, best.n AS length, CASE WHEN best.n > 100 THEN substring(t, best.x, 100) || '...' ELSE substring(t, best.x, best.n) END AS segment
    FROM steps JOIN plain ON doc_id = a WHERE no > 0"""
)
def common_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_docs = docs(spark, sf_dir)
    return similarity.common_segments(similarity.similar_pairs(all_docs, PAIRS_AT), all_docs, PAIRS_AT)


@query(
    rf"""WITH {DOCS}, a AS (SELECT DISTINCT doc_id, substring(k, i, 24) AS g FROM (SELECT doc_id, regexp_replace(t, '[^a-zA-Z0-9\x{{4E00}}-\x{{9FFF}}]', '', 'g') AS k FROM d), unnest(range(1, length(k) - 22)) AS u(i)),
    b AS (SELECT DISTINCT item_id, substring(k, i, 24) AS g FROM (SELECT item_id, regexp_replace(coalesce(text, ''), '[^a-zA-Z0-9\x{{4E00}}-\x{{9FFF}}]', '', 'g') AS k FROM benchmark), unnest(range(1, length(k) - 22)) AS u(i))
    SELECT doc_id, item_id, count(*) AS shared FROM a JOIN b USING (g) GROUP BY doc_id, item_id"""
)
def corpus_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.corpus_overlap(docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", 24)


# Evaluation
DIMENSIONS = (Dimension("功能", 0.35), Dimension("代码", 0.25), Dimension("文档", 0.4))
ANSWERS = [
    (1, 'Here:\n```json\n{"dimension_scores": {"功能": 80, "代码": 72.5, "文档": 120}, "total_score": 3, "evaluation_basis": "b", "short_comment": "c", "core_problems": {"P1": ["y"], "P0": ["x", "z"]}}\n```\nend'),
    (2, '{"dimension_scores": {"功能": 60}, "core_problems": ["p", "q"]}'),
    (3, "功能：85 分\n代码: 70\n总分：77"),
    (4, "no scores at all"),
    (5, '`{"dimension_scores": {"文档": -5, "代码": 33.5}}`'),
    (6, "broken {json 总得：12"),
]
#: The answers that labelled documents get, with a number of each for its scores.
ANSWERED = [(i, r.replace("80", "§").replace("85", "§").replace("33.5", "§.5")) for i, r in ANSWERS]
SCORE = "CAST((doc_id * 37) % 130 AS VARCHAR)"


def _eval_sql() -> str:
    body = r"CASE WHEN regexp_matches(r, '(?s)```(?:json)?\s*\n?(.*?)\n?```') THEN regexp_extract(r, '(?s)```(?:json)?\s*\n?(.*?)\n?```', 1) ELSE r END"
    j = rf"regexp_replace({strip(body)}, '\A`+|`+\z', '', 'g')"
    half = lambda x: f"CASE WHEN {x} - floor({x}) = 0.5 THEN 2 * floor(({x} + 1) / 2) ELSE round({x}) END"
    bound = lambda x: f"least(100.0::DOUBLE, greatest(0.0::DOUBLE, {half(x)}))"
    score = lambda d: bound(f"coalesce(TRY_CAST(json_extract_string(j, '$.dimension_scores.\"{d.name}\"') AS DOUBLE), 0.0::DOUBLE)")
    said = lambda d: bound(f"TRY_CAST(nullif(regexp_extract(r, '{d.name}[：:]\\s*(\\d+)', 1), '') AS DOUBLE)")
    columns = ", ".join(f"CASE WHEN ok THEN {score(d)} WHEN regexp_matches(r, '{d.name}[：:]\\s*(\\d+)') THEN {said(d)} END AS s{n}" for n, d in enumerate(DIMENSIONS))
    total = " + ".join(f"s{n} * {d.weight}::DOUBLE" for n, d in enumerate(DIMENSIONS))
    return f"""{drawn(ANSWERED, 'doc_id', SCORE, 'labels', 'r')}, g AS (SELECT id, r, {j} AS js FROM f), h AS (SELECT id, r, CASE WHEN json_valid(js) THEN js END AS j, json_valid(js) AS ok FROM g),
    s AS (SELECT *, {columns} FROM h), e AS (SELECT *, CASE WHEN ok THEN {bound(f'({total})')} ELSE coalesce({bound("TRY_CAST(nullif(regexp_extract(r, '" + E.TOTAL + "', 1), '') AS DOUBLE)")}, 0.0::DOUBLE) END AS total FROM s)"""


EVAL = _eval_sql()


def _parsed(spark: SparkSession) -> DataFrame:
    return E.parse_evaluation(spark.createDataFrame(ANSWERS, "id long, response string"), DIMENSIONS)


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.col("doc_id") * 37 % 130).cast("string")
    return E.parse_evaluation(draw(spark.read.parquet(f"{sf_dir}/labels.parquet"), ANSWERED, "doc_id", number, "response"), DIMENSIONS)


@query(f"WITH {EVAL} SELECT id, ok AS parsed, s0, s1, s2, total, CASE WHEN ok THEN coalesce(json_extract_string(j, '$.short_comment'), '{E.NO_COMMENT}') ELSE '{E.UNPARSED}' END AS comment FROM e")
def eval_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = [F.try_element_at("scores", F.lit(d.name)).alias(f"s{n}") for n, d in enumerate(DIMENSIONS)]
    return _answered(spark, sf_dir).select("id", "parsed", *scores, "total", "comment")


LEVELS = "list_concat(" * 2 + ", ".join(f"list_transform(coalesce(CAST(json_extract(j, '$.core_problems.{p}') AS VARCHAR[]), []), lambda x: '[{p}]' || x)" + ")" * (n > 0) for n, p in enumerate(("P0", "P1", "P2")))


@query(f"WITH {EVAL} SELECT id, coalesce(array_to_string(CASE WHEN NOT ok THEN [] WHEN json_type(j, '$.core_problems') = 'ARRAY' THEN CAST(json_extract(j, '$.core_problems') AS VARCHAR[]) ELSE {LEVELS} END, ','), '') AS problems FROM e")
def eval_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answered(spark, sf_dir).select("id", F.array_join("problems", ",").alias("problems"))


WEIGHTS = [(1, [0.5, 0.3, 0.2]), (2, [3.0, 1.0, 1.0]), (3, [0.9, 0.05, 0.05]), (4, [1.0]), (5, [0.2, 0.2, 0.2, 0.2]), (6, [0.0, 0.0])]


@query(
    f"""WITH f AS (SELECT doc_id AS id, list_transform({lit([w for _, w in WEIGHTS])}[CAST(doc_id % {len(WEIGHTS)} AS INT) + 1], lambda x: x::DOUBLE * (1 + doc_id % 3)) AS raw FROM labels), w AS (SELECT id, list_transform(raw, lambda x: x::DOUBLE) AS w, list_sum(list_transform(raw, lambda x: x::DOUBLE)) AS s FROM f), q AS (SELECT id, w, s, CASE WHEN s = 0 THEN w ELSE list_transform(w, lambda x: {fix('x / s', 2)}) END AS q FROM w),
    z AS (SELECT id, CASE WHEN s = 0 OR abs(s - 1.0::DOUBLE) <= 0.01 THEN w ELSE list_append(q[1:len(q) - 1], {fix('1.0::DOUBLE - coalesce(list_sum(q[1:len(q) - 1]), 0.0::DOUBLE)', 2)}) END AS z FROM q)
    SELECT id, ord, least(0.5::DOUBLE, greatest(0.05::DOUBLE, z[ord])) AS weight FROM z, unnest(range(1, len(z) + 1)) AS u(ord)"""
)
def rubric_weight_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.get(F.array(*[F.array(*map(F.lit, w)) for _, w in WEIGHTS]), (F.col("doc_id") % len(WEIGHTS)).cast("int"))
    drawn_ = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), F.transform(one, lambda x: x * (1 + F.col("doc_id") % 3)).alias("w"))
    rows = drawn_.select("id", F.posexplode(E.normalised_weights(F.col("w"))).alias("ord", "weight"))
    return rows.select("id", (F.col("ord") + 1).cast("long").alias("ord"), "weight")


#: Turns of conversations stand in for images again, three to a batch; § is the first of a batch.
BATCHES = [(0, '```json\n[{"image_index": §, "description": "d1", "relevance": "高", "has_caption": true, "quality_issues": ["模糊"], "is_likely_aigc": true, "aigc_confidence": 0.8}, {"image_index": 9§, "description": "d9"}]\n```'), (1, "not json"), (2, '{"image_index": §, "relevance": "低"}')]
PICTURES = "q AS (SELECT conv_id, turn // 3 AS batch, turn, role, text FROM conversations), p AS (SELECT CAST(conv_id AS VARCHAR) AS doc, batch, CAST(turn AS INT) AS image_index, role AS section, left(text, 20) AS caption FROM q)"


def _image_sql() -> str:
    body = r"CASE WHEN regexp_matches(r, '(?s)```(?:json)?\s*\n?(.*?)\n?```') THEN regexp_extract(r, '(?s)```(?:json)?\s*\n?(.*?)\n?```', 1) ELSE r END"
    text = lambda p, default: f"CASE WHEN i IS NULL THEN '{default[1]}' ELSE coalesce(json_extract_string(i, '$.{p}'), '{default[0]}') END"
    return f"""{PICTURES}, f AS (SELECT CAST(conv_id AS VARCHAR) AS doc, batch, replace({lit([t for _, t in BATCHES])}[CAST((conv_id + batch) % 3 AS INT) + 1], '§', CAST(min(turn) AS VARCHAR)) AS r FROM q GROUP BY conv_id, batch), g AS (SELECT doc, batch, {body} AS b FROM f),
    h AS (SELECT doc, batch, CASE WHEN starts_with(b, '{{') THEN '[' || b || ']' ELSE b END AS b FROM g), t AS (SELECT doc, batch, unnest(CAST(CASE WHEN json_valid(b) THEN b ELSE '[]' END AS JSON[])) AS i FROM h),
    u AS (SELECT doc, batch, CAST(json_extract_string(i, '$.image_index') AS INT) AS image_index, i FROM t), x AS (SELECT * FROM p FULL JOIN u USING (doc, batch, image_index))
    SELECT doc, batch, CAST(image_index AS BIGINT) AS image_index, coalesce(section, '') AS section, coalesce(caption, '') AS caption, {text('description', ('', E.FAILED))} AS description, {text('relevance', (E.UNKNOWN, E.UNKNOWN))} AS relevance,
      coalesce(CAST(json_extract_string(i, '$.has_caption') AS BOOLEAN), false) AS has_caption, CASE WHEN i IS NULL THEN '{E.FAILED}' ELSE coalesce(array_to_string(CAST(json_extract(i, '$.quality_issues') AS VARCHAR[]), ','), '') END AS quality_issues,
      coalesce(CAST(json_extract_string(i, '$.is_likely_aigc') AS BOOLEAN), false) AS is_likely_aigc, coalesce(CAST(json_extract_string(i, '$.aigc_confidence') AS DOUBLE), 0.0::DOUBLE) AS aigc_confidence FROM x"""


@query(f"WITH {_image_sql()}")
def image_json_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumns({"doc": F.col("conv_id").cast("string"), "batch": F.floor(F.col("turn") / 3)})
    batches = turns.groupBy("doc", "conv_id", "batch").agg(F.min("turn").alias("first")).withColumn("n", F.col("conv_id") + F.col("batch"))
    one = F.get(F.array(*[F.lit(t) for _, t in BATCHES]), (F.col("n") % 3).cast("int"))
    answers = batches.select("doc", "batch", F.replace(one, F.lit("§"), F.col("first").cast("string")).alias("response"))
    images = turns.select("doc", "batch", F.col("turn").cast("int").alias("image_index"), F.col("role").alias("section"), F.left("text", F.lit(20)).alias("caption"))
    return E.parse_images(answers, images).withColumns({"quality_issues": F.array_join("quality_issues", ","), "image_index": F.col("image_index").cast("long")})


# Scores. Labels stand in for evaluations: quality for success, and a total from the text's length.
TOTALS = "CAST(40 + (doc_id * 37) % 61 AS DOUBLE)"
OUT = Scale(out_low=60, out_high=90, exponent=1.5)
EVEN = lambda x: f"CASE WHEN {x} - floor({x}) = 0.5::DOUBLE THEN 2 * floor(({x} + 1) / 2) ELSE round({x}) END"


def _evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = (F.lit(40) + (F.col("doc_id") * 37) % 61).cast("double")
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", total.alias("total"), (F.col("quality") == 1).alias("success"))


#: Every input of a final score, by the number of a labelled document.
INPUTS = {
    "completeness": "CASE WHEN doc_id % 11 > 0 THEN CAST((doc_id * 37) % 101 AS DOUBLE) END",
    "evaluated": "doc_id % 4 > 0",
    "success": "CASE WHEN doc_id % 13 > 0 THEN quality = 1 END",
    "total": TOTALS,
    "probability": "CAST((doc_id * 53) % 101 AS DOUBLE) / 100",
    "suspicious": "CASE WHEN doc_id % 6 > 0 THEN (doc_id * 53) % 101 >= 60 END",
    "similarity": "CAST((doc_id * 71) % 101 AS DOUBLE) / 100",
    "has_pair": "CASE WHEN doc_id % 9 > 0 THEN (doc_id * 71) % 101 >= 40 END",
}
MIXED = "(completeness * 0.2::DOUBLE + total * 0.8::DOUBLE) * (CASE WHEN coalesce(suspicious, false) THEN 1 - probability * 0.8::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN coalesce(has_pair, false) THEN 1 - similarity * 0.3::DOUBLE ELSE 1.0::DOUBLE END)"
BOUND = lambda x: f"(0.0::DOUBLE + pow(least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({x} - 0.0) / 100.0::DOUBLE)), 1.0) * 100.0::DOUBLE)"
FINAL = f"CASE WHEN completeness IS NOT NULL AND evaluated AND coalesce(success, false) THEN {EVEN(BOUND('mixed'))} WHEN completeness IS NOT NULL AND NOT evaluated THEN {EVEN(BOUND('completeness'))} ELSE 0.0::DOUBLE END"


@query(
    f"""WITH c AS (SELECT doc_id AS id, {', '.join(f'{e} AS {n}' for n, e in INPUTS.items())} FROM labels),
    m AS (SELECT *, {MIXED} AS mixed FROM c) SELECT id, {FINAL} AS final FROM m"""
)
def final_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), *[F.expr(e).alias(n) for n, e in INPUTS.items()])
    return rows.select("id", scoring.final_score(*[F.col(c) for c in rows.columns[1:]]).alias("final"))


@query(f"WITH e AS (SELECT doc_id, {TOTALS} AS total, pow(least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({TOTALS} - 0) / 100.0::DOUBLE)), 1.5::DOUBLE) AS p FROM labels) SELECT doc_id, total, {EVEN('(60.0::DOUBLE + p * 30.0::DOUBLE)')} AS normalised FROM e")
def post_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluations(spark, sf_dir).select("doc_id", "total", scoring.normalise(F.col("total"), OUT).alias("normalised"))


# dimension scores of the labelled documents; every seventh lacks one
PARTS = {"功能": "(doc_id * 37) % 101", "代码": "(doc_id * 53) % 101", "文档": "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE (doc_id * 71) % 101 END"}


@query(f"WITH p AS (SELECT doc_id, {' + '.join(f'coalesce({PARTS[d.name]}, 0)::DOUBLE * {d.weight}::DOUBLE' for d in DIMENSIONS)} AS p FROM labels) SELECT doc_id, least(100.0::DOUBLE, greatest(0.0::DOUBLE, {EVEN('p')})) AS total FROM p")
def weighted_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("key"), F.expr(e).cast("int").alias("value")) for n, e in PARTS.items()]), lambda e: e["value"].isNotNull()))
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", scoring.weighted_total(scores, DIMENSIONS).alias("total"))


REPORT = f"""{COMPLETE.replace(DOCS, ROLLED, 1).replace(' f AS', ' cf AS', 1).replace(' c AS (SELECT *', ' cc AS (SELECT *', 1).replace('FROM f)', 'FROM cf)', 1).replace('FROM c)', 'FROM cc)', 1)}, {RISK.replace(DOCS + ',', '', 1).replace(' n AS', ' nn AS', 1).replace('FROM n)', 'FROM nn)', 1)},
    ev AS (SELECT doc_id, {TOTALS} AS total, quality = 1 AS success FROM labels),
    rep AS (SELECT k.doc_id, k.score AS completeness, total, success, total IS NOT NULL AS evaluated, risk.probability, risk.suspicious, risk.risk, rolled.highest AS similarity, rolled.links > 0 AS has_pair FROM k LEFT JOIN ev USING (doc_id) LEFT JOIN risk USING (doc_id) LEFT JOIN rolled USING (doc_id)),
    mix AS (SELECT *, {MIXED} AS mixed FROM rep), fin AS (SELECT *, {FINAL} AS final FROM mix)"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness and signs in one pass over the texts, joined with evaluations and similarity."""
    found = D.detected(checked(spark, sf_dir).drop("figures", "words"), FOUND)
    rows = found.select("doc_id", F.col("score").alias("completeness"), T.fixed(F.col("probability"), 4).alias("probability"), "suspicious", "risk")
    return report.joined(rows, _evaluations(spark, sf_dir), _rolled(spark, sf_dir))


@query(f"WITH {REPORT} SELECT row_number() OVER (ORDER BY doc_id) AS ordinal, doc_id, completeness, total AS evaluation, risk, similarity, final FROM fin")
def summary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.numbered(_report(spark, sf_dir), "doc_id").select("ordinal", "doc_id", "completeness", "evaluation", "risk", F.col("highest").alias("similarity"), "final")


@query(f"SELECT count(*) AS n, avg({TOTALS}) AS mean, max({TOTALS}) AS highest, min({TOTALS}) AS lowest FROM labels WHERE quality = 1")
def summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.statistics(_evaluations(spark, sf_dir).withColumnRenamed("total", "evaluation"))


# Incremental
@query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def incremental_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.pending(docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").select("doc_id", "source")


@query(f"WITH c AS (SELECT doc_id, {TOTALS} AS total FROM labels), n AS (SELECT doc_id, 50.0::DOUBLE AS total FROM documents WHERE doc_id % 3 = 0) SELECT doc_id, total FROM n UNION ALL SELECT doc_id, total FROM c ANTI JOIN n USING (doc_id)")
def incremental_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = docs(spark, sf_dir).where("doc_id % 3 = 0").select("doc_id", F.lit(50.0).alias("total"))
    return incremental.merged(_evaluations(spark, sf_dir).select("doc_id", "total"), new, "doc_id")


FILES = "CAST(20210000 + doc_id % 97 AS VARCHAR) || '_' || source || list_extract(['.docx', '.doc', '.pdf', '.txt'], CAST(doc_id // 97 % 4 AS INT) + 1)"


@query(
    f"""WITH f AS (SELECT DISTINCT {FILES} AS name FROM documents), p AS (SELECT name, regexp_extract(name, '^(.+)[.]', 1) AS stem, list_position(['docx', 'doc', 'pdf'], regexp_extract(name, '[.]([^.]+)$', 1)) AS rank FROM f),
    a AS (SELECT name, rank, CASE WHEN regexp_matches(stem, '^[0-9]{{6,}}_') THEN replace(stem, '_', '-') ELSE split_part(stem, '_', 1) END AS author FROM p WHERE rank > 0)
    SELECT name, author FROM a QUALIFY row_number() OVER (PARTITION BY author ORDER BY rank, name) = 1"""
)
def dedupe_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources import files

    kind = F.get(F.array(*map(F.lit, (".docx", ".doc", ".pdf", ".txt"))), F.expr("cast(doc_id div 97 % 4 as int)"))
    names = docs(spark, sf_dir).select(F.concat((20210000 + F.col("doc_id") % 97).cast("string"), F.lit("_"), "source", kind).alias("name")).distinct()
    return files.best(names).select("name", "author")


#: The fields of a report of labelled documents, as the texts that a report has.
RESTORE = {
    "completeness": "CASE doc_id % 4 WHEN 0 THEN CAST((doc_id * 37) % 101 AS VARCHAR) WHEN 1 THEN 'N/A' WHEN 2 THEN '55.5' END",
    "risk": "CASE doc_id % 3 WHEN 0 THEN '高风险' WHEN 1 THEN '正常' ELSE '低风险' END",
    "deduction": "CASE WHEN doc_id % 7 > 0 THEN '-' || CAST((doc_id * 53) % 101 AS VARCHAR) || '%' END",
    "similarity": "CASE WHEN doc_id % 5 > 0 THEN CAST((doc_id * 71) % 101 AS VARCHAR) || '%' ELSE 'x' END",
}


@query(
    f"""WITH f AS (SELECT CAST(doc_id AS VARCHAR) AS author, {', '.join(f'{e} AS {n}' for n, e in RESTORE.items())} FROM labels) SELECT author, coalesce(TRY_CAST(completeness AS DOUBLE), 0.0::DOUBLE) AS score,
    least(coalesce(TRY_CAST(nullif(regexp_extract(deduction, '(\\d+)', 1), '') AS DOUBLE), 0.0::DOUBLE) / 80.0::DOUBLE, 1.0::DOUBLE) AS probability, risk NOT IN ('正常', '低风险') AS suspicious,
    coalesce(TRY_CAST(nullif(regexp_extract(similarity, '(\\d+)', 1), '') AS DOUBLE), 0.0::DOUBLE) / 100.0::DOUBLE AS highest FROM f"""
)
def excel_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources import store

    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("string").alias("author"), *[F.expr(e.replace("VARCHAR", "STRING")).alias(n) for n, e in RESTORE.items()])
    return store.restored(rows)


@query("WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents) SELECT doc_id, n > 0 AS success, CASE WHEN n > 0 THEN CAST(least(100, 40 + n // 100) AS DOUBLE) ELSE 0.0::DOUBLE END AS total FROM d")
def scorer_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import scorer

    return scorer.evaluate(docs(spark, sf_dir), scorer.LengthScorer())


# What graders are asked, and what the report shows
@query(
    f"""WITH {DOCS}, f AS (SELECT doc_id, t, {WORDS} AS words, CAST(len({FILLED}) AS BIGINT) AS paragraphs, {count('t', ' [|] ')} AS figures, {count('t', '@')} AS likely FROM d)
    SELECT doc_id, md5((CASE WHEN length(t) > {prompts.MOST} THEN left(t, {prompts.MOST}) || {lit(prompts.CUT)} ELSE t END)
      || printf({lit(prompts.COUNTS)}, words, paragraphs, figures, 0) || (CASE WHEN figures = 0 THEN {lit(prompts.NO_IMAGES)} ELSE '' END)
      || (CASE WHEN likely > 0 THEN printf({lit(prompts.LIKELY)}, likely) ELSE '' END)) AS prompt_md5 FROM f"""
)
def grading_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    figures, likely, none = F.regexp_count(t, F.lit(" [|] ")).cast("long"), F.regexp_count(t, F.lit("@")).cast("long"), F.lit(0).cast("long")
    suffix = prompts.metadata(T.word_count(t), T.paragraph_count(t), figures, none, likely, none)
    return docs(spark, sf_dir).select("doc_id", F.md5(prompts.asked(t, suffix)).alias("prompt_md5"))


SHOWN = "f AS (SELECT CAST(conv_id AS VARCHAR) AS doc, turn AS image_index, role AS section, text AS caption FROM conversations)"


@query(
    f"""WITH {SHOWN}, b AS (SELECT *, (row_number() OVER (PARTITION BY doc ORDER BY image_index) - 1) // 5 + 1 AS batch FROM f)
    SELECT doc, batch, string_agg(printf({lit(prompts.IMAGE_LINE)}, image_index, section, CASE WHEN length(caption) > 120 THEN left(caption, 120) || '...' ELSE caption END), chr(10) ORDER BY image_index) AS listed FROM b GROUP BY doc, batch"""
)
def image_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("string").alias("doc"), F.col("turn").alias("image_index"), F.col("role").alias("section"), F.col("text").alias("caption"))
    return prompts.image_lists(prompts.batched(shown))


RUBRICS = [(1, '```json\n{"dimensions": [{"name": "a", "weight": §}, {"name": "b", "weight": 1}], "completeness": {"sections": ["x", "y"], "word_count": {"min": 500}}}\n```'), (2, '{"dimensions": ["p", "q"], "sections": ["z"], "min_word_count": 90§}'), (3, "not json")]


def _rubric_sql() -> str:
    body = r"CASE WHEN regexp_matches(r, '(?s)```(?:json)?\s*\n?(.*?)\n?```') THEN regexp_extract(r, '(?s)```(?:json)?\s*\n?(.*?)\n?```', 1) ELSE r END"
    named = lambda x: f"coalesce(json_extract_string({x}, '$.name'), json_extract_string({x}, '$'))"
    heavy = lambda x: f"CASE WHEN json_extract_string({x}, '$.name') IS NULL THEN 0.2::DOUBLE ELSE coalesce(TRY_CAST(json_extract_string({x}, '$.weight') AS DOUBLE), 0.0::DOUBLE) END"
    items = lambda path: f"coalesce(CAST(json_extract(j, '{path}') AS JSON[]), [])"
    return f"""{drawn(RUBRICS, 'doc_id', 'CAST(doc_id % 9 + 1 AS VARCHAR)', 'labels', 'r')}, g AS (SELECT id, {body} AS b FROM f), h AS (SELECT id, CASE WHEN json_valid(b) THEN b::JSON END AS j FROM g),
    w AS (SELECT id, j, list_transform({items('$.dimensions')}, lambda x: {named('x')}) AS names, list_transform({items('$.dimensions')}, lambda x: {heavy('x')}) AS w,
          CASE WHEN len({items('$.completeness.sections')}) > 0 THEN list_transform({items('$.completeness.sections')}, lambda x: {named('x')}) ELSE list_transform({items('$.sections')}, lambda x: {named('x')}) END AS sections FROM h),
    q AS (SELECT *, coalesce(list_sum(w), 0.0) AS s FROM w), z AS (SELECT *, CASE WHEN s = 0 OR abs(s - 1) <= 0.01 THEN w ELSE list_transform(w, lambda x: {fix('x / s', 2)}) END AS v FROM q),
    y AS (SELECT *, CASE WHEN s = 0 OR abs(s - 1) <= 0.01 THEN v ELSE list_append(v[1:len(v) - 1], {fix('1.0::DOUBLE - coalesce(list_sum(v[1:len(v) - 1]), 0.0::DOUBLE)', 2)}) END AS u FROM z)
    SELECT id, j IS NOT NULL AS parsed, coalesce(array_to_string(names, ','), '') AS names, coalesce(array_to_string(list_transform(u, lambda x: least(0.5::DOUBLE, greatest(0.05::DOUBLE, x))::VARCHAR), ','), '') AS weights, coalesce(array_to_string(sections, ','), '') AS sections,
      coalesce(TRY_CAST(json_extract_string(j, '$.completeness.sections_weight') AS DOUBLE), 40.0::DOUBLE) AS sections_weight, CAST(coalesce(json_extract_string(j, '$.completeness.word_count.min'), json_extract_string(j, '$.min_word_count'), '2000') AS BIGINT) AS min_words,
      CAST(coalesce(json_extract_string(j, '$.completeness.figures.min'), '3') AS BIGINT) AS min_figures FROM y"""


@query(f"WITH {_rubric_sql()}")
def rubric_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.col("doc_id") % 9 + 1).cast("string")
    found = E.parse_rubric(draw(spark.read.parquet(f"{sf_dir}/labels.parquet"), RUBRICS, "doc_id", number, "response"))
    return found.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("names", "weights", "sections")})


@query(
    f"""WITH {SIMILAR}, w AS (SELECT a AS doc_id, b AS other, similarity FROM sus UNION ALL SELECT b, a, similarity FROM sus)
    SELECT doc_id, '与' || string_agg(other::VARCHAR, ', ' ORDER BY other) || '相似度' || CAST({EVEN('(max(similarity) * 100)')} AS INT)::VARCHAR || '%' AS warning FROM w GROUP BY doc_id"""
)
def similarity_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets, members = similarity.classes(docs(spark, sf_dir), PAIRS_AT)
    return report.warnings(similarity.compared(sets, PAIRS_AT), members, PAIRS_AT.suspect)


@query(f"WITH {EVAL} SELECT id, total, s0 AS \"功能\", s1 AS \"代码\", s2 AS \"文档\" FROM e")
def dimension_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_dimension(_answered(spark, sf_dir).select("id", "total", "scores"), DIMENSIONS)
