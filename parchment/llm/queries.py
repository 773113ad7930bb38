"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, langid, media, neighbours, packing, pii, quality, resample, simhash, spelling, suffixes, toxicity, urls


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(common.documents(spark, sf_dir))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.store_texts(common.documents(spark, sf_dir)))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.documents(spark, sf_dir))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    days = F.pmod(F.col("page_id") * urls.STRIDE, F.lit(urls.DAYS)).cast("int")
    captures = pages.withColumn("fetched", F.date_add(F.lit(urls.FIRST_DAY).cast("date"), days))
    entries = spark.createDataFrame(urls.ENTRIES, "pattern string, list_name string, kind string, day string, action string")
    found = urls.evaluate(captures, entries)
    return found.select("page_id", "host", F.date_format("fetched", "yyyy-MM-dd").alias("fetched"), "n_active", "active_lists", "blocked")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = langid.held_out(common.documents(spark, sf_dir))
    model = langid.train(docs.where("not held_out"))
    found = langid.identify(docs, model)
    return found.select("doc_id", F.coalesce(common.id_bucket(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(common.documents(spark, sf_dir)))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.documents(spark, sf_dir), common.labels(spark, sf_dir)
    return _scored(quality.score(docs, quality.train(docs, _learnable(labels))))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.documents(spark, sf_dir), common.labels(spark, sf_dir)
    return _scored(toxicity.score(docs, toxicity.train(docs, _learnable(labels))))


def _learnable(labels: DataFrame) -> DataFrame:
    return labels.where(common.id_bucket(F.col("doc_id"), 4) != 2)


def _scored(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.coalesce(common.id_bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir), *tokenizer())


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.counts(common.documents(spark, sf_dir)))


def tokenizer() -> tuple[str, str]:
    """The vocabulary file of byte_bpe_50k, and how it splits texts; the package is on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_array_dedup, op2_media_columns, op3_simhash_near_dedup, op4_url_filters, op5_language_id, op6_quality_classifier, op7_toxicity, op8_packing, op9_pii, op10_decontamination, op11_embedding_near_dedup, op12_importance_resampling, op13_spelling_variants)}


OP4_SQL = f"""
WITH entries(pattern, list_name, kind, day, action) AS (VALUES {", ".join(str(e) for e in urls.ENTRIES)}),
intervals AS (
  SELECT * FROM (
    SELECT pattern, list_name, kind, CAST(day AS DATE) AS start, action,
           lead(CAST(day AS DATE)) OVER (PARTITION BY pattern, list_name, kind ORDER BY CAST(day AS DATE)) AS stop
    FROM entries) WHERE action = 'add'),
captures AS (
  SELECT row_number() OVER () AS rid, page_id, CAST(DATE '{urls.FIRST_DAY}' + CAST((page_id * {urls.STRIDE}) % {urls.DAYS} AS INTEGER) AS DATE) AS fetched,
         nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[0-9a-f:.]+\\]|[^/?#:@\\[]+)', 1), '^www\\.|\\.$', '', 'g'), '') AS host
  FROM pages),
hits AS (
  SELECT c.rid, i.list_name, i.kind, length(i.pattern) AS width
  FROM captures c JOIN intervals i
    ON (c.host = i.pattern OR ends_with(c.host, '.' || i.pattern)) AND i.start <= c.fetched AND (i.stop IS NULL OR c.fetched < i.stop)),
seen AS (
  SELECT rid, count(*) AS n, string_agg(DISTINCT list_name, ',' ORDER BY list_name) AS lists,
         coalesce(max(width) FILTER (WHERE kind = 'block'), -1) > coalesce(max(width) FILTER (WHERE kind = 'allow'), -1) AS blocked
  FROM hits GROUP BY rid)
SELECT page_id, host, strftime(fetched, '%Y-%m-%d') AS fetched, coalesce(n, 0) AS n_active, coalesce(lists, '') AS active_lists, coalesce(blocked, false) AS blocked
FROM captures LEFT JOIN seen USING (rid)
"""


OP11_SQL = f"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_aggregate(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x)), 'max') > 0),
links AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y
    ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= {neighbours.LEAST}),
reach(a, b) AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(l.b, vec_id)) AS component_id, least(vec_id, coalesce(l.b, vec_id)) = vec_id AS kept
FROM embeddings e LEFT JOIN counted c ON e.vec_id = c.a LEFT JOIN least l ON e.vec_id = l.a
"""

#: The table of the CRC of 32 bits, by its polynomial, and how a text's bytes run through it.
CRC_TABLE = "crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def crc_sql(text: str) -> str:
    """The unsigned CRC of `text`, in SQL that has `t` of CRC_TABLE at hand."""
    byte = f"list_transform(range(CAST(length(hex({text})) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex({text}), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {byte}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP12_SQL = rf"""
WITH {CRC_TABLE},
words AS (
  SELECT rid, doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
aimed AS (SELECT unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
distinct_words AS (SELECT DISTINCT w FROM (SELECT w FROM words UNION ALL SELECT w FROM aimed)),
hashed AS (SELECT w, {crc_sql("w")} % {resample.BUCKETS} AS b FROM distinct_words, crc),
s AS (SELECT b, count(*) AS n FROM words JOIN hashed USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM aimed JOIN hashed USING (w) GROUP BY b),
gains AS (
  SELECT b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM words)::DOUBLE + {resample.BUCKETS})
                                 / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM aimed)::DOUBLE + {resample.BUCKETS})))) AS BIGINT) AS g
  FROM (SELECT DISTINCT b FROM hashed) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
weights AS (
  SELECT rid, count(*) AS n_features, CAST(floor(sum(g)::DOUBLE / count(*)) AS BIGINT) AS weight
  FROM words JOIN hashed USING (w) JOIN gains USING (b) GROUP BY rid),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('{resample.SEED}:' || d.doc_id), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM (SELECT row_number() OVER () AS rid, doc_id FROM documents) d LEFT JOIN weights USING (rid)),
ranked AS (
  SELECT *, CASE WHEN n_features >= {resample.LEAST} THEN row_number() OVER (PARTITION BY n_features >= {resample.LEAST} ORDER BY score DESC, doc_id) END AS r FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN r <= {resample.PERCENT} * (SELECT count(*) FROM scored WHERE n_features >= {resample.LEAST}) // 100 THEN r END AS rank
FROM ranked
"""

#: Each accented letter as a sign of one byte, as the distance in SQL is one of bytes.
ACCENTED, SIGNS = "".join(map(chr, range(0xC0, 0x100))), "".join(c for c in map(chr, range(33, 127)) if not c.islower() and c != "'")[:64]
OP13_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= {spelling.SHORTEST} GROUP BY ALL),
hashed AS (SELECT run, n, {crc_sql("doc_id || ':' || run")} AS h FROM runs, crc),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n, translate(word, '{ACCENTED}', '{SIGNS}') AS plain FROM (
    SELECT CASE WHEN h % {spelling.NOISE} = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= {spelling.SHORTEST} GROUP BY word HAVING sum(n) >= {spelling.OFTEN}),
pairs AS (
  SELECT x.word, x.n, y.word AS other, y.n AS m FROM words x JOIN words y
    ON length(y.word) BETWEEN length(x.word) - 1 AND length(x.word) + 1 AND x.word <> y.word AND levenshtein(x.plain, y.plain) = 1),
best AS (SELECT word, n, count(*) AS n_near, max(m) AS m FROM pairs GROUP BY word, n),
forms AS MATERIALIZED (
  SELECT b.word, n_near, CASE WHEN b.m >= {spelling.TIMES} * b.n THEN (SELECT min(other) FROM pairs p WHERE p.word = b.word AND p.m = b.m) END AS form,
         CASE WHEN b.m >= {spelling.TIMES} * b.n THEN b.m END AS form_n FROM best b),
chain(word, here) AS (
  SELECT word, word FROM words
  UNION ALL
  SELECT c.word, f.form FROM chain c JOIN forms f ON c.here = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.here AS root FROM chain c LEFT JOIN forms f ON c.here = f.word WHERE f.form IS NULL)
SELECT w.word, f.form, r.root, w.n, coalesce(f.n_near, 0) AS n_near, f.form_n
FROM words w LEFT JOIN forms f USING (word) JOIN roots r USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filters": OP4_SQL, "op11_embedding_near_dedup": OP11_SQL, "op12_importance_resampling": OP12_SQL, "op13_spelling_variants": OP13_SQL}
