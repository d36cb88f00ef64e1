"""Queries of the core library over the driver's tables, with their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.analyzer import Analyzer, field_tokens, standard_analyzer
from textloom.functions.codec import decode_postings, encode_postings, from_json, key_parts, to_json
from textloom.functions.filters import ENGLISH_STOP_WORDS, lower, stem
from textloom.functions.highlight import HighlightOptions
from textloom.functions.patterns import WHITE_SPACE
from textloom.functions.scoring import Scorer
from textloom.functions.tokenizers import DictionaryTokenizer, HmmTokenizer, SimpleTokenizer, StandardTokenizer, WhitespaceTokenizer
from textloom.model import Posting, TextloomError
from textloom.operators import postings as lists
from textloom.operators.heavy_keys import heavy_keys, once, profile_keys
from textloom.operators.search_index import SearchIndex, add, new_index
from textloom.plans.ast import BooleanQuery, FuzzyQuery, MatchQuery, PhraseQuery, PrefixQuery, Query, TermQuery, TermsQuery
from textloom.runtime import materialize, read_table, shared_dir
from textloom.sources.corpora import corpus, corpus_of_records
from textloom.sources.records import accepted
from textloom.sources.store import KeyValueStore, StoredIndex, is_folder
from textloom.streaming.ingest import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- heavy keys

PROBS = (0.5, 0.9)
#: A key is heavy from this share of its table's rows on.
HEAVY_SHARE = 0.02


def _posting_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Postings with copies dropped and ``tf`` restored from the positions where it is null."""
    p = read_table(spark, folder, "postings").select("shard", "field", "term", "id", F.coalesce("tf", F.size("positions")).alias("tf"))
    return once(p, ["id", "term", "shard"], ["id", "term", "shard", "field"], F.max("tf").alias("tf"))


def _token_rows(spark: SparkSession, folder: str) -> DataFrame:
    t = read_table(spark, folder, "tokens").select("shard", "id", "field", "term", "position")
    return once(t, ["term", "shard", "id"], ["term", "shard", "id", "field", "position"])


def _id_profile(spark: SparkSession, folder: str) -> DataFrame:
    return profile_keys(materialize(_posting_rows(spark, folder), "postings"), "id", ["shard"], "tf", "tf", PROBS)


def _term_profile(spark: SparkSession, folder: str) -> DataFrame:
    return profile_keys(materialize(_token_rows(spark, folder), "tokens"), "term", ["shard", "id"], "position", None, PROBS)


def _spread(profile: DataFrame) -> DataFrame:
    return profile.select("key_value", "n_rows", "occurrences", "records", F.col("q")[0].alias("median"), F.col("q")[1].alias("p90"))


@query(
    """
    WITH p AS (SELECT id, count(*) n FROM (SELECT DISTINCT shard, field, term, id FROM postings) GROUP BY id),
         t AS (SELECT term, count(*) n FROM (SELECT DISTINCT shard, id, field, term, position FROM tokens) GROUP BY term)
    SELECT 'postings.id' AS key_column, id AS key_value FROM p WHERE n >= 0.02 * (SELECT sum(n) FROM p)
    UNION ALL
    SELECT 'tokens.term' AS key_column, term AS key_value FROM t WHERE n >= 0.02 * (SELECT sum(n) FROM t)
    """
)
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of postings and terms of tokens that hold at least ``HEAVY_SHARE`` of their table's rows."""
    p = read_table(spark, folder, "postings").select("shard", "field", "term", "id", F.coalesce("tf", F.size("positions")).alias("tf"))
    t = read_table(spark, folder, "tokens").select("shard", "id", "field", "term", "position")
    ids = heavy_keys(p, "id", ["shard", "field", "term", "id"], "tf", HEAVY_SHARE, PROBS)
    terms = heavy_keys(t, "term", ["shard", "id", "field", "term", "position"], "position", HEAVY_SHARE, PROBS)
    named = lambda name, df: df.where(F.col("key_value").isNotNull()).select(F.lit(name).alias("key_column"), "key_value")
    return named("postings.id", ids).unionByName(named("tokens.term", terms))


@query(
    """
    WITH p AS (SELECT shard, field, term, id, max(coalesce(tf, len(positions))) tf FROM postings GROUP BY ALL)
    SELECT id AS key_value, count(*) AS n_rows, CAST(sum(tf) AS BIGINT) AS occurrences, count(DISTINCT shard) AS records,
           CAST(quantile_disc(tf, 0.5) AS BIGINT) AS median, CAST(quantile_disc(tf, 0.9) AS BIGINT) AS p90
    FROM p GROUP BY id
    """
)
def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, occurrences, shards and exact quantiles of the frequency for every id of postings."""
    return _spread(_id_profile(spark, folder))


@query(
    """
    WITH t AS (SELECT DISTINCT shard, id, field, term, position FROM tokens)
    SELECT term AS key_value, count(*) AS n_rows, count(*) AS occurrences, count(DISTINCT (shard, id)) AS records,
           CAST(quantile_disc(position, 0.5) AS BIGINT) AS median, CAST(quantile_disc(position, 0.9) AS BIGINT) AS p90
    FROM t GROUP BY term
    """
)
def p6_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, records and exact quantiles of the position for every term of tokens."""
    return _spread(_term_profile(spark, folder))


# ------------------------------------------------------------------ analysis

#: Decimal places of scores in results, so that the order of a sum does not show.
DIGITS = 6


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").select("doc_id", "text")


def _exploded(rows: DataFrame, tokens) -> DataFrame:
    return rows.select("doc_id", F.explode(tokens).alias("t")).select("doc_id", "t.*")


def _re2_tokens(pattern: str) -> str:
    return f"""
    WITH x AS (SELECT doc_id, regexp_extract_all(text, '{pattern}') t FROM documents),
         y AS (SELECT doc_id, unnest(t) term, generate_subscripts(t, 1) - 1 AS position FROM x)
    SELECT doc_id, term, CAST(position AS INT) AS position FROM y
    """


@query(_re2_tokens(f"[^{WHITE_SPACE}]+"))
def tok_whitespace(spark: SparkSession, folder: str) -> DataFrame:
    return _exploded(_texts(spark, folder), WhitespaceTokenizer().column(F.col("text")))


@query(_re2_tokens(r"[\p{L}\p{Nd}]+"))
def tok_simple(spark: SparkSession, folder: str) -> DataFrame:
    return _exploded(_texts(spark, folder), SimpleTokenizer().column(F.col("text")))


# RE2 has no look-ahead: a URL is taken up to the next blank and gives back its tail afterwards.
STANDARD_RE2 = (
    rf"(?s)(?i:https?://|www\.)[^{WHITE_SPACE}]*|[\p{{L}}\p{{Nd}}][\p{{L}}\p{{Nd}}._+@\-]*|[^{WHITE_SPACE}]"
)
STANDARD_SQL = f"""
    raw AS (SELECT doc_id, regexp_extract_all(text, '{STANDARD_RE2}') t FROM documents),
    fixed AS (SELECT doc_id, flatten(list_transform(t, lambda x: CASE WHEN regexp_matches(x, '^(?i:https?://|www\\.)') THEN
                 list_concat([rtrim(x, '.,;:!?)]}}')], list_filter(string_split(substr(x, length(rtrim(x, '.,;:!?)]}}')) + 1), ''), lambda y: y <> ''))
                 ELSE [x] END)) t FROM raw),
    std AS (SELECT doc_id, unnest(t) term, generate_subscripts(t, 1) - 1 AS position FROM fixed)
""".replace("\\\\.", "\\.")


@query(f"WITH {STANDARD_SQL} SELECT doc_id, term, CAST(position AS INT) AS position FROM std")
def tok_standard(spark: SparkSession, folder: str) -> DataFrame:
    return _exploded(_texts(spark, folder), StandardTokenizer().column(F.col("text")))


@query(
    f"""
    WITH {STANDARD_SQL}
    SELECT type, count(*) AS n FROM (SELECT CASE
        WHEN regexp_matches(term, '^(?i:https?://|www\\.)') THEN 'url'
        WHEN NOT regexp_matches(term, '^[\\p{{L}}\\p{{Nd}}]') THEN 'symbol'
        WHEN contains(term, '@') THEN 'email'
        WHEN regexp_full_match(term, '[\\p{{Nd}}.,+\\-]+') THEN 'number'
        ELSE 'word' END AS type FROM std) GROUP BY type
    """.replace("\\\\", "\\")
)
def tok_types(spark: SparkSession, folder: str) -> DataFrame:
    """How many tokens of each type the texts have."""
    return _exploded(_texts(spark, folder), StandardTokenizer().column(F.col("text"), types=True)).groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT shard, id, field, term, position, start_offset, end_offset FROM tokens")
def tok_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """All tokens of the current records with byte offsets, which the tokens table holds too."""
    docs = corpus_of_records(read_table(spark, folder, "records"))
    flat = docs.select("id", F.explode("fields").alias("field", "text"))
    rows = flat.select("id", "field", F.explode(standard_analyzer().full(F.col("text"))).alias("t"))
    shard = F.substring_index("id", "/", 1)
    return rows.select(shard.cast("int").alias("shard"), F.expr("substring(id, length(substring_index(id, '/', 1)) + 2)").alias("id"), "field", "t.term", "t.position", "t.start_offset", "t.end_offset")


@query(
    f"""
    WITH {STANDARD_SQL}
    SELECT doc_id, lower(term) AS term, CAST(position AS INT) AS position FROM std
    WHERE lower(term) NOT IN ({", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS)})
    """
)
def pipeline_standard(spark: SparkSession, folder: str) -> DataFrame:
    return _exploded(_texts(spark, folder), standard_analyzer().column(F.col("text")))


@query("SELECT DISTINCT term, lower(term) AS lowered FROM (SELECT unnest(regexp_extract_all(text, '[\\p{L}\\p{Nd}]+')) term FROM documents)")
def filt_lower(spark: SparkSession, folder: str) -> DataFrame:
    words = _exploded(_texts(spark, folder), SimpleTokenizer().column(F.col("text"))).select("term").distinct()
    return words.select("term", lower(F.col("term")).alias("lowered"))


@query(f"SELECT count(*) AS kept FROM (SELECT DISTINCT shard, id, field, position, term FROM tokens) WHERE term NOT IN ({', '.join(repr(w) for w in ENGLISH_STOP_WORDS)})")
def filt_stop(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of the current records that the stop-word filter leaves."""
    docs = corpus_of_records(read_table(spark, folder, "records"))
    tokens = field_tokens(docs, lambda f: standard_analyzer())
    return tokens.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).cast("long").alias("kept"))


@query(
    """
    WITH w AS (SELECT DISTINCT term FROM tokens WHERE term IS NOT NULL),
         c AS (SELECT term, octet_length(encode(term)) n FROM w)
    SELECT term, CASE
        WHEN n > 5 AND ends_with(term, 'ing') THEN
            CASE WHEN length(term) > 4 AND substr(term, length(term) - 3, 1) = substr(term, length(term) - 4, 1) AND ascii(substr(term, length(term) - 3, 1)) < 128
                 THEN substr(term, 1, length(term) - 4) ELSE substr(term, 1, length(term) - 3) END
        WHEN n > 4 AND ends_with(term, 'ied') THEN substr(term, 1, length(term) - 3) || 'y'
        WHEN n > 4 AND ends_with(term, 'ed') THEN substr(term, 1, length(term) - 2)
        WHEN n > 4 AND ends_with(term, 'es') THEN substr(term, 1, length(term) - 2)
        WHEN n > 3 AND ends_with(term, 's') AND NOT ends_with(term, 'ss') THEN substr(term, 1, length(term) - 1)
        ELSE term END AS stem FROM c
    """
)
def filt_stem(spark: SparkSession, folder: str) -> DataFrame:
    """The stem of every distinct term."""
    terms = read_table(spark, folder, "tokens").where(F.col("term").isNotNull()).select("term").distinct()
    return terms.select("term", stem(F.col("term")).alias("stem"))


#: A small word list for the dictionary tokenizer.
WORDS = "索引器 存储层 搜索 搜索页面 页面 查询 查询计划 计划 高亮 高亮服务 服务 分词 分词组件 组件 排序 步骤 词语 频率 写入 缓冲区 停用词 全部 隐藏 重复 记录 的重复 文件头 表达式 在大多数 大多数情况 情况下 重新 重新启动 启动以后".split()
_LONGEST_FIRST = "|".join(sorted(WORDS, key=lambda w: (-len(w), w)))


@query(_re2_tokens(rf"(?:{_LONGEST_FIRST})|\p{{Han}}|(?:[^\P{{L}}\p{{Han}}]|\p{{Nd}})+|[^{WHITE_SPACE}\p{{P}}]"))
def cjk_fmm(spark: SparkSession, folder: str) -> DataFrame:
    """Forward maximum matching."""
    return _exploded(_texts(spark, folder), DictionaryTokenizer(WORDS).column(F.col("text")))


def _signs_back(x: str) -> str:
    """SQL: the code points of a string in reverse order."""
    return f"array_to_string(list_reverse(regexp_extract_all({x}, '(?s).')), '')"


_HAN_RE2 = rf"\p{{Han}}|(?:[^\P{{L}}\p{{Han}}]|\p{{Nd}})+|[^{WHITE_SPACE}\p{{P}}]"
_BACK_RE2 = "(?:" + "|".join(sorted((w[::-1] for w in WORDS), key=lambda w: (-len(w), w))) + ")|" + _HAN_RE2
CUTS_SQL = f"""
    ahead AS (SELECT doc_id, regexp_extract_all(text, '(?:{_LONGEST_FIRST})|{_HAN_RE2}') t FROM documents WHERE text IS NOT NULL),
    back AS (SELECT doc_id, list_transform(list_reverse(regexp_extract_all({_signs_back("text")}, '{_BACK_RE2}')), lambda x: {_signs_back("x")}) t FROM documents WHERE text IS NOT NULL)
"""


def _numbered(source: str) -> str:
    return f"SELECT doc_id, unnest(t) AS term, CAST(generate_subscripts(t, 1) - 1 AS INT) AS position FROM {source}"


@query(f"WITH {CUTS_SQL} {_numbered('back')}")
def cjk_rmm(spark: SparkSession, folder: str) -> DataFrame:
    """Reverse maximum matching."""
    return _exploded(_texts(spark, folder), DictionaryTokenizer(WORDS, "reverse").column(F.col("text")))


@query(
    f"""
    WITH {CUTS_SQL},
    cost AS (SELECT doc_id, a.t f, b.t r, (len(a.t), len(list_filter(a.t, lambda x: length(x) = 1))) cf, (len(b.t), len(list_filter(b.t, lambda x: length(x) = 1))) cr
             FROM ahead a JOIN back b USING (doc_id)),
    best AS (SELECT doc_id, CASE WHEN cr < cf THEN r ELSE f END t FROM cost)
    {_numbered("best")}
    """
)
def cjk_bmm(spark: SparkSession, folder: str) -> DataFrame:
    """The better of both directions."""
    return _exploded(_texts(spark, folder), DictionaryTokenizer(WORDS, "both").column(F.col("text")))


# With the default model every sign has the same probabilities, so the best path depends on the length of a run alone.
_NONE = "'-infinity'::DOUBLE"
HMM_SQL = f"""
    runs AS (SELECT doc_id, regexp_extract_all(text, '\\p{{Han}}+|(?:[^\\P{{L}}\\p{{Han}}]|\\p{{Nd}})+|[^{WHITE_SPACE}\\p{{P}}]') t FROM documents WHERE text IS NOT NULL),
    longest AS (SELECT coalesce(max(list_max(list_transform(t, lambda x: length(x)))), 1) n FROM runs),
    path AS (
        SELECT 1 n, -0.5::DOUBLE + -0.6::DOUBLE b, {_NONE} m, {_NONE} e, -0.8::DOUBLE + -0.9::DOUBLE s, 'B' pb, 'M' pm, 'E' pe, 'S' ps
        UNION ALL
        SELECT n + 1, greatest(e + -0.7::DOUBLE, s + -0.7::DOUBLE) + -0.6::DOUBLE, greatest(b + -0.7::DOUBLE, m + -0.7::DOUBLE) + -0.8::DOUBLE, greatest(b + -0.7::DOUBLE, m + -0.7::DOUBLE) + -0.6::DOUBLE, greatest(e + -0.7::DOUBLE, s + -0.7::DOUBLE) + -0.9::DOUBLE,
               CASE WHEN greatest(e, s) = {_NONE} THEN pb WHEN e + -0.7::DOUBLE >= s + -0.7::DOUBLE THEN pe ELSE ps END || 'B', CASE WHEN b + -0.7::DOUBLE >= m + -0.7::DOUBLE THEN pb ELSE pm END || 'M',
               CASE WHEN b + -0.7::DOUBLE >= m + -0.7::DOUBLE THEN pb ELSE pm END || 'E', CASE WHEN greatest(e, s) = {_NONE} THEN pb WHEN e + -0.7::DOUBLE >= s + -0.7::DOUBLE THEN pe ELSE ps END || 'S'
        FROM path WHERE n < (SELECT n FROM longest)
    ),
    words AS (SELECT n, list_transform(regexp_extract_all(CASE WHEN s > e THEN ps ELSE pe END, '[BM]*[ES]'), lambda w: length(w)) w FROM path),
    flat AS (SELECT doc_id, unnest(t) x, generate_subscripts(t, 1) k FROM runs),
    cut AS (SELECT doc_id, k, CASE WHEN regexp_matches(x, '^\\p{{Han}}') THEN list_transform(range(1, len(w) + 1), lambda i: substr(x, 1 + CAST(coalesce(list_sum(w[1:i - 1]), 0) AS BIGINT), w[i])) ELSE [x] END ws
            FROM flat LEFT JOIN words ON words.n = length(x)),
    seg AS (SELECT doc_id, flatten(list(ws ORDER BY k)) t FROM cut GROUP BY doc_id)
"""


@query(f"WITH RECURSIVE {HMM_SQL} {_numbered('seg')}")
def hmm_default(spark: SparkSession, folder: str) -> DataFrame:
    return _exploded(_texts(spark, folder), HmmTokenizer().column(F.col("text")))


# --------------------------------------------------------------------- index

_indexes: dict[tuple[str, str], SearchIndex] = {}


def records_index(spark: SparkSession, folder: str) -> SearchIndex:
    """The index of all current records, written once per session and folder and then only read."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _indexes:
        _indexes[key] = SearchIndex.written(corpus_of_records(read_table(spark, folder, "records")))
    return _indexes[key]


def _joined(positions=None):
    """Positions as text, which every engine compares alike."""
    return F.array_join(F.col("positions") if positions is None else positions, ",").alias("positions")


TOK = """
    tok AS (SELECT DISTINCT shard || '/' || id AS id, field, term, position FROM tokens),
    pos AS (SELECT field, term, id, CAST(count(*) AS INT) tf, list(position ORDER BY position) positions FROM tok GROUP BY field, term, id),
    tfs AS (SELECT field, term, id, CAST(count(*) AS INT) tf FROM tok GROUP BY field, term, id),
    nn AS (SELECT sum(document_count)::DOUBLE n FROM stats),
    dl AS (SELECT id, field, count(*) len FROM tok GROUP BY id, field),
    av AS (SELECT field, sum(len) / (SELECT n FROM nn) mean FROM dl GROUP BY field),
    dic AS (SELECT field, term, count(*) df, CAST(sum(tf) AS BIGINT) total_tf FROM tfs GROUP BY field, term),
    win AS (SELECT *, count(*) OVER (PARTITION BY field, term) df, sum(tf) OVER (PARTITION BY id, field) len FROM tfs),
    sc AS (SELECT win.*, ln(1 + ((SELECT n FROM nn) - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len / mean)) s
           FROM win JOIN av USING (field)),
    docs AS (SELECT shard || '/' || id AS id, fields FROM (
        SELECT *, row_number() OVER (PARTITION BY shard, id ORDER BY seq DESC) rn
        FROM (SELECT DISTINCT seq, shard, id, fields FROM records
              WHERE id IS NOT NULL AND trim(id) <> '' AND fields IS NOT NULL AND cardinality(fields) > 0)) WHERE rn = 1)
"""


@query(f"WITH {TOK} SELECT id, field, term, tf, array_to_string(positions, ',') AS positions FROM pos")
def idx_postings(spark: SparkSession, folder: str) -> DataFrame:
    return records_index(spark, folder).tables.postings.select("id", "field", "term", "tf", _joined())


@query(f"WITH {TOK} SELECT field, term, df, total_tf FROM dic")
def idx_terms(spark: SparkSession, folder: str) -> DataFrame:
    return records_index(spark, folder).tables.terms.select("field", "term", "df", "total_tf")


@query("SELECT DISTINCT shard || '/' || id AS id, field, len FROM doclen")
def idx_doclen(spark: SparkSession, folder: str) -> DataFrame:
    return records_index(spark, folder).tables.doclen.select("id", "field", "len")


@query(
    """
    WITH t AS (SELECT unnest(map_entries(total_field_length)) e FROM stats)
    SELECT e.key AS field, CAST(sum(e.value) AS BIGINT) AS total, (SELECT CAST(sum(document_count) AS BIGINT) FROM stats) AS documents FROM t GROUP BY e.key
    """
)
def idx_stats(spark: SparkSession, folder: str) -> DataFrame:
    n, totals = records_index(spark, folder).stats()
    return spark.createDataFrame([(f, total, n) for f, total in totals.items()], "field string, total long, documents long")


@query(f"WITH {TOK} SELECT id FROM docs")
def all_ids(spark: SparkSession, folder: str) -> DataFrame:
    return records_index(spark, folder).all_ids()


@query(f"WITH {TOK} SELECT term, df, total_tf FROM dic WHERE field = 'content' AND starts_with(term, 'co')")
def terms_prefix(spark: SparkSession, folder: str) -> DataFrame:
    return records_index(spark, folder).terms("content", "co")


@query(f"WITH {TOK} SELECT id, tf, array_to_string(positions, ',') AS positions FROM pos WHERE field = 'content' AND term = 'parser'")
def term_postings(spark: SparkSession, folder: str) -> DataFrame:
    return records_index(spark, folder).postings("content", "parser").withColumn("positions", _joined())


def _error(call) -> str:
    """Name of the library's error that a call ends with, or nothing."""
    try:
        call()
        return ""
    except TextloomError as e:
        return type(e).__name__


@query(
    f"""
    WITH {TOK} SELECT '0/shared/glossary' AS id, (SELECT fields['title'] FROM docs WHERE id = '0/shared/glossary') AS title, '' AS error
    UNION ALL SELECT 'no such id', NULL, 'DocumentMissingError'
    """
)
def document_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by id, by the reader's method; an unknown id is an error."""
    index = records_index(spark, folder)
    rows = [("0/shared/glossary", index.document("0/shared/glossary").get("title"), ""), ("no such id", None, _error(lambda: index.document("no such id")))]
    return spark.createDataFrame(rows, "id string, title string, error string")


@query(
    """
    SELECT DISTINCT field, CAST(len AS BIGINT) AS len, '' AS error FROM doclen WHERE shard = 0 AND id = 'shared/glossary'
    UNION ALL SELECT 'no such id', 0, 'DocumentMissingError'
    """
)
def metadata_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Field lengths of one document, by the reader's method; an unknown id is an error."""
    index = records_index(spark, folder)
    rows = [(f, n, "") for f, n in index.metadata("0/shared/glossary").items()]
    return spark.createDataFrame([*rows, ("no such id", 0, _error(lambda: index.metadata("no such id")))], "field string, len long, error string")


PROBED = ("storage", "parser", "snapshot", "no-such-term")


@query(
    f"""
    WITH {TOK}, w AS (SELECT unnest({list(PROBED)}) term)
    SELECT term, coalesce(df, 0) AS df, coalesce(total_tf, 0) AS total_tf FROM w LEFT JOIN (SELECT * FROM dic WHERE field = 'content') USING (term)
    """
)
def term_info(spark: SparkSession, folder: str) -> DataFrame:
    """Dictionary entries by the reader's method; zeros for an unknown term."""
    index = records_index(spark, folder)
    return spark.createDataFrame([(t, *index.term_info("content", t)) for t in PROBED], "term string, df long, total_tf long")


# -------------------------------------------------------------------- search


def _hits(spark: SparkSession, folder: str, q: Query, limit: int = 0) -> DataFrame:
    return records_index(spark, folder).search(q, limit, DIGITS).select("id", "score")


def _string(spark: SparkSession, folder: str, expression: str) -> DataFrame:
    return records_index(spark, folder).search_string(expression, "content", 0, DIGITS).select("id", "score")


def _sum_sql(terms: list[str], field: str = "content", having: str = "", factor: str = "1") -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"SELECT id, sum(s * {factor}) score FROM sc WHERE field = '{field}' AND term IN ({listed}) GROUP BY id {having}"


def _scored(sql: str) -> str:
    return f"WITH {TOK}, h AS ({sql}) SELECT id, round(score, {DIGITS}) AS score FROM h"


@query(
    f"""
    WITH {TOK} SELECT id, round(s, {DIGITS}) AS score, 'BM25(content:parser, tf=' || tf || ')' AS explanation
    FROM sc WHERE field = 'content' AND term = 'parser'
    """
)
def term_query(spark: SparkSession, folder: str) -> DataFrame:
    return records_index(spark, folder).search(TermQuery("content", "parser"), digits=DIGITS)


@query(_scored(_sum_sql(["storage", "layer", "parser"])))
def match_or(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(spark, folder, MatchQuery("content", "The storage layer and the Parser parser"))


@query(_scored(_sum_sql(["storage", "layer", "parser"], having="HAVING count(*) = 3")))
def match_and(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(spark, folder, MatchQuery("content", "storage layer parser", "and"))


@query(f"WITH {TOK}, h AS ({_sum_sql(['storage', 'layer', 'parser'])}) SELECT id, round(score, {DIGITS}) AS score FROM h ORDER BY round(score, {DIGITS}) DESC, id LIMIT 10")
def search_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best hits: the flagship query."""
    return _hits(spark, folder, MatchQuery("content", "storage layer parser"), 10)


def _bool_sql(body: str) -> str:
    leaf = {"a": "storage", "b": "parser", "c": "crawler", "d": "snapshot"}
    ctes = ", ".join(f"{k} AS (SELECT id, s score FROM sc WHERE field = 'content' AND term = '{t}')" for k, t in leaf.items())
    return f"WITH {TOK}, {ctes}, h AS ({body}) SELECT id, round(score, {DIGITS}) AS score FROM h"


def _t(term: str) -> TermQuery:
    return TermQuery("content", term)


@query(_bool_sql("SELECT id, a.score + b.score score FROM a JOIN b USING (id)"))
def bool_must(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(spark, folder, BooleanQuery(must=(_t("storage"), _t("parser"))))


@query(_bool_sql("SELECT id, coalesce(a.score, 0) + coalesce(b.score, 0) score FROM a FULL JOIN b USING (id)"))
def bool_should(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(spark, folder, BooleanQuery(should=(_t("storage"), _t("parser"))))


@query(_bool_sql("SELECT id, a.score + coalesce(b.score, 0) score FROM a LEFT JOIN b USING (id) WHERE id NOT IN (SELECT id FROM c)"))
def bool_must_should(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(spark, folder, BooleanQuery(must=(_t("storage"),), should=(_t("parser"),), must_not=(_t("crawler"),)))


@query(_bool_sql("SELECT id, 0.0::DOUBLE score FROM docs WHERE id NOT IN (SELECT id FROM a UNION SELECT id FROM b)"))
def bool_mustnot_only(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(spark, folder, BooleanQuery(must_not=(_t("storage"), _t("parser"))))


@query(
    _bool_sql(
        """
        SELECT id, coalesce(a.score, 0) + coalesce(d.score, 0) score FROM docs LEFT JOIN a USING (id) LEFT JOIN d USING (id) LEFT JOIN b USING (id) LEFT JOIN c USING (id)
        WHERE a.score IS NOT NULL OR (d.score IS NOT NULL AND c.score IS NULL) OR b.score IS NULL
        """.replace("coalesce(d.score, 0)", "CASE WHEN d.score IS NOT NULL AND c.score IS NULL THEN d.score ELSE 0 END")
    )
)
def bool_nested(spark: SparkSession, folder: str) -> DataFrame:
    """a OR (d AND NOT c) OR NOT b: pure negation inside a disjunction."""
    inner = BooleanQuery(must=(_t("snapshot"),), must_not=(_t("crawler"),))
    return _hits(spark, folder, BooleanQuery(should=(_t("storage"), inner, BooleanQuery(must_not=(_t("parser"),)))))


def _phrase_sql(terms: list[str], gaps: list[int], slop: int) -> str:
    """Chains of positions: from each start the earliest next occurrence, at most ``slop`` longer in all."""
    chain = "SELECT id, position first, position place, 0 used FROM tok WHERE field = 'content' AND term = '{}'".format(terms[0])
    for t, g in zip(terms[1:], gaps):
        chain = (
            f"SELECT c.id, c.first, min(k.position) place, any_value(c.used) + min(k.position) - any_value(c.place) - {g} used FROM ({chain}) c "
            f"JOIN tok k ON k.id = c.id AND k.field = 'content' AND k.term = '{t}' AND k.position >= c.place + {g} GROUP BY c.id, c.first"
        )
    listed = " UNION ALL ".join(f"SELECT id, s FROM sc WHERE field = 'content' AND term = '{t}'" for t in terms)
    return (
        f"WITH {TOK}, m AS (SELECT DISTINCT id FROM ({chain}) WHERE used <= {slop}), l AS ({listed}) "
        f"SELECT id, round(sum(s) * 1.5, {DIGITS}) AS score FROM l JOIN m USING (id) GROUP BY id"
    )


@query(_phrase_sql(["stale", "snapshot"], [1], 0))
def phrase_slop0(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(spark, folder, PhraseQuery("content", "stale snapshot"))


@query(_phrase_sql(["because", "clock", "drifted."], [2, 1], 0))
def phrase_gap(spark: SparkSession, folder: str) -> DataFrame:
    """A stop word inside the phrase leaves its gap."""
    return _hits(spark, folder, PhraseQuery("content", "because the clock drifted."))


@query(_phrase_sql(["storage", "empty", "values"], [1, 1], 6))
def phrase_slop2(spark: SparkSession, folder: str) -> DataFrame:
    """Up to six positions further apart than written."""
    return _hits(spark, folder, PhraseQuery("content", "storage empty values", 6))


@query(f"WITH {TOK} SELECT id, round(sum(s), {DIGITS}) AS score FROM sc WHERE field = 'content' AND starts_with(term, 'comp') GROUP BY id")
def prefix_query(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(spark, folder, PrefixQuery("content", "Comp"))


FUZZY_SQL = """
    WITH {tok}, e AS (SELECT *, levenshtein(regexp_replace(term, '[^\\x00-\\x7F]', chr(1), 'g'), '{word}') d FROM sc
                    WHERE field = '{field}' AND length(term) BETWEEN {low} AND {high})
    SELECT id, round(sum(s / (d + 1)), {digits}) AS score FROM e WHERE d <= {edits} GROUP BY id
"""


def _fuzzy_sql(field: str, word: str, edits: int) -> str:
    return FUZZY_SQL.format(tok=TOK, word=word, field=field, low=len(word) - edits, high=len(word) + edits, edits=edits, digits=DIGITS)


@query(_fuzzy_sql("content", "indxer", 1))
def fuzzy_query(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(spark, folder, FuzzyQuery("content", "Indxer"))


@query(_fuzzy_sql("content", "reprots", 3))
def fuzzy_boost(spark: SparkSession, folder: str) -> DataFrame:
    """Nearer terms weigh more; more than three edits mean three."""
    return _hits(spark, folder, FuzzyQuery("content", "reprots", 9))


@dataclass(frozen=True)
class EndingQuery(TermsQuery):
    """A leaf that is not of the library: terms with an ending, longer ones weighing less."""

    field: str
    ending: str

    def matching(self, terms: DataFrame) -> DataFrame:
        return terms.where(F.col("term").endswith(self.ending)).withColumn("weight", F.lit(1.0) / F.char_length("term"))

    def scan(self):
        return F.col("term").endswith(self.ending)


class TfIdf(Scorer):
    """A scorer that is not of the library."""

    name = "tf-idf"

    def column(self, tf, df, n, dl, avgdl):
        return tf * F.ln(F.lit(float(n)) / df)


@query(
    f"""
    WITH {TOK}, e AS (SELECT id, sum(s / length(term)) x FROM sc WHERE field = 'content' AND ends_with(term, 'ing') GROUP BY id),
         b AS (SELECT id FROM sc WHERE field = 'content' AND term = 'parser')
    SELECT id, round(x, {DIGITS}) AS score FROM e WHERE id NOT IN (SELECT id FROM b)
    """
)
def own_query(spark: SparkSession, folder: str) -> DataFrame:
    """A leaf of the user's own inside a Boolean query."""
    return _hits(spark, folder, BooleanQuery(must=(EndingQuery("content", "ing"),), must_not=(_t("parser"),)))


@query(
    f"""
    WITH {TOK} SELECT id, round(tf * ln((SELECT n FROM nn) / df), {DIGITS}) AS score, 'tf-idf(content:parser, tf=' || tf || ')' AS explanation
    FROM sc WHERE field = 'content' AND term = 'parser'
    """
)
def own_scorer(spark: SparkSession, folder: str) -> DataFrame:
    """A scorer of the user's own."""
    index = records_index(spark, folder)
    return SearchIndex(index.tables, index.config.with_scorer(TfIdf())).search(TermQuery("content", "parser"), digits=DIGITS)


@query(_bool_sql("""
    SELECT id, coalesce(x.score, 0) + coalesce(y.score, 0) score FROM
    (SELECT id, sum(s) * 1.5 score FROM sc WHERE field = 'content' AND term IN ('stale', 'snapshot') AND id IN (
        SELECT u.id FROM tok u JOIN tok v ON u.id = v.id AND u.field = 'content' AND v.field = 'content' AND u.term = 'stale' AND v.term = 'snapshot' AND v.position = u.position + 1) GROUP BY id) x
    FULL JOIN (SELECT id, s score FROM sc WHERE field = 'title' AND term = 'tuning') y USING (id)"""))
def qs_phrase_or(spark: SparkSession, folder: str) -> DataFrame:
    return _string(spark, folder, 'content:"stale snapshot" OR title:tuning')


@query(_bool_sql("SELECT id, a.score + 0.0 score FROM a WHERE id NOT IN (SELECT id FROM b)"))
def qs_and_not(spark: SparkSession, folder: str) -> DataFrame:
    return _string(spark, folder, "content:storage AND NOT content:parser")


@query(_bool_sql("SELECT id, coalesce(a.score, 0) score FROM docs LEFT JOIN a USING (id) LEFT JOIN b USING (id) WHERE a.score IS NOT NULL OR b.score IS NULL"))
def qs_implicit_or(spark: SparkSession, folder: str) -> DataFrame:
    """Two clauses side by side are an OR, also with NOT."""
    return _string(spark, folder, "storage NOT parser")


@query(_bool_sql("SELECT id, coalesce(a.score, 0) + coalesce(b.score, 0) + d.score score FROM d LEFT JOIN a USING (id) LEFT JOIN b USING (id) WHERE a.score IS NOT NULL OR b.score IS NOT NULL"))
def qs_grouped(spark: SparkSession, folder: str) -> DataFrame:
    return _string(spark, folder, "(storage or PARSER) and snapshot")


# ------------------------------------------------- facets, highlight, set operations

HITS_SQL = "SELECT DISTINCT id FROM sc WHERE field = 'content' AND term = 'parser'"


@query(f"WITH {TOK} SELECT fields['category'] AS value, count(*) AS count FROM docs WHERE id IN ({HITS_SQL}) AND fields['category'] IS NOT NULL GROUP BY 1")
def facet_category(spark: SparkSession, folder: str) -> DataFrame:
    return records_index(spark, folder).facet(MatchQuery("content", "parser"), "category")


@query(f"WITH {TOK} SELECT fields['lang'] AS value, count(*) AS count FROM docs WHERE fields['lang'] IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def facet_lang(spark: SparkSession, folder: str) -> DataFrame:
    """The five most frequent labels over all documents."""
    return records_index(spark, folder).facet(BooleanQuery(must_not=(TermQuery("content", ""),)), "lang", 5)


@query(
    """
    WITH h AS (SELECT CAST(doc_id AS VARCHAR) id, source FROM documents
               WHERE list_contains(list_transform(regexp_extract_all(text, '[\\p{L}\\p{Nd}]+'), lambda x: lower(x)), 'parser'))
    SELECT source AS value, count(*) AS count FROM h WHERE source IS NOT NULL GROUP BY source
    """
)
def facet_source(spark: SparkSession, folder: str) -> DataFrame:
    """Facets over another corpus with another analyzer: simple tokens, lower case."""
    from textloom.functions.filters import LowercaseFilter
    from textloom.operators.search_index import IndexConfig

    d = read_table(spark, folder, "documents")
    index = SearchIndex.of_documents(corpus(d, "doc_id", {"text": "text", "source": "source"}), IndexConfig(Analyzer(SimpleTokenizer(), [LowercaseFilter()])))
    return index.facet(MatchQuery("text", "PARSER"), "source")


def _fragments_sql(pages: str, most: int, size: int = 160, escape: bool = True) -> str:
    """Fragments of ``content`` around "stale" and "snapshot" for the ids of ``pages``, from the offsets in tokens; bytes are pairs of hexadecimal digits."""

    def text(a: str, b: str, h: str = "h") -> str:
        out = f"decode(unhex(substr({h}, 2 * CAST({a} AS BIGINT) + 1, 2 * CAST(({b}) - ({a}) AS BIGINT))))"
        for sign, name in (("'&'", "&amp;"), ("chr(39)", "&#39;"), ("'<'", "&lt;"), ("'>'", "&gt;"), ("chr(34)", "&#34;")) if escape else ():
            out = f"replace({out}, {sign}, '{name}')"
        return out

    inside = lambda at: f"{at} > 0 AND {at} < total AND substr(h, 2 * CAST({at} AS BIGINT) + 1, 1) IN ('8', '9', 'A', 'B')"
    back = "CASE WHEN NOT ({0}) THEN s WHEN NOT ({1}) THEN s - 1 WHEN NOT ({2}) THEN s - 2 ELSE s - 3 END".format(inside("s"), inside("(s - 1)"), inside("(s - 2)"))
    on = "CASE WHEN NOT ({0}) THEN e WHEN NOT ({1}) THEN e + 1 WHEN NOT ({2}) THEN e + 2 ELSE e + 3 END".format(inside("e"), inside("(e + 1)"), inside("(e + 2)"))
    return f"""
        WITH {TOK}, page AS ({pages}),
        m AS (SELECT DISTINCT shard || '/' || id AS id, start_offset a, end_offset b FROM tokens WHERE field = 'content' AND term IN ('stale', 'snapshot') AND shard || '/' || id IN (SELECT id FROM page)),
        g AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY a) grp FROM (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY id ORDER BY a) <= {size} THEN 0 ELSE 1 END fresh FROM m)),
        q AS (SELECT id, grp, min(a) f, max(b) l FROM g WHERE grp <= {most} GROUP BY id, grp),
        w AS (SELECT q.*, hex(encode(fields['content'])) h, octet_length(encode(fields['content'])) total, greatest(0, f - greatest(0, {size} - (l - f)) // 2) s0 FROM q JOIN docs USING (id)),
        x AS (SELECT *, CASE WHEN greatest(s0 + {size}, l) > total THEN greatest(0, total - {size}) ELSE s0 END s, CASE WHEN greatest(s0 + {size}, l) > total THEN total ELSE greatest(s0 + {size}, l) END e FROM w),
        y AS (SELECT id, grp, h, total, {back} s, {on} e FROM x),
        z AS (SELECT y.*, m.a, m.b, coalesce(lag(m.b) OVER (PARTITION BY y.id, y.grp ORDER BY m.a), y.s) p FROM y JOIN m ON m.id = y.id AND m.a >= y.s AND m.b <= y.e)
        SELECT id, CAST(grp AS INT) AS n, CAST(s AS INT) AS start, CAST(e AS INT) AS stop,
               string_agg({text("p", "a")} || '<em>' || {text("a", "b")} || '</em>', '' ORDER BY a) || {text("max(b)", "e", "any_value(h)")} AS text
        FROM z GROUP BY id, grp, s, e
    """


def _fragments(rows: DataFrame) -> DataFrame:
    rows = rows.select("id", F.posexplode("fragments").alias("n", "f"))
    return rows.select("id", (F.col("n") + 1).alias("n"), F.col("f.start").alias("start"), F.col("f.end").alias("stop"), F.col("f.text").alias("text"))


@query(_fragments_sql("SELECT DISTINCT id FROM sc WHERE field = 'content' AND term IN ('stale', 'snapshot')", 2))
def highlight_basic(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments of all hits."""
    index = records_index(spark, folder)
    return _fragments(index.highlight(index.hits(MatchQuery("content", "stale snapshot")), "content", ["stale", "snapshot"], HighlightOptions(max_fragments=2)))


_BEST_SQL = f"SELECT id FROM ({_sum_sql(['stale', 'snapshot'])}) ORDER BY round(score, {DIGITS}) DESC, id LIMIT 10"


@query(_fragments_sql(_BEST_SQL, 2))
def highlight_page(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments of the ten best hits."""
    index = records_index(spark, folder)
    best = materialize(_hits(spark, folder, MatchQuery("content", "stale snapshot"), 10), "best")
    return _fragments(index.highlight(best, "content", ["stale", "snapshot"], HighlightOptions(max_fragments=2)))


@query(_fragments_sql(_BEST_SQL, 1, escape=False))
def highlight_plain(spark: SparkSession, folder: str) -> DataFrame:
    """The same by options of which nothing is set: default tags and sizes, and no escapes."""
    index = records_index(spark, folder)
    best = materialize(_hits(spark, folder, MatchQuery("content", "stale snapshot"), 10), "best")
    return _fragments(index.highlight(best, "content", ["stale", "snapshot"], HighlightOptions.unset()))


def _list(spark: SparkSession, folder: str, term: str) -> DataFrame:
    return records_index(spark, folder).tables.postings.where((F.col("field") == "content") & (F.col("term") == term)).select("id", "tf", "positions")


@query(f"WITH {TOK} SELECT id, tf, array_to_string(positions, ',') AS positions FROM pos WHERE field = 'content' AND term = 'storage' AND id IN (SELECT id FROM pos WHERE field = 'content' AND term = 'parser')")
def postings_intersect(spark: SparkSession, folder: str) -> DataFrame:
    return lists.intersect(_list(spark, folder, "storage"), _list(spark, folder, "parser")).withColumn("positions", _joined())


@query(
    f"""
    WITH {TOK}, l AS (SELECT id, tf, array_to_string(positions, ',') AS positions FROM pos WHERE field = 'content' AND term = 'storage'), r AS (SELECT id, tf, array_to_string(positions, ',') AS positions FROM pos WHERE field = 'content' AND term = 'parser')
    SELECT * FROM l UNION ALL SELECT * FROM r WHERE id NOT IN (SELECT id FROM l)
    """
)
def postings_union(spark: SparkSession, folder: str) -> DataFrame:
    return lists.union(_list(spark, folder, "storage"), _list(spark, folder, "parser")).withColumn("positions", _joined())


@query(f"WITH {TOK} SELECT id, tf, array_to_string(positions, ',') AS positions FROM pos WHERE field = 'content' AND term = 'storage' AND id >= '0/doc-00000200'")
def skip_to(spark: SparkSession, folder: str) -> DataFrame:
    return lists.skip_to(_list(spark, folder, "storage"), "0/doc-00000200").withColumn("positions", _joined())


@query(f"WITH {TOK} SELECT field, term, id, tf, array_to_string(positions, ',') AS positions FROM pos")
def posting_codec(spark: SparkSession, folder: str) -> DataFrame:
    """All postings of all fields encoded to bytes and decoded again."""
    p = records_index(spark, folder).tables.postings
    back = p.select("field", "term", decode_postings(encode_postings(F.col("id"), F.col("positions"))).alias("p"))
    return back.select("field", "term", "p.id", "p.tf", _joined(F.col("p.positions")))


def _varint_sql(x: str) -> str:
    """Hexadecimal digits of a number below 2**21 as a varint."""
    return f"CASE WHEN {x} < 128 THEN printf('%02X', {x}) WHEN {x} < 16384 THEN printf('%02X%02X', ({x} & 127) | 128, {x} >> 7) ELSE printf('%02X%02X%02X', ({x} & 127) | 128, (({x} >> 7) & 127) | 128, {x} >> 14) END"


@query(
    f"""
    WITH {TOK}, p AS (SELECT field, term, id, hex(encode(id)) h, CAST(octet_length(encode(id)) AS BIGINT) n, CAST(tf AS BIGINT) tf,
        list_transform(list_zip(positions, list_prepend(0, positions[:-2])), lambda x: CAST(x[1] - x[2] AS BIGINT)) steps FROM pos)
    SELECT field, term, id, {_varint_sql("n")} || h || {_varint_sql("tf")} || {_varint_sql("tf")} || array_to_string(list_transform(steps, lambda d: {_varint_sql("d")}), '') AS bytes FROM p
    """
)
def posting_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """The bytes of all postings of all fields, in hexadecimal."""
    p = records_index(spark, folder).tables.postings
    return p.select("field", "term", "id", F.hex(encode_postings(F.col("id"), F.col("positions"))).alias("bytes"))


@query("SELECT DISTINCT id, rtrim(replace(replace(base64(encode(id)), '+', '-'), '/', '_'), '=') AS part FROM records WHERE id IS NOT NULL")
def key_codec(spark: SparkSession, folder: str) -> DataFrame:
    """Path-safe key components of all ids."""
    return read_table(spark, folder, "records").where(F.col("id").isNotNull()).select("id").distinct().select("id", key_parts(F.col("id")).alias("part"))


# --------------------------------------------------------------- maintenance


def _summary(index: SearchIndex) -> DataFrame:
    """Everything that a change of an index shows in: the dictionary of all fields, total lengths, lengths by document, and stored fields."""
    t = index.tables
    n, totals = index.stats()
    none = F.lit(None).cast("string").alias("term")
    terms = t.terms.select(F.lit("term").alias("kind"), "field", "term", "df", "total_tf")
    total = t.documents.sparkSession.createDataFrame([("total", f, None, n, x) for f, x in totals.items()], "kind string, field string, term string, df long, total_tf long")
    lengths = t.doclen.groupBy("field").agg(F.count("*").alias("df"), F.sum("len").cast("long").alias("total_tf")).select(F.lit("lengths").alias("kind"), "field", none, "df", "total_tf")
    stored = t.documents.select(F.explode(F.map_keys("fields")).alias("field")).groupBy("field").agg(F.count("*").alias("df"))
    stored = stored.select(F.lit("stored").alias("kind"), "field", none, "df", F.lit(0).cast("long").alias("total_tf"))
    return terms.unionByName(total).unionByName(lengths).unionByName(stored)


def _summary_sql(tokens: str, docs: str) -> str:
    """The same from rows ``id, field, term, tf`` and ``id, fields``."""
    return f"""
        , k AS ({tokens}), d AS ({docs}),
        f AS (SELECT id, unnest(map_keys(fields)) field, unnest(map_values(fields)) v FROM d),
        l AS (SELECT field, count(*) df, CAST(sum(coalesce(n, 0)) AS BIGINT) total FROM f LEFT JOIN (SELECT id, field, sum(tf) n FROM k GROUP BY id, field) USING (id, field) WHERE v IS NOT NULL GROUP BY field)
        SELECT 'term' AS kind, field, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total_tf FROM k GROUP BY field, term
        UNION ALL SELECT 'total', field, NULL, (SELECT count(*) FROM d), total FROM l
        UNION ALL SELECT 'lengths', field, NULL, df, total FROM l
        UNION ALL SELECT 'stored', field, NULL, count(*), 0 FROM f WHERE v IS NOT NULL GROUP BY field
    """


_stores: dict[tuple[str, str], StoredIndex] = {}


def _new_store(spark: SparkSession) -> StoredIndex:
    return StoredIndex(spark, f"{shared_dir(spark)}/textloom/index-{uuid.uuid4().hex}")


def _stored(spark: SparkSession, folder: str) -> StoredIndex:
    """A stored index of its own that begins as that of all current records, which is written once per session and folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _stores:
        _stores[key] = _new_store(spark)
        _stores[key].write(lambda _: records_index(spark, folder))
    return _stores[key].fork(f"{shared_dir(spark)}/textloom/index-{uuid.uuid4().hex}")


@query(
    f"WITH {TOK}, gone AS (SELECT id FROM docs WHERE fields['category'] = 'book')"
    + _summary_sql(
        """
        SELECT id, field, term, tf FROM tfs WHERE id NOT IN (SELECT id FROM gone)
        UNION ALL SELECT id, 'content', 'renewed', 1 FROM gone UNION ALL SELECT id, 'category', 'book', 1 FROM gone
        """,
        "SELECT id, fields FROM docs WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT id, MAP {'content': 'Renewed', 'category': 'book'} FROM gone",
    )
)
def upsert_batch(spark: SparkSession, folder: str) -> DataFrame:
    """All documents of one category get the content "Renewed": the old terms go, the new one comes. The change is a segment of a stored index."""
    store = _stored(spark, folder)
    some = store.snapshot().tables.documents.where(F.col("fields").getItem("category") == "book")
    new = some.select("id", F.create_map(F.lit("content"), F.lit("Renewed"), F.lit("category"), F.lit("book")).alias("fields"))
    return _summary(store.add_batch(new))


@query(f"WITH {TOK}" + _summary_sql("SELECT id, field, term, tf FROM tfs", "SELECT id, fields FROM docs"))
def upsert_repeated(spark: SparkSession, folder: str) -> DataFrame:
    """All accepted rows of the log in one batch, in which ids repeat: of each the last in the order of arrival stays."""
    rows = read_table(spark, folder, "records").where(accepted(F.col("id"), F.col("fields")))
    rows = rows.select(F.concat_ws("/", F.col("shard").cast("string"), "id").alias("id"), F.map_filter("fields", lambda k, v: v.isNotNull()).alias("fields"), "seq")
    store = _new_store(spark)
    return _summary(store.add_batch(rows, "seq"))


@query(f"WITH {TOK}" + _summary_sql("SELECT id, field, term, tf FROM tfs WHERE NOT ends_with(id, '/shared/glossary')", "SELECT id, fields FROM docs WHERE NOT ends_with(id, '/shared/glossary')"))
def delete_docs(spark: SparkSession, folder: str) -> DataFrame:
    """The glossary of every shard is deleted from a stored index."""
    store = _stored(spark, folder)
    return _summary(store.delete_all(store.snapshot().tables.documents.where(F.col("id").endswith("/shared/glossary"))))


@query(
    f"""
    WITH {TOK} SELECT call, error, (SELECT count(*) FROM docs) AS documents FROM (VALUES
        ('blank id', 'InvalidDocumentError'), ('no fields', 'InvalidDocumentError'), ('blank field', 'InvalidDocumentError'), ('repeated id', 'InvalidDocumentError'),
        ('delete unknown', 'DocumentMissingError'), ('delete blank', 'InvalidDocumentError'), ('closed', 'StoreClosedError')) t(call, error)
    """
)
def refused_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Every change that is refused, with its error and the number of documents after it: each leaves the stored index as it was."""
    store = _stored(spark, folder)
    batch = lambda *rows: spark.createDataFrame([("good", {"content": "x"}), *rows], "id string, fields map<string,string>")
    calls = {
        "blank id": lambda: store.add_batch(batch((" ", {"content": "x"}))), "no fields": lambda: store.add_batch(batch(("b", {}))), "blank field": lambda: store.add_batch(batch(("b", {" ": "x"}))),
        "repeated id": lambda: store.add_batch(batch(("good", {"content": "y"}))), "delete unknown": lambda: store.delete("no such id"), "delete blank": lambda: store.delete(" "),
    }
    rows = [(name, _error(call), store.snapshot().stats()[0]) for name, call in calls.items()]
    n = store.snapshot().stats()[0]
    store.close()
    return spark.createDataFrame([*rows, ("closed", _error(store.snapshot), n)], "call string, error string, documents long")


@query(f"WITH {TOK} SELECT field, term, df, total_tf FROM dic")
def rebuild_equal(spark: SparkSession, folder: str) -> DataFrame:
    """Derived anew from the stored documents, the dictionary is the same."""
    return records_index(spark, folder).rebuild().tables.terms.select("field", "term", "df", "total_tf")


@query(f"WITH {TOK} SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM dic) AS terms, (SELECT count(*) FROM pos) AS postings, 0::BIGINT AS n_problems")
def check_report(spark: SparkSession, folder: str) -> DataFrame:
    return records_index(spark, folder).check().withColumnRenamed("problems", "n_problems")


@query(
    f"""
    WITH {TOK} SELECT 'term' AS kind, field, term, df + 1 AS counted, df AS found FROM dic WHERE starts_with(term, 'pa')
    UNION ALL SELECT 'term', 'content', 'no-such-term', 5, 0
    UNION ALL SELECT 'documents', NULL, NULL, (SELECT count(*) FROM docs) + 1, (SELECT count(*) FROM docs)
    """
)
def check_damaged(spark: SparkSession, folder: str) -> DataFrame:
    """The problems of an index of which some counts are wrong, one entry is made up and the number of documents is off."""
    t = records_index(spark, folder).tables
    off = t.terms.withColumn("df", F.col("df") + F.when(F.col("term").startswith("pa"), 1).otherwise(0))
    made_up = spark.createDataFrame([("content", "no-such-term", 5, 5)], "field string, term string, df long, total_tf long")
    stats = t.stats.withColumn("document_count", F.col("document_count") + 1)
    return SearchIndex(replace(t, terms=off.unionByName(made_up), stats=stats)).problems()


@query(f"WITH {TOK} SELECT field, term, df, total_tf FROM dic")
def segmented_index(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of each of five parts added one batch after the other, each a segment; the whole is the same."""
    docs = records_index(spark, folder).tables.documents
    store = _new_store(spark)
    for part in range(5):
        store.add_batch(docs.where(F.pmod(F.xxhash64("id"), F.lit(5)) == part))
    return store.snapshot().tables.terms.select("field", "term", "df", "total_tf")


@query(
    """
    SELECT '/target/' || source AS key, CAST(CAST(round(target_share * 1000) AS BIGINT) AS VARCHAR) || '!' AS value FROM source_targets WHERE max_repeat > 1
    UNION ALL SELECT '/target', 'rolled back: ValueError'
    """
)
def key_value_store(spark: SparkSession, folder: str) -> DataFrame:
    """Puts, deletes, a transaction and one that fails on a key-value store, then all keys under a prefix.

    The targets of the sources are put one by one and all of them again in one
    transaction, which also deletes some; a key under another prefix stays out
    of sight.
    """
    rows = [(r["source"], str(round(r["target_share"] * 1000)), r["max_repeat"]) for r in read_table(spark, folder, "source_targets").collect()]
    store = KeyValueStore(spark)
    for source, share, _ in rows:
        store.put(f"/target/{source}".encode(), share.encode())
    store.put(b"/other", b"out of sight")

    def again(tx) -> None:
        for source, _, repeat in rows:
            key = f"/target/{source}".encode()
            tx.put(key, tx.get(key) + b"!")
            if repeat <= 1:
                tx.delete(key)

    def failing(tx) -> None:
        tx.put(b"/target/none", b"never seen")
        raise ValueError

    store.transaction(again)
    try:
        store.transaction(failing)
    except ValueError as e:
        store.put(b"/target", f"rolled back: {type(e).__name__}".encode())
    return store.table(b"/target").select(F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"))


@query(f"WITH {TOK} SELECT field, term, df, total_tf FROM dic")
def stored_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index published as a new version of a stored one and read back."""
    return _stored(spark, folder).snapshot().tables.terms.select("field", "term", "df", "total_tf")


@query(
    """
    WITH t AS (SELECT source, max_repeat, row_number() OVER (ORDER BY source) n FROM source_targets), k AS (SELECT * FROM t WHERE n > 1),
    w AS (SELECT 'source' AS field, lower(source) AS term FROM k UNION ALL SELECT 'repeat', CAST(max_repeat AS VARCHAR) FROM k WHERE n > 2 UNION ALL SELECT 'repeat', unnest(['seldom', 'seldom']) FROM k WHERE n = 2)
    SELECT field, term, count(*) - CASE WHEN term = 'seldom' THEN 1 ELSE 0 END AS df, count(*) AS total_tf FROM w GROUP BY field, term
    """
)
def temporary_index(spark: SparkSession, folder: str) -> DataFrame:
    """An index in memory: a document for each source added one at a time, the first then deleted and the second put in place again."""
    rows = sorted((r["source"], str(r["max_repeat"])) for r in read_table(spark, folder, "source_targets").collect())
    index = new_index(spark)
    for source, repeat in rows:
        index = add(index, source, {"source": source, "repeat": repeat})
    index = add(index.delete(rows[0][0]), rows[1][0], {"source": rows[1][0], "repeat": "seldom seldom"})
    out = index.tables.terms.select("field", "term", "df", "total_tf")
    index.close()
    return out


@query(
    """
    SELECT "case", CAST(hits AS BIGINT) AS hits FROM (VALUES ('empty Boolean', 0), ('Boolean of empty Booleans', 0), ('no query', 0), ('empty term', 0), ('empty match', 0), ('empty phrase', 0), ('stop words only', 0), ('unknown field', 0)) t("case", hits)
    UNION ALL SELECT 'nothing excluded', CAST(sum(document_count) AS BIGINT) FROM stats
    """
)
def empty_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Queries without content match nothing; only the negation of nothing matches all."""
    index = records_index(spark, folder)
    cases = {
        "empty Boolean": BooleanQuery(), "Boolean of empty Booleans": BooleanQuery(must=(BooleanQuery(),)), "no query": None, "empty term": TermQuery("content", ""), "empty match": MatchQuery("content", ""),
        "empty phrase": PhraseQuery("content", ""), "stop words only": MatchQuery("content", "the and of", "and"), "unknown field": TermQuery("nowhere", "parser"), "nothing excluded": BooleanQuery(must_not=(TermQuery("content", ""),)),
    }
    return spark.createDataFrame([(name, index.search(q).count()) for name, q in cases.items()], "case string, hits long")


@query("SELECT source AS text, 0 AS position, lower(source) AS term, 0 AS start_offset, CAST(octet_length(encode(source)) AS INT) AS end_offset FROM source_targets UNION ALL SELECT 'again', 1, 'end', 4, 7")
def token_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The cursor over tokens, reset from text to text; the last text has a stop word and another token."""
    stream, rows = standard_analyzer().stream(""), []
    texts = [(r["source"], r["source"]) for r in read_table(spark, folder, "source_targets").select("source").collect()]
    for name, text in [*texts, ("again", "the end")]:
        stream.reset(text)
        while stream.next():
            t = stream.token
            rows.append((name, t.position, t.term, t.start_offset, t.end_offset))
    return spark.createDataFrame(rows, "text string, position int, term string, start_offset int, end_offset int")


@query(f"""
    WITH {TOK}, p AS (SELECT id, tf FROM tfs WHERE field = 'content' AND term = 'parser'), w AS (SELECT unnest(['', '0/doc', '0/doc-00000200', '1/', '1/shared', '9']) target)
    SELECT target, first AS id, coalesce(tf, 0) AS tf FROM (SELECT target, (SELECT min(id) FROM p WHERE id >= target) first FROM w) LEFT JOIN p ON id = first
    """)
def posting_cursor(spark: SparkSession, folder: str) -> DataFrame:
    """Where the cursor over one term's postings stands after jumps to ascending targets."""
    found = records_index(spark, folder).postings("content", "parser").collect()
    cursor, rows = lists.PostingCursor([Posting(r["id"], tuple(r["positions"])) for r in found]), []
    for target in ("", "0/doc", "0/doc-00000200", "1/", "1/shared", "9"):
        cursor.skip_to(target)
        rows.append((target, cursor.key, cursor.posting.frequency if cursor.valid else 0))
    return spark.createDataFrame(rows, "target string, id string, tf int")


@query("""
    WITH t AS (SELECT unnest(map_entries(total_field_length)) e FROM stats)
    SELECT '{"field":"' || e.key || '","total":' || CAST(sum(e.value) AS BIGINT) || '}' AS json, e.key AS field, CAST(sum(e.value) AS BIGINT) AS total FROM t GROUP BY e.key
    """)
def json_codec(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata of the index as JSON and read back."""
    _, totals = records_index(spark, folder).stats()
    coded = [to_json({"field": f, "total": n}) for f, n in totals.items()]
    return spark.createDataFrame([(c.decode(), from_json(c)["field"], from_json(c)["total"]) for c in coded], "json string, field string, total long")


@query("SELECT lower(source) AS term, count(*) AS df, count(*) AS total_tf FROM documents WHERE source IS NOT NULL GROUP BY 1")
def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as a stream into a stored index; the terms of their source."""
    base = f"{shared_dir(spark)}/textloom/stream-{uuid.uuid4().hex}"
    store = StoredIndex(spark, f"{base}/index")
    schema = read_table(spark, folder, "documents").schema
    # a stream reads folders: the table's own, or the one that holds its single file
    reader = spark.readStream.schema(schema)
    table = f"{folder}/documents.parquet"
    rows = reader.parquet(table) if is_folder(spark, table) else reader.option("pathGlobFilter", "documents.parquet").parquet(folder)
    ingest(corpus(rows, "doc_id", {"text": "text", "source": "source"}), store, f"{base}/checkpoint").awaitTermination()
    return store.snapshot().terms("source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
