"""Queries of the training-text operators over the driver's tables, with their SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.distinctiveness import distinctiveness, leading_terms
from textloom.llm.language import fit, labelled_sample, paragraph_languages, relabelled
from textloom.llm.mixing import EXACT, mix, mix_shares
from textloom.llm.near_duplicates import bags_of_terms, groups, linked_records, record_pairs, similar_pairs
from textloom.llm.packing import fill, pack
from textloom.llm.pii import find_pii, redact_pii
from textloom.llm.pii import fit as fit_pii
from textloom.llm.term_counts import mark, term_counts
from textloom.llm.token_sizes import token_sizes
from textloom.llm.visual_form import character_table, visual_form
from textloom.operators.counted_join import join_counted
from textloom.runtime import materialize, read_table
from textloom.sources.records import current_records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


CURRENT_SQL = """
    cur AS (SELECT seq, shard, id, fields FROM (
        SELECT *, row_number() OVER (PARTITION BY shard, id ORDER BY seq DESC) rn
        FROM (SELECT DISTINCT seq, shard, id, fields FROM records
              WHERE id IS NOT NULL AND trim(id) <> '' AND fields IS NOT NULL AND cardinality(fields) > 0)) WHERE rn = 1)
"""


def _n_records(spark: SparkSession, folder: str) -> int:
    """The number of current records, from the clean per-shard statistics."""
    return read_table(spark, folder, "stats").agg(F.sum("document_count")).first()[0] or 0


# ------------------------------------------------------------ 1: near duplicates

#: Terms in both contents are at least this share of the terms in either.
SIMILARITY = (7, 10)


def _content_pairs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    content = read_table(spark, folder, "tokens").where(F.col("field") == "content")
    bags = bags_of_terms(content, ["shard", "id"], "term")
    current = current_records(read_table(spark, folder, "records"))
    return similar_pairs(materialize(bags.join(current, ["shard", "id"]).select("seq", "items"), "bags"), "seq", SIMILARITY)


PAIRS_SQL = f"""
    {CURRENT_SQL},
    bag AS (SELECT DISTINCT seq, term FROM tokens JOIN cur USING (shard, id) WHERE field = 'content' AND term IS NOT NULL),
    size AS (SELECT seq, count(*) n FROM bag GROUP BY seq),
    both_ AS (SELECT a.seq a, b.seq b, count(*) c FROM bag a JOIN bag b USING (term) WHERE a.seq < b.seq GROUP BY ALL),
    pair AS (SELECT a, b FROM both_ JOIN size x ON x.seq = a JOIN size y ON y.seq = b WHERE 10 * c >= 7 * (x.n + y.n - c))
"""


@query(f"WITH {PAIRS_SQL} SELECT a AS seq_a, b AS seq_b FROM pair")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of current records whose contents share at least 70 % of their distinct terms."""
    members, pairs = _content_pairs(spark, folder)
    return record_pairs(members, pairs, "seq").select(F.col("a").alias("seq_a"), F.col("b").alias("seq_b"))


@query(
    f"""
    WITH RECURSIVE {PAIRS_SQL}, edge AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair UNION ALL SELECT seq, seq FROM size),
    reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b)
    SELECT a AS seq, min(b) AS group_seq FROM reach GROUP BY a
    """
)
def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The group of near-duplicate contents that each current record belongs to."""
    members, pairs = _content_pairs(spark, folder)
    return groups(members, pairs, "seq").withColumnRenamed("group", "group_seq")


@query(
    f"""
    WITH {PAIRS_SQL}, l AS (SELECT seq, count(b) links FROM size LEFT JOIN (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair) ON a = seq GROUP BY seq),
    k AS (SELECT seq, array_to_string(list(term ORDER BY term), chr(1)) k FROM bag GROUP BY seq)
    SELECT seq, min(seq) OVER (PARTITION BY k) AS class_seq, links FROM l JOIN k USING (seq)
    """
)
def p1_links(spark: SparkSession, folder: str) -> DataFrame:
    """The class of equal contents of each current record and the number of records it is similar to, without writing out pairs."""
    members, pairs = _content_pairs(spark, folder)
    return linked_records(members, pairs, "seq").withColumnRenamed("class", "class_seq")


@query(
    f"""
    WITH {CURRENT_SQL},
    bag AS (SELECT seq, term, count(DISTINCT position) c FROM tokens JOIN cur USING (shard, id) WHERE field = 'content' AND term IS NOT NULL GROUP BY seq, term),
    size AS (SELECT seq, sum(c) n FROM bag GROUP BY seq),
    both_ AS (SELECT a.seq a, b.seq b, sum(least(a.c, b.c)) c FROM bag a JOIN bag b USING (term) WHERE a.seq < b.seq GROUP BY ALL),
    pair AS (SELECT a, b FROM both_ JOIN size x ON x.seq = a JOIN size y ON y.seq = b WHERE 10 * c >= 7 * (x.n + y.n - c)),
    l AS (SELECT seq, count(b) links FROM size LEFT JOIN (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair) ON a = seq GROUP BY seq),
    k AS (SELECT seq, array_to_string(list(term || chr(2) || c ORDER BY term), chr(1)) k FROM bag GROUP BY seq)
    SELECT seq, min(seq) OVER (PARTITION BY k) AS class_seq, links FROM l JOIN k USING (seq)
    """
)
def p1_bags(spark: SparkSession, folder: str) -> DataFrame:
    """Like ``p1_links`` with bags of terms: how often a term occurs counts too, and the overlap is that of multisets."""
    content = read_table(spark, folder, "tokens").where(F.col("field") == "content").select("shard", "id", "term", "position").distinct()
    bags = bags_of_terms(content, ["shard", "id"], "term", multiset=True)
    current = current_records(read_table(spark, folder, "records"))
    members, pairs = similar_pairs(materialize(bags.join(current, ["shard", "id"]).select("seq", "items"), "bags"), "seq", SIMILARITY)
    return linked_records(members, pairs, "seq").withColumnRenamed("class", "class_seq")


# ------------------------------------------------- 2: how distinctive a term is

GL2_SQL = """
    n AS (SELECT sum(document_count)::DOUBLE n FROM stats),
    p AS (SELECT field, term, shard, id, max(coalesce(tf, len(positions))) tf FROM postings GROUP BY ALL),
    d AS (SELECT field, term, count(*) df FROM p GROUP BY ALL),
    l AS (SELECT shard, id, field, max(len) len FROM doclen GROUP BY ALL),
    a AS (SELECT field, sum(len) / any_value(n.n) mean FROM l, n GROUP BY field),
    s AS (SELECT p.shard, p.id, p.field, p.term, p.tf, d.df, df / n.n pr,
                 p.tf * log2(1 + a.mean / greatest(l.len, 1)) tfn
          FROM p JOIN d USING (field, term) LEFT JOIN l USING (shard, id, field) LEFT JOIN a USING (field), n),
    g AS (SELECT *, (log2(1 + pr) + tfn * log2((1 + pr) / pr)) / (tfn + 1) score FROM s)
"""


@query(
    f"""
    WITH {GL2_SQL}, r AS (
        SELECT probe_id, term, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, tf DESC, term) rn
        FROM g JOIN probes USING (shard, id) WHERE field = 'content' AND score IS NOT NULL)
    SELECT probe_id, term FROM r WHERE rn = 1
    """
)
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The term of ``content`` that sets each probe's record apart most."""
    probes = read_table(spark, folder, "probes")
    content = F.col("field") == "content"
    scores = distinctiveness(
        read_table(spark, folder, "postings").where(content),
        read_table(spark, folder, "doclen").where(content),
        _n_records(spark, folder),
        of=probes,
    )
    scores = materialize(scores.join(probes, ["shard", "id"]).select("probe_id", "term", "tf", "score"), "scores")
    return leading_terms(scores, ["probe_id"])


@query(f"WITH {GL2_SQL} SELECT shard, id, field, term, CAST(tf AS BIGINT) AS tf, df, round(score, 6) AS score FROM g")
def p2_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every term of every record's field with its score."""
    scores = distinctiveness(read_table(spark, folder, "postings"), read_table(spark, folder, "doclen"), _n_records(spark, folder))
    return scores.withColumn("tf", F.col("tf").cast("long")).withColumn("score", F.round("score", 6))


# ------------------------------------------------------- 3: frequency of terms

#: A term is common from this share of all records on.
COMMON_SHARE = 0.1


@query(
    """
    WITH n AS (SELECT sum(document_count) n FROM stats),
         t AS (SELECT term, count(DISTINCT (shard, id)) r FROM tokens WHERE field = 'content' GROUP BY term)
    SELECT term, CASE WHEN r = 1 THEN 'rare' ELSE 'common' END AS mark FROM t, n WHERE r = 1 OR r * 10 >= n.n
    """
)
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of ``content`` that are too rare or too common to be useful."""
    n = _n_records(spark, folder)
    counts = term_counts(read_table(spark, folder, "tokens").where(F.col("field") == "content"), place=("position",))
    return counts.select("term", mark(F.col("records"), n, COMMON_SHARE).alias("mark")).where(F.col("mark").isNotNull())


@query(
    """
    WITH n AS (SELECT sum(document_count) n FROM stats),
         u AS (SELECT DISTINCT term, shard, id, field, position FROM tokens WHERE term IS NOT NULL),
         t AS (SELECT term, count(*) occurrences, count(DISTINCT (shard, id)) records FROM u GROUP BY term)
    SELECT term, occurrences, records,
           CASE WHEN records = 1 THEN 'rare' WHEN records * 10 >= n.n THEN 'common' END AS mark FROM t, n
    """
)
def p3_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences and records of every distinct term over all fields and shards, with its mark."""
    n = _n_records(spark, folder)
    counts = term_counts(read_table(spark, folder, "tokens"))
    return counts.withColumn("mark", mark(F.col("records"), n, COMMON_SHARE))


# ------------------------------------------------ 4: one form for what looks alike


def _quoted(s: str) -> str:
    """A SQL expression for any string."""
    return " || ".join(f"chr({ord(c)})" for c in s) or "''"


def _forms_sql(source: str) -> str:
    """SQL for the forms of ``k, v``: characters one by one by a table, then composed. Half-width sound marks become combining ones, which compose too."""
    rows = ", ".join(f"({ord(c)}, {_quoted(new)})" for c, new in character_table())
    return f"""
        look(c, t) AS (VALUES {rows}),
        src AS ({source}),
        chars AS (SELECT k, unnest(t) ch, generate_subscripts(t, 1) i FROM (SELECT k, regexp_extract_all(v, '(?s).') t FROM src)),
        form AS (SELECT k, nfc_normalize(string_agg(coalesce(t, ch), '' ORDER BY i)) form FROM chars LEFT JOIN look ON c = unicode(ch) GROUP BY k
                 UNION ALL SELECT k, v FROM src WHERE v IS NULL OR v = '')
    """


TITLES_SQL = f"{CURRENT_SQL}, " + _forms_sql("SELECT seq k, fields['title'] v FROM cur")


@query(
    f"""
    WITH {TITLES_SQL}, t AS (SELECT k, v, form FROM src JOIN form USING (k) WHERE v IS NOT NULL)
    SELECT least(a.k, b.k) AS seq_a, greatest(a.k, b.k) AS seq_b FROM t a JOIN t b USING (form) WHERE a.v < b.v
    """
)
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of current records whose titles differ but look the same.

    Distinct titles are paired inside their form first, and only then spread to
    their records, so records that share one title never meet each other.
    """
    titles = current_records(read_table(spark, folder, "records"), "title").where(F.col("title").isNotNull())
    rows = materialize(titles.select("seq", "title", visual_form(F.col("title")).alias("form")), "titles")
    forms = rows.groupBy("form").agg(F.min("title").alias("lo"), F.max("title").alias("hi")).where(F.col("lo") < F.col("hi")).select("form")
    some = materialize(rows.join(forms, "form", "left_semi"), "alike")
    kinds = some.select("form", "title").distinct()
    a = kinds.select("form", F.col("title").alias("ta"))
    b = kinds.select("form", F.col("title").alias("tb"))
    pairs = a.join(b, "form").where(F.col("ta") < F.col("tb")).select("ta", "tb")
    left = some.select(F.col("seq").alias("sa"), F.col("title").alias("ta"))
    right = some.select(F.col("seq").alias("sb"), F.col("title").alias("tb"))
    out = pairs.join(left, "ta").join(right, "tb")
    return out.select(F.least("sa", "sb").alias("seq_a"), F.greatest("sa", "sb").alias("seq_b"))


@query(
    f"""
    WITH {TITLES_SQL}, t AS (SELECT k, v, form FROM src JOIN form USING (k) WHERE v IS NOT NULL)
    SELECT k AS seq, min(k) OVER (PARTITION BY form) AS class_seq, n AS titles FROM t JOIN (SELECT form, count(DISTINCT v) n FROM t GROUP BY form) USING (form)
    """
)
def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The class of current records whose titles look the same, and how many different titles it has: one row for each record, whatever the size of a class."""
    titles = current_records(read_table(spark, folder, "records"), "title").where(F.col("title").isNotNull())
    rows = materialize(titles.select("seq", "title", visual_form(F.col("title")).alias("form")), "titles")
    kinds = rows.groupBy("form", "title").agg(F.min("seq").alias("seq"), F.count("*").alias("n"))
    classes = materialize(kinds.groupBy("form").agg(F.min("seq").alias("class_seq"), F.count("*").alias("titles"), F.sum("n").alias("n")), "classes")
    return join_counted(rows, classes, ["form"], "n").select("seq", "class_seq", "titles")


@query(
    f"""
    WITH {CURRENT_SQL}, {_forms_sql("SELECT seq * 2 k, fields['title'] v FROM cur UNION ALL SELECT seq * 2 + 1, fields['content'] FROM cur")}
    SELECT seq, t.form AS title, c.form AS content FROM cur JOIN form t ON t.k = seq * 2 JOIN form c ON c.k = seq * 2 + 1
    """
)
def p4_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Title and content of every current record in the one form."""
    rows = current_records(read_table(spark, folder, "records"), "title", "content")
    return rows.select("seq", visual_form(F.col("title")).alias("title"), visual_form(F.col("content")).alias("content"))


@query(
    f"""
    WITH {_forms_sql("SELECT DISTINCT term k, term v FROM tokens WHERE term IS NOT NULL")}
    SELECT form, count(*) AS terms FROM form GROUP BY form HAVING count(*) > 1
    """
)
def p4_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Forms that several distinct terms of tokens share, with the number of those terms."""
    terms = read_table(spark, folder, "tokens").where(F.col("term").isNotNull()).select("term").distinct()
    forms = terms.select(visual_form(F.col("term")).alias("form"))
    return forms.groupBy("form").agg(F.count("*").alias("terms")).where("terms > 1")


# ----------------------------------------------------------- 5: language labels


def _paragraphs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Current records (seq, content, lang) as a table, and their paragraphs with languages."""
    rows = materialize(current_records(read_table(spark, folder, "records"), "content", "lang").select("seq", "content", "lang"), "records")
    model = fit(*labelled_sample(rows, "content", "lang", "seq"))
    return rows, paragraph_languages(rows.where(F.length("content") > 0), "seq", "content", model)


@query()
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Language of each paragraph of the records whose label is missing or wrong or that mix languages."""
    rows, paras = _paragraphs(spark, folder)
    paras = materialize(paras.select("seq", "para", "lang"), "paragraphs")
    return relabelled(paras, rows.select("seq", F.col("lang").alias("label")), "seq", "label")


@query()
def p5_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Language and confidence of every paragraph, and of the whole content, of every current record."""
    return _paragraphs(spark, folder)[1]


# --------------------------------------------------------- 7: filling containers


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(token_sizes(read_table(spark, folder, "documents"), "text", ["doc_id", "source"]), "sizes")


@query()
def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every text, or of every piece of a text above the capacity, for each kind of container."""
    return pack(_sizes(spark, folder), read_table(spark, folder, "containers"))


@query(
    """
    SELECT container_kind AS kind, (SELECT count(*) FROM documents) AS texts, 0::BIGINT AS overfull, 0::BIGINT AS cut_small, 0::BIGINT AS gaps_or_overlaps, 0::BIGINT AS could_merge FROM containers
    """
)
def p7_sound(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of a packing, for each kind: how many texts it has, and how often something is wrong.

    Wrong are containers above the capacity, texts cut though they fit, pieces
    that do not follow each other from token 0 to the last, and, beyond one,
    containers that are not even half full: best fit puts two such together.
    """
    sizes, containers = _sizes(spark, folder), read_table(spark, folder, "containers")
    packed = materialize(pack(sizes, containers), "packed")
    caps = F.broadcast(containers.select(F.col("container_kind").alias("kind"), F.col("capacity_tokens").cast("long").alias("cap")))
    texts = packed.groupBy("kind", "doc_id").agg(F.count("*").alias("n"), F.min("first_token").alias("lo"), F.max(F.col("first_token") + F.col("tokens")).alias("hi"), F.sum("tokens").alias("sum"))
    texts = texts.join(sizes.select("doc_id", F.col("n_tokens").alias("all")), "doc_id").join(caps, "kind")
    odd = (F.col("lo") != 0) | (F.col("hi") != F.col("all")) | (F.col("sum") != F.col("all"))
    how_many = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    by_text = texts.groupBy("kind").agg(F.count("*").alias("texts"), how_many((F.col("all") <= F.col("cap")) & (F.col("n") > 1)).alias("cut_small"), how_many(odd).alias("gaps_or_overlaps"))
    load = packed.groupBy("kind", "container").agg(F.sum("tokens").alias("load")).join(caps, "kind")
    low = how_many(F.col("load") * 2 <= F.col("cap"))
    by_load = load.groupBy("kind").agg(how_many(F.col("load") > F.col("cap")).alias("overfull"), F.greatest(low - 1, F.lit(0)).alias("could_merge"))
    return by_text.join(by_load, "kind").select("kind", "texts", "overfull", "cut_small", "gaps_or_overlaps", "could_merge")


@query()
def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Texts, tokens and fill of every container."""
    containers = read_table(spark, folder, "containers")
    return fill(pack(_sizes(spark, folder), containers), containers)


# ------------------------------------------------------------- 8: mixing sources


@query()
def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen texts with their number of copies."""
    return mix(_sizes(spark, folder), read_table(spark, folder, "source_targets"))


@query()
def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted and reached share of each source, in a mixture as large as the collection."""
    targets = read_table(spark, folder, "source_targets")
    return mix_shares(mix(_sizes(spark, folder), targets), targets)


@query(
    """
    SELECT source, (SELECT count(*) FROM documents d WHERE d.source = t.source AND length(text) > 0) > 0 AS has_texts, 0::BIGINT AS unknown, 0::BIGINT AS repeated_too_often, 0::BIGINT AS twice, true AS share_reached
    FROM source_targets t
    """
)
def p8_sound(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the mixture that meets every share: no unknown text, none more often than allowed, none in two rows, and each share within a thousandth.

    Copies of a source are spread over its texts in order of size, so its
    tokens differ from the wanted ones by some of the longest texts at most.
    """
    sizes, targets = _sizes(spark, folder), read_table(spark, folder, "source_targets")
    chosen = materialize(mix(sizes, targets, EXACT), "chosen")
    few = F.broadcast(targets.select("source", "max_repeat", "target_share"))
    per = chosen.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.sum("copies").alias("copies"))
    per = per.join(sizes.select(F.col("doc_id").alias("d"), F.col("source").alias("s")), F.col("doc_id") == F.col("d"), "left").join(few, "source")
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    bad = per.groupBy("source").agg(
        count(F.col("s").isNull() | (F.col("s") != F.col("source"))).alias("unknown"), count(F.col("copies") > F.col("max_repeat")).alias("repeated_too_often"), count(F.col("n") > 1).alias("twice")
    )
    longest = sizes.groupBy("source").agg(F.max("n_tokens").alias("longest"))
    shares = mix_shares(chosen, targets)
    total = shares.agg(F.sum("tokens")).first()[0] or 1
    weight = targets.agg(F.sum("target_share")).first()[0] or 1.0
    rows = shares.join(bad, "source", "left").join(F.broadcast(longest), "source", "left")
    off = F.abs(F.col("tokens") - F.col("target_share") / F.lit(float(weight)) * F.lit(float(total)))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("source", F.col("longest").isNotNull().alias("has_texts"), zero("unknown"), zero("repeated_too_often"), zero("twice"), (off <= 0.001 * total + 2 * F.coalesce("longest", F.lit(0))).alias("share_reached"))


@query()
def p8_exact_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted and reached share of each source, in the largest mixture that meets every share."""
    targets = read_table(spark, folder, "source_targets")
    return mix_shares(mix(_sizes(spark, folder), targets, EXACT), targets)


# -------------------------------------------------------- 9: personal information


@query()
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of personal information in every text."""
    return find_pii(read_table(spark, folder, "documents"), "doc_id", "text", fit_pii())


@query()
def p9_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every text with placeholders in place of personal information."""
    return redact_pii(read_table(spark, folder, "documents"), "doc_id", "text", fit_pii())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
