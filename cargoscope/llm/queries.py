"""Registered queries of the subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargoscope.llm import (conversation_trie, decontaminate, html_extract, katz, language_id,
                            license_scan, merkle, mixing, near_dup, quality_knn, quality_rules, secrets, token_counts)
from cargoscope.llm.common import crc_mod, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


WORDS_SQL = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  WHERE 100 * c >= 80 * (p.n + q.n - c)
), edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d
  UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON r.other = e.a
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP7_WORDS_SQL = rf"regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP7_SQL = rf"""
WITH i AS (SELECT item_id, {OP7_WORDS_SQL} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, m, array_to_string(w[k:k + m - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k
        FROM i WHERE len(w) > 0)
), d AS (SELECT row_number() OVER () AS r, doc_id, {OP7_WORDS_SQL} AS w FROM documents
), places AS (
  SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS k
  FROM d CROSS JOIN (SELECT DISTINCT m FROM windows) WHERE len(w) >= m
), hits AS (
  SELECT r, k, p.m, item_id FROM (SELECT r, m, k, array_to_string(w[k:k + m - 1], ' ') AS g FROM places) p
  JOIN windows v ON v.m = p.m AND v.g = p.g
), covered AS (
  SELECT r, count(DISTINCT c) AS n FROM (SELECT r, unnest(range(k, k + m)) AS c FROM hits) GROUP BY r
), found AS (
  SELECT r, count(*) AS n, string_agg(t, ',' ORDER BY t) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS t FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit,
       coalesce(found.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       covered.n IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""


@register("op1_license_scan")
def op1_license_scan(spark, sf_dir):
    """Licence passages of every document, with the best Dice coefficient."""
    found = license_scan.find_licenses(tables(spark, sf_dir, "documents").select("doc_id", "text"),
                                       keep=["doc_id"])
    ids = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"])))
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_passages"),
        F.array_join(ids, ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("licenses", lambda x: x["dice"])), F.lit(0.0))
        .alias("best_dice"),
        F.array_join(F.transform("licenses", lambda x: F.concat_ws(
            ":", x["license"], x["start"].cast("string"), x["end"].cast("string"))), ",")
        .alias("spans"))


@register("op2_near_dup", OP2_SQL)
def op2_near_dup(spark, sf_dir):
    """Components of documents linked by four-word shingles."""
    return near_dup.near_duplicates(tables(spark, sf_dir, "documents").select("doc_id", "text"),
                                    shingle=4)


def _held_out(mod: int, rest: int) -> Column:
    return F.coalesce(crc_mod("doc_id", mod) == rest, F.lit(False))


QUALITY_FROM = 0.3


@register("op3_quality_knn")
def op3_quality_knn(spark, sf_dir):
    """Quality of every document, learnt from the labels outside the held-out fifth."""
    docs = tables(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_knn.fit(docs, tables(spark, sf_dir, "labels"), use=~_held_out(5, 0))
    return quality_knn.score(docs, model, keep=["doc_id"]).select(
        "doc_id", _held_out(5, 0).alias("held_out"), "score",
        (F.col("score") >= QUALITY_FROM).cast("int").alias("predicted"))


def _digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


@register("op4_secrets")
def op4_secrets(spark, sf_dir):
    """Secret spans of every document."""
    found = secrets.find_secrets(tables(spark, sf_dir, "documents").select("doc_id", "text"),
                                 keep=["doc_id"])

    def n(kind):
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")

    base = F.filter("secrets", lambda x: x["kind"] != "literal")
    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"),
        n("hex").alias("n_hex"), F.sha2(_digest(base).cast("binary"), 256).alias("base_sha256"),
        _digest(F.col("secrets")).alias("spans"))


@register("op5_katz")
def op5_katz(spark, sf_dir):
    """Katz and add-one scores of every document, learnt outside the held-out seventh."""
    docs = tables(spark, sf_dir, "documents").select("doc_id", "text")
    scores = katz.fit_and_score(docs, ~_held_out(7, 2)).scores
    return scores.select("doc_id", _held_out(7, 2).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")


@register("op6_html_extract")
def op6_html_extract(spark, sf_dir):
    """Main text of every page."""
    return html_extract.extract(tables(spark, sf_dir, "pages").select("page_id", "url", "html"),
                                keep=["page_id", "url"])


@register("op7_decontaminate", OP7_SQL)
def op7_decontaminate(spark, sf_dir):
    """Benchmark windows of ten words found in every document."""
    hits = decontaminate.find_hits(
        tables(spark, sf_dir, "documents").select("doc_id", "text"),
        tables(spark, sf_dir, "benchmark"), keep=["doc_id", "text"])
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, h: acc + h["len"])
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"))


TOKEN_LIMIT = 512


@register("op8_token_counts")
def op8_token_counts(spark, sf_dir):
    """Tokens of every document by the public byte-level vocabulary."""
    import public_tokenizers

    counts = token_counts.count_tokens(
        tables(spark, sf_dir, "documents").select("doc_id", "text"),
        public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


OP9_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, {WORDS_SQL} AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), starts AS (
  SELECT r, ws, unnest(range(1, len(ws) - {quality_rules.WINDOW - 2})) AS i FROM w
), grams AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(ws[i:i + {quality_rules.WINDOW - 1}], ' ')) AS c
  FROM starts
), covered AS (
  SELECT r, least({quality_rules.WINDOW},
                  coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, {quality_rules.WINDOW})) AS n
  FROM grams WHERE c > 1
), repeats AS (SELECT r, sum(n)::BIGINT AS n FROM covered GROUP BY r
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         len(list_filter(ws, lambda x: list_contains({_sql_list(quality_rules.STOP_WORDS)}, lower(x))))::BIGINT
           AS n_stop_words,
         coalesce(repeats.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN repeats USING (r)
), j AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 3.0 AND 10.0
         AND n_symbols / n_words <= 0.1 AND n_stop_words / n_words >= 0.03
         AND coalesce(n_dup_lines / nullif(n_lines, 0) <= 0.5, true) AS kept
FROM j
"""


@register("op9_quality_rules", OP9_SQL)
def op9_quality_rules(spark, sf_dir):
    """Length, symbol, stop-word and line ratios of every document."""
    docs = tables(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.apply_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


OP10_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS u
  FROM documents
), s AS (
  SELECT source, n, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w,
         sum(n) OVER () AS total
  FROM (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source)
), o AS (  -- sources by how soon they fill up; what is left for a source and those after it
  SELECT *, row_number() OVER f AS k,
         total - 3 * coalesce(sum(n) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM s WINDOW f AS (ORDER BY 3.0 * n / w, source NULLS LAST)
), first_open AS (
  SELECT CAST(rest AS DOUBLE) AS rest, weights, k FROM o
  WHERE CAST(rest AS DOUBLE) * w / weights <= 3 * n ORDER BY k LIMIT 1
), t AS (
  SELECT o.source, o.n, CASE WHEN o.k < coalesce(p.k, o.k + 1) THEN 3.0::DOUBLE * o.n
                             ELSE p.rest * o.w / p.weights END AS target
  FROM o LEFT JOIN first_open p ON true
), plan AS (
  SELECT *, CASE WHEN n > 0 THEN least(3, floor(target / n + 1e-12))::BIGINT ELSE 0 END AS whole FROM t
), extra AS (SELECT *, CASE WHEN whole < 3 THEN target - whole * n ELSE 0 END AS want FROM plan
), run AS (
  SELECT source, u, g, sum(g) OVER (PARTITION BY source ORDER BY u) AS upto
  FROM (SELECT source, u, sum(size) AS g FROM d GROUP BY source, u)
), cut AS (
  SELECT e.source, CASE WHEN g - (want - (upto - g)) <= want - (upto - g) THEN u ELSE u - 1 END AS last
  FROM extra e JOIN run ON run.source IS NOT DISTINCT FROM e.source
  WHERE want > 0 AND upto >= want AND upto - g < want)
SELECT doc_id, size, e.n AS source_size, e.target, size * (e.whole + coalesce(u <= last, false)::BIGINT) AS taken
FROM d JOIN extra e ON e.source IS NOT DISTINCT FROM d.source
LEFT JOIN cut ON cut.source IS NOT DISTINCT FROM d.source
"""


@register("op10_mixing", OP10_SQL)
def op10_mixing(spark, sf_dir):
    """Words that the mix takes from every document."""
    mixed = mixing.mix(tables(spark, sf_dir, "documents").select("doc_id", "source", "text"),
                       keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target",
                        (F.col("size") * F.col("copies")).alias("taken"))


CRC32_SQL = """
  list_reduce([4294967295] || flatten(list_transform(range(1, strlen(CAST({0} AS VARCHAR)) + 1),
      lambda i: [ord(substr(CAST({0} AS VARCHAR), i, 1)), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda s, e: CASE WHEN e >= 0 THEN xor(s, e)
                      WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END)
"""  # the register before its final inversion; crc32 = 4294967295 - this


OP11_SQL = rf"""
WITH o AS (
  SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}}
                            ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), e AS (
  SELECT c, l, ((4294967295 - {CRC32_SQL.format("c")}) % 4)::BIGINT AS h FROM o
), rebuilt AS (
  SELECT e.c, list_concat(coalesce(b.l[1:e.h], []), e.l[e.h + 1:]) AS l FROM e LEFT JOIN o b ON b.c = e.c - e.c % 20
), path AS (  -- a conversation's prefixes, each by the text of its turns
  SELECT c, d, len(l) AS n, CASE WHEN d = 0 THEN '' ELSE l[d].t END AS t,
         array_to_string(list_transform(l[1:d], lambda x: len(x.r) || ':' || len(x.t) || ':' || x.r || x.t), '') AS k
  FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM rebuilt)
), node AS (
  SELECT d, k, min(c) AS c, count(*) AS n_convs, count(*) FILTER (n = d) AS n_ends,
         (count(*) - 1) * len(regexp_extract_all(any_value(t), '[^ 	-]+')) AS saved,
         coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '') AS ends
  FROM path GROUP BY d, k
), below AS (  -- every node with each of its ancestors and itself, through its smallest member
  SELECT a.d, a.k, sum(v.saved) AS saved, count(*) FILTER (v.n_convs = v.n_ends) AS n_leaves,
         count(*) FILTER (v.d = a.d + 1) AS n_children
  FROM node v JOIN path a ON a.c = v.c AND a.d <= v.d GROUP BY a.d, a.k
)
SELECT node.c AS conv_id, node.d AS depth, parent.c AS parent_conv_id, node.n_convs, below.n_children,
       below.n_leaves, below.saved::BIGINT AS saved_tokens, sha256(node.ends) AS ends_sha256
FROM node JOIN below USING (d, k) LEFT JOIN path up ON up.c = node.c AND up.d = node.d - 1
LEFT JOIN node parent ON parent.d = up.d AND parent.k = up.k
"""


@register("op11_conversation_trie", OP11_SQL)
def op11_conversation_trie(spark, sf_dir):
    """Nodes of the prefix trie of all rebuilt conversations."""
    return conversation_trie.build(tables(spark, sf_dir, "conversations")).drop("last_turn")


def _field_sql(col: str) -> str:
    return (f"CASE WHEN {col} IS NULL THEN '-' ELSE CAST(strlen(CAST({col} AS VARCHAR)) AS VARCHAR)"
            f" || ':' || CAST({col} AS VARCHAR) END")


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(c) for c in (*merkle.FIELDS[:-1], text)) + ")"


OP12_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, source, {_leaf_sql("text")} AS leaf,
         CASE WHEN (4294967295 - {CRC32_SQL.format("doc_id")}) % 2 = 0
              THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS found
  FROM documents
), p AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d
), low(source, k, l) AS (  -- the nodes of each level of a source's tree
  SELECT source, 0, list(leaf ORDER BY i) FROM p GROUP BY source
  UNION ALL
  SELECT source, k + 1, list_transform(range(0, len(l), 3), lambda j: sha256(array_to_string(l[j + 1:j + 3], '')))
  FROM low WHERE len(l) > 1
), subroot AS (
  SELECT source, l[1] AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS i
  FROM low WHERE len(l) = 1
), high(k, l) AS (
  SELECT 0, list(subroot ORDER BY i) FROM subroot
  UNION ALL
  SELECT k + 1, list_transform(range(0, len(l), 3), lambda j: sha256(array_to_string(l[j + 1:j + 3], '')))
  FROM high WHERE len(l) > 1
), climb(r, source, i, k, folded, proof) AS (
  SELECT r, source, i, 0, found, '' FROM p
  UNION ALL
  SELECT r, c.source, i // 3, c.k + 1,
         sha256(array_to_string(l[i // 3 * 3 + 1:i], '') || folded || array_to_string(l[i + 2:i // 3 * 3 + 3], '')),
         proof || array_to_string(l[i // 3 * 3 + 1:i], '') || array_to_string(l[i + 2:i // 3 * 3 + 3], '')
  FROM climb c JOIN low ON low.source IS NOT DISTINCT FROM c.source AND low.k = c.k WHERE len(l) > 1
), at_subroot AS (
  SELECT r, s.source, s.i, s.subroot, c.folded, c.proof FROM (
    SELECT r, max(k) AS k FROM climb GROUP BY r) m JOIN climb c USING (r, k)
  JOIN subroot s ON s.source IS NOT DISTINCT FROM c.source
), rise(r, subroot, i, k, folded, proof) AS (
  SELECT r, subroot, i, 0, folded, proof FROM at_subroot
  UNION ALL
  SELECT r, subroot, i // 3, c.k + 1,
         sha256(array_to_string(l[i // 3 * 3 + 1:i], '') || folded || array_to_string(l[i + 2:i // 3 * 3 + 3], '')),
         proof || array_to_string(l[i // 3 * 3 + 1:i], '') || array_to_string(l[i + 2:i // 3 * 3 + 3], '')
  FROM rise c JOIN high ON high.k = c.k WHERE len(l) > 1
)
SELECT doc_id, leaf, subroot, l[1] AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
       folded = l[1] AS verified
FROM rise JOIN high USING (k) JOIN p USING (r) WHERE len(l) = 1
"""


@register("op12_merkle", OP12_SQL)
def op12_merkle(spark, sf_dir):
    """Merkle proof of every document; every second one is changed before it is folded."""
    docs = tables(spark, sf_dir, "documents").select(*merkle.FIELDS)
    changed = F.when(crc_mod("doc_id", 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle.manifest(docs, changes={"text": changed})


@register("op13_language_id")
def op13_language_id(spark, sf_dir):
    """Language of every document, learnt outside the held-out fifth."""
    docs = tables(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.predict(docs, language_id.fit(docs, ~_held_out(5, 0)), keep=["doc_id"]).select(
        "doc_id", _held_out(5, 0).alias("held_out"), "lang_pred", "score")
