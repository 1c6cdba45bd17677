"""One query per operator over the test tables, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanframe.llm import bpe, exact_dedup, html, jaccard, langid, lattice, negatives, packing, pii, prefix_tree, quality, toxicity, urls
from gleanframe.llm.rows import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_html_text")
def html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract_text(table(spark, folder, "pages"))


@query("op2_toxicity")
def toxicity_query(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    grammar = toxicity.fit(documents, table(spark, folder, "labels").where(~held_out))
    return toxicity.score(documents, grammar).select("doc_id", held_out.alias("held_out"), "score", "predicted")


# pseudonyms of the test tables; a deployment brings its own secret
PII_KEY = b"test tables only"


@query("op3_pii")
def pii_query(spark: SparkSession, folder: str) -> DataFrame:
    done = pii.pseudonymise(table(spark, folder, "documents"), PII_KEY, keep=("doc_id", "text"))
    return done.select("doc_id", "text", F.size("spans").cast("bigint").alias("n_replaced"))


@query("op4_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    trees = langid.fit(documents.where(~held_out))
    return langid.predict(documents, trees).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


URL_RULES = [
    urls.UrlRule("block", "net"),
    urls.UrlRule("allow", "example.net", "/en/"),
    urls.UrlRule("block", "example.com", "/de/"),
    urls.UrlRule("allow", "org", "/fr/"),
]


@query("op5_url_filter", """
WITH rules(verdict, rhost, rpath) AS (VALUES
  ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN
  split_part(split_part(substr(url, strpos(url, '://') + 3), '#', 1), '?', 1) ELSE '' END rest FROM pages),
parts AS (SELECT page_id, split_part(rest, '/', 1) raw, substr(rest, length(split_part(rest, '/', 1)) + 1) path FROM cut),
hosts AS (SELECT page_id, path, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host FROM parts),
judged AS (SELECT page_id, host, path, (SELECT {'rule': rhost || rpath, 'verdict': verdict} FROM rules
  WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  ORDER BY length(rhost || rpath) DESC LIMIT 1) best FROM hosts)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM judged
""")
def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_urls(table(spark, folder, "pages"), URL_RULES)


@query("op6_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, folder, "documents"), VOCABULARY))


@query("op7_exact_dedup", """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM n
""")
def exact_dedup_query(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


@query("op8_bpe")
def bpe_query(spark: SparkSession, folder: str) -> DataFrame:
    done = bpe.encode(table(spark, folder, "documents"), VOCABULARY)
    return done.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


_SPLIT = "list_filter(string_split_regex({}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"


@query("op9_quality", f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, r, t, {_SPLIT.format("t")} AS w,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^ \\t\\n\\x0B\\f\\r]')) AS lines FROM d),
g AS (SELECT r, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM s)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, (VALUES (0), (1), (2)) AS o(j) GROUP BY r),
good AS (SELECT r, list_filter(lines, lambda l: NOT (
  len(list_filter(['lorem ipsum', 'javascript', 'cookie', 'privacy policy', 'terms of use', 'terms of service',
    'all rights reserved', 'sign in', 'sign up', 'subscribe', 'click here', 'read more', 'share this',
    'released under the', 'copyright ©', '{{', '}}'], lambda p: contains(lower(l), p))) > 0
  OR length(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) * 100 > length(l) * 8
  OR length(regexp_replace(l, '[^|»›•·]', '', 'g')) >= 3
  OR (upper(l) = l AND lower(l) <> l AND len({_SPLIT.format("l")}) >= 3)
  OR (NOT regexp_matches(rtrim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[.!?…:;"”’»)\\]'']$')
    AND len({_SPLIT.format("l")}) >= 8))) AS good FROM s),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
  length(regexp_replace(array_to_string(good, ''), '[ \\t\\n\\x0B\\f\\r]', '', 'g')) AS clean
  FROM s JOIN good USING (r) LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * clean >= 50 * word_chars AS kept FROM m
""")
def quality_query(spark: SparkSession, folder: str) -> DataFrame:
    return quality.clean_lines(table(spark, folder, "documents")).drop("clean_text", "lines_removed")


@query("op10_ngram_jaccard", r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'),
    lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(v, l) AS (SELECT doc_id, doc_id FROM n UNION SELECT u.b, r.l FROM r JOIN u ON u.a = r.v)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.l, t.doc_id) AS component_id
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT v, min(l) AS l FROM r GROUP BY v) m ON m.v = t.doc_id
""")
def ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_classes(table(spark, folder, "documents"), words=4, percent=85)


@query("op11_lattice_neardup", """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label,
    CASE WHEN label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS e FROM embeddings),
l AS (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
t(r, c) AS (SELECT r, vec_id FROM v UNION SELECT l.b, t.c FROM t JOIN l ON l.a = t.r),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), m AS (SELECT r, min(c) AS c FROM t GROUP BY r)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id IS NOT DISTINCT FROM c AS kept
FROM v JOIN m USING (r) LEFT JOIN n ON n.a = v.r
""")
def lattice_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.near_classes(table(spark, folder, "embeddings"), threshold=0.93)


# unsigned CRC-32 of a decimal text, byte by byte and bit by bit
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
  lambda s, b: list_reduce(list_prepend(xor(s, b), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]),
    lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END))"""
HEADS = 4


@query("op12_prefix_tree", f"""
WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, max(i) AS n, xor({_CRC.format("c")}, 4294967295::BIGINT) % 4 AS h FROM o GROUP BY c),
t AS (SELECT k.c, o.i, o.role, o.text FROM k JOIN o ON o.c = k.c - k.c % 20 AND o.i <= k.h
  UNION ALL SELECT k.c, k.h + o.i, o.role, o.text FROM k JOIN o ON o.c = k.c AND o.i > k.h),
l AS (SELECT c, list({{'r': role, 't': text}} ORDER BY i) AS turns FROM t GROUP BY c),
w AS (SELECT k.c, coalesce(l.turns, []) AS turns FROM k LEFT JOIN l USING (c)),
p AS (SELECT c, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS d, turns FROM w),
q AS (SELECT c, n, d, sha256(turns[1:d]::VARCHAR) AS s, sha256(turns[1:d - 1]::VARCHAR) AS up,
  CASE WHEN d > 0 THEN len(list_filter(string_split_regex(turns[d].t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) ELSE 0 END AS words FROM p),
node AS (SELECT d, s, min(c) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN d > 0 THEN up END) AS up, any_value(words) AS words,
  string_agg(CASE WHEN n = d THEN c::VARCHAR END, ',' ORDER BY c) AS ends FROM q GROUP BY d, s),
kids AS (SELECT d - 1 AS d, up AS s, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (d, s)),
under AS (SELECT DISTINCT a.d AS ad, a.s AS a, b.d AS bd, b.s AS b FROM q a JOIN q b ON a.c = b.c AND a.d <= b.d),
sums AS (SELECT ad AS d, a AS s, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM under JOIN full_node ON full_node.d = bd AND full_node.s = b GROUP BY ALL)
SELECT x.conv_id, x.d::BIGINT AS depth, y.conv_id AS parent_conv_id, x.n_convs, x.n_children, sums.n_leaves::BIGINT AS n_leaves,
  sums.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM full_node x JOIN sums USING (d, s) LEFT JOIN node y ON y.d = x.d - 1 AND y.s = x.up
""")
def conversation_tree(spark: SparkSession, folder: str) -> DataFrame:
    conv = F.col("conv")
    return prefix_tree.prefix_tree(
        table(spark, folder, "conversations"), fold(conv, HEADS), conv - conv % 20, HEADS - 1,
    )


@query("op13_hard_negatives", """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT vec_id AS anchor_id, label, q FROM v WHERE vec_id % 100 = 0),
s AS (SELECT anchor_id, v.vec_id, a.label = v.label AS same,
    list_sum(list_transform(range(1, len(v.q) + 1), lambda i: a.q[i] * v.q[i]))::BIGINT AS score FROM a, v WHERE v.vec_id <> anchor_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER w AS k FROM s WHERE same
  WINDOW w AS (PARTITION BY anchor_id ORDER BY score DESC, vec_id)),
n AS (SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
  WHERE k <= 5 WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id))
SELECT * FROM n WHERE rank <= 10
""")
def hard_negatives_query(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), F.col("id") % 100 == 0)
