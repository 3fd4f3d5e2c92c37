"""The registered queries: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat, clusters, exact_dedup, merkle, mixing, ngram_jaccard, packing, quality, rules, secrets, simhash,
               token_counts, warc)
from .common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@query("op3_exact_dedup")
def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.duplicate_table(read_table(spark, sf_dir, "documents"))


ORACLE["op3_exact_dedup"] = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


@query("op10_simhash")
def op10_simhash(spark, sf_dir):
    return simhash.near_duplicate_table(read_table(spark, sf_dir, "documents"))


@query("op8_packing")
def op8_packing(spark, sf_dir):
    pieces = packing.token_pieces(read_table(spark, sf_dir, "documents"))
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


@query("op7_warc")
def op7_warc(spark, sf_dir):
    return warc.read_archives(warc.write_archives(read_table(spark, sf_dir, "pages"))).drop("url")


ORACLE["op7_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (
  SELECT page_id, h, strlen(h) AS b, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(b AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN b >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN b >= 1000 AND page_id <> top THEN top END AS refers_to
FROM g
"""


@query("op1_secrets")
def op1_secrets(spark, sf_dir):
    found = secrets.scan(read_table(spark, sf_dir, "documents"))

    def n(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"] != "markov")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(secrets.joined(base), 256)
                        .alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"), n("markov"))


@query("op9_quality")
def op9_quality(spark, sf_dir):
    return quality.score_table(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op6_host_rules")
def op6_host_rules(spark, sf_dir):
    return rules.judge(read_table(spark, sf_dir, "documents"))


ORACLE["op6_host_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(1) || 'null') AS host, coalesce(text, '') AS t
  FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, t FROM d),
win AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
ln AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM w),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM ln
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (
  SELECT d.doc_id, d.host, CAST(len(w.ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w.ws, '')) AS BIGINT) AS word_chars,
         CAST(length(w.t) - length(regexp_replace(w.t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN cov USING (r)),
j AS (
  SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2, 10 * n_symbols > n_words AS f3,
         word_chars < 2 * n_words AS f4, word_chars > 12 * n_words AS f5, 10 * n_dup_lines > n_words AS f6
  FROM c),
h AS (
  SELECT host, count(*) AS n, unnest([1, 2, 3, 4, 5, 6]) AS rule,
         unnest([sum(f1::INT), sum(f2::INT), sum(f3::INT), sum(f4::INT), sum(f5::INT), sum(f6::INT)]) AS failed
  FROM j GROUP BY host),
m AS (SELECT rule, avg(failed / n) AS m, var_pop(failed / n) AS v FROM h GROUP BY rule),
p AS (SELECT rule, m, CASE WHEN v > 0 THEN least(1e6, greatest(1.0, m * (1 - m) / v - 1)) ELSE 1e6 END AS k FROM m),
v AS (SELECT host, max((failed + m * k) / (n + k)) > 0.8 AS host_failed FROM h JOIN p USING (rule) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (f1 OR f2) AS base_failed,
       NOT (f1 OR f2) AND NOT host_failed AS kept
FROM j JOIN v USING (host)
"""


@query("op2_chat_format")
def op2_chat_format(spark, sf_dir):
    talks = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit("\\### Assistant: </turn> ok").alias("text"))
    return chat.contract_table(chat.format_trees(*chat.conversation_nodes(talks.unionByName(probe)))).drop("branch_rank")


# formatted_chars follows from the template: 4 + 2 + 9 characters around each turn, plus what escaping adds
ORACLE["op2_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\t') AS esc FROM c),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, sha256(text)) AS said,
         coalesce(string_agg(text, '' ORDER BY turn, role, sha256(text)) FILTER (role = 'assistant'), '') AS loss,
         sum(length(role) + length(esc) + 15) AS chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM g
"""


def labelled_languages(spark, sf_dir):
    """The labelled table of the mixing classifier: labelled ids and their domain."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id").distinct(), "doc_id")


@query("op4_mixing")
def op4_mixing(spark, sf_dir):
    mixed = mixing.mix(read_table(spark, sf_dir, "documents").select("doc_id", "text"),
                       labelled_languages(spark, sf_dir))
    return mixed.select(F.col("_row.doc_id").alias("doc_id"), "tokens", "domain", "posterior", "rate", "copies")


@query("op5_token_counts")
def op5_token_counts(spark, sf_dir):
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


@query("op11_merkle")
def op11_merkle(spark, sf_dir):
    return merkle.audit(read_table(spark, sf_dir, "documents"))


# crc: bytes of the id, eight shifts each; up: a tree per language, level by level; over: the tree of subroots
ORACLE["op11_merkle"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS r, lang, doc_id,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') ||
         coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents),
crc AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
           string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
           lambda c, x: xor(xor(c, x) >> 1, CASE WHEN xor(c, x) % 2 = 1 THEN 3988292384 ELSE 0 END)),
           CAST(4294967295 AS BIGINT)) AS crc
  FROM d),
l AS (
  SELECT r, lang, doc_id,
         sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
         CASE WHEN crc % 7 = 0 THEN sha256(head || coalesce(
           strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS now
  FROM crc),
up AS (
  SELECT lang, 0 AS k, r AS p, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM l
  UNION ALL
  SELECT lang, k + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), (min(n) + 1) // 2
  FROM up WHERE n > 1 GROUP BY lang, k, p // 2),
subs AS (SELECT lang, h AS subroot, k AS depth, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g
         FROM up WHERE n = 1),
over_ AS (
  SELECT 0 AS k, g AS p, subroot AS h, count(*) OVER () AS n FROM subs
  UNION ALL
  SELECT k + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), (min(n) + 1) // 2
  FROM over_ WHERE n > 1 GROUP BY k, p // 2),
top AS (SELECT h AS root, k AS height FROM over_ WHERE n = 1),
steps AS (
  SELECT l.doc_id, l.lang, l.r, s.k, (l.r >> s.k) % 2 AS side, o.h AS sib
  FROM l JOIN subs x ON l.lang IS NOT DISTINCT FROM x.lang
  CROSS JOIN (SELECT unnest(range(0, 64)) AS k) s
  LEFT JOIN up o ON o.lang IS NOT DISTINCT FROM l.lang AND o.k = s.k AND o.p = xor(l.r >> s.k, 1)
  WHERE s.k < x.depth
  UNION ALL
  SELECT l.doc_id, l.lang, l.r, x.depth + s.k, (x.g >> s.k) % 2, o.h
  FROM l JOIN subs x ON l.lang IS NOT DISTINCT FROM x.lang CROSS JOIN top
  CROSS JOIN (SELECT unnest(range(0, 64)) AS k) s
  LEFT JOIN over_ o ON o.k = s.k AND o.p = xor(x.g >> s.k, 1)
  WHERE s.k < height),
proof AS (
  SELECT lang, r, string_agg(coalesce(sib, ''), '' ORDER BY k) AS sibs, list(struct_pack(side := side,
         sib := coalesce(sib, '')) ORDER BY k) AS path
  FROM steps GROUP BY lang, r),
walk AS (
  SELECT l.lang, l.r, 0 AS k, coalesce(l.now, l.leaf) AS h, coalesce(p.path, []) AS path
  FROM l LEFT JOIN proof p ON l.lang IS NOT DISTINCT FROM p.lang AND l.r = p.r
  UNION ALL
  SELECT lang, r, k + 1, sha256(CASE WHEN path[k + 1].side = 1 THEN path[k + 1].sib || h
                                     ELSE h || path[k + 1].sib END), path
  FROM walk WHERE k < len(path))
SELECT l.doc_id, l.leaf, x.subroot, top.root, sha256(coalesce(p.sibs, '')) AS proof_sha256, w.h AS folded_root,
       w.h = top.root AS verified
FROM l JOIN subs x ON l.lang IS NOT DISTINCT FROM x.lang CROSS JOIN top
LEFT JOIN proof p ON l.lang IS NOT DISTINCT FROM p.lang AND l.r = p.r
JOIN walk w ON l.lang IS NOT DISTINCT FROM w.lang AND l.r = w.r AND w.k = len(w.path)
"""


@query("op12_centroids")
def op12_centroids(spark, sf_dir):
    return clusters.cluster(read_table(spark, sf_dir, "embeddings"))


def _centroid_rounds(rounds: int) -> str:
    """SQL of the centroids after each round: c0 (the first ones) to c<rounds>."""
    nearest = """
  SELECT vec_id, v, arg_min(j, (d, j)) AS cluster, min(d) AS distance FROM (
    SELECT vec_id, v, j, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)
           AS d, row FROM kept, c{i}) GROUP BY row, vec_id, v"""
    steps = ["""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id,
         list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
             """c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY key, v) - 1 AS j, v AS c FROM (
    SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), 'null')) AS key, v FROM kept ORDER BY key, v LIMIT 8))"""]
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({nearest.format(i=i)})")
        steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT j, coalesce(list(m ORDER BY pos) FILTER (WHERE m IS NOT NULL), any_value(c)) AS c FROM (
    SELECT j, c, pos, (s - ((s % n) + n) % n) // n AS m FROM c{i} LEFT JOIN (
      SELECT cluster, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
      FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS pos FROM a{i}) GROUP BY cluster, pos) ON cluster = j)
  GROUP BY j)""")
    steps.append(f"f AS MATERIALIZED ({nearest.format(i=rounds)})")
    return ",\n".join(steps)


ORACLE["op12_centroids"] = f"""
WITH {_centroid_rounds(10)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance,
       CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM f JOIN c10 ON j = cluster
"""


@query("op13_jaccard_join")
def op13_jaccard_join(spark, sf_dir):
    return ngram_jaccard.similar_documents(read_table(spark, sf_dir, "documents"))
