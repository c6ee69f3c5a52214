"""Queries of the training-data operators over the whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm import clustering, conversations, fingerprints, html_text, jaccard, langid, language_model, mixing, neardup, packing, substring, toxicity, url_rules
from cohortflow.llm.common import id_crc, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (F.pmod(id_crc("doc_id"), F.lit(4)) == 2).alias("held_out"))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score")


@query
def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(table(spark, sf_dir, "documents"))


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.pmod(id_crc("doc_id"), F.lit(3)) == 1).alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(F.pmod(id_crc("doc_id"), F.lit(3)) != 1).select("doc_id", "toxic")
    lexicon = toxicity.learn(toxicity.labelled(docs, labels))
    return toxicity.score(docs, lexicon, keep=("held_out",)).select("doc_id", "held_out", "score", "predicted")


@query
def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "confidence")


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE["op7_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS h
  FROM documents),
p AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, source ASC NULLS LAST) AS i FROM p),
l AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_words,
         sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight FROM o),
c AS (SELECT *, left_words * w >= 3 * source_size * left_weight AS capped FROM l),
f AS (SELECT left_words AS ow, left_weight AS oweight FROM c WHERE NOT capped ORDER BY i LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
              ELSE CAST((SELECT ow FROM f) AS DOUBLE) * w / CAST((SELECT oweight FROM f) AS DOUBLE) END AS target
  FROM c),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
x AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.copies, r.target - CAST(r.copies * r.source_size AS DOUBLE) AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.h) AS cell
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (copies + CASE WHEN rest > 0 AND (upto <= rest OR (upto - cell <= rest AND cell - (rest - (upto - cell)) < rest - (upto - cell)))
                                  THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM x
"""


@query
def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_units", "n_removed", "removed_words")


ORACLE["op8_substring"] = r"""
WITH d AS (SELECT doc_id, text, md5(text) AS t FROM documents),
s AS (
  SELECT doc_id, t, text, string_split(regexp_replace(text, '([.!?][\x20\x09-\x0D]+|[\x20\x09-\x0D]*\n[\x20\x09-\x0D]*)', '\1' || chr(57344), 'g'), chr(57344)) AS parts
  FROM d WHERE text IS NOT NULL),
u AS (SELECT doc_id, t, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM s),
w AS (
  SELECT *, len(regexp_extract_all(part, '[^\x20\x09-\x0D]+')) AS words,
         md5(array_to_string(regexp_extract_all(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ')) AS digest
  FROM u),
f AS (
  SELECT *, words > 0 AND row_number() OVER (PARTITION BY digest ORDER BY doc_id, t, i) > 1 AS again FROM w),
g AS (
  SELECT *, sum(CASE WHEN again THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, t ORDER BY i) AS run FROM f),
r AS (
  SELECT *, again AND sum(CASE WHEN again THEN words ELSE 0 END) OVER (PARTITION BY doc_id, t, run) >= 20 AS gone FROM g),
o AS (
  SELECT doc_id, t, coalesce(string_agg(part, '' ORDER BY i) FILTER (WHERE NOT gone), '') AS text,
         count(*) FILTER (WHERE words > 0) AS n_units, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(sum(words) FILTER (WHERE gone), 0) AS removed_words
  FROM r GROUP BY doc_id, t)
SELECT d.doc_id, o.text, coalesce(o.n_units, 0)::BIGINT AS n_units, coalesce(o.n_removed, 0)::BIGINT AS n_removed,
       coalesce(o.removed_words, 0)::BIGINT AS removed_words
FROM d LEFT JOIN o ON d.doc_id IS NOT DISTINCT FROM o.doc_id AND d.t IS NOT DISTINCT FROM o.t
"""


@query
def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"), F.pmod(id_crc("doc_id"), F.lit(7)) == 2)


@query
def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), k=3, percent=90)


@query
def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), html_text.train()).select("page_id", "url", "text", "n_chars")


@query
def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.repair_with_digests(rows).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _repair_sql() -> str:
    """Dynamic programming over a conversation's rows: per state the least of cost (nine digits) and audit as one string."""
    kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    after = (2, 2, 3, 2)

    def plus(q, cost, edits):
        return f"lpad(CAST(CAST(left(p.q{q}, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr(p.q{q}, 10) || '{edits}'"

    to: dict[int, list[str]] = {q: [] for q in range(4)}
    for q in range(4):
        at = q
        for inserts in range(3):
            paid, edits = 2 * inserts, "I" * inserts
            to[at].append(plus(q, paid + 3, edits + "D"))
            for c in "sua":
                if (at, c) in kept:
                    to[kept[at, c]].append(f"CASE WHEN NOT r.gone AND r.c = '{c}' THEN {plus(q, f'{paid} + r.cut', edits + 'K')} END")
            to[after[at]].append(f"CASE WHEN NOT r.gone THEN {plus(q, f'{paid + 2} + r.cut', edits + 'R')} END")
            at = after[at]
    states = ", ".join(f"least({', '.join(x)}) AS q{q}" for q, x in to.items())
    last = f"least(p.q0, {plus(1, 4, 'II')}, {plus(2, 2, 'I')}, p.q3)"
    return rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
z AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(key) + 1), lambda i: CAST(ord(substr(key, i, 1)) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS z FROM k),
d AS (
  SELECT conv_id, turn, CASE WHEN z = 4 THEN 'user' ELSE role END AS role,
         CASE z WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE z WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM z),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM d),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open FROM n),
r AS MATERIALIZED (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS c, blank, again AND NOT blank AS dup, open AND NOT again AND NOT blank AS trunc,
         blank OR again AS gone, CAST(open AND NOT again AND NOT blank AS INTEGER) AS cut,
         i > 1 AND (lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1)) NOT IN ('su', 'ua', 'au') AS illegal
  FROM o),
p AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS q0, CAST(NULL AS VARCHAR) AS q1, CAST(NULL AS VARCHAR) AS q2, CAST(NULL AS VARCHAR) AS q3
  FROM conversations
  UNION ALL
  SELECT p.conv_id, r.i, {states} FROM p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1),
w AS (SELECT conv_id, arg_max({last}, p.i) AS way FROM p GROUP BY conv_id),
a AS (SELECT conv_id, CAST(left(way, 9) AS BIGINT) AS cost, substr(way, 10) AS audit FROM w),
e AS (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS pos, audit FROM a),
l AS (
  SELECT conv_id, pos, substr(audit, pos, 1) AS edit, length(replace(left(audit, pos), 'I', '')) AS i, length(replace(left(audit, pos), 'D', '')) AS n FROM e),
m AS (
  SELECT l.conv_id, l.pos, l.edit, l.n, r.role, CASE WHEN l.edit = 'I' THEN '' ELSE r.text END AS text,
         max(CASE WHEN l.n = 1 AND l.edit = 'K' AND r.c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS head
  FROM l LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i AND l.edit <> 'I' WHERE l.edit <> 'D'),
t AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (n - head) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos) AS whole
  FROM m GROUP BY conv_id),
f AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
         count(*) FILTER (trunc) AS truncated, count(*) FILTER (illegal) AS illegal FROM r GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(f.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(f.blank, 0) AS BIGINT) AS blank, CAST(coalesce(f.duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(f.truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(f.illegal, 0) AS BIGINT) AS illegal, a.cost, a.audit,
       sha256(coalesce(t.whole, '')) AS repaired_sha256
FROM a LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
"""


ORACLE["op12_conversations"] = _repair_sql()


@query
def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _clustering_sql(rounds: int = 5, k: int = 40, dims: int = 64) -> str:
    """Each round: every squared distance, the nearest centroid (ties: smaller number), exact floors of the means."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS (
  SELECT r, vec_id, v, arg_min(c, s) AS c, min(s)[1] AS d FROM (
    SELECT k.r, k.vec_id, k.v, m.c,
           [CAST(list_sum(list_transform(list_zip(k.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), m.c] AS s
    FROM k CROSS JOIN c{i} m) GROUP BY r, vec_id, v),""")
        if i < rounds:
            steps.append(f"""
c{i + 1} AS (
  SELECT m.c, coalesce(n.v, m.v) AS v FROM c{i} m LEFT JOIN (
    SELECT c, list(x ORDER BY g) AS v FROM (
      SELECT c, g, CAST((sum(v[g]) - ((sum(v[g]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
      FROM a{i}, (SELECT unnest(range(1, {dims + 1})) AS g) GROUP BY c, g) GROUP BY c) n ON n.c = m.c),""")
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS BIGINT) AS c, v
  FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM k ORDER BY h, v LIMIT {k})),{"".join(steps)}
z AS (SELECT c, sha256(array_to_string(v, ',')) AS digest FROM c{rounds})
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, z.digest AS centroid_sha256
FROM a{rounds} a JOIN z ON z.c = a.c
"""


ORACLE["op13_clustering"] = _clustering_sql()
