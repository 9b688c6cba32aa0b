"""One query for each operator, over whole tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.llm import backoff, cover_tree, decontaminate, factorisation, html_text, line_dedup, mixing, periodic_runs, quality_rules, simhash, token_counts, toxicity, vector_codes
from cellspan.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = backoff.stupid_backoff(table(spark, sf_dir, "documents"))
    # sums of logarithms to four places, so that sums in another order compare equal
    return scores.select("doc_id", "n_words", *[F.round(c, 4).alias(c) for c in ("log_score", "mean_log_score")], "n_full", "n_backed_off", "n_unseen")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good")
    )


def op6_factorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factorisation.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return held.select("doc_id", "item_id", "edits", "start", "end", "item_chars")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.encode(table(spark, sf_dir, "embeddings"))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_backoff, op3_line_dedup, op4_mixing, op5_quality_rules, op6_factorisation, op7_toxicity, op8_decontaminate, op9_token_counts, op10_html_text,
    op11_cover_tree, op12_delta_lloyd, op13_periodic_runs, pipeline,
)}

LINE_DEDUP_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT doc_id, lines, unnest(range(len(lines))) AS pos FROM d),
l AS (SELECT doc_id, pos, lines[pos + 1] AS line,
        translate(trim(lines[pos + 1], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
c AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.doc_id, l.pos, l.line, c.key IS NOT NULL AND l.doc_id <> c.keeper AS gone FROM l LEFT JOIN c ON l.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
             md5('42:' || doc_id) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w,
        (3 * source_size)::DOUBLE AS cap FROM s),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
      FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level FROM v WHERE cap / w >= level ORDER BY cap / w, level LIMIT 1),
t AS (SELECT source, source_size, least(cap, w * (SELECT level FROM f)) AS target FROM w),
q AS (SELECT d.*, t.source_size, t.target,
        sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS through
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, (source_size * turn + through)::DOUBLE / target AS time FROM q, range(3) r(turn) WHERE size > 0),
g AS (SELECT doc_id, size, sum(size) OVER (ORDER BY time, source NULLS LAST, key, doc_id, size, turn ROWS UNBOUNDED PRECEDING) AS upto FROM e),
k AS (SELECT doc_id, count(*) AS copies FROM g WHERE upto <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(k.copies, 0))::BIGINT AS taken FROM q LEFT JOIN k ON q.doc_id = k.doc_id
"""

BACKOFF_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, w[i] AS g1, CASE WHEN i > 1 THEN w[i - 1:i] END AS g2, CASE WHEN i > 2 THEN w[i - 2:i] END AS g3,
        lag(w[i]) OVER o AS p1, CASE WHEN i > 2 THEN w[i - 2:i - 1] END AS p2
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
o1 AS (SELECT doc_id, g1 AS g, count(*) AS own FROM p GROUP BY ALL), c1 AS (SELECT doc_id, g, sum(own) OVER (PARTITION BY g) - own AS c FROM o1),
o2 AS (SELECT doc_id, g2 AS g, count(*) AS own FROM p WHERE i > 1 GROUP BY ALL), c2 AS (SELECT doc_id, g, sum(own) OVER (PARTITION BY g) - own AS c FROM o2),
o3 AS (SELECT doc_id, g3 AS g, count(*) AS own FROM p WHERE i > 2 GROUP BY ALL), c3 AS (SELECT doc_id, g, sum(own) OVER (PARTITION BY g) - own AS c FROM o3),
j AS (SELECT p.doc_id, p.i, c1.c AS n1, c2.c AS n2, c3.c AS n3, b1.c AS d1, b2.c AS d2 FROM p
        JOIN c1 ON c1.doc_id = p.doc_id AND c1.g = p.g1 LEFT JOIN c2 ON c2.doc_id = p.doc_id AND c2.g = p.g2 LEFT JOIN c3 ON c3.doc_id = p.doc_id AND c3.g = p.g3
        LEFT JOIN c1 b1 ON b1.doc_id = p.doc_id AND b1.g = p.p1 LEFT JOIN c2 b2 ON b2.doc_id = p.doc_id AND b2.g = p.p2),
n AS (SELECT doc_id, len(w) AS n_words, greatest(sum(len(w)) OVER () - len(w), 1)::DOUBLE AS size FROM d),
s AS (SELECT j.doc_id, CASE WHEN n3 > 0 THEN 3 WHEN n2 > 0 THEN 2 WHEN n1 > 0 THEN 1 ELSE 0 END AS used, least(i, 3) AS reach,
        ln(CASE WHEN n3 > 0 THEN n3::DOUBLE / d2 WHEN n2 > 0 THEN n2::DOUBLE / d1 WHEN n1 > 0 THEN n1 / size ELSE 0.5 / size END)
          + ln(0.4::DOUBLE) * (least(i, 3) - CASE WHEN n3 > 0 THEN 3 WHEN n2 > 0 THEN 2 ELSE 1 END) AS log
      FROM j JOIN n ON n.doc_id = j.doc_id),
t AS (SELECT doc_id, sum(log) AS log, count(*) FILTER (used = reach) AS full, count(*) FILTER (used > 0 AND used < reach) AS backed, count(*) FILTER (used = 0) AS new FROM s GROUP BY doc_id)
SELECT n.doc_id, n.n_words::BIGINT AS n_words, round(coalesce(log, 0.0), 4) + 0.0 AS log_score, round(CASE WHEN n_words > 0 THEN log / n_words END, 4) + 0.0 AS mean_log_score,
       coalesce("full", 0)::BIGINT AS n_full, coalesce(backed, 0)::BIGINT AS n_backed_off, coalesce("new", 0)::BIGINT AS n_unseen
FROM n LEFT JOIN t ON t.doc_id = n.doc_id
"""

RUNS_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o,
    xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) AS h FROM documents),
a AS (SELECT doc_id, o, h, len(o) AS n, CASE WHEN len(o) > 0 THEN (h // 10) % len(o) END AS a FROM t),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: o[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) ELSE o END AS w FROM a),
e AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM d),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
g AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM m),
s AS (SELECT doc_id, q, min(i) AS i, count(*) + q AS l FROM g GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, i, l, min(q) AS q FROM s GROUP BY doc_id, i, l),
b AS (SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(i, l, q), struct_pack(l := -l, i := i, q := q)) AS best, string_agg(i || ',' || l || ',' || q || chr(10), '' ORDER BY i, q) AS listed FROM r GROUP BY doc_id),
z AS (SELECT DISTINCT doc_id, unnest(range(i + q, i + l)) AS i FROM r),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM e ANTI JOIN z USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.i::BIGINT AS start, best.l::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.l // best.q)::BIGINT AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM d LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)
"""

SQL = {"op2_backoff": BACKOFF_SQL, "op3_line_dedup": LINE_DEDUP_SQL, "op4_mixing": MIXING_SQL, "op11_cover_tree": cover_tree.SQL, "op12_delta_lloyd": vector_codes.encode_sql(), "op13_periodic_runs": RUNS_SQL}
