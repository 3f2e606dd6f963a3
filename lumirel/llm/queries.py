"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, compression_classifier, embedding_dedup, exact_dedup, html_text, language_id, minhash, mixing, periodic, quality_rules, spelling, suffix_dedup, warc
from .common import read_table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(read_table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.token_digests(read_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read_table(spark, sf_dir, "documents"))


def op4_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_classifier.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read_table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(read_table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_assemble(read_table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(read_table(spark, sf_dir, "documents"))


#: One run of letters in so many loses a letter in op11's words.
OP11_DROP_EVERY = 199


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents"), OP11_DROP_EVERY)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(read_table(spark, sf_dir, "documents"), periodic.repeat_tail)


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_minhash_near_dedup,
        op2_byte_bpe,
        op3_quality_rules,
        op4_compression_classifier,
        op5_source_mixing,
        op6_suffix_array_dedup,
        op7_html_extraction,
        op8_exact_dedup,
        op9_warc,
        op10_language_id,
        op11_spelling_variants,
        op12_periodic_runs,
        op13_embedding_near_dedup,
    )
    return {f.__name__: f for f in found}


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.doc_id)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.root) AS component_id, d.doc_id = min(r.root) AS kept
FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""

OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, generate_series(0, 7) s(k) GROUP BY doc_id),
l AS (SELECT doc_id, line, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
m AS (SELECT doc_id, line, len(w) AS n,
  len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]') AND regexp_matches(x, '[^#*$%&|<>]'))) AS marked,
  len(list_filter(w, lambda x: x IN ('|', '>', '/'))) AS bare, len(list_filter(w, lambda x: suffix(x, '!'))) AS shout,
  regexp_matches(line, '(?i)^\s*(licensed under|released under|copyright\b|all rights reserved|\(c\)\s|terms of (use|service)|privacy policy|cookie policy|lorem ipsum|please enable javascript)') AS notice
  FROM l WHERE len(w) > 0),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (bad) AS removed, coalesce(sum(n) FILTER (bad), 0) AS lost
  FROM (SELECT *, 100 * marked > 30 * n OR 100 * shout > 50 * n OR 100 * bare > 25 * n OR notice AS bad FROM m) GROUP BY doc_id),
b AS (SELECT w.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(removed, 0) AS n_lines_removed, coalesce(lost, 0) AS n_words_removed
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * (n_words - n_words_removed) >= 50 * n_words AS kept,
  n_lines_removed::BIGINT AS n_lines_removed, n_words_removed::BIGINT AS n_words_removed FROM b
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, min(page_id) AS first_id FROM p WHERE strlen(html) >= 100 GROUP BY html)
SELECT p.page_id, strlen(p.html)::BIGINT AS payload_bytes, sha256(p.html) AS payload_digest,
  CASE WHEN first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> p.page_id THEN first_id END AS refers_to
FROM p LEFT JOIN g USING (html)
"""


#: The table of crc32, and crc32 of a list of bytes x.
CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc)"
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, x), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"

OP11_SQL = (
    r"""
WITH RECURSIVE {table},
r AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]{6,}')) AS word FROM documents) GROUP BY ALL),
b AS (SELECT word, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || word, ''), lambda y: CASE WHEN unicode(y) < 128 THEN [unicode(y)::BIGINT] ELSE [195, unicode(y)::BIGINT - 64] END)) AS x FROM r),
h AS (SELECT word, n, {crc} AS h FROM b, crc),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substring(word, 1, (h % length(word))::INT) || substring(word, (h % length(word))::INT + 2) ELSE word END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
c AS (SELECT word, n, substring(word, 1, i) AS a, substring(word, i + 2) AS b FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM v)),
near AS (SELECT x.word, y.word AS other, y.n AS m FROM c x JOIN c y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT c.word, v.word, v.n FROM c JOIN v ON v.word = c.a || c.b UNION SELECT v.word, c.word, c.n FROM c JOIN v ON v.word = c.a || c.b),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN other END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
up(word, root) AS (SELECT word, word FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM f JOIN up USING (word) JOIN f last ON last.word = up.root WHERE last.form IS NULL
"""
).replace("{table}", CRC_TABLE).replace("{crc}", CRC)

OP12_SQL = (
    r"""
WITH {table},
d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda y: y <> '') AS w, list_transform(string_split(doc_id::VARCHAR, ''), lambda y: unicode(y)::BIGINT) AS x FROM documents),
h AS (SELECT doc_id, w, len(w) AS n, {crc} AS h FROM d, crc),
g AS (SELECT doc_id, w, n, h, h // 10 % greatest(n, 1) AS a, 1 + (n - h // 10 % greatest(n, 1)) // (3 + h // 10 % 8) AS p FROM h),
t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM g),
s AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 6], ' ') AS s FROM (SELECT doc_id, w, unnest(range(n - 5)) AS i FROM t WHERE n >= 6)),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS p FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.s = y.s AND x.i < y.i),
k AS (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS k FROM m),
f AS (SELECT doc_id, min(i) AS start, count(*) + 5 + p AS length, p FROM k GROUP BY doc_id, p, k HAVING count(*) + 5 + p >= greatest(12, 2 * p)),
r AS (SELECT doc_id, start, length, min(p) AS period FROM f GROUP BY ALL),
top AS (SELECT doc_id, count(*) AS n_runs, arg_min((start, length, period), (-length, start, period)) AS b, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM t),
c AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, b[1] AS start, b[2] AS length, b[3] AS period, 1000 * b[2] // b[3] AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN top USING (doc_id) LEFT JOIN c USING (doc_id)
"""
).replace("{table}", CRC_TABLE).replace("{crc}", CRC)

OP13_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(vec_id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.w, r.root FROM r JOIN l ON l.u = r.vec_id),
n AS (SELECT u AS vec_id, count(*) AS n FROM l GROUP BY u)
SELECT r.vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(root)::BIGINT AS component_id, r.vec_id = min(root) AS kept FROM r LEFT JOIN n USING (vec_id) GROUP BY r.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_near_dedup": OP1_SQL,
        "op3_quality_rules": OP3_SQL,
        "op8_exact_dedup": OP8_SQL,
        "op9_warc": OP9_SQL,
        "op11_spelling_variants": OP11_SQL,
        "op12_periodic_runs": OP12_SQL,
        "op13_embedding_near_dedup": OP13_SQL,
    }
