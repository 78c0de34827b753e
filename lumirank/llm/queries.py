"""The operators as queries over the given tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumirank.llm import (
    bpe,
    exact_dedup,
    fingerprints,
    jaccard,
    language,
    mixing,
    neighbours,
    pii,
    quality,
    spelling,
    suffix_dedup,
    token_files,
    vector_codes,
)
from lumirank.llm.common import read_table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of each document in a mix of the sources by weight."""
    mixed = mixing.mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as byte-level BPE ids and back."""
    return bpe.token_report(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document that repeat 100 bytes of an earlier place."""
    return suffix_dedup.repeated_report(read_table(spark, sf_dir, "documents"))


def op4_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text."""
    return pii.private_report(read_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text, learned from the labels."""
    return quality.quality_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    return neighbours.nearest_vectors(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back per document."""
    return token_files.token_file_report(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose shingle sets link."""
    groups = jaccard.similar_groups(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id", "class_id")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from the texts that name theirs."""
    return language.language_report(read_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays of each group of equal texts."""
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a code of four entries of integer codebooks."""
    return vector_codes.vector_code_report(read_table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, the words one letter away, and the frequent form of rare ones."""
    return spelling.spelling_report(read_table(spark, sf_dir, "documents"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness."""
    return fingerprints.fingerprint_report(read_table(spark, sf_dir, "documents"))


_QUERIES = (
    op1_mixing, op2_bpe, op3_suffix_dedup, op4_private_data, op5_quality, op6_neighbours, op7_token_files, op8_jaccard_join,
    op9_language, op10_exact_dedup, op11_vector_codes, op12_spelling_variants, op13_fingerprints,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query per operator."""
    return {f.__name__: f for f in _QUERIES}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP10 = f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM d
"""


OP8 = f"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END)) AS s FROM w),
c AS MATERIALIZED (SELECT min(doc_id) AS class_id, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
e AS MATERIALIZED (SELECT class_id, n, unnest(s) AS g FROM c),
l AS MATERIALIZED (
  SELECT a.class_id AS x, b.class_id AS y FROM e a JOIN e b ON a.g = b.g AND a.class_id <> b.class_id
  GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT class_id AS x, class_id AS y FROM c UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT doc_id, len(s.s) AS n_shingles, coalesce(g.component_id, doc_id) AS component_id, coalesce(c.class_id, doc_id) AS class_id
FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) g ON g.x = c.class_id
"""


def _op11(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The rounds one after the other; sums of whole numbers below 2^53 are exact in double precision."""
    steps = [
        """v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""p AS MATERIALIZED (
  SELECT vec_id, label, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS x
  FROM v, (SELECT unnest(range({parts})) AS part))""",
        f"""c0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id, x) - 1 AS e, x AS c FROM p
  QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id, x) <= {entries})""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, any_value(label) AS label, p.part, any_value(x) AS x,
    min((list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::BIGINT * {entries} + e) AS best
  FROM p JOIN c{r} USING (part) GROUP BY vec_id, p.part)""")
        if r == rounds:
            break
        steps.append(f"""s{r} AS MATERIALIZED (
  SELECT part, best % {entries} AS e, i, sum(x[i]::BIGINT) AS s, count(*) AS n
  FROM a{r}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM p))) AS i) GROUP BY ALL)""")
        steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT part, e, coalesce(m, c) AS c FROM c{r} LEFT JOIN (
    SELECT part, e, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS m FROM s{r} GROUP BY part, e) USING (part, e))""")
    steps.append(f"""f AS MATERIALIZED (
  SELECT vec_id, any_value(label) AS label, string_agg(lpad(lower(to_hex(best % {entries})), 2, '0'), '' ORDER BY part) AS code,
    sum(best // {entries})::BIGINT AS error FROM a{rounds} GROUP BY vec_id)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY part, e)) FROM c{rounds})
    AS codebooks_sha256
FROM f
"""


# crc32 by its table of 256 remainders, byte by byte; the letters of a word have one or two bytes.
OP12 = r"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
t AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
r AS MATERIALIZED (
  SELECT id, unnest(regexp_extract_all(@LOWER@,
    '[a-z\x{C0}-\x{FF}]+')) AS w FROM (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS id, text FROM documents)),
l AS MATERIALIZED (SELECT id, w FROM r WHERE length(w) >= 7),
h AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(id || w, ''),
    lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [195::BIGINT, (unicode(ch) - 64)::BIGINT] END))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM l, t),
e AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM h),
v AS MATERIALIZED (SELECT word, count(*) AS n FROM e WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
c AS MATERIALIZED (
  SELECT word, n, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM v, LATERAL (SELECT unnest(range(length(word))) AS i)),
d AS MATERIALIZED (
  SELECT DISTINCT c.word AS x, c.n AS xn, v.word AS y, v.n AS yn FROM c JOIN v ON v.word = c.a || c.b),
m AS MATERIALIZED (
  SELECT x, xn, y, yn FROM d UNION ALL SELECT y, yn, x, xn FROM d
  UNION ALL SELECT c.word, c.n, o.word, o.n FROM c JOIN c o ON c.a = o.a AND c.b = o.b AND c.word <> o.word),
g AS MATERIALIZED (
  SELECT x AS word, count(*) AS n_near, CASE WHEN max(yn) >= 10 * any_value(xn) THEN max(yn) END AS form_n,
    CASE WHEN max(yn) >= 10 * any_value(xn) THEN arg_min(y, {'n': -yn, 'y': encode(y)}) END AS form
  FROM m GROUP BY x),
f(word, root) AS (
  SELECT word, form FROM g WHERE form IS NOT NULL
  UNION ALL SELECT f.word, g.form FROM f JOIN g ON g.word = f.root WHERE g.form IS NOT NULL)
SELECT v.word, v.n, coalesce(g.n_near, 0)::BIGINT AS n_near, g.form, g.form_n,
  coalesce((SELECT q.root FROM f q JOIN v z ON z.word = q.root WHERE q.word = v.word ORDER BY z.n DESC LIMIT 1), v.word) AS root
FROM v LEFT JOIN g USING (word)
""".replace("@LOWER@", _LOWER)


def oracle_sql() -> dict[str, str]:
    """SQL for the queries SQL can express."""
    return {"op8_jaccard_join": OP8, "op10_exact_dedup": OP10, "op11_vector_codes": _op11(), "op12_spelling_variants": OP12}
