"""The registered query of each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quotaline.llm import bpe, chat, idfiles, language, multi_index, neardup, packing, phrases, quality, topk, toxicity, unigram, whitening
from quotaline.llm.shared import own_folder

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), WORD_BPE, with_ids=False)


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings."""
    said = "<|im_end|><|im_start|>assistant ok"
    columns = ["conv_id", "turn", "role", "text"]
    own = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t (turn, role)")
    return chat.digests(chat.examples(table(spark, folder, "conversations").select(columns).unionByName(own)))


def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), BYTE_BPE)


def op6_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), lambda i: i % 20 == 0)


def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"))


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return unigram.token_counts(table(spark, folder, "documents"), PIECES)


def op9_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return multi_index.search(table(spark, folder, "embeddings"), lambda i: i % 20 == 0)


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.predict(table(spark, folder, "documents"))


def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


def op12_binary_output(spark: SparkSession, folder: str) -> DataFrame:
    files = own_folder(spark, "ids")
    idfiles.write(table(spark, folder, "documents"), WORD_BPE, files)
    return idfiles.read(spark, files, with_ids=False)


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(table(spark, folder, "embeddings")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_packing, op3_toxicity, op4_chat_formatting, op5_bpe, op6_exact_top_k, op7_near_duplicates, op8_token_counts, op9_nearest_neighbours, op10_language_id, op11_phrase_collocations, op12_binary_output, op13_embedding_whitening)}


#: Formatted length of a turn: 12 + 11 characters of the template, a line feed, role and escaped text.
OP4_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), sized AS (
  SELECT *, sum(24 + length(role) + length(replace(replace(text, '\', '\\'), '<|', '<\|')))
      OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS is_last
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) FILTER (WHERE role = 'assistant' OR is_last) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS vec FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, e.vec_id, CAST(list_inner_product(q.vec, e.vec) AS BIGINT) AS score
  FROM v q JOIN v e ON q.vec_id <> e.vec_id AND len(q.vec) = len(e.vec) WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP7_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingled AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM worded WHERE len(w) > 0)
), sized AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sized x ON a = x.doc_id JOIN sized y ON b = y.doc_id WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reached.doc_id, ways.b FROM reached JOIN ways ON reached.r = ways.a
)
SELECT d.doc_id, coalesce(sized.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sized USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reached GROUP BY doc_id) c USING (doc_id)
"""

OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
runs AS (
  SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (VALUES (1), (2), (3)) AS t (k) WHERE len(w) >= k
), counted AS MATERIALIZED (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, lang || chr(10) || array_to_string(w[i : i + k - 1], ' ') AS key, count(*) AS f
  FROM runs GROUP BY ALL
), candidates AS MATERIALIZED (
  SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k >= 2 AND f >= 10
), parts AS (
  SELECT *, 1 AS j, lang || chr(10) || w[1] AS head, lang || chr(10) || array_to_string(w[2 : k], ' ') AS tail FROM candidates
  UNION ALL SELECT *, 2, lang || chr(10) || array_to_string(w[1 : 2], ' '), lang || chr(10) || w[3] FROM candidates WHERE k = 3
), cuts AS (
  SELECT p.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM parts p JOIN counted x ON x.key = p.head JOIN counted y ON y.key = p.tail
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, array_to_string(w[1 : 2], ' ') AS phrase, a FROM candidates WHERE k = 3
    UNION ALL SELECT lang, array_to_string(w[2 : 3], ' '), a FROM candidates WHERE k = 3
  ) GROUP BY ALL
), kept AS (
  SELECT s.lang, s.phrase, s.a, s.l, s.r, s.score FROM lowest s LEFT JOIN longer o ON o.lang = s.lang AND o.phrase = s.phrase
  WHERE o.a IS NULL OR 100 * o.a < 50 * s.a
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank FROM kept
), totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_formatting": OP4_SQL, "op6_exact_top_k": OP6_SQL, "op7_near_duplicates": OP7_SQL, "op11_phrase_collocations": OP11_SQL}
