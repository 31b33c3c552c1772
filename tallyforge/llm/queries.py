"""The queries opN_<name> over their whole tables, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import fresh_path, table

#: Distinct sites from which a line counts as boilerplate, of about twenty.
MIN_SITES = 10


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def op1_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.media import probe_audio, store_audio

    return probe_audio(store_audio(_docs(spark, sf_dir))).drop("texts")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.minhash import near_duplicates

    found = near_duplicates(_docs(spark, sf_dir), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op3_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.quality import clean_lines

    return clean_lines(_docs(spark, sf_dir)).drop("clean_text")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.tokens import count_tokens

    counted = count_tokens(_docs(spark, sf_dir), fresh_path(spark, "token_cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.substring import dedup_substrings

    return dedup_substrings(_docs(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.toxicity import learnable, score_toxicity

    scored = score_toxicity(_docs(spark, sf_dir), learnable(table(spark, sf_dir, "labels", "doc_id", "toxic")))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "score", "predicted", "evidence")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents", "doc_id", "text", "source")).drop("row_key")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.license import scan_licenses

    return scan_licenses(_docs(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.lines import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text", "source"), MIN_SITES)
    return out.select("doc_id", "lines_total", "lines_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.pieces import encode_pieces, piece_digests

    return piece_digests(encode_pieces(_docs(spark, sf_dir)))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.chat import Template, chat_digests, format_log, read_chats, turns_as_log

    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    turns = turns.unionByName(spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], turns.schema))
    template = Template()
    return chat_digests(read_chats(format_log(turns_as_log(turns), template), template))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.whitening import whiten_embeddings

    return whiten_embeddings(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.repair import damage, repair_conversations

    return repair_conversations(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"), damage)


QUERIES = {
    f.__name__: f
    for f in (op1_media_audio, op2_minhash, op3_quality_lines, op4_token_counts, op5_substring_dedup, op6_toxicity, op7_mixing, op8_license_scan, op9_line_dedup, op10_sentencepiece, op11_chat_format, op12_whitening, op13_conversation_repair)
}


def _line_sql() -> str:
    return rf"""
WITH pieces AS (
  SELECT doc_id, source, unnest(range(len(a))) AS pos, unnest(a) AS raw
  FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), lines AS (
  SELECT *, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM pieces
), spread AS (
  SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce(source, chr(1))) >= {MIN_SITES}
), marked AS (
  SELECT l.*, s.line IS NOT NULL AND row_number() OVER (PARTITION BY l.line ORDER BY doc_id, pos) > 1 AS gone
  FROM lines l LEFT JOIN spread s ON l.line = s.line
)
SELECT doc_id, count(*) FILTER (line <> '') AS lines_total, count(*) FILTER (gone) AS lines_removed,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def _license_sql() -> str:
    from tallyforge.llm.license import PHRASES, TEMPLATES, block_size, wider

    block, step = block_size(TEMPLATES)
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    templates = ", ".join(f"({i}, '{label}', string_split('{keys}', ' '), list_distinct(string_split('{text}', ' ')), {wider(TEMPLATES)[i]}::INTEGER[])" for i, (label, keys, text) in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{label}', string_split('{text}', ' '))" for label, text in PHRASES)
    return rf"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS low FROM documents
), w AS (
  SELECT doc_id, low, regexp_extract_all(low, '{word}') AS ws FROM d
), phrases(label, p) AS (VALUES {phrases}),
starts AS (
  SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM w WHERE low LIKE '%cc%' OR low LIKE '%license%' OR low LIKE '%reserved%'
), places AS (
  SELECT doc_id, label, i FROM starts JOIN phrases ON ws[i + 1 : i + len(p)] = p
), based AS (
  SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS b, list_distinct(list(label)) AS base FROM places GROUP BY doc_id
), templates(t_id, label, keys, t, wider) AS (VALUES {templates}),
blocks AS (
  SELECT doc_id, i, list_distinct(ws[i + 1 : i + {block}]) AS b
  FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - {block}, 0) + {step}, {step})) AS i FROM w WHERE len(ws) > 0)
), matched AS (
  SELECT doc_id, i, t_id, label, wider, len(list_intersect(t, b)) / len(t) AS c FROM blocks JOIN templates
  ON len(list_intersect(t, b)) >= ceil(0.8 * len(t) - 1e-9) AND len(list_intersect(keys, b)) = len(keys)
), together AS (
  SELECT doc_id, i, list(t_id) AS ts FROM matched GROUP BY doc_id, i
), found AS (
  SELECT doc_id, list_distinct(list(label)) AS labels, max(c) AS score
  FROM matched JOIN together USING (doc_id, i) WHERE NOT list_has_any(wider, ts) GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(labels, [])))), ',') AS labels,
  coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN based USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def _chat_sql() -> str:
    """Turns and texts straight from the table; the formatted length from the template's marks."""
    from tallyforge.llm.chat import Template

    t = Template()
    hidden, slash = t.hidden(r"(\\*)"), r"\1\\\2\3"
    sizes = " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in t.marks.items())
    other = f"{sum(map(len, t.other))} + length(regexp_replace(role, '{hidden}', '{slash}', 'g'))"
    return rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, CASE role {sizes} ELSE {other} END + length(regexp_replace(text, '{hidden}', '{slash}', 'g')) AS chars,
    CASE WHEN role = '{t.learnt}' THEN text ELSE '' END AS learnt
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(length(learnt))::BIGINT AS loss_chars, sha256(string_agg(learnt, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


_SUBSTRING_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), starts AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 49], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 48, 1))) AS i FROM w)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS lo FROM starts) WHERE lo < doc_id
), words AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM w
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM dup
), kept AS (
  SELECT words.doc_id, count(gone.j) AS n, string_agg(word, ' ' ORDER BY words.j) FILTER (gone.j IS NULL) AS k
  FROM words LEFT JOIN gone USING (doc_id, j) GROUP BY words.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

_MINHASH_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), both_ AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), least AS (
  SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, w.doc_id <= coalesce(m, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""

#: The others have none: SQL can't write audio frames (1), express the line rules and their order of precedence briefly (3),
#: tokenise (4, 10), search by cosine in learnt terms (6), route a flow (7), find eigenvectors (12) or the least
#: of the cheapest edits (13). Their tests hold them against brute force.
ORACLES = {"op2_minhash": _MINHASH_SQL, "op5_substring_dedup": _SUBSTRING_SQL, "op8_license_scan": _license_sql(), "op9_line_dedup": _line_sql(), "op11_chat_format": _chat_sql()}
