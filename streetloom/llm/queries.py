"""The registered queries of this subpackage: one for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, lines, media, quality, simhash, substrings, toxicity, urlfilter
from .urlfilter import Rule

#: The rules of op7_url_filters.
URL_RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TOXIC_THRESHOLD, QUALITY_THRESHOLD = 0.3, 0.5


def remainder(modulus: int) -> F.Column:
    """The part of the rows that an id falls in, by its checksum."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def tokenizer() -> tuple[str, str]:
    """Path of the rank file and the pattern of op10_byte_bpe."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(_table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    made = chat.format_conversations(turns.unionByName(extra))
    read = made.select(
        "conv_id", F.length("formatted").cast("long").alias("formatted_chars"),
        chat.read_turns(F.col("formatted")).alias("turns"), F.array_join(chat.read_loss(F.col("formatted"), F.col("loss")), "").alias("learned"),
    )
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars",
    )


#: So many words of repeated sentences or lines in a row are a paragraph.
RUN_WORDS = 20


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=1, pattern=lines.SENTENCES, run_words=RUN_WORDS)
    offsets = F.array_join(F.transform("removed", lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["stop"].cast("string"))), ",")
    return found.select("doc_id", "n_units", "n_removed", offsets.alias("removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.train(docs, labels, training=remainder(4) != 2)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(_table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return found.select(
        "doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= TOXIC_THRESHOLD).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), kept_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), training=remainder(3) != 1)
    found = quality.score(docs, model)
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), *tokenizer())


QUERIES = {
    f.__name__: f
    for f in (
        op1_media_columns, op2_chat_formatting, op3_substring_dedup, op4_toxicity, op5_benchmark_decontamination,
        op6_simhash_near_dedup, op7_url_filters, op8_suffix_array_dedup, op9_quality_classifier, op10_byte_bpe,
    )
}
_CHAT_SQL = r"""WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (SELECT *, replace(replace(replace(text, '\', '\\'), '</turn>', '\e'), '### ', '\h') AS e,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length(e) + 8 + CASE WHEN role IS DISTINCT FROM before THEN length(role) + 6 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id"""

# Units end behind U+FDD0, which no text holds.
_LINES_SQL = r"""WITH docs AS (SELECT doc_id, text, string_split(regexp_replace(regexp_replace(text, '([.!?])([\x09-\x0D\x20])', '\1' || chr(64976) || '\2', 'g'), '([\n\x{3002}\x{FF01}\x{FF1F}])', '\1' || chr(64976), 'g'), chr(64976)) AS units FROM documents),
units AS (SELECT doc_id, unnest(units) AS unit, unnest(range(1, len(units) + 1)) AS place FROM docs WHERE text IS NOT NULL),
known AS (SELECT *, translate(trim(regexp_replace(unit, '[\x09-\x0D\x20]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k, sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY place) AS stop FROM units),
ranked AS (SELECT doc_id, place, stop - length(unit) AS start, stop, len(string_split(k, ' ')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, place) > 1 AS again FROM known WHERE k <> ''),
islands AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS island FROM ranked WHERE again),
runs AS (SELECT doc_id, min(start) AS start, max(stop) AS stop, min(place) AS a, max(place) AS z FROM islands GROUP BY doc_id, island HAVING sum(words) >= 20),
cut AS (SELECT doc_id, CAST(sum(z - a + 1) AS BIGINT) AS n_removed, string_agg(CAST(start AS BIGINT) || '-' || CAST(stop AS BIGINT), ',' ORDER BY start) AS removed, list((a, z)) AS spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(units), 0) AS BIGINT) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed,
  sha256(CASE WHEN spans IS NULL THEN coalesce(text, '') ELSE array_to_string([units[i] FOR i IN range(1, len(units) + 1) IF len([1 FOR s IN spans IF s[1] <= i AND i <= s[2]]) = 0], '') END) AS kept_sha256
FROM docs d LEFT JOIN cut USING (doc_id)"""

_URL_SQL = r"""WITH parts AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
judged AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM (SELECT *, CASE
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM judged)"""

#: For tables as generated: document ids are unique, and no page has a canonical link or a redirect.
ORACLES: dict[str, str] = {"op2_chat_formatting": _CHAT_SQL, "op3_substring_dedup": _LINES_SQL, "op7_url_filters": _URL_SQL}
