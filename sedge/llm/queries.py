"""One query for each operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, decontaminate, neardup, personal, phrases, pieces, pitmanyor, quality, rules, sharding, substrings, tokenfiles


#: Vocabulary files of public tokenizers; a parameter of the operators.
TOKENIZERS = os.environ.get("SEDGE_TOKENIZERS", "/opt/tokenizers")
#: The free id of the byte-pair vocabularies, a text of control strings, and how texts are split before merging.
SEPARATOR = 50256
HARD = "</s>[INST] ok [/INST]"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitmanyor.score_texts(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), pieces.Vocabulary.read(f"{TOKENIZERS}/piece_bpe_32k.model"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of whole texts; file names hang on partitions and are left out."""
    ranks, pattern = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken", PATTERN
    return tokenfiles.document_token_counts(table(spark, sf_dir, "documents"), ranks, pattern, SEPARATOR).select("doc_id", "n_tokens")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find_personal(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, personal.KINDS), F.sha2(personal.written(F.col("base")), 256).alias("base_sha256"), personal.written(F.col("spans")).alias("spans"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(F.encode(text, "UTF-8"))
    placed = sharding.shard(table(spark, sf_dir, "documents"), 8, carry={"size": size, "text_crc32": crc})
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the table are records of one turn each; a conversation whose texts look like marks goes with them."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)], "conv_id long, turn long, role string, text string")
    record = F.to_json(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    return chat.chat_report(said.unionByName(hard).select("conv_id", "turn", record.alias("record")))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = alignment.Pair(f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")
    return alignment.link_report(table(spark, sf_dir, "documents"), pair)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_pitman_yor, op3_quality_rules, op4_sentencepiece, op5_token_counts, op6_personal_data, op7_minhash_neardup, op8_decontamination, op9_sharding, op10_substring_dedup, op11_chat_format, op12_alignment, op13_phrases)}

#: Words of each document, split at ASCII white space.
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP10 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM s),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS again FROM h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM r WHERE again),
g AS (SELECT doc_id, list(k) AS gone FROM c GROUP BY doc_id),
o AS (SELECT d.doc_id, d.w, coalesce(gone, []) AS gone FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, len(w) AS n_words, len(gone) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, k: NOT list_contains(gone, k)), ' ')) AS kept_sha256
FROM o
"""

OP3 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 2], ' ')) AS n FROM x),
z AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM y WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT doc_id, source, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d JOIN l USING (doc_id) LEFT JOIN z USING (doc_id)),
f AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
r AS (SELECT source, 'base' AS rule, base_failed AS bad FROM f
      UNION ALL SELECT source, 'symbols', 10 * n_symbols > n_words FROM f
      UNION ALL SELECT source, 'dup_lines', n_dup_lines > 0 AND 100 * n_dup_lines > 5 * n_words FROM f
      UNION ALL SELECT source, 'word_length', n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) FROM f),
h AS (SELECT source, rule, count(*) AS docs, sum(CAST(bad AS INT)) AS failed FROM r WHERE source IS NOT NULL GROUP BY ALL),
t AS (SELECT rule, sum(docs) AS n, sum(docs * docs) AS n2, count(*) AS k, sum(failed) / sum(docs) AS mean FROM h GROUP BY rule),
v AS (SELECT rule, mean, mean * (1 - mean) AS noise,
             (sum(docs * (failed / docs - mean) ** 2) - (any_value(k) - 1) * mean * (1 - mean)) / nullif(any_value(n) - any_value(n2) / any_value(n), 0) AS between_hosts
      FROM h JOIN t USING (rule) GROUP BY rule, mean),
p AS (SELECT rule, mean, CASE WHEN between_hosts > 0 THEN least(1e6, greatest(2, noise / between_hosts - 1)) ELSE 1e6 END AS weight FROM v),
g AS (SELECT source, bool_or((failed + weight * mean) / (docs + weight) > 0.5) AS rejected FROM h JOIN p USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM f LEFT JOIN g USING (source)
"""

#: All pairs by shared shingles, then everything reachable; for tables of some thousand documents.
OP7 = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM d),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
q AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS id, doc_id AS c FROM s UNION SELECT q.b, r.c FROM r JOIN q ON q.a = r.id),
m AS (SELECT id AS doc_id, min(c) AS component_id FROM r GROUP BY id)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (doc_id)
"""

#: The template of sedge.llm.chat written out: marks, escapes, order of turns.
OP11 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (SELECT *, regexp_replace(replace(role, '\', '\\'), '(<)(\|role\|>|\|text\|>|\|end\|>|s>|/s>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>)|(\[)(INST\]|/INST\])', '\1\3\\\2\4', 'g') AS safe_role,
             regexp_replace(replace(text, '\', '\\'), '(<)(\|role\|>|\|text\|>|\|end\|>|s>|/s>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>)|(\[)(INST\]|/INST\])', '\1\3\\\2\4', 'g') AS safe_text FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|role|>' || safe_role || '<|text|>' || safe_text || '<|end|>')) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

#: All runs of up to four words, counted and cut one by one.
OP13 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, w, i, unnest([1, 2, 3, 4]) AS k FROM i),
f AS MATERIALIZED (SELECT lang, k, w[i:i + k - 1] AS g, count(*) AS f FROM g WHERE i + k - 1 <= len(w) GROUP BY ALL),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM f WHERE k > 1 AND f >= 30),
s AS (SELECT lang, f, unnest(CASE WHEN k = 3 THEN [g[1:2], g[2:3]] ELSE [g[1:2], g[2:3], g[3:4], g[1:3], g[2:4]] END) AS g FROM c WHERE k > 2),
m AS (SELECT lang, g, max(f) AS longer FROM s GROUP BY ALL),
d AS (SELECT c.* FROM c LEFT JOIN m USING (lang, g) WHERE longer IS NULL OR 100 * longer < 80 * f),
u AS (SELECT lang, k, g, f, unnest(range(1, k)) AS m FROM d),
v AS (SELECT u.lang, u.g, u.f AS a, x.f AS l, y.f AS r, m, CAST(floor(CAST(2000000 AS HUGEINT) * u.f // (x.f + y.f)) AS BIGINT) AS score
      FROM u JOIN f x ON x.lang = u.lang AND x.g = u.g[1:m] JOIN f y ON y.lang = u.lang AND y.g = u.g[m + 1:]),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, m) AS o FROM v),
r AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM b WHERE o = 1),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM r)
SELECT lang, rank, phrase, a, l, r, n, score FROM q JOIN t USING (lang) WHERE rank <= 2000
"""

ORACLES = {"op3_quality_rules": OP3, "op7_minhash_neardup": OP7, "op10_substring_dedup": OP10, "op11_chat_format": OP11, "op13_phrases": OP13}
