"""The operators of this subpackage applied to the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trencher.llm import (alignment, chat, class_lm, decontaminate, line_dedup, packing, permutation_index, quality_classifier, quality_rules, repair,
                          sharding, simhash, token_shards)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_best_fit_packing")
def best_fit_packing(spark, folder):
    pieces = packing.token_pieces(table(spark, folder, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op7_simhash_near_dedup")
def simhash_near_dedup(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


@query("op10_benchmark_decontamination")
def benchmark_decontamination(spark, folder):
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OWN_CONVERSATION = [(-7, turn, role, r"\### Assistant: </turn> ok") for turn, role in enumerate(("user", "assistant"))]


@query("op4_prefix_target_expansion", r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(role) + length(text) + (length(text) - length(replace(text, '\', '')))
    + (length(text) - length(replace(text, '</turn>', ''))) / 7 + (length(text) - length(replace(text, '### ', ''))) / 4) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""")
def prefix_target_expansion(spark, folder):
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame(OWN_CONVERSATION, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(given.unionByName(own)))


@query("op5_host_quality_rules", r"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS pos FROM w WHERE len(words) >= 3),
r AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, words[pos], words[pos + 1], words[pos + 2]) AS n FROM g) WHERE n >= 2),
rep AS (SELECT doc_id, count(DISTINCT pos + k) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
f AS (SELECT w.doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
h AS (SELECT source, unnest([{'k': 1, 'x': count(*) FILTER (n_words < 50)}, {'k': 2, 'x': count(*) FILTER (100 * n_repeat_words > 50 * n_words)},
  {'k': 3, 'x': count(*) FILTER (10 * n_symbols > n_words)}, {'k': 4, 'x': count(*) FILTER (10 * n_dup_lines > 3 * n_lines)}], recursive := true), count(*) AS n FROM v GROUP BY source),
m AS (SELECT k, sum(x)::DOUBLE / sum(n) AS m, sum(n)::DOUBLE AS pages, count(*) AS hosts FROM h GROUP BY k),
s AS (SELECT k, any_value(m) AS m, sum(n * (x::DOUBLE / n - m) ** 2) / any_value(pages) - any_value(m * (1 - m) * hosts / pages) AS beyond FROM h JOIN m USING (k) GROUP BY k),
p AS (SELECT k, m, CASE WHEN beyond <= 0 THEN 1e6 ELSE least(1e6, greatest(1, m * (1 - m) / beyond - 1)) END AS weight FROM s),
rate AS (SELECT source, max((x + m * weight) / (n + weight)) AS host_rate FROM h JOIN p USING (k) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_rate <= 0.5 AS kept
FROM v JOIN rate ON v.source IS NOT DISTINCT FROM rate.source""")
def host_quality_rules(spark, folder):
    found = quality_rules.judged(table(spark, folder, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op8_brown_class_lm")
def brown_class_lm(spark, folder):
    found = class_lm.scores(table(spark, folder, "documents"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op2_site_relative_line_dedup", r"""WITH d AS (SELECT doc_id, source, text FROM documents),
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d WHERE text IS NOT NULL),
b AS (SELECT doc_id, source, line, pos, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM l),
pages AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
f AS (SELECT source, bare FROM (SELECT source, bare, count(DISTINCT doc_id) AS n FROM b WHERE bare <> '' GROUP BY source, bare) JOIN pages USING (source) WHERE n >= 5 AND n > 0.1::DOUBLE * pages),
k AS (SELECT doc_id, line, pos, f.bare IS NULL AS kept FROM b LEFT JOIN f ON b.source = f.source AND b.bare = f.bare)
SELECT doc_id, count(*) FILTER (NOT kept) AS lines_dropped, CAST(length(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (kept), '')) AS BIGINT) AS n_chars,
  md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (kept), '')) AS text_md5 FROM k GROUP BY doc_id""")
def site_relative_line_dedup(spark, folder):
    found = line_dedup.without_boilerplate(table(spark, folder, "documents"))
    return found.select("doc_id", "lines_dropped", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("op3_feistel_token_shards")
def feistel_token_shards(spark, folder):
    written = token_shards.shards(token_shards.sequences(table(spark, folder, "documents")))
    return token_shards.records(written).select("doc_id", "piece", "slot", "shard", "byte_offset", F.col("length").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query("op6_hierarchical_bayes_quality")
def hierarchical_bayes_quality(spark, folder):
    found = quality_classifier.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select("doc_id", "low_quality", "toxic", "kept")


@query("op9_extendible_hash_shards")
def extendible_hash_shards(spark, folder):
    found = sharding.sharded(table(spark, folder, "documents"))
    return found.select("doc_id", "shard", "depth", "n_bytes", "shard_bytes", F.crc32("text").alias("text_crc32"))


@query("op11_cross_tokenizer_alignment")
def cross_tokenizer_alignment(spark, folder):
    return alignment.alignment(table(spark, folder, "documents"))


@query("op12_conversation_repair", r"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
    lambda x: ascii(x)::BIGINT)), lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 20 AS kind
  FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE kind <> 0),
o AS (SELECT conv_id, turn, role, text, left(role, 1) AS r, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN nth > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault,
  r || lead(r) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM o),
w(conv_id, i, s) AS (SELECT conv_id, 0::BIGINT, [{'c': 0, 'a': '', 't': ''}, {'c': 1000000, 'a': '', 't': ''}, {'c': 1000000, 'a': '', 't': ''}, {'c': 1000000, 'a': '', 't': ''}] FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, i, [{'c': e[1].c + 3, 'a': e[1].a || 'D', 't': e[1].t},
    list_min([{'c': e[2].c + 3, 'a': e[2].a || 'D', 't': e[2].t}, {'c': e[1].c + cut + CASE WHEN r = 's' AND free THEN 0 ELSE 1000000 END, 'a': e[1].a || 'K', 't': e[1].t || own}]),
    list_min(list_concat([{'c': e[3].c + 3, 'a': e[3].a || 'D', 't': e[3].t}], flatten([[{'c': e[k].c + cut + CASE WHEN r = 'u' AND free THEN 0 ELSE 1000000 END, 'a': e[k].a || 'K', 't': e[k].t || own},
      {'c': e[k].c + 2 + cut + CASE WHEN free THEN 0 ELSE 1000000 END, 'a': e[k].a || 'R', 't': e[k].t || 'user:' || text || chr(10)}] for k in [1, 2, 4]]))),
    list_min([{'c': e[4].c + 3, 'a': e[4].a || 'D', 't': e[4].t}, {'c': e[3].c + cut + CASE WHEN r = 'a' AND free THEN 0 ELSE 1000000 END, 'a': e[3].a || 'K', 't': e[3].t || own},
      {'c': e[3].c + 2 + cut + CASE WHEN free THEN 0 ELSE 1000000 END, 'a': e[3].a || 'R', 't': e[3].t || 'assistant:' || text || chr(10)}])]
    FROM (SELECT f.conv_id, f.i, f.r, f.text, f.role || ':' || f.text || chr(10) AS own, f.fault NOT IN ('b', 'd') AS free, CASE WHEN f.fault = 't' THEN 1 ELSE 0 END AS cut,
      [s[1], s[2], x2, list_min([s[4], {'c': x2.c + 2, 'a': x2.a || 'I', 't': x2.t || 'assistant:' || chr(10)}])] AS e
      FROM (SELECT *, list_min([s[3], {'c': s[1].c + 2, 'a': s[1].a || 'I', 't': s[1].t || 'user:' || chr(10)}, {'c': s[2].c + 2, 'a': s[2].a || 'I', 't': s[2].t || 'user:' || chr(10)},
        {'c': s[4].c + 2, 'a': s[4].a || 'I', 't': s[4].t || 'user:' || chr(10)}]) AS x2 FROM w) AS w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1)),
z AS (SELECT conv_id, list_min([s[1], s[4], {'c': s[3].c + 2, 'a': s[3].a || 'I', 't': s[3].t || 'assistant:' || chr(10)},
  {'c': s[2].c + 4, 'a': s[2].a || 'II', 't': s[2].t || 'user:' || chr(10) || 'assistant:' || chr(10)}]) AS best FROM w QUALIFY i = max(i) OVER (PARTITION BY conv_id))
SELECT z.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, CAST(any_value(best.c) AS BIGINT) AS cost, any_value(best.a) AS audit,
  sha256(regexp_replace(any_value(best.t), chr(10) || '$', '')) AS repaired_sha256
FROM z LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM z.conv_id GROUP BY z.conv_id""")
def conversation_repair(spark, folder):
    return repair.repaired_after_damage(table(spark, folder, "conversations"))


@query("op13_permutation_index")
def permutation_index_search(spark, folder):
    return permutation_index.search(table(spark, folder, "embeddings"), every=100)
