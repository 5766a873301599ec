"""The registered queries of this subpackage, one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, fim, langid, licences, ngram_join, packing, runs, sharding, simhash, topk, warc
from .common import delete_at_end, scratch_path, ship, table

QueryFn = Callable[[SparkSession, str], DataFrame]


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=3, distance=3)
    return found.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), digest_all=True)
    return found.select("rec.doc_id", "keep_id", "group_size", "kept", F.col("full_hash").alias("text_sha256"))


OP2_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


def op5_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return licences.scan_licences(table(spark, sf_dir, "documents")).withColumn("sentences", F.concat_ws(",", "sentences"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    delete_at_end(spark, path)
    read = warc.read_archives(spark, path, with_payload=False)
    # what was just written reads back whole: a gap is a lost record, and an error
    kind = F.when(F.col("kind") == "gap", F.raise_error(F.concat_ws(" ", F.lit("a record was lost:"), "archive", F.col("offset").cast("string"), "reason"))).otherwise(F.col("kind"))
    return read.select("page_id", "payload_bytes", "payload_digest", kind.alias("record_type"), "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 100 OR page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 100 OR page_id = least THEN NULL ELSE least END AS refers_to
FROM f
"""

def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = table(spark, sf_dir, "documents").select("doc_id", bpe.encode_column("text", vocabulary, public_tokenizers.PATTERN).alias("ids"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                        F.sha2(bpe.decode_column("ids", vocabulary), 256).alias("decoded_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out)
    dictionaries = langid.learn(docs.where("not held_out"))
    return docs.select("doc_id", "held_out", langid.predict_column("text", dictionaries).alias("p")).select("doc_id", "held_out", "p.*")


#: The conversation that the contract adds: both texts hold what looks like marks.
ADDED_ID, ADDED_TEXT = -7, r"\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(ADDED_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ADDED_TEXT).alias("text"))
    made = chat.format_conversations(turns.union(added))
    read = made.select("conv_id", chat.read_turns(chat.formatted_text()).alias("turns"), chat.read_loss(F.col("pieces")).alias("loss"),
                       F.length(chat.formatted_text()).cast("long").alias("formatted_chars"))
    told = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


OP10_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS chars, length(replace(replace(role, '\', '\\'), '<|', '<\|')) AS role_chars,
             lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS before FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars + CASE WHEN before = role THEN length('<|next|>') ELSE length('<|start|><|text|><|end|>') + role_chars END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"), seed=42, rate=50, spm_rate=80)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fim.restore("output", "form"), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
                  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
d AS (SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""

def planted_periods(docs: DataFrame) -> DataFrame:
    """The contract's texts: of every tenth document, the words from one on repeat the first few of these."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("words"))
    docs = docs.withColumn("n", F.size("words")).withColumn("a", F.expr("int(if(n > 0, g % n, 0))")).withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.expr("int((n - a + p - 1) div p)")))
    made = F.concat_ws(" ", F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), again), F.lit(1), F.col("n")))
    return docs.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = runs.periodic_runs(planted_periods(table(spark, sf_dir, "documents")))
    found = found.withColumn("best", runs.strongest("runs"))
    told = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), words=5, percent=80)


QUERIES: dict[str, QueryFn] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_jump_sharding": op5_jump_sharding,
    "op6_licence_scan": op6_licence_scan,
    "op7_warc": op7_warc,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_language_id": op9_language_id,
    "op10_chat_format": op10_chat_format,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_ngram_jaccard_join": op13_ngram_jaccard_join,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": OP2_SQL,
    "op4_exact_top_k": OP4_SQL,
    "op7_warc": OP7_SQL,
    "op10_chat_format": OP10_SQL,
    "op11_fill_in_middle": OP11_SQL,
}
