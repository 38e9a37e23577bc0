"""The registered queries of the subpackage: opN_<name>, each over its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.llm import (bpe, chat, html_crf, iblt, lexical, mixing, quality, repeats, simhash, token_files, topk, warc,
                           whitening)
from shelfmark.session import work_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern, decoded="decoded")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op2_main_text")
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = html_crf.fit(html_crf.labelled_pages())
    return html_crf.extract(table(spark, sf_dir, "pages"), model)


@query("op3_warc")
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = work_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), archives)
    read = warc.read_archives(spark, archives)
    stored = F.col("record_type") == "response"
    return read.select(
        warc.page_number(F.col("record_id")).alias("page_id"),
        F.when(stored, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(stored, F.sha1("payload")).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type", warc.page_number(F.col("refers_to")).alias("refers_to"))


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = simhash.fingerprints(table(spark, sf_dir, "documents"), shingle=4)
    found = simhash.near_duplicates(marks, max_bits=4)
    return found.select(F.col("id").alias("doc_id"),
                        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


MIX_WEIGHTS = [3, 1, 2]


@query("op5_mix", mixing.mix_sql(MIX_WEIGHTS))
def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS)


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_path(spark, "token-ids")
    files = token_files.write_files(table(spark, sf_dir, "documents"), folder,
                                    public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return (token_files.read_files(spark, folder, files)
            .select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")))


@query("op7_iblt")
def op7_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.compare_with_edits(table(spark, sf_dir, "documents"))


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model)


@query("op9_repeats")
def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.kept_words(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_top_k", """
    WITH v AS (
      SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (
      SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    WHERE rank <= 10""")
def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


@query("op11_lexical", lexical.search_sql(50))
def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), 50)


@query("op12_whiten")
def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), 16)
    return found.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


class _ChatDigest:
    """Counts and digests of one conversation, fed turn by turn."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n, self.loss_chars, self.chars = 0, 0, 0

    def piece(self, text: str) -> None:
        self.chars += len(text)

    def turn(self, role: str, text: str) -> None:
        self.n += 1
        self.turns.update(f"{role}\n{text}\n".encode())

    def learned(self, text: str) -> None:
        self.loss_chars += len(text)
        self.loss.update(text.encode())

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


@query("op13_chat")
def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    said = "</s>[INST] ok [/INST]"
    records = (rows.select(F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
               .union(spark.range(1).select(F.to_json(F.struct(F.lit(-1).alias("conv_id"), F.array(*(
                   F.struct(F.lit(role).alias("role"), F.lit(said).alias("content")) for role in ("user", "assistant")))
                   .alias("messages"))))))
    chats = work_path(spark, "chats")
    chat.format_chats(records, chats)
    return chat.fold_chats(chat.read_chats(spark, chats), _ChatDigest,
                           "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
