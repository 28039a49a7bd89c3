"""One query for each corpus operator, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, dedup, jaccard, langid, mixing, quality, secrets, tokens, warc
from .common import read, write_table
from .langid import held_out

TOKENIZER = "byte_bpe_50k.json"
#: Whose whole words, by frequency, are op8's dictionary.
WORDS = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_variant_object(F.struct("role", "text")).alias("record"))
    said = "</s>[INST] ok [/INST]"
    own = json.dumps({"messages": [{"role": r, "content": said} for r in ("user", "assistant")]})
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.parse_json(F.lit(own)).alias("record"))
    formatted = write_table(chat.format_chats(rows.unionByName(extra), "conv_id", "turn"), "chats")
    got = chat.parse_chats(formatted, "conv_id")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return got.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    known = langid.learn(docs.filter(F.col("doc_id").isNotNull() & ~held_out()).select("text", "lang"))
    got = langid.identify(docs.select("doc_id", "text"), known)
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("source")


def op5_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    machine = quality.train(docs, read(spark, sf_dir, "labels").filter(~held_out()))
    got = quality.score(docs, machine)
    return got.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pages_through_warc(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(read(spark, sf_dir, "documents"), words=tokenizer_path(WORDS))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(read(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_binary(read(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict:
    return {f.__name__: f for f in (op1_chat_format, op2_decontaminate, op3_language_id, op4_mix_sources, op5_quality_fm, op6_arc_to_warc, op7_exact_dedup, op8_secret_scan, op9_ngram_jaccard, op10_token_binary)}


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in chat.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


def oracle_sql() -> dict[str, str]:
    marks = len(chat.START) + len(chat.SEP) + len(chat.END)
    return {
        "op1_chat_format": f"""
            with rows as (
              select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
              union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
            )
            select conv_id, count(*) as n_turns,
              sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
              sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
              sha256(coalesce(string_agg(case when role = 'assistant' then text else '' end, '' order by turn), '')) as loss_sha256,
              sum({marks} + length({_escaped("role")}) + length({_escaped("text")}))::bigint as formatted_chars
            from rows group by conv_id""",
        "op6_arc_to_warc": f"""
            with p as (
              select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
            ), q as (select *, max(page_id) over (partition by payload_digest) as last from p)
            select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
              case when payload_bytes >= {warc.LEAST_REVISIT} and page_id < last then 'revisit' else 'response' end as record_type,
              case when payload_bytes >= {warc.LEAST_REVISIT} and page_id < last then last end as refers_to
            from q""",
        "op7_exact_dedup": r"""
            with n as (
              select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents
            )
            select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
              doc_id = min(doc_id) over w as kept, text_sha256
            from n window w as (partition by text_sha256)""",
    }
