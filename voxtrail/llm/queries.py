"""Named queries of the text operators, each over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voxtrail.llm import bpe, chat, fim, fingerprint, gru, langid, packing, pii, simhash, topk, toxicity, urls
from voxtrail.llm.common import table


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise_documents(table(spark, sf_dir, "documents"), pii.session_key(spark, pii.KEY))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.neighbours(table(spark, sf_dir, "embeddings"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru.score_documents(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(table(spark, sf_dir, "documents"))


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group_documents(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fill_in_middle_documents(table(spark, sf_dir, "documents"))


def op12_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii_pseudonyms,
        op2_packing,
        op3_toxicity,
        op4_document_fingerprints,
        op5_exact_top_k,
        op6_url_filter,
        op7_gru_scores,
        op8_language_id,
        op9_simhash_groups,
        op10_byte_bpe,
        op11_fill_in_middle,
        op12_chat_windows,
    )
}
ORACLE: dict[str, str] = {
    "op5_exact_top_k": """
        with q as (
            select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
            from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), parts as (
            select vec_id, unnest(v) as x, generate_subscripts(v, 1) as d from q
        ), scores as (
            select a.vec_id as query_id, b.vec_id as vec_id, sum(a.x * b.x)::bigint as score
            from parts a join parts b on a.d = b.d
            where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
            group by a.vec_id, b.vec_id
        ), ranked as (
            select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scores
        )
        select query_id, rank, vec_id, score from ranked where rank <= 5
    """,
    "op11_fill_in_middle": r"""
        with d as (
            select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as digest from documents
        ), u as (
            select doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units,
                list_transform(range(4), lambda i: ('0x' || substr(digest, 8 * i + 1, 8))::bigint) as h from d
        ), c as (
            select *, len(units) as n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) as a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) as b,
                case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= 50 then 'plain'
                    when h[4] % 100 < 80 then 'spm' else 'psm' end as form from u
        ), parts as (
            select doc_id, text, n, form, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:], '') as suffix from c
        )
        select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
            sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(text) as restored_sha256
        from parts
    """,
}
