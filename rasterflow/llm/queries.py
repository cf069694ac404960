"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rasterflow.llm import (
    chat_format,
    compact_windows,
    decontaminate,
    jaccard_join,
    prefix_free,
    preference_ranking,
    quality_rules,
    secrets,
    sentencepiece_codec,
    token_output,
)
from rasterflow.llm.common import read

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PATTERN = public_tokenizers.PATTERN


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as ids in shards, read back; null texts have the end id only, repeated rows each their frame."""
    return token_output.token_output(read(spark, sf_dir, "documents"), WORD_BPE)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of benchmark windows in every row of documents; null texts have no words, an empty benchmark hits nothing."""
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by four-word shingles at 85 %; texts without words stand alone."""
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents"), width=4, percent=85)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from the labels of four folds; null and empty texts are scored as no features."""
    return preference_ranking.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document; null texts are empty and have none."""
    return secrets.secret_report(read(spark, sf_dir, "documents"), BYTE_BPE, PATTERN)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations formatted, written and read back; null texts are empty, repeated rows are turns of their own."""
    probe = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.chat_report(rows, BYTE_BPE, PATTERN)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document; null texts have no words and fail."""
    return quality_rules.quality_report(read(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a near-duplicate passage, with ranges and component; null and short texts have none."""
    return compact_windows.near_passages(read(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated 400-byte strings leave of every document; null texts are empty, repeated rows remove each other."""
    return prefix_free.removal_report(read(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and checksum of every document's pieces; null texts have none."""
    return sentencepiece_codec.encode_documents(read(spark, sf_dir, "documents"), PIECES)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_output, op2_decontamination, op3_ngram_jaccard, op4_quality_classifier, op5_secret_scan, op6_chat_formatting,
        op7_quality_rules, op8_substring_dedup, op9_suffix_dedup, op10_sentencepiece,
    )
}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op2_decontamination": f"""
with t as (select row_number() over () as r, doc_id, {_WORDS} as w from (select doc_id, coalesce(text, '') as text from documents)),
b as (select item_id, {_WORDS} as w from benchmark where text is not null),
bw as (select item_id, case when len(w) < 13 then len(w) else 13 end as n, w from b where len(w) > 0),
win as (select distinct item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as x
        from (select *, unnest(range(1, len(w) - n + 2)) as i from bw)),
sizes as (select distinct n from win),
dw as (select r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as x
       from (select r, n, w, unnest(range(1, len(w) - n + 2)) as i from t, sizes where len(w) >= n)),
hit as (select r, dw.n, i, item_id from dw join win on dw.n = win.n and dw.x = win.x),
pos as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from hit) group by r),
it as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
       from (select distinct r, cast(item_id as varchar) as item_id from hit) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from t left join pos using (r) left join it using (r)""",
    "op3_ngram_jaccard": r"""
with recursive t as (select doc_id, string_split_regex(trim(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz     ')), ' +') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) end) as x
      from t where w <> ['']),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as both_ from s a join s b using (x) where a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * both_ >= 85 * (x.n + y.n - both_)),
reach as (select a as doc_id, b as other from l union select reach.doc_id, l.b from reach join l on l.a = reach.other)
select d.doc_id, cast(coalesce(any_value(n.n), 0) as bigint) as n_shingles, least(d.doc_id, coalesce(min(other), d.doc_id)) as component_id
from documents d left join n using (doc_id) left join reach using (doc_id) group by d.doc_id""",
    "op6_chat_formatting": chat_format.REPORT_SQL,
    "op7_quality_rules": quality_rules.report_sql(),
}
