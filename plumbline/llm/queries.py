"""The registered queries of this subpackage, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import bpe_encode
from .conversation_trie import SQL as TRIE_SQL
from .conversation_trie import conversation_trie
from .decontamination import SQL as DECONTAMINATION_SQL
from .decontamination import decontaminate
from .exact_dedup import exact_dedup
from .fingerprints import edited_fingerprints
from .langid import predict_language, train_langid
from .license_scan import SQL as LICENSE_SQL
from .license_scan import license_scan
from .lm_score import WORDS, lm_score
from .manifest import SQL as MANIFEST_SQL
from .manifest import manifest
from .ngram_join import ngram_components
from .packing import best_fit_packing
from .toxicity import score_toxicity, train_toxicity
from .warc import read_warc, write_warc
from ..session import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return keep


@query(
    "op1_exact_dedup",
    """
    select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
           doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
    from documents window same as (partition by coalesce(text, ''))
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


@query("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return score_toxicity(documents, train_toxicity(documents, _table(spark, sf_dir, "labels")))


@query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op9_language")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return predict_language(documents, train_langid(documents))


@query(
    "op10_warc",
    """
    with p as (select page_id, coalesce(html, '') as payload, octet_length(encode(coalesce(html, ''))) as n from pages),
    g as (select page_id, n, sha1(payload) as d, max(page_id) over (partition by payload) as last from p)
    select page_id, n as payload_bytes, d as payload_digest,
           case when n >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type,
           case when n >= 1000 and page_id <> last then last end as refers_to
    from g
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "warc")
    write_warc(_table(spark, sf_dir, "pages"), path)
    records = read_warc(spark, path)
    return records.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


@query("op2_license_scan", LICENSE_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


@query("op5_lm_score")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(_table(spark, sf_dir, "documents"), words=WORDS)


@query("op7_fingerprints")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(_table(spark, sf_dir, "documents"))


@query(
    "op8_ngram_join",
    r"""
    with recursive w as (
      select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
    s as (select r, unnest(case when len(ws) >= 3 then list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' ')))
                                when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as x from w),
    n as (select r, count(*) as n from s group by r),
    common as (select a.r as a, b.r as b, count(*) as c from s a join s b on a.x = b.x and a.r <> b.r group by a.r, b.r),
    link as (select a, b from common join n na on na.r = a join n nb on nb.r = b where 100 * c >= 90 * (na.n + nb.n - c)),
    reach(a, b) as (select r, r from w union select reach.a, link.b from reach join link on reach.b = link.a)
    select w.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(other.doc_id) as component_id
    from w left join n using (r) join reach on reach.a = w.r join w other on other.r = reach.b group by w.r, w.doc_id
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents"))


@query("op11_decontamination", DECONTAMINATION_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query("op12_manifest", MANIFEST_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(_table(spark, sf_dir, "documents"))


@query("op13_conversation_trie", TRIE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_table(spark, sf_dir, "conversations"))
