"""The registered queries opN_<name>: thin digests of the operators, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, codes, decontaminate, jaccard, langid, lm, neighbours, pieces, quality, repeats, sharding, tokenstore, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = tokenstore.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return tokenstore.read_tokens(spark, store, lambda ids: zlib.crc32(ids.tobytes()), "ids_crc32 long")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digests=True)


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), _remainder(4) == 2)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), 40, seed=17)
    data = F.coalesce("text", F.lit("")).cast("binary")
    return dealt.select("doc_id", (F.octet_length(data) + 16).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_pages(table(spark, sf_dir, "pages"))
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) as long)")  # noqa: E731  behind urn:page:
    # responses are read whole, of revisits the headers alone
    read = warc.read_warc(spark, folder, payload=False, digest=True).where("record_type = 'response'").select("record_id", F.col("payload_length").alias("payload_bytes"), F.col("payload_sha1").alias("payload_digest"), "record_type", "refers_to")
    again = warc.read_warc(spark, folder, payload=False).where("record_type = 'revisit'").select("record_id", F.col("http_length").alias("payload_bytes"), F.substring("payload_digest", 6, 32).alias("payload_digest"), "record_type", "refers_to")
    return read.unionByName(again).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components_of(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"), _remainder(7) == 2)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), 35, digests=True)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), with_text=False)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digests=True)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"))
    sha = hashlib.sha256(books.text().encode()).hexdigest() if books else None
    return codes.with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(sha).cast("string").alias("codebooks_sha256"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

_BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((list_sum(
    list_transform(range(5), lambda j: cast((strpos('0123456789abcdef', substr(hex, cast(5 * (i // 4) + j + 1 as int), 1)) - 1) as bigint) << cast(16 - 4 * j as int)))
    >> cast(15 - 5 * (i % 4) as int)) & 31 as int), 1)), '')"""

SQL: dict[str, str] = {
    "op5_warc": f"""
        with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as hex from pages),
        m as (select *, max(page_id) over (partition by hex, n) as first from p)
        select page_id, cast(n as bigint) as payload_bytes, {_BASE32} as payload_digest,
               case when page_id is null or page_id <> first then 'revisit' else 'response' end as record_type,
               case when page_id is null or page_id <> first then first end as refers_to
        from m""",
    "op6_jaccard_join": f"""
        with recursive w as materialized (select doc_id, {_WORDS.replace("text", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
        g as materialized (select distinct doc_id, md5(array_to_string(w[i : i + 4], ' ')) as h from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from w where len(w) > 0)),
        c as materialized (select doc_id, count(*) as n from g group by doc_id),
        links as materialized (
            select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as common from g x join g y using (h) where x.doc_id <> y.doc_id group by all) p
            join c ca on ca.doc_id = a join c cb on cb.doc_id = b where 100 * common >= 75 * (ca.n + cb.n - common)),
        reach as (select doc_id as node, doc_id as label from documents union select b, label from reach join links on a = node)
        select doc_id, coalesce(n, 0) as n_shingles, label as component_id
        from (select node as doc_id, min(label) as label from reach group by node) left join c using (doc_id)""",
    "op9_substring_dedup": f"""
        with w as materialized (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
        p as (select r, unnest(range(1, len(w) - 33)) as i, w from w where len(w) >= 35),
        h as (select r, i, md5(array_to_string(w[i : i + 34], ' ')) as h from p),
        again as (select r, i from (select r, i, count(*) over (partition by h) as n from h) where n > 1),
        gone as (select r, list_sort(list_distinct(flatten(list(range(i, i + 35))))) as g from again group by r),
        kept as (select doc_id, len(w) as n, coalesce(len(g), 0) as gone,
                        case when g is null then w else list_filter(w, lambda x, k: not list_contains(g, k)) end as k from w left join gone using (r))
        select doc_id, cast(n as bigint) as n_words, cast(gone as bigint) as n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept""",
}
