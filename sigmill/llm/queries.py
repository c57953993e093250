"""Queries opN_<name>: each operator over its whole table, with the columns its contract names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, line_crf, merkle, ngram_model, packing, periodic_runs, pieces, posting_lists, quality_rules, simhash, suffix_dedup, warc, word_table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(_table(spark, sf_dir, "documents"), size=3, radius=3)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_model.score_corpus(_table(spark, sf_dir, "documents"), order=3)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_table(spark, sf_dir, "documents"))


def op2_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_lists.search(_table(spark, sf_dir, "embeddings"), F.col("query_id") % 50 == 0, k=5)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(_table(spark, sf_dir, "documents"))


def op11_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_table.digests(_table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_posting_lists": op2_posting_lists,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_kneser_ney": op4_kneser_ney,
    "op5_language_id": op5_language_id,
    "op6_simhash": op6_simhash,
    "op7_pieces": op7_pieces,
    "op8_packing": op8_packing,
    "op9_warc": op9_warc,
    "op10_line_crf": op10_line_crf,
    "op11_word_table": op11_word_table,
    "op12_merkle": op12_merkle,
    "op13_periodic_runs": op13_periodic_runs,
}

#: Five hexadecimal digits of the SHA-1 give four base32 ones.
_BASE32 = (
    "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + "
    "((cast('0x' || substr(sha1(payload), cast(1 + 5 * (i // 4) as integer), 5) as integer) >> cast(15 - 5 * (i % 4) as integer)) & 31) as integer), 1)), '')"
)

#: CRC-32 of the decimal doc_id: eight shifts a character.
_CRC = (
    "xor(4294967295, list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint)), "
    "lambda crc, ch: list_reduce([xor(crc, ch), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1))), 4294967295))"
)


def _leaf_sql(text: str) -> str:
    return "sha256(concat(" + ", ".join(f"case when {c} is null then '-' else concat(strlen(cast({c} as varchar)), ':', {c}) end" for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"


def _beside(table: str, key: str) -> str:
    """What stands before and behind each node of a tree's levels."""
    same = f"a.{key} is not distinct from b.{key} and " if key else ""
    return f"""select {f"a.{key}, " if key else ""}a.level, a.idx, coalesce(string_agg(b.h, '' order by b.idx) filter (b.idx < a.idx), '') as l, coalesce(string_agg(b.h, '' order by b.idx) filter (b.idx > a.idx), '') as r
 from {table} a join {table} b on {same}a.level = b.level and a.idx // 8 = b.idx // 8 where a.m > 1 group by all"""


#: The other results have a model, a search, a hash or a tokenizer in them that SQL lacks; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op9_warc": f"""with p as (select page_id, coalesce(html, '') as payload from pages), f as (select *, min(page_id) over (partition by payload) as first from p)
select page_id, cast(strlen(payload) as bigint) as payload_bytes, {_BASE32} as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
 case when page_id <> first then first end as refers_to from f""",
    "op12_merkle": f"""with recursive low as (select *, case when {_CRC} % 3 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as other from documents),
lv as (select doc_id, lang, {_leaf_sql("text")} as leaf, {_leaf_sql("other")} as tampered from low),
num as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from lv),
nodes as (select lang, 0 as level, i as idx, leaf as h, n as m from num union all select lang, level + 1, idx // 8, sha256(string_agg(h, '' order by idx)), any_value((m + 7) // 8) from nodes where m > 1 group by lang, level, idx // 8),
sub as (select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as t, count(*) over () as k from nodes where m = 1),
top as (select 0 as level, t as idx, subroot as h, k as m from sub union all select level + 1, idx // 8, sha256(string_agg(h, '' order by idx)), any_value((m + 7) // 8) from top where m > 1 group by level, idx // 8),
below as ({_beside("nodes", "lang")}), above as ({_beside("top", "")}),
steps as (select n.lang, n.i, p.level, p.l, p.r from num n join below p on n.lang is not distinct from p.lang and p.idx = n.i // cast(pow(8, p.level) as bigint)
 union all select n.lang, n.i, 1000 + p.level, p.l, p.r from num n join sub s on n.lang is not distinct from s.lang join above p on p.idx = s.t // cast(pow(8, p.level) as bigint)),
path as (select *, row_number() over (partition by lang, i order by level) as k from steps),
proof as (select lang, i, sha256(string_agg(concat(l, r), '' order by k)) as proof_sha256, count(*) as height from path group by all),
fold as (select lang, i, 0 as k, tampered as h from num union all select f.lang, f.i, p.k, sha256(concat(p.l, f.h, p.r)) from fold f join path p on f.lang is not distinct from p.lang and f.i = p.i and p.k = f.k + 1)
select n.doc_id, n.leaf, s.subroot, (select h from top where m = 1) as root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, f.h as folded_root, f.h = (select h from top where m = 1) as verified
 from num n join sub s on n.lang is not distinct from s.lang left join proof p on n.lang is not distinct from p.lang and n.i = p.i join fold f on n.lang is not distinct from f.lang and n.i = f.i and f.k = coalesce(p.height, 0)""",
}
