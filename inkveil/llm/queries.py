"""The registered queries of this package, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm import (
    backoff_lm, chunked_bpe, conversations, jaccard_join, language_mixture, licenses, maxscore, packing, sequences, signature_join,
    toxicity, whitening, winnowing,
)
from inkveil.llm.common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(maxscore.quantised(table(spark, sf_dir, "embeddings")), F.col("id") % 20 == 0, 20)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=85)


def op4_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.score(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_mixture.language_folds(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", packing.word_count().alias("n_tokens"))
    return packing.best_fit(docs)


def op8_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.sequences(table(spark, sf_dir, "documents"), TOKENIZER)


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprints(table(spark, sf_dir, "documents"))


def op10_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked_bpe.digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op11_hirschberg_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversations.reports(turns, conversations.damaged(turns))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_join.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_maxscore_top_k, op2_toxicity, op3_ngram_jaccard_join, op4_backoff_lm, op5_license_scan, op6_language_mixture,
        op7_best_fit_packing, op8_arrow_sequences, op9_winnowing, op10_chunked_bpe, op11_hirschberg_repair, op12_whitening, op13_signature_join,
    )
}

# crc32 of the column k bit by bit, before its last inversion; k is ASCII
_CRC_BYTE = "case when i % 8 = 0 then xor(c, ascii(substr(k, cast(i // 8 + 1 as bigint), 1))) else c end"
_CRC_SQL = (
    "list_reduce(list_prepend(4294967295, range(8 * length(k))), "
    f"lambda c, i: case when ({_CRC_BYTE}) & 1 = 1 then xor(({_CRC_BYTE}) >> 1, 3988292384) else ({_CRC_BYTE}) >> 1 end)"
)

SQL = {
    "op1_maxscore_top_k": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
            from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id
        ), r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 20
    """,
    "op3_ngram_jaccard_join": r"""
        with recursive w as (
            select doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'
            ) as w from documents
        ), s as materialized (
            select doc_id, case when len(w) = 0 then [] else list_distinct(list_transform(
                range(1, greatest(len(w) - 2, 2)), lambda i: array_to_string(w[i:i + 3], ' '))) end as s
            from w
        ), one as materialized (select doc_id, len(s) as n, unnest(s) as g from s),
        near as (
            select a.doc_id as a, b.doc_id as b from one a join one b on a.g = b.g and a.doc_id < b.doc_id
            group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), edge as materialized (select a, b from near union all select b, a from near),
        reach(doc_id, other) as (
            select a, b from edge union select r.doc_id, e.b from reach r join edge e on r.other = e.a
        ), least as (select doc_id, min(other) as other from reach group by doc_id)
        select s.doc_id, cast(len(s.s) as bigint) as n_shingles, least(s.doc_id, coalesce(l.other, s.doc_id)) as component_id
        from s left join least l on s.doc_id = l.doc_id
    """,
    "op11_hirschberg_repair": rf"""
        with recursive damage as (
            select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                xor({_CRC_SQL}, 4294967295) % 20 as fault
            from (select *, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations)
        ), rows as (
            select conv_id, turn, case when fault = 4 then 'user' else role end as role,
                case fault when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
                unnest(case when fault = 3 then [1, 2] else [1] end) as copy
            from damage where fault <> 0
        ), placed as (
            select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i from rows
        ), judged as (
            select *, left(role, 1) as initial, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank,
                row_number() over (partition by conv_id, role, text order by i) > 1 as again,
                regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) not in ('.', '!', '?') as open,
                lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) as pair
            from placed
        ), turns as (
            select *, blank or again as goes, case when not blank and not again and open then 3 else 0 end as cut from judged
        ), inserted(s, n, state, letters, lines) as (values
            (0, 0, 0, '', []), (0, 1, 2, 'I', ['user:']), (0, 2, 3, 'II', ['user:', 'assistant:']),
            (1, 0, 1, '', []), (1, 1, 2, 'I', ['user:']), (1, 2, 3, 'II', ['user:', 'assistant:']),
            (2, 0, 2, '', []), (2, 1, 3, 'I', ['assistant:']), (2, 2, 2, 'II', ['assistant:', 'user:']),
            (3, 0, 3, '', []), (3, 1, 2, 'I', ['user:']), (3, 2, 3, 'II', ['user:', 'assistant:'])
        ), acts(state, letter, needs, t, name) as (values
            (0, 'D', null, 0, null), (1, 'D', null, 1, null), (2, 'D', null, 2, null), (3, 'D', null, 3, null),
            (0, 'R', null, 2, 'user'), (1, 'R', null, 2, 'user'), (2, 'R', null, 3, 'assistant'), (3, 'R', null, 2, 'user'),
            (0, 'K', 's', 1, null), (0, 'K', 'u', 2, null), (1, 'K', 'u', 2, null), (3, 'K', 'u', 2, null), (2, 'K', 'a', 3, null)
        ), steps(conv_id, i, s, best, lines) as (
            select conv_id, cast(0 as bigint), 0, row(cast(0 as bigint), ''), cast([] as varchar[]) from (select distinct conv_id from turns)
            union all
            select conv_id, i, t, min(way), arg_min(lines, way) from (
                select p.conv_id, r.i, a.t,
                    row(cast(p.best[1] + 3 * x.n + case a.letter when 'D' then 4 when 'R' then 3 + r.cut else r.cut end as bigint),
                        p.best[2] || x.letters || a.letter) as way,
                    p.lines || cast(x.lines as varchar[])
                        || case when a.letter = 'D' then cast([] as varchar[]) else [coalesce(a.name, r.role) || ':' || r.text] end as lines
                from steps as p join turns as r on r.conv_id is not distinct from p.conv_id and r.i = p.i + 1
                join inserted as x on x.s = p.s join acts as a on a.state = x.state
                where (a.letter = 'D' or not r.goes) and (a.needs is null or a.needs = r.initial)
            ) group by conv_id, i, t
        ), ended as (
            select p.conv_id, row(p.best[1] + 3 * x.n, p.best[2] || x.letters) as way, p.lines || cast(x.lines as varchar[]) as lines
            from steps as p join (select conv_id, max(i) as i from turns group by conv_id) as l on l.conv_id is not distinct from p.conv_id and l.i = p.i
            join inserted as x on x.s = p.s where x.state in (0, 3)
        ), repaired as (select conv_id, min(way) as way, arg_min(lines, way) as lines from ended group by conv_id),
        counted as (
            select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
                count(*) filter (not blank and again) as duplicate, count(*) filter (cut > 0) as truncated,
                count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) as illegal
            from turns group by conv_id
        )
        select c.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
            coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(r.way[1], 0) as cost, coalesce(r.way[2], '') as audit,
            sha256(coalesce(array_to_string(r.lines, chr(10)), '')) as repaired_sha256
        from (select distinct conv_id from conversations) as c left join counted as n on n.conv_id is not distinct from c.conv_id
        left join repaired as r on r.conv_id is not distinct from c.conv_id
    """,
    "op13_signature_join": r"""
        with recursive w as (
            select doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'
            ) as w from documents
        ), s as materialized (
            select doc_id, case when len(w) = 0 then [] else list_distinct(list_transform(
                range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' '))) end as s
            from w
        ), one as materialized (select doc_id, len(s) as n, unnest(s) as g from s),
        near as (
            select a.doc_id as a, b.doc_id as b from one a join one b on a.g = b.g and a.doc_id < b.doc_id
            group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), edge as materialized (select a, b from near union all select b, a from near),
        reach(doc_id, other) as (
            select a, b from edge union select r.doc_id, e.b from reach r join edge e on r.other = e.a
        ), least as (select doc_id, min(other) as other from reach group by doc_id)
        select s.doc_id, cast(len(s.s) as bigint) as n_shingles, least(s.doc_id, coalesce(l.other, s.doc_id)) as component_id,
            s.doc_id <= coalesce(l.other, s.doc_id) as kept
        from s left join least l on s.doc_id = l.doc_id
    """,
}
