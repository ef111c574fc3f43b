"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat
from .byte_bpe import byte_bpe
from .divergence import divergence
from .jaccard import jaccard_classes
from .langid import Training, held_out, identify, train, training_rows
from .packing import pack_documents
from .ppm import lm_scores
from .quality import quality
from .substring_dedup import remove_repeats
from .token_counts import count_tokens
from .trie import trie
from .warc import warc_round_trip
from .winnow import winnow

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), WORD_BPE).drop("ids")


def op2_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), WORD_BPE)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(_table(spark, sf_dir, "documents"), BYTE_BPE, keep_ids=False)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_table(spark, sf_dir, "pages")).drop("capture_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    network = train(training_rows(docs, Training()))
    found = identify(docs.select("doc_id", "text"), network).select("row.doc_id", "lang_pred", "score")
    return found.withColumn("held_out", held_out(F.col("doc_id")))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(_table(spark, sf_dir, "documents"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.formatted(rows))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_winnow, op3_token_counts, op4_byte_bpe, op5_substring_dedup, op6_ppm, op7_warc, op8_quality, op9_jaccard_join, op10_language_id, op11_divergence, op12_chat, op13_prefix_trie)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op5_substring_dedup": f"""
        with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
        win as (select r, doc_id, i, array_to_string(w[i:i + 12], ' ') as g from (select r, doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13)),
        bad as (select r, i from (select *, min(doc_id) over (partition by g) as first_id from win) where first_id < doc_id),
        cover as (select distinct r, i + o as i from bad, range(13) t(o)),
        ws as (select r, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from d),
        kept as (select ws.r, string_agg(word, ' ' order by ws.i) as text, count(*) as n from ws anti join cover on ws.r = cover.r and ws.i = cover.i group by ws.r)
        select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(text, '')) as kept_sha256
        from d left join kept using (r)""",
    "op7_warc": """
        with p as (select page_id, coalesce(html, '') as payload from pages),
        d as (select page_id, strlen(payload)::bigint as n, sha256(payload) as digest from p),
        f as (select *, min(page_id) over (partition by digest) as first_id from d)
        select page_id, n as payload_bytes, digest as payload_digest,
               case when n >= 100 and page_id > first_id then 'revisit' else 'response' end as record_type,
               case when n >= 100 and page_id > first_id then first_id end as refers_to
        from f""",
    "op8_quality": f"""
        with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text, {_WORDS} as w from documents),
        win as (select r, i, array_to_string(w[i:i + 7], ' ') as g from (select r, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)),
        dup as (select r, i from (select *, count(*) over (partition by r, g) as c from win) where c > 1),
        rep as (select r, sum(least(8, coalesce(nxt - i, 8)))::bigint as n from (select r, i, lead(i) over (partition by r order by i) as nxt from dup) group by r),
        ln as (select r, count(*) as n_lines, count(*) - count(distinct x) as n_dup from (select r, unnest(string_split(text, chr(10))) as x from d)
               where regexp_matches(x, '[^\x20\x09-\x0D]') group by r),
        m as (select d.r, doc_id, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
                     (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(n_lines, 0) as n_lines,
                     coalesce(n_dup, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words
              from d left join rep using (r) left join ln using (r)),
        b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m),
        f as (select *, base_failed or 100 * n_symbols > 50 * n_words or 100 * n_dup_lines > 50 * n_lines as failed from b),
        h as (select source, count(*)::double as n, sum(failed::int)::double as f from f group by source),
        a as (select avg(f / n) as m, var_pop(f / n) as v from h),
        k as (select m, case when v > 1e-12 then least(10000, greatest(1, m * (1 - m) / v - 1)) else 10000 end as weight from a),
        s as (select source, (f + m * weight) / (n + weight) as rate from h, k)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and rate <= 0.5 as kept
        from f join s on f.source is not distinct from s.source""",
    "op9_jaccard_join": f"""
        with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
        s as (select distinct doc_id, g from (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
              else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from d)),
        n as (select doc_id, count(*) as n from s group by doc_id),
        p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
        links as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 75 * (x.n + y.n - i)),
        reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
        least_of as (select a, min(b) as b from reach group by a)
        select d.doc_id, coalesce(n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) as component_id
        from d left join n using (doc_id) left join least_of on a = d.doc_id""",
    "op11_divergence": r"""
        with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
        t as (select lang, source, r, unnest(w) as term from d),
        kept as (select lang, term, count(*) as total from t group by 1, 2 having count(distinct r) >= 10),
        v as (select lang, count(*) as v, sum(total) as n from kept group by 1),
        g as (select distinct lang, source from d),
        c as (select lang, source, term, count(*) as n from t semi join kept using (lang, term) group by 1, 2, 3),
        gn as (select g.*, coalesce(sum(c.n), 0) as n from g left join c using (lang, source) group by 1, 2),
        cells as (select gn.lang, gn.source, kept.term, coalesce(c.n, 0) as n, kept.total,
                         (1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (gn.n + 2 * v.v))::bigint as p,
                         (1 + (1000000000::hugeint * (kept.total + 2)) // (v.n + 2 * v.v))::bigint as q
                  from gn join kept using (lang) join v using (lang) left join c on c.lang = gn.lang and c.source = gn.source and c.term = kept.term),
        far as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
                from cells a join cells b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
        pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(far.value, 0)::bigint as value
                  from g a join g b on a.lang = b.lang and a.source <> b.source left join far on far.lang = a.lang and far.source = a.source and far.item = b.source),
        terms as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value from cells where n > 0 and p > q),
        ranked as (select *, (row_number() over (partition by lang, source, part order by value desc, encode(item)))::int as rank from (from pairs union all from terms))
        select * from ranked where part = 'pair' or rank <= 10""",
    "op12_chat": r"""
        with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
                   union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
        m as (select *, length(text) + len(regexp_extract_all(text, '<</?SYS>>|</?s>|\[/?(?:INST|ROLE|TEXT)\]')) as size,
                     length(role) + len(regexp_extract_all(role, '<</?SYS>>|</?s>|\[/?(?:INST|ROLE|TEXT)\]')) as role_size,
                     row_number() over (partition by conv_id order by turn nulls first, role, text) as pos from c)
        select conv_id, count(*)::bigint as n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by pos)) as turns_sha256,
               coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
               sha256(coalesce(string_agg(text, '' order by pos) filter (role = 'assistant'), '')) as loss_sha256,
               sum(size + case role when 'system' then 17 when 'user' then 15 when 'assistant' then 9 else role_size + 30 end)::bigint as formatted_chars
        from m group by conv_id""",
    "op13_prefix_trie": r"""
        with own as (select *, row_number() over (partition by conv_id order by turn nulls first) as pos
                     from (select conv_id, turn, coalesce(role, '') || chr(10) || coalesce(text, '') as t, strlen(coalesce(text, '')) as bytes from conversations where conv_id is not null)),
        bits as (select conv_id, flatten(list_transform(string_split(conv_id::varchar, ''), lambda x: [ascii(x), 0, 0, 0, 0, 0, 0, 0])) as b from (select distinct conv_id from own)),
        heads as (select conv_id, conv_id - conv_id % 5 as head,
                         xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)))) % 9 as h from bits),
        rows_of as (select heads.conv_id, 0 as part, pos, t, bytes from heads join own on own.conv_id = head and pos <= h
                    union all select conv_id, 1, pos, t, bytes from heads join own using (conv_id) where pos > h),
        seq as (select conv_id, list(sha256(t) order by part, pos) as s, list(bytes order by part, pos) as b from rows_of group by 1),
        convs as (select conv_id, coalesce(s, []) as s, coalesce(b, []) as b from heads left join seq using (conv_id)),
        pre as (select conv_id, d, array_to_string(s[1:d], '') as k, coalesce(b[d], 0) as bytes, len(s) = d as ended from (select *, unnest(range(0, len(s) + 1)) as d from convs)),
        nodes as (select k, d, min(conv_id) as conv_id, count(*) as n, any_value(bytes) as bytes, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ended), '')) as ends from pre group by 1, 2),
        kids as (select left(k, (d - 1) * 64) as k, d - 1 as d, count(*) as n from nodes where d > 0 group by 1, 2),
        under as (select distinct a.k, a.d, b.k as bk, b.d as bd from pre a join pre b on a.conv_id = b.conv_id and b.d >= a.d),
        sums as (select u.k, u.d, sum((n.n - 1) * n.bytes) as saved, count(*) filter (c.n is null) as leaves
                 from under u join nodes n on n.k = bk and n.d = bd left join kids c on c.k = bk and c.d = bd group by 1, 2)
        select n.conv_id, n.d::bigint as depth, p.conv_id as parent_conv_id, n.n as n_convs, coalesce(c.n, 0) as n_children, leaves as n_leaves, saved::bigint as saved_tokens, n.ends as ends_sha256
        from nodes n join sums s on s.k = n.k and s.d = n.d left join kids c on c.k = n.k and c.d = n.d left join nodes p on p.d = n.d - 1 and p.k = left(n.k, p.d * 64)""",
}
