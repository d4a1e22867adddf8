"""One query for each operator, over its whole table, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowlens.llm import alignment, ann, embed_dedup, jaccard, mixing, pieces, pii, suffix_dedup, token_files, topk, toxicity, turns, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), mixing.domains_of(table(spark, sf_dir, "labels")), {"good": 0.7, "poor": 0.2, "toxic": 0.1}).drop("mark")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.token_rows(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.stored(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.damaged_and_repaired(table(spark, sf_dir, "conversations"))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 20 = 0"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_warc, op3_toxicity, op4_pii, op5_mixing, op6_sentencepiece, op7_ngram_jaccard, op8_token_files, op9_embedding_dedup, op10_nearest, op11_alignment, op12_turn_repair, op13_exact_topk)
}


def _edited(state: str, cost: str, letter: str, said: str = "") -> str:
    """SQL for a state (cost, audit, repaired text) after one edit; a state that can't be reached stays null."""
    text = f"{state}.t || case when {state}.t = '' then '' else chr(10) end || {said}" if said else f"{state}.t"
    return f"case when {state} is not null then {{'c': {state}.c + {cost}, 'a': {state}.a || {letter}, 't': {text}}} end"


def _least(*states: str) -> str:
    return f"list_min([x for x in [{', '.join(states)}] if x is not null])"


def _kept(state: str, initial: str, role: str) -> str:
    """SQL for a state after the row at hand has been kept, or given the role that is due."""
    to = _edited(state, f"case when i0 = '{initial}' then 0 else 3 end + extra", f"case when i0 = '{initial}' then 'K' else 'R' end", f"case when i0 = '{initial}' then role else '{role}' end || ':' || text")
    return f"case when stays then {to} end"


_GONE = {x: _edited(x, "4", "'D'") for x in ("n", "s", "u1", "a1")}
_USER, _ASSISTANT = (lambda x: _edited(x, "3", "'I'", "'user:'")), (lambda x: _edited(x, "3", "'I'", "'assistant:'"))

#: the grammar as an automaton whose states (nothing, system, user, assistant last) fold over the rows; the operator aligns to strings instead
TURN_REPAIR = rf"""
    with recursive
         b as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ord(c)::bigint) as bytes from conversations),
         k as (select *, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: case when x % 2 = 1 then xor(x // 2, 3988292384::bigint) else x // 2 end)), 4294967295::bigint) % 20 as act from b),
         d as (select conv_id, turn, case when act = 4 then 'user' else role end as role, case act when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when act = 3 then [1, 2] else [1] end) as copy from k where act <> 0),
         o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen,
                      regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) as ending from d),
         r as (select *, left(role, 1) as i0, case when ending = '' then 'blank' when seen > 1 then 'duplicate' when ending not in ('.', '!', '?') then 'truncated' else '' end as fault,
                      lag(left(role, 1)) over (partition by conv_id order by i) as i1 from o),
         f(conv_id, i, n, s, u, a) as (
             select distinct conv_id, 0::bigint, {{'c': 0::bigint, 'a': '', 't': ''}}, null::struct(c bigint, a varchar, t varchar), null::struct(c bigint, a varchar, t varchar), null::struct(c bigint, a varchar, t varchar) from r
             union all
             select conv_id, i + 1, {_GONE["n"]}, {_least(_GONE["s"], "case when stays and i0 = 's' then " + _edited("n", "extra", "'K'", "role || ':' || text") + " end")},
                    {_least(_GONE["u1"], *[_kept(x, "u", "user") for x in ("n", "s", "a1")])}, {_least(_GONE["a1"], _kept("u1", "a", "assistant"))}
             from (select f.*, role, text, i0, fault in ('', 'truncated') as stays, case when fault = 'truncated' then 3 else 0 end as extra,
                          {_least("u", *[_USER("f." + x) for x in ("n", "s", "a")])} as u1, {_least("a", _ASSISTANT("u"))} as a1
                   from f join r on r.conv_id is not distinct from f.conv_id and r.i = f.i + 1)),
         e as (select conv_id, {_least("n", "a", _ASSISTANT("u"), _ASSISTANT("su"))} as best from (select *, {_USER("s")} as su, row_number() over (partition by conv_id order by i desc) as back from f) where back = 1),
         g as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
                      count(*) filter (i1 is not null and i1 || i0 not in ('su', 'ua', 'au')) as illegal from r group by conv_id),
         c as (select distinct conv_id from conversations)
    select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
           coalesce(best.c, 0)::bigint as cost, coalesce(best.a, '') as audit, sha256(coalesce(best.t, '')) as repaired_sha256
    from c left join g on g.conv_id is not distinct from c.conv_id left join e on e.conv_id is not distinct from c.conv_id
"""

ORACLES: dict[str, str] = {
    "op12_turn_repair": TURN_REPAIR,
    "op2_warc": """
        with p as (select page_id, coalesce(html, '') as html from pages where page_id is not null),
             d as (select page_id, octet_length(encode(html)) as n, sha256(html) as h from p),
             f as (select h, min(page_id) as first from d where n >= 100 group by h)
        select page_id, n::bigint as payload_bytes, h as payload_digest,
               case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
               case when first <> page_id then first end as refers_to
        from d left join f using (h)
    """,
    "op7_ngram_jaccard": r"""
        with recursive
             w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
                   from documents where doc_id is not null),
             s as (select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
                                                       else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end)) as g from w),
             n as (select doc_id, count(*) as n from s group by doc_id),
             both_ as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
             link as (select a, b from both_ join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 75 * (na.n + nb.n - c)),
             reach(a, b) as (select a, b from link union select reach.a, link.b from reach join link on reach.b = link.a)
        select w.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, least(w.doc_id, coalesce(min(reach.b), w.doc_id)) as component_id
        from w left join n using (doc_id) left join reach on reach.a = w.doc_id group by w.doc_id
    """,
    "op13_exact_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as q from embeddings
                   where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
             s as (select x.vec_id as query_id, y.vec_id, list_inner_product(x.q, y.q)::bigint as score from v x join v y on x.vec_id <> y.vec_id and len(x.q) = len(y.q) where x.vec_id % 20 = 0)
        select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s
        qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20
    """,
}
