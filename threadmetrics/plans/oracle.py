"""Oracle SQL (DuckDB) for every registered query.

Each entry restates the query independently in plain SQL over the driver's
tables: thread tables come from the shared derivation text, trees are
walked with ``WITH RECURSIVE`` instead of pointer jumping. Doubles are
rounded to 6 places on both sides.
"""

from __future__ import annotations

from ..functions import calendar as cal
from ..functions import text as tx
from ..functions.fixed import NEGATIONS, SENTIMENT_LEXICON
from ..sources.threads import DUCKDB, THREAD_SQL

ORACLE: dict[str, str] = {}


def register(name: str):
    def deco(fn):
        ORACLE[name] = fn()
        return fn
    return deco


def ctes(*names: str, extra: str = "", recursive: bool = False) -> str:
    parts = [f"{n} as ({THREAD_SQL[n][0](DUCKDB)})" for n in names]
    if extra:
        parts.append(extra)
    return ("with recursive " if recursive else "with ") + ",\n".join(parts)


def tree_cte(src: str, name: str = "tree") -> str:
    """Root and level of every comment of ``src`` by recursion."""
    return f"""{name}(post_id, comment_id, tlc_id, level) as (
  select post_id, comment_id, comment_id, 0 from {src} where parent_id is null
  union all
  select c.post_id, c.comment_id, t.tlc_id, t.level + 1
  from {src} c join {name} t on c.post_id = t.post_id and c.parent_id = t.comment_id)"""


def anc_cte(src: str, name: str = "anc") -> str:
    """(node, ancestor-or-self, distance) pairs by recursion (oracle only)."""
    return f"""{name}(post_id, node, a, d) as (
  select post_id, comment_id, comment_id, 0 from {src}
  union all
  select x.post_id, x.node, c.parent_id, x.d + 1
  from {name} x join {src} c on c.post_id = x.post_id and c.comment_id = x.a
  where c.parent_id is not null)"""


# --------------------------------------------------------------- trees
@register("a1_reply_rollup")
def _a1():
    return ctes("order_comments", extra=tree_cte("order_comments"), recursive=True) + """
select tl.comment_id Top_comment_id,
  cast(count(r.comment_id) as bigint) Replies_total_number,
  cast(coalesce(max(r.level), 0) as bigint) Replies_max_depth,
  cast(coalesce(sum(r.links), 0) as bigint) Replies_links_count,
  cast(coalesce(sum(coalesce(r.score, 0)), 0) as bigint) Replies_sum_score,
  cast(count(case when r.level = 1 then 1 end) as bigint) Top_comment_direct_children
from order_comments tl left join (
  select t.tlc_id, t.level, c.comment_id, c.score, """ + tx.sql_link_count("c.body") + """ links
  from tree t join order_comments c using (post_id, comment_id) where t.level > 0) r
  on r.tlc_id = tl.comment_id
where tl.parent_id is null
group by tl.comment_id"""


@register("a2_reply_count")
def _a2():
    return ctes("conv_comments", extra=tree_cte("conv_comments"), recursive=True) + """
select tl.comment_id Top_comment_id, cast(count(t.comment_id) as bigint) n_replies
from conv_comments tl left join tree t on t.tlc_id = tl.comment_id and t.level > 0
where tl.parent_id is null group by tl.comment_id"""


def _heights(src: str) -> str:
    return ctes(src, extra=anc_cte(src), recursive=True) + """
select a comment_id, cast(max(d) + 1 as int) height, cast(count(*) as bigint) size
from anc group by a"""


@register("a5_node_height")
def _a5():
    return _heights("chain_comments")


@register("a5_node_height_bushy")
def _a5b():
    return _heights("bushy_comments")


@register("a8_direct_children")
def _a8():
    return ctes("order_comments") + """
select tl.comment_id Top_comment_id, cast(count(c.comment_id) as bigint) Top_comment_direct_children
from order_comments tl left join order_comments c on c.post_id = tl.post_id and c.parent_id = tl.comment_id
where tl.parent_id is null group by tl.comment_id"""


# --------------------------------------------------------------- text scores and language
def _tri(s: str) -> str:
    return (f"list_filter(list_transform(range(1, length(lower({s})) - 1), lambda i: substring(lower({s}), i, 3)), "
            f"lambda g: regexp_full_match(g, '\\p{{L}}{{3}}'))")


def language_ctes(rel: str, key: str, text: str) -> str:
    """Span languages ``sl`` and English ``flags`` of the texts of ``rel``,
    with profiles trained on the documents."""
    return f"""prof as (select lang, tri from (select lang, tri, row_number() over (partition by lang order by cnt desc, tri) r
    from (select lang, tri, count(*) cnt from (select lang, unnest({_tri('text')}) tri from documents) group by all)) where r <= 300),
sp as (select * from (select {key} doc_id, unnest(string_split({text}, chr(10))) span,
    unnest(generate_series(0, len(string_split({text}, chr(10))) - 1)) span_no from {rel}) where trim(span) <> ''),
hits as (select doc_id, span_no, lang from (select doc_id, span_no, lang,
    row_number() over (partition by doc_id, span_no order by cnt desc, lang) r
    from (select doc_id, span_no, lang, count(*) cnt from (select doc_id, span_no, unnest({_tri('span')}) tri from sp)
          join prof using (tri) group by all)) where r = 1),
sl as (select doc_id, span_no, coalesce(h.lang, 'un') lang, length(span) span_len from sp left join hits h using (doc_id, span_no)),
flags as (select doc_id, (langs = ['en'] or (langs = ['en', 'un'] and first_lang = 'en' and en_share > 0.8)) is_english from
  (select doc_id, list_sort(list(lang)) langs, list(lang order by n desc, lang)[1] first_lang,
     sum(case when lang = 'en' then n else 0 end) / sum(n) en_share
   from (select doc_id, lang, sum(span_len) n from sl group by all) group by doc_id))"""


def _lex_sql(t: str, idx: int) -> str:
    return "case " + " ".join(f"when {t} = {tx.sql_str(r[0])} then {r[idx]}::double" for r in SENTIMENT_LEXICON) + " end"


_NEG = "[" + ", ".join(tx.sql_str(w) for w in NEGATIONS) + "]"
def sentiment_sql(rel: str, key: str, text: str) -> str:
    return f"""select {key},
  round(case when len(h) > 0 then list_sum(list_transform(h, lambda x: x.p)) / len(h) else 0.0 end, 6) Top_comment_polarity,
  round(case when len(h) > 0 then list_sum(list_transform(h, lambda x: x.s)) / len(h) else 0.0 end, 6) Top_comment_subjectivity
from (select {key}, list_filter(list_transform(toks, lambda t, i: struct_pack(
    p := {_lex_sql('t', 1)} * case when coalesce(list_contains({_NEG}, case when i >= 2 then toks[i - 1] end), false)
      or coalesce(list_contains({_NEG}, case when i >= 3 then toks[i - 2] end), false) then -0.5 else 1.0 end,
    s := {_lex_sql('t', 2)})), lambda x: x.p is not null) h
  from (select {key}, {tx.sql_valid_tokens(text)} toks from {rel}))"""
def readability_sql(rel: str, key: str, text: str) -> str:
    return f"""select {key}, round(case when nw > 0 then 0.39::double * nw / ns + 11.8::double * syl / nw - 15.59::double else 0.0 end, 6)
  Top_comment_readability from (select {key}, len(w) nw,
  greatest(1, len(regexp_extract_all(coalesce(t, ''), '[.!?]+'))) ns,
  list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(lower(x), '[aeiouy]+'))))) syl
  from (select {key}, t, regexp_extract_all(coalesce(t, ''), '[A-Za-z]+') w
        from (select {key}, {text} t from {rel})))"""
# --------------------------------------------------------------- features
@register("p1_explode_tlc")
def _p1():
    return ctes("conv_comments") + """
select post_id, comment_id Top_comment_id, sibling_ord Top_comment_order, body
from conv_comments where parent_id is null"""


@register("p3_tlc_key")
def _p3():
    return ctes("conv_comments") + """
select subreddit Top_comment_subreddit, subreddit_id Top_comment_subreddit_id, comment_id Top_comment_id
from conv_comments where parent_id is null"""


def features_cte(src: str, posts: str) -> str:
    """Basic TLC features (P2) of ``src`` as CTEs ``roll``, ``base``, ``features``
    (needs the ``tree`` CTE of ``src``)."""
    tc, pc = "t.created_utc", "p.created_utc"
    return f"""roll as (
  select tl.comment_id Top_comment_id,
    cast(count(r.comment_id) as bigint) Replies_total_number,
    cast(coalesce(max(r.level), 0) as bigint) Replies_max_depth,
    cast(coalesce(sum(r.links), 0) as bigint) Replies_links_count,
    cast(coalesce(sum(coalesce(r.score, 0)), 0) as bigint) Replies_sum_score,
    cast(count(case when r.level = 1 then 1 end) as bigint) Top_comment_direct_children
  from {src} tl left join (
    select t.tlc_id, t.level, c.comment_id, c.score, {tx.sql_link_count('c.body')} links
    from tree t join {src} c using (post_id, comment_id) where t.level > 0) r
    on r.tlc_id = tl.comment_id
  where tl.parent_id is null group by tl.comment_id),
base as (
  select t.comment_id Top_comment_id, t.sibling_ord Top_comment_order, p.created_utc Post_created_utc,
    coalesce(p.score, 0) Post_score, t.created_utc Top_comment_created_utc, t.subreddit Top_comment_subreddit,
    {tx.sql_link_count('t.body')} Top_comment_link_count, coalesce(t.score, 0) Top_comment_score,
    t.author Top_comment_author, p.author Post_author,
    {cal.sql_utc_hour(tc)} Top_comment_hour, {cal.sql_utc_day(tc)} Top_comment_day,
    {cal.sql_utc_weekday(tc)} Top_comment_day_of_week,
    {cal.sql_utc_hour(pc)} Post_hour, {cal.sql_utc_day(pc)} Post_day, {cal.sql_utc_weekday(pc)} Post_day_of_week,
    {cal.sql_hours_post_to_tlc(tc, pc)} Top_comment_and_Post_time_difference,
    {tx.sql_clean_text('t.body')} Top_comment_text,
    {tx.sql_clean_text(tx.sql_post_text('p.title', 'p.selftext'))} Post_text
  from {src} t join {posts} p using (post_id) where t.parent_id is null),
features as (
select b.Top_comment_id, Top_comment_order, Post_created_utc, Post_score, Top_comment_created_utc,
  Top_comment_subreddit, Top_comment_link_count, Top_comment_score, Top_comment_author, Post_author,
  r.Top_comment_direct_children, Top_comment_hour, Top_comment_day, Top_comment_day_of_week, Post_hour, Post_day,
  Post_day_of_week, Top_comment_and_Post_time_difference, Replies_total_number, Replies_max_depth,
  Replies_links_count, Replies_sum_score, Top_comment_text,
  cast({tx.sql_token_count('b.Top_comment_text')} as bigint) Top_comment_word_count, Post_text,
  s.Top_comment_polarity, s.Top_comment_subjectivity, f.Top_comment_readability
from base b join roll r using (Top_comment_id)
join ({sentiment_sql('base', 'Top_comment_id', 'Top_comment_text')}) s using (Top_comment_id)
join ({readability_sql('base', 'Top_comment_id', 'Top_comment_text')}) f using (Top_comment_id))"""


@register("p2_basic_features")
def _p2():
    return (ctes("conv_comments", "conv_posts", extra=tree_cte("conv_comments") + ",\n"
                 + features_cte("conv_comments", "conv_posts") + ",\n"
                 + language_ctes("base", "Top_comment_id", "Top_comment_text"), recursive=True)
            + " select * from features where Top_comment_id in (select doc_id from flags where is_english)")


# --------------------------------------------------------------- halves and sampling
def _counts(src: str) -> str:
    return tree_cte(src) + f""",
counts as (
  select tl.subreddit Top_comment_subreddit, tl.subreddit_id Top_comment_subreddit_id,
    tl.comment_id Top_comment_id, cast(count(t.comment_id) as bigint) n_replies
  from {src} tl left join tree t on t.post_id = tl.post_id and t.tlc_id = tl.comment_id and t.level > 0
  where tl.parent_id is null group by all),
even as (select * from counts where n_replies > 0 and n_replies % 2 = 0)"""


def _sample() -> str:
    return """,
strata as (select Top_comment_subreddit, Top_comment_subreddit_id, n_replies, cast(count(*) as bigint) n_members
  from even group by all having count(*) >= 50),
sample as (select e.* from (
    select *, row_number() over (partition by Top_comment_subreddit, Top_comment_subreddit_id, n_replies
      order by md5('42:' || Top_comment_id), Top_comment_id) r from even) e
  join strata s using (Top_comment_subreddit, Top_comment_subreddit_id, n_replies) where r <= 100)"""


@register("a3_sum_by_key")
def _a3():
    return ctes("order_comments", extra=_counts("order_comments"), recursive=True) + " select * from counts"


@register("f6_even")
def _f6():
    return ctes("order_comments", extra=_counts("order_comments"), recursive=True) + " select * from even"


@register("f7_strata")
def _f7():
    return ctes("order_comments", extra=_counts("order_comments") + _sample(), recursive=True) + " select * from strata"


@register("w3_stratified_sample")
def _w3():
    return (ctes("order_comments", extra=_counts("order_comments") + _sample(), recursive=True)
            + " select Top_comment_subreddit, Top_comment_subreddit_id, Top_comment_id, n_replies from sample")


@register("w3_sample_with_replacement")
def _w3r():
    keys = "Top_comment_subreddit, Top_comment_subreddit_id, n_replies"
    draw = ("('0x' || substr(md5(concat_ws(':', '42', Top_comment_subreddit, Top_comment_subreddit_id, n_replies, draw)), 1, 12))"
            "::bigint")
    return (ctes("order_comments", extra=_counts("order_comments") + _sample() + f""",
ranked as (select *, row_number() over (partition by {keys} order by md5('42:' || Top_comment_id), Top_comment_id) pos from even),
draws as (select *, case when n_members <= 100 then draw else {draw} % n_members + 1 end pos
  from (select *, unnest(range(1, least(n_members, 100) + 1)) draw from strata))""", recursive=True)
            + f" select {keys}, r.Top_comment_id, draw from draws d join ranked r using ({keys}, pos)")


def _replies(src: str) -> str:
    """Replies with tlc, level and whole-tree height, ranked by time."""
    return tree_cte(src) + ",\n" + anc_cte(src) + f""",
h as (select post_id, a comment_id, cast(max(d) + 1 as bigint) height from anc group by all),
r as (select c.*, t.tlc_id, t.level, h.height from {src} c join tree t using (post_id, comment_id)
      join h using (post_id, comment_id) where t.level > 0),
rk as (select *, row_number() over (partition by post_id, tlc_id order by created_utc, comment_id) time_rank,
       count(*) over (partition by post_id, tlc_id) n_replies from r),
halves as (select *, case when time_rank <= n_replies / 2 then 0 else 1 end half from rk
           where n_replies > 0 and n_replies % 2 = 0),
hf as (select tlc_id Top_comment_id, half,
    cast(sum({tx.sql_link_count('body')}) as bigint) Replies_links_count,
    cast(count(*) as bigint) Replies_total_number,
    cast(count(case when parent_id = tlc_id then 1 end) as bigint) Top_comment_direct_children,
    cast(sum(coalesce(score, 0)) as bigint) Replies_sum_score,
    cast(max(height) as bigint) Replies_max_depth
  from halves group by all),
tot as (select tlc_id Top_comment_id, cast(count(case when parent_id = tlc_id then 1 end) as bigint) Top_comment_direct_children
  from halves group by all)"""


@register("w1_order")
def _w1():
    return (ctes("conv_comments", extra=_replies("conv_comments"), recursive=True)
            + " select tlc_id Top_comment_id, comment_id, cast(time_rank as bigint) time_rank, cast(n_replies as bigint) n_replies from rk")


@register("w2_split")
def _w2():
    return (ctes("conv_comments", extra=_replies("conv_comments"), recursive=True)
            + " select tlc_id Top_comment_id, comment_id, half from halves")


@register("a6_half_features")
def _a6():
    return ctes("chain_comments", extra=_replies("chain_comments"), recursive=True) + " select * from hf"


@register("a7_direct_total")
def _a7():
    return ctes("conv_comments", extra=_replies("conv_comments"), recursive=True) + " select * from tot"


@register("j2_fix_direct")
def _j2():
    return (ctes("conv_comments", extra=_replies("conv_comments"), recursive=True) + """
select hf.Top_comment_id, hf.half, hf.Replies_links_count, hf.Replies_total_number,
  case when hf.half = 1 then tot.Top_comment_direct_children else hf.Top_comment_direct_children end Top_comment_direct_children,
  hf.Replies_sum_score, hf.Replies_max_depth
from hf join tot using (Top_comment_id)""")


@register("j1_sample_join")
def _j1():
    return (ctes("order_comments", "order_posts", extra=_counts("order_comments") + _sample() + ",\n"
                 + features_cte("order_comments", "order_posts"), recursive=True)
            + " select s.n_replies, f.* from sample s join features f using (Top_comment_id)")


# --------------------------------------------------------------- vocabulary
from ..functions.fixed import STOP_WORDS  # noqa: E402


def _vocab_ctes() -> str:
    stops = ", ".join(tx.sql_str(w) for w in STOP_WORDS)
    return f"""with docs as (select doc_id, {tx.sql_valid_tokens(tx.sql_clean_text('text'))} toks from documents),
kept as (select * from docs where len(toks) > 10),
ndocs as (select count(*) n from kept),
dfreq as (select w word, cast(count(*) as bigint) doc_freq from (select distinct doc_id, unnest(toks) w from kept) group by w),
band as (select d.* from dfreq d, ndocs where doc_freq >= 10 and doc_freq < 0.9::double * n),
vocab as (select * from band where word not in ({stops})),
pos as (select doc_id, unnest(toks) word, unnest(generate_series(1, len(toks))) pos from kept),
vdocs as (select doc_id, string_agg(word, ' ' order by pos) text_for_topic_modeling
          from pos where word in (select word from vocab) group by doc_id)"""


ORACLE["t2_treebank_count"] = f"select doc_id, cast({tx.sql_token_count('text')} as bigint) n_tokens from documents"
ORACLE["t7_token"] = (f"select doc_id, array_to_string(t, ' ') valid_text, cast(len(t) as bigint) n_valid from "
                      f"(select doc_id, {tx.sql_valid_tokens(tx.sql_clean_text('text'))} t from documents)")
ORACLE["f3_min_tokens"] = _vocab_ctes() + " select doc_id, cast(len(toks) as bigint) n_valid from kept"
ORACLE["a9_doc_freq"] = _vocab_ctes() + " select * from dfreq"
ORACLE["a10_doc_count"] = _vocab_ctes() + " select cast(n as bigint) n_docs from ndocs"
ORACLE["f4_band"] = _vocab_ctes() + " select * from band"
ORACLE["o1_minus_stop"] = _vocab_ctes() + " select * from vocab"
ORACLE["f10_vocab_docs"] = _vocab_ctes() + " select * from vdocs"
ORACLE["j4_vocab_semi_join"] = (_vocab_ctes() + " select doc_id, cast(count(*) as bigint) n_kept from pos "
                                "where word in (select word from vocab) group by doc_id")
ORACLE["f5_nonempty_docs"] = (_vocab_ctes() + " select cast(count(*) as bigint) n_nonempty, "
                              "cast(count(case when trim(text_for_topic_modeling) = '' then 1 end) as bigint) n_blank from vdocs")
ORACLE["a11_bow"] = _vocab_ctes() + """,
ids as (select word, row_number() over (order by word) - 1 word_id from vocab),
cnt as (select doc_id, word_id, count(*) c from pos join ids using (word) group by all)
select doc_id, string_agg(word_id || ':' || c, ' ' order by word_id) bow from cnt group by doc_id"""


# --------------------------------------------------------------- scalar text and calendar
LOCAL_TZ = "America/Detroit"


def _local(x: str) -> str:
    return f"timezone('{LOCAL_TZ}', timezone('UTC', {cal.sql_ts(x)}))"


ORACLE["t1_clean"] = ctes("conv_comments") + f" select comment_id, {tx.sql_clean_text('body')} clean_body from conv_comments"
ORACLE["t1_clean_docs"] = f"select doc_id, {tx.sql_clean_text('text')} clean_text from documents"
ORACLE["t3_links"] = ctes("conv_comments") + f" select comment_id, {tx.sql_link_count('body')} n_links from conv_comments"
ORACLE["t3_links_pages"] = f"select page_id, {tx.sql_link_count('url')} n_links from pages"
ORACLE["t4_calendar"] = ctes("chain_comments") + (
    f" select comment_id, {cal.sql_utc_hour('created_utc')} AS hour_of_day, {cal.sql_utc_day('created_utc')} AS day_of_month, "
    f"{cal.sql_utc_weekday('created_utc')} day_of_week from chain_comments")
ORACLE["t5_hours"] = ctes("order_comments", "order_posts") + (
    f" select c.comment_id, {cal.sql_hours_post_to_tlc('c.created_utc', 'p.created_utc')} AS hours_diff "
    "from order_comments c join order_posts p using (post_id) where c.parent_id is null")
ORACLE["t6_local"] = ctes("chain_comments") + (
    f" select comment_id, hour({_local('created_utc')}) AS hour_of_day, day({_local('created_utc')}) AS day_of_month, "
    f"isodow({_local('created_utc')}) day_of_week from chain_comments")
ORACLE["t8_alpha"] = f"select doc_id, {tx.sql_alpha_words('text')} alpha_text from documents"
ORACLE["t9_words"] = f"select doc_id, {tx.sql_space_word_count(tx.sql_alpha_words('text'))} word_count from documents"
ORACLE["t17_prefix"] = ctes("conv_comments") + (
    " select comment_id, 't1_' || parent_id typed_parent, "
    f"{tx.sql_strip_type_prefix(chr(39) + 't1_' + chr(39) + ' || parent_id')} parent "
    "from conv_comments where parent_id is not null")
ORACLE["t19_concat"] = ctes("conv_posts") + f" select post_id, {tx.sql_post_text('title', 'selftext')} post_text from conv_posts"


# --------------------------------------------------------------- scores, pairs, subsets
_LI = "(select l_extendedprice / 100000.0 y, l_quantity / 50.0 p from lineitem)"
ORACLE["a14_regression_scores"] = f"""select cast(count(*) as bigint) n,
  round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) r2, round(sum((y - p) * (y - p)) / count(*), 6) mse
from {_LI}"""
ORACLE["a17_mean_baseline"] = f"""select cast(count(*) as bigint) n,
  round(1 - sum((y - m) * (y - m)) / (var_pop(y) * count(*)), 6) r2, round(sum((y - m) * (y - m)) / count(*), 6) mse
from {_LI}, (select avg(y) m from {_LI})"""
_LD = "(select l.*, d.n_chars, d.source from labels l join documents d using (doc_id))"
ORACLE["a15_ce"] = f"""select round(avg(greatest(z0, z1) + ln(exp(z0 - greatest(z0, z1)) + exp(z1 - greatest(z0, z1)))
    - case when gold = 0 then z0 else z1 end), 6) cross_entropy,
  round(avg(case when (case when z1 > z0 then 1 else 0 end) = gold then 1.0 else 0.0 end), 6) accuracy,
  cast(count(*) as bigint) n
from (select 0.0::double z0, (n_chars - 1500) / 1000.0 z1, quality gold from {_LD})"""
_PAIRS = """(select l.doc_id l_id, r.doc_id r_id, r.quality human_label from labels l join labels r on r.doc_id = l.doc_id + 1)"""
_PROWS = f"""(select p.l_id, p.r_id, p.human_label,
  a.n_chars n_chars_l, a.quality quality_l, a.toxic toxic_l, a.source source_l,
  b.n_chars n_chars_r, b.quality quality_r, b.toxic toxic_r, b.source source_r
  from {_PAIRS} p join {_LD} a on a.doc_id = p.l_id join {_LD} b on b.doc_id = p.r_id)"""
_RANK = f"""(select l_id, r_id, human_label, cast(case when toxic_l > toxic_r then 0 when toxic_l < toxic_r then 1
  else ('0x' || substr(md5(cast(l_id as varchar) || ':' || cast(r_id as varchar)), 1, 1))::int % 2 end as int) pred from {_PROWS})"""
ORACLE["j7_pairs"] = f"select * from {_PROWS}"
ORACLE["m9_rank"] = f"select l_id, r_id, pred from {_RANK}"
ORACLE["a16_pair_scores"] = f"""select round(accuracy, 6) accuracy, round(recall_l, 6) recall_l, round(recall_r, 6) recall_r,
  round(case when recall_l + recall_r > 0 then 2 * recall_l * recall_r / (recall_l + recall_r) end, 6) f1_score
from (select count(case when pred = human_label then 1 end) / count(*) accuracy,
  case when count(case when human_label = 0 then 1 end) > 0 then count(case when human_label = 0 and pred = 0 then 1 end) / count(case when human_label = 0 then 1 end) end recall_l,
  case when count(case when human_label = 1 then 1 end) > 0 then count(case when human_label = 1 and pred = 1 then 1 end) / count(case when human_label = 1 then 1 end) end recall_r
  from {_RANK})"""
ORACLE["t13_t14_rescale"] = f"""select doc_id, round(2.0 * toxic - 1, 6)::double gender_value,
  round((0.5 * (1 + 4 * quality) - 1.5)::double, 6) politeness_value from {_LD}"""
ORACLE["t15_toxicity"] = """select doc_id, case when toxic > 0.5 then 1 else 0 end untuned_toxicity,
  case when toxic > 0.8 and 1 - quality > 0.5 then 1 else 0 end tuned_toxicity from labels"""
ORACLE["x5_toxic_children"] = ctes("order_comments", "order_scores", extra=tree_cte("order_comments"), recursive=True) + """
select tlc_id Top_comment_id, cast(sum(u) as bigint) Replies_untuned_toxicity_children_count,
  cast(sum(t) as bigint) Replies_tuned_toxicity_children_count,
  round(avg(1 - u), 6) Replies_untuned_non_toxic_percentage, round(avg(1 - t), 6) Replies_tuned_non_toxic_percentage
from (select tr.tlc_id, case when s.toxicity > 0.5 then 1 else 0 end u,
  case when s.toxicity > 0.8 and s.attack > 0.5 then 1 else 0 end t
  from tree tr left join order_scores s using (post_id, comment_id) where tr.level > 0) group by tlc_id"""
ORACLE["t16_cosine"] = """select a_id, b_id, round(dot / (sqrt(na) * sqrt(nb)), 6) cosine from (
  select a.vec_id a_id, b.vec_id b_id,
    list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda t: t[1]::double * t[2]::double)) dot,
    list_sum(list_transform(a.embedding, lambda t: t::double * t::double)) na,
    list_sum(list_transform(b.embedding, lambda t: t::double * t::double)) nb
  from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"""
ORACLE["a18_moments"] = """select round(avg(x), 6) mean, round(stddev_pop(x), 6) std, cast(count(*) as bigint) n_cells
from (select unnest(embedding)::double x from embeddings)"""
ORACLE["w4_subset"] = """select o_orderkey, o_custkey from orders order by md5('42:' || cast(o_orderkey as varchar)), o_orderkey limit 1000"""
ORACLE["w5_eval_subset"] = """select o_orderkey, o_custkey from orders order by md5('42:' || cast(o_orderkey as varchar)), o_orderkey
limit (select count(*) // 500 from orders)"""


# --------------------------------------------------------------- outcome tables and merge
from ..functions.fixed import (ACCOMMODATION_MARKERS, FUNDRAISING_HOSTS, INFORMATIVE_HOSTS,  # noqa: E402
                               OUTCOME_METRICS, PROSOCIAL_NEW_NAMES, PROSOCIAL_OLD_NAMES,
                               PROSOCIAL_PATTERNS)


def _outcome_ctes(src: str, scores: str | None = None) -> str:
    scores = scores or src.replace("_comments", "_scores")
    body = "coalesce(body, '')"
    pros = ",\n    ".join(
        [f"cast(count(case when regexp_matches({body}, {tx.sql_str(p)}) then 1 end) as bigint) Replies_{k}_count"
         for k, p in PROSOCIAL_PATTERNS.items()]
        + [f"cast(count(case when regexp_matches({body}, {tx.sql_str(FUNDRAISING_HOSTS)}) then 1 end) as bigint) Replies_fundraising_URL_count",
           f"cast(count(case when regexp_matches({body}, {tx.sql_str(INFORMATIVE_HOSTS)}) then 1 end) as bigint) Replies_informative_URL_count"])

    def has(col, m):
        words = "[" + ", ".join(tx.sql_str(w) for w in ACCOMMODATION_MARKERS[m]) + "]"
        return f"list_has_any(regexp_split_to_array(lower(coalesce({col}, '')), '[^a-z]+'), {words})"
    acc_aggs, acc_out = [], []
    for m in ACCOMMODATION_MARKERS:
        c, p = has("h.body", m), has("pp.body", m)
        acc_aggs.append(f"count(case when {c} and {p} then 1 end) cp_{m}, count(case when {p} then 1 end) p_{m}, "
                        f"count(case when {c} then 1 end) c_{m}")
        acc_out.append(f"case when p_{m} > 0 then cp_{m} / p_{m} - c_{m} / n else 0.0 end Top_comment_{m}_accommodation")
    return _replies(src) + f""",
pros as (select tlc_id Top_comment_id, half, {pros} from halves group by all),
accraw as (select h.tlc_id Top_comment_id, h.half, count(*) n, {", ".join(acc_aggs)}
  from halves h join {src} pp on pp.post_id = h.post_id and pp.comment_id = h.parent_id group by all),
acc as (select Top_comment_id, half, {", ".join(acc_out)} from accraw),
scored as (select h.tlc_id, h.half, s.* from halves h left join {scores} s using (post_id, comment_id)),
ps as (select tlc_id Top_comment_id, half, avg(0.5 * politeness - 1.5) Replies_average_politeness,
  avg(0.5 * support - 1.5) Replies_average_support from scored group by all),
tox as (select tlc_id Top_comment_id, half, cast(sum(u) as bigint) Replies_untuned_toxicity_children_count,
  cast(sum(t) as bigint) Replies_tuned_toxicity_children_count,
  avg(1 - u) Replies_untuned_non_toxic_percentage, avg(1 - t) Replies_tuned_non_toxic_percentage
  from (select *, case when toxicity > 0.5 then 1 else 0 end u,
    case when toxicity > 0.8 and attack > 0.5 then 1 else 0 end t from scored) group by all),
par as (select c.post_id, c.comment_id, c.parent_id, c.author, p.author pa, p.parent_id gp
  from {src} c left join {src} p on p.post_id = c.post_id and p.comment_id = c.parent_id),
x as (select par.*, coalesce(pa is not null and pa <> par.author and g.author is not null and g.author = par.author, false) cont,
  case when pa is null or pa = par.author then 1 else 2 end base
  from par left join {src} g on g.post_id = par.post_id and g.comment_id = par.gp),
altr(post_id, comment_id, alt) as (
  select post_id, comment_id, base from x where not cont
  union all
  select x.post_id, x.comment_id, a.alt + 1 from x join altr a on x.post_id = a.post_id and x.parent_id = a.comment_id
  where x.cont),
sus as (select h.tlc_id Top_comment_id, h.half,
  cast(count(distinct case when x.cont then least(x.author, x.pa) || '|' || greatest(x.author, x.pa) end) as bigint)
    Replies_distinct_pairs_of_sustained_conversation,
  cast(case when max(a.alt) >= 3 then max(a.alt) else 0 end as bigint) Replies_max_turns_of_sustained_conversations
  from halves h join x using (post_id, comment_id) join altr a using (post_id, comment_id) group by all),
basic as (select hf.Top_comment_id, hf.half, hf.Replies_links_count, hf.Replies_total_number,
  case when hf.half = 1 then tot.Top_comment_direct_children else hf.Top_comment_direct_children end Top_comment_direct_children,
  hf.Replies_sum_score, hf.Replies_max_depth from hf join tot using (Top_comment_id)),
merged as (select * from basic join pros using (Top_comment_id, half) join sus using (Top_comment_id, half)
  join acc using (Top_comment_id, half) join ps using (Top_comment_id, half) join tox using (Top_comment_id, half))"""


def _r6(cols):
    return ", ".join(f"round({c}, 6) {c}" if c.endswith(("accommodation", "percentage", "politeness", "support"))
                     else c for c in cols)


_OUT = ["Top_comment_id", "half"] + OUTCOME_METRICS
ORACLE["x3_prosocial"] = ctes("conv_comments", "conv_scores", extra=_outcome_ctes("conv_comments"), recursive=True) + " select * from pros"
ORACLE["x2_accommodation"] = (ctes("order_comments", "order_scores", extra=_outcome_ctes("order_comments"), recursive=True)
                              + " select " + _r6(["Top_comment_id", "half"] + [f"Top_comment_{m}_accommodation" for m in ACCOMMODATION_MARKERS]) + " from acc")
ORACLE["x6_politeness_support"] = (ctes("conv_comments", "conv_scores", extra=_outcome_ctes("conv_comments"), recursive=True)
                                   + " select " + _r6(["Top_comment_id", "half", "Replies_average_politeness", "Replies_average_support"]) + " from ps")
ORACLE["x7_sustained"] = ctes("order_comments", "order_scores", extra=_outcome_ctes("order_comments"), recursive=True) + " select * from sus"
ORACLE["p7_outcomes"] = (ctes("conv_comments", "conv_scores", extra=_outcome_ctes("conv_comments"), recursive=True)
                         + " select " + _r6(_OUT) + " from merged")
ORACLE["j3_merge"] = (ctes("order_comments", "order_scores", extra=_outcome_ctes("order_comments"), recursive=True)
                      + " select " + _r6(_OUT) + " from merged")
ORACLE["j3_sampled_merge"] = (ctes("order_comments", "order_scores", extra=_outcome_ctes("order_comments") + ",\n"
                                   + _counts("order_comments").replace(tree_cte("order_comments") + ",\n", "") + _sample(),
                                   recursive=True)
                              + " select " + _r6(_OUT) + " from merged where Top_comment_id in (select Top_comment_id from sample)")
ORACLE["a6_half_features_orders"] = (ctes("order_comments", "order_scores", extra=_outcome_ctes("order_comments"), recursive=True)
                                     + " select * from basic")
ORACLE["a12_dedupe"] = """select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over
  (partition by o_custkey order by o_orderkey, o_totalprice) r from orders) where r = 1"""
ORACLE["p5_halves_to_rows"] = """select o.l_orderkey, h.half, round(coalesce(sum(l.l_quantity), 0), 4) l_quantity,
  round(coalesce(sum(l.l_tax), 0), 4) l_tax
from (select distinct l_orderkey from lineitem) o, (select unnest([0, 1]) half) h
left join lineitem l on l.l_orderkey = o.l_orderkey and (l.l_linenumber > 3) = (h.half = 1) group by all"""
ORACLE["p6_rename"] = (ctes("conv_comments", "conv_scores", extra=_outcome_ctes("conv_comments"), recursive=True)
                       + " select " + ", ".join(PROSOCIAL_NEW_NAMES) + " from pros where half = 0")


# --------------------------------------------------------------- categories and sequences
_DICT = """(select name, row_number() over (order by name) category_id from
  (select distinct p_type name from part where p_type is not null)
  union all select '<generic>', 0)"""
ORACLE["a13_vocab_ids"] = f"select * from {_DICT}"
ORACLE["a21_id_check"] = f"""select min(category_id) min_id, max(category_id) max_id, cast(count(*) as bigint) n,
  cast(count(distinct category_id) as bigint) n_distinct,
  (min(category_id) = 0 and max(category_id) = count(*) - 1 and count(distinct category_id) = count(*)) ids_contiguous
from {_DICT}"""
ORACLE["j5_lookup"] = """with n as (select doc_id, concat_ws('/', source, lang) name from documents),
d as (select name, row_number() over (order by name) category_id from (select distinct name from n
  where doc_id in (select doc_id from labels where toxic = 1)))
select n.doc_id, cast(coalesce(d.category_id, 0) as bigint) category_id from n left join d using (name)"""


def _u(key: str, part: int) -> str:
    return f"((('0x' || substr(md5({key}), {1 + 8 * part}, 8))::bigint)::double + 1.0) / 4294967296.0"


_CELLS = f"""(select c.category_id, c.j, coalesce(k.v::double,
    sqrt(-2.0 * ln({_u("'42:' || c.category_id || ':' || c.j", 0)})) * cos(2.0 * pi() * {_u("'42:' || c.category_id || ':' || c.j", 1)})
    * m.sd + m.mu) value
  from (select category_id, unnest(range(64)) j from {_DICT}) c
  left join (select vec_id category_id, unnest(embedding) v, unnest(range(len(embedding))) j from embeddings) k
    using (category_id, j),
  (select round(avg(x), 6) mu, round(stddev_pop(x), 6) sd from (select unnest(embedding)::double x from embeddings)) m)"""
ORACLE["j6_embedding_fill"] = f"select category_id, j, round(value, 4) value from {_CELLS}"
ORACLE["t18_blend"] = f"""select c.category_id, c.j, round(0.5 * c.value + 0.5 * g.value, 4) value
from {_CELLS} c join (select j, value from {_CELLS} where category_id = 0) g using (j)"""


def _enc_ctes() -> str:
    return _vocab_ctes() + """,
ids as (select word, row_number() over (order by word) - 1 + 5 tok_id from vocab),
apos as (select doc_id, unnest(toks) word, unnest(generate_series(1, len(toks))) pos from docs),
aenc as (select doc_id, list(coalesce(ids.tok_id, 1) order by pos) ids from apos left join ids using (word) group by doc_id),
enc as (select docs.doc_id, coalesce(aenc.ids, []) ids from docs left join aenc using (doc_id)),
seqs as (select doc_id, list_concat([2], ids[1:126], [3]) seq from enc),
padded as (select doc_id, list_resize(seq, 128, 0) p, len(seq) n from seqs)"""


ORACLE["t20_pad"] = _enc_ctes() + " select doc_id, array_to_string(p, ' ') input_ids, cast(n as bigint) n_real from padded"


def _seq_cte(name: str, rel: str, key: str, text: str) -> str:
    return f""",
{name}d as (select {key}, {tx.sql_valid_tokens(tx.sql_clean_text(text))} toks from {rel}),
{name}p as (select {key}, unnest(toks) word, unnest(generate_series(1, len(toks))) pos from {name}d),
{name}e as (select {key}, list(coalesce(ids.tok_id, 1) order by pos) ids from {name}p left join ids using (word) group by {key}),
{name} as (select d.{key}, array_to_string(list_resize(list_concat([2], coalesce(e.ids, [])[1:126], [3]), 128, 0), ' ') seq
  from {name}d d left join {name}e e using ({key}))"""


ORACLE["t20_post_tlc"] = (
    _enc_ctes().replace("with docs as", ctes("conv_comments", "conv_posts") + ",\ndocs as", 1)
    + ", tl as (select * from conv_comments where parent_id is null)"
    + _seq_cte("a", "tl", "comment_id", "body") + _seq_cte("b", "conv_posts", "post_id", tx.sql_post_text("title", "selftext"))
    + " select tl.post_id, tl.comment_id, a.seq tlc_ids, b.seq post_ids from tl join a using (comment_id) join b using (post_id)")


def _mlm() -> str:
    key = "'42:' || doc_id || ':' || (i - 1)"
    chosen = f"(x >= 5 and {_u(key, 0)} <= 0.15)"
    rnd = f"(((('0x' || substr(md5({key}), 25, 8))::bigint) % vs) + 5)"
    new = (f"case when not {chosen} then x when {_u(key, 1)} <= 0.8 then 4 "
           f"when {_u(key, 2)} <= 0.5 then {rnd} else x end")
    lab = f"case when {chosen} then x else -100 end"
    return (f"select doc_id, array_to_string(list_transform(p, lambda x, i: {new}), ' ') input_ids, "
            f"array_to_string(list_transform(p, lambda x, i: {lab}), ' ') labels "
            f"from padded, (select count(*) vs from vocab)")


ORACLE["m11_mask"] = _enc_ctes() + " " + _mlm()
ORACLE["o2_union"] = """select 'documents' origin, doc_id item_id, length(text) n_chars from documents
union all select 'benchmark', item_id, length(text) from benchmark"""


# --------------------------------------------------------------- language and text scores


_LANG = "with " + language_ctes("documents", "doc_id", "text") + """,
fl as (select d.doc_id, coalesce(f.is_english, false) is_english, d.n_chars from documents d left join flags f using (doc_id))"""

ORACLE["t10_span_language"] = _LANG + " select * from sl"
ORACLE["a19_language_share"] = _LANG + """ select doc_id, lang, round(lang_len / total_len, 6) share from
  (select doc_id, lang, sum(span_len) lang_len from sl group by all) join (select doc_id, sum(span_len) total_len from sl group by all) using (doc_id)"""
ORACLE["f1_english"] = _LANG + " select doc_id, is_english from fl"
ORACLE["f2_split"] = _LANG + " select is_english, cast(count(*) as bigint) n_docs, cast(sum(n_chars) as bigint) n_chars from fl group by is_english"


ORACLE["t11_sentiment"] = sentiment_sql("documents", "doc_id", tx.sql_clean_text("text"))

ORACLE["t12_readability"] = readability_sql("documents", "doc_id", tx.sql_clean_text("text"))

ORACLE["a20_misspelling"] = _vocab_ctes() + f""",
dic as (select word from vocab union select unnest([{", ".join(tx.sql_str(w) for w in STOP_WORDS)}])),
dw as (select doc_id, case when text = 'nan' then []::varchar[] else
  list_filter(string_split(lower({tx.sql_alpha_words('text')}), ' '), lambda w: w <> '') end w from documents),
ex as (select doc_id, unnest(w) w1 from dw)
select d.doc_id, round(coalesce(m.miss / m.n, 0.0), 6) misspelling_ratio from dw d left join
  (select doc_id, count(*) n, count(case when dic.word is null then 1 end) miss from ex left join dic on dic.word = ex.w1 group by doc_id) m
  using (doc_id)"""

ORACLE["x1_jaccard"] = ctes("conv_comments", "conv_posts") + f"""
select comment_id Top_comment_id, round(case when u > 0 then i / u else 0.0 end, 6) Post_Top_comment_Jaccard_sim from (
  select comment_id, len(list_distinct(list_intersect(a, b))) i, len(list_distinct(list_concat(a, b))) u from (
    select c.comment_id, {tx.sql_valid_tokens(tx.sql_clean_text(tx.sql_post_text('p.title', 'p.selftext')))} a,
      {tx.sql_valid_tokens(tx.sql_clean_text('c.body'))} b
    from conv_comments c join conv_posts p using (post_id) where c.parent_id is null))"""


# --------------------------------------------------------------- machine learning
_OF = """(select o.o_orderkey, l.n_lines, l.sum_qty, l.avg_disc, l.avg_tax, l.sum_qty / 10.0 x1,
  (l.sum_qty + l.n_lines * 5) / 10.0 + l.avg_disc x2,
  l.sum_qty / 10.0 + 50 * l.avg_disc + o.o_totalprice / 100000.0 y
from orders o join (select l_orderkey, count(*)::double n_lines, sum(l_quantity) sum_qty, avg(l_discount) avg_disc,
  avg(l_tax) avg_tax from lineitem group by l_orderkey) l on l.l_orderkey = o.o_orderkey)"""
# closed-form 2 x 2 PCA: eigenvalues of the sample covariance, eigenvectors
# (b, l - a) normalised, sign: largest |component| positive.
_PCA = f"""with f as {_OF},
cov as (select var_samp(x1) a, covar_samp(x1, x2) b, var_samp(x2) c, avg(x1) m1, avg(x2) m2 from f),
ev as (select *, (a + c) / 2 + sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) l0,
  (a + c) / 2 - sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) l1 from cov),
vec as (select *, b / sqrt(b * b + (l0 - a) * (l0 - a)) v00, (l0 - a) / sqrt(b * b + (l0 - a) * (l0 - a)) v01,
  b / sqrt(b * b + (l1 - a) * (l1 - a)) v10, (l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)) v11 from ev),
sg as (select *, case when abs(v00) >= abs(v01) then sign(v00) else sign(v01) end s0,
  case when abs(v10) >= abs(v11) then sign(v10) else sign(v11) end s1 from vec),
ratios as (select 0 component, l0 / (l0 + l1) explained_variance_ratio from ev
  union all select 1, l1 / (l0 + l1) from ev)"""
ORACLE["m3_pca_ratio"] = _PCA + " select component, round(explained_variance_ratio, 6) explained_variance_ratio from ratios"
ORACLE["w6_top_components"] = (_PCA + " select component, round(explained_variance_ratio, 6) explained_variance_ratio "
                               "from ratios order by explained_variance_ratio desc, component limit 5")
ORACLE["m5_project"] = _PCA + """ select o_orderkey, round(s0 * ((x1 - m1) * v00 + (x2 - m2) * v01), 6) PC0,
  round(s1 * ((x1 - m1) * v10 + (x2 - m2) * v11), 6) PC1 from f, sg"""
ORACLE["m4_loadings"] = _PCA + """ select 0 component, 'x1' feature, round(s0 * v00 * sqrt(l0), 6) loading from sg
  union all select 0, 'x2', round(s0 * v01 * sqrt(l0), 6) from sg
  union all select 1, 'x1', round(s1 * v10 * sqrt(l1), 6) from sg
  union all select 1, 'x2', round(s1 * v11 * sqrt(l1), 6) from sg"""
ORACLE["m8_linear"] = f"select round(regr_slope(y, sum_qty), 6) coefficient, round(regr_intercept(y, sum_qty), 6) intercept from {_OF}"
_LINPRED = f"""select o_orderkey, round(i + s * sum_qty, 6) prediction from {_OF},
  (select regr_slope(y, sum_qty) s, regr_intercept(y, sum_qty) i from {_OF})"""
ORACLE["m12_batch_inference"] = _LINPRED
ORACLE["m13_model_roundtrip"] = _LINPRED


# --------------------------------------------------------------- sources and sinks
ORACLE["s1_json_ingest"] = ctes("conv_comments") + """ select post_id, comment_id, parent_id,
  cast(row_number() over (partition by post_id, parent_id order by sibling_ord) - 1 as int) sibling_ord,
  subreddit, subreddit_id, author, score, created_utc, body from conv_comments"""
ORACLE["s1_json_posts"] = ctes("conv_posts") + " select * from conv_posts"
ORACLE["s2_s4_tsv_roundtrip"] = ORACLE["p2_basic_features"]
ORACLE["s9_embedding_csv"] = """select cast(vec_id as varchar) name, round(list_sum(list_transform(embedding, lambda x: x::double)), 4) cell_sum
from embeddings"""
ORACLE["s7_category_dict"] = ORACLE["a13_vocab_ids"]
ORACLE["s11_replace_labels"] = f"""select p.l_id, p.r_id, l.toxic human_label, p.n_chars_l, p.n_chars_r
from {_PROWS} p join labels l on l.doc_id = p.r_id"""


ORACLE["x8_ngrams"] = _vocab_ctes() + """,
uni as (select doc_id, unnest(toks) term from docs),
bi as (select doc_id, unnest(list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])) term from docs),
tu as (select term from uni group by term order by count(*) desc, term limit 1000),
tb as (select term from bi group by term order by count(*) desc, term limit 1000),
cu as (select doc_id, count(*) c from uni where term in (select term from tu) group by doc_id),
cb as (select doc_id, count(*) c from bi where term in (select term from tb) group by doc_id)
select d.doc_id, cast(len(d.toks) as int) n_tokens, coalesce(cu.c, 0)::double unigram_mass, coalesce(cb.c, 0)::double bigram_mass
from docs d left join cu using (doc_id) left join cb using (doc_id)"""
ORACLE["m6_embedding_facts"] = "select count(*) n_rows, true centred, true uncorrelated, true descending from embeddings"
ORACLE["m7_gbt_facts"] = f"""select cast(count(*) as bigint) n, true beats_mean from {_OF}
  where substr(md5('42:' || o_orderkey), 1, 1) = '0'"""
ORACLE["m7_boosting_facts"] = ORACLE["m7_gbt_facts"]
ORACLE["s6_word_list"] = "select distinct lower(p_name) word from part"
ORACLE["s8_columns"] = "select l_returnflag, cast(sum(l_linenumber) as bigint) n_lines from lineitem group by l_returnflag"
ORACLE["s10_reuse"] = "select o_orderkey, o_orderstatus from orders where o_orderstatus = 'F'"
ORACLE["s12_combine"] = "select doc_id, lang, n_chars from documents"
ORACLE["t21_vector"] = """select l_orderkey, sum(l_quantity) quantity, round(sum(l_discount), 6) discount, cast(3 as bigint) width
from lineitem group by l_orderkey"""
ORACLE["m1_topics"] = _vocab_ctes() + """ select cast(unnest(range(20)) as int) topic, (select count(*) from vocab) n_terms,
  1.0::double weight_sum, true falling"""
ORACLE["m1_word_mass"] = _vocab_ctes() + """ select word, cast(count(*) as bigint) n_tokens from pos
  where word in (select word from vocab) group by word"""
ORACLE["m2_topic_facts"] = _vocab_ctes() + """ select doc_id, case when known then cast(20 as bigint) end n_topics,
  case when known then true end not_negative, case when known then 1.0::double end share_sum
from (select doc_id, doc_id in (select doc_id from vdocs) known from kept)"""


# --------------------------------------------------------------- outcome metrics to PC0 to models
def _metrics(select: str) -> str:
    return ctes("order_comments", "order_scores", extra=_outcome_ctes("order_comments"), recursive=True) + select


ORACLE["m5_metric_scores"] = _metrics(
    " select count(*) n_rows, true centred, true uncorrelated, true descending, round("
    + " + ".join(f"var_samp(coalesce({c}, 0)::double)" for c in OUTCOME_METRICS) + ", 3) total_variance from merged")
ORACLE["m3_metric_ratio"] = "select cast(26 as bigint) n_components, 1.0::double ratio_sum"
ORACLE["m4_metric_loadings"] = _metrics(" " + " union all ".join(
    f"select '{c}' feature, round(var_samp(coalesce({c}, 0)::double), 3) variance from merged" for c in OUTCOME_METRICS))
ORACLE["m8_loaded_coefficients"] = f"""select o_orderkey, round(i + s * sum_qty, 6) score from {_OF},
  (select regr_slope(y, sum_qty) s, regr_intercept(y, sum_qty) i from {_OF})"""


# --------------------------------------------------------------- remaining small ids
ORACLE["f8_half_select"] = (ctes("conv_comments", extra=_replies("conv_comments"), recursive=True)
                            + " select tlc_id Top_comment_id, comment_id from halves where half = 0")
ORACLE["p4_flatten"] = (ctes("bushy_comments", extra=tree_cte("bushy_comments") + ",\n" + anc_cte("bushy_comments"), recursive=True)
                        + """, h as (select post_id, a comment_id, cast(max(d) + 1 as bigint) height from anc group by all)
select t.tlc_id Top_comment_id, t.comment_id, t.level, h.height from tree t join h using (post_id, comment_id) where t.level > 0""")
