"""Registered queries: one per operator id of the survey inventory.

Each query is ``(spark, sf_dir) -> DataFrame`` over the driver's tables (or
tables Spark derives from them), so its work grows with the input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import features as feat
from ..operators import boosting as bo
from ..operators import language as lg
from ..operators import tree
from ..operators.lineage import materialize, release
from ..sources.threads import thread_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def _t(spark, sf_dir, name):
    return thread_table(spark, sf_dir, name)


def _row_local(spark, sf_dir, name):
    """A thread table that is read once, row by row: derived in place, not stored first."""
    return thread_table(spark, sf_dir, name, materialized=False)


# --------------------------------------------------------------- trees
@query("a1_reply_rollup")
def a1_reply_rollup(spark, sf_dir):
    return tree.reply_rollup(_t(spark, sf_dir, "order_comments"))


@query("a2_reply_count")
def a2_reply_count(spark, sf_dir):
    return tree.reply_count(_t(spark, sf_dir, "conv_comments"))


@query("a5_node_height")
def a5_node_height(spark, sf_dir):
    return tree.node_heights(_t(spark, sf_dir, "chain_comments"))


@query("a5_node_height_bushy")
def a5_node_height_bushy(spark, sf_dir):
    return tree.node_heights(_t(spark, sf_dir, "bushy_comments"))


@query("a8_direct_children")
def a8_direct_children(spark, sf_dir):
    return tree.direct_children(_t(spark, sf_dir, "order_comments"))


# --------------------------------------------------------------- features
@query("p1_explode_tlc")
def p1_explode_tlc(spark, sf_dir):
    return feat.explode_tlc(_row_local(spark, sf_dir, "conv_comments"))


@query("p3_tlc_key")
def p3_tlc_key(spark, sf_dir):
    return feat.tlc_key(_row_local(spark, sf_dir, "conv_comments"))


@query("p2_basic_features")
def p2_basic_features(spark, sf_dir):
    profiles = lg.train_profiles(read_table(spark, sf_dir, "documents"), "text", "lang")
    return _round_text_scores(feat.basic_features(_t(spark, sf_dir, "conv_comments"), _t(spark, sf_dir, "conv_posts"),
                                                  profiles=profiles))


def _round_text_scores(df):
    names = ["Top_comment_polarity", "Top_comment_subjectivity", "Top_comment_readability"]
    return df.withColumns({c: F.round(c, 6) for c in names})


# --------------------------------------------------------------- halves and sampling
from ..operators import halves as hv  # noqa: E402


def _even(spark, sf_dir, name="order_comments"):
    return hv.even_tlcs(hv.reply_counts_by_key(_t(spark, sf_dir, name)))


@query("a3_sum_by_key")
def a3_sum_by_key(spark, sf_dir):
    return hv.reply_counts_by_key(_t(spark, sf_dir, "order_comments"))


@query("f6_even")
def f6_even(spark, sf_dir):
    return _even(spark, sf_dir)


@query("f7_strata")
def f7_strata(spark, sf_dir):
    return hv.strata_sizes(_even(spark, sf_dir))


@query("w3_stratified_sample")
def w3_stratified_sample(spark, sf_dir):
    return hv.stratified_sample(_even(spark, sf_dir))


@query("w3_sample_with_replacement")
def w3_sample_with_replacement(spark, sf_dir):
    return hv.stratified_sample_with_replacement(_even(spark, sf_dir))


@query("j1_sample_join")
def j1_sample_join(spark, sf_dir):
    sample = hv.stratified_sample(_even(spark, sf_dir))
    full = feat.basic_features(_t(spark, sf_dir, "order_comments"), _t(spark, sf_dir, "order_posts"))
    return _round_text_scores(hv.sample_join(sample, full))


@query("w1_order")
def w1_order(spark, sf_dir):
    from ..operators.grouprank import group_rank
    r = hv.replies_with_heights(_t(spark, sf_dir, "conv_comments"))
    out = group_rank(r, ["post_id", "tlc_id"], ["created_utc", "comment_id"],
                     rank_col="time_rank", size_col="n_replies")
    return out.select(F.col("tlc_id").alias("Top_comment_id"), "comment_id", "time_rank", "n_replies")


@query("w2_split")
def w2_split(spark, sf_dir):
    h = hv.time_halves(hv.replies_with_heights(_t(spark, sf_dir, "conv_comments")))
    return h.select(F.col("tlc_id").alias("Top_comment_id"), "comment_id", "half")


@query("a6_half_features")
def a6_half_features(spark, sf_dir):
    return hv.half_features(hv.time_halves(hv.replies_with_heights(_t(spark, sf_dir, "chain_comments"))))


@query("a7_direct_total")
def a7_direct_total(spark, sf_dir):
    return hv.direct_total(hv.time_halves(hv.replies_with_heights(_t(spark, sf_dir, "conv_comments"))))


@query("j2_fix_direct")
def j2_fix_direct(spark, sf_dir):
    return hv.fixed_half_features(hv.time_halves(hv.replies_with_heights(_t(spark, sf_dir, "conv_comments"))))


# --------------------------------------------------------------- vocabulary
from ..functions import text as tx  # noqa: E402
from ..operators import vocab as vb  # noqa: E402
from ..sources.tables import read_table, spread  # noqa: E402


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


def _texts(spark, sf_dir):
    """Ids and texts of the documents over all cores, for work on every character."""
    return spread(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id", "text")


def _tokens(spark, sf_dir):
    return vb.token_docs(_texts(spark, sf_dir), "doc_id", "text")


@query("t2_treebank_count")
def t2_treebank_count(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", tx.token_count(F.col("text")).cast("bigint").alias("n_tokens"))


@query("t7_token")
def t7_token(spark, sf_dir):
    toks = tx.valid_tokens(tx.clean_text(F.col("text")))
    return _texts(spark, sf_dir).select(
        "doc_id", F.array_join(toks, " ").alias("valid_text"), F.size(toks).cast("bigint").alias("n_valid"))


@query("f3_min_tokens")
def f3_min_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir).select("doc_id", F.size("tokens").cast("bigint").alias("n_valid"))


@query("a9_doc_freq")
def a9_doc_freq(spark, sf_dir):
    return vb.doc_freq(_tokens(spark, sf_dir))


@query("a10_doc_count")
def a10_doc_count(spark, sf_dir):
    return _tokens(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_docs"))


@query("f4_band")
def f4_band(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    n = t.count()
    return vb.doc_freq(t).filter((F.col("doc_freq") >= 10) & (F.col("doc_freq") < 0.9 * n))


@query("o1_minus_stop")
def o1_minus_stop(spark, sf_dir):
    return vb.vocabulary(_tokens(spark, sf_dir))


@query("f10_vocab_docs")
def f10_vocab_docs(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    return vb.filter_to_vocab(t, vb.vocabulary(t))


@query("j4_vocab_semi_join")
def j4_vocab_semi_join(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    v = vb.vocabulary(t)
    pos = t.select("doc_id", F.explode("tokens").alias("word"))
    return vb.in_vocab(pos, v).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_kept"))


@query("f5_nonempty_docs")
def f5_nonempty_docs(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    kept = vb.filter_to_vocab(t, vb.vocabulary(t))
    return kept.agg(F.count(F.lit(1)).alias("n_nonempty"),
                    F.count_if(F.trim("text_for_topic_modeling") == "").alias("n_blank"))


@query("a11_bow")
def a11_bow(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    return vb.bag_of_words(t, vb.vocabulary(t))


# --------------------------------------------------------------- scalar text and calendar
from ..functions import calendar as cal  # noqa: E402

LOCAL_TZ = "America/Detroit"


@query("t1_clean")
def t1_clean(spark, sf_dir):
    c = _row_local(spark, sf_dir, "conv_comments")
    return c.select("comment_id", tx.clean_text(F.col("body")).alias("clean_body"))


@query("t1_clean_docs")
def t1_clean_docs(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.clean_text(F.col("text")).alias("clean_text"))


@query("t3_links")
def t3_links(spark, sf_dir):
    c = _row_local(spark, sf_dir, "conv_comments")
    return c.select("comment_id", tx.link_count(F.col("body")).alias("n_links"))


@query("t3_links_pages")
def t3_links_pages(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", tx.link_count(F.col("url")).alias("n_links"))


@query("t4_calendar")
def t4_calendar(spark, sf_dir):
    e = _row_local(spark, sf_dir, "chain_comments")
    u = F.col("created_utc")
    return e.select("comment_id", cal.utc_hour(u).alias("hour_of_day"), cal.utc_day(u).alias("day_of_month"),
                    cal.utc_weekday(u).alias("day_of_week"))


@query("t5_hours")
def t5_hours(spark, sf_dir):
    c = _row_local(spark, sf_dir, "order_comments").filter(F.col("parent_id").isNull())
    p = _row_local(spark, sf_dir, "order_posts").select("post_id", F.col("created_utc").alias("post_utc"))
    return c.join(p, "post_id").select(
        "comment_id", cal.hours_post_to_tlc(F.col("created_utc"), F.col("post_utc")).alias("hours_diff"))


@query("t6_local")
def t6_local(spark, sf_dir):
    e = _row_local(spark, sf_dir, "chain_comments")
    h, d, w = cal.local_parts(F.col("created_utc"), LOCAL_TZ)
    return e.select("comment_id", h.alias("hour_of_day"), d.alias("day_of_month"), w.alias("day_of_week"))


@query("t8_alpha")
def t8_alpha(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", tx.alpha_words(F.col("text")).alias("alpha_text"))


@query("t9_words")
def t9_words(spark, sf_dir):
    return _texts(spark, sf_dir).select(
        "doc_id", tx.space_word_count(tx.alpha_words(F.col("text"))).alias("word_count"))


@query("t17_prefix")
def t17_prefix(spark, sf_dir):
    c = _row_local(spark, sf_dir, "conv_comments").filter(F.col("parent_id").isNotNull())
    typed = F.concat(F.lit("t1_"), F.col("parent_id"))
    return c.select("comment_id", typed.alias("typed_parent"), tx.strip_type_prefix(typed).alias("parent"))


@query("t19_concat")
def t19_concat(spark, sf_dir):
    p = _row_local(spark, sf_dir, "conv_posts")
    return p.select("post_id", tx.post_text(F.col("title"), F.col("selftext")).alias("post_text"))


# --------------------------------------------------------------- scores, pairs, subsets
from ..operators import scores as sc  # noqa: E402


def _round(df, digits=6):
    return df.select(*[F.round(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


def _lineitem_target(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_extendedprice") / 100000.0).alias("y"), (F.col("l_quantity") / 50.0).alias("p"))


@query("a14_regression_scores")
def a14_regression_scores(spark, sf_dir):
    return _round(sc.regression_scores(_lineitem_target(spark, sf_dir), "y", "p"))


@query("a17_mean_baseline")
def a17_mean_baseline(spark, sf_dir):
    return _round(sc.mean_baseline(_lineitem_target(spark, sf_dir), "y"))


def _labeled_docs(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    return read_table(spark, sf_dir, "labels").join(d, "doc_id", "inner")


@query("a15_ce")
def a15_ce(spark, sf_dir):
    d = _labeled_docs(spark, sf_dir).select(
        F.lit(0.0).alias("z0"), ((F.col("n_chars") - 1500) / 1000.0).alias("z1"), F.col("quality").alias("gold"))
    return _round(sc.classification_scores(d, ["z0", "z1"], "gold"))


def _pairs(spark, sf_dir):
    lab = read_table(spark, sf_dir, "labels")
    l = lab.select(F.col("doc_id").alias("l_id"))
    r = lab.select(F.col("doc_id").alias("r_id"), F.col("quality").alias("human_label"))
    return l.join(r, F.col("r_id") == F.col("l_id") + 1, "inner")


def _pair_rows(spark, sf_dir):
    feats = _labeled_docs(spark, sf_dir).select("doc_id", "n_chars", "quality", "toxic", "source")
    return sc.pair_features(_pairs(spark, sf_dir), feats, "doc_id")


@query("j7_pairs")
def j7_pairs(spark, sf_dir):
    return _pair_rows(spark, sf_dir)


@query("m9_rank")
def m9_rank(spark, sf_dir):
    p = _pair_rows(spark, sf_dir)
    key = F.concat(F.col("l_id").cast("string"), F.lit(":"), F.col("r_id").cast("string"))
    return p.select("l_id", "r_id", sc.rank_pair(F.col("toxic_l"), F.col("toxic_r"), key).alias("pred"))


@query("a16_pair_scores")
def a16_pair_scores(spark, sf_dir):
    ranked = m9_rank(spark, sf_dir).join(_pairs(spark, sf_dir), ["l_id", "r_id"])
    return _round(sc.pair_scores(ranked, "pred", "human_label"))


@query("t13_t14_rescale")
def t13_t14_rescale(spark, sf_dir):
    d = _labeled_docs(spark, sf_dir)
    return _round(d.select(
        "doc_id",
        sc.unit_to_signed(F.col("toxic").cast("double")).alias("gender_value"),
        sc.five_point_to_signed(1 + 4 * F.col("quality")).alias("politeness_value")))


@query("t15_toxicity")
def t15_toxicity(spark, sf_dir):
    u, t = sc.toxicity_flags(F.col("toxic").cast("double"), (1 - F.col("quality")).cast("double"))
    return read_table(spark, sf_dir, "labels").select("doc_id", u.alias("untuned_toxicity"), t.alias("tuned_toxicity"))


@query("x5_toxic_children")
def x5_toxic_children(spark, sf_dir):
    replies = tree.annotate(_t(spark, sf_dir, "order_comments")).filter(F.col("level") > 0)
    scored = oc.with_scores(replies, _t(spark, sf_dir, "order_scores"))
    out = sc.toxic_children(scored, F.col("toxicity"), F.col("attack"), ["tlc_id"])
    return _round(out.withColumnRenamed("tlc_id", "Top_comment_id"))


@query("t16_cosine")
def t16_cosine(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    a = e.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a"))
    b = e.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b"))
    j = a.join(b, F.col("b_id") == F.col("a_id") + 1)
    return _round(j.select("a_id", "b_id", sc.cosine(F.col("a"), F.col("b")).alias("cosine")))


@query("a18_moments")
def a18_moments(spark, sf_dir):
    return _round(sc.cell_moments(read_table(spark, sf_dir, "embeddings"), "embedding"))


@query("w4_subset")
def w4_subset(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return sc.random_subset(o, "o_orderkey", 1000)


@query("w5_eval_subset")
def w5_eval_subset(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    m = sc.eval_subset_size(o.count())
    return sc.random_subset(o, "o_orderkey", m)


# --------------------------------------------------------------- outcome tables and merge
from ..functions.fixed import PROSOCIAL_NEW_NAMES, PROSOCIAL_OLD_NAMES  # noqa: E402
from ..operators import merge as mg  # noqa: E402
from ..operators import outcomes as oc  # noqa: E402
from . import dynamic as dyn  # noqa: E402


def _halves(spark, sf_dir, name="conv_comments"):
    return hv.time_halves(hv.replies_with_heights(_t(spark, sf_dir, name)))


@query("x3_prosocial")
def x3_prosocial(spark, sf_dir):
    return oc.prosocial_counts(_halves(spark, sf_dir))


@query("x2_accommodation")
def x2_accommodation(spark, sf_dir):
    return _round(oc.accommodation(_halves(spark, sf_dir, "order_comments"), _t(spark, sf_dir, "order_comments")))


@query("x6_politeness_support")
def x6_politeness_support(spark, sf_dir):
    return _round(oc.politeness_support(_halves(spark, sf_dir), _t(spark, sf_dir, "conv_scores")))


@query("x7_sustained")
def x7_sustained(spark, sf_dir):
    return oc.sustained(_halves(spark, sf_dir, "order_comments"), _t(spark, sf_dir, "order_comments"))


@query("a12_dedupe")
def a12_dedupe(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return mg.dedupe(o, ["o_custkey"])


@query("p5_halves_to_rows")
def p5_halves_to_rows(spark, sf_dir):
    # a table that is wide to begin with: an order's early and late lines
    early = F.col("l_linenumber") <= 3
    sums = [F.round(F.sum(F.when(cond, F.col(c)).otherwise(0.0)), 4).alias(f"{c}_{half}_half")
            for c in ("l_quantity", "l_tax") for half, cond in (("first", early), ("second", ~early))]
    wide = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*sums)
    return mg.halves_to_rows(wide, "l_orderkey", ["l_quantity", "l_tax"])


@query("p6_rename")
def p6_rename(spark, sf_dir):
    pros = oc.prosocial_counts(_halves(spark, sf_dir)).filter(F.col("half") == 0).drop("half")
    old = pros.select(*[F.col(n).alias(o) for o, n in zip(PROSOCIAL_OLD_NAMES, PROSOCIAL_NEW_NAMES)])
    return mg.rename(old, PROSOCIAL_OLD_NAMES, PROSOCIAL_NEW_NAMES)


@query("p7_outcomes")
def p7_outcomes(spark, sf_dir):
    return _round(dyn.merged_outcomes(_t(spark, sf_dir, "conv_comments"), _t(spark, sf_dir, "conv_scores")))


@query("j3_merge")
def j3_merge(spark, sf_dir):
    return _round(dyn.half_outcomes(_t(spark, sf_dir, "order_comments"), _t(spark, sf_dir, "order_scores")))


@query("j3_sampled_merge")
def j3_sampled_merge(spark, sf_dir):
    return _round(dyn.sampled_outcomes(_t(spark, sf_dir, "order_comments"), _t(spark, sf_dir, "order_scores")))


@query("a6_half_features_orders")
def a6_half_features_orders(spark, sf_dir):
    return hv.fixed_half_features(_halves(spark, sf_dir, "order_comments"))


# --------------------------------------------------------------- categories and sequences
from ..operators import category as cg  # noqa: E402
from ..operators import sequences as sq  # noqa: E402
from ..functions.fixed import MIN_VALID_TOKENS  # noqa: E402
from ..operators.indexing import global_index  # noqa: E402


def _part_dict(spark, sf_dir):
    return cg.category_ids(read_table(spark, sf_dir, "part"), "p_type")


@query("a13_vocab_ids")
def a13_vocab_ids(spark, sf_dir):
    return _part_dict(spark, sf_dir)


@query("a21_id_check")
def a21_id_check(spark, sf_dir):
    return cg.id_check(_part_dict(spark, sf_dir))


@query("j5_lookup")
def j5_lookup(spark, sf_dir):
    # source and language pairs looked up in the dictionary of the pairs that have
    # a toxic label: the other pairs are unknown names
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    known = docs.join(labels.filter(F.col("toxic") == 1).select("doc_id"), "doc_id", "left_semi")
    names = docs.select("doc_id", F.concat_ws("/", "source", "lang").alias("name"))
    dictionary = cg.category_ids(known.select(F.concat_ws("/", "source", "lang").alias("name")), "name")
    return cg.lookup(names, "name", dictionary).select("doc_id", "category_id")


def _cat_cells(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    m = sc.cell_moments(emb, "embedding").first()
    d = _part_dict(spark, sf_dir)
    return cg.category_vectors(d, emb, "vec_id", "embedding", 64, round(m["mean"], 6), round(m["std"], 6))


@query("j6_embedding_fill")
def j6_embedding_fill(spark, sf_dir):
    return _round(_cat_cells(spark, sf_dir), 4)


@query("t18_blend")
def t18_blend(spark, sf_dir):
    return _round(cg.blend_with_generic(_cat_cells(spark, sf_dir)), 4)


def _all_tokens(spark, sf_dir):
    return vb.all_token_docs(_texts(spark, sf_dir), "doc_id", "text")


def _encoded(spark, sf_dir):
    """Every document's ids; the vocabulary comes from documents that pass F3."""
    t = _all_tokens(spark, sf_dir)
    vocab = vb.vocabulary(t.filter(F.size("tokens") > MIN_VALID_TOKENS))
    idx = sq.word_ids(global_index(vocab.select("word"), ["word"], "word_id"))
    return sq.encode(t, idx), idx


@query("t20_pad")
def t20_pad(spark, sf_dir):
    enc, _ = _encoded(spark, sf_dir)
    ids, mask = sq.pad_truncate(F.col("ids"))
    return enc.select("doc_id", F.array_join(ids, " ").alias("input_ids"),
                      F.aggregate(mask, F.lit(0), lambda a, b: a + b).cast("bigint").alias("n_real"))


@query("t20_post_tlc")
def t20_post_tlc(spark, sf_dir):
    """Post and TLC texts as fixed-length ids over the documents' vocabulary:
    one row per TLC with both sequences."""
    vocab = vb.vocabulary(_tokens(spark, sf_dir))
    idx = sq.word_ids(global_index(vocab.select("word"), ["word"], "word_id"))
    c = _t(spark, sf_dir, "conv_comments").filter(F.col("parent_id").isNull())
    p = _t(spark, sf_dir, "conv_posts").select("post_id", tx.post_text(F.col("title"), F.col("selftext")).alias("text"))

    def padded(texts, key, name):
        enc = sq.encode(vb.all_token_docs(texts, key, "text"), idx)
        return enc.select(F.col("doc_id").alias(key), F.array_join(sq.pad_truncate(F.col("ids"))[0], " ").alias(name))

    return (c.select("post_id", "comment_id")
            .join(padded(c.select("comment_id", F.col("body").alias("text")), "comment_id", "tlc_ids"), "comment_id")
            .join(padded(p, "post_id", "post_ids"), "post_id"))


@query("m11_mask")
def m11_mask(spark, sf_dir):
    enc, idx = _encoded(spark, sf_dir)
    ids, _ = sq.pad_truncate(F.col("ids"))
    inputs, labels = sq.mask_tokens(F.col("doc_id"), ids, idx.count())
    return enc.select("doc_id", F.array_join(inputs, " ").alias("input_ids"),
                      F.array_join(labels, " ").alias("labels"))


@query("o2_union")
def o2_union(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("origin"), F.col("doc_id").alias("item_id"), "text")
    b = read_table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("origin"), "item_id", "text")
    return d.unionByName(b).select("origin", "item_id", F.length("text").cast("bigint").alias("n_chars"))


# --------------------------------------------------------------- language and text scores
from ..functions.fixed import STOP_WORDS  # noqa: E402
from ..operators import textscores as ts  # noqa: E402


def _span_langs(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    prof = lg.train_profiles(docs, "text", "lang")
    return lg.span_languages(docs, "doc_id", "text", prof)


@query("t10_span_language")
def t10_span_language(spark, sf_dir):
    return _span_langs(spark, sf_dir)


@query("a19_language_share")
def a19_language_share(spark, sf_dir):
    return _round(lg.language_shares(_span_langs(spark, sf_dir)))


@query("f1_english")
def f1_english(spark, sf_dir):
    return lg.english_flags(_docs(spark, sf_dir), "doc_id", _span_langs(spark, sf_dir))


@query("f2_split")
def f2_split(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    flags = materialize(lg.english_flags(docs, "doc_id", _span_langs(spark, sf_dir)), "english")   # one detection pass
    en, other = lg.split_by_language(docs.select("doc_id", "n_chars"), "doc_id", flags)

    def summary(df, flag):
        return df.agg(F.lit(flag).alias("is_english"), F.count(F.lit(1)).cast("bigint").alias("n_docs"),
                      F.sum("n_chars").cast("bigint").alias("n_chars"))
    return summary(en, True).unionByName(summary(other, False))


@query("t11_sentiment")
def t11_sentiment(spark, sf_dir):
    scored = ts.with_sentiment(_texts(spark, sf_dir), tx.clean_text(F.col("text")), "Top_comment_polarity",
                               "Top_comment_subjectivity")
    return _round(scored.select("doc_id", "Top_comment_polarity", "Top_comment_subjectivity"))


@query("t12_readability")
def t12_readability(spark, sf_dir):
    return _round(_texts(spark, sf_dir).select("doc_id", ts.readability(tx.clean_text(F.col("text"))).alias("Top_comment_readability")))


@query("a20_misspelling")
def a20_misspelling(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    dic = vb.vocabulary(t).select("word").unionByName(vb.stop_words(spark))
    return _round(ts.misspelling_ratio(_texts(spark, sf_dir), "doc_id", "text", dic))


@query("x1_jaccard")
def x1_jaccard(spark, sf_dir):
    c = _row_local(spark, sf_dir, "conv_comments").filter(F.col("parent_id").isNull())
    p = _row_local(spark, sf_dir, "conv_posts")
    j = c.join(p.select("post_id", "title", "selftext"), "post_id")
    a = tx.valid_tokens(tx.clean_text(tx.post_text(F.col("title"), F.col("selftext"))))
    b = tx.valid_tokens(tx.clean_text(F.col("body")))
    return _round(j.select(F.col("comment_id").alias("Top_comment_id"), ts.jaccard(a, b).alias("Post_Top_comment_Jaccard_sim")))


# --------------------------------------------------------------- machine learning
from ..operators import ml  # noqa: E402
from ..operators import topics as tp  # noqa: E402


def _order_features(spark, sf_dir):
    """Per-order features from its lines and a learnable target."""
    li = (read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
          .agg(F.count(F.lit(1)).cast("double").alias("n_lines"), F.sum("l_quantity").alias("sum_qty"),
               F.avg("l_discount").alias("avg_disc"), F.avg("l_tax").alias("avg_tax")))
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    j = o.join(li, o["o_orderkey"] == li["l_orderkey"]).drop("l_orderkey")
    return j.select("o_orderkey", "n_lines", "sum_qty", "avg_disc", "avg_tax",
                    (F.col("sum_qty") / 10.0).alias("x1"),
                    ((F.col("sum_qty") + F.col("n_lines") * 5) / 10.0 + F.col("avg_disc")).alias("x2"),
                    (F.col("sum_qty") / 10.0 + 50 * F.col("avg_disc") + F.col("o_totalprice") / 100000.0).alias("y"),
                    F.conv(F.substring(F.md5(F.concat(F.lit("42:"), F.col("o_orderkey").cast("string"))), 1, 1), 16, 10)
                    .cast("int").alias("bucket"))


def _pca2(spark, sf_dir):
    f = _order_features(spark, sf_dir)
    return f, ml.fit_pca(f, ["x1", "x2"], 2)


@query("m3_pca_ratio")
def m3_pca_ratio(spark, sf_dir):
    _, p = _pca2(spark, sf_dir)
    return _round(p.ratio_table(spark))


@query("w6_top_components")
def w6_top_components(spark, sf_dir):
    _, p = _pca2(spark, sf_dir)
    return _round(ml.top_components(p.ratio_table(spark)))


@query("m5_project")
def m5_project(spark, sf_dir):
    f, p = _pca2(spark, sf_dir)
    return _round(p.transform(f, "o_orderkey"))


@query("m4_loadings")
def m4_loadings(spark, sf_dir):
    f, p = _pca2(spark, sf_dir)
    return _round(p.loadings(p.transform(f, "o_orderkey")))


@query("m6_embedding_pca")
def m6_embedding_pca(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    cols = [f"e{i}" for i in range(64)]
    wide = e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)])
    p = ml.fit_pca(wide, cols, 16)
    return _round(p.transform(wide, "vec_id"), 4)


@query("m6_embedding_facts")
def m6_embedding_facts(spark, sf_dir):
    """Facts of the 16 principal scores of the embeddings."""
    s = materialize(m6_embedding_pca(spark, sf_dir), "pc")
    pcs = [f"PC{j}" for j in range(16)]
    pairs = [(a, b) for i, a in enumerate(pcs) for b in pcs[i + 1:]]
    return s.agg(F.count(F.lit(1)).alias("n_rows"),
                 (F.greatest(*[F.abs(F.avg(c)) for c in pcs]) < 1e-3).alias("centred"),
                 (F.greatest(*[F.abs(F.covar_samp(a, b)) for a, b in pairs]) < 1e-3).alias("uncorrelated"),
                 (F.greatest(*[F.var_samp(b) - F.var_samp(a) for a, b in zip(pcs, pcs[1:])]) < 1e-3).alias("descending"))


def _topic_model(spark, sf_dir):
    """The documents' tokens and the model of their vocabulary."""
    docs = _tokens(spark, sf_dir)
    return docs, tp.fit(docs, "doc_id", "tokens", vb.vocabulary(docs))


def _strongest(model, n):
    """The ``n`` strongest words of every topic with their place, from 0."""
    order = Window.partitionBy("topic").orderBy(F.desc("weight"), "word")
    return model.shares().withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < n)


@query("m1_topics")
def m1_topics(spark, sf_dir):
    """Facts of the fitted topics: each is a distribution over the vocabulary
    (its weights add up to 1) with its 20 top terms in falling order."""
    _, model = _topic_model(spark, sf_dir)
    facts = model.shares().groupBy("topic").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("weight"), 6).alias("weight_sum"))
    after = F.lead("weight").over(Window.partitionBy("topic").orderBy("place"))
    falls = (_strongest(model, 20).withColumn("_next", after).groupBy("topic")
             .agg(F.every(F.coalesce(F.col("weight") >= F.col("_next"), F.lit(True))).alias("falling")))
    return facts.join(falls, "topic").select("topic", "n_terms", "weight_sum", "falling")


@query("m1_topic_terms")
def m1_topic_terms(spark, sf_dir):
    """The 20 strongest terms of each topic with their weights."""
    return _round(_strongest(_topic_model(spark, sf_dir)[1], 20).select(
        "topic", F.col("place").cast("int").alias("place"), F.col("word").alias("term"), "weight"))


@query("m1_word_mass")
def m1_word_mass(spark, sf_dir):
    """The expected counts of every word summed over the topics: its count in
    the corpus, as every occurrence is shared out whole in every round."""
    _, model = _topic_model(spark, sf_dir)
    mass = F.aggregate("vec", F.lit(0.0), lambda a, x: a + (x.cast("double") - model.eta))
    return model.weights.select("word", F.round(mass).cast("bigint").alias("n_tokens"))


@query("m2_topic_vectors")
def m2_topic_vectors(spark, sf_dir):
    """One vector per document, null for a document without a vocabulary word."""
    found = pr.topic_tables(_docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "text"))
    return _round(found.select(F.col("id").cast("bigint").alias("doc_id"),
                               *[F.get("topics", F.lit(i)).alias(f"Top_comment_topic{i}") for i in range(19)]), 4)


@query("m2_topic_facts")
def m2_topic_facts(spark, sf_dir):
    """Per document that the model learns from: its vector has 20 shares, none
    negative, that add up to 1; null without a vocabulary word."""
    docs, model = _topic_model(spark, sf_dir)
    got = tp.infer(model, docs, "doc_id", "tokens")
    return got.select("doc_id", F.array_size("topics").cast("bigint").alias("n_topics"),
                      F.forall("topics", lambda x: x >= 0).alias("not_negative"),
                      F.round(F.aggregate("topics", F.lit(0.0), lambda a, x: a + x), 6).alias("share_sum"))


def _gbt(spark, sf_dir):
    f = _order_features(spark, sf_dir).withColumn("is_valid", F.col("bucket") == 1)
    train = f.filter(F.col("bucket") >= 1)
    model = ml.fit_gbt(train, ["n_lines", "sum_qty", "avg_disc", "avg_tax"], "y", "is_valid", max_iter=30)
    return model.transform(f).withColumn("held_out", F.col("bucket") == 0)


@query("m7_gbt")
def m7_gbt(spark, sf_dir):
    """A prediction for every order; scores are taken over the held-out ones."""
    return _round(_gbt(spark, sf_dir).select("o_orderkey", "prediction", "held_out"), 4)


@query("m7_gbt_scores")
def m7_gbt_scores(spark, sf_dir):
    return _round(sc.regression_scores(_gbt(spark, sf_dir).filter("held_out"), "y", "prediction"), 4)


@query("m7_gbt_facts")
def m7_gbt_facts(spark, sf_dir):
    """On unseen rows the boosted trees explain more than the mean does."""
    scored = materialize(_gbt(spark, sf_dir).filter("held_out").select("y", "prediction"), "gbt")
    r = sc.regression_scores(scored, "y", "prediction")
    m = sc.mean_baseline(scored, "y").select(F.col("r2").alias("base"))
    return r.join(m).select("n", (F.col("r2") > F.col("base") + 0.5).alias("beats_mean"))    # one row each


BOOSTING = bo.Params(rounds=12, step=0.4)      # the other settings are the reference's
ORDER_FEATURES = ["n_lines", "sum_qty", "avg_disc", "avg_tax"]


def _boosted(spark, sf_dir):
    f = materialize(_order_features(spark, sf_dir), "order-features")
    train = f.filter(F.col("bucket") >= 1).withColumn("is_valid", F.col("bucket") == 1)
    x = bo.feature_array(ORDER_FEATURES)
    model = bo.fit(train, "o_orderkey", x, len(ORDER_FEATURES), "y", "is_valid", BOOSTING)
    return f.select("o_orderkey", "y", model.predict(x).alias("prediction"), (F.col("bucket") == 0).alias("held_out"))


@query("m7_boosting")
def m7_boosting(spark, sf_dir):
    """Second-order boosted trees with l1 and l2 terms: a prediction for every
    order; the held-out ones take no part in the training or the early stop."""
    return _round(_boosted(spark, sf_dir).select("o_orderkey", "prediction", "held_out"), 4)


@query("m7_boosting_facts")
def m7_boosting_facts(spark, sf_dir):
    """On unseen rows the second-order trees explain more than the mean does."""
    scored = materialize(_boosted(spark, sf_dir).filter("held_out").select("y", "prediction"), "boosted")
    r = sc.regression_scores(scored, "y", "prediction")
    m = sc.mean_baseline(scored, "y").select(F.col("r2").alias("base"))
    return r.join(m).select("n", (F.col("r2") > F.col("base") + 0.5).alias("beats_mean"))    # one row each


def _linear(spark, sf_dir):
    f = _order_features(spark, sf_dir)
    return f, ml.fit_linear(f, ["sum_qty"], "y")


@query("m8_linear")
def m8_linear(spark, sf_dir):
    _, m = _linear(spark, sf_dir)
    lr = m.stages[-1]
    return _round(spark.createDataFrame([(float(lr.coefficients[0]), float(lr.intercept))],
                                        "coefficient double, intercept double"))


@query("m12_batch_inference")
def m12_batch_inference(spark, sf_dir):
    f, m = _linear(spark, sf_dir)
    return _round(m.transform(f).select("o_orderkey", "prediction"))


@query("m13_model_roundtrip")
def m13_model_roundtrip(spark, sf_dir):
    f, m = _linear(spark, sf_dir)
    path, _meta = ml.save_with_params(m, spark, {"features": "sum_qty", "label": "y"}, seed=42)
    return _round(ml.load(path).transform(f).select("o_orderkey", "prediction"))


@query("m10_pair_classifier")
def m10_pair_classifier(spark, sf_dir):
    p = _pair_rows(spark, sf_dir).withColumn("human_label", F.col("human_label").cast("double"))
    held = F.crc32(F.col("r_id").cast("string")) % 4 == 2
    model = ml.fit_pair_classifier(p.filter(~held), ["n_chars", "toxic"], "human_label")
    return model.transform(p).select("l_id", "r_id", F.col("prediction").cast("int").alias("pred"), held.alias("held_out"))


@query("x8_ngrams")
def x8_ngrams(spark, sf_dir):
    v = ml.ngram_vectors(_all_tokens(spark, sf_dir), "tokens")
    return v.select("doc_id", F.size(F.col("tokens")).alias("n_tokens"),
                    F.aggregate(vector_to_array_safe("unigrams"), F.lit(0.0), lambda a, b: a + b).alias("unigram_mass"),
                    F.aggregate(vector_to_array_safe("bigrams"), F.lit(0.0), lambda a, b: a + b).alias("bigram_mass"))


def vector_to_array_safe(c):
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(F.col(c))


# --------------------------------------------------------------- sources and sinks
import os as _os  # noqa: E402
import uuid as _uuid  # noqa: E402

from ..session import ensure_checkpoint_dir  # noqa: E402
from ..sources import files as fs  # noqa: E402
from ..sources import jsonl  # noqa: E402


def _scratch(spark, name):
    return _os.path.join(ensure_checkpoint_dir(spark), f"tm-{name}-{_uuid.uuid4().hex}")


def _json_roundtrip(spark, sf_dir):
    path = _scratch(spark, "threads-json")
    jsonl.write_threads(_t(spark, sf_dir, "conv_posts"), _t(spark, sf_dir, "conv_comments"), path)
    return jsonl.read_threads(spark, path)


@query("s1_json_ingest")
def s1_json_ingest(spark, sf_dir):
    _, comments = _json_roundtrip(spark, sf_dir)
    return comments


@query("s1_json_posts")
def s1_json_posts(spark, sf_dir):
    posts, _ = _json_roundtrip(spark, sf_dir)
    return posts


@query("s2_s4_tsv_roundtrip")
def s2_s4_tsv_roundtrip(spark, sf_dir):
    df = p2_basic_features(spark, sf_dir)
    path = _scratch(spark, "features-tsv")
    fs.write_tsv(df, path)
    schema = ", ".join(f"{c} {t}" for c, t in sorted(df.dtypes))
    return fs.read_tsv(spark, path, schema)


@query("s9_embedding_csv")
def s9_embedding_csv(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    path = _scratch(spark, "embeddings-csv")
    fs.write_embedding_csv(e, "vec_id", "embedding", 64, path)
    back = fs.read_embedding_csv(spark, path, 64)
    return _round(back.select("name", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
                              .alias("cell_sum")), 4)


@query("s7_category_dict")
def s7_category_dict(spark, sf_dir):
    d = _part_dict(spark, sf_dir)
    path = _scratch(spark, "category-json")
    fs.write_category_dict(d, path)
    return fs.read_category_dict(spark, path)


@query("s11_replace_labels")
def s11_replace_labels(spark, sf_dir):
    """New labels laid over a stored data set, written as its next version."""
    base = _scratch(spark, "datasets")
    ds = fs.save_dataset(_pair_rows(spark, sf_dir), base, "pairs", "1")
    lab = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("r_id"), F.col("toxic").alias("human_label"))
    newer = fs.save_dataset(fs.replace_labels(ds, lab, "r_id", "human_label"), base, "pairs", "2")
    return newer.select("l_id", "r_id", "human_label", "n_chars_l", "n_chars_r")


@query("s6_word_list")
def s6_word_list(spark, sf_dir):
    """A word list written from a table, one word per line, and read back."""
    path = _scratch(spark, "words")
    read_table(spark, sf_dir, "part").select(
        F.concat(F.lit(" "), F.lower("p_name"), F.lit("  ")).alias("value")).distinct().write.mode("overwrite").text(path)
    return fs.read_word_list(spark, path)


@query("s8_columns")
def s8_columns(spark, sf_dir):
    """Two columns of a wide stored table: only they are read."""
    path = _scratch(spark, "wide")
    read_table(spark, sf_dir, "lineitem").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).groupBy("l_returnflag").agg(F.sum("l_linenumber").alias("n_lines"))


@query("s10_reuse")
def s10_reuse(spark, sf_dir):
    """A version that is there is read, not built again."""
    base = _scratch(spark, "datasets")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    fs.load_or_build(spark, base, "orders", "1", lambda: orders.filter(F.col("o_orderstatus") == "F"))
    return fs.load_or_build(spark, base, "orders", "1", lambda: orders)


@query("s12_combine")
def s12_combine(spark, sf_dir):
    """Training files of several sources, written apart and combined."""
    parts = []
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    for name, rows in (("first", docs.filter(F.col("lang") == "en")), ("second", docs.filter(F.col("lang") != "en"))):
        path = _scratch(spark, f"training-{name}")
        fs.write_tsv(rows, path)
        parts.append(fs.read_tsv(spark, path, "doc_id bigint, lang string, n_chars bigint"))
    return fs.union_all(parts)


@query("t21_vector")
def t21_vector(spark, sf_dir):
    """Numeric columns of a table assembled into one vector per row."""
    from pyspark.ml.feature import VectorAssembler
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_quantity", "l_discount", F.col("l_partkey").cast("double").alias("l_partkey"))
    v = VectorAssembler(inputCols=["l_quantity", "l_discount", "l_partkey"], outputCol="v").transform(li)
    a = vector_to_array_safe("v")
    return v.groupBy("l_orderkey").agg(F.sum(a[0]).alias("quantity"), F.round(F.sum(a[1]), 6).alias("discount"),
                                       F.max(F.size(a)).cast("bigint").alias("width"))


# --------------------------------------------------------------- outcome metrics to PC0 to models
from ..functions.fixed import OUTCOME_METRICS  # noqa: E402
from . import product as pr  # noqa: E402

GBT_FEATURES = ["Top_comment_and_Post_time_difference", "Top_comment_day", "Top_comment_day_of_week", "Top_comment_hour",
                "Top_comment_link_count", "Top_comment_score", "Top_comment_informative_count", "Top_comment_advice_count",
                "Top_comment_laughter_count", "Top_comment_gratitude_count", "Top_comment_i_language_count",
                "Top_comment_compliments_count", "Top_comment_informative_URL_count", "Top_comment_readability",
                "Top_comment_polarity", "Top_comment_word_count"]


def _metric_pca(spark, sf_dir):
    comments, scores = _t(spark, sf_dir, "order_comments"), _t(spark, sf_dir, "order_scores")
    found = pr.metric_pca(comments, scores)
    release(comments)
    release(scores)
    return found


@query("m5_metric_scores")
def m5_metric_scores(spark, sf_dir):
    """Facts that hold for principal scores of the 26 outcome metrics: mean 0,
    no covariance, variances in descending order that add up to the metrics'."""
    rows, p = _metric_pca(spark, sf_dir)
    s = materialize(p.transform(rows, "id"), "pc")
    pcs = [f"PC{j}" for j in range(len(OUTCOME_METRICS))]
    pairs = [(a, b) for i, a in enumerate(pcs) for b in pcs[i + 1:]]
    facts = s.agg(F.count(F.lit(1)).alias("n"), F.greatest(*[F.abs(F.avg(c)) for c in pcs]).alias("mean"),
                  F.greatest(*[F.abs(F.covar_samp(a, b)) for a, b in pairs]).alias("cov"),
                  sum([F.var_samp(c) for c in pcs], F.lit(0.0)).alias("total"),
                  F.greatest(*[F.var_samp(b) - F.var_samp(a) for a, b in zip(pcs, pcs[1:])]).alias("rise"))
    return facts.select(F.col("n").alias("n_rows"), (F.col("mean") < 1e-6).alias("centred"),
                        (F.col("cov") < 1e-4).alias("uncorrelated"), (F.col("rise") < 1e-6).alias("descending"),
                        F.round("total", 3).alias("total_variance"))


@query("m3_metric_ratio")
def m3_metric_ratio(spark, sf_dir):
    """Explained-variance ratios of the 26 components: their number and sum."""
    _, p = _metric_pca(spark, sf_dir)
    r = p.ratio_table(spark)
    return r.agg(F.count(F.lit(1)).alias("n_components"), F.round(F.sum("explained_variance_ratio"), 6).alias("ratio_sum"))


@query("m4_metric_loadings")
def m4_metric_loadings(spark, sf_dir):
    """The squared loadings of a metric over all components add up to its variance."""
    rows, p = _metric_pca(spark, sf_dir)
    load = p.loadings(p.transform(rows, "id"))
    return load.groupBy("feature").agg(F.round(F.sum(F.col("loading") * F.col("loading")), 3).alias("variance"))


@query("m3_metric_ratio_rows")
def m3_metric_ratio_rows(spark, sf_dir):
    """Explained-variance ratio of each of the 26 components."""
    _, p = _metric_pca(spark, sf_dir)
    return _round(p.ratio_table(spark))


@query("m4_metric_loading_rows")
def m4_metric_loading_rows(spark, sf_dir):
    """Loading of each metric on each component."""
    rows, p = _metric_pca(spark, sf_dir)
    return _round(p.loadings(p.transform(rows, "id")))


@query("m5_metric_score_rows")
def m5_metric_score_rows(spark, sf_dir):
    """All 26 component scores of every id."""
    rows, p = _metric_pca(spark, sf_dir)
    return _round(p.transform(rows, "id"))


def _pc0_table(spark, sf_dir):
    tables = [_t(spark, sf_dir, n) for n in ("order_comments", "order_posts", "order_scores")]
    t = materialize(pr.training_table(*tables, GBT_FEATURES), "training")
    for used in tables:
        release(used)
    return t


@query("end_to_end_pc0")
def end_to_end_pc0(spark, sf_dir):
    """Boosted trees on the feature row predict PC0 of every TLC; the held-out
    ones take no part in the training."""
    t = _pc0_table(spark, sf_dir).withColumn("is_valid", F.col("bucket") == 1)
    model = ml.fit_gbt(t.filter(F.col("bucket") >= 1), GBT_FEATURES, "PC0", "is_valid", max_iter=20)
    return _round(model.transform(t).select("Top_comment_id", "PC0", "prediction", (F.col("bucket") == 0).alias("held_out")), 4)


@query("end_to_end_boosting")
def end_to_end_boosting(spark, sf_dir):
    """Second-order boosted trees on the whole feature row (65 features, 1,000
    unigrams and 1,000 bigrams) predict PC0 of every top-level comment."""
    names = ("conv_comments", "conv_posts", "conv_scores")
    comments, posts, scores = (_t(spark, sf_dir, n) for n in names)
    rows, pca = pr.metric_pca(comments, scores)
    table = materialize(pr.full_features(comments, posts, scores).join(pr.pc0(rows, pca), "Top_comment_id"), "full-features")
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit("42:"), "Top_comment_id")), 1, 1), 16, 10).cast("int")
    table = table.withColumns({"is_valid": bucket == 1, "held_out": bucket == 0})
    model = bo.fit(table.filter(~F.col("held_out")), "Top_comment_id", F.col("x"), pr.FULL_WIDTH, "PC0", "is_valid")
    return _round(table.select("Top_comment_id", "PC0", model.predict(F.col("x")).alias("prediction"), "held_out"), 4)


@query("m8_loaded_coefficients")
def m8_loaded_coefficients(spark, sf_dir):
    """A linear model's coefficients written as one CSV row, loaded and applied
    by name; a feature without a coefficient counts 0."""
    f, m = _linear(spark, sf_dir)
    lr = m.stages[-1]
    path = _scratch(spark, "coefficients")
    spark.createDataFrame([(float(lr.coefficients[0]), 7.0)], "sum_qty double, not_a_column double").write.mode(
        "overwrite").csv(path, header=True)
    coef = ml.read_coefficients(spark, path)
    scored = ml.score_with_coefficients(f.select("o_orderkey", "sum_qty", "n_lines"), coef, float(lr.intercept))
    return _round(scored.select("o_orderkey", "score"))


@query("model_features")
def model_features(spark, sf_dir):
    """The 65 numeric model features of every TLC."""
    c = _t(spark, sf_dir, "conv_comments")
    authors = c.groupBy("author").agg(F.avg(F.when(F.col("score") > 0, 1.0).otherwise(0.0)).alias("gender"),
                                      F.avg(F.when(F.col("body").contains("http"), 1.0).otherwise(0.0)).alias("agreement"))
    docs = _tokens(spark, sf_dir)
    words = vb.vocabulary(docs).select("word").unionByName(vb.stop_words(spark))
    return _round(pr.model_features(c, _t(spark, sf_dir, "conv_posts"), _t(spark, sf_dir, "conv_scores"), authors, words), 4)


# --------------------------------------------------------------- remaining small ids
@query("f8_half_select")
def f8_half_select(spark, sf_dir):
    h = _halves(spark, sf_dir)
    return h.filter(F.col("half") == 0).select(F.col("tlc_id").alias("Top_comment_id"), "comment_id")


@query("p4_flatten")
def p4_flatten(spark, sf_dir):
    f = tree.flatten_post_order(_t(spark, sf_dir, "bushy_comments"))
    return f.filter(F.col("level") > 0).select(F.col("tlc_id").alias("Top_comment_id"), "comment_id", "level",
                                               F.col("height").cast("bigint").alias("height"))
