"""Thread tables derived from the driver's tables.

The driver's tables hold no reply trees, so threads are derived by pure SQL
that runs unchanged in Spark and in DuckDB (the oracle engine). Every
derived comment table has the canonical columns::

    post_id, comment_id, parent_id (NULL for a top-level comment),
    sibling_ord, subreddit, subreddit_id, author, score (nullable),
    created_utc (epoch seconds), body

Posts have ``post_id, subreddit, author, score, created_utc, title, selftext``.

The same text is used by the Spark side (``spark.sql`` with DataFrame
arguments, no global views) and by the oracle SQL (plain table names).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import read_table

SPARK = "spark"
DUCKDB = "duckdb"


def epoch_seconds(expr: str, dialect: str) -> str:
    """Epoch seconds of a TIMESTAMP_NTZ column as BIGINT."""
    if dialect == SPARK:
        return f"cast(unix_timestamp({expr}) as bigint)"
    return f"cast(floor(epoch({expr})) as bigint)"


# ---------------------------------------------------------------- templates
# ``{t}`` is replaced by the table reference of the dialect.

def conv_posts_sql(dialect: str) -> str:
    t = "{conversations}" if dialect == SPARK else "conversations"
    return f"""
select cast(conv_id as string) post_id, concat('sub', cast(conv_id % 5 as string)) subreddit,
  concat('u', cast(conv_id % 7 as string)) author,
  case when conv_id % 17 = 0 then null else cast(conv_id % 11 - 3 as int) end score,
  cast(1704067200 + conv_id * 86399 as bigint) created_utc, substr(text, 1, 40) title, text selftext
from {t} where turn = 0"""


def conv_comments_sql(dialect: str) -> str:
    t = "{conversations}" if dialect == SPARK else "conversations"
    return f"""
select cast(conv_id as string) post_id, concat(cast(conv_id as string), '_', cast(turn as string)) comment_id,
  case when turn <= 2 then null else concat(cast(conv_id as string), '_', cast(cast(floor((turn - 1) / 2) as bigint) as string)) end parent_id,
  cast(turn - 1 as int) sibling_ord, concat('sub', cast(conv_id % 5 as string)) subreddit, concat('t5_', cast(conv_id % 5 as string)) subreddit_id,
  concat('u', cast(length(text) % 2 as string)) author,
  case when (conv_id + turn) % 17 = 0 then null else cast((conv_id * 7 + turn * 13) % 11 - 3 as int) end score,
  cast(1704067200 + conv_id * 86399 + turn * 3607 as bigint) created_utc,
  concat(text, case when (conv_id + turn) % 3 = 0 then ' see [the source](http://a.example.com/x?y=1) and https://b.example.org/z#t' else '' end) body
from {t} where turn >= 1"""


def _event_threads_sql(dialect: str, parent_case: str) -> str:
    t = "{events}" if dialect == SPARK else "events"
    return f"""
select cast(user_id as string) post_id, concat(cast(user_id as string), '_', cast(n as string)) comment_id,
  {parent_case} parent_id,
  cast(n - 1 as int) sibling_ord, concat('sub', cast(user_id % 5 as string)) subreddit,
  concat('t5_', cast(user_id % 5 as string)) subreddit_id, concat('u', cast(event_id % 7 as string)) author,
  cast(floor(value) as int) score, {epoch_seconds('ts', dialect)} created_utc,
  case when event_id % 4 = 0 then concat(event_type, ' at http://e.example.com/', cast(event_id as string)) else event_type end body
from (select *, row_number() over (partition by user_id order by ts, event_id) n from {t})"""


def chain_comments_sql(dialect: str) -> str:
    return _event_threads_sql(dialect, "case when n <= 1 then null else concat(cast(user_id as string), '_', cast(n - 1 as string)) end")


def bushy_comments_sql(dialect: str) -> str:
    return _event_threads_sql(dialect, "case when n <= 3 then null else concat(cast(user_id as string), '_', cast(n - 1 - event_id % 3 as string)) end")


# Reply texts of the order threads: a phrase picked by the line's part, so that
# every marker and link kind of the outcome metrics occurs.
PHRASES = ["thanks, a great and nice study with the research", "maybe you should try to look, but i never did",
           "lol that is always so, or not", "all of this would be good, i guess",
           "no, it is the source of everything", "and the", "i appreciate it, but without proof",
           "perhaps some of these hope to include both", "nobody said that http://en.wikipedia.org/wiki/X",
           "definitely the most, although except one"]


def _phrase(key: str) -> str:
    whens = " ".join(f"when {i} then '{p}'" for i, p in enumerate(PHRASES))
    return f"case {key} % {len(PHRASES) + 1} {whens} else concat(l_returnflag, ' ', l_linestatus) end"


_LINES = """(select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity,
        l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) n from {t})"""


def order_scores_sql(dialect: str) -> str:
    """Scores of order comments: the labels of the line's part, where it has any."""
    t, lab = ("{lineitem}", "{labels}") if dialect == SPARK else ("lineitem", "labels")
    return f"""
select cast(l_orderkey as string) post_id, concat(cast(l_orderkey as string), '_', cast(n as string)) comment_id,
  cast(1 + 4 * quality as double) politeness, cast(1 + 2 * quality + 2 * (1 - toxic) as double) support,
  cast(toxic as double) toxicity, cast(1 - quality as double) attack
from {_LINES.format(t=t)} l join {lab} s on s.doc_id = l.l_partkey"""


def conv_scores_sql(dialect: str) -> str:
    """Scores of conversation comments: the labels of a document picked by conversation and turn."""
    t, lab = ("{conversations}", "{labels}") if dialect == SPARK else ("conversations", "labels")
    return f"""
select cast(conv_id as string) post_id, concat(cast(conv_id as string), '_', cast(turn as string)) comment_id,
  cast(1 + 4 * quality as double) politeness, cast(1 + 2 * quality + 2 * (1 - toxic) as double) support,
  cast(toxic as double) toxicity, cast(1 - quality as double) attack
from {t} c join {lab} s on s.doc_id = c.conv_id * 8 + c.turn where turn >= 1"""


def order_comments_sql(dialect: str) -> str:
    t = "{lineitem}" if dialect == SPARK else "lineitem"
    return f"""
select cast(l_orderkey as string) post_id, concat(cast(l_orderkey as string), '_', cast(n as string)) comment_id,
  case when n <= 2 then null else concat(cast(l_orderkey as string), '_', cast(cast(floor((n - 1) / 2) as bigint) as string)) end parent_id,
  cast(n - 1 as int) sibling_ord, concat('cat', cast(l_suppkey % 20 as string)) subreddit,
  concat('t5_', cast(l_suppkey % 20 as string)) subreddit_id, concat('p', cast(l_partkey % 3 as string)) author,
  cast(floor(l_quantity) as int) score, {epoch_seconds('l_shipdate', dialect)} created_utc,
  case when l_linenumber % 3 = 0 then concat('see http://x.example.com/', cast(l_partkey as string), ' and https://y.example.org/', cast(l_suppkey as string))
       else {_phrase('l_partkey')} end body
from {_LINES.format(t=t)}"""


def order_posts_sql(dialect: str) -> str:
    t = "{orders}" if dialect == SPARK else "orders"
    return f"""
select cast(o_orderkey as string) post_id, concat('cat', cast(o_custkey % 20 as string)) subreddit,
  concat('c', cast(o_custkey % 97 as string)) author,
  case when o_orderstatus = 'P' then null else cast(o_custkey % 13 - 4 as int) end score,
  {epoch_seconds('o_orderdate', dialect)} created_utc, o_orderpriority title, concat('status ', o_orderstatus) selftext
from {t}"""


THREAD_SQL = {
    "conv_posts": (conv_posts_sql, ("conversations",)),
    "conv_comments": (conv_comments_sql, ("conversations",)),
    "chain_comments": (chain_comments_sql, ("events",)),
    "bushy_comments": (bushy_comments_sql, ("events",)),
    "order_comments": (order_comments_sql, ("lineitem",)),
    "order_posts": (order_posts_sql, ("orders",)),
    "conv_scores": (conv_scores_sql, ("conversations", "labels")),
    "order_scores": (order_scores_sql, ("lineitem", "labels")),
}


def thread_table(spark: SparkSession, sf_dir: str, name: str, materialized: bool = True) -> DataFrame:
    """Derive a thread table in Spark from the driver's Parquet tables.

    The derivation (a window over the source table) is written once as a
    Parquet table below the checkpoint folder, as a stored comment table
    would be, so operators that read it several times scan it instead of
    re-deriving it."""
    from ..operators.lineage import materialize

    fn, inputs = THREAD_SQL[name]
    args = {t: read_table(spark, sf_dir, t) for t in inputs}
    df = spark.sql(fn(SPARK), **args)
    return materialize(df, name) if materialized else df


def thread_cte(*names: str) -> str:
    """``WITH`` clause defining the given thread tables for the oracle."""
    parts = [f"{n} as ({THREAD_SQL[n][0](DUCKDB)})" for n in names]
    return "with " + ",\n".join(parts)
