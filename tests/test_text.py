from pyspark.sql import functions as F

from threadmetrics.functions import calendar as cal
from threadmetrics.functions import text as tx


def one(spark, col_fn, value, ddl="x string"):
    return spark.createDataFrame([(value,)], ddl).select(col_fn(F.col("x")).alias("y")).first()["y"]


def test_links(spark):
    assert one(spark, tx.link_count, "http://a#b") == 1
    assert one(spark, tx.link_count, "https://a.b/c?d=e, http://x") == 2
    assert one(spark, tx.link_count, "ftp://x") == 0
    assert one(spark, tx.link_count, None) == 0


def test_clean(spark):
    assert one(spark, tx.clean_text, "[x](u)") == "x"
    assert one(spark, tx.clean_text, "a\nb") == "ab"
    assert one(spark, tx.clean_text, 'say "hi"\t') == "say hi"
    assert one(spark, tx.clean_text, "") == ""


def test_token_normalisation(spark):
    toks = spark.createDataFrame([("'tis-",), ("--",), ("O'Neil",), ("naive",), ("naïve",), ("abc1",), ('""',)], "t string")
    got = [r[0] for r in toks.select(tx.normalize_token(F.col("t"))).collect()]
    assert got == ["tis", None, "o'neil", "naive", None, None, None]


def test_treebank(spark):
    got = one(spark, tx.treebank_tokens, "They'll save and invest more. I cannot go!")
    # word-level Treebank rules: only the final period of the text is split off
    assert got == ["They", "'ll", "save", "and", "invest", "more.", "I", "can", "not", "go", "!"]
    assert one(spark, tx.token_count, "") == 0


def test_hours_ignore_year(spark):
    df = spark.createDataFrame([(1706742000, 1706745600)], "p bigint, t bigint")  # 31 Jan 23:00 -> 1 Feb 00:00
    assert df.select(cal.hours_post_to_tlc(F.col("t"), F.col("p"))).first()[0] == -23
    dec = spark.createDataFrame([(1703980800, 1704067200)], "p bigint, t bigint")  # 31 Dec -> 1 Jan
    assert dec.select(cal.hours_post_to_tlc(F.col("t"), F.col("p"))).first()[0] < 0


# Sentences with the tokens that the published word-level Treebank rules give.
GOLDEN = [
    ("Good muffins cost $3.88 in New York.", "Good muffins cost $ 3.88 in New York ."),
    ("Please buy me two of them, thanks.", "Please buy me two of them , thanks ."),
    ("I can't do that, won't I?", "I ca n't do that , wo n't I ?"),
    ("The dog's bone isn't here", "The dog 's bone is n't here"),
    ("We're gonna go (maybe) now", "We 're gon na go ( maybe ) now"),
    ("She said hi; he left: gone", "She said hi ; he left : gone"),
    ("It costs 1,000 dollars", "It costs 1,000 dollars"),
    ("Wait... what", "Wait ... what"),
    ("A--B", "A -- B"),
    ("you'd better know I'm there", "you 'd better know I 'm there"),
]


def test_treebank_golden(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "i int, t string")
    got = {r["i"]: " ".join(r["w"]) for r in rows.select("i", tx.treebank_tokens(F.col("t")).alias("w")).collect()}
    assert [got[i] for i in range(len(GOLDEN))] == [w for _, w in GOLDEN]


def test_guarded_steps_equal_the_plain_chain(spark):
    """Steps run only on texts that they can change (STEP_NEEDS); the tokens are
    those of all steps one after the other, and of a judgement token by token."""
    import random
    parts = [*"ab.,:;'\"`-?!()[]{}<>@#$%& \n\t\r7N", "...", "--", "''", "``", "cannot", "Gonna", "d'ye", "more'n", " 'tis ",
             "'Twas", "n't ", "'ll ", "'s ", "\u0085", "é", "K", " ", " ", " a", "the "]
    pick = random.Random(7)
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 24))) for _ in range(4000)] + [None, "", "a.\" ) "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    x = F.col("text")
    for step in tx.TREEBANK_STEPS:
        x = F.concat(F.lit(" "), x, F.lit(" ")) if step is None else F.regexp_replace(x, step[0], tx._spark_repl(step[1]))
    plain = F.regexp_extract_all(x, F.lit(tx.NON_WS), 0)
    valid = F.filter(F.transform(plain, tx.normalize_token), lambda t: t.isNotNull())
    alpha = F.array_join(F.filter(plain, lambda t: t.rlike(r"^\p{L}+$")), " ")
    t = F.col("text")
    for new, old in ((tx.treebank_tokens(t), plain), (tx.token_count(t), F.size(plain)), (tx.valid_tokens(t), valid),
                     (tx.alpha_words(t), alpha)):
        assert df.filter(~new.eqNullSafe(old)).count() == 0
    assert {s[0] for s in tx.TREEBANK_STEPS if s} >= {*tx.STEP_NEEDS, *tx.STEP_NEEDS_LOWER}


def test_one_row_group_is_spread_over_the_cores(spark, tmp_path):
    from threadmetrics.sources.tables import spread
    spark.range(0, 20000, 1, 1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = spread(df, "id")
    cores = spark.sparkContext.defaultParallelism
    assert got.count() == 20000
    assert cores == 1 or got.select(F.spark_partition_id()).distinct().count() >= cores
    assert spread(df.limit(5), "id").count() == 5


def test_tokens_of_plain_texts_equal_those_of_the_steps(spark):
    """Texts without quotes skip the steps; what they give must be the same."""
    import random
    draw = random.Random(3)
    atoms = ["a", "Cat", "x", "-", "--", "---", ".", "...", "....", ",", ":", ",,", " ", "\n", "(", ")", "] (", "[", "?", ";", "&",
             "5", "é", "K", " ", "`", "'", " cannot ", "Gimme", "http://x.y", "_"]
    texts = ["".join(draw.choice(atoms) for _ in range(draw.randint(0, 8))) for _ in range(3000)]
    words = tx.treebank_text(F.col("t"))
    each = F.filter(F.transform(F.regexp_extract_all(words, F.lit(tx.NON_WS), 0), tx.normalize_token), lambda x: x.isNotNull())
    alpha = F.array_join(F.filter(F.regexp_extract_all(words, F.lit(tx.NON_WS), 0), lambda x: x.rlike(r"^\p{L}+$")), " ")
    df = spark.createDataFrame([(t,) for t in [*texts, "", None]], "t string")
    got = df.select("t", tx.valid_tokens(F.col("t")).alias("v"), each.alias("w"), tx.alpha_words(F.col("t")).alias("a"), alpha.alias("b"),
                    tx._plain_or(F.col("t"), lambda t, low: F.lit(1), lambda t: F.lit(0)).alias("plain")).collect()
    assert [r for r in got if r["v"] != r["w"] or r["a"] != r["b"]] == []
    assert 500 < sum(r["plain"] for r in got) < 2500
