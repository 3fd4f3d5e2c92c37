"""Fixed values that must equal the reference's for equal results.

Kept together, in their natural order, as plain text.
"""

# --- fixed values: URL pattern of the link counter (http/https URLs) -----------
URL_PATTERN = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\(\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"

# --- fixed values: Markdown link ``[label](target)`` -> ``label`` --------------
MD_LINK_PATTERN = r"\[([^]]+)\]\s*\([^)]+\)"

# --- fixed values: characters deleted by the text cleaner ----------------------
CLEAN_DELETE_CHARS = "\"\n\t\r"

# --- fixed values: characters stripped from both ends of a token ---------------
TOKEN_STRIP_CHARS = "\"'-"

# --- fixed values: English stop words, one per line of the stop-word file ------
STOP_WORDS = """i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
yourselves he him his himself she she's her hers herself it it's its itself they them their theirs
themselves what which who whom this that that'll these those am is are was were be been being have has
had having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over under
again further then once here there when where why how all any both each few more most other some such
no nor not only own same so than too very s t can will just don don't should should've now d ll m o re
ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't
isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't
weren weren't won won't wouldn wouldn't""".split()

# --- fixed values: defaults of the jobs ----------------------------------------
ENGLISH_SHARE_THRESHOLD = 0.8     # share of English text for a mixed text
VOCAB_MIN_DOC_FREQ = 10           # low document-frequency bound (inclusive)
VOCAB_MAX_DOC_SHARE = 0.9         # high bound, exclusive, as a share of documents
MIN_VALID_TOKENS = 10             # documents need more than this many tokens
EVEN_SAMPLE_MIN_STRATUM = 50      # strata with fewer members are dropped
EVEN_SAMPLE_PER_STRATUM = 100     # draws per stratum
TOXIC_THRESHOLD = 0.5             # untuned toxicity flag: tox > 0.5
TUNED_TOXIC_THRESHOLD = 0.8       # tuned flag: tox > 0.8 and attack > 0.5
TUNED_ATTACK_THRESHOLD = 0.5
NUM_TOPICS = 20
MAX_SEQ_LEN = 128
MLM_PROBABILITY = 0.15
EMBEDDING_BLEND_ALPHA = 0.5
GENERIC_CATEGORY_ID = 0

# --- fixed values: columns of the basic feature row, in the reference's order --
BASIC_COLUMNS = [
    "Top_comment_id", "Top_comment_order", "Post_created_utc", "Post_score",
    "Top_comment_created_utc", "Top_comment_subreddit", "Top_comment_link_count",
    "Top_comment_score", "Top_comment_author", "Post_author", "Top_comment_direct_children",
    "Top_comment_hour", "Top_comment_day", "Top_comment_day_of_week", "Post_hour", "Post_day",
    "Post_day_of_week", "Top_comment_and_Post_time_difference", "Replies_total_number",
    "Replies_max_depth", "Replies_links_count", "Replies_sum_score", "Top_comment_text",
    "Top_comment_word_count", "Post_text", "Top_comment_polarity", "Top_comment_subjectivity",
    "Top_comment_readability",
]

# --- own definitions (not reference values): reply marker lexicons -------------
# The reference consumes accommodation and prosocial counts computed elsewhere;
# these small function-word lists are this engine's own stand-ins.
ACCOMMODATION_MARKERS = {
    "article": "a an the".split(),
    "certain": "always never certainly definitely absolutely clearly".split(),
    "conj": "and but or because so although".split(),
    "discrep": "should would could ought wish hope".split(),
    "excl": "but except without exclude unless".split(),
    "incl": "with and include including both".split(),
    "ipron": "it this that something anything these those".split(),
    "negate": "no not never none nothing nobody".split(),
    "quant": "all many some few most every much".split(),
    "tentat": "maybe perhaps might guess probably possibly".split(),
}
PROSOCIAL_PATTERNS = {
    "informative": r"(?i)(according to|source|research|study|for example|in fact)",
    "advice": r"(?i)(you should|i recommend|try to|i suggest|consider)",
    "laughter": r"(?i)(lol|haha|lmao|rofl)",
    "gratitude": r"(?i)(thank|grateful|appreciate)",
    "i_language": r"(?i)(^|[^a-z])(i|me|my|mine|myself)([^a-z]|$)",
    "compliments": r"(?i)(great|awesome|nice|well done|good job)",
}
FUNDRAISING_HOSTS = r"(?i)https?://[^/ ]*(gofundme|patreon|kickstarter|donate)"
INFORMATIVE_HOSTS = r"(?i)https?://[^/ ]*(wikipedia|\.gov|\.edu|doi\.org|example\.org)"

# --- fixed values: the 26 outcome metrics, in the reference's order -----------
OUTCOME_METRICS = [
    "Replies_informative_count", "Replies_links_count", "Replies_max_depth", "Replies_sum_score",
    "Replies_total_number", "Top_comment_article_accommodation", "Top_comment_certain_accommodation",
    "Top_comment_conj_accommodation", "Top_comment_discrep_accommodation", "Top_comment_excl_accommodation",
    "Top_comment_incl_accommodation", "Top_comment_ipron_accommodation", "Top_comment_negate_accommodation",
    "Top_comment_quant_accommodation", "Top_comment_tentat_accommodation", "Replies_advice_count",
    "Replies_laughter_count", "Replies_gratitude_count", "Replies_informative_URL_count",
    "Replies_i_language_count", "Replies_compliments_count", "Replies_untuned_toxicity_children_count",
    "Top_comment_direct_children", "Replies_distinct_pairs_of_sustained_conversation",
    "Replies_max_turns_of_sustained_conversations", "Replies_untuned_non_toxic_percentage",
]

# --- fixed values: the 65 numeric model features ------------------------------
MODEL_FEATURES = [
    "Post_Top_comment_Jaccard_sim", "Post_Top_comment_topic_cosine_similarity",
    "Post_topic0", "Post_topic1", "Post_topic10", "Post_topic11", "Post_topic12", "Post_topic13",
    "Post_topic14", "Post_topic15", "Post_topic16", "Post_topic17", "Post_topic18", "Post_topic2",
    "Post_topic3", "Post_topic4", "Post_topic5", "Post_topic6", "Post_topic7", "Post_topic8", "Post_topic9",
    "Top_comment_advice_count", "Top_comment_agreement_value", "Top_comment_and_Post_time_difference",
    "Top_comment_author_gender_value", "Top_comment_compliments_count", "Top_comment_day",
    "Top_comment_day_of_week", "Top_comment_fundraising_URL_count", "Top_comment_gratitude_count",
    "Top_comment_hour", "Top_comment_i_language_count", "Top_comment_informative_URL_count",
    "Top_comment_informative_count", "Top_comment_laughter_count", "Top_comment_link_count",
    "Top_comment_mispellings", "Top_comment_polarity", "Top_comment_politeness_value",
    "Top_comment_readability", "Top_comment_score", "Top_comment_subjectivity", "Top_comment_support_value",
    "Top_comment_topic0", "Top_comment_topic1", "Top_comment_topic10", "Top_comment_topic11",
    "Top_comment_topic12", "Top_comment_topic13", "Top_comment_topic14", "Top_comment_topic15",
    "Top_comment_topic16", "Top_comment_topic17", "Top_comment_topic18", "Top_comment_topic2",
    "Top_comment_topic3", "Top_comment_topic4", "Top_comment_topic5", "Top_comment_topic6",
    "Top_comment_topic7", "Top_comment_topic8", "Top_comment_topic9",
    "Top_comment_tuned_toxicity", "Top_comment_untuned_toxicity", "Top_comment_word_count",
]

# --- fixed values: renaming of the prosocial count table (old -> new) ----------
PROSOCIAL_OLD_NAMES = [
    "Top_comment_id", "num_informative_replies", "num_advice_replies", "num_laughter_replies",
    "num_gratitude_replies", "num_fundraising_URL_replies", "num_informative_URL_replies",
    "num_i_language_replies", "num_compliments",
]
PROSOCIAL_NEW_NAMES = [
    "Top_comment_id", "Replies_informative_count", "Replies_advice_count", "Replies_laughter_count",
    "Replies_gratitude_count", "Replies_fundraising_URL_count", "Replies_informative_URL_count",
    "Replies_i_language_count", "Replies_compliments_count",
]

# --- own definitions: sentiment lexicon (word, polarity, subjectivity) ---------
SENTIMENT_LEXICON = [
    ("good", 0.7, 0.6), ("great", 0.8, 0.75), ("excellent", 1.0, 1.0), ("nice", 0.6, 1.0),
    ("love", 0.5, 0.6), ("happy", 0.8, 1.0), ("best", 1.0, 0.3), ("better", 0.5, 0.5),
    ("wonderful", 1.0, 1.0), ("amazing", 0.6, 0.9), ("thanks", 0.2, 0.2),
    ("bad", -0.7, 0.67), ("terrible", -1.0, 1.0), ("awful", -1.0, 1.0), ("worst", -1.0, 1.0),
    ("hate", -0.8, 0.9), ("poor", -0.4, 0.6), ("wrong", -0.5, 0.9), ("sad", -0.5, 1.0),
    ("stupid", -0.8, 1.0), ("boring", -1.0, 1.0),
]
NEGATIONS = ["not", "no", "never", "n't", "nobody", "nothing"]
NEGATION_FACTOR = -0.5
LANGUAGE_PROFILE_SIZE = 300   # trigrams kept per language
UNKNOWN_LANGUAGE = "un"
