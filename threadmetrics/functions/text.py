"""Text scalar functions (T1-T3, T7-T9, T17, T19) as native Column expressions.

Every function has two renderings kept side by side: a Spark ``Column``
(runs inside whole-stage codegen, no Python per row) and ``sql_*``, the
same definition as DuckDB SQL text for the oracle. Patterns only use
syntax with the same meaning in Java regex and RE2 (no look-around, no
back-references in patterns, ``\\z`` for end of text).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import CLEAN_DELETE_CHARS, MD_LINK_PATTERN, URL_PATTERN

# Whitespace as one explicit class (Java's \s and RE2's \s differ in \x0B).
WS = r"[\t\n\x0B\f\r ]"
NON_WS = r"[^\t\n\x0B\f\r ]+"
_W = "A-Za-z0-9_"

# Penn Treebank tokenisation as (pattern, replacement) rewrite steps. The
# replacement uses \1-style groups (RE2); Spark gets $1. ``None`` marks the
# point where the text is padded with one space on both sides.
TREEBANK_STEPS = [
    # opening quotes
    (r'^"', " `` "),
    (r"(``)", r" \1 "),
    (r"([ (\[{<])(\"|'')", r"\1 `` "),
    # punctuation
    (r"([:,])([^0-9])", r" \1 \2"),
    (r"([:,])\z", r" \1 "),
    (r"\.\.\.", " ... "),
    (r"([;@#$%&])", r" \1 "),
    (r"([^.])(\.)([\])}>\"']*)" + WS + r"*\z", r"\1 \2\3 "),
    (r"([?!])", r" \1 "),
    (r"([^'])' ", r"\1 ' "),
    # brackets and dashes
    (r"([\]\[(){}<>])", r" \1 "),
    (r"--", " -- "),
    None,
    # closing quotes and clitics
    (r'"', " '' "),
    (r"([^\t\n\x0B\f\r ])('')", r"\1 \2 "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", r"\1 \2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"\1 \2 "),
    # split contractions
    (rf"(?i)([^{_W}])(can)(not)([^{_W}])", r"\1\2 \3\4"),
    (rf"(?i)([^{_W}])(d)('ye)([^{_W}])", r"\1\2 \3\4"),
    (rf"(?i)([^{_W}])(gim)(me)([^{_W}])", r"\1\2 \3\4"),
    (rf"(?i)([^{_W}])(gon)(na)([^{_W}])", r"\1\2 \3\4"),
    (rf"(?i)([^{_W}])(got)(ta)([^{_W}])", r"\1\2 \3\4"),
    (rf"(?i)([^{_W}])(lem)(me)([^{_W}])", r"\1\2 \3\4"),
    (rf"(?i)([^{_W}])(more)('n)([^{_W}])", r"\1\2 \3\4"),
    (rf"(?i)([^{_W}])(wan)(na)([^{_W}])", r"\1\2 \3\4"),
    (rf"(?i) ('t)(is)([^{_W}])", r" \1 \2\3"),
    (rf"(?i) ('t)(was)([^{_W}])", r" \1 \2\3"),
]


def _spark_repl(r: str) -> str:
    out = []
    i = 0
    while i < len(r):
        if r[i] == "\\" and i + 1 < len(r) and r[i + 1].isdigit():
            out.append("$" + r[i + 1])
            i += 2
            continue
        if r[i] == "$":
            out.append("\\$")
        else:
            out.append(r[i])
        i += 1
    return "".join(out)


def sql_str(s: str) -> str:
    """A SQL string literal (standard quoting, no backslash escapes)."""
    return "'" + s.replace("'", "''") + "'"


# ------------------------------------------------------------------ T1 clean
def clean_text(c: Column) -> Column:
    """Markdown links to their label; delete double quotes, newlines, tabs, CR."""
    def unlinked(t: Column) -> Column:
        return F.when(F.contains(t, F.lit("]")) & F.contains(t, F.lit("(")), F.regexp_replace(t, MD_LINK_PATTERN, "$1")).otherwise(t)

    return reduce(lambda t, char: F.replace(t, F.lit(char), F.lit("")), CLEAN_DELETE_CHARS, _bound(c, unlinked))


def sql_clean_text(x: str) -> str:
    dele = "chr(34) || chr(10) || chr(9) || chr(13)"
    return f"translate(regexp_replace({x}, {sql_str(MD_LINK_PATTERN)}, '\\1', 'g'), {dele}, '')"


# ------------------------------------------------------------------ T2 tokens
# A step can change a text only if one of these strings is in it (``lower``: in
# the text with A-Z lower-cased, as the pattern ignores their case). The test is
# a byte search, so a pattern runs over the texts that it can match.
STEP_NEEDS = {
    r"(``)": ("``",), r"([ (\[{<])(\"|'')": ('"', "''"), r"([:,])([^0-9])": (",", ":"), r"\.\.\.": ("...",), r"--": ("--",),
    r"([^'])' ": ("' ",), r'"': ('"',), r"([^\t\n\x0B\f\r ])('')": ("''",),
    r"([^' ])('[sS]|'[mM]|'[dD]|') ": ("' ", "'s ", "'S ", "'m ", "'M ", "'d ", "'D "),
    r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ": ("'ll ", "'LL ", "'re ", "'RE ", "'ve ", "'VE ", "n't ", "N'T "),
}
STEP_NEEDS_LOWER = dict(zip([step[0] for step in TREEBANK_STEPS[-10:]], (
    "cannot", "d'ye", "gimme", "gonna", "gotta", "lemme", "more'n", "wanna", " 'tis", " 'twas"), strict=True))
FINAL_PERIOD = next(step[0] for step in TREEBANK_STEPS if step and step[0].startswith("([^.])"))
_CLOSERS = "])}>\"'"


def _bound(c: Column, fn) -> Column:
    """``fn(c)`` with ``c`` computed once, however often ``fn`` names it."""
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def _any(x: Column, needs) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(x, F.lit(n)) for n in needs])


def _final_period(x: Column) -> Column:
    """The step for a period that ends the text: it looks at the end alone."""
    body = F.rtrim(x, F.lit("\t\n\x0B\f\r "))

    def split(y: Column) -> Column:
        n = F.length(F.rtrim(y, F.lit(_CLOSERS)))
        return F.concat(F.substring(y, F.lit(1), n - 1), F.lit(" ."), F.substring(y, n + 1, F.length(y)), F.lit(" "))

    return _bound(body, lambda y: F.when(
        F.right(F.rtrim(y, F.lit(_CLOSERS)), F.lit(2)).rlike(r"^[^.]\.\z"), split(y)).otherwise(x))


def _treebank_step(pat: str, rep: str):
    def run(t: Column) -> Column:
        return F.regexp_replace(t, pat, _spark_repl(rep))

    def step(t: Column) -> Column:
        if pat == FINAL_PERIOD:
            return _final_period(t)
        if pat == r'^"':
            needed = F.startswith(t, F.lit('"'))
        elif pat == r"([:,])\z":
            needed = F.endswith(t, F.lit(",")) | F.endswith(t, F.lit(":"))
        elif pat in STEP_NEEDS:
            needed = _any(t, STEP_NEEDS[pat])
        else:
            return run(t)
        return F.when(needed, run(t)).otherwise(t)

    return step


def treebank_text(c: Column) -> Column:
    """The text after all steps: its tokens are what white space separates."""
    x, folded = c, []
    for step in TREEBANK_STEPS:
        if step is None:
            x = F.concat(F.lit(" "), x, F.lit(" "))
        elif step[0] in STEP_NEEDS_LOWER:
            folded.append(step)
        else:
            x = _bound(x, _treebank_step(*step))

    def contracted(t: Column) -> Column:
        for pat, rep in folded:
            t = F.regexp_replace(t, pat, _spark_repl(rep))
        return t

    return _bound(x, lambda t: F.when(_bound(F.lower(t), lambda low: _any(low, STEP_NEEDS_LOWER.values())), contracted(t))
                  .otherwise(t))


def treebank_tokens(c: Column) -> Column:
    """Treebank-style tokens of a text, as ``array<string>``."""
    return F.regexp_extract_all(treebank_text(c), F.lit(NON_WS), 0)


def sql_treebank_tokens(x: str) -> str:
    for step in TREEBANK_STEPS:
        if step is None:
            x = f"(' ' || {x} || ' ')"
            continue
        pat, rep = step
        x = f"regexp_replace({x}, {sql_str(pat)}, {sql_str(rep)}, 'g')"
    return f"regexp_extract_all({x}, {sql_str(NON_WS)})"


def token_count(c: Column) -> Column:
    return F.regexp_count(treebank_text(c), F.lit(NON_WS))


def sql_token_count(x: str) -> str:
    return f"len({sql_treebank_tokens(x)})"


# ------------------------------------------------------------------ T3 links
def link_count(c: Column) -> Column:
    """Number of http/https URLs in a text (0 for NULL)."""
    return F.coalesce(F.regexp_count(c, F.lit(URL_PATTERN)), F.lit(0)).cast("bigint")


def sql_link_count(x: str) -> str:
    return f"cast(coalesce(len(regexp_extract_all({x}, {sql_str(URL_PATTERN)})), 0) as bigint)"


# ------------------------------------------------------------------ T7 token
# Tokens found in the whole text. ``$`` matches before these line ends, which do
# not part tokens: a text that has one is judged token by token.
LINE_ENDS = r"[\u0085\u2028\u2029]"
_ALONE = r"(?<![^\t\n\x0B\f\r ])", r"(?![^\t\n\x0B\f\r ])"
VALID_TOKEN = rf"""{_ALONE[0]}["'-]*+([A-Za-z](?:[A-Za-z'-]*[A-Za-z])?+)["'-]*+{_ALONE[1]}"""
ALPHA_TOKEN = rf"{_ALONE[0]}\p{{L}}++{_ALONE[1]}"
_STRIP = r"""^["'-]+|["'-]+$"""

# Most texts have no quote, no run of marks and no contraction: there the steps
# only part the text at fixed marks, so the tokens are found in the text itself.
_MARKS = r"\t\n\x0B\f\r ;@#$%&?!\[\](){}<>"
_BEFORE = rf"(?:(?<![^{_MARKS}:,])|(?<=--)|(?<=\.\.\.))"
_AFTER = rf"\z|[{_MARKS}]|[:,](?![0-9])|\.\.\.|\.[\])}}>]*+{WS}*+\z"
PLAIN_TOKEN = rf"{_BEFORE}-*+([A-Za-z]++(?:-[A-Za-z]++)*+)(?:(?=--)|-*+(?={_AFTER}))"
PLAIN_ALPHA = rf"{_BEFORE}\p{{L}}++(?=--|{_AFTER})"
NOT_PLAIN = ('"', "'", "``", "....", ",,", "::", ",:", ":,", "\u0085", "\u2028", "\u2029")
NOT_PLAIN_LOWER = tuple(w for w in STEP_NEEDS_LOWER.values() if "'" not in w)


def normalize_token(t: Column) -> Column:
    """Strip ``"'-`` at both ends; keep (lower-cased) if the rest without
    inner ``-`` and ``'`` is non-empty ASCII letters; else NULL."""
    s = F.regexp_replace(t, _STRIP, "")
    ok = F.regexp_replace(s, "[-']", "").rlike("^[A-Za-z]+$")
    return F.when(ok, F.lower(s))


def sql_normalize_token(t: str) -> str:
    s = f"regexp_replace({t}, {sql_str(_STRIP)}, '', 'g')"
    return (f"case when regexp_full_match(regexp_replace({s}, '[-'']', '', 'g'), '[A-Za-z]+') "
            f"then lower({s}) end")


def _plain_or(text: Column, plain, general, *needs: str) -> Column:
    """``plain(t, low)`` where the steps only part the text ``t`` at fixed marks
    (``low``: ``t`` in lower case), else ``general(t)``."""
    def chosen(t: Column, low: Column) -> Column:
        return F.when(_any(t, NOT_PLAIN + needs) | _any(low, NOT_PLAIN_LOWER), general(t)).otherwise(plain(t, low))

    return _bound(text, lambda t: _bound(F.lower(t), lambda low: chosen(t, low)))


def valid_tokens(text: Column) -> Column:
    """T2 then T7, dropping invalid tokens (F9): the vocabulary input. Valid
    tokens are found in one pass; no pattern runs per token."""
    def found(t: Column) -> Column:
        each = F.filter(F.transform(F.regexp_extract_all(t, F.lit(NON_WS), 0), normalize_token), lambda x: x.isNotNull())
        return F.when(t.rlike(LINE_ENDS), each).otherwise(
            F.transform(F.regexp_extract_all(t, F.lit(VALID_TOKEN), 1), F.lower))

    def plain(t: Column, low: Column) -> Column:
        # lower case of other scripts can be ASCII: there the tokens are lowered one by one
        return F.when(F.octet_length(t) == F.length(t), F.regexp_extract_all(low, F.lit(PLAIN_TOKEN), 1)).otherwise(
            F.transform(F.regexp_extract_all(t, F.lit(PLAIN_TOKEN), 1), F.lower))

    return _plain_or(text, plain, lambda t: _bound(treebank_text(t), found))


def sql_valid_tokens(x: str) -> str:
    return (f"list_filter(list_transform({sql_treebank_tokens(x)}, lambda t: {sql_normalize_token('t')}), "
            f"lambda t: t is not null)")


# ------------------------------------------------------------------ T8 alpha
def alpha_words(text: Column) -> Column:
    """Keep alphabetic tokens (any script) and join them with one space."""
    def found(t: Column) -> Column:
        each = F.filter(F.regexp_extract_all(t, F.lit(NON_WS), 0), lambda x: x.rlike(r"^\p{L}+$"))
        return F.array_join(F.when(t.rlike(LINE_ENDS), each).otherwise(F.regexp_extract_all(t, F.lit(ALPHA_TOKEN), 0)), " ")

    return _plain_or(text, lambda t, low: F.array_join(F.regexp_extract_all(t, F.lit(PLAIN_ALPHA), 0), " "),
                     lambda t: _bound(treebank_text(t), found), "---")


def sql_alpha_words(x: str) -> str:
    return f"array_to_string(list_filter({sql_treebank_tokens(x)}, lambda t: regexp_full_match(t, '\\p{{L}}+')), ' ')"


# ------------------------------------------------------------------ T9 words
def space_word_count(text: Column) -> Column:
    """Pieces of a split on single spaces; an empty text counts 1."""
    return F.size(F.split(text, " ", -1)).cast("bigint")


def sql_space_word_count(x: str) -> str:
    return f"cast(len(string_split({x}, ' ')) as bigint)"


# ------------------------------------------------------------------ T17, T19
def strip_type_prefix(parent_id: Column) -> Column:
    """``t1_abc`` -> ``abc`` (drop the 3-character type prefix)."""
    return F.substring(parent_id, 4, 1 << 30)


def sql_strip_type_prefix(x: str) -> str:
    return f"substr({x}, 4)"


def post_text(title: Column, selftext: Column) -> Column:
    return F.concat(title, F.lit(" "), selftext)


def sql_post_text(t: str, s: str) -> str:
    return f"({t} || ' ' || {s})"
