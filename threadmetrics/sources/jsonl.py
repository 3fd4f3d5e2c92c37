"""Posts with nested reply trees as JSON lines (S1) to flat tables, and back.

Reading: each line is decoded once, in the task that reads it, and flattened
with an explicit stack into one row for the post and one per comment, so the
work is linear in the line and no depth of nesting is too deep. Lines nested
beyond what the standard decoder takes go through an iterative decoder (an
explicit stack over the line's tokens). The rows of all kinds are written once
to the shared folder. Nothing is lost silently: lines that are not a JSON
object, comments that are not one and numbers that do not fit their column are
returned as a reject table with the reason.

Defined values: bytes that are not UTF-8 and lone surrogates become U+FFFD; a
whole number may be written as 7, 7.0, 7e0, "7" or "7.0"; any other number, a
boolean and a number out of its column's range (32 bits for score, 64 for
created_utc) are NULL in the row and rejected.
"""

from __future__ import annotations

import json
import math
import re
from json.decoder import scanstring

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import materialize

COMMENTS_DDL = ("post_id string, comment_id string, parent_id string, sibling_ord int, subreddit string, "
                "subreddit_id string, author string, score int, created_utc bigint, body string")
POSTS_DDL = ("post_id string, subreddit string, author string, score int, created_utc bigint, "
             "title string, selftext string")
REJECTS_DDL = "line string, reason string"
_COMMENT = [c.split()[0] for c in COMMENTS_DDL.split(", ")]
_POST = [c.split()[0] for c in POSTS_DDL.split(", ")]
ROWS_DDL = f"kind string, {COMMENTS_DDL}, title string, selftext string, line string, reason string"
_ROW = [c.split()[0] for c in ROWS_DDL.split(", ")]


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines that hold anything, as valid UTF-8."""
    return spark.read.text(path).select(F.make_valid_utf8("value").alias("value")).filter(F.trim("value") != "")


def read_threads_and_rejects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """JSON lines -> (posts, comments, rejected lines)."""
    rows = materialize(text_lines(spark, path).mapInPandas(_flatten, ROWS_DDL), "threads")

    def kind(name: str, cols: list[str]) -> DataFrame:
        return rows.filter(F.col("kind") == name).select(*cols)

    return kind("post", _POST), kind("comment", _COMMENT), kind("reject", ["line", "reason"])


def read_threads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines -> (posts, comments) with the canonical schemas."""
    posts, comments, _ = read_threads_and_rejects(spark, path)
    return posts, comments


# ------------------------------------------------------------------ decoding
_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
_WORDS = {"true": True, "false": False, "null": None}


def decode_iteratively(text: str):
    """Value of a JSON text, for any depth of nesting. ``open_`` holds the
    containers around the current position, outermost first."""
    at, end = _SPACE.match(text).end(), len(text)
    open_: list[tuple[object, object]] = []        # (container, key it sits under)
    value, have, key = None, False, None
    while True:
        if not have:
            c = text[at:at + 1]
            if c == '"':
                value, at = scanstring(text, at + 1, True)
                have = True
            elif c in ("{", "["):
                box: object = {} if c == "{" else []
                at = _SPACE.match(text, at + 1).end()
                if text[at:at + 1] == ("}" if c == "{" else "]"):
                    value, have, at = box, True, at + 1
                else:
                    open_.append((box, key))
                    key, at = _key(text, at) if c == "{" else (None, at)
                    continue
            else:
                m = _NUMBER.match(text, at)
                word = next((w for w in _WORDS if text.startswith(w, at)), None)
                if m:
                    number = m.group()
                    value = int(number) if re.fullmatch(r"-?\d+", number) else float(number)
                    at = m.end()
                elif word:
                    value, at = _WORDS[word], at + len(word)
                else:
                    raise ValueError(f"no JSON value at character {at}")
                have = True
        at = _SPACE.match(text, at).end()
        if not open_:
            if at != end:
                raise ValueError(f"more text at character {at}")
            return value
        box, outer = open_[-1]
        if isinstance(box, dict):
            box[key] = value
        else:
            box.append(value)
        c = text[at:at + 1]
        if c == ",":
            at = _SPACE.match(text, at + 1).end()
            key, at = _key(text, at) if isinstance(box, dict) else (None, at)
            have = False
        elif c == ("}" if isinstance(box, dict) else "]"):
            open_.pop()
            value, key, at = box, outer, at + 1
        else:
            raise ValueError(f"expected ',' or an end at character {at}")


def _key(text: str, at: int) -> tuple[str, int]:
    """A member name and the place after its colon."""
    if text[at:at + 1] != '"':
        raise ValueError(f"expected a name at character {at}")
    name, at = scanstring(text, at + 1, True)
    at = _SPACE.match(text, at).end()
    if text[at:at + 1] != ":":
        raise ValueError(f"expected ':' at character {at}")
    return name, _SPACE.match(text, at + 1).end()


def decode(line: str):
    try:
        return json.loads(line)
    except RecursionError:
        return decode_iteratively(line)


# ------------------------------------------------------------------ flattening
def whole_number(x, bits: int) -> int | None:
    """A JSON value as a whole number of so many bits. Raises ValueError."""
    if x is None:
        return None
    if isinstance(x, bool) or not isinstance(x, int | float | str):
        raise ValueError("not a number")
    if isinstance(x, str):
        x = x.strip()
        x = int(x) if re.fullmatch(r"[+-]?[0-9]{1,40}", x) else float(x)
    if isinstance(x, float) and (not math.isfinite(x) or x != int(x)):
        raise ValueError("not a whole number")
    if not -(1 << bits - 1) <= int(x) < 1 << bits - 1:
        raise ValueError(f"out of the range of {bits} bits")
    return int(x)


_SURROGATE = re.compile("[\ud800-\udfff]")


def valid(text: str) -> str:
    """``text`` with surrogate pairs joined and lone surrogates as U+FFFD."""
    if not _SURROGATE.search(text):
        return text
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _str(x):
    return x if x is None else valid(x) if isinstance(x, str) else json.dumps(x)


_BITS = {"score": 32, "created_utc": 64}


def _numbers(node: dict, what: str) -> tuple[dict, list[dict]]:
    """The number columns of a post or comment, and rejects for what does not fit."""
    values, rejects = {}, []
    for name, bits in _BITS.items():
        raw = node.get(name)
        try:
            values[name] = whole_number(raw, bits)
        except ValueError as e:
            values[name] = None
            rejects.append({"kind": "reject", "line": json.dumps({name: raw}), "reason": f"{name} of {what}: {e}"})
    return values, rejects


def _children(node: dict) -> list:
    kids = node.get("children")
    return kids if isinstance(kids, list) else []


def line_rows(line: str):
    """Row dictionaries of one line."""
    try:
        post = decode(line)
    except ValueError as e:
        yield {"kind": "reject", "line": line, "reason": valid(str(e))}
        return
    if not isinstance(post, dict):
        yield {"kind": "reject", "line": line, "reason": "not a JSON object"}
        return
    pid = _str(post.get("id"))
    numbers, rejects = _numbers(post, f"post {pid}")
    yield {"kind": "post", "post_id": pid, "subreddit": _str(post.get("subreddit")), "author": _str(post.get("author")),
           **numbers, "title": _str(post.get("title")), "selftext": _str(post.get("selftext"))}
    yield from rejects
    stack = [(None, i, c) for i, c in reversed(list(enumerate(_children(post))))]
    while stack:
        parent, i, c = stack.pop()
        if not isinstance(c, dict):
            yield {"kind": "reject", "line": json.dumps(c), "reason": f"a comment of {pid} is not a JSON object"}
            continue
        cid = _str(c.get("id"))
        numbers, rejects = _numbers(c, f"comment {cid} of {pid}")
        yield {"kind": "comment", "post_id": pid, "comment_id": cid, "parent_id": parent, "sibling_ord": i,
               "subreddit": _str(c.get("subreddit")), "subreddit_id": _str(c.get("subreddit_id")),
               "author": _str(c.get("author")), **numbers, "body": _str(c.get("body"))}
        yield from rejects
        stack.extend((cid, j, k) for j, k in reversed(list(enumerate(_children(c)))))


def _flatten(batches):
    import pandas as pd

    def frame(rows):
        out = pd.DataFrame([tuple(r.get(c) for c in _ROW) for r in rows], columns=_ROW, dtype=object)
        return out.astype({"sibling_ord": "Int32", "score": "Int32", "created_utc": "Int64"})

    for pdf in batches:
        rows = []
        for line in pdf["value"]:
            for row in line_rows(line):
                rows.append(row)
                if len(rows) >= 20_000:      # a giant thread leaves in pieces
                    yield frame(rows)
                    rows = []
        yield frame(rows)


# ------------------------------------------------------------------ writer
def write_threads(posts: DataFrame, comments: DataFrame, path: str) -> None:
    """Flat (posts, comments) -> one JSON line per post with nested
    ``children``, built bottom-up one tree level at a time (children are
    ordered by ``sibling_ord``). A post is one line, as in the format."""
    from ..operators.tree import annotate

    ann = comments.join(annotate(comments).select("post_id", "comment_id", "level"), ["post_id", "comment_id"])
    ann = materialize(ann, "write_threads")
    max_level = ann.agg(F.max("level")).first()[0]
    fields = ["id", "subreddit", "subreddit_id", "author", "score", "created_utc", "body"]
    below = None  # (post_id, parent_id, sibling_ord, json) of the level below
    for lvl in range(max_level if max_level is not None else -1, -1, -1):
        nodes = ann.filter(F.col("level") == lvl).select(
            "post_id", "comment_id", "parent_id", "sibling_ord",
            F.to_json(F.struct(F.col("comment_id").alias("id"), *[c for c in fields[1:]])).alias("_j"))
        if below is not None:
            kids = (below.groupBy("post_id", F.col("parent_id").alias("comment_id"))
                    .agg(F.array_sort(F.collect_list(F.struct("sibling_ord", "json"))).alias("_k")))
            nodes = nodes.join(kids, ["post_id", "comment_id"], "left")
            kid_text = F.coalesce(F.array_join(F.transform("_k", lambda s: s["json"]), ","), F.lit(""))
        else:
            kid_text = F.lit("")
        js = F.concat(F.expr("substring(_j, 1, length(_j) - 1)"), F.lit(',"children":['), kid_text, F.lit("]}"))
        below = materialize(nodes.select("post_id", "parent_id", "sibling_ord", js.alias("json")), "nest")
    p = posts.select("post_id", F.to_json(F.struct(F.col("post_id").alias("id"), "subreddit", "author", "score",
                                                   "created_utc", "title", "selftext")).alias("_j"))
    if below is not None:
        tl = (below.groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct("sibling_ord", "json"))).alias("_k")))
        p = p.join(tl, "post_id", "left")
        kid_text = F.coalesce(F.array_join(F.transform("_k", lambda s: s["json"]), ","), F.lit(""))
    else:
        kid_text = F.lit("")
    out = p.select(F.concat(F.expr("substring(_j, 1, length(_j) - 1)"), F.lit(',"children":['), kid_text,
                            F.lit("]}")).alias("value"))
    out.write.mode("overwrite").text(path)
