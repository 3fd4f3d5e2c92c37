"""Unigram token counts by dynamic programming over a trie of pre-tokens.

A text's pre-tokens are its words, each with the vocabulary's word-start mark.
A pre-token's best segmentation into vocabulary pieces (highest sum of piece
scores; of equal sums the one with fewer tokens) is found by a forward pass
over its prefixes. Distinct new pre-tokens are inserted in a trie by walking
them in sorted order: the forward state of a prefix that several pre-tokens
share is computed once, on the path of the walk, and the state at a pre-token's
end (its token count) is stored. Counts are kept per task for later batches, up
to ``KEPT`` pre-tokens, so memory is bounded; nothing is shuffled.

Piece scores: the vocabulary file gives pieces in order of rank, and the score
of rank r is ``-log(r + 2)`` (a Zipf rule; nothing is trained). A character
that no piece covers costs one token per UTF-8 byte, each with the score of a
piece past the end of the vocabulary.

Defined results: null and empty texts have no tokens; a word of any length is
segmented whole; repeated rows give repeated results; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, bound_arrow

VOCABULARY = "piece_bpe_32k.model"
START = "▁"            # the vocabulary's word-start mark
KEPT = 1_000_000
WORDS = re.compile(WORD).findall
SHIFT, MASK = 40, (1 << 40) - 1
TIE = 1e-9                  # scores closer than this are equal

@lru_cache(maxsize=2)
def load_pieces(path: str) -> tuple[dict[str, float], float]:
    """(piece -> score, score of a byte)."""
    from sentencepiece import SentencePieceProcessor
    model = SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = {model.id_to_piece(i): -math.log(i + 2) for i in range(n)
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
    return pieces, -math.log(n + 2)


@lru_cache(maxsize=2)
def suffix_scores(path: str) -> dict[str, float | None]:
    """Every ending of every piece -> the score if it is a piece itself. The
    pieces that end at a character are found by growing an ending to the left
    until no piece ends so."""
    pieces = load_pieces(path)[0]
    out: dict[str, float | None] = {p[i:]: None for p in pieces for i in range(1, len(p))}
    out.update(pieces)
    return out


def trie_counts(words: Iterable[str], endings: dict[str, float | None], byte: float) -> dict[str, tuple[int, int]]:
    """Word -> (tokens, byte tokens) for distinct words. The words are walked
    in sorted order; ``score[i]``, ``tokens[i]`` and ``raw[i]`` are the state
    after the first i characters of the current one, and the part shared with
    the word before is kept."""
    out: dict[str, tuple[int, int]] = {}
    score, tokens, raw = [0.0], [0], [0]
    before = ""
    for word in sorted(words):
        marked = START + word
        shared, most = 0, min(len(before), len(marked))
        while shared < most and before[shared] == marked[shared]:
            shared += 1
        del score[shared + 1:], tokens[shared + 1:], raw[shared + 1:]
        for end in range(shared + 1, len(marked) + 1):
            last = marked[end - 1]
            if endings.get(last) is None:       # no piece is this character
                size = len(last.encode("utf-8", "surrogatepass"))
                top, n, r = score[end - 1] + size * byte, tokens[end - 1] + size, raw[end - 1] + size
            else:
                top, n, r = -math.inf, 0, 0
            for begin in range(end - 1, -1, -1):
                part = marked[begin:end]
                if part not in endings:
                    break
                own = endings[part]
                if own is not None:
                    s = score[begin] + own
                    if s > top + TIE or (s > top - TIE and tokens[begin] + 1 < n):
                        top, n, r = s, tokens[begin] + 1, raw[begin]
            score.append(top)
            tokens.append(n)
            raw.append(r)
        before = marked
        out[word] = (tokens[-1], raw[-1])
    return out


def _counter(path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        endings, byte = suffix_scores(path), load_pieces(path)[1]
        known: dict[str, int] = {}       # tokens, and byte tokens shifted left, in one number
        for pdf in frames:
            words = [WORDS(t) if t else [] for t in pdf["text"].tolist()]
            new = set(chain.from_iterable(words)).difference(known)
            if len(known) + len(new) > KEPT:
                known, new = {}, set(chain.from_iterable(words))
            known.update((w, n | r << SHIFT) for w, (n, r) in trie_counts(new, endings, byte).items())
            sums = [sum(map(known.__getitem__, ws)) for ws in words]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": list(map(len, words)),
                                "n_tokens": [x & MASK for x in sums], "n_byte_tokens": [x >> SHIFT for x in sums]})
    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_words, n_tokens, n_byte_tokens`` for every row."""
    bound_arrow(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    return (docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInPandas(_counter(path), "doc_id string, n_words long, n_tokens long, n_byte_tokens long")
            .withColumn("doc_id", F.col("doc_id").cast(kind)))
