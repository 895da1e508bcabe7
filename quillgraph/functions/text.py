"""Column functions over text: sub-tokens, the hashing embedder, token cost, clipping, and the intent router."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+"
PART = r"[A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+"
LOCATE = r"(?i)(?U)\b(?:where|who|which)\b.*\b(?:use[ds]?|call(?:s|ed)?|references?|invokes?)\b"
EXPLAIN = r"(?i)(?U)\b(?:how|why|explain|describe|overview|works?|flow)\b"


#: Different identifiers that a task remembers, and identifiers of a text that it holds at once.
KNOWN_WORDS, PIECE_WORDS = 200_000, 100_000


def words_of(text: str | None):
    """The identifiers of a text, in lists of bounded length."""
    found = (m[0] for m in re.finditer(IDENTIFIER, text or ""))
    if text and len(text) <= PIECE_WORDS:
        yield re.findall(IDENTIFIER, text)
        return
    while piece := list(islice(found, PIECE_WORDS)):
        yield piece


def word_tokens(word: str) -> list[str]:
    """``subtokens`` of one identifier."""
    whole = word.lower()
    return [whole, *(p for p in map(str.lower, re.findall(PART, word)) if p != whole)]


def subtokens(text: Column) -> Column:
    """Identifiers in lower case, each followed by its snake and camel parts that differ from it."""
    def parts(word: Column) -> Column:
        whole = F.lower(word)
        inner = F.transform(F.regexp_extract_all(word, F.lit(PART), F.lit(0)), F.lower)
        return F.concat(F.array(whole), F.filter(inner, lambda p: p != whole))

    return F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(0)), parts))


def bucket(token: Column, dim: int) -> Column:
    """The token's md5 as one number, modulo ``dim``, by folding 32-bit pieces."""
    digest = F.md5(token)
    out = F.lit(0).cast("long")
    for k in range(4):
        piece = F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
        out = (out * F.lit(2**32 % dim) + piece) % F.lit(dim)
    return out


def hashing_embedding(text: Column, dim: int = 256) -> Column:
    """Unit vector of counts of hashed sub-tokens; zeros for a text without any.

    As ``bucket`` of ``subtokens``; but a histogram of fixed length has no JVM
    expression of linear cost, so texts go to Python in Arrow batches, where
    each different identifier is hashed once and the counting is one call.
    """

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        known: dict[str, list[int]] = {}

        def buckets(word: str) -> list[int]:
            if word not in known:
                known[word] = [int(hashlib.md5(p.encode()).hexdigest(), 16) % dim for p in word_tokens(word)]
            return known[word]

        counts = np.zeros((len(texts), dim))
        # tokens of few texts at once, and of a long text in pieces: a batch's tokens never lie side by side
        rows, found, held = [], [], 0

        def add() -> None:
            low, sizes = rows[0], [len(x) for x in found]
            flat = np.fromiter(chain.from_iterable(found), np.int64, sum(sizes)) + np.repeat(np.array(rows) - low, sizes) * dim
            high = rows[-1] + 1
            counts[low:high] += np.bincount(flat, minlength=(high - low) * dim).reshape(-1, dim)
            rows.clear(), found.clear()

        for k, t in enumerate(texts):
            for piece in words_of(t):
                if len(known) > KNOWN_WORDS:
                    known.clear()
                rows.append(k)
                found.append([b for w in piece for b in buckets(w)])
                held += len(found[-1])
                if held >= PIECE_WORDS:
                    add()
                    held = 0
        if rows:
            add()
        norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        return pd.Series(list((counts / np.where(norm == 0, 1.0, norm)).astype(np.float32)))

    return embed(text)


def subtoken_counts(text: Column) -> Column:
    """(tokens, kinds): how many ``subtokens`` a text has, and how many different ones; each different identifier is looked at once a batch."""

    @F.pandas_udf("tokens long, kinds long")
    def count(texts: pd.Series) -> pd.DataFrame:
        known: dict[str, list[str]] = {}
        rows = []
        for t in texts:
            many, kinds = 0, set()
            for piece in words_of(t):
                for w, n in Counter(piece).items():
                    if w not in known:
                        if len(known) > KNOWN_WORDS:
                            known.clear()
                        known[w] = word_tokens(w)
                    many += n * len(known[w])
                    kinds.update(known[w])
            rows.append((many, len(kinds)))
        return pd.DataFrame(rows, columns=["tokens", "kinds"], dtype="int64")

    # a filter on a field must not be pushed below, where it would count once more
    return count.asNondeterministic()(text)


def token_cost(text: Column) -> Column:
    """Characters, rounded up to fours, 1 at least."""
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4)).cast("long")


def clip(text: Column, cap: int = 240) -> Column:
    """One line of at most ``cap`` characters and an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\R", " "))
    return F.when(F.length(flat) > cap, F.concat(F.substring(flat, 1, cap), F.lit("…"))).otherwise(flat)


def intent(query: Column) -> Column:
    """LOCATE, or EXPLAIN as the default."""
    return F.when(query.rlike(LOCATE), "LOCATE").otherwise("EXPLAIN")
