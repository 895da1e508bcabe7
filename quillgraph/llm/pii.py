"""Personal data by a linear-chain conditional random field.

Tokens are runs without white space, cut to their core (marks around it go).
Features are the token's collapsed word shape (``a.9@a9.a.a``), digits, length,
marks and the digits of its neighbours. Weights are trained on the driver from
a small labelled table by forward-backward and gradient steps.

Decoding is exact Viterbi over whole documents: a token whose score for
"none" leads by more than any pair of transitions could win back is "none" in
the best path whatever its neighbours are, so chains are cut there and the
stretches between are decoded together in numpy, one step for all.

Defined cases: null and empty texts hold none; a start or end of a text acts
as a neighbour "none"; rows without an id are reported with a null id;
repeated rows are reported each; texts are read whole; an empty table gives an
empty result.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import words as W
from .common import id_text, lean, text_of

TAGS = ("none", "email", "phone", "+phone", "ip", "card", "+card", "national_id")
KINDS = tuple(t.removeprefix("+") for t in TAGS)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = ord("a")
_CLASS[65:91] = ord("A")
_CLASS[48:58] = ord("9")
_FIRST = np.isin(_CLASS, [ord(c) for c in "aA9+("])
_LAST = np.isin(_CLASS, [ord(c) for c in "aA9)"])
_DIGITS = np.searchsorted([1, 2, 3, 4, 5, 7, 8, 10, 13, 14, 15, 16, 17, 20], np.arange(64), side="right")
_LENGTHS = np.searchsorted([2, 3, 4, 5, 6, 8, 11, 15, 16, 17, 20, 30], np.arange(64), side="right")
SHAPES = 256  # shapes of the labelled table that get weights of their own


@dataclass
class Tokens:
    doc: np.ndarray
    start: np.ndarray  # byte of the core in the pass
    end: np.ndarray
    shape: np.ndarray  # 64-bit hash of the collapsed shape
    groups: np.ndarray  # tokens x feature groups, without the shape


SIZES = (16, 16, 16, 16, 10, 10, 16, 16)


def tokens(texts: pa.Array) -> tuple[Tokens, np.ndarray, np.ndarray]:
    """(tokens, bytes, offsets) of one pass of texts."""
    raw, off = W.raw_bytes(W.column(texts))
    n = len(raw)
    ink = ~_SPACE[raw]
    prev = np.zeros(n, bool)
    prev[1:] = ink[:-1]
    at = off[:-1]
    prev[at[at < n]] = False
    start = np.flatnonzero(ink & ~prev)
    nxt = np.zeros(n, bool)
    nxt[:-1] = ink[1:]
    last = off[1:] - 1
    nxt[last[last >= 0]] = False
    end = np.flatnonzero(ink & ~nxt) + 1
    # the core of each token: from its first to its last byte that may bound one
    place = np.arange(n, dtype=np.int64)
    first = np.minimum.reduceat(np.append(np.where(_FIRST[raw], place, n), n), start) if len(start) else start
    final = np.maximum.reduceat(np.append(np.where(_LAST[raw], place, -1), -1), start) + 1 if len(start) else end
    has = (first < end) & (final > first)
    start, end = first[has], final[has]
    doc = np.searchsorted(off, start, side="right") - 1
    kind = _CLASS[raw]
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change[start] = True
    step = np.cumsum(change)
    value = np.where(change, W._BYTE_VALUE[kind] * W.powers(W._BASE, n + 2)[step % (n + 2)], W.U64(0))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(value, out=sums[1:])
    shape = W.mix((sums[end] - sums[start]) * W.powers(W._BASE_INV, n + 2)[step[start]] if len(start) else np.zeros(0, np.uint64))

    def total(flags: np.ndarray) -> np.ndarray:
        s = np.zeros(n + 1, np.int32)
        np.cumsum(flags, out=s[1:])
        return s[end] - s[start]

    digits, size = np.minimum(total(kind == 57), 63), np.minimum(end - start, 63)
    dots, ats = np.minimum(total(raw == 46), 4), np.minimum(total(raw == 64), 2)
    hyphens, parens = np.minimum(total(raw == 45), 3), np.minimum(total((raw == 40) | (raw == 41)), 1)
    letters = total((kind == 97) | (kind == 65)) > 0
    bound = np.zeros(256, np.int64)
    for k, c in enumerate("aA9+()"):
        bound[ord(c)] = k + 1
    d = _DIGITS[digits]
    before, after = np.zeros_like(d), np.zeros_like(d)
    if len(d):
        same = doc[1:] == doc[:-1]
        before[1:] = np.where(same, d[:-1] + 1, 0)
        after[:-1] = np.where(same, d[1:] + 1, 0)
    groups = np.stack(
        [d, _LENGTHS[size], dots * 3 + ats, hyphens * 4 + parens * 2 + letters, bound[kind[start]], bound[kind[end - 1]] + 0, before, after], axis=1
    ) if len(start) else np.zeros((0, len(SIZES)), np.int64)
    return Tokens(doc, start, end, shape, groups), raw, off


@dataclass
class Model:
    shapes: np.ndarray  # sorted hashes
    weights: np.ndarray  # features x tags
    moves: np.ndarray  # tags x tags

    def features(self, t: Tokens) -> np.ndarray:
        """tokens x groups: rows of ``weights``."""
        k = np.minimum(np.searchsorted(self.shapes, t.shape), max(0, len(self.shapes) - 1))
        known = (self.shapes[k] == t.shape) if len(self.shapes) else np.zeros(len(t.shape), bool)
        base = SHAPES + 1 + np.concatenate(([0], np.cumsum(SIZES)[:-1]))
        return np.concatenate([np.where(known, k + 1, 0)[:, None], t.groups + base], axis=1)

    def scores(self, t: Tokens) -> np.ndarray:
        f = self.features(t)
        out = self.weights[f[:, 0]].copy()
        for k in range(1, f.shape[1]):
            out += self.weights[f[:, k]]
        return out

    def decode(self, scores: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Best tag of each token."""
        n = len(scores)
        tags = np.zeros(n, np.int64)
        if not n:
            return tags
        m = self.moves
        swing = (m[:, :, None] + m[None, :, :])[:, 1:, :] - (m[:, :1, None] + m[None, :1, :])
        open_ = np.flatnonzero(scores[:, 0] - scores[:, 1:].max(axis=1) <= swing.max())
        if not len(open_):
            return tags
        new = np.ones(len(open_), bool)
        new[1:] = (open_[1:] != open_[:-1] + 1) | (doc[open_[1:]] != doc[open_[:-1]])
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(open_)))
        order = np.argsort(-length, kind="stable")
        begin, length = open_[begin[order]], length[order]
        best = scores[begin] + m[0]
        back = []
        ended = np.empty((len(begin), len(TAGS)))
        for t in range(1, int(length[0]) + 1):
            live = int(np.searchsorted(-length, -t, side="left"))  # chains longer than t
            ended[live : len(best)] = best[live:]
            if not live:
                break
            options = best[:live, :, None] + m[None]
            back.append(options.argmax(axis=1))
            best = options.max(axis=1) + scores[begin[:live] + t]
        state = (ended + m[:, 0]).argmax(axis=1)
        for t in range(int(length[0]) - 1, -1, -1):
            live = int(np.searchsorted(-length, -t, side="left"))
            tags[begin[:live] + t] = state[:live]
            if t:
                state[:live] = back[t - 1][np.arange(live), state[:live]] if len(back[t - 1]) == live else state[:live]
        return tags


def labelled_table(sentences: int = 900, seed: int = 5) -> pd.DataFrame:
    """(sentence, place, token, tag): the small labelled table, written from templates."""
    rng = random.Random(seed)
    pick = rng.choice
    letters = lambda a, b: "".join(pick("abcdefghijklmnopqrstuvwxyzéüñç") if rng.random() < 0.97 else pick("éèöß") for _ in range(rng.randint(a, b)))
    ascii_ = lambda a, b: "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    num = lambda k: "".join(pick("0123456789") for _ in range(k))

    def word() -> str:
        w = letters(1, 12)
        r = rng.random()
        w = w.capitalize() if r < 0.15 else w.upper() if r < 0.2 else w
        return w + pick(["", "", "", "", ",", ".", "!!", "&&&", "%%%", "$$$", "***", "###", ";", ":"])

    def email() -> list[str]:
        name = pick([ascii_(2, 9), f"{ascii_(2, 7)}.{ascii_(2, 8)}", f"{ascii_(2, 8)}.{num(2)}", f"{ascii_(3, 8)}{num(rng.randint(1, 4))}", f"{ascii_(2, 6)}_{ascii_(2, 6)}", f"{ascii_(1, 1)}-{ascii_(3, 8)}", f"{ascii_(3, 7)}+{ascii_(2, 5)}", ascii_(3, 7).capitalize()])
        host = pick([f"{ascii_(3, 9)}.{pick(['com', 'org', 'net', 'de', 'io'])}", f"mail{num(1)}.{ascii_(4, 8)}.com", f"{ascii_(3, 6)}-{ascii_(3, 6)}.{pick(['co.uk', 'com', 'fr'])}", f"{ascii_(2, 5)}.{ascii_(3, 7)}.edu"])
        return [f"{name}@{host}"]

    def phone() -> list[str]:
        a, b, c = num(3), num(3), num(4)
        return pick([["+1", f"({a})", f"{b}-{c}"], [f"+{rng.randint(1, 99)}", a, b, c], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"+1-{a}-{b}-{c}"], [f"+{rng.randint(20, 99)}", num(2), num(4), num(4)], [f"+{rng.randint(1, 99)}{num(10)}"], [f"{a}.{b}.{c}"], ["+1", f"({a})", b, c], [f"+1({a}){b}-{c}"]])

    def card() -> list[str]:
        whole = pick(["4", "5", "37", "6011"])
        whole += num((15 if whole == "37" else 16) - len(whole))
        if len(whole) == 16 and rng.random() < 0.35:
            four = [whole[k : k + 4] for k in range(0, 16, 4)]
            return pick([four, ["-".join(four)]])
        return [whole]

    makers = {
        "email": email, "phone": phone, "card": card,
        "ip": lambda: [".".join(str(rng.randint(0, 255)) for _ in range(4))],
        "national_id": lambda: [f"{num(3)}-{num(2)}-{num(4)}"],
    }

    def other() -> list[str]:
        hexa = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))
        return pick([
            [num(rng.randint(1, 6))], [str(rng.randint(1900, 2030))], [f"{rng.randint(1, 9)}.{rng.randint(0, 9)}"], [f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}"],
            [f"20{num(2)}-0{rng.randint(1, 9)}-{num(2)}"], [f"{num(2)}:{num(2)}"], [f"${num(3)}.{num(2)}"], ["token", "=", f'"{hexa(40)}"'], [f"password={hexa(18)}"],
            ["AKIA" + "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))], [f"{num(1)},{num(3)},{num(3)}"], [num(8)], [num(10)], [f"{ascii_(3, 8)}.{pick(['com', 'org'])}"],
            [f"@{ascii_(3, 9)}"], [f"#{num(3)}"], [f"{num(2)}%"], [f"({num(4)})"], ["version", f"{rng.randint(1, 9)}."], [f"{num(2)}/{num(2)}/20{num(2)}"], [f"{ascii_(2, 5)}-{num(3)}"],
            [f"https://www.{ascii_(3, 9)}.com/{ascii_(2, 6)}"], [f"{num(3)}-{num(3)}"], ["License,", "Version", "2.0."], [hexa(32)], ["|"], ["-"],
        ])

    rows = []
    for s in range(sentences):
        out: list[tuple[str, str]] = []
        for _ in range(rng.randint(1, 4)):
            out += [(word(), "none") for _ in range(rng.randint(0, 5))]
            r = rng.random()
            if r < 0.55:
                tag = pick(list(makers))
                parts = makers[tag]()
                tail = pick(["", "", "", ",", ".", ";", "###", "***", "!!"])
                parts[-1] += tail
                out += [(p, tag if k == 0 else f"+{tag}") for k, p in enumerate(parts)]
            elif r < 0.85:
                out += [(p, "none") for p in other()]
        out += [(word(), "none") for _ in range(rng.randint(0, 4))]
        rows += [(s, k, tok, tag) for k, (tok, tag) in enumerate(out)]
    return pd.DataFrame(rows, columns=["sentence", "place", "token", "tag"])


def fit(table: pd.DataFrame, steps: int = 250, l2: float = 2e-4, rate: float = 0.15) -> Model:
    """Train on (sentence, place, token, tag) by full gradient steps with adaptive rates."""
    table = table.sort_values(["sentence", "place"], kind="stable")
    texts = table.groupby("sentence", sort=True)["token"].agg(" ".join)
    t, _, _ = tokens(pa.array(texts.tolist(), pa.large_string()))
    want = table["tag"].map({x: k for k, x in enumerate(TAGS)}).to_numpy()
    cored = np.array([bool(np.any(_FIRST[np.frombuffer(x.encode(), np.uint8)]) and np.any(_LAST[np.frombuffer(x.encode(), np.uint8)])) for x in table["token"]])
    want = want[cored]
    if len(want) != len(t.doc):
        raise ValueError("tokens of the labelled table must not hold white space")
    count = pd.Series(t.shape).value_counts()
    model = Model(np.sort(count.index[:SHAPES].to_numpy(np.uint64)), np.zeros((SHAPES + 1 + sum(SIZES), len(TAGS))), np.zeros((len(TAGS), len(TAGS))))
    f = model.features(t)
    begin = np.searchsorted(t.doc, np.arange(len(texts)))
    length = np.diff(np.append(begin, len(t.doc)))
    begin, length = begin[length > 0], length[length > 0]
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    prev = np.concatenate(([0], want[:-1]))
    prev[begin] = 0
    final = begin + length - 1
    gold = np.zeros_like(model.weights)
    for k in range(f.shape[1]):
        np.add.at(gold, (f[:, k], want), 1)
    gold_moves = np.zeros_like(model.moves)
    np.add.at(gold_moves, (prev, want), 1)
    np.add.at(gold_moves, (want[final], np.zeros_like(final)), 1)
    n = len(want)
    state = [np.zeros_like(model.weights), np.zeros_like(model.weights), np.zeros_like(model.moves), np.zeros_like(model.moves)]
    lse = lambda a, axis: a.max(axis=axis) + np.log(np.exp(a - np.expand_dims(a.max(axis=axis), axis)).sum(axis=axis))
    for step in range(1, steps + 1):
        s, m = model.scores(t), model.moves
        fwd, bwd = np.zeros_like(s), np.zeros_like(s)
        fwd[begin] = s[begin] + m[0]
        for d in range(1, int(length[0])):
            at = begin[length > d] + d
            fwd[at] = s[at] + lse(fwd[at - 1][:, :, None] + m[None], 1)
        bwd[final] = m[:, 0]
        for d in range(int(length[0]) - 2, -1, -1):
            at = begin[length > d + 1] + d
            bwd[at] = lse(m[None] + (s[at + 1] + bwd[at + 1])[:, None, :], 2)
        z = np.repeat(lse(fwd[final] + m[:, 0], 1), length)
        index = np.concatenate([np.arange(b, b + k) for b, k in zip(begin, length, strict=True)])
        zs = np.empty(n)
        zs[index] = z
        p = np.exp(fwd + bwd - zs[:, None])
        g = np.zeros_like(model.weights)
        for k in range(f.shape[1]):
            for tag in range(len(TAGS)):
                g[:, tag] += np.bincount(f[:, k], p[:, tag], minlength=len(g))
        first = np.zeros(n, bool)
        first[begin] = True
        inner = np.flatnonzero(~first)
        pairs = np.exp(fwd[inner - 1][:, :, None] + m[None] + (s[inner] + bwd[inner])[:, None, :] - zs[inner][:, None, None]).sum(axis=0)
        pairs[0] += p[begin].sum(axis=0)
        pairs[:, 0] += p[final].sum(axis=0)
        for value, grad, a, b in ((model.weights, (g - gold) / n + l2 * model.weights, 0, 1), (model.moves, (pairs - gold_moves) / n + l2 * model.moves, 2, 3)):
            state[a] = 0.9 * state[a] + 0.1 * grad
            state[b] = 0.99 * state[b] + 0.01 * grad**2
            value -= rate * (state[a] / (1 - 0.9**step)) / (np.sqrt(state[b] / (1 - 0.99**step)) + 1e-6)
    return Model(model.shapes, np.ascontiguousarray(model.weights, np.float32), model.moves.astype(np.float32))


def spans(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, kind, char from, char to) of one pass."""
    t, raw, off = tokens(texts)
    tags = model.decode(model.scores(t), t.doc)
    inner = np.array([x.startswith("+") for x in TAGS])[tags]
    kind = np.array([KINDS.index(x) for x in KINDS])[tags]
    joins = np.zeros(len(tags), bool)
    if len(tags):
        joins[1:] = inner[1:] & (kind[1:] == kind[:-1]) & (t.doc[1:] == t.doc[:-1])
    first = np.flatnonzero((tags > 0) & ~joins)
    group = np.cumsum((~joins).astype(np.int64))
    final = np.searchsorted(group, group[first], side="right") - 1
    chars = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=chars[1:])
    doc = t.doc[first]
    return doc, kind[first], chars[t.start[first]] - chars[off[doc]], chars[t.end[final]] - chars[off[doc]]


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, kind, char_at, char_to), a row for each span."""
    model = model or fit(labelled_table())
    names = pa.array(KINDS)

    def run(batches):
        for batch in batches:
            for at, part in W.passes(text_of(batch)):
                doc, kind, a, b = spans(part, model)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + at)), pc.take(names, pa.array(kind)), pa.array(a), pa.array(b)], ["doc_id", "kind", "char_at", "char_to"])

    return id_text(docs).mapInArrow(lean(run), "doc_id long, kind string, char_at long, char_to long")
