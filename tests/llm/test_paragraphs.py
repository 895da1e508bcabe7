import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quillgraph.llm import paragraphs as P
from quillgraph.llm import words as W
from quillgraph.llm.common import table
from tests.llm.test_simhash import closure

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


def plain(text):
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7F])+", text.lower())


def units_of(text):
    """(kind, from, to) of the words of lines and segments, slowly; hashes are those of the operator."""
    out, at = [], 0
    for line in text.split("\n"):
        n = len(plain(line))
        if n:
            out.append((0, at, at + n))
        at += n
    w = W.split([text])
    h, n, r = w.grams(P.SHINGLE)[0].tolist(), len(w.hashes), P.RADIUS
    cuts = [i for i in range(r, n - r - P.SHINGLE + 1) if h[i] < min(h[i - r : i]) and h[i] <= min(h[i + 1 : i + r + 1])]
    bounds = [0, *cuts, n]
    return out + [(1, a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if a < b]


def slow(texts, least=P.SPAN_WORDS):
    """{doc: set of words in spans} and the pairs of similar units, with no hashing or banding."""
    place, sets, same = [], [], {}
    for d, text in sorted(texts.items()):
        w = plain(text)
        for kind, a, b in units_of(text):
            same.setdefault((kind, *w[a:b]), []).append(len(place))
            place.append((kind, d, a, b))
            sets.append({(kind, *w[i : i + 3]) for i in range(a, b - 2)})
    have, shared = {}, {}
    for ids in same.values():
        for g in sets[ids[0]]:
            have.setdefault(g, []).append(ids[0])
    for ids in have.values():
        for x in range(len(ids)):
            for y in range(x):
                shared[ids[y], ids[x]] = shared.get((ids[y], ids[x]), 0) + 1
    near = [(i, j) for (i, j), n in shared.items() if n / (len(sets[i]) + len(sets[j]) - n) >= P.SIMILAR]
    exact = [(ids[0], x) for ids in same.values() for x in ids[1:]]

    def words(links):
        first = {}
        root = closure(links)
        for i in sorted(root, key=lambda i: place[i][1:]):
            first.setdefault(root[i], i)
        spans = {}
        for i, r in root.items():
            if i != first[r]:
                spans.setdefault(place[i][1], []).append(place[i][2:])
        out = {}
        for d, mine in spans.items():
            joined = []
            for a, b in sorted(mine):
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = max(b, joined[-1][1])
                else:
                    joined.append([a, b])
            got = {k for a, b in joined if b - a >= least for k in range(a, b)}
            if got:
                out[d] = got
        return out

    return words(exact), words(exact + near)


def covered(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, set()).update(range(r.word_at, r.word_to))
    return out


def test_the_query_against_brute_force(spark):
    from quillgraph.llm import queries

    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    exact, all_ = slow(texts)
    rows = queries.queries()["op10_paragraph_dedup"](spark, SF).collect()
    got = covered(rows)
    count = lambda x: sum(map(len, x.values()))
    assert all(exact[d] <= got.get(d, set()) for d in exact)
    assert all(got[d] <= all_.get(d, set()) for d in got)
    assert count(got) >= 0.99 * count(all_)
    for r in rows:
        assert plain(texts[r.doc_id][r.char_at : r.char_to]) == plain(texts[r.doc_id])[r.word_at : r.word_to] and r.words == r.word_to - r.word_at >= P.SPAN_WORDS
        assert r.kept_doc_id <= r.doc_id


def test_passages_of_50_words_wherever_they_lie(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    prose = lambda n, every: "".join(word() + ("\n" if every and rng.random() < 1 / every else " ") for _ in range(n))
    texts, places = {}, {}
    for k in range(150):
        passage = [word() for _ in range(50)]
        for c in range(2):
            before, after = (prose(rng.randint(0, 90), rng.choice((0, 12, 40))) for _ in range(2))
            joined = "".join(w + ("\n" if rng.random() < 1 / 15 else " ") for w in passage)  # each copy is wrapped in its own way
            texts[2 * k + c], places[2 * k + c] = before + joined + after, len(plain(before))
    rows = covered(P.removals(spark.createDataFrame(list(texts.items()), SCHEMA), least=1).collect())
    hit = [len(rows.get(d, set()) & set(range(places[d], places[d] + 50))) for d in texts if d % 2]
    assert np.mean([h > 0 for h in hit]) >= 0.98 and np.mean(hit) >= 25
    long = covered(P.removals(spark.createDataFrame([(d, t.replace("\n", " ")) for d, t in texts.items() if d < 2], SCHEMA)).collect())
    assert set(long) <= {1}


def test_short_paragraphs(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    line = lambda n: " ".join(word() for _ in range(n))
    same15, same14, same3 = line(15), line(14), line(3)
    texts = [(k, "\n".join((line(25), x, line(25), y, line(25)))) for k, (x, y) in enumerate([(same15, same3), (same14, same15), (same3, same14)])]
    df = spark.createDataFrame(texts, SCHEMA)
    got = {(r.doc_id, r.word_at, r.words, r.kept_doc_id) for r in P.removals(df).collect()}
    assert got == {(1, 64, 15, 0)}
    got = {(r.doc_id, r.word_at, r.words, r.kept_doc_id) for r in P.removals(df, least=1).collect()}
    assert got == {(1, 64, 15, 0), (2, 25, 3, 0), (2, 53, 14, 1)}
    edited = same15.split()
    edited[-1] = "otherword"
    df = spark.createDataFrame([(0, f"{line(25)}\n{same15}"), (1, f"{' '.join(edited)}\n{line(25)}")], SCHEMA)
    assert [(r.doc_id, r.word_at, r.word_to) for r in P.removals(df).collect()] == [(1, 0, 15)]


def test_units_and_cuts():
    texts = ["", None, "one", "a b\n\nc ... d", "x " * 500, " ".join(f"w{i}" for i in range(400)), "É ü\nß"]
    u = P.Units(pa.array(texts, pa.string()))
    base = u.words.doc_words[u.doc]
    got = sorted(zip(u.doc.tolist(), u.kind.tolist(), (u.at - base).tolist(), (u.to - base).tolist(), strict=True))
    assert got == sorted((d, k, a, b) for d, t in enumerate(texts) if t for k, a, b in units_of(t))
    begin, end = u.chars()
    for d, a, b, ca, cb in zip(u.doc.tolist(), (u.at - base).tolist(), (u.to - base).tolist(), begin.tolist(), end.tolist(), strict=True):
        assert plain(texts[d][ca:cb]) == plain(texts[d])[a:b]
    keys, of = u.bands(np.arange(len(u)))
    want = np.where(u.to - u.at >= 3, np.where(u.kind == 0, P.BANDS, P.SEGMENT_BANDS), 0)
    assert np.bincount(of, minlength=len(u)).tolist() == want.tolist() and len(keys) == len(of)
    assert len(P.Units(pa.array([], pa.string()))) == 0 and len(P.Units(pa.array(["", None], pa.string()))) == 0


@pytest.mark.parametrize("size", [1, 2, 5, 400])
def test_verified_links_join_what_is_similar_and_nothing_else(size):
    rng = np.random.default_rng(3)
    rows = []
    for group in np.sort(rng.choice(2**62, 60)) - 2**61:
        base = np.unique(rng.integers(0, 2**63, 12, dtype=np.uint64))
        for _ in range(rng.integers(1, 9)):
            new = np.unique(np.concatenate((base[rng.random(len(base)) > 0.1], rng.integers(0, 2**63, rng.integers(0, 4), dtype=np.uint64))))
            rows.append((int(group), len(rows), new.tobytes()))
    schema = pa.schema([("group", pa.int64()), ("hash", pa.int64()), ("shingles", pa.binary())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[i : i + size]], schema) for i in range(0, len(rows), size)]
    got = [tuple(r.values()) for b in P._verify(0.6)(batches) for r in b.to_pylist()]
    sets = [set(np.frombuffer(r[2], np.uint64).tolist()) for r in rows]
    want = [(i, j) for j in range(len(rows)) for i in range(j) if rows[i][0] == rows[j][0] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.6]
    assert set(map(tuple, map(sorted, got))) <= set(want) and closure(got) == closure(want) and len(want) > len(got) > 50


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_met_rows_whatever_the_batches(size):
    rng = np.random.default_rng(5)
    rows = sorted((int(k), int(h)) for k, h in zip(rng.integers(0, 60, 150), rng.integers(0, 4, 150), strict=True))  # with repeated rows
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + size], strict=True)], ["key", "hash"]) for i in range(0, 150, size)]
    got = [tuple(r.values()) for b in P._met(batches) for r in b.to_pylist()]
    of = {k: sorted({h for x, h in rows if x == k}) for k, _ in rows}
    assert got == [(k, h, i) for k in sorted(of) if len(of[k]) > 1 for i, h in enumerate(of[k])]


def test_crowds_are_searched_in_blocks_without_a_lost_pair(spark):
    met = [(7, h, h) for h in range(25)] + [(8, h, h) for h in range(25)] + [(9, 50, 0), (9, 51, 1)]
    rows = P.groups_to_search(spark.createDataFrame(met, "key long, hash long, place long"), 10).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.group, set()).add(r.hash)
    # keys 7 and 8 have the same members and are searched once: three pairs of blocks, and the pair of key 9
    assert len(groups) == 4 and max(map(len, groups.values())) == 20
    assert all(any({a, b} <= g for g in groups.values()) for a in range(25) for b in range(a))


def test_a_crowd_of_variants_and_of_copies(spark, monkeypatch):
    monkeypatch.setattr(P, "CROWD", 50)
    head = " ".join(f"licence{i}" for i in range(40))
    rows = [(k, f"{head} year{k}" if k % 2 else head) for k in range(1200)]
    got = P.removals(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in got} == set(range(1, 1200)) and {r.kept_doc_id for r in got} == {0} and min(r.words for r in got) == 40


def test_odd_rows(spark, odd, none):
    got = {(r.doc_id, r.word_at, r.kept_doc_id) for r in P.removals(odd).collect()}
    long = {x for x in got if x[0] in (5, 6)}  # the long text repeats itself, too
    assert got - long == {(2, 0, 1)} and (6, 0, 5) in long and not any(d == 5 and at == 0 for d, at, _ in long)
    assert P.removals(none).count() == 0
    twice = spark.createDataFrame([(None, "a b c d"), (1, None), (2, ""), (3, "..."), (4, "a b c d"), (4, "a b c d"), (5, "A, b; c\nd")], SCHEMA)
    assert {(r.doc_id, r.word_at, r.word_to, r.kept_doc_id) for r in P.removals(twice, least=1).collect()} == {(5, 0, 4, 4)}


def test_what_a_task_has_met_is_held_in_a_bounded_table(spark):
    seen = P.Seen(64)
    some = np.arange(1, 41, dtype=np.uint64) * np.uint64(64) + np.arange(40, dtype=np.uint64)
    assert seen.add(some).all() and not seen.add(some).any()
    over = some + np.uint64(64)  # the same places
    assert seen.add(over).all() and seen.add(some).all() and len(seen.held) == 64
    assert seen.add(np.zeros(1, np.uint64)).all() and seen.add(np.zeros(1, np.uint64)).all()
    docs = spark.createDataFrame([(i, "\n".join(f"line {k} of some words" for k in range(i % 7 + 1))) for i in range(50)], "doc_id long, text string").coalesce(1)
    once = P.band_table(docs).collect()
    assert len(once) == len(set(once))  # a unit of several documents is sent once
