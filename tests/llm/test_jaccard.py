"""Near copies by similarity of word shingles against all pairs."""

import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

import corpus_pipeline
from assaymill.llm import jaccard, simhash

from .test_queries import union_find


def alike(a: bytes, b: bytes) -> bool:
    x, y = (set(jaccard.shingles(t).tolist()) for t in (a, b))
    return 5 * len(x & y) >= 4 * len(x | y)


def brute(rows):
    texts = [(t or "").encode() for _, t in rows]
    part = union_find(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if alike(texts[a], texts[b])])
    return [rows[p][0] for p in part]


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
    return " ".join(words)


@given(st.sets(st.integers(0, 40), min_size=1), st.sets(st.integers(0, 40), min_size=1), st.sets(st.integers(0, 40)))
def test_similar_sets_share_a_prefix(a, b, often):
    of, least = [np.array(sorted(x), np.uint64) for x in (a, b)], Fraction(4, 5)
    order = np.array(sorted(often), np.uint64)
    counts = np.arange(len(often))[::-1] + 3
    if 5 * len(a & b) >= 4 * len(a | b):
        assert set.intersection(*(set(jaccard.prefix(x, least, order, counts).tolist()) for x in of))


@given(st.sets(st.integers(0, 2**64 - 1)), st.sets(st.integers(0, 2**64 - 1)), st.sets(st.integers(0, 2**64 - 1)))
def test_marks_differ_in_no_more_bits_than_sets_in_hashes(a, b, both):
    x, y = (jaccard.marks(np.array(sorted(s | both), np.uint64)) for s in (a, b))
    assert (x ^ y).bit_count() <= len((a | both) ^ (b | both))


@pytest.mark.parametrize("pairwise", [2, 32])
def test_groups_brute_force(spark, pairwise):
    """Chains, a large cluster about the bound, common lines, odd texts."""
    r = random.Random(pairwise)
    new = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    base, line = new(120), new(30)
    texts = [edited(r, base, r.randint(0, 4)) for _ in range(70)] + [" ".join(line + new(r.randint(3, 40))) for _ in range(60)]
    for _ in range(20):
        words = new(r.randint(5, 200))
        for _ in range(3):
            texts += [" ".join(words), words[0].upper() + " " + " ".join(words[1:])]
            words = edited(r, words, r.randint(1, 3)).split()
    texts += [None, "", " \n", "one", "One", "one two three four", "one two three four five", "one one one one one one one"]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    got = {x.doc_id: x.component_id for x in jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), pairwise=pairwise).collect()}
    assert [got[k] for k, _ in rows] == brute(rows)


def test_stage_drops_near_copies_that_differ_in_many_bits(spark):
    r = random.Random(1)
    words = [f"w{k}" for k in range(150)]
    rows = [(1, " ".join(words), "en", "web", 1), (2, edited(r, words, 2), "en", "web", 1), (3, edited(r, words, 40), "en", "web", 1), (4, None, None, None, None)]
    assert (simhash.fingerprint(rows[0][1].encode()) ^ simhash.fingerprint(rows[1][1].encode())).bit_count() > 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 3, 4]


def test_odd_tables(spark):
    rows = [(None, "a b c"), (2, "A b  c"), (2, "A b  c"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((x.doc_id or 0, x.component_id) for x in jaccard.jaccard_groups(docs).collect()) == [(0, 2), (2, 2), (2, 2), (3, 3), (4, 3)]
    kept = lambda d: simhash.kept_only(d, shingle=5, similarity=0.8)
    assert sorted(x.doc_id for x in kept(docs).collect()) == [2, 3]
    assert kept(docs.where("false")).count() == 0


def differ(a, b):
    return (simhash.fingerprint(a.encode(), 5) ^ simhash.fingerprint(b.encode(), 5)).bit_count()


def test_stage_links_by_the_balls_and_checks_them(spark, monkeypatch):
    """Within 3 bits and similar: linked by SimHash; within 3 bits and not
    similar: apart; similar beyond 3 bits: linked by what follows."""
    r = random.Random(4)
    words = [f"w{k}" for k in range(2000)]
    close = next(t for t in (edited(r, words, 3) for _ in range(1000)) if 1 <= differ(" ".join(words), t) <= 3)
    loop, tail = " ".join(["a b c d e"] * 400), lambda at: " ".join(f"t{at + k}" for k in range(12))
    some = [f"v{k}" for k in range(150)]
    texts = [" ".join(words), close, f"{loop} {tail(0)}", f"{loop} {tail(50)}", " ".join(some), edited(r, some, 2)]
    assert alike(texts[0].encode(), texts[1].encode())
    assert differ(*texts[2:4]) <= 3 and not alike(texts[2].encode(), texts[3].encode())
    assert differ(*texts[4:]) > 3 and alike(texts[4].encode(), texts[5].encode())
    docs = spark.createDataFrame([(k, t, "en", "web", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    near, rest = [], []
    by_balls, others = simhash.links, jaccard.rest
    monkeypatch.setattr(simhash, "links", lambda *a, **k: near.append(by_balls(*a, **k)) or near[-1])
    monkeypatch.setattr(jaccard, "rest", lambda *a: rest.append((a[1], others(*a))) or rest[-1][1])
    assert sorted(x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [0, 2, 3, 4]
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    assert frozenset(signed(simhash.fingerprint(t.encode(), 5)) for t in texts[:2]) in {frozenset((x.a, x.b)) for x in near[0].collect()}
    sets = [signed(jaccard.signature(jaccard.shingles(t.encode()))) for t in texts]
    ends = lambda links: {frozenset((x.a, x.b)) for x in links.collect()}
    assert ends(rest[0][0]) == {frozenset(sets[:2])}
    assert ends(rest[0][1]) == {frozenset(sets[4:])}


def test_balls_connect_all_fingerprints_within_three_bits(spark):
    r = random.Random(6)
    words = [f"w{k}" for k in range(800)]
    texts = [edited(r, words, r.randint(0, 3)) for _ in range(40)] + ["one two", "One  two", "", "x y z"]
    rows = spark.createDataFrame([(k, 0, bytearray(t.encode())) for k, t in enumerate(texts)], "_am_id long, _am_tie long, _am_text binary")
    none = np.empty(0, np.uint64)
    sets = jaccard._sets(rows, 5, Fraction(4, 5), none, none).cache()
    of = {x._am_id: x._am_fp for x in sets.collect()}
    names = sorted(set(of.values()))
    at = {n: k for k, n in enumerate(names)}
    want = union_find(len(names), [(at[of[a]], at[of[b]]) for a in of for b in range(a) if differ(texts[a], texts[b]) <= 3 and texts[a].split() and texts[b].split()])
    got = union_find(len(names), [(at[x.a], at[x.b]) for x in jaccard.near(sets).collect()])
    assert got == want and len(set(want)) < len(names)
