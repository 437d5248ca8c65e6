"""Operators on fixtures: nulls, empty and long texts, ties, repeated rows,
empty tables, clashing extra columns, hot groups."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assaymill.llm import chat, common, components, exact_dedup, html_extract, html_train, mixing, packing, shards, simhash, substrings, toxicity, vectors
from assaymill.llm.common import cut, release, shared_dir, stored

from .test_queries import removed, union_find

LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))
ODD = [(1, "a  b\tc", "x"), (2, "a b c", "x"), (3, None, None), (4, "", "y"), (5, LONG, "x"), (6, LONG + " end", None), (7, " a b c", "x"), (None, "no id", "y"), (8, "one", "x"), (8, "one", "x"), (9, "\u00a0 \u2028 İ ß <|endoftext|>", "z")]
#: Names that operators make themselves, as columns of the input.
CLASHES = ["size", "kept", "KEEP_ID", "shard", "slot", "score", "Text_Sha256", "item", "offset", "target", "fingerprint", "doc", "hash", "row"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    for c in CLASHES:
        df = df.withColumn(c, F.lit("mine"))
    return df.cache()


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def run_all(docs):
    return {
        "exact": exact_dedup.exact_dedup(docs), "exact kept": exact_dedup.kept_only(docs), "shards": shards.uniform_shards(docs, n_shards=3), "mix": mixing.mix(docs), "mixed": mixing.mixed_documents(docs),
        "simhash": simhash.simhash_groups(docs), "simhash kept": simhash.kept_only(docs), "substrings": substrings.substring_dedup(docs, with_text=True), "pack": packing.pack(docs),
        "toxicity": toxicity.score(docs, toxicity.fit([b"you idiot", b"a nice day", b"hello"], [True, False, False])),
    }


def test_odd_rows(odd):
    out = {k: df.collect() for k, df in run_all(odd).items()}
    n = len(ODD)
    for name in ("exact", "shards", "mix", "simhash", "substrings", "toxicity"):
        assert len(out[name]) == n, name
    exact = {(r.doc_id, r.text): r for r in out["exact"]}
    assert (exact[2, "a b c"].keep_id, exact[2, "a b c"].group_size, exact[2, "a b c"].kept) == (1, 2, False)
    assert exact[3, None].keep_id == 3 and exact[4, ""].keep_id == 3 and exact[7, " a b c"].kept and exact[None, "no id"].kept
    assert exact[8, "one"].group_size == 2 and sorted(x for x in (r.doc_id for r in out["exact kept"]) if x) == [1, 3, 5, 6, 7, 8, 9]
    sizes = sorted(len([r for r in out["shards"] if r.shard == s]) for s in range(3))
    assert sizes[-1] - sizes[0] <= 1
    mixed = {r.doc_id: r for r in out["mix"]}
    assert mixed[3]["size"] == 0 and mixed[5]["size"] == 60_000 and all(r.taken <= 2 * r["size"] for r in out["mix"])
    prints = {r.doc_id: r for r in out["simhash"]}
    assert prints[3].fingerprint == "0" * 16 and prints[4].component_id == 3 and prints[1].component_id == 1 and prints[7].component_id == 1
    cut_ = {r.doc_id: r for r in out["substrings"]}
    assert cut_[3].n_words == 0 and cut_[6].n_removed == 60_000 and cut_[6].kept_text == "end"
    assert sum(r.length for r in out["pack"] if r.doc_id == 4) == 1
    assert out["toxicity"][0].score is not None and "mine" in {r["size"] for r in out["toxicity"]}


def test_empty_tables(empty):
    for name, df in run_all(empty).items():
        assert df.count() == 0, name


def test_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = spark.range(10).where("id > 3")
    assert cut(df).count() == stored(df).count() == 6
    path = stored(df).inputFiles()[0].removeprefix("file://")
    # earlier frames of this module no longer read theirs
    assert os.path.exists(path) and release(spark) > 0 and not os.path.exists(path)


# ---------------------------------------------------------------- components, simhash
def test_components(spark):
    r = random.Random(3)
    n = 300
    links = [(r.randrange(n), r.randrange(n)) for _ in range(220)] + [(k, k + 1) for k in range(200, 299)]
    want = union_find(n, links)
    got = {x.node: x.component for x in components.components(spark.createDataFrame([*links, (None, 1), (7, 7)], "a long, b long")).collect()}
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {k: want[k] for k in touched}


def ball(r, base, n, most):
    out = set()
    while len(out) < n:
        x = base
        for _ in range(r.randint(0, most)):
            x ^= 1 << r.randrange(64)
        out.add(x)
    return out


def test_masks_are_the_ball_by_parity():
    for odd in (False, True):
        all_of = [m for lead in range(8) for m in simhash.masks(odd, lead)]
        assert len(all_of) == len(set(all_of)) == 65 + 992 * odd and max(m.bit_count() for m in all_of) == 1 + odd


@pytest.mark.parametrize("bits", [1, 3])
def test_links_connect_what_all_pairs_connect(spark, bits):
    """Balls, clusters and lone fingerprints: the components of all pairs."""
    r = random.Random(bits)
    prints = set().union(*(ball(r, r.getrandbits(64), 40, m) for m in (2, 3, 5, 9)), {r.getrandbits(64) for _ in range(60)}, {0, 1 << 63, (1 << 64) - 1})
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    want = union_find(len(prints), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3])
    found = simhash.links(spark.createDataFrame([(s,) for s in signed], "_am_fp long"), bits).collect()
    at = {s: k for k, s in enumerate(signed)}
    assert all((prints[at[x.a]] ^ prints[at[x.b]]).bit_count() <= 3 for x in found)
    assert union_find(len(prints), [(at[x.a], at[x.b]) for x in found]) == want


# ---------------------------------------------------------------- substrings
def test_cover():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


@given(st.lists(st.integers(0, 2**64 - 1), max_size=60), st.integers(1, 25))
def test_window_hashes_are_of_their_items(items, width):
    h = np.array(items, np.uint64)
    out = substrings.window_hashes(h, width)
    assert len(out) == max(0, len(items) - width + 1)
    for k in range(len(out)):
        assert out[k] == substrings.window_hashes(h[k : k + width], width)[0]


@pytest.mark.parametrize("window", [13, 20, 27])
def test_substrings_brute_force(spark, window, monkeypatch):
    """Copied passages, self-repeats, periodic texts and whole copies, in many
    small batches."""
    r = random.Random(window)
    passages = [[r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.randint(10, 70))] for _ in range(6)]
    texts = {}
    for i in range(120):
        w = []
        for _ in range(r.randint(0, 4)):
            w += r.choice(passages)[r.randint(0, 8) :] if r.random() < 0.5 else [f"u{r.randrange(10**6)}" for _ in range(r.randint(0, 30))]
        texts[i] = w
    texts[120], texts[121] = ["p"] * 80, ["p", "q"] * 40
    texts[122] = texts[5] = texts[60]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(5)
    got = {g.doc_id: (g.n_words, g.n_removed, g.kept_sha256) for g in substrings.substring_dedup(df, window=window).collect()}
    assert got == removed({i: [x.encode() for x in w] for i, w in texts.items()}, window)
    # a sieve so full that nearly every text passes it
    monkeypatch.setattr("assaymill.llm.common.SIEVE_BITS", 6)
    assert {g.doc_id: (g.n_words, g.n_removed, g.kept_sha256) for g in substrings.substring_dedup(df, window=window).collect()} == got


# ---------------------------------------------------------------- packing
@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80))
def test_best_fit(sizes):
    bins = packing.best_fit(sizes, 100)
    fill = {}
    for s, b in zip(sizes, bins):
        fill[b] = fill.get(b, 0) + s
    assert all(f <= 100 for f in fill.values()) and sorted(fill) == list(range(len(fill)))
    assert sum(f <= 50 for f in fill.values()) <= 1


def test_rounds_merge_residuals(spark):
    """Many small groups: later rounds merge their underfull bins, whole."""
    r = random.Random(2)
    rows = [(i, k, 0, r.choice([3, 9, 30, 64, 100]), i) for i in range(900) for k in range(2)]
    pieces = spark.createDataFrame(rows, "doc long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack_pieces(pieces, 100, items_per_group=40).collect()
    assert sorted((x.doc, x.piece, x.length) for x in out) == sorted((a, b, d) for a, b, _, d, _ in rows)
    bins = {}
    for x in out:
        bins.setdefault(x.item, []).append((x.offset, x.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100
    one_group = len({x.item for x in packing.pack_pieces(pieces, 100, items_per_group=10**6).collect()})
    assert len(bins) <= 1.1 * one_group


ALPHABET = "abcdeABC'’.!-_ \t\n\x1c\x85 éÉß´́ñ漢字٣12²ªº½ʼΣσςİ🙂<>|"


@pytest.mark.parametrize("slab", [40, packing.SLAB])
@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(ALPHABET, max_size=120), max_size=6))
def test_piece_tokens_are_the_texts_tokens(slab, monkeypatch, texts):
    """Batches, contractions, special tokens, and texts cut in slabs."""
    monkeypatch.setattr(packing, "SLAB", slab)
    known = packing._KNOWN.setdefault(packing.default_tokenizer(), packing.PieceTokens(packing.default_tokenizer()))
    column = pa.array(["before", *texts], pa.string()).cast(pa.binary()).slice(1)
    got = [ids.tobytes() for at, n in packing._slabs(column) for ids in packing.token_ids(column.slice(at, n), known)]
    assert got == [known.whole(t) for t in texts]


def test_cutting_takes_little_memory_beside_the_text():
    """Ids of 12 MB of known words, within 80 MB of arrays."""
    import tracemalloc

    r = random.Random(2)
    words = [f"w{k}" for k in range(3000)]
    column = pa.array([" ".join(r.choices(words, k=1000)).encode() for _ in range(2500)], pa.binary())
    known = packing.PieceTokens(packing.default_tokenizer())
    known.ids(np.frombuffer(" ".join(words).encode(), np.uint8), np.array([0, len(" ".join(words))]))
    tracemalloc.start()
    try:
        n = sum(len(ids) for at, m in packing._slabs(column) for ids in packing.token_ids(column.slice(at, m), known))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n > 2_500_000 and peak < 80 << 20


def test_tasks_give_freed_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    run = common.tidy(lambda batches: (b + 1 for b in batches))
    assert list(run(iter([1, 2]))) == [2, 3] and len(calls) == 1
    part = run(iter([1, 2]))
    assert next(part) == 2 and len(calls) == 1
    part.close()
    assert len(calls) == 2


def test_the_driver_sweeps_a_heap_past_half_its_limit():
    from types import SimpleNamespace as Some

    calls = []
    jvm = lambda taken: Some(Runtime=Some(getRuntime=lambda: Some(totalMemory=lambda: taken, maxMemory=lambda: 100)), System=Some(gc=lambda: calls.append(taken)))
    for taken in (40, 60):
        common.sweep(Some(_jvm=jvm(taken)))
    assert calls == [60]


def test_the_driver_is_swept_while_a_table_is_computed(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(common, "WATCH_S", 0.05)
    monkeypatch.setattr(common, "sweep", lambda s: calls.append("sweep"))
    monkeypatch.setattr(common, "trim", lambda s: calls.append("trim") or True)
    slow = spark.range(2, numPartitions=1).selectExpr("id", "reflect('java.util.concurrent.locks.LockSupport', 'parkNanos', 700000000L) as n")
    for compute in (common.stored, common.cut):
        calls.clear()
        assert compute(slow).count() == 2
        assert calls.count("trim") > 2 and calls.count("sweep") > 1 and calls[-2:] == ["sweep", "trim"]


def test_the_drivers_jvm_gives_native_memory_back(spark, monkeypatch):
    from types import SimpleNamespace as Some

    from py4j.protocol import Py4JError

    def unknown(name):
        raise Py4JError(name)

    asked = Some(_jvm=Some(java=Some(lang=Some(Class=Some(forName=unknown)))), sparkContext=Some(_gateway=Some(new_array=lambda kind, n: [None] * n)))
    asked._jvm.java.lang.Object = None
    assert common.trim(asked) is False
    since = spark._jvm.java.lang.Runtime.version().feature()
    assert common.trim(spark) is True or since < 17 or not spark._jvm.System.getProperty("os.name").startswith("Linux")


def test_forgotten_pieces_are_learnt_again(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 1000)
    known = packing.PieceTokens(packing.default_tokenizer())
    for k in range(30):
        texts = [f"word{j}a{k % 3}b don't Ünï{j}x, ..." for j in range(10)]
        column = pa.array([t.encode() for t in texts], pa.binary())
        assert [i.tobytes() for i in packing.token_ids(column, known)] == [known.whole(t) for t in texts]
    assert len(known.known) + len(known.older) < 120


def test_sizes_that_hardly_merge_keep_their_groups(spark):
    """Pieces of more than half a sequence: no task gets them all."""
    rows = [(i, 0, 0, 51 + i % 40, i) for i in range(2000)]
    pieces = spark.createDataFrame(rows, "doc long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack_pieces(pieces, 100, items_per_group=100)
    got = out.collect()
    assert len(got) == len({r.item for r in got}) == 2000 and sorted(r.doc for r in got) == list(range(2000))
    per_group = out.groupBy(F.expr("shiftright(item, 32)")).count().agg(F.max("count")).first()[0]
    assert per_group <= 300


def test_sequences_hold_the_ids(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "gamma " * 3000), (3, None), (3, None)], "doc_id long, text string")
    whole = sorted(len(r.ids) for r in packing.sequences(df).collect())
    assert sum(whole) == sum(r.length for r in packing.pack(df).collect()) and whole[-1] == 2048


# ---------------------------------------------------------------- mixing, shards
def test_hot_source_crosses_slices(spark):
    rows = [(i, "w " * (1 + i % 50), "hot" if i % 3 else f"s{i % 4}") for i in range(3000)] + [(9999, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, rows_ordered=64).collect()
    source = {r[0]: r[2] for r in rows}
    per = {}
    for r in out:
        of = per.setdefault(source[r.doc_id], [0, r.target, 0])
        of[0] += r.taken
        of[2] = max(of[2], r["size"])
    for taken, target, largest in per.values():
        assert abs(taken - target) <= largest / 2 + 1
    copies = mixing.mixed_documents(df, rows_ordered=64).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in copies} == {r.doc_id: r.taken // r["size"] for r in out if r.taken}


def test_weights_bring_documents_forward(spark):
    df = spark.createDataFrame([(i, "w " * 10, "a") for i in range(4000)], "doc_id long, text string, source string")
    heavy = F.when(F.col("doc_id") % 2 == 0, 9.0).otherwise(1.0)
    out = mixing.mix(df, weight=heavy, share=0.3).collect()
    even = sum(r.taken for r in out if r.doc_id % 2 == 0)
    assert even > 5 * sum(r.taken for r in out if r.doc_id % 2)


def test_communication_matrix():
    m = shards.communication_matrix([5, 0, 17, 8], [10, 10, 10], 1)
    assert m.sum(axis=1).tolist() == [5, 0, 17, 8] and m.sum(axis=0).tolist() == [10, 10, 10]
    rng = np.random.default_rng(0)
    small = [shards.hypergeometric(rng, 3_000_000_000, 1_000_000_000, 1000) for _ in range(300)]
    assert abs(np.mean(small) - 750) < 4 and 8 < np.std(small) < 20


def test_shards_are_uniform(spark):
    df = spark.range(4000).withColumnRenamed("id", "doc_id")
    out = shards.uniform_shards(df, n_shards=4, rows_per_partition=200).collect()
    low = sum(r.shard == 0 and r.doc_id < 2000 for r in out)
    assert 440 < low < 560 and sorted(r.slot for r in out if r.shard == 1) == list(range(1000))
    assert abs(np.corrcoef([r.slot for r in out], [r.doc_id for r in out])[0, 1]) < 0.06


# ---------------------------------------------------------------- vectors
def test_near_vectors_with_odd_rows(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(12, 16))
    rows = []
    for k in range(400):
        v = base[k % 12] + r.normal(size=16) * (0.02 if k % 3 else 0.6)
        rows.append((k, v.tolist(), k % 2))
    rows += [(400, rows[0][1], 0), (401, [x * 3 for x in rows[0][1]], 0), (402, None, 0), (403, [0.0] * 16, 0), (404, [1.0, None] + [0.0] * 14, 0), (405, [float("nan")] * 16, 0), (406, rows[0][1], None), (407, [1.0, 2.0], 0), (408, [], 0), (0, rows[0][1], 0), (409, [1e-200] * 16, 0), (410, [1e200] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("uid", F.lit(1)).withColumn("list", F.lit(2))
    good = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v))]
    unit = {k: vectors.units_of(np.array([rows[k][1]], np.float64))[0] for k in good}
    links = [(a, b) for a in good for b in good if a != b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= 0.98]
    part = union_find(len(rows), links)
    n = np.bincount([a for a, _ in links], minlength=len(rows))
    least = {}
    for k in range(len(rows)):
        least[part[k]] = min(least.get(part[k], 10**9), rows[k][0])
    want = sorted((rows[k][0], int(n[k]), least[part[k]]) for k in range(len(rows)))
    for tile in (16, 2048):
        vectors.TILE = tile
        assert sorted((x.vec_id, x.n_links, x.component_id) for x in vectors.near_vectors(df).collect()) == want
    assert len(links) > 1000
    assert vectors.near_vectors(df.where("false")).count() == 0 and vectors.near_vectors(df.where("vec_id = 402")).first().kept


# ---------------------------------------------------------------- html
def test_labeller_on_new_pages():
    right, whole = html_train.accuracy(html_extract.Labeller.load(), 300, seed=1234)
    assert right > 0.99 and whole > 0.85


@settings(max_examples=200, deadline=None)
@given(st.text("<>/=\"'!-&;abp div script\n\x00é", max_size=80))
def test_any_markup_parses(page):
    for b in html_extract.blocks(page):
        assert b.text and b.text == " ".join(b.text.split())


def test_html_rows(spark):
    page = "<html><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One  two\nthree &copy;. It was a long story, told well.<p>Next<br>line of the story, told again.</article><footer>&copy; 2020</footer>"
    df = spark.createDataFrame([(1, "u", page, "x"), (2, "u", None, "x"), (3, "u", "", "x"), (4, "u", "<", "x"), (1, "u", page, "x")], "page_id long, url string, html string, TEXT string")
    out = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert out[1].text == "A & B\n\nOne two three ©. It was a long story, told well.\n\nNext line of the story, told again."
    assert (out[2].text, out[3].n_chars) == ("", 0) and html_extract.extract(df).count() == 5


def test_training_learns():
    made = html_train.train(pages=250, epochs=3, tell=lambda _: None)
    assert html_train.accuracy(made, 60)[0] > 0.9


# ---------------------------------------------------------------- toxicity
def gapped_kernel(a, b):
    """The kernel by its definition."""
    import itertools

    def features(word):
        s = [0, *[int(toxicity._SYMBOL[c]) for c in word], 31]
        out = {}
        for p in (3, 4):
            for at in itertools.combinations(range(len(s)), p):
                if at[-1] - at[0] + 1 - p <= toxicity.GAP:
                    key = tuple(s[k] for k in at)
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1 - p)
        return out, toxicity._norm(len(s))

    (x, nx), (y, ny) = features(a), features(b)
    return sum(v * y[k] for k, v in x.items() if k in y) / nx / ny


def test_kernel_is_its_definition():
    words = [b"idiot", b"idxiot", b"idot", b"a", b"", b"banana", b"worthless"]
    got = toxicity.kernel(words, [b"idiot", b"banana"])
    for k, w in enumerate(words):
        assert got[k] == pytest.approx([gapped_kernel(w, b"idiot"), gapped_kernel(w, b"banana")], rel=1e-5, abs=1e-7)


def test_insults_survive_disguise():
    r = random.Random(0)
    syllables = "ka lo mi ne ru sa to ve".split()
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    insults = ["grubnik", "stinkard", "zwoble"]
    texts, labels = [], []
    for k in range(500):
        w = [word() for _ in range(r.randint(5, 40))]
        if k % 5 == 0:
            w[r.randrange(len(w))] = r.choice(insults)
        texts.append(" ".join(w).encode())
        labels.append(k % 5 == 0)
    model = toxicity.fit(texts, labels)
    scores = toxicity.Scorer(model).scores
    assert (scores([f"kalo {i} mine".encode() for i in insults]) >= 0.3).all()
    assert (scores([b"so GRUBNIK!", b"g.r.u.b.n.i.k", b"st1nkard", b"grubbnik", b"s t i n k a r d"]) >= 0.3).all()
    assert (scores([b"kalo mine ruto", b"", b"12 34"]) < 0.3).all()


def test_toxicity_without_labels():
    for texts, labels in (([], []), ([b"a"], [True]), ([b"a", b"b"], [False, False]), ([b"", b""], [True, False])):
        assert np.isfinite(toxicity.Scorer(toxicity.fit(texts, labels)).scores([b"", b"abc", LONG.encode()])).all()


def test_fit_leaves_held_out_rows_alone(spark):
    labels = spark.createDataFrame([(i, 1) for i in range(100)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    import zlib

    kept = labels.where(~toxicity.held_out()).where("doc_id is not null").select("doc_id").distinct().collect()
    assert {r.doc_id for r in kept} == {i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2}


# ---------------------------------------------------------------- chat
TEXTS = st.text(st.sampled_from("\\#</turn>|: \nab:é\ud83d\ude00".replace("\ud83d\ude00", "🙂")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), TEXTS), TEXTS), max_size=5))
def test_chat_round_trip(turns):
    made = [chat.format_turn(role, [chat.Text(text)]) for role, text in turns]
    assert chat.read_back("".join(t.formatted for t in made)) == turns
    for (_, text), t in zip(turns, made):
        assert chat.unescape(t.formatted[t.start : t.start + t.length]) == text


def test_parts(spark):
    rows = [(1, 1, "user", [("text", "see <|image:9|>", None, None, None, None, None), ("image", None, "a.png", 56, 29, None, None), ("audio", None, "b.wav", None, None, 1.5, None), ("document", None, "c.pdf", None, None, None, 3), None]), (1, 2, "assistant", None)]
    out = chat.format_turns(spark.createDataFrame(rows, f"conv_id long, turn long, role string, text {chat.PARTS}")).orderBy("turn").collect()
    assert out[0].formatted == "### user: see \\<|image:9|><|image:0|><|audio:1|><|document:2|></turn>\n"
    assert [tuple(a) for a in out[0].attachments] == [(0, "image", "a.png", 4), (1, "audio", "b.wav", 38), (2, "document", "c.pdf", 1536)] and out[0].attachment_tokens == 1578
    assert chat.read_back(out[0].formatted) == [("user", "see <|image:9|><|image:0|><|audio:1|><|document:2|>")]
    with pytest.raises(ValueError):
        chat.part_of({"type": "video"})


def test_conversations(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, None, None), (1, None, "user", "first"), (None, 1, "user", "x"), (2, 1, "user", "same"), (2, 1, "user", "same"), (3, 1, "assistant", LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("mine"))
    out = {r.conv_id: r for r in chat.conversation_digests(df).collect()}
    assert (out[1].n_turns, out[2].n_turns, out[None].n_turns, out[3].loss_chars) == (3, 2, 1, len(LONG))
    assert chat.conversation_digests(df.where("false")).count() == 0
