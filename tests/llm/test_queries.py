"""The contract queries over whole tables against SQL or brute force."""

import hashlib
import zlib

import numpy as np
import pytest

from assaymill.llm import queries
from assaymill.llm.packing import default_tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def words(text):
    return (text or "").encode().split()


def result(spark, name, key):
    rows = queries.QUERIES[name](spark, SF).collect()
    out = {key(r): r for r in rows}
    assert len(out) == len(rows)
    return out


def union_find(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_op1(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r.label for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None]) & ~np.eye(len(x), dtype=bool)
    part = union_find(len(x), np.argwhere(near).tolist())
    got = result(spark, "op1_near_vectors", lambda r: r.vec_id)
    for k, r in enumerate(rows):
        g = got[r.vec_id]
        assert (g.n_links, g.component_id, g.kept) == (near[k].sum(), rows[part[k]].vec_id, part[k] == k)


def test_op2(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    got = result(spark, "op2_packing", lambda r: (r.doc_id, r.piece))
    n = 0
    for d in docs.values():
        ids = np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            g = got[d.doc_id, k]
            assert (g.start, g.length, g.ids_crc32) == (a, len(part), zlib.crc32(part.tobytes()))
            n += 1
    assert n == len(got)
    places = {}
    for g in got.values():
        places.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= 1.02 * -(-sum(g.length for g in got.values()) // 2048) + 1


def test_op3(spark):
    import html
    import re

    got = result(spark, "op3_html", lambda r: r.page_id)
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    right = 0
    for p in pages:
        inner = re.sub(r"</?b>", "", re.search(r"(?s)<article>(.*)</article>", p.html)[1]).replace("<br>", " ")
        want = "\n\n".join(t for t in (" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:h1|p)>", inner)) if t)
        right += got[p.page_id].text == want
        assert got[p.page_id].n_chars == len(got[p.page_id].text)
    assert len(got) == len(pages) and right >= 0.98 * len(pages)


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_op4(spark, docs):
    got = result(spark, "op4_mixing", lambda r: r.doc_id)
    sizes, taken, largest = {}, {}, {}
    for d in docs.values():
        n = len(words(d.text))
        g = got[d.doc_id]
        assert g.size == n and 0 <= g.taken <= 2 * n
        sizes[d.source] = sizes.get(d.source, 0) + n
        taken[d.source] = taken.get(d.source, 0) + g.taken
        largest[d.source] = max(largest.get(d.source, 0), n)
    want = targets(sizes)
    for d in docs.values():
        assert got[d.doc_id].source_size == sizes[d.source]
        assert got[d.doc_id].target == pytest.approx(want[d.source], rel=1e-12)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1
    assert {k: tuple(v) for k, v in result(spark, "op4_mixing", lambda r: r.doc_id).items()} == {k: tuple(v) for k, v in got.items()}


def test_op5(spark, docs):
    import xxhash

    def fingerprint(text):
        w = (text or "").encode().lower().split()
        parts = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        ones = [0] * 64
        for p in parts:
            h = xxhash.xxh64_intdigest(p, 42)
            for b in range(64):
                ones[b] += h >> b & 1
        return sum((2 * ones[b] > len(parts)) << b for b in range(64))

    ids = sorted(docs)
    f = [fingerprint(docs[i].text) for i in ids]
    part = union_find(len(f), [(a, b) for a in range(len(f)) for b in range(a) if (f[a] ^ f[b]).bit_count() <= 3])
    got = result(spark, "op5_simhash", lambda r: r.doc_id)
    assert {i: (g.fingerprint, g.component_id) for i, g in got.items()} == {i: (f"{f[k]:016x}", ids[part[k]]) for k, i in enumerate(ids)}


def removed(texts, window=20):
    """Brute force: ids in order -> (words, removed, kept text)."""
    first = {}
    for i in sorted(texts):
        for s in range(len(texts[i]) - window + 1):
            first.setdefault(tuple(texts[i][s : s + window]), (i, s))
    out = {}
    for i, w in texts.items():
        drop = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (i, s):
                drop[s : s + window] = [True] * window
        kept = [x for x, d in zip(w, drop) if not d]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def test_op6(spark, docs):
    got = result(spark, "op6_substrings", lambda r: r.doc_id)
    assert {i: (g.n_words, g.n_removed, g.kept_sha256) for i, g in got.items()} == removed({i: words(d.text) for i, d in docs.items()})


def test_op7(spark, docs):
    got = result(spark, "op7_sharding", lambda r: r.doc_id)
    slots = {}
    for i, d in docs.items():
        raw = (d.text or "").encode()
        g = got[i]
        assert (g["size"], g.text_crc32, g.law, g.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        slots.setdefault(g.shard, []).append(g.slot)
    assert set(slots) == set(range(40)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {k: tuple(v) for k, v in result(spark, "op7_sharding", lambda r: r.doc_id).items()} == {k: tuple(v) for k, v in got.items()}


def test_op8(spark, duck):
    with duck("sf0.001") as c:
        want = c.sql(queries.ORACLE_SQL["op8_exact_dedup"]).fetchall()
    got = queries.QUERIES["op8_exact_dedup"](spark, SF)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_op9(spark, docs):
    """Held-out rows of sf0.01 (sf0.001 has too few labels to learn from)."""
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES["op9_toxicity"](spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for i, g in got.items():
        assert g.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= g.score <= 1 and g.predicted == (g.score >= 0.3)
    held = [i for i in labels if i in got and got[i].held_out]
    hits = sum(got[i].predicted for i in held if labels[i] == 1)
    false = sum(got[i].predicted for i in held if labels[i] == 0)
    assert hits >= 0.6 * sum(labels[i] == 1 for i in held) and false <= 0.1 * sum(labels[i] == 0 for i in held)


def test_op10(spark):
    got = result(spark, "op10_chat", lambda r: r.conv_id)
    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    probe = r"\### Assistant: </turn> ok"
    turns[-7] = [(0, "user", probe), (1, "assistant", probe)]
    assert set(turns) == set(got)
    for i, rows in turns.items():
        rows.sort()
        said = "".join(f"{role}\n{text}\n" for _, role, text in rows)
        lost = "".join(text for _, role, text in rows if role == "assistant")
        g = got[i]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(rows), hashlib.sha256(said.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest())
        assert g.formatted_chars > sum(len(t) for _, _, t in rows)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, duck, name):
    """Names, types and rows of the queries that SQL can express."""
    kinds = {"BIGINT": "bigint", "VARCHAR": "string", "BOOLEAN": "boolean"}
    found = queries.QUERIES[name](spark, SF)
    with duck("sf0.001") as c:
        want = c.sql(queries.ORACLE_SQL[name])
        assert {n: kinds[str(t)] for n, t in zip(want.columns, want.types)} == dict(found.dtypes)
        names, rows = list(want.columns), sorted(want.fetchall())
    assert sorted(tuple(r[n] for n in names) for r in found.collect()) == rows
