"""Each pipeline stage against a brute-force version on its own input."""

import numpy as np
import pytest

import corpus_pipeline
from assaymill.llm import jaccard, toxicity

from .test_queries import targets, union_find

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        out.append(docs.collect())
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "mixing", "packing"]
    for rows in stages[:-1]:
        assert set(rows[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}


def test_toxic_go(spark, stages):
    model = toxicity.fit_on(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = toxicity.Scorer(model).scores([(r.text or "").encode() for r in stages[0]])
    assert sorted(r.doc_id for r in stages[1]) == sorted(r.doc_id for r, s in zip(stages[0], scores) if s < toxicity.THRESHOLD)


def test_copies_go(stages):
    import re

    least = {}
    for r in stages[1]:
        key = re.sub(r"[\x20\x09-\x0d]+", " ", r.text or "")
        least[key] = min(least.get(key, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in stages[2]) == sorted(least.values())


def test_near_copies_go(stages):
    """All pairs by the similarity of their sets of five-word shingles."""
    rows = sorted(stages[2], key=lambda r: r.doc_id)
    sets = [set(jaccard.shingles((r.text or "").encode()).tolist()) for r in rows]
    near = lambda x, y: 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y)
    part = union_find(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if near(sets[a], sets[b])])
    assert sorted(r.doc_id for r in stages[3]) == [rows[k].doc_id for k in sorted(set(part))]


def test_mix_meets_targets(stages):
    size, taken, largest = {}, {}, {}
    for r in stages[3]:
        n = len((r.text or "").encode().split())
        size[r.source] = size.get(r.source, 0) + n
        largest[r.source] = max(largest.get(r.source, 0), n)
    for r in stages[4]:
        taken[r.source] = taken.get(r.source, 0) + len((r.text or "").encode().split())
    for s, t in targets(size).items():
        assert abs(taken.get(s, 0) - t) <= largest[s] / 2 + 1


def test_packing_is_whole(stages):
    by = {}
    for r in stages[5]:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist()
    starts = sum(r.piece == 0 for r in stages[5])
    assert starts == len(stages[4])


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, got)) == sorted(map(key, stages[5]))
