"""The pipeline's near-copy stage against all pairs' 5-word Jaccard similarity."""

from __future__ import annotations

import random

import pytest

from test_operators import prose

near_copies = pytest.importorskip("linkweave.llm.near_copies")


def shingle_set(t):
    words = (t or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def test_near_duplicates_stage_leaves_no_alike_texts(spark):
    import corpus_pipeline

    rng, texts = random.Random(7), []
    for k in range(25):
        base = prose(1000 + k, 120).split()
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 6):  # 3 edits: similarity of 0.8 or so; 6: below
            words = list(base)
            for at in rng.sample(range(len(words)), edits):
                words[at] = f"edited{k}x{at}"
            texts.append(" ".join(words))
    texts += [texts[0], None, None, "", "two words", "Two  words"]
    rows = [(len(texts) - k, t, "en", "s", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").select("doc_id").collect()
    kept = sorted(r.doc_id for r in left)
    sets = {i: shingle_set(t) for i, t, *_ in rows}
    assert not [(i, j) for i in kept for j in kept if i < j and alike(sets[i], sets[j])]
    # what went is joined by alike texts to one that stays, and ids stand for their groups
    group = {i: i for i in sets}
    for _ in sets:
        group = {i: min(group[j] for j in sets if alike(sets[i], sets[j])) for i in sets}
    assert {group[i] for i in kept} == set(group.values())


def test_signatures_find_pairs_at_the_limit():
    rng = random.Random(3)
    for _ in range(200):
        pool = [rng.getrandbits(64) for _ in range(90)]
        a, b = (near_copies.np.unique(near_copies.np.array(x, near_copies.np.uint64)) for x in (pool[:81], pool[9:]))
        assert near_copies._shared([a], [b])[0, 0] == 72
        assert set(near_copies.bands(a).tolist()) & set(near_copies.bands(b).tolist())


def test_tiles_find_what_first_sets_miss(spark):
    """Sets that are alike each to the next one only, in one bucket, over many tiles."""
    import numpy as np

    rng = np.random.default_rng(4)
    base = rng.integers(-(2**62), 2**62, 400)
    sets = [np.sort(np.concatenate([base[5 * k :], rng.integers(-(2**62), 2**62, 5 * k)])) for k in range(0, 40, 2)]
    rows = [(int(k), near_copies.np.int64(near_copies.np.uint64(near_copies.fingerprint(x.view(np.uint64)))).item(), x.tolist()) for k, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "s long, fp long, x array<long>")
    keyed = spark.createDataFrame([(k, 1) for k in range(len(sets))], "s long, key long")
    old, near_copies.TILE = near_copies.TILE, 4
    try:
        found = {(r.u, r.v) for r in near_copies._tiled(keyed, df, 4, 5).collect()}
    finally:
        near_copies.TILE = old
    want = {(a, b) for a in range(len(sets)) for b in range(a) if alike(set(sets[a].tolist()), set(sets[b].tolist()))}
    group = {k: k for k in range(len(sets))}
    for _ in sets:
        for a, b in want:
            group[a] = group[b] = min(group[a], group[b])
    near = {k: k for k in range(len(sets))}
    for _ in sets:
        for a, b in found:
            near[a] = near[b] = min(near[a], near[b])
    assert near == group and {tuple(sorted(p, reverse=True)) for p in found} <= want and len(set(group.values())) < len(sets)


def test_stage_goes_through_op9_and_tiles_by_population_counts(spark, monkeypatch):
    """op 9's links judge the sets that share buckets, and no tile pair beyond the radius is compared."""
    import corpus_pipeline
    import numpy as np

    rng, calls = np.random.default_rng(5), []
    links = near_copies.simhash_links
    monkeypatch.setattr(near_copies, "simhash_links", lambda fps, *a: calls.append(fps.count()) or links(fps, *a))
    base = prose(77, 300)
    docs = spark.createDataFrame([(1, base, "en", "s", 1), (2, base + " more", "en", "s", 1), (3, prose(78, 300), "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    left = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").select("doc_id").collect()
    assert sorted(r.doc_id for r in left) == [1, 3] and calls == [2]

    few, many = [(1 << k) - 1 for k in range(1, 5)], [-(1 << k) for k in range(1, 5)]  # 1 to 4 and 60 to 63 ones
    x = np.sort(rng.integers(0, 2**62, 40)).tolist()
    df = spark.createDataFrame([(k, fp, x) for k, fp in enumerate(few + many)], "s long, fp long, x array<long>")
    monkeypatch.setattr(near_copies, "TILE", 2)
    found = near_copies._tiled(spark.createDataFrame([(k, 1) for k in range(8)], "s long, key long"), df, 4, 5).collect()
    assert {(r.u < 4) == (r.v < 4) for r in found} == {True} and {k for r in found for k in (r.u, r.v)} == set(range(8))
