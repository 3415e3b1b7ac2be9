"""near_copies against exact Jaccard components of five-word shingles, where the single stages could lose a link."""

import inspect

import numpy as np

from emberlog.llm import simhash


def exact(texts):
    """The least index of each text's component: Jaccard of the sets of shingles at 0.8 or more."""
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) or {t} for t in texts]
    least = list(range(len(texts)))

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                least[y] = x
    return [find(k) for k in range(len(texts))]


def components(spark, texts, **options):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(frame, **options).collect()}
    return [got[k] for k in range(len(texts))]


def test_large_borderline_groups(spark):
    rng = np.random.default_rng(11)
    texts = []
    for g in range(12):
        base = [f"g{g}w{x}" for x in range(300)]
        for k in range(24):  # three changes against three qualify (0.82), three against four don't (0.79)
            v = list(base)
            for at in rng.choice(60, 3 + k % 2, replace=False):
                v[5 * at] = f"new{g}x{k}x{at}"
            texts.append(" ".join(v))
    want = exact(texts)
    assert components(spark, texts) == want
    assert components(spark, texts, group_limit=7) == want


def test_shared_counts():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 3000, n).astype(np.uint32)) for n in rng.integers(0, 2500, 40)]
    i, j = np.triu_indices(len(sets), 1)
    want = [len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in zip(i, j, strict=True)]
    assert simhash.shared_counts(sets, i, j).tolist() == want
    assert simhash.shared_counts(sets, i[:50], j[:50]).tolist() == want[:50]


def test_radius_loses_no_short_text():
    radius = inspect.signature(simhash.near_copies).parameters["radius"].default
    for words in (8, 12, 40):  # one word appended: a similarity of 0.8 and more
        for k in range(300):
            text = [f"t{k}w{x}" for x in range(words)]
            a, b = (simhash.sketch(" ".join(t).encode())[0] for t in (text, [*text, "more"]))
            assert np.bitwise_count(a ^ b).sum() <= radius


def test_repeats_change_no_sketch():
    line = [f"w{x}" for x in range(100)]
    once, often = (simhash.sketch(" ".join(line * k).encode()) for k in (2, 9))
    assert all((a == b).all() for a, b in zip(once, often, strict=True))
    boiler = "one line that stands here again and again".split()
    a, b = (simhash.sketch(" ".join(line + boiler * k).encode()) for k in (2, 40))
    assert (a[2] == b[2]).all() and (a[0] == b[0]).all()
