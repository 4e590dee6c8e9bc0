"""Near copies against brute force: isolated pairs near the threshold, groups like chains, large postings, equal fingerprints of unlike texts."""

import random

import numpy as np
import pytest

from tessera.llm.minhash import classes, fingerprint_pairs, shingles
from tessera.llm.simhash import candidates, fingerprint, near_duplicates


def jaccard(x, y):
    x, y = (set(shingles(t).tolist()) for t in (x, y))
    return len(x & y) / len(x | y)


def changed(words, n, r):
    out = list(words)
    for k in r.sample(range(len(out)), n):
        out[k] = f"new{r.random()}"
    return out


def words(r, n):
    return [f"w{r.randrange(50000)}" for _ in range(n)]


def least_reachable(data):
    """By id: the smallest id reached by links of texts alike by 0.8."""
    c = {i: i for i, _ in data}
    linked = [(i, j) for i, s in data for j, t in data if i < j and jaccard(s, t) >= 0.8]
    for _ in data:
        for i, j in linked:
            c[i] = c[j] = min(c[i], c[j])
    return c


def chain():
    """Copies alike to the next one, but not to those further off; and copies around one original."""
    r = random.Random(8)
    data, now = [], words(r, 300)
    for k in range(25):
        data.append((k, " ".join(now)))
        now = changed(now, 5, r)
    base = words(r, 300)
    data += [(100 + k, " ".join(changed(base, r.randrange(4, 7), r))) for k in range(25)] + [(99, " ".join(base))]
    return data


def test_isolated_pairs_near_the_threshold(spark):
    r = random.Random(3)
    data = []
    while len(data) < 160:
        text = words(r, r.randrange(80, 400))
        s, t = " ".join(text), " ".join(changed(text, max(1, len(text) // 55), r))
        if 0.8 <= jaccard(s, t) <= 0.9:
            data += [(len(data), s), (len(data) + 1, t)]
    found = near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), alike=0.8).collect()
    assert all(x.component_id == x.doc_id // 2 * 2 for x in found)


def test_equal_fingerprints_of_unlike_texts(spark):
    r = random.Random(4)
    data = [(k, " ".join(words(r, 120) + ["na"] * 200)) for k in range(3)]
    data.append((3, data[1][1]))
    assert len({fingerprint(t) for _, t in data}) == 1
    found = near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), alike=0.8).collect()
    assert {x.doc_id: x.component_id for x in found} == {0: 0, 1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("bits", [1, 2])
@pytest.mark.parametrize("pair_up", [512, 5])
def test_tallies(spark, bits, pair_up):
    """Pairs with enough bytes in common are told from those whose bits are too many, in postings with all their first bytes alike."""
    r = np.random.default_rng(6)
    low = r.integers(0, 2**16, 200, dtype=np.uint64)
    f = np.unique(np.concatenate([low << np.uint64(48), (low << np.uint64(48)) ^ np.uint64(0x0101), low | np.uint64(7 << 60)]))
    want = {}
    for a in map(int, f):
        for b in map(int, f):
            if a != b and (a ^ b).bit_count() <= bits:
                want[frozenset((a, b))] = sum(x == y for x, y in zip(a.to_bytes(8), b.to_bytes(8), strict=True))
    found = candidates(spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long"), max_bits=bits, pair_up=pair_up).collect()
    assert len(found) == len(want) and {frozenset((x.f % 2**64, x.g % 2**64)): x.equal_bytes for x in found} == want


@pytest.mark.parametrize("pair_up", [64, 1])
def test_groups_like_chains(spark, pair_up):
    data = chain()
    want = least_reachable(data)
    assert set(want.values()) == {0, 99}
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert {x.doc_id: x.class_id for x in classes(fingerprint_pairs(df), df, pair_up=pair_up).collect()} == want
    assert {x.doc_id: x.component_id for x in near_duplicates(df, alike=0.8, pair_up=pair_up).collect()} == want


def test_classes_by_the_texts_likeness(spark):
    r = random.Random(5)
    data = []
    for k in range(60):
        text = words(r, 150)
        data += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(changed(text, 3 + k % 3, r)))]
    want = least_reachable(data)
    assert 70 < len(set(want.values())) < 120
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert {x.doc_id: x.class_id for x in classes(fingerprint_pairs(df), df).collect()} == want
