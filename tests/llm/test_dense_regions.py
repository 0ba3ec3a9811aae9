"""Near-duplicates in regions that are larger than the windows."""

import numpy as np

from axiomata.llm import near_dedup, shingles

from tests.llm.test_operators import brute_components


def boilerplate(families=60):
    """Documents that share most of their words; two of a family are near-duplicates at 99, others aren't."""
    common = [f"c{k}" for k in range(1000)]
    own = {f: [f"f{f}w{k}" for k in range(5)] for f in range(families)}
    return {n + f: " ".join(common + own[f] + [f"x{n + f}"]) for n in (0, 1000) for f in range(families)}


def test_whole_families(shared):
    source = boilerplate()
    want = brute_components(source, 99)
    assert len({c for _, c in want.values()}) == 60
    docs = shared.createDataFrame(list(source.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, percent=99).collect()}
    assert got == want


def test_prefix_pairs_are_all():
    common = [f"c{k}" for k in range(60)]
    texts = [" ".join(common[: 60 - k] + [f"w{k % 7}x{i}" for i in range(3 * (k % 9))]) for k in range(60)]
    found = shingles.sets([t.encode() for t in texts])
    rarity = np.zeros(near_dedup.RARITY, np.int64)
    for s in found:
        np.add.at(rarity, near_dedup._counter(s), 1)
    for percent in (50, 80, 85, 95, 100):
        rows = sorted((int(x), k, len(s), p) for k, s in enumerate(found) for p, x in enumerate(near_dedup.prefix(s, rarity, percent).view(np.int64)))
        shingle, rep, size, place = map(np.array, zip(*rows, strict=True))
        got = {(int(x), int(y)) for a, b in near_dedup.across(shingle, rep, rep, size, place, percent) for x, y in zip(a, b, strict=True)}
        alike = lambda p, q: 100 * (c := shingles.common(p, q)) >= percent * (len(p) + len(q) - c)
        assert {(i, k) for k in range(len(found)) for i in range(k) if alike(found[i], found[k])} <= got
