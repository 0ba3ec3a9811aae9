"""Masked pseudo-likelihood: counts, classes, network and scores against plain loops."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from axiomata.llm import lm_scoring
from tests.llm.test_operators import SF


def words(text):
    return [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]


def plain_class(word):
    before = word[-2] if len(word) > 1 else 0
    return ((before * 31 + word[-1]) * 5 + min(len(word), 12)) % lm_scoring.SHARED


def test_scores_are_sums_over_words(shared):
    docs = shared.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: words(r["text"]) for r in docs.collect()}
    made = lm_scoring.fitted(docs)
    got = {r["doc_id"]: r for r in lm_scoring.scored(docs).collect()}
    counts = Counter(w for ws in texts.values() for w in ws)
    total = sum(counts.values())
    own = {w for w, n in counts.items() if n >= total / (lm_scoring.OWN * math.log2(total + 2))}
    assert len(own) == len(made.words.own) <= lm_scoring.OWN * math.log2(total + 2)
    class_total = Counter()
    for w, n in counts.items():
        class_total[w if w in own else plain_class(w)] += n
    place = {}  # which class of its own a word has, by the only thing that is plain about it: how often it occurs
    for k, logarithm in enumerate(made.words.log_total[lm_scoring.SHARED :]):
        place.setdefault(round(math.exp(logarithm)), []).append(lm_scoring.SHARED + k)
    unique = {w: place[counts[w]][0] for w in own if len(place[counts[w]]) == 1}
    checked = 0
    for k, ws in texts.items():
        assert got[k]["n_words"] == len(ws)
        if not ws or any(w in own and w not in unique for w in ws):
            continue
        classes = [unique.get(w, None) if w in own else plain_class(w) for w in ws]
        whole = 0.0
        for i, w in enumerate(ws):
            around = [classes[i + d] if 0 <= i + d < len(ws) else made.net.classes for d in (-2, -1, 1, 2)]
            _, _, raw = made.net.layers(np.array([around]))
            whole += float(raw[0, classes[i]] - np.log(np.exp(raw[0]).sum()))
            whole += math.log(counts[w] / class_total[w if w in own else classes[i]])
        assert got[k]["sum_log_prob"] == pytest.approx(whole, rel=1e-3)
        assert got[k]["mean_log_prob"] == pytest.approx(whole / len(ws), rel=1e-3)
        checked += 1
    assert checked > 20


def test_own_counts_tell_words_of_a_class_apart(shared):
    rows = [(k, "the cat sat on the " + ("abcing" if k % 4 else "xyzing")) for k in range(400)] + [(1000, "the cat sat on the qqqing")]
    assert plain_class(b"abcing") == plain_class(b"qqqing")
    rows += [(2000 + k, f"w{k} v{k}") for k in range(3000)]
    got = {r["doc_id"]: r["sum_log_prob"] for r in lm_scoring.scored(shared.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] > got[0] > got[1000]


def test_odd_rows(odd, none):
    rows = {r["doc_id"]: r for r in lm_scoring.scored(odd).collect()}
    assert (rows[0]["n_words"], rows[0]["sum_log_prob"], rows[0]["mean_log_prob"]) == (0, 0.0, None)
    assert rows[5]["sum_log_prob"] == pytest.approx(rows[6]["sum_log_prob"])
    assert rows[None]["sum_log_prob"] == pytest.approx(rows[6]["sum_log_prob"])
    assert (rows[7]["n_words"], rows[8]["n_words"]) == (1, 15_000)
    assert lm_scoring.scored(none).count() == 0


def pairs(shared):
    rows = [(k, "a b " * 120 + f"n{k} " + "c d " * 3_000) for k in range(24)]
    return lm_scoring.fitted(shared.createDataFrame(rows, "doc_id long, text string"))


def test_words_beyond_the_start(shared):
    """Pairs that stand deep in the texts are learnt: the second word is likelier after the first than by its count."""
    made = pairs(shared)
    data = np.array([lm_scoring.SHARED + k for k in range(len(made.words.own))])
    assert len(data) >= 2
    often = data[np.argsort(-made.words.log_total[data])[:2]]
    target = np.tile(often, 200)
    around = lm_scoring.windows(target, np.zeros(len(target), int), made.net.classes)
    assert made.net.log_probability(around, target).mean() > np.log(0.5)


def test_windows_stop_at_texts():
    got = lm_scoring.windows(np.array([1, 2, 3, 4]), np.array([0, 0, 0, 1]), 9)
    assert got.tolist() == [[9, 9, 2, 3], [9, 1, 3, 9], [1, 2, 9, 9], [9, 9, 9, 9]]


def test_quick_probabilities_are_the_network_s():
    net = lm_scoring.Network(40).settle()
    around = np.random.default_rng(1).integers(0, 41, (50, 4))
    _, _, raw = net.layers(around)
    whole = raw - np.log(np.exp(raw).sum(axis=1, keepdims=True))
    assert net.log_probability(around, np.arange(40)[np.arange(50) % 40]) == pytest.approx(whole[np.arange(50), np.arange(50) % 40], abs=1e-4)
