"""Terms that give entities away, against plain counting, and where they are hidden."""

import math
import re
from collections import defaultdict

import regex

from axiomata.llm import sanitise
from axiomata.llm.tables import Scratch
from tests.llm.test_operators import brute_spans


def groups(kind, hit):
    hit = hit.lower()
    number = re.sub("[^0-9]", "", hit)
    return {"email": "domain:" + hit.rsplit("@", 1)[-1], "ip": "network:" + ".".join(hit.split(".")[:2]), "card": "issuer:" + number[:6], "phone": "area:" + number[:4]}[kind]


def words_near(text, start, end, every):
    low = max(0, start - sanitise.REACH)
    left, right = text[low:start], text[end : end + sanitise.REACH]
    skip = len(re.match(r"\S*", left)[0]) if low else 0
    right = re.sub(r"\S*\Z", "", right) if len(right) == sanitise.REACH else right
    found = []
    for base, part in ((low + skip, left[skip:]), (end, right)):
        for m in regex.finditer(r"[\p{L}\p{N}]{2,}", part):
            a, b = base + m.start(), base + m.end()
            if not any(a < y and b > x for x, y in every):
                found.append(m[0].lower())
    return found


def brute_telling(texts):
    contexts, both_contexts, n_entity, n_both, n_word = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    for k, text in texts.items():
        for w in set(regex.findall(r"[\p{L}\p{N}]{2,}", text.lower())):
            n_word[w].add(k)
        base = [x.split(":") for x in brute_spans(text)]
        every = [(int(a), int(b)) for _, a, b in base]
        for kind, a, b in base:
            hit = text[int(a) : int(b)]
            near = words_near(text, int(a), int(b), every)
            for e in (f"{kind}:{hit.lower()}", groups(kind, hit)):
                contexts[e].add(" ".join(near))
                n_entity[e].add(k)
                for w in near:
                    both_contexts[e, w].add(" ".join(near))
                    n_both[e, w].add(k)
    found, n = {}, len(texts)
    for (e, w), seen in both_contexts.items():
        k, chance = len(seen), len(contexts[e]) * len(n_word[w]) / n
        information = -math.log2(len(n_entity[e]) / n)
        mutual = math.log2(len(n_both[e, w]) * n / (len(n_word[w]) * len(n_entity[e])))
        if k >= 2 and information > 0 and mutual >= sanitise.ALPHA * information and k > chance and k * math.log(k / chance) - k + chance >= sanitise.UNLIKELY:
            found[e, w] = (len(n_both[e, w]), len(n_entity[e]), len(n_word[w]), k, len(contexts[e]))
    return found


def corpus():
    rows = {k: f"note {k} zanzibar x{k}y project {'abcdefgh'[k % 8] * 5} write to boss@firm.example now common" for k in range(8)}
    rows |= {20 + k: f"call {k} of harbour office +1 (743) 555-{1000 + k} or later, common y{k}z" for k in range(5)}
    rows |= {40 + k: "the very same copy, quokka, from 10.1.2.3 and nothing else" for k in range(6)}
    rows |= {50: "far from any address: Zanzibar is mentioned, and HARBOUR, and quokka", 51: "zanzibars and superharbour are other words"}
    rows |= {100 + k: f"common words of all kinds {k} and word{k}" for k in range(3000)}
    return rows


def test_scores_equal_plain_counts(shared):
    source = corpus()
    docs = shared.createDataFrame(list(source.items()), "doc_id long, text string")
    scratch = Scratch(shared, "test")
    kept = scratch.keep(sanitise._marked(docs))
    got = {(r["entity"], r["hit"]): (r["n_both"], r["n_entity"], r["n_word"], r["both_contexts"], r["contexts"]) for r in sanitise.telling(docs, kept, scratch).collect()}
    want = brute_telling(source)
    assert got == want
    assert ("email:boss@firm.example", "zanzibar") in want and ("domain:firm.example", "zanzibar") in want
    assert ("area:1743", "harbour") in want  # no value occurs twice there, but the area does
    assert not any(w in ("quokka", "common") for _, w in want)  # copies are no evidence, common words tell nothing


def test_terms_are_hidden_wherever_they_occur(shared):
    source = corpus()
    docs = shared.createDataFrame(list(source.items()), "doc_id long, text string")
    terms = {w for _, w in brute_telling(source)}
    for r in sanitise.report(docs).collect():
        text = source[r["doc_id"]]
        base = brute_spans(text)
        every = [tuple(map(int, x.split(":")[1:])) for x in base]
        hidden = [f"term:{m.start()}:{m.end()}" for m in regex.finditer(r"[\p{L}\p{N}]{2,}", text) if m[0].lower() in terms and not any(m.start() < y and m.end() > x for x, y in every)]
        assert r["spans"] == ",".join(base + hidden)
    clean = {r["doc_id"]: r["text"] for r in sanitise.sanitised(docs).collect()}
    assert clean[50] == "far from any address: [TERM] is mentioned, and [TERM], and quokka"
    assert clean[51] == source[51]
