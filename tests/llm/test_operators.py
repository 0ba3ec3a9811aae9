"""Every operator against brute force, and on odd and empty tables."""

import hashlib
import itertools
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from axiomata.llm import collision_search, language_id, near_dedup, packing, piece_lattice, quality_rules, repeat_index, sanitise, shingles, url_filters
from axiomata.llm.components import components, labels
from axiomata.llm.exchange import Batch
from axiomata.llm.tables import Scratch

SF = "/root/testdata/sf0.001"
ODD_ROWS = 12


@pytest.fixture(scope="module")
def docs(shared):
    return shared.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# quality rules


def test_quality_rules(docs, texts, odd, none):
    for found, source in ((quality_rules.ledger(docs), texts), (quality_rules.ledger(odd), None)):
        for r in found.collect():
            if source is None and r["doc_id"] is None:
                continue
            text = source[r["doc_id"]] if source else odd.where(F.col("doc_id") == r["doc_id"]).first()["text"] or ""
            w = words(text)
            grams = Counter(zip(w, w[1:], w[2:], strict=False))
            hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
            lines = [x for x in text.split("\n") if words(x)]
            want = (len(w), sum(map(len, w)), len(hit), len(lines) - len(set(lines)), len(re.findall(r"[#*$%&|<>]", text)))
            assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"], r["n_symbols"]) == want
    book = quality_rules.verdicts(quality_rules.ledger(docs)).cache()
    report = {r["rule"]: r for r in quality_rules.ablations(book).collect()}
    bits = [r["fail_bits"] for r in book.collect()]
    assert report["symbols"]["n_failed"] == sum(b >> 2 & 1 for b in bits)
    assert report["symbols"]["n_sole"] == sum(b == 4 for b in bits)
    assert report["symbols"]["n_kept_without"] == sum(b & ~4 == 0 for b in bits)
    assert quality_rules.ledger(odd).count() == ODD_ROWS
    assert quality_rules.ledger(none).count() == 0
    assert quality_rules.passing(odd, "base").columns == odd.columns


# MinHash


def brute_components(source, percent=85):
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for k, w in ((k, words(re.sub("[A-Z]", lambda m: m[0].lower(), t))) for k, t in source.items())}
    keys = sorted(sets)
    root = {k: k for k in keys}

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = up(a), up(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), up(k)) for k in keys}


def test_near_dedup(shared, docs, texts, odd, none):
    base = words(texts[next(iter(texts))])[:200] + [f"w{k}" for k in range(200)]
    more = {10_000 + k: " ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in range(0, 60, 2)}
    more[20_000] = " ".join(base).upper()
    source = texts | more
    table = docs.select("doc_id", "text").unionByName(shared.createDataFrame(list(more.items()), "doc_id long, text string"))
    want = brute_components(source)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(table).collect()}
    assert got == want
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == ODD_ROWS
    by = {r["doc_id"]: r for r in rows}
    assert (by[6]["component_id"], by[6]["kept"], by[None]["component_id"], by[None]["kept"]) == (5, False, 5, False)
    assert all(by[k]["kept"] and by[k]["n_shingles"] == 0 for k in range(4))
    assert near_dedup.near_duplicates(none).count() == 0
    stay = near_dedup.representatives(odd)
    assert stay.columns == odd.columns
    assert sorted(r["doc_id"] for r in stay.collect() if r["doc_id"] is not None) == [0, 1, 2, 3, 4, 5, 7, 8, 9]


def test_components(shared):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(a) + 1) for a in range(200) if a % 50] + [tuple(map(int, x)) for x in rng.integers(300, 500, (150, 2))] + [(1000, k) for k in range(1001, 1060)]
    nodes, root = labels(*map(np.array, zip(*pairs, strict=True)))
    want = {int(a): int(b) for a, b in zip(nodes, root, strict=True) if a != b}
    links = shared.createDataFrame(pairs, "a long, b long")
    for per_task in (1_000_000, 60):
        assert {r["id"]: r["root"] for r in components(links, Scratch(shared, "test"), per_task).collect()} == want


def test_shingles():
    text = "A b\tc d e F\x0bg  h" * 50
    want = words(text.lower())
    assert len(shingles.sets([text.encode()])[0]) == len({tuple(want[i : i + 5]) for i in range(len(want) - 4)})
    assert [len(x) for x in shingles.sets([b"", b" ", b"a b", b"a b c d e"])] == [0, 0, 1, 1]
    assert (shingles.sets([b"x " * 400_000 + b"y"])[0] == shingles.sets([b"x x x x x x y"])[0]).all()


# repeated passages


def brute_removed(source):
    seen, out = set(), {}
    for k in sorted(source):
        raw = source[k].encode()
        gone = np.zeros(len(raw), bool)
        own = [raw[i : i + 50] for i in range(len(raw) - 49)]
        for i, w in enumerate(own):
            if w in seen:
                gone[i : i + 50] = True
        seen.update(own)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[k] = (len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_repeat_index(shared, docs, texts, odd, none):
    cut = "".join(texts.values())[3:140]
    more = {10_000: "start " + cut, 10_001: cut[:49] + "!" + cut[:50], 10_002: "ab" * 100, 10_003: "ab" * 30 + "é" + cut[20:90], 10_004: "é" * 60, 10_005: "xé" + "é" * 50}
    source = texts | more
    table = docs.select("doc_id", "text").unionByName(shared.createDataFrame(list(more.items()), "doc_id long, text string"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeat_index.without_repeats(table).collect()}
    assert got == brute_removed(source)
    rows = repeat_index.without_repeats(odd, with_text=True).collect()
    assert len(rows) == ODD_ROWS
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["n_bytes"] == 0
    assert by[6]["n_removed"] == by[6]["n_bytes"] == by[None]["n_removed"]
    assert [r["n_removed"] for r in rows if r["doc_id"] == 5] == [0, 0]
    assert (by[9]["kept_text"], by[9]["lang"], by[9]["part"]) == ("a@b.co or +1 (743) 555-3824 or 10.0.0.1 or 4242 4242 4242 4242", "en", "b")
    assert repeat_index.without_repeats(none, with_text=True).count() == 0


def test_run_index():
    rng = np.random.default_rng(2)
    parts = [rng.integers(97, 100, 70, np.uint8) for _ in range(20)]
    parts += [np.concatenate([p[5:], p[:5]]) for p in parts[:7]]
    widths, doc = np.array([len(p) for p in parts]), rng.permutation(len(parts))
    bits = repeat_index.covered_windows(np.concatenate(parts), widths, doc)
    for i, p in enumerate(parts):
        for k in range(21):
            w = p[k : k + 50].tobytes()
            hit = any(doc[j] < doc[i] and w in q.tobytes() for j, q in enumerate(parts))
            assert bool(int(bits[i]) >> k & 1) == hit


def test_run_samples_make_the_matching_statistics():
    rng = np.random.default_rng(3)
    parts = [rng.integers(97, 99, int(w), np.uint8) for w in rng.integers(1, 60, 12)]
    parts += [parts[0], np.concatenate([parts[1], parts[2]])]
    text, widths = np.concatenate(parts), np.array([len(p) for p in parts])
    owner, ends = np.repeat(np.arange(len(parts)), widths), np.repeat(np.cumsum(widths), widths)
    suffix = [text[k : ends[k]].tobytes() for k in range(len(text))]
    order = sorted(range(len(text)), key=lambda k: (suffix[k], k))
    assert repeat_index.suffix_order(text, widths).tolist() == order
    index = repeat_index.RunIndex(text, widths)
    runs = 1 + sum(text[a - 1] != text[b - 1] or owner[b - 1] != owner[b] or owner[a - 1] != owner[a] for a, b in zip(order, order[1:], strict=False) if a and b)
    assert len(index.run_head) < len(text) and len(index.run_head) >= runs
    want = {b: (a, len(os.path.commonprefix([suffix[a], suffix[b]]))) for a, b in zip(order, order[1:], strict=False)}
    before, length = index.matching_statistics()
    assert all((before[k], length[k]) == want[k] for k in range(len(text)) if k != order[0])
    index.run_end = np.roll(index.run_end, 1)  # without the true samples, nothing is right
    before, length = index.matching_statistics()
    assert sum((before[k], length[k]) == want[k] for k in range(len(text)) if k != order[0]) < len(text) / 2


def test_hot_anchors(shared, docs, texts):
    phrase = "this phrase stands in very many documents of the corpus, "
    more = {20_000 + k: f"{k * 7919 % 10007} {phrase}and then it goes on with {k % 5} things" for k in range(60)}
    source = texts | more
    table = docs.select("doc_id", "text").unionByName(shared.createDataFrame(list(more.items()), "doc_id long, text string"))
    assert len(repeat_index.hot_anchors(shared.createDataFrame([(0, _one_batch(more))], "batch long, payload binary"), 0, 10)) > 0
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeat_index.without_repeats(table, hot_from=5).collect()}
    assert got == brute_removed(source)


def _one_batch(source):
    raw = [t.encode() for t in source.values()]
    return Batch(np.array(list(source)), np.array([len(r) for r in raw]), b"".join(raw), np.zeros(len(raw), np.int64), b"").packed()


# personal data


def brute_spans(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (c > "4") for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int((x.lstrip("0") or "0")[:9]) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_sanitise(shared, docs, texts, odd, none):
    more = {
        10_000: "a@b.c_d@e.f x@y.z.", 10_001: "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.4", 10_002: "4111 1111 1111 1111 4111-1111-1111-1111-1 5", 10_003: "+1 (743) 555-3824 +12 ++12345678 +1((((",
        10_004: "😀 é@b.co ü+1@x.y.z, 4242424242424242", 10_005: "0" * 5000 + "1." * 3000,
    }
    table = docs.select("doc_id", "text").unionByName(shared.createDataFrame(list(more.items()), "doc_id long, text string"))
    for r in sanitise.report(table).collect():
        want = brute_spans((texts | more)[r["doc_id"]])
        counts = Counter(x.split(":")[0] for x in want)
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(counts[k] for k in sanitise.KINDS[:4])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x and not x.startswith("term")] == want
    assert sanitise.report(odd).count() == ODD_ROWS
    assert sanitise.report(none).count() == 0
    clean = {r["doc_id"]: r for r in sanitise.sanitised(odd).collect()}
    assert clean[9]["text"] == "[EMAIL] or [PHONE] or [IP] or [CARD]"
    assert (clean[0]["text"], clean[4]["text"], clean[9]["part"]) == (None, "one two three", "b")


# packing


def test_packing(docs, texts, odd, none):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(packing.vocabulary())
    want = {}
    for k, t in texts.items():
        ids = [*coder.encode(t, add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            want[k, p] = (at, len(part), zlib.crc32(part.tobytes()))
    rows = packing.packed(docs).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    check_sequences(rows)
    total = sum(v[1] for v in want.values())
    assert len({r["sequence_id"] for r in rows}) <= -(-total // 2048) + 2
    rows = packing.packed(odd).collect()
    check_sequences(rows)
    assert [r["length"] for r in rows if r["doc_id"] == 0] == [1]
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert packing.packed(none).count() == 0


def lengths_like_sf01():
    """A histogram like that of sf0.1: ten thousand pieces of some 1,800 lengths, few of each."""
    rng = np.random.default_rng(8)
    return Counter(np.minimum(rng.lognormal(6.1, 0.9, 10_000).astype(int) + 1, 2048).tolist())


def check_plan(counts, made, capacity=2048):
    got = Counter()
    for copies, times in made.runs:
        assert sum(x * n for x, n in copies.items()) <= capacity
        for x, n in copies.items():
            got[x] += n * times
    assert got == Counter({x: n for x, n in counts.items() if n})


def test_programs_place_nearly_all_pieces():
    counts = lengths_like_sf01()
    made = packing.plan(counts)
    check_plan(counts, made)
    assert made.rounded >= 0.9 * sum(counts.values())
    assert made.gaps[0] <= packing.GAP
    total = sum(x * n for x, n in counts.items())
    assert sum(t for _, t in made.runs) <= -(-total // 2048) + 3


def test_programs_where_volume_is_no_bound():
    for counts, want in (({1100: 1000, 10: 500, 600: 700}, 1000), ({1024: 5000, 1025: 5000}, 7500), ({1500: 1000, 5: 1}, 1000), ({300: 7, 2048: 5}, 7), ({7: 3}, 1), ({}, 0)):
        made = packing.plan(counts)
        check_plan(counts, made)
        assert sum(t for _, t in made.runs) == want


def test_program_covers_and_its_bound_holds():
    rng = np.random.default_rng(9)
    for counts, optimum in (({3: 40, 5: 40}, None), ({6: 30}, 30), ({4: 30, 7: 10}, None), ({2: 9, 9: 50}, 50)):
        program = packing.fractional(counts, 10, rng)
        covered = Counter()
        for copies, times in program.columns:
            assert sum(x * n for x, n in copies.items()) <= 10
            for x, n in copies.items():
                covered[x] += n * times
        assert all(abs(covered[x] - n) <= 0.05 + n / 500 for x, n in counts.items())
        assert program.bound <= program.value * 1.01
        if optimum:
            assert program.bound <= optimum + 1e-9 and program.value >= optimum * 0.99


def test_fillings_are_the_best():
    rng = np.random.default_rng(10)
    for _ in range(30):
        lengths = np.sort(rng.choice(np.arange(1, 12), 4, replace=False))
        prices, counts = rng.random(4), rng.integers(1, 4, 4)
        best, taken = packing.best_fillings(lengths, prices, counts, 15)
        options = [np.array(c) for c in itertools.product(*(range(n + 1) for n in counts))]
        for room in range(16):
            assert best[room] == pytest.approx(max(c @ prices for c in options if c @ lengths <= room))
            made = packing.spelled_out(lengths, taken, np.array([room]))[0]
            assert (made <= counts).all() and made @ lengths <= room and made @ prices == pytest.approx(best[room])


def check_sequences(rows):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_chunks():
    coder = packing.Chunked(packing.vocabulary())
    for t in ("á ́x", "<|endoftext|> x<|startoftext|>y", "\x1c\x1d a\u0085b c", "I'll don't  x's 12 3", "ΣΑΣ ß İ.", "!!!...\t'll", "  　 z", "\n", "Straße ÀÉ, ÿþ. naïve ﬁ Ŀ ªºµ é é, Ünï"):
        assert coder.encoded([t])[0] == coder.ids(t).tobytes()


# language


def test_language(shared, odd, none):
    docs = shared.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r["lang_pred"] for r in language_id.identified(odd).collect()}
    assert (by[0], by[1], by[2], by[4]) == ("und", "und", "und", "en")
    assert [language_id.has_letter(t) for t in ("", "2² _", "² a", "é")] == [False, False, True, True]
    assert language_id.identified(none).count() == 0


def plain_grams(text):
    raw = text.encode()
    symbols = [1 + (c | 32) - 97 if 97 <= (c | 32) < 123 and c < 128 else 27 + (c - 128) % 37 if c >= 128 else 0 for c in raw]
    return {tuple(symbols[i : i + n]) for n in (1, 2, 3) for i in range(len(symbols) - n + 1)}


def test_language_kernel_and_ridge(texts):
    """Kernels are cosines of n-gram sets, and the weights solve the regularised least squares over Nystroem features."""
    chosen = [t for t in texts.values() if language_id.has_letter(t) and len(t) < 4000][:24]
    samples = [(t, "ab"[k % 2]) for k, t in enumerate(chosen)]
    model = language_id.fit(samples, per_language=6)
    assert model.langs == ["a", "b"] and model.landmarks.shape[1] == 12
    landmarks = [t for t, lang in samples if lang == "a"][:6], [t for t, lang in samples if lang == "b"][:6]
    order = [x for pair in zip(*landmarks, strict=True) for x in pair]
    sets = [plain_grams(t) for t in order]
    kernel = lambda t: np.array([len(plain_grams(t) & s) / np.sqrt(len(plain_grams(t)) * len(s)) for s in sets])
    fresh = ["Une phrase é 12", "zzz", "The quick brown fox ß"]
    got = model.scores(fresh)
    assert got == pytest.approx(np.array([kernel(t) @ model.weights[:-1] + model.weights[-1] for t in fresh]), abs=1e-4)
    among = np.array([kernel(t) for t in order])
    values, vectors = np.linalg.eigh(among + 1e-6 * np.eye(12))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-8))) @ vectors.T
    rows = [kernel(t) for t in [t for t, _ in samples] + [t[:120] for t, _ in samples]]
    features = np.hstack([np.array(rows) @ root, np.ones((len(rows), 1))])
    target = np.array([[1.0 if lang == x else -1.0 for x in "ab"] for _, lang in samples] * 2)
    share = 1 / 12
    solved = np.linalg.solve(features.T @ features * share + np.diag([language_id.RIDGE] * 12 + [0.0]) + 1e-9 * np.eye(13), features.T @ target * share)
    assert got == pytest.approx(np.array([np.append(kernel(t) @ root, 1) @ solved for t in fresh]), abs=5e-3)


def test_language_sample_has_one_row_of_an_id(shared):
    rows = [(1, "the same id again and again " + str(k), "en") for k in range(300)] + [(k, f"ein Satz über {k}", "de") for k in range(2, 900)] + [(k, "x", None) for k in range(1000, 1100)]
    docs = shared.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.sampled(docs, F.lit(True), 50)
    assert [lang for _, lang in found].count("en") == 1
    assert [lang for _, lang in found].count("de") == 50
    assert found == language_id.sampled(docs.repartition(7), F.lit(True), 50)


# neighbours


def test_vectors_of_any_magnitude(shared):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 16))
    want = collision_search.Block(np.arange(300), base).search(np.arange(5), base[:5], 5)
    for factor in (1e-300, 1e-170, 1e170, 1e300, 5e-324 * 2**60):
        block = collision_search.Block(np.arange(300), base * factor)
        for (ids, scores), (ids_, scores_) in zip(block.search(np.arange(5), base[:5], 5), want, strict=True):
            assert ids.tolist() == ids_.tolist() and scores == pytest.approx(scores_, abs=1e-4 if factor < 1e-300 else 1e-12)
    mixed = base * 10.0 ** rng.integers(-200, 200, (300, 1))
    docs = shared.createDataFrame([(k, v.tolist(), 1, 2, "x") for k, v in enumerate(mixed)] + [(400, [0.0] * 16, 1, 2, "x"), (450, None, 1, 2, "x")], "vec_id long, embedding array<double>, rank int, query_id int, score string")
    got = {(r["query_id"], r["rank"]): r["score"] for r in collision_search.nearest(docs).collect()}
    unit = base / np.sqrt((base * base).sum(1))[:, None]
    for q in range(0, 300, 50):
        best = np.sort(np.delete(unit @ unit[q], q))[::-1][:5]
        assert [got[q, k] for k in range(1, 6)] == pytest.approx(best.tolist(), abs=1e-12)
    assert len(got) == 30


def test_long_vectors(shared):
    rng = np.random.default_rng(5)
    data = [(k, rng.standard_normal(3000).tolist()) for k in range(60)]
    got = collision_search.nearest(shared.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 10 and all(-1 <= r["score"] <= 1 for r in got)


def test_collision_search(shared):
    rows = shared.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    data = [(r["vec_id"], r["embedding"]) for r in rows.collect()]
    data += [(1001, None), (1002, [0.0] * 64), (1003, [float("nan")] * 64), (1050, [None] * 64), (1100, data[0][1]), (7, data[7][1]), (2000, [1.0, 0.0]), (2001, [0.5, 0.5])]
    table = shared.createDataFrame(data, "vec_id long, embedding array<float>")
    got = {}
    for r in collision_search.nearest(table, block=200).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = {k: np.array(v, np.float64) for k, v in data if v and None not in v and np.isfinite(v).all() and any(v)}
    hits = total = 0
    for q in (k for k in good if k % 50 == 0):
        scores = {k: float(good[q] @ v / np.sqrt(good[q] @ good[q]) / np.sqrt(v @ v)) for k, v in good.items() if k != q and len(v) == len(good[q])}
        best = sorted(scores, key=lambda k: (-round(scores[k], 12), k))[:5]
        mine = sorted(got[q])
        assert [x[0] for x in mine] == list(range(1, len(best) + 1))
        assert all(abs(x[2] - scores[x[1]]) < 1e-12 for x in mine)
        hits += len({x[1] for x in mine} & set(best))
        total += len(best)
    assert hits >= 0.95 * total
    assert got[2000][0][1] == 2001
    assert 1050 not in got
    assert collision_search.nearest(table.limit(0)).count() == 0


# urls


def test_url_filters(shared):
    urls = [None, "", "no scheme/x", "http://A.Com", "http://a.com/", "https://www.Example.com/en/1?x#y", "x://m.example.com/en/", "x://net/fr/2", "x://notnet/es/", "x://b.net/es/#a", "x://h.org/de/1?/z", "://?q"]
    pages = shared.createDataFrame([(k, u, "h") for k, u in enumerate(urls)] + [(None, urls[4], "h")], "page_id long, url string, host string")
    labels_ = shared.createDataFrame([(k, 0, 0) for k in range(100, 160)] + [(None, 0, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    spam = shared.createDataFrame([(k, f"x://bad.org/ads/{k}.html", "") for k in range(100, 160)] + [(k, f"x://bad.org/ok/{k}", "") for k in range(200, 260)], pages.schema)
    fine = labels_.unionByName(shared.createDataFrame([(k, 1, 0) for k in range(200, 260)], labels_.schema))
    rows = url_filters.filtered(pages.unionByName(spam), fine).collect()
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert len(rows) == 133
    assert [by[k] for k in range(12)] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.com", "", None, "allow"), ("a.com", "/", "com/", "allow"),
        ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("m.example.com", "/en/", "example.com/en/", "block"), ("net", "/fr/2", "net/fr/", "block"), ("notnet", "/es/", None, "allow"),
        ("b.net", "/es/", "net/es/", "block"), ("h.org", "/de/1", None, "allow"), ("", "", None, "allow"),
    ]
    assert {by[k][3] for k in range(100, 160)} == {"block"}
    assert {by[k][3] for k in range(200, 260)} == {"allow"}
    assert url_filters.filtered(pages.limit(0), labels_.limit(0)).count() == 0


# pieces


def test_pieces(shared, docs, texts, odd, none):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_lattice.model_path())
    pieces = piece_lattice.pieces_of(piece_lattice.model_path())
    more = ["\nabc", "\n\n a", " a", "a ", " ", "  \n", "a \nb", "你  你", "ﬁ ½ é é", "x" * 500 + " y", "\t\ta", "<s>hi</s> <0x0A>", "😀😀 z", "a\r\nb", "ab" * 300, "a▁b"]
    source = texts | {10_000 + k: t for k, t in enumerate(more)}
    table = docs.select("doc_id", "text").unionByName(shared.createDataFrame([(10_000 + k, t) for k, t in enumerate(more)], "doc_id long, text string"))
    for r in piece_lattice.encoded(table, with_ids=True).collect():
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == model.encode(source[r["doc_id"]])
        assert r["round_trip"] == ("▁" not in source[r["doc_id"]])
    listed = sorted({"▁" + w for t in texts.values() for w in t.split()[:8]} | {"▁é你", "\nab", "▁▁▁x"})
    listed = [w for w in listed if len(w) <= piece_lattice.LONGEST]
    native = {r["word"]: r["ids"] for r in piece_lattice.lattice(shared.createDataFrame([(w,) for w in listed], "word string"), pieces).collect()}
    assert native == {w: pieces.folded(w) for w in listed}
    assert [pieces.folded_long(w) for w in listed] == [pieces.folded(w) for w in listed]
    assert piece_lattice.encoded(odd).count() == ODD_ROWS
    assert piece_lattice.encoded(none).count() == 0
