"""The pipeline's stages against brute force."""

import hashlib

import corpus_pipeline

from tests.llm.test_operators import SF, brute_components, brute_removed, brute_spans, check_sequences, words


def test_stages(shared, odd):
    docs = shared.read.parquet(f"{SF}/documents.parquet")
    (_, quality), (_, near), (_, repeats), (_, personal), (_, pack) = corpus_pipeline.STAGES
    good = quality(shared, docs, SF).cache()
    assert good.columns == list(corpus_pipeline.COLUMNS)
    assert all(len(words(r["text"])) >= 50 for r in good.collect())
    single = near(shared, good, SF).cache()
    source = {r["doc_id"]: r["text"] for r in good.collect()}
    kept = {k for k, (_, c) in brute_components(source, 80).items() if c == k}
    assert {r["doc_id"] for r in single.collect()} == kept
    source = {r["doc_id"]: r["text"] for r in single.collect()}
    cut = repeats(shared, single, SF).cache()
    want = brute_removed(source)
    rows = cut.collect()
    by = {r["doc_id"]: r["text"] for r in rows}
    assert {k: hashlib.sha256(t.encode()).hexdigest() for k, t in by.items() if source[k].isascii()} == {k: w[3] for k, w in want.items() if source[k].isascii()}
    assert {r["doc_id"] for r in rows} == kept
    assert all(len(r["text"].encode()) <= want[r["doc_id"]][0] - want[r["doc_id"]][1] for r in rows)
    assert all(r["text"] == source[r["doc_id"]] for r in rows if not want[r["doc_id"]][1])
    clean = personal(shared, cut, SF).cache()
    assert clean.columns == list(corpus_pipeline.COLUMNS)
    assert not any(brute_spans(r["text"]) for r in clean.collect())
    packed = pack(shared, clean, SF).collect()
    check_sequences(packed)
    assert {r["doc_id"] for r in packed} == kept


def test_odd_documents(shared, odd):
    docs = odd.select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        stage(shared, docs, SF).collect()
        stage(shared, docs.limit(0), SF).collect()


def test_near_copies_of_four_fifths_go(shared):
    """A pair of a similarity of 0.80 to 0.85 is one document to the pipeline, though not to op4."""
    words_ = [f"w{k}" for k in range(400)]
    near = words_[:360]
    rows = [(1, " ".join(words_), "en", "s", 0), (2, " ".join(near[:340] + [f"x{k}" for k in range(20)]), "en", "s", 0)]
    docs = shared.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words(rows[0][1]), words(rows[1][1])))
    assert 0.8 <= len(a & b) / len(a | b) < 0.85
    assert [r["doc_id"] for r in corpus_pipeline.STAGES[1][1](shared, docs, SF).collect()] == [1]
