"""Language identification with blended-spectrum presence kernels.

The kernel of two texts is the cosine of their sets of 1- to 3-grams over a reduced alphabet:
common n-grams over the root of the product of the set sizes. A bounded sample of labelled texts
(``PER_LANGUAGE`` of each language, chosen by hashes) is split into landmarks and
training rows; Nystroem features against the landmarks are fitted by one-versus-rest kernel ridge
regression. Documents are scored in batches: presence matrix times landmarks, times coefficients.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomata.llm.tables import table

#: Bounds of what is learnt from: labelled rows per language, landmarks per language, characters of a training text (a stretch from anywhere in it), languages (the most frequent).
PER_LANGUAGE, LANDMARKS, TRAIN_CHARS, LANGUAGES = 400, 40, 4000, 200
RIDGE = 1e-2
#: Rows asked for, as a multiple of PER_LANGUAGE, since chance decides how many the hashes choose.
SPARE = 1.5
#: Documents scored by one matrix product, and bytes of text looked up at a time.
ROWS, STRETCH = 256, 1 << 20
UNKNOWN = "und"
WORD_SIGN = re.compile(r"[^\W\d_]")

#: Bytes -> 64 symbols: letters without case, all else in ASCII as a gap, the 64 high values folded to 37.
SYMBOL = np.zeros(256, np.int32)
SYMBOL[ord("a") : ord("z") + 1] = SYMBOL[ord("A") : ord("Z") + 1] = np.arange(1, 27)
SYMBOL[128:] = 27 + np.arange(128) % 37
GRAMS = 64 + 64**2 + 64**3


def has_letter(text: str) -> bool:
    found = WORD_SIGN.search(text)  # letters, and signs like a raised two
    return found is not None and (found[0].isalpha() or any(map(str.isalpha, text)))


def grams(symbols: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n-grams of a symbol array, below GRAMS."""
    if len(symbols) < n:
        return np.empty(0, np.int32)
    code = symbols[: len(symbols) - n + 1]
    for k in range(1, n):
        code = code * 64 + symbols[k : len(symbols) - n + 1 + k]
    return code + (0, 64, 64 + 64**2)[n - 1]


def presence(text: str, columns: np.ndarray, row: np.ndarray) -> int:
    """Marks in ``row`` the columns of the n-grams that occur; returns the number of distinct n-grams."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    seen = np.zeros(GRAMS, bool)
    for at in range(0, max(1, len(raw)), STRETCH):
        symbols = SYMBOL[raw[at : at + STRETCH + 2]]
        for n in (1, 2, 3):
            seen[grams(symbols, n)] = True
    found = np.flatnonzero(seen)
    place = columns[found]
    row[place[place >= 0]] = 1
    return len(found)


class Model(NamedTuple):
    langs: list[str]
    columns: np.ndarray  # n-gram -> column, or -1
    landmarks: np.ndarray  # columns x landmarks, scaled
    weights: np.ndarray  # landmarks + 1 x langs

    def scores(self, texts: list[str]) -> np.ndarray:
        marks = np.zeros((len(texts), len(self.landmarks)), np.float32)
        sizes = np.array([presence(t, self.columns, marks[k]) for k, t in enumerate(texts)], np.float32)
        kernel = (marks @ self.landmarks) / np.sqrt(np.maximum(sizes, 1))[:, None]
        return kernel @ self.weights[:-1] + self.weights[-1]


def fit(samples: list[tuple[str, str]], per_language: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """A model of (text, lang) pairs, in the given order; the first of each language are landmarks."""
    langs = sorted({lang for _, lang in samples})
    taken: dict[str, int] = dict.fromkeys(langs, 0)
    chosen = []
    for text, lang in samples:
        if taken[lang] < per_language:
            taken[lang] += 1
            chosen.append(text[:TRAIN_CHARS])
    every = np.arange(GRAMS)
    rows = np.zeros((len(chosen), GRAMS), np.float32)
    sizes = np.array([presence(t, every, rows[k]) for k, t in enumerate(chosen)], np.float32)
    used = np.flatnonzero(rows.any(0))
    columns = np.full(GRAMS, -1, np.int32)
    columns[used] = np.arange(len(used))
    landmarks = (rows[:, used] / np.sqrt(np.maximum(sizes, 1))[:, None]).T.copy()
    model = Model(langs, columns, landmarks, np.zeros((len(chosen) + 1, len(langs)), np.float32))
    # Nystroem: K_nm (K_mm + e)^-1/2 as features, ridge regression on them, folded back into weights of kernel values
    among = (landmarks.T @ landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh(among + 1e-6 * np.eye(len(chosen)))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-8))) @ vectors.T
    eye = Model(langs, columns, landmarks, np.vstack([np.eye(len(chosen)), np.zeros((1, len(chosen)))]).astype(np.float32))
    # every sample counts whole and as a short stretch, so that short texts are known too
    texts = [t[:TRAIN_CHARS] for t, _ in samples] + [t[:120] for t, _ in samples]
    kernel = np.vstack([eye.scores(texts[k : k + ROWS]) for k in range(0, len(texts), ROWS)]).astype(np.float64)
    features = np.hstack([kernel @ root, np.ones((len(texts), 1))])
    is_lang = np.array([[1.0 if lang == x else -1.0 for x in langs] for _, lang in samples] * 2)
    share = np.array([1.0 / sum(lang == x for _, x in samples) for _, lang in samples] * 2)[:, None]
    gram = features.T @ (features * share) + ridge * np.diag([1.0] * len(chosen) + [0.0])
    solved = np.linalg.solve(gram + 1e-9 * np.eye(len(gram)), features.T @ (is_lang * share))
    weights = np.vstack([root @ solved[:-1], solved[-1:]]).astype(np.float32)
    return Model(langs, columns, landmarks, weights)


def sampled(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """A bounded sample of labelled texts: of each language the documents with the smallest hashes, one row of each, in that order.

    How many documents a language has says below which hash enough of them lie, so no task ranks a
    language, and rows that repeat an id are one before they are collected.
    """
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("h", F.xxhash64(F.col("doc_id").cast("string")))
    keys = labelled.select("lang", "h").distinct()
    sizes = keys.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    share = F.least(F.lit(SPARE * per_language) / F.col("count"), F.lit(1.0))
    below = F.broadcast(sizes.select("lang", share.alias("share")))  # LANGUAGES rows
    place = F.col("h").cast("double") / F.lit(float(2**64)) + 0.5
    stretch = F.substring("text", F.pmod(F.col("h"), F.greatest(F.length("text") - TRAIN_CHARS, F.lit(0)) + 1).cast("int") + 1, F.lit(TRAIN_CHARS))
    chosen = labelled.join(below, "lang").where(place <= F.col("share")).select("lang", "h", stretch.alias("text"))
    rows = chosen.groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    taken: dict[str, int] = {}
    found = []
    for r in sorted(rows, key=lambda r: (r["h"], r["lang"])):
        taken[r["lang"]] = k = taken.get(r["lang"], 0) + 1
        if k <= per_language and has_letter(r["text"]):
            found.append((k, r["lang"], r["text"]))
    return [(text, lang) for _, lang, text in sorted(found, key=lambda x: x[:2])]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame, learn: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang).

    ``learn`` says which rows may be learnt from (by default, those not held out); only text and
    lang of those are used, and predictions see the text alone. ``und`` stands for a null text or
    one without a letter, or if nothing can be learnt. Whole texts are scored, at any length.
    Repeated rows give repeated rows; a null doc_id is not held out.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", "lang")
    samples = sampled(docs, ~held_out() if learn is None else learn)
    model = spark.sparkContext.broadcast(fit(samples) if samples else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = model.value
        for batch in batches:
            texts = batch.column("text")
            preds, scores = [], []
            for k in range(0, batch.num_rows, ROWS):
                some = [x or "" for x in texts.slice(k, ROWS).to_pylist()]
                if at is None:
                    preds += [UNKNOWN] * len(some)
                    scores += [0.0] * len(some)
                    continue
                found = at.scores(some)
                best = found.argmax(1)
                odds = np.exp(4 * (found - found.max(1, keepdims=True)))
                sure = 1 / odds.sum(1)
                for t, b, s in zip(some, best, sure, strict=True):
                    known = has_letter(t)
                    preds.append(at.langs[b] if known else UNKNOWN)
                    scores.append(float(s) if known else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
