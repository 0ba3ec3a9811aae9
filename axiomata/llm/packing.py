"""Packing token pieces into sequences through a configuration linear program.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens. All that packing
needs is how many pieces there are of each length, a histogram of at most ``capacity`` rows. A
configuration says how many pieces of each length share a sequence. The linear program "fewest
configurations that cover the histogram" is solved by multiplicative weights: a length's price is
its share of a sequence, times a weight that falls as the length gets covered. Each round a
knapsack dynamic program finds the best configurations at these prices, which are used as often as
leaves a part of every length that they need, until all is covered. Its value is within a fraction
of a percent of the bound that the prices prove (``Program.gap``). The fractional solution is
rounded systematically, and what rounding leaves is a smaller histogram with a program of its own,
until few pieces are left. Those are filled in largest first. The plan is a few runs of equal
sequences per length, so each piece finds its place from its rank among the pieces of its length,
with no further exchange.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axiomata.llm.tables import Scratch, table

CAPACITY = 2048
#: Follows every document.
END = 0
#: Chunks of text whose ids are remembered by a worker; beyond it the memory starts afresh.
REMEMBERED = 600_000
#: Characters that are tokenised together.
TOGETHER = 1 << 20
#: How fast weights fall; the part of what is left that a configuration takes; what counts as covered; lengths priced by one dynamic program.
RATE, PART, CRUMB, BLOCK = 0.1, 0.5, 0.02, 1024
#: The gap between a program's value and the bound at which passes end.
GAP = 0.01
#: Tokens that a rounded configuration may leave empty beyond the program's gap; pieces left that are filled in without a program.
SLACK, FEW = 4, 256
SEED = 20260106
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Bytes as byte-level vocabularies spell them: printable ones as themselves, others in order from U+0100; blanks stay.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SPELLED = {x: 0x100 + k for k, x in enumerate(sorted(set(range(256)) - set(_PRINTED))) if x != 0x20}


class Chunked:
    """Token ids of whole texts, by chunks between blanks and line feeds.

    Such a place always ends a token of a tokenizer that drops white space and lowers case, so a
    text's ids are its chunks' ids in order, and most chunks were met before. A new chunk that is
    a word and a full stop or comma is taken apart. New words are tokenised in one call: each ends
    with a token that carries the end-of-word mark. Words of letters below U+0100 need neither
    normalising nor splitting, so their bytes are spelled out here and only merged there. Other
    new chunks are parted by a special token.
    """

    def __init__(self, path: str, parting: str = "<|startoftext|>", mark: str = "</w>"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.parting, self.parting_id = parting, self.tokenizer.token_to_id(parting)
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.ends[k] = token.endswith(mark)
        self.known: dict[str, bytes] = {"": b""}
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer, self.plain.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        probe = ["the", "Zebra", "straße", "ÀÉÎÕÜ", "naïveté", "ñandú", "ªºµ", "xyzzyqwv", "þÿð"]
        if not np.array_equal(self.merged(probe), self.ids(" ".join(probe))):
            self.plain = None

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def merged(self, words: list[str]) -> np.ndarray:
        """Ids of words of letters below U+0100."""
        spelled = " ".join(words).lower()
        if not spelled.isascii():
            spelled = spelled.encode().decode("latin-1").translate(_SPELLED)
        return np.array(self.plain.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, "<u4")

    def learn_parts(self, chunks: list[str], found: np.ndarray, ends: np.ndarray, gap: int) -> None:
        raw, at = found.tobytes(), 0
        for c, end in zip(chunks, (ends * 4).tolist(), strict=True):
            self.known[c] = raw[at:end]
            at = end + gap

    def learn_words(self, words: list[str], low: bool = False) -> None:
        found = self.merged(words) if low else self.ids(" ".join(words))
        ends = np.flatnonzero(self.ends[found]) + 1
        if len(ends) == len(words):
            self.learn_parts(words, found, ends, 0)
        else:  # some word is more than one to this tokenizer
            self.learn_others(words)

    def learn_others(self, chunks: list[str]) -> None:
        plain = [c for c in chunks if self.parting not in c]
        for c in chunks:
            if self.parting in c:
                self.known[c] = self.ids(c).tobytes()
        if plain:
            found = self.ids(self.parting.join(plain))
            self.learn_parts(plain, found, np.append(np.flatnonzero(found == self.parting_id), len(found)), 4)

    def learn(self, chunks: list[str]) -> None:
        known, apart, words, others = self.known, [], set(), []
        for c in chunks:
            # lower case may end in a mark, which then joins what follows
            word, tail = (c[:-1], c[-1]) if c[-1] in ".," and c[:-1].isalpha() and c[:-1].lower().isalpha() else (c, "")
            if word.isascii():
                word = word.lower()
            if word.isalpha():
                if word not in known:
                    words.add(word)
            elif word not in known:
                others.append(word)
            if word != c:
                apart.append((c, word, tail))
        simple = [w for w in words if w.isascii()] if self.plain else []
        latin = [w for w in words if not w.isascii() and max(w) < "\u0100"] if self.plain else []
        for some in (simple, latin):
            if some:
                self.learn_words(some, low=True)
        rest = list(words.difference(simple, latin))
        if rest:
            self.learn_words(rest)
        self.learn_others([*others, *(x for x in ".," if x not in known)])
        for c, word, tail in apart:
            known[c] = known[word] + known[tail] if tail else known[word]

    def encoded(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        chunks = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {"": b""}
        known = self.known
        new = [c for c in set().union(*chunks) if c not in known]
        for k in range(0, len(new), 5_000):
            self.learn(new[k : k + 5_000])
        return [b"".join(map(known.__getitem__, c)) for c in chunks]


_made: dict[str, Chunked] = {}


def _cut(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _made.setdefault(path, None) or Chunked(path)
        _made[path] = coder
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            rows: list[list] = [[], [], [], [], [], []]
            k = 0
            while k < len(keys):
                some, size = [], 0
                while k + len(some) < len(keys) and (not some or size < TOGETHER):
                    some.append(texts[k + len(some)].as_py() or "")
                    size += len(some[-1])
                for key, raw in zip(keys[k : k + len(some)], coder.encoded(some), strict=True):
                    raw += end
                    for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        for column, value in zip(rows, (key, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None), strict=True):
                            column.append(value)
                k += len(some)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, its ids."""
    schema = PIECES + (", ids binary" if with_ids else "")
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_cut(tokenizer or vocabulary(), capacity, with_ids), schema)


def best_fillings(lengths: np.ndarray, prices: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounded knapsack: for every room up to ``capacity`` the best price, and by length how many copies the best filling takes last."""
    best, taken = np.zeros(capacity + 1), np.zeros((len(lengths), capacity + 1), np.uint16)
    for i, x in enumerate(lengths.tolist()):
        left, part = min(int(counts[i]), capacity // x), 1
        while left > 0:  # copies in parts of 1, 2, 4, ...
            k = min(part, left)
            left, part = left - k, 2 * part
            rest = capacity + 1 - k * x
            worth = best[:rest] + k * prices[i]
            better = worth > best[k * x :] + 1e-12
            if better.any():
                taken[i, k * x :] = np.where(better, taken[i, :rest] + k, taken[i, k * x :])
                best[k * x :] = np.where(better, worth, best[k * x :])
    return best, taken


def spelled_out(lengths: np.ndarray, taken: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Copies of each length in the best filling of each room."""
    out, room = np.zeros((len(room), len(lengths)), np.int64), room.copy()
    for i in range(len(lengths) - 1, -1, -1):
        out[:, i] = taken[i, room]
        room -= out[:, i] * int(lengths[i])
    return out


class Program(NamedTuple):
    """A fractional solution: configurations with multiplicities, their sum, and a bound that no solution goes below."""

    columns: list[tuple[dict[int, int], float]]
    value: float
    bound: float

    @property
    def gap(self) -> float:
        return self.value / self.bound - 1


def covering(lengths: np.ndarray, need: np.ndarray, capacity: int, base: np.ndarray, rng: np.random.Generator) -> list[tuple[dict[int, int], float]]:
    """One pass of multiplicative weights over prices ``base``: configurations with multiplicities that cover all but crumbs."""
    left, columns = need.copy(), {}
    crumb = np.maximum(CRUMB, need * CRUMB / 20)
    while (left > crumb).any():
        lacking = rng.permutation(np.flatnonzero(left > crumb))
        price = base * np.exp(RATE * (left / need - 1))
        for block in np.array_split(lacking, -(-len(lacking) // BLOCK)):
            block = np.sort(block)
            own = lengths[block]
            best, taken = best_fillings(own, price[block], np.ceil(left[block] - 1e-9), capacity)
            value = price[block] + best[capacity - own]  # of the best configuration that holds this length
            copies = spelled_out(own, taken, capacity - own)
            copies[np.arange(len(block)), np.arange(len(block))] += 1
            for k in np.argsort(-value, kind="stable").tolist():
                at = np.flatnonzero(copies[k])
                most = float((left[block[at]] / copies[k, at]).min())
                if most <= CRUMB / 2:
                    continue
                times = most * PART if most * PART > 2 * CRUMB else most
                left[block[at]] -= copies[k, at] * times
                key = tuple(zip(own[at].tolist(), copies[k, at].tolist(), strict=True))
                columns[key] = columns.get(key, 0.0) + times
    return [(dict(key), times) for key, times in columns.items()]


def fractional(counts: dict[int, int], capacity: int, rng: np.random.Generator) -> Program:
    """The covering program of a histogram, to a gap of GAP or until passes no longer lower it.

    A pass starts from prices in proportion to length. What a length then costs, its share of the
    sequences that hold it, is the next pass's price; lengths that fill sequences badly cost more.
    Any prices prove a bound: no sequence holds more of them than their best filling.
    """
    lengths = np.array(sorted(counts))
    need = np.array([counts[x] for x in lengths.tolist()], float)
    place = {x: k for k, x in enumerate(lengths.tolist())}
    base = lengths / capacity
    found, bound, stalled = None, 0.0, 0
    while True:
        before = found.value / bound if found else math.inf
        columns = covering(lengths, need, capacity, base, rng)
        value = sum(t for _, t in columns)
        if found is None or value < found.value:
            found = Program(columns, value, 0.0)
        cost, covered = np.zeros(len(lengths)), np.full(len(lengths), 1e-9)
        for copies, times in columns:
            at = np.array([place[x] for x in copies])
            share = np.array(list(copies.values())) * times
            covered[at] += share
            cost[at] += share * lengths[at] / sum(x * n for x, n in copies.items())
        cost = np.where(cost > 0, cost / covered, base)
        for prices in (base, cost):
            bound = max(bound, float((prices * need).sum() / best_fillings(lengths, prices, need, capacity)[0][capacity]))
        stalled = stalled + 1 if before - found.value / bound < GAP / 10 else 0
        if found.value <= (1 + GAP) * bound or stalled == 2:
            return found._replace(bound=bound)
        base = np.sqrt(base * cost)


class Plan(NamedTuple):
    """Runs of equal sequences, how many pieces rounded programs placed, and the programs' gaps."""

    runs: list[tuple[dict[int, int], int]]
    rounded: int
    gaps: list[float]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """(configuration, number of sequences) for a histogram of lengths; covers it exactly."""
    left = {x: n for x, n in counts.items() if n > 0}
    runs, rounded, gaps = [], 0, []
    rng = np.random.default_rng(SEED)

    def use(copies: dict[int, int], most: float = math.inf) -> int:
        times = int(min(most, *(left.get(x, 0) // n for x, n in copies.items())))
        if times > 0:
            runs.append((copies, times))
            for x, n in copies.items():
                left[x] -= n * times
                if not left[x]:
                    del left[x]
        return times * sum(copies.values())

    if capacity in left:  # a full piece is a sequence, in any solution
        rounded += use({capacity: 1})
    while sum(left.values()) > FEW:
        program = fractional(left, capacity, rng)
        gaps.append(program.gap)
        order = rng.permutation(len(program.columns))
        shares = np.array([program.columns[k][1] for k in order])
        ends = np.cumsum(shares)
        whole = np.floor(ends + 0.5) - np.floor(ends - shares + 0.5)  # so that sums of multiplicities stay what they are
        placed = 0
        for k, times in zip(order.tolist(), whole.tolist(), strict=True):
            copies = program.columns[k][0]
            if times > 0 and capacity - sum(x * n for x, n in copies.items()) <= SLACK + capacity * max(0, program.gap):
                placed += use(copies, times)
        rounded += placed
        if placed < FEW // 4:
            break
    while left:  # the largest piece left starts a sequence; the rest of it is the fullest filling that the pieces left allow
        first = max(left)
        lengths = np.array(sorted(x for x in left if x <= capacity - first and left[x] > (x == first)))
        copies = {first: 1}
        if len(lengths):
            free = np.array([left[x] - (x == first) for x in lengths.tolist()])
            _, taken = best_fillings(lengths, lengths.astype(float), free, capacity - first)
            for x, n in zip(lengths.tolist(), spelled_out(lengths, taken, np.array([capacity - first]))[0].tolist(), strict=True):
                if n:
                    copies[x] = copies.get(x, 0) + n
        use(copies)
    return Plan(runs, rounded, gaps)


class Places:
    """Where the pieces of each length go, by their rank among those of that length."""

    def __init__(self, runs: list[tuple[dict[int, int], int]]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        ranks: dict[int, int] = {}
        sequence = 0
        for copies, times in runs:
            offset = 0
            for x, n in sorted(copies.items(), reverse=True):
                rows.setdefault(x, []).append((ranks.get(x, 0), n, sequence, offset))
                ranks[x] = ranks.get(x, 0) + n * times
                offset += x * n
            sequence += times
        self.sequences = sequence
        self.rows = {x: np.array(v, np.int64) for x, v in rows.items()}

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for x in np.unique(length):
            at = np.flatnonzero(length == x)
            run = self.rows[int(x)][np.searchsorted(self.rows[int(x)][:, 0], rank[at], "right") - 1]
            past = rank[at] - run[:, 0]
            sequence[at] = run[:, 2] + past // run[:, 1]
            offset[at] = run[:, 3] + past % run[:, 1] * x
        return sequence, offset


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece with its sequence_id and its offset there.

    Only key and text of ``docs`` are read. A null or empty text is the end token alone. Texts of
    any length are tokenised whole and cut only beyond ``capacity`` tokens. Repeated rows are
    packed once each; an empty table packs into nothing. Sequences are gapless from offset 0, and
    a sequence may end before its capacity.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = scratch.keep(pieces(docs, tokenizer, capacity, key, text, with_ids))
    total = cut.count()
    # Ranks among equal lengths are dealt by (length, part): a length that holds much of the table is split.
    parts = max(16, min(4096, total // 500_000))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    before = np.zeros((capacity + 1, parts + 1), np.int64)
    for r in cut.groupBy("length", "part").count().collect():  # at most capacity * parts rows
        before[r["length"], r["part"] + 1] = r["count"]
    counts = {x: int(n) for x, n in enumerate(before.sum(1)) if n}
    before = before.cumsum(1)
    places = Places(plan(counts, capacity).runs)
    shared = spark.sparkContext.broadcast((before, places))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, where = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda name, b=batch: b.column(name).to_numpy(zero_copy_only=False)
            sequence, offset = where.of(column("length"), start[column("length"), column("part")] + column("rank") - 1)
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    names = [c for c in cut.columns if c != "part"]
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece")).cast("long"))
    schema = PIECES + (", ids binary" if with_ids else "") + ", sequence_id long, offset long"
    return ranked.mapInArrow(put, schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents", "doc_id", "text"))
