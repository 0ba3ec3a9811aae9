"""SentencePiece encoding and decoding through a lattice of pieces.

A text is cut where no piece can reach across: before blanks and line feeds. For each word, its
substrings of bounded length are equi-joined to the piece table, and the edges found are grouped
by word. The piece table is a merge (BPE) model, whose segmentation isn't the path of the largest
sum that Viterbi's recurrence finds; so the fold over a word's edges merges, at every step, the
two neighbours whose edge has the best score, leftmost first, until no edge joins two neighbours.

The words that make up one of every LEXICON words of the corpus or more go through ``lattice``, in
DataFrame operations, into a lexicon; there are never more of them than that. Tasks fold the
lattices of other words themselves, by the same rule.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomata.llm.tables import Scratch, table

BLANK = "▁"
#: A word is in the lexicon if it is one of every so many or more frequent; characters of a word in it.
LEXICON, LONGEST = 200_000, 32
#: Words whose ids a worker remembers, and whose counts it holds back.
REMEMBERED, PENDING = 400_000, 200_000
#: Characters encoded together.
TOGETHER = 1 << 20
_NO_EDGE = float("-inf")
_PARTS = re.compile(f"{BLANK}+[^{BLANK}\n]*|\n[^{BLANK}\n]*|[^{BLANK}\n]+")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """A model's pieces with ids and scores, and its bytes' ids."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.names = [model.id_to_piece(k) for k in range(n)]
        plain = [k for k in range(n) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
        self.table = {self.names[k]: (k, model.get_score(k)) for k in plain}
        self.byte = {int(self.names[k][3:5], 16): k for k in range(n) if model.is_byte(k)}
        self.longest = max(map(len, self.table))
        self.raw = [name.replace(BLANK, " ").encode() for name in self.names]
        for value, k in self.byte.items():
            self.raw[k] = bytes([value])
        for k in range(n):
            if model.is_control(k) or model.is_unknown(k):
                self.raw[k] = b""

    def folded(self, word: str) -> list[int]:
        """Ids of a word: its lattice's edges merged by score, then characters without a piece as bytes.

        Only edges that join two neighbours count, so they are looked up when neighbours arise.
        """
        if len(word) > LONGEST:
            return self.folded_long(word)
        get, none = self.table.get, (0, _NO_EDGE)
        found = list(word)
        scores = [get(x + y, none)[1] for x, y in zip(found[:-1], found[1:], strict=True)]
        while scores:
            best = max(scores)
            if best == _NO_EDGE:
                break
            i = scores.index(best)
            found[i : i + 2] = [found[i] + found[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = get(found[i - 1] + found[i], none)[1]
            if i < len(scores):
                scores[i] = get(found[i] + found[i + 1], none)[1]
        return self.named(found)

    def folded_long(self, word: str) -> list[int]:
        """The same with a heap of joins, so that a long word takes little more than linear time."""
        import heapq

        n = len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))
        alive = [True] * n
        heap: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                hit = self.table.get(word[i : end[j]]) if end[j] - i <= self.longest else None
                if hit:
                    heapq.heappush(heap, (-hit[1], i, end[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j], end[i], after[i] = False, end[j], after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return self.named([word[i : end[i]] for i in range(n) if alive[i]])

    def named(self, found: list[str]) -> list[int]:
        out: list[int] = []
        for piece in found:
            hit = self.table.get(piece)
            if hit:
                out.append(hit[0])
            else:
                out += [self.byte[x] for x in piece.encode("utf-8", "replace")]
        return out

    def decoded(self, ids: list[int]) -> str:
        """The text of some ids; without the blank that encoding puts first."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def parts(text: str) -> list[str]:
    """Words of a text that no piece reaches across; those without a leading line feed stand after a blank.

    A word is given without that blank, so ``x`` is the piece text of a blank and x, and a word
    that begins with further blanks keeps them.
    """
    if not text:
        return []
    if "  " not in text and text[0] != " " and BLANK not in text:
        return text.replace("\n", " \n").split(" ")
    found = _PARTS.findall(BLANK + text.replace(" ", BLANK))
    return [p[1:] if p[0] == BLANK else p for p in found]


def spelled(part: str) -> str:
    """The characters that a part stands for."""
    return part if part[:1] == "\n" else BLANK + part


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["part", "n"])

    for batch in batches:
        for text in batch.column("text"):
            seen.update(parts(text.as_py() or ""))
            if len(seen) > PENDING:
                yield rows()
                seen.clear()
    if seen:
        yield rows()


def lattice(words: DataFrame, pieces: Pieces, word: str = "word") -> DataFrame:
    """(word, ids) of distinct words of up to LONGEST characters, in DataFrame operations.

    The places between a word's characters are bits of a number, set where neighbours meet. An edge
    knows the bits at its ends and those between them; it joins two neighbours if both ends are set
    and one bit between is, which the fold then clears, for the best such edge at every step.
    """
    spark = words.sparkSession
    listed = [(p, k, float(s)) for p, (k, s) in pieces.table.items()]
    table_ = spark.createDataFrame(listed, "piece string, id int, score double")  # the model's pieces: a fixed number
    spans = F.explode(
        F.flatten(F.transform(F.sequence(F.lit(0), F.length(word) - 1), lambda a: F.transform(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), F.length(word) - a)), lambda n: F.struct(a.alias("a"), (a + n).alias("b")))))
    ).alias("s")
    substrings = words.where(F.length(word) > 0).select(word, spans).select(word, "s.a", "s.b", F.substring(F.col(word), F.col("s.a") + 1, F.col("s.b") - F.col("s.a")).alias("piece"))
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at)
    ends = bit(F.col("a")).bitwiseOR(bit(F.col("b")))
    inner = bit(F.col("b")) - bit(F.col("a") + 1)
    edge = F.struct((-F.col("score")).alias("cost"), "a", "b", ends.alias("ends"), inner.alias("inner"), "id")
    edges = substrings.join(F.broadcast(table_), "piece").groupBy(word).agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    known = words.select(word).distinct().join(edges, word, "left")
    none = F.array().cast("array<struct<cost:double,a:int,b:int,ends:bigint,inner:bigint,id:int>>")
    known = known.where(F.length(word) > 0).withColumn("edges", F.coalesce("edges", none))

    def merge(cuts: Column, _: Column) -> Column:
        def joins(e: Column) -> Column:
            between = cuts.bitwiseAND(e["inner"])
            return (cuts.bitwiseAND(e["ends"]) == e["ends"]) & (between != 0) & (between.bitwiseAND(between - 1) == 0)

        return F.coalesce(cuts.bitwiseAND(F.bitwise_not(F.get(F.filter("edges", joins), F.lit(0))["inner"])), cuts)

    start = bit(F.length(word) + 1) - 1
    places = F.sequence(F.lit(0), F.length(word))

    def ids(cuts: Column) -> Column:
        def of(a: Column, i: Column) -> Column:
            b = F.get(cuts, i + 1)
            hit = F.get(F.filter("edges", lambda e: (e["a"] == a) & (e["b"] == b)), F.lit(0))["id"]
            raw = F.hex(F.encode(F.substring(F.col(word), a + 1, b - a), "UTF-8"))
            spelt = F.transform(F.sequence(F.lit(0), (F.length(raw) / 2).cast("int") - 1), lambda k: F.conv(F.substring(raw, k * 2 + 1, F.lit(2)), 16, 10).cast("int") + pieces.byte[0])
            return F.when(hit.isNotNull(), F.array(hit)).otherwise(spelt)

        return F.flatten(F.transform(F.slice(cuts, 1, F.size(cuts) - 1), of))

    folded = F.aggregate(F.sequence(F.lit(1), F.length(word)), start, merge)
    found = _bind(folded, lambda still: _bind(F.filter(places, lambda at: still.bitwiseAND(bit(at)) != 0), ids))
    return known.select(word, found.alias("ids"))


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_loaded: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


class Encoder:
    """Texts to ids through a memory of parts, which starts from a lexicon."""

    def __init__(self, pieces: Pieces, lexicon: dict[str, bytes]):
        self.pieces, self.lexicon, self.known = pieces, lexicon, dict(lexicon)

    def encoded(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        known, out = self.known, parts(text)
        if len(known) > REMEMBERED:
            known = self.known = dict(self.lexicon)
        for p in out:
            if p not in known:
                known[p] = np.array(self.pieces.folded(spelled(p)), "<u4").tobytes()
        return b"".join(map(known.__getitem__, out))


def encoded(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, round_trip (and ids, as little-endian 32-bit numbers) for every row.

    Only key and text are read. A null or empty text has no ids. round_trip says whether decoding
    gives the text back; it does unless a text holds the blank sign itself or broken characters.
    Texts of any length are encoded whole; repeated rows give repeated rows, an empty table none.
    """
    spark = docs.sparkSession
    path = path or model_path()
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = pieces_of(path)
    scratch = Scratch(spark, "pieces")
    counts = scratch.keep(docs.select("text").mapInArrow(_counted, "part string, n long").groupBy("part").agg(F.sum("n").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = counts.where((F.length("part") < LONGEST) & (F.col("n") * LEXICON >= total))
    words = frequent.select("part", F.when(F.col("part").startswith("\n"), F.col("part")).otherwise(F.concat(F.lit(BLANK), F.col("part"))).alias("word"))
    words = scratch.keep(words)
    spelt = scratch.keep(words.join(lattice(words, pieces), "word").select("part", "ids"))
    lexicon = {r["part"]: np.array(r["ids"], "<u4").tobytes() for r in spelt.collect()}  # LEXICON rows at most
    shared = spark.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces_of(path)
        coder = Encoder(known, shared.value)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for value in batch.column("text"):
                whole = value.as_py() or ""
                raw = coder.encoded(whole)
                same = known.decoded(np.frombuffer(raw, "<u4").tolist()) == whole
                for column, x in zip(out, (len(raw) // 4, zlib.crc32(raw), same, raw), strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary()][: 3 + with_ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, kinds, strict=False))], names=["doc_id", "n_tokens", "ids_crc32", "round_trip", "ids"][: 4 + with_ids])

    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean" + (", ids binary" if with_ids else ""))


def op7_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents", "doc_id", "text"))
