"""A versioned store of formulas on Parquet.

A change writes one new segment, which holds the changed formulas with their facets and postings,
and then a pointer to all segments. Pointers are numbered files that are created exclusively and
end in a mark: the highest complete one holds. So readers keep the version they opened, a write
that breaks off changes nothing, and of two writers that began from the same version one fails.
A formula of a newer segment replaces those of older ones; when segments get many they are merged.
In a segment formulas are sorted by signature, facets by facet and postings by token, so that
searches skip row groups.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomata import schema
from axiomata.functions.canonical import engine_probe, signature
from axiomata.functions.expressions import parse
from axiomata.operators import search
from axiomata.sources import corpus

TABLES = {"formulas": schema.FORMULAS, "facets": schema.FACETS, "postings": schema.POSTINGS, "proofs": schema.PROOFS}
KEYS = {"formulas": ["entry_id", "side"], "facets": ["entry_id", "side"], "postings": ["entry_id", "side"], "proofs": ["entry_id"]}
SORTED = {"formulas": "signature", "facets": "facet", "postings": "tok", "proofs": "entry_id"}
#: Which segments a table is in, and what says which keys a segment replaces.
GROUP = {"formulas": "formulas", "facets": "formulas", "postings": "formulas", "proofs": "proofs"}
#: Segments of a group that are merged into one.
MOST = 16
_END = "end"


class Changed(RuntimeError):
    """Another writer published a version in the meantime; nothing was changed."""


class Ingested(NamedTuple):
    """What an ingest did."""

    total: int
    indexed: int
    rejected: DataFrame
    skipped: DataFrame


class Version(NamedTuple):
    """A pointer: its number, the segments of each group, oldest first, and the settings."""

    number: int
    segments: dict[str, list[str]]
    meta: dict[str, str]


class Store:
    """Tables under one folder, which may be in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda p: path(f"{self.root}/{p}")
        self._fs = path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        if self._newest() is None:
            if self._names():
                raise ValueError(f"{self.root} holds files but no complete pointer; it isn't opened as an empty store")
            self._publish(Version(0, {"formulas": [], "proofs": []}, {"schema_version": schema.SCHEMA_VERSION}))

    # versions

    def _names(self) -> list[str]:
        root = self._path("")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(root)) if self._fs.exists(root) else []

    def _newest(self) -> Version | None:
        """The highest complete pointer; one that a crash left incomplete is passed over."""
        for name in reversed([n for n in self._names() if n.startswith("VERSION-")]):
            lines = [r["value"] for r in self.spark.read.text(f"{self.root}/{name}").collect()]  # two lines
            if len(lines) == 2 and lines[1] == _END:
                found = json.loads(lines[0])
                return Version(int(name.split("-")[1]), found["segments"], found["meta"])
        return None

    @property
    def version(self) -> Version:
        return self._newest()

    def _publish(self, after: Version) -> None:
        """Writes a pointer under its number, which nobody may have written yet."""
        used = [int(n.split("-")[1]) for n in self._names() if n.startswith("VERSION-")]
        newest = self._newest()
        if newest is not None and newest.number >= after.number:
            raise Changed(f"version {newest.number} came before {after.number}")
        number = max([after.number, *(n + 1 for n in used)])  # past incomplete ones
        try:
            out = self._fs.create(self._path(f"VERSION-{number:010d}"), False)
        except Exception as e:
            raise Changed(f"version {number} was written by another") from e
        out.write(bytearray((json.dumps({"segments": after.segments, "meta": after.meta}) + f"\n{_END}\n").encode()))
        out.close()

    def _written(self, **tables: DataFrame) -> str:
        segment = f"segment-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.sortWithinPartitions(SORTED[name]).write.parquet(f"{self.root}/{segment}/{name}")
        return segment

    def _segment(self, segment: str, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{segment}/{name}")

    def _indexed(self, formulas: DataFrame) -> str:
        """A segment of formulas with their facets and postings."""
        segment = self._written(formulas=formulas)
        mine = self._segment(segment, "formulas")
        for name, rows in (("facets", search.facet_rows(mine)), ("postings", search.postings(mine))):
            rows.sortWithinPartitions(SORTED[name]).write.parquet(f"{self.root}/{segment}/{name}")
        return segment

    def _grown(self, group: str, segment: str, begun: Version) -> None:
        """Publishes one more segment of a group, merging them first if there are many."""
        segments = [*begun.segments[group], segment]
        if len(segments) > MOST:
            merged = self._table(group, segments)
            segments = [self._indexed(merged) if group == "formulas" else self._written(proofs=merged)]
        self._publish(Version(begun.number + 1, begun.segments | {group: segments}, begun.meta))

    def _table(self, name: str, segments: list[str]) -> DataFrame:
        """What the newest segment that holds a key says of it."""
        if not segments:
            return self.spark.createDataFrame([], TABLES[name])
        base, *later = segments
        if not later:
            return self._segment(base, name)
        keys = KEYS[name]
        union = lambda frames: reduce(DataFrame.unionByName, frames)
        holder = union([self._segment(s, GROUP[name]).select(*keys, F.lit(k).alias("seg")) for k, s in enumerate(later)]).groupBy(*keys).agg(F.max("seg").alias("seg"))
        changed = union([self._segment(s, name).withColumn("seg", F.lit(k)) for k, s in enumerate(later)]).join(holder, [*keys, "seg"], "left_semi").drop("seg")
        return self._segment(base, name).join(holder, keys, "left_anti").unionByName(changed)

    def table(self, name: str) -> DataFrame:
        if name == "meta":
            return self.spark.createDataFrame(sorted(self.version.meta.items()), schema.META)
        return self._table(name, self.version.segments[GROUP[name]])

    @property
    def formulas(self) -> DataFrame:
        return self.table("formulas")

    # writing

    def upsert(self, formulas: DataFrame, order: list[str]) -> None:
        """Inserts formulas, or replaces those of the same entry and side; the last by ``order`` stays."""
        begun = self.version
        names = [c.split()[0] for c in schema.FORMULAS.split(", ")]
        sized = formulas.withColumn("n_tokens", F.size("tokens"))
        fresh = search.latest(sized.select(*names, *[c for c in order if c not in names]), KEYS["formulas"], order).select(*names)
        self._grown("formulas", self._indexed(fresh), begun)

    def ingest(self, files: list[str], rebuild: bool = False) -> Ingested:
        """Reads corpus files into the store; afresh if asked to, or if the stored forms are of another engine."""
        if rebuild or self.stale()[0]:
            self.reset()
        entries, skipped = corpus.read_entries(self.spark, files)
        good, rejected = self._analysed(corpus.sides(entries))
        indexed = good.count()
        self.upsert(good, ["seq", "pos"])
        return Ingested(indexed + rejected.count(), indexed, rejected, skipped)

    def _analysed(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(formulas, rejected) of sides, whose analysis is written once."""
        path = f"{self.root}/work-{uuid.uuid4().hex}"
        corpus.analysis(rows).write.parquet(path)
        return corpus.parted(self.spark.read.parquet(path))

    def add(self, entry: dict[str, str]) -> DataFrame:
        """Adds one entry, whole or not at all; returns its signatures by side."""
        if not entry.get("id"):
            raise ValueError("id is required")
        rows = corpus.sides(self.spark.createDataFrame([tuple(entry.get(f, "") for f in corpus.FIELDS)], schema.ENTRY))
        good, rejected = corpus.analysed(rows)
        bad = rejected.first()
        if bad:
            raise ValueError(f"{bad['side']}: {bad['error']}")
        if good.isEmpty():
            raise ValueError("lhs or rhs is required")
        self.upsert(good, ["pos"])
        return search.signatures_by_side(good)

    def reset(self) -> None:
        """Empties formulas, facets and postings, keeps proofs, and records the engine."""
        begun = self.version
        meta = begun.meta | {"engine_probe": engine_probe(), "schema_version": schema.SCHEMA_VERSION}
        self._publish(Version(begun.number + 1, begun.segments | {"formulas": []}, meta))

    def set_meta(self, key: str, value: str) -> None:
        begun = self.version
        self._publish(Version(begun.number + 1, begun.segments, begun.meta | {key: value}))

    def set_proof(self, entry_id: str, system: str, proof: bytes, status: str = "draft") -> None:
        if not system or not proof:
            raise ValueError("system and proof are required")
        row = self.spark.createDataFrame([(entry_id, system, status, bytearray(proof))], "entry_id string, system string, status string, proof binary")
        self.set_proofs(row)

    def set_proofs(self, proofs: DataFrame) -> None:
        """Upserts proofs (entry_id, system, status, proof), one of each entry."""
        begun = self.version
        rows = proofs.select("entry_id", "system", "status", "proof", F.current_timestamp().alias("updated"))
        self._grown("proofs", self._written(proofs=rows), begun)

    # reading

    def meta(self, key: str) -> str:
        return self.version.meta.get(key, "")

    def proof(self, entry_id: str) -> DataFrame:
        """The proof of an entry, or no row."""
        return self.table("proofs").where(F.col("entry_id") == entry_id).select("system", "status", "proof")

    def stale(self) -> tuple[bool, str]:
        """Whether stored forms may differ from what this engine makes, and why."""
        probe, version = self.meta("engine_probe"), self.meta("schema_version")
        if not probe:
            return True, "no engine fingerprint recorded (empty store)"
        if probe != engine_probe():
            return True, "the canonical engine has changed"
        if version != schema.SCHEMA_VERSION:
            return True, f"schema version {version}, not {schema.SCHEMA_VERSION}"
        return False, ""

    def warning(self) -> str:
        """What to tell users of a stale store, which is searched all the same; empty for any other."""
        old, why = self.stale()
        return f"the store is stale: {why}; results may lack matches until it is ingested again" if old else ""

    def count(self) -> int:
        return self.formulas.select("entry_id").count()

    def exact(self, text: str) -> DataFrame:
        return search.with_identities(search.exact(self.formulas, signature(parse(text))), self.formulas)

    def fuzzy(self, query_tokens: list[str], limit: int = search.FUZZY_LIMIT, pool: int = search.POOL) -> DataFrame:
        formulas = self.formulas
        return search.with_identities(search.fuzzy(formulas, query_tokens, limit, pool, self.table("postings")), formulas)

    def facets(self, selected: list[str], limit: int = search.FUZZY_LIMIT) -> search.Facets:
        found = search.facets(self.formulas, selected, limit, rows=self.table("facets"))
        return found._replace(hits=search.with_identities(found.hits, self.formulas))

    def duplicates(self, limit: int = search.FUZZY_LIMIT) -> tuple[int, DataFrame]:
        return search.duplicate_signatures(self.formulas).count(), search.duplicates(self.formulas, limit)
