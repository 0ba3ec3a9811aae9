"""What the service answers, as DataFrames under the service's field names."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiomata.config import Config
from axiomata.functions import features
from axiomata.functions.canonical import canonical
from axiomata.functions.expressions import ParseError, parse
from axiomata.operators.store import Store

HIT = ("entry_id", "side", "label", "class", "latex", "mma", "identity_mma", "identity_latex", "signature", "score", "occurrences")


def stats(store: Store) -> DataFrame:
    return store.formulas.agg(F.count("*").alias("count"))


def search(store: Store, q: str, config: Config | None = None) -> dict[str, Any]:
    """query_canonical, exact and fuzzy, and a warning if the store is stale; or an error, for text that isn't a formula. An empty query is refused."""
    if not q:
        raise ValueError("q is required")
    config = config or Config()
    try:
        form = canonical(parse(q))
    except ParseError as e:
        return {"error": str(e)}
    fuzzy = store.fuzzy(features.tokens_from(form), config.search.fuzzy_limit, config.search.pool)
    found = {"query_canonical": form, "exact": store.exact(q).select(*HIT), "fuzzy": fuzzy.select(*HIT)}
    return found | ({"warning": store.warning()} if store.warning() else {})


def facets(store: Store, f: list[str], config: Config | None = None) -> dict[str, Any]:
    """selected, total, refine, limit and hits, which are empty unless few enough formulas match."""
    limit = (config or Config()).search.fuzzy_limit
    found = store.facets(f, limit)
    return {"selected": list(f), "total": found.total, "refine": found.refine, "limit": limit, "hits": found.hits.select(*HIT)}


def add(store: Store, entry: dict[str, str]) -> DataFrame:
    """Signatures by side of an entry that was added."""
    return store.add(entry)


def get_proof(store: Store, entry_id: str) -> DataFrame:
    """entry_id, system, status and proof as text; no row if there is none."""
    return store.proof(entry_id).select(F.lit(entry_id).alias("entry_id"), "system", "status", F.decode("proof", "UTF-8").alias("proof"))


def put_proof(store: Store, entry_id: str, system: str, proof: str, status: str = "") -> None:
    store.set_proof(entry_id, system, proof.encode(), status or "draft")
