"""Schemas of the corpus and of the stored tables."""

from __future__ import annotations

ENTRY = "id string, label string, source string, class string, latex string, lhs string, rhs string, verified string"
#: Columns of a formula that results carry.
FORMULA = ("entry_id", "side", "label", "source", "class", "latex", "mma", "canonical", "signature", "verified")
FORMULAS = ", ".join(f"{c} string" for c in FORMULA) + ", tokens array<string>, facets array<string>, side_latex string, n_tokens int"
FACETS = "entry_id string, side string, facet string"
POSTINGS = "entry_id string, side string, tok string, tf long, length int"
PROOFS = "entry_id string, system string, status string, proof binary, updated timestamp"
META = "key string, value string"
SCHEMA_VERSION = "2"
