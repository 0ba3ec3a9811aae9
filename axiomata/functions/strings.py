"""Scalar helpers of the serving side, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that blank sides may consist of.
BLANK = r"^[\s\p{Z}\u0085]*$"


def first_non_empty(a: Column, b: Column) -> Column:
    return F.coalesce(F.nullif(a, F.lit("")), b)


def not_blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(BLANK)


def bearer(header: Column) -> Column:
    """The token of an Authorization header, or empty."""
    return F.when(header.startswith("Bearer "), F.trim(F.substring(header, 8, F.length(header)))).otherwise(F.lit(""))


def client_ip(forwarded: Column, remote: Column) -> Column:
    """The first forwarded address, else the host of the peer's address."""
    first = F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))
    host = F.regexp_extract(remote, r"^\[?(.*?)\]?(?::[0-9]+)?$", 1)
    return F.when(F.coalesce(forwarded, F.lit("")) != "", first).otherwise(host)


def subject(provider: Column, who: Column) -> Column:
    return F.concat_ws(":", provider, who)


def user_info_id(body: Column) -> Column:
    """``sub``, else ``id``, of a JSON object; null if there is neither."""
    found = F.from_json(body, "sub string, id string")
    return F.nullif(first_non_empty(found["sub"], F.coalesce(found["id"], F.lit(""))), F.lit(""))


def id_token_subject(token: Column) -> Column:
    """``sub`` of a three-part token's payload, whose signature isn't checked; null if there is none."""
    parts = F.split(token, r"\.", -1)
    middle = F.translate(F.get(parts, F.lit(1)), "-_", "+/")
    padded = F.concat(middle, F.repeat(F.lit("="), F.pmod(-F.length(middle), F.lit(4))))
    payload = F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8")
    return F.when(F.size(parts) == 3, F.nullif(F.from_json(payload, "sub string")["sub"], F.lit("")))


def cleaned_latex(c: Column) -> Column:
    """Without dollars at its ends, then without a closing comma or full stop, then without blanks at its ends."""
    bare = F.regexp_replace(F.regexp_replace(c, r"^\s*\$*|\s+$", ""), r"\$+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[,.]\s*$", ""), r"^\s+|\s+$", "")


def shortened(c: Column, most: int = 80) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def display_latex(identity: Column, latex: Column) -> Column:
    return first_non_empty(identity, latex)


def display_mma(identity: Column, mma: Column) -> Column:
    return F.coalesce(first_non_empty(identity, mma), F.lit(""))


def occurrence_text(occurrences: Column) -> Column:
    """``entry.side`` of all occurrences, if there are several."""
    listed = F.array_join(F.transform(occurrences, lambda o: F.concat_ws(".", o["entry_id"], o["side"])), ", ")
    return F.when(F.size(occurrences) > 1, listed).otherwise(F.lit(""))
