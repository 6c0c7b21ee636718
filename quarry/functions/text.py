"""Small text rules: ignore patterns, token estimates, hashes, route paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.operators.graph import glob_regex


def ignore_regex(lines: list[str]) -> tuple[str, str]:
    """Regular expressions of the paths that gitignore lines leave out and of those that ``!`` lines take back."""
    out, back = [], []
    for line in (x.strip() for x in lines):
        if not line or line.startswith("#"):
            continue
        target, pattern = (back, line[1:]) if line.startswith("!") else (out, line)
        anchored, folder = "/" in pattern.rstrip("/"), pattern.endswith("/")
        body = glob_regex(pattern.strip("/"))[1:-1]
        target.append(("^" if anchored else "(?:^|/)") + body + ("/" if folder else "(?:/|$)"))
    return "|".join(out), "|".join(back)


def estimate_tokens(text: Column) -> Column:
    """A quarter of a text's bytes."""
    return (F.octet_length(text) * 0.25).cast("long")


def truncate_to_tokens(text: Column, tokens: int) -> Column:
    """The longest beginning of a text of at most four bytes a token, whole characters only."""
    chars = F.transform(F.sequence(F.lit(1), F.least(F.length(text), F.lit(4 * tokens))), lambda k: F.substring(text, k, F.lit(1)))
    kept = F.aggregate(chars, F.struct(F.lit(0).alias("bytes"), F.lit("").alias("text")), lambda s, c: F.when(s["bytes"] + F.octet_length(c) <= 4 * tokens, F.struct((s["bytes"] + F.octet_length(c)).alias("bytes"), F.concat(s["text"], c).alias("text"))).otherwise(F.struct(F.lit(4 * tokens + 1).alias("bytes"), s["text"].alias("text"))))
    return F.when(F.octet_length(text) <= 4 * tokens, text).when(F.length(text) > 0, kept["text"]).otherwise(text)


def content_hash(text: Column) -> Column:
    """A stable 16-digit hash of a text."""
    return F.lpad(F.lower(F.hex(F.xxhash64(text))), 16, "0")


def canonical_route(path: Column) -> Column:
    """A route's path with ``{}`` for its parameters, single slashes, one leading and no trailing slash."""
    out = F.regexp_replace(path, "/{2,}", "/")
    for pattern in (r"\$\{[^}]*\}", r"<[^>]*>", r":[A-Za-z0-9_]+", r"\{[A-Za-z0-9_]+\}"):
        out = F.regexp_replace(out, pattern, "{}")
    out = F.when(out.startswith("/"), out).otherwise(F.concat(F.lit("/"), out))
    return F.when(F.length(out) > 1, F.regexp_replace(out, "/$", "")).otherwise(out)


def stable_id(*parts: Column) -> Column:
    """A 64-bit id of a record's natural key."""
    return F.xxhash64(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
