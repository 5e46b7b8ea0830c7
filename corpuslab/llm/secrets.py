"""Operator 8, secret scan with multipart credential linking.

Method: one scan of each text finds strong secrets (the base patterns) and weak parts: access
identifiers, secrets and endpoints that mean little alone. Parts get a role (identifier, secret
or endpoint; base spans have one too). An interval join within scopes (one text, at most
``DISTANCE`` code points apart) links complementary roles; a weak part is reported only if a
complementary part is linked to it. Base spans are always reported.

The join is an equi-join on (row, block of ``BLOCK`` code points) with the interval condition
after it. A block holds a bounded number of parts, so a text with many parts makes no
pairs beyond its neighbourhoods; only parts are shuffled, never texts.

Scans are linear in the text: runs are consumed once.

Cases: null and empty texts have no spans; each row is judged alone, so repeated rows and ids
(also null ids) keep their own spans; an empty table gives an empty table; extra columns
are not read; offsets are code points, ends are exclusive.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, shared_table
from .spans import SPAN, count_of, joined

DISTANCE = 200
BLOCK = 256

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
IDENTIFIER, SECRET, ENDPOINT = 0, 1, 2
#: Role of a span of each kind.
ROLES = (SECRET, IDENTIFIER, SECRET, IDENTIFIER, SECRET, ENDPOINT)
#: Roles that complete each role.
COMPLEMENTS = {IDENTIFIER: (SECRET,), SECRET: (IDENTIFIER, ENDPOINT), ENDPOINT: (SECRET,)}

# The base patterns of the query, with letters in either case spelled out.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
                    r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")

# Weak parts. A keyed value needs no strength; a bare secret looks random.
WEAK = (
    (3, re.compile(r"""(?ai:\b(?:user(?:_?name)?|login|client_?id|account|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?)"""
                   r"""([A-Za-z0-9_.@+-]{2,})""")),
    (3, re.compile(r"(?a:\b)((?:ASIA|AIDA|AROA)[A-Z0-9]{12,})")),
    (4, re.compile(r"(?<![A-Za-z0-9+/_=-])((?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])(?=[A-Za-z+/_-]*[0-9])"
                   r"[A-Za-z0-9+/_-]{20,}={0,2})(?![A-Za-z0-9+/_=-])")),
    (4, re.compile(r"""(?ai:\b(?:pwd|pass(?:phrase|code)?|private_?key|auth|credential)["']?\x20*[:=]\x20*["']?)"""
                   r"""([^\s"',;]{4,})""")),
    (5, re.compile(r"""(?ai:\b)((?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]{3,})""")),
    (5, re.compile(r"""(?ai:\b(?:host(?:_?name)?|server|endpoint|region)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9_.:-]{3,})""")),
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak parts that overlap no base span and no earlier weak part."""
    found = sorted({(m.start(1), kind, m.end(1)) for kind, pattern in WEAK for m in pattern.finditer(text)})
    out, taken, k, last = [], sorted((a, b) for a, _, b in base), 0, 0
    for a, kind, b in found:
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if a >= last and not (k < len(taken) and taken[k][0] < b):
            out.append((a, kind, b))
            last = b
    return out


def find_parts(docs: DataFrame) -> DataFrame:
    """``docs`` rows as ``(row, doc_id, base, weak)``; ``row`` names a row of this table."""

    @F.pandas_udf(f"struct<base:array<{SPAN}>,weak:array<{SPAN}>>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base = base_spans(text) if text else []
            rows.append((base, weak_spans(text, base) if text else []))
        return pd.DataFrame(rows, columns=["base", "weak"])

    d = docs.select("doc_id", scan("text").alias("s")).select("doc_id", "s.base", "s.weak")
    return shared_table(d.withColumn("row", F.monotonically_increasing_id()), "secret-parts")


def linked_weak(parts: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``(row, added)``: the weak parts with a complementary part at most ``distance`` away."""
    roles = F.array(*[F.lit(r) for r in ROLES])
    p = (parts.where(F.size("weak") > 0)
         .select("row", "weak", F.explode(F.concat("base", "weak")).alias("s"))
         .select("row", "s", F.get(roles, F.col("s.kind")).alias("role"), (F.col("s.kind") >= 3).alias("weak")))
    near = lambda c: F.explode(F.sequence(
        F.floor((F.col(f"{c}.start") - distance) / BLOCK), F.floor((F.col(f"{c}.end") + distance) / BLOCK)))
    asks = p.where("weak").select("row", "s", "role", near("s").alias("block"))
    gives = p.select("row", F.col("s").alias("g"), F.col("role").alias("g_role"),
                     F.explode(F.sequence(F.floor(F.col("s.start") / BLOCK), F.floor((F.col("s.end") - 1) / BLOCK))).alias("block"))
    fits = F.lit(False)
    for role, others in COMPLEMENTS.items():
        fits = fits | ((F.col("role") == role) & F.col("g_role").isin(*others))
    apart = (F.col("g.start") - F.col("s.end") <= distance) & (F.col("s.start") - F.col("g.end") <= distance)
    return (asks.join(gives, ["row", "block"]).where(fits & apart)
            .groupBy("row").agg(F.collect_set("s").alias("added")))


def scan_secrets(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Per row: ``doc_id``, ``base`` and ``spans`` (arrays of start, kind, end)."""
    parts = find_parts(docs)
    added = F.coalesce("added", F.array().cast(f"array<{SPAN}>"))
    return (parts.join(linked_weak(parts, distance), "row", "left")
            .select("doc_id", "base", F.concat("base", added).alias("spans")))


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    d = scan_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", *[count_of(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(3)],
                    F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"),
                    joined(F.col("spans"), KINDS).alias("spans"))
