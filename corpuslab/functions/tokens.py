"""Token helpers that need no vocabulary: byte-level ids (B8) and pattern pre-tokens.

Everything here is a built-in expression (no Python).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the training split pattern (contractions, letters with one optional
# leading symbol, 1-2 digits, symbol runs, newlines, spaces). Java regex supports
# its possessive quantifiers and look-ahead; RE2 does not.
TRAIN_SPLIT_PATTERN = r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"
# Fixed value: the byte-level pre-tokenizer pattern (GPT-2 style, no prefix space).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same without look-ahead: both Java and RE2 accept it (oracle-checkable variant).
SIMPLE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


def byte_ids(text: Column) -> Column:
    """UTF-8 bytes of the text as ``ARRAY<INT>`` (0-255)."""
    hx = F.hex(F.encode(text, "UTF-8"))
    return F.transform(F.regexp_extract_all(hx, F.lit("(..)"), 1),
                       lambda h: F.conv(h, 16, 10).cast("int"))


def byte_token_count(text: Column) -> Column:
    """Number of byte-level tokens = UTF-8 length (no array needed)."""
    return F.octet_length(text)


def pretokens(text: Column, pattern: str = TRAIN_SPLIT_PATTERN) -> Column:
    """The pre-token strings of ``text`` (``ARRAY<STRING>``)."""
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), 0)


def pretoken_count(text: Column, pattern: str = SIMPLE_PATTERN) -> Column:
    return F.size(pretokens(text, pattern))
