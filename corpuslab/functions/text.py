"""Wiki-markup cleaning as native Column expressions.

Every step is a JVM ``regexp_replace`` so the chain stays inside whole-stage
codegen; only the entities (T12) cross to Python, once, in an Arrow batch.

Java regex needs two flags to behave like Python's ``re`` on ``str``:
``d`` (only ``\\n`` ends a line for ``.``, ``^`` and ``$``) and ``U`` (Unicode
``\\s``, ``\\w``, ``\\b``). Every pattern below is prefixed with them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslab.profiles import ENGLISH, Profile

PY = "(?dU)"

# The cleaning patterns and replacements, in application order.
TEMPLATE_INNER = r"\{\{[^{}]*\}\}"            # T1, repeated to a fixpoint, at most 30 passes
TEMPLATE_UNCLOSED = r"\{\{[^}]*\}\}"          # T2
TEMPLATE_LAZY = r"(?s)\{\{.*?\}\}"            # T3
TABLE_INNER = r"(?s)\{\|[^{}]*?\|\}"          # T4, at most 5 passes
TABLE_LAZY = r"(?s)\{\|.*?\|\}"               # T5
TABLE_ROW_LINE = r"(?m)^[|!].*$"              # T6
MEDIA_LINK = r"(?i)\[\[(?:{prefixes}):[^\]]*\]\]"   # T7, prefixes from the profile
INTERNAL_LINK = r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]"   # T8 -> group 1
EXTERNAL_LINK_LABEL = r"\[https?://\S+\s+([^\]]+)\]"  # T9 -> group 1
EXTERNAL_LINK_BARE = r"\[https?://\S+\]"      # T10
HTML_TAG = r"<[^>]+/?>"                       # T11
ATTRIBUTE_NAMES = ("bgcolor|class|style|align|valign|width|height|colspan|rowspan|"
                   "cellpadding|cellspacing|border")
ATTRIBUTE_START = r"(?=[abchrsvw])\b(?:"     # the names' first letters, looked at before the slower \b
ATTRIBUTE_QUOTED = ATTRIBUTE_START + ATTRIBUTE_NAMES + r')\s*=\s*"[^"]*"'   # T13
ATTRIBUTE_BARE = ATTRIBUTE_START + ATTRIBUTE_NAMES + r")\s*=\s*\S+"        # T14
COLOUR_6 = r"#[0-9a-fA-F]{6}\b"               # T15
COLOUR_3 = r"#[0-9a-fA-F]{3}\b"               # T16
HEADING = r"={2,6}([^=]+)={2,6}"              # T17 -> group 1
BOLD_ITALIC = r"'{2,3}"                       # T18
MAGIC_WORD = r"__[A-Z]+__"                    # T19
NEWLINE_RUN = r"\n{3,}"                       # T20 -> two newlines
BLANK_RUN = r"[ \t]+"                         # T21 -> one space
PUNCT_LINE = r"(?m)^\s*[|!:{}\[\]]\s*$"       # T22
TEMPLATE_PASSES = 30
TABLE_PASSES = 5
# Python's str.strip() whitespace (str.isspace): Unicode White_Space plus U+001C..U+001F.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 + "".join(chr(c) for c in range(0x2000, 0x200B))
                 + "\u2028\u2029\u202f\u205f\u3000")


def _re(pattern: str) -> str:
    return PY + pattern


def _sub(c: Column, pattern: str, repl: str = "") -> Column:
    return F.regexp_replace(c, _re(pattern), repl)


def fixpoint_head(c: Column, pattern: str, unrolled: int = 3) -> Column:
    """The first ``unrolled`` passes of ``pattern -> ''`` as plain expressions."""
    for _ in range(unrolled):
        c = _sub(c, pattern)
    return c


def fixpoint_tail(c: Column, pattern: str, rest: int) -> Column:
    """The remaining ``rest`` passes, only for rows that still match.

    ``c`` is referenced three times, so pass a column reference (materialised by
    a previous projection), not a long expression.
    """
    if rest <= 0:
        return c
    pat = _re(pattern)

    def step(acc, _i):
        return F.regexp_replace(acc, pat, "")

    looped = F.aggregate(F.sequence(F.lit(1), F.lit(rest)), c, step)
    return F.when(c.rlike(pat), looped).otherwise(c)


def _fixpoint(c: Column, pattern: str, max_passes: int, unrolled: int = 2) -> Column:
    """Apply ``pattern -> ''`` up to ``max_passes`` times.

    Passes after the fixpoint change nothing, so running all of them equals the
    early break. The first ``unrolled`` passes are plain expressions (codegen);
    rows that still match run the rest in one ``aggregate`` over a sequence.
    """
    unrolled = min(unrolled, max_passes)
    return fixpoint_tail(fixpoint_head(c, pattern, unrolled), pattern, max_passes - unrolled)


def strip(c: Column) -> Column:
    """Python ``str.strip()``: ``btrim`` with the exact whitespace set (no regex)."""
    return F.btrim(c, F.lit(PY_WHITESPACE))


def remove_templates(c: Column) -> Column:
    """T1-T3."""
    c = _fixpoint(c, TEMPLATE_INNER, TEMPLATE_PASSES)
    c = _sub(c, TEMPLATE_UNCLOSED)
    return _sub(c, TEMPLATE_LAZY)


def remove_tables(c: Column) -> Column:
    """T4-T6."""
    c = _fixpoint(c, TABLE_INNER, TABLE_PASSES)
    c = _sub(c, TABLE_LAZY)
    return _sub(c, TABLE_ROW_LINE)


def media_link_pattern(prof: Profile) -> str:
    return MEDIA_LINK.format(prefixes="|".join(prof.link_prefixes))


def remove_media_links(c: Column, prof: Profile = ENGLISH, lang: Column | None = None,
                       profiles: dict[str, Profile] | None = None) -> Column:
    """T7 with the row's profile: ``profiles`` maps a ``lang`` value to a profile,
    other rows use ``prof``. Each branch keeps a literal (pre-compiled) pattern."""
    out = _sub(c, media_link_pattern(prof))
    if lang is None or not profiles:
        return out
    cond = None
    for code, p in profiles.items():
        branch = _sub(c, media_link_pattern(p))
        cond = F.when(lang == code, branch) if cond is None else cond.when(lang == code, branch)
    return cond.otherwise(out)


def unwrap_links(c: Column, prof: Profile = ENGLISH, lang: Column | None = None,
                 profiles: dict[str, Profile] | None = None) -> Column:
    """T7-T10."""
    c = remove_media_links(c, prof, lang, profiles)
    c = _sub(c, INTERNAL_LINK, "$1")
    c = _sub(c, EXTERNAL_LINK_LABEL, "$1")
    return _sub(c, EXTERNAL_LINK_BARE)


def remove_tags(c: Column) -> Column:
    """T11."""
    return _sub(c, HTML_TAG)


def remove_attributes_and_colours(c: Column) -> Column:
    """T13-T16."""
    c = _sub(c, ATTRIBUTE_QUOTED)
    c = _sub(c, ATTRIBUTE_BARE)
    c = _sub(c, COLOUR_6)
    return _sub(c, COLOUR_3)


def remove_formatting(c: Column) -> Column:
    """T17-T19."""
    c = _sub(c, HEADING, "$1")
    c = _sub(c, BOLD_ITALIC)
    return _sub(c, MAGIC_WORD)


def normalise_whitespace(c: Column) -> Column:
    """T20-T22 (T22 runs last, so it can open new paragraph breaks)."""
    c = _sub(c, NEWLINE_RUN, "\n\n")
    c = _sub(c, BLANK_RUN, " ")
    return _sub(c, PUNCT_LINE)


def clean_before_entities(c: Column, prof: Profile = ENGLISH, lang: Column | None = None,
                          profiles: dict[str, Profile] | None = None) -> Column:
    """T1-T11."""
    return remove_tags(unwrap_links(remove_tables(remove_templates(c)), prof, lang, profiles))


def clean_after_entities(c: Column) -> Column:
    """T13-T23."""
    return strip(normalise_whitespace(remove_formatting(remove_attributes_and_colours(c))))


def clean_wikitext(c: Column, prof: Profile = ENGLISH, decode_entities: bool = True,
                   lang: Column | None = None, profiles: dict[str, Profile] | None = None) -> Column:
    """The whole chain T1-T23. ``decode_entities=False`` skips T12 (all-JVM variant).

    With ``lang``/``profiles`` the link step (T7) follows each row's profile.
    """
    from corpuslab.functions.entities import unescape_html

    c = clean_before_entities(c, prof, lang, profiles)
    if decode_entities:
        c = unescape_html(c)
    return clean_after_entities(c)


def prefix(c: Column, n: int = 10_000) -> Column:
    """The first ``n`` characters (code points)."""
    return F.substring(c, 1, n)


def char_length(c: Column) -> Column:
    """Characters (code points, like Python ``len``)."""
    return F.char_length(c)


def byte_length(c: Column) -> Column:
    """UTF-8 bytes."""
    return F.octet_length(c)
