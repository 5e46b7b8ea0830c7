"""Filters and predicates F1-F8 as Column predicates plus DataFrame helpers.

All are narrow ``filter``s. Title predicates read only ``title``, so apply them
before cleaning: the cleaner (and its Python entity step) then never sees the
dropped pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.text import strip
from corpuslab.profiles import ENGLISH, Profile

MIN_ARTICLE_CHARS = 100   # F3 (fixed value)
MIN_PARAGRAPH_CHARS = 20  # F6, strictly longer (fixed value)
MIN_DOC_CHARS = 50        # F7, strictly longer (fixed value)


def _per_profile(make, prof: Profile, lang: Column | None,
                 profiles: dict[str, Profile] | None) -> Column:
    base = make(prof)
    if lang is None or not profiles:
        return base
    cond = None
    for code, p in profiles.items():
        cond = F.when(lang == code, make(p)) if cond is None else cond.when(lang == code, make(p))
    return cond.otherwise(base)


def has_title_and_text(title: Column, text: Column) -> Column:
    """F1."""
    return title.isNotNull() & text.isNotNull()


def is_redirect(text: Column, prof: Profile = ENGLISH, lang: Column | None = None,
                profiles: dict[str, Profile] | None = None) -> Column:
    """F2 (negated): case-insensitive redirect marker at the start of the stripped text.

    Lower-casing never shortens a character, so comparing the lowered prefix of
    marker length equals comparing a prefix of the lowered text.
    """
    def make(p: Profile) -> Column:
        s = strip(text)
        hits = [F.lower(F.substring(s, 1, len(m))).startswith(m) for m in p.redirect_markers]
        out = hits[0]
        for h in hits[1:]:
            out = out | h
        return out

    return _per_profile(make, prof, lang, profiles)


def long_enough(text: Column, n: int = MIN_ARTICLE_CHARS) -> Column:
    """at least ``n`` characters after strip."""
    return F.char_length(strip(text)) >= n


def is_namespaced_title(title: Column, prof: Profile = ENGLISH, lang: Column | None = None,
                        profiles: dict[str, Profile] | None = None) -> Column:
    """F4 (negated): the title starts with a skipped namespace prefix (case-sensitive)."""
    def make(p: Profile) -> Column:
        out = title.startswith(p.title_prefixes[0])
        for pre in p.title_prefixes[1:]:
            out = out | title.startswith(pre)
        return out

    return _per_profile(make, prof, lang, profiles)


def is_valid_article(title: Column, text: Column, prof: Profile = ENGLISH,
                     lang: Column | None = None,
                     profiles: dict[str, Profile] | None = None) -> Column:
    """F5 = F2 and F3 and F4, on cleaned text."""
    return (~is_redirect(text, prof, lang, profiles) & long_enough(text)
            & ~is_namespaced_title(title, prof, lang, profiles))


def paragraph_kept(par: Column) -> Column:
    """longer than 20 characters after strip."""
    return F.char_length(strip(par)) > MIN_PARAGRAPH_CHARS


def doc_kept(text: Column) -> Column:
    """stripped length above 50; the stored text stays unstripped."""
    return F.char_length(strip(text)) > MIN_DOC_CHARS


def line_not_blank(line: Column) -> Column:
    """F8."""
    return strip(line) != F.lit("")


def keep_titled_articles(df: DataFrame, prof: Profile = ENGLISH, lang_col: str | None = None,
                         profiles: dict[str, Profile] | None = None) -> DataFrame:
    """F1 and F4 — the cheap filters that run before cleaning."""
    lang = F.col(lang_col) if lang_col else None
    return df.where(has_title_and_text(F.col("title"), F.col("text"))
                    & ~is_namespaced_title(F.col("title"), prof, lang, profiles))


def keep_valid_cleaned(df: DataFrame, prof: Profile = ENGLISH, lang_col: str | None = None,
                       profiles: dict[str, Profile] | None = None) -> DataFrame:
    """F2 and F3 on the cleaned ``text``."""
    lang = F.col(lang_col) if lang_col else None
    t = F.col("text")
    return df.where(~is_redirect(t, prof, lang, profiles) & long_enough(t))
