"""Language profiles: the constants that differ between corpora.

One cleaning/filtering job serves every language; a profile supplies the link
prefixes removed by the cleaner, the redirect markers and the skipped title
prefixes. Unknown languages fall back to the ``english`` profile, which is the
generic one.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Profile:
    name: str
    link_prefixes: tuple[str, ...]
    redirect_markers: tuple[str, ...]
    title_prefixes: tuple[str, ...]


# Fixed values (must equal the reference for equal results), in their natural order.
# Link namespaces removed together with the link:
ENGLISH_LINK_PREFIXES = ("File", "Image", "Category")
ESPERANTO_LINK_PREFIXES = ("File", "Image", "Category", "Dosiero", "Bildo", "Kategorio")
# Redirect markers, compared in lower case against the start of the cleaned text:
ENGLISH_REDIRECT_MARKERS = ("#redirect",)
ESPERANTO_REDIRECT_MARKERS = ("#redirect", "#alidirektu")
# Title prefixes of pages that are not articles (case-sensitive):
ENGLISH_TITLE_PREFIXES = ("Wikipedia:", "Talk:", "User:", "File:", "Template:", "Help:", "Category:")
ESPERANTO_TITLE_PREFIXES = ENGLISH_TITLE_PREFIXES + (
    "Vikipedio:", "Diskuto:", "Uzanto:", "Dosiero:", "Ŝablono:", "Helpo:", "Kategorio:",
)
# Corpus name -> article file name (the third name has no download script).
CORPUS_FILES = {
    "english": "simplewiki-articles.jsonl",
    "esperanto": "eowiki-articles.jsonl",
    "loga": "loga-articles.jsonl",
}

ENGLISH = Profile("english", ENGLISH_LINK_PREFIXES, ENGLISH_REDIRECT_MARKERS, ENGLISH_TITLE_PREFIXES)
ESPERANTO = Profile("esperanto", ESPERANTO_LINK_PREFIXES, ESPERANTO_REDIRECT_MARKERS,
                    ESPERANTO_TITLE_PREFIXES)

PROFILES = {"english": ENGLISH, "en": ENGLISH, "esperanto": ESPERANTO, "eo": ESPERANTO}


def profile(name: str) -> Profile:
    return PROFILES.get(name, ENGLISH)


def corpus_file(name: str) -> str:
    """Corpus name -> article file; unknown names fail before any job starts."""
    if name not in CORPUS_FILES:
        raise FileNotFoundError(f"unknown corpus {name!r}; known: {sorted(CORPUS_FILES)}")
    return CORPUS_FILES[name]
