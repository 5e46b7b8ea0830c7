"""DuckDB SQL text equivalent to the Spark views and the cleaning chain.

Used only to build ``oracle_sql()`` strings for the correctness gate. DuckDB uses
RE2: inline flags ``(?s)``, ``(?m)``, ``(?i)`` work, replacements use ``\\1``;
``\\s``/``\\b`` are ASCII there, which the derived views avoid stressing.
"""

from __future__ import annotations

from corpuslab.functions import text as tx
from corpuslab.plans import views
from corpuslab.profiles import ENGLISH, ESPERANTO, Profile

NL = "chr(10)"

# Python's str.isspace() set, spelled for RE2.
WS_CLASS = (r"[\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
STRIP_PATTERN = f"^{WS_CLASS}+|{WS_CLASS}+$"

# Entities present in the derived views and the pages table, decoded the way
# html.unescape does for them; ``&amp`` is decoded last, in one pass.
ENTITY_REPLACEMENTS = [
    ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&nbsp;", "chr(160)"),
    ("&copy;", "chr(169)"), ("&middot;", "chr(183)"),
]


def q(s: str) -> str:
    """SQL string literal, newlines spelled with chr(10)."""
    parts = s.split("\n")
    lits = ["'" + p.replace("'", "''") + "'" for p in parts]
    return f" || {NL} || ".join(lits) if len(lits) > 1 else lits[0]


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '{STRIP_PATTERN}', '', 'g')"


def _re(x: str, pattern: str, repl: str = "''") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {repl}, 'g')"


def media_sql(x: str, lang_col: str, profiles: dict[str, Profile]) -> str:
    cases = " ".join(
        f"WHEN {lang_col} = {q(lang)} THEN {_re(x, tx.media_link_pattern(p))}"
        for lang, p in profiles.items() if p is not ENGLISH)
    default = _re(x, tx.media_link_pattern(ENGLISH))
    return f"(CASE {cases} ELSE {default} END)" if cases else default


def clean_sql(x: str, lang_col: str = "lang", profiles: dict[str, Profile] | None = None,
              template_passes: int = tx.TEMPLATE_PASSES, table_passes: int = tx.TABLE_PASSES,
              entities: bool = True) -> str:
    """The cleaning chain as one nested DuckDB expression."""
    profiles = profiles or {}
    for _ in range(template_passes):
        x = _re(x, tx.TEMPLATE_INNER)
    x = _re(x, tx.TEMPLATE_UNCLOSED)
    x = _re(x, tx.TEMPLATE_LAZY)
    for _ in range(table_passes):
        x = _re(x, tx.TABLE_INNER)
    x = _re(x, tx.TABLE_LAZY)
    x = _re(x, tx.TABLE_ROW_LINE)
    x = media_sql(x, lang_col, profiles)
    x = _re(x, tx.INTERNAL_LINK, r"'\1'")
    x = _re(x, tx.EXTERNAL_LINK_LABEL, r"'\1'")
    x = _re(x, tx.EXTERNAL_LINK_BARE)
    x = _re(x, tx.HTML_TAG)
    if entities:
        for ent, rep in ENTITY_REPLACEMENTS:
            x = f"replace({x}, {q(ent)}, {rep})"
        x = _re(x, "&amp;?", "'&'")
    x = _re(x, tx.ATTRIBUTE_QUOTED)
    x = _re(x, tx.ATTRIBUTE_BARE)
    x = _re(x, tx.COLOUR_6)
    x = _re(x, tx.COLOUR_3)
    x = _re(x, tx.HEADING, r"'\1'")
    x = _re(x, tx.BOLD_ITALIC)
    x = _re(x, tx.MAGIC_WORD)
    x = _re(x, tx.NEWLINE_RUN, f"{NL} || {NL}")
    x = _re(x, tx.BLANK_RUN, "' '")
    x = _re(x, tx.PUNCT_LINE)
    return strip_sql(x)


def wikify_sql(doc_id: str = "doc_id", text: str = "text") -> str:
    return (
        f"CASE WHEN {doc_id} % 23 <> 5 THEN concat("
        f"CASE WHEN {doc_id} % 26 = 0 THEN '#ALIDIREKTU [[Target ' || CAST({doc_id} AS VARCHAR) || ']]' || {NL} "
        f"WHEN {doc_id} % 13 = 0 THEN '#REDIRECT [[Target ' || CAST({doc_id} AS VARCHAR) || ']]' || {NL} "
        "ELSE '' END, "
        f"'{{{{Infobox|a={{{{b', CAST({doc_id} % 7 AS VARCHAR), '}}}}|c={{{{d|{{{{e}}}}}}}}}}}}' || {NL}, "
        f"'== H ==' || {NL}, "
        f"CASE WHEN {doc_id} % 5 = 0 THEN {q(views.TABLE_MARKUP)} ELSE '' END, "
        f"CASE WHEN {doc_id} % 3 = 1 THEN {q(views.ODD_MARKUP)} ELSE '' END, "
        f"{q(views.HEAD_MARKUP)} || {NL}, "
        f"replace({text}, {NL}, {NL} || {NL} || {q(views.LINE_MARKUP)}), "
        f"{NL} || {NL} || {NL} || {NL} || ':' || {NL} || '[[Category:K]]') END"
    )


def wiki_title_sql(doc_id: str = "doc_id") -> str:
    return (f"CASE WHEN {doc_id} % 19 <> 3 THEN (CASE WHEN {doc_id} % 17 = 0 THEN 'Talk:' WHEN {doc_id} % 17 = 1 THEN 'User talk:' "
            f"WHEN {doc_id} % 17 = 2 THEN 'Kategorio:' ELSE '' END) || 'Doc ' || CAST({doc_id} AS VARCHAR) END")


WIKIFIED_CTE = (
    "wiki AS (SELECT doc_id, lang, " + wiki_title_sql() + " AS title, " + wikify_sql()
    + " AS text FROM documents)"
)


def _run_columns(k: str) -> str:
    return (
        f"CAST({k} AS VARCHAR) AS run_id, "
        f"CASE WHEN {k} % 2 = 0 THEN 'english' ELSE 'esperanto' END AS language, "
        f"CASE WHEN ({k} // 2) % 2 = 0 THEN '10M' ELSE '30M' END AS size, "
        f"CAST({k} // 8 AS INTEGER) AS seed, "
        f"CASE WHEN ({k} // 4) % 2 = 0 THEN 'bpe' ELSE 'byte' END AS tokenizer_type, "
    )


def runs_cte() -> str:
    return (
        "runs AS (SELECT " + _run_columns("event_id")
        + "value AS val_bpb, CAST(user_id * 1000 AS BIGINT) AS tokens, value AS wallclock_s, "
        "props AS hparams_json, event_id AS run_ord, "
        "'[' || CAST(value + 3.0 AS VARCHAR) || ',' || CAST(value + 1.0 AS VARCHAR) || ',' "
        "|| CAST(value AS VARCHAR) || ']' AS val_bpb_curve FROM events)"
    )


def logged_runs_cte(n_runs: int) -> str:
    return (
        f"logged AS (SELECT event_id % {n_runs} AS run_ord, round(avg(value), 6) AS val_bpb "
        "FROM events GROUP BY 1), runs AS (SELECT " + _run_columns("run_ord")
        + "val_bpb, run_ord FROM logged)"
    )


def scenario_runs_cte(n_runs: int = 240) -> str:
    names = ["english", *views.SCENARIOS]
    factors = [(1.0, 1.0), *views.SCENARIOS.values()]
    n = len(names)
    cell = f"(run_ord // {n})"
    return (
        f"logged AS (SELECT event_id % {n_runs} AS run_ord, avg(value) AS v FROM events GROUP BY 1), "
        f"scen AS (SELECT run_ord, [{', '.join(map(q, names))}][run_ord % {n} + 1] AS language, "
        f"CASE WHEN {cell} % 2 = 0 THEN '10M' ELSE '30M' END AS size, {cell} // 4 AS seed, "
        f"CASE WHEN ({cell} // 2) % 2 = 0 THEN 'bpe' ELSE 'byte' END AS tokenizer_type, "
        f"round(v * [{', '.join(f'[{a}::DOUBLE, {b}::DOUBLE]' for a, b in factors)}][run_ord % {n} + 1][({cell} // 2) % 2 + 1], 6) AS val_bpb "
        "FROM logged), runs AS (SELECT * FROM scen WHERE language <> 'sparse' OR seed = 0)"
    )


# Profiles used by the registered queries: ``de`` rows take the esperanto profile
# so both profiles are exercised on the driver tables.
QUERY_PROFILES = {"de": ESPERANTO}
