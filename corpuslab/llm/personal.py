"""Operator 4, personal data by weak supervision.

Method: one scan finds base spans (strict patterns) and candidates (looser patterns: written-out
emails, local phone numbers, account and social-security numbers, names after a title). Four
labelers vote yes, no or nothing on every candidate: the strict regex, a gazetteer, the words
before it (context) and its shape. A candidate becomes a pattern: its kind, its votes and four
shape bits. The counts of the patterns over all documents (at most ``PATTERNS`` rows, whatever
the corpus) are all that reaches the driver: expectation-maximisation (Dawid-Skene with
abstentions) estimates each labeler's reliability, its posteriors are the soft labels
of a logistic classifier over kind, votes and shape, and the classifier accepts patterns.
Accepted candidates that overlap no base span are added; base spans always stay.

Scans are linear in the text: a run that cannot match is not tried again from its middle.

Cases: null and empty texts have no spans; every row is judged alone, repeated rows alike; if
no candidate exists anywhere the base spans are returned; an empty table gives an empty
table; extra columns are not read; offsets are code points, ends are exclusive.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, shared_table
from .spans import SPAN, count_of, joined

KINDS = ("email", "ip", "card", "phone", "email_words", "phone_local", "account", "ssn", "name")

# The base patterns of the query. Look-behinds and possessive runs only keep a
# failed run from being tried again at each of its characters.
LOCAL = r"[A-Za-z0-9._%+-]"
DOMAIN = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
EMAIL_HERE = re.compile(rf"{LOCAL}++@{DOMAIN}")
EMAIL_NEXT = re.compile(rf"(?<!{LOCAL}){LOCAL}++@{DOMAIN}")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

CANDIDATES = (
    (4, re.compile(r"(?<![\w.])[A-Za-z0-9_.-]{2,64}(?: at | ?\[at\] ?| ?\(at\) ?)[A-Za-z0-9-]{2,64}"
                   r"(?:(?: dot | ?\[dot\] ?| ?\(dot\) ?|\.)[A-Za-z0-9-]{2,64}){1,4}(?![\w.])")),
    (5, re.compile(r"(?<![\w+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w])")),
    (5, re.compile(r"(?<![\w+])0[0-9]{1,4}[ /-][0-9]{3,8}(?:[ -][0-9]{2,4}){0,2}(?![\w])")),
    (6, re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    (7, re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    (8, re.compile(r"(?:M(?:rs?|s|me|onsieur|adame)\.? |Dr\.? |Herr |Frau |Señora? |my name is |Name: )"
                   r"([A-ZÄÖÜÁÉÍÓÚÑ]\w{1,30}(?: [A-ZÄÖÜÁÉÍÓÚÑ]\w{1,30}){0,2})")),
)

#: A small gazetteer (given names, mail providers, country codes of accounts).
GAZETTEER = frozenset((
    "james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph "
    "jessica thomas sarah charles karen anna peter hans klaus sabine monika jürgen ursula stefan andreas martin "
    "pierre jean marie michel nathalie philippe isabelle françois sophie carlos maría josé ana luis carmen juan "
    "antonio pedro lucía gmail yahoo hotmail outlook gmx web posteo proton icloud aol "
    "DE GB FR ES IT NL BE AT CH PL").split())
CUES = re.compile(r"(?i)\b(?:e-?mail|mail|contact|reach|write|call|tel|telefon|phone|mobile|fax|cell|whatsapp|iban|"
                  r"konto|account|cuenta|compte|ssn|social security|name|named|mr|mrs|ms|dr|herr|frau|monsieur|madame|"
                  r"mme|señora?|born|patient|customer)\b")
AGAINST = re.compile(r"(?i)\b(?:isbn|issn|version|order|invoice|sku|model|serial|page|pages|chapter|figure|score|total|"
                     r"price|ratio|part no|doi|between|from year)\b")
CONTEXT = 40
#: kinds x votes of four labelers x four shape bits
N_CANDIDATE_KINDS, N_LABELERS, N_SHAPE = 5, 4, 4
PATTERNS = N_CANDIDATE_KINDS * 3**N_LABELERS * 2**N_SHAPE


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds."""
    out = []
    if "@" in text:
        at = 0
        while m := EMAIL_HERE.match(text, at) or EMAIL_NEXT.search(text, at):
            out.append((m.start(), 0, m.end()))
            at = m.end()
    if DIGIT.search(text):
        # a part may have any length, so it is compared as text once leading zeros are off
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text)
                if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m.groups())]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text)
                    if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def mod97(account: str) -> bool:
    s = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def votes(text: str, start: int, kind: int, end: int) -> tuple[int, int, int, int]:
    """Votes (0 no, 1 nothing, 2 yes) of the labelers: regex, gazetteer, context, shape."""
    span = text[start:end]
    digits = re.sub(r"[^0-9]", "", span)
    if kind == 6:
        regex = 2 if mod97(span) else 0
    elif kind == 7:
        regex = 0 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 2
    elif kind == 5:
        regex = 2 if 9 <= len(digits) <= 12 else 0 if len(digits) < 7 else 1
    else:
        regex = 2 if kind == 4 and ("[" in span or "(" in span) else 1
    names = set(re.findall(r"\w+", span.lower())) if kind in (4, 8) else {span[:2]}
    gazetteer = 2 if names & GAZETTEER else 0 if kind == 6 else 1
    before = text[max(0, start - CONTEXT):start]
    context = 0 if AGAINST.search(before) else 2 if CUES.search(before) else 1
    shape = 2 if kind in (4, 8) and len(names) > 1 else 2 if kind in (5, 7) and len(set(digits)) > 3 else \
        0 if digits and len(set(digits)) < 3 else 1
    return regex, gazetteer, context, shape


def pattern_of(text: str, start: int, kind: int, end: int) -> int:
    code = kind - 4
    for v in votes(text, start, kind, end):
        code = code * 3 + v
    span = text[start:end]
    bits = (any(c in span for c in "()[]"), " " in span, end - start > 16, start == 0 or text[start - 1] in "\n:")
    for b in bits:
        code = code * 2 + int(b)
    return code


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, pattern) of loose matches that overlap no base span nor each other."""
    # the span is the pattern's group, if it has one
    found = sorted({(m.start(p.groups), kind, m.end(p.groups)) for kind, p in CANDIDATES for m in p.finditer(text)})
    taken, k, last, out = sorted((a, b) for a, _, b in base), 0, 0, []
    for a, kind, b in found:
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if a >= last and not (k < len(taken) and taken[k][0] < b):
            out.append((a, kind, b, pattern_of(text, a, kind, b)))
            last = b
    return out


def unpack(patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind, votes (columns of 0, 1, 2) and shape bits of pattern numbers."""
    bits = (patterns[:, None] >> np.arange(N_SHAPE - 1, -1, -1)) & 1
    rest = patterns >> N_SHAPE
    v = (rest[:, None] // 3 ** np.arange(N_LABELERS - 1, -1, -1)) % 3
    return rest // 3**N_LABELERS, v, bits


def em(v: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of a true span for each row of votes (weight ``n``), and each labeler's
    probabilities of (no, nothing, yes) for false and for true spans. Pseudo-counts make
    labelers right more often than wrong, which names the two classes."""
    prior = np.array([[3.0, 3.0, 1.0], [1.0, 3.0, 3.0]])
    table = np.repeat((prior / prior.sum(1, keepdims=True))[None], v.shape[1], 0)
    share, post = 0.5, np.full(len(v), 0.5)
    for _ in range(rounds):
        logs = np.log(np.stack([1 - share + 0 * n, share + 0 * n]))
        for j in range(v.shape[1]):
            logs = logs + np.log(table[j][:, v[:, j]])
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        done = np.abs(new - post).max(initial=0) < 1e-9
        post = new
        share = ((post * n).sum() + 1) / (n.sum() + 2)
        for j in range(v.shape[1]):
            counts = np.stack([np.bincount(v[:, j], n * w, 3) for w in (1 - post, post)]) + prior
            table[j] = counts / counts.sum(1, keepdims=True)
        if done:
            break
    return post, table


def features(patterns: np.ndarray) -> np.ndarray:
    kind, v, bits = unpack(patterns)
    return np.hstack([np.eye(N_CANDIDATE_KINDS)[kind], *[np.eye(3)[v[:, j]] for j in range(N_LABELERS)], bits])


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression on soft labels (Newton steps)."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)),
                               x.T @ (n * (p - y)) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def accepted_patterns(counts: dict[int, int]) -> list[int]:
    """Patterns that the classifier takes for personal data."""
    if not counts:
        return []
    patterns = np.array(sorted(counts))
    n = np.array([counts[p] for p in patterns.tolist()], float)
    post, _ = em(unpack(patterns)[1], n)
    x = features(patterns)
    return patterns[x @ logistic(x, post, n) > 0].tolist()


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, ``base`` and ``spans`` (arrays of start, kind, end)."""
    kind = f"struct<base:array<{SPAN}>,more:array<struct<start:int,kind:int,end:int,pattern:int>>>"

    @F.pandas_udf(kind)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base = base_spans(text) if text else []
            rows.append((base, candidates(text, base) if text else []))
        return pd.DataFrame(rows, columns=["base", "more"])

    d = shared_table(docs.select("doc_id", scan("text").alias("s")).select("doc_id", "s.base", "s.more"), "personal")
    counts = d.select(F.explode("more.pattern").alias("pattern")).groupBy("pattern").count().collect()
    accepted = accepted_patterns({r["pattern"]: r["count"] for r in counts})
    added = F.transform(F.filter("more", lambda c: c["pattern"].isin(accepted)),
                        lambda c: F.struct(c["start"], c["kind"], c["end"]))
    return d.select("doc_id", "base", F.concat("base", added).alias("spans"))


def op4_personal_data(spark, sf_dir: str) -> DataFrame:
    d = find_personal_data(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", *[count_of(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(4)],
                    F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"),
                    joined(F.col("spans"), KINDS).alias("spans"))
