"""Personal data in text, by weak supervision.

Regex, gazetteer and context labelers vote on every candidate span. Expectation maximisation
estimates how reliable each labeler is from the votes of all candidates of the corpus, and a
span classifier is trained on the resulting probabilities. The four strictly defined kinds
(:data:`BASE`) are always kept; the classifier decides on all other candidates.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, store, texts
from .linear import fit_linear, sigmoid

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "iban", "ssn", "name")
LABELERS = ("strict", "shape", "checksum", "gazetteer", "context", "misfit", "bounds", "variety")
SPAN = "struct<kind:string,start:int,end:int,base:boolean,code:int>"
SPAN_TYPE = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("code", pa.int32())])

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a digit run is never entered in its middle, so these equal the plain patterns and stay linear
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# further candidates
SPOKEN_MAIL = re.compile(r"\b[A-Za-z0-9._-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{2,63})+", re.I)
LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])")
SECRET = re.compile(r"\b(?:api[_ -]?key|access[_ -]?key|auth|passwd|password|pwd|secret|token)\b[ \t]{0,3}[=:][ \t]{0,3}[\"']?([A-Za-z0-9+/_=-]{8,})", re.I)
KEY = re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{16,}|xox[abp]-[A-Za-z0-9-]{10,})\b")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
NAME = re.compile(r"\b([A-Z][a-z]{2,20}) ([A-Z][a-z]{2,20})\b")
TITLED = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]{2,20}(?: [A-Z][a-z]{2,20})?\b")

GIVEN_NAMES = frozenset(
    "Alexander Alice Andrew Anna Anthony Barbara Carlos Charles Christopher Daniel David Donald Elizabeth Emily Emma George "
    "Hans Helen James Jean Jennifer Jessica John Joseph Juan Karen Kenneth Laura Linda Lisa Margaret Maria Mark Mary Matthew "
    "Michael Nancy Olivia Pablo Patricia Paul Peter Pierre Richard Robert Sandra Sarah Sophie Steven Susan Thomas William".split()
)
MAIL_ENDS = frozenset("com org net edu gov io de fr es uk example info eu".split())
CONTEXT = {
    "email": re.compile(r"mail|contact|write|reach|adresse|correo", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|from", re.I),
    "card": re.compile(r"card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte", re.I),
    "phone": re.compile(r"phone|call|tel|fax|mobile|cell|ruf|tél|móvil", re.I),
    "secret": re.compile(r"key|token|pass|secret|auth", re.I),
    "iban": re.compile(r"iban|account|bank|konto|compte|cuenta", re.I),
    "ssn": re.compile(r"ssn|social|security", re.I),
    "name": re.compile(r"name|mr|mrs|ms|dr|dear|by|herr|frau|señor|madame", re.I),
}
MISFIT = re.compile(r"(?:version|isbn|issn|order|invoice|ref|doi|page|no\.|#|\$|€|v)[ \t]*$", re.I)


@dataclass
class Candidate:
    kind: str
    start: int
    end: int
    base: bool
    checksum: int
    gazetteer: int


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, each @ looked at once."""
    at, low = text.find("@"), 0
    while at >= 0:
        start = low + len(text[low:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        low = m.end() if m else at + 1
        at = text.find("@", low)


def _octets(text: str) -> bool:
    return all(len(x) <= 3 and int(x or "0") <= 255 for x in (p.lstrip("0") for p in text.split(".")))


def _iban(text: str) -> bool:
    bare = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def find(text: str) -> list[Candidate]:
    """Every candidate of a text, the strict ones first."""
    out = []
    add = lambda *x: out.append(Candidate(*x))
    for a, b in mails(text):
        add("email", a, b, True, 0, 1 if text[a:b].rpartition(".")[2].lower() in MAIL_ENDS else 0)
    for m in IP.finditer(text):
        if _octets(m[0]):
            add("ip", *m.span(), True, 1, 0)
    for m in CARD.finditer(text):
        if len(m[0]) < 13:
            continue
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19:
            good = luhn(digits)
            add("card", *m.span(), good and len(digits) >= 16, 1 if good else -1, 1 if digits[0] in "3456" else 0)
    for m in PHONE.finditer(text):
        if 8 <= (n := sum(map(str.isdigit, m[0]))) <= 15:
            add("phone", *m.span(), True, 0, 1 if n >= 10 else 0)
    for m in LOCAL_PHONE.finditer(text):
        add("phone", *m.span(), False, 0, 0)
    for m in SSN.finditer(text):
        add("ssn", *m.span(), False, 1 if m[0][:3] not in ("000", "666") and m[0][0] != "9" else -1, 0)
    if "at)" in text or "at]" in text or "AT)" in text or "AT]" in text:
        for m in SPOKEN_MAIL.finditer(text):
            add("email", *m.span(), False, 0, 1 if re.split(r"[^A-Za-z]+", m[0])[-1].lower() in MAIL_ENDS else 0)
    for m in SECRET.finditer(text):
        add("secret", *m.span(1), False, 0, 1 if any(map(str.isdigit, m[1])) else -1)
    for m in KEY.finditer(text):
        add("secret", *m.span(), False, 0, 1)
    for m in IBAN.finditer(text):
        add("iban", *m.span(), False, 1 if _iban(m[0]) else -1, 0)
    for m in NAME.finditer(text):
        if m[1] in GIVEN_NAMES:
            add("name", *m.span(), False, 0, 1)
    for m in TITLED.finditer(text):
        add("name", *m.span(), False, 0, 0)
    return out


def vote(text: str, c: Candidate) -> int:
    """The candidate's kind and the labelers' votes (-1, 0, 1) as one number."""
    before, own = text[max(0, c.start - 32):c.start], text[c.start:c.end]
    edges = text[c.start - 1:c.start], text[c.end:c.end + 1]
    kinds = len(set(own.lower()))
    votes = (
        1 if c.base else 0,
        1 if len(own) >= 7 else -1,
        c.checksum,
        c.gazetteer,
        1 if CONTEXT[c.kind].search(before) else 0,
        -1 if MISFIT.search(before) else 0,
        -1 if any(e.isalnum() for e in edges) else 1,
        1 if kinds >= 5 else -1 if kinds <= 2 else 0,
    )
    code = KINDS.index(c.kind)
    for v in votes:
        code = code * 3 + v + 1
    return code


def decode(code: int) -> tuple[int, list[int]]:
    votes = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        votes.append(v - 1)
    return code, votes[::-1]


def candidates(text: Column) -> Column:
    """All candidates of a text with their votes; null and empty texts have none."""

    def read(column: pa.Array) -> pa.Array:
        rows = [[{"kind": c.kind, "start": c.start, "end": c.end, "base": c.base, "code": vote(x, c)} for c in find(x)] for x in texts(column)]
        return pa.array(rows, pa.list_(SPAN_TYPE))

    return arrow_column(read, f"array<{SPAN}>")(text)


def label_model(codes: list[int], counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """The probability of personal data for each distinct (kind, votes), by expectation maximisation.

    Each labeler has a distribution over its votes for true and for false candidates; each kind
    has a prior. All candidates of the corpus count.
    """
    kinds = np.array([decode(c)[0] for c in codes])
    votes = np.array([decode(c)[1] for c in codes])
    belief = sigmoid(1.5 * votes.sum(axis=1))
    for _ in range(rounds):
        odds = np.zeros(len(codes))
        for kind in np.unique(kinds):
            own = kinds == kind
            prior = (counts[own] @ belief[own] + 1) / (counts[own].sum() + 2)
            odds[own] = np.log(prior / (1 - prior))
        for k in range(len(LABELERS)):
            for v in (-1, 0, 1):
                here = votes[:, k] == v
                true = ((counts * belief)[here].sum() + 0.5) / ((counts * belief).sum() + 1.5)
                false = ((counts * (1 - belief))[here].sum() + 0.5) / ((counts * (1 - belief)).sum() + 1.5)
                odds[here] += np.log(true / false)
        # what a labeler calls strictly right is right: the estimation can't swap the classes
        odds[votes[:, 0] == 1] = np.maximum(odds[votes[:, 0] == 1], 3.0)
        new = sigmoid(odds)
        if np.abs(new - belief).max() < 1e-4:
            break
        belief = new
    return belief


def train(found: DataFrame, threshold: float = 0.5) -> frozenset[int]:
    """The (kind, votes) codes the span classifier accepts, learnt from all rows of ``found(spans)``.

    Only the histogram of codes reaches the driver: at most kinds times three to the number
    of labelers.
    """
    rows = found.select(F.explode("spans").alias("s")).groupBy("s.code").count().collect()
    if not rows:
        return frozenset()
    rows = sorted(map(tuple, rows))
    codes, counts = [r[0] for r in rows], np.array([r[1] for r in rows], float)
    belief = label_model(codes, counts)
    decoded = [decode(c) for c in codes]
    features = np.array([[*(k == j for j in range(len(KINDS))), *votes, *(v == 0 for v in votes)] for k, votes in decoded], float)
    # a frequent pattern counts more, but not a thousand times more
    weights = fit_linear(features, belief, np.log1p(counts), ridge=0.1)
    score = sigmoid(features @ weights[:-1] + weights[-1])
    return frozenset(c for c, s in zip(codes, score) if s >= threshold)


def choose(spans: list[dict], accepted: frozenset[int]) -> list[dict]:
    """The base spans, then accepted others that touch nothing chosen before, by kind and start."""
    chosen = [s for s in spans if s["base"]]
    taken = sorted((s["start"], s["end"]) for s in chosen)
    for s in sorted((s for s in spans if not s["base"] and s["code"] in accepted), key=lambda s: (s["start"], -s["end"])):
        if all(s["end"] <= a or b <= s["start"] for a, b in _near(taken, s["start"], s["end"])):
            chosen.append(s)
            insort(taken, (s["start"], s["end"]))
    return sorted(chosen, key=lambda s: (KINDS.index(s["kind"]), s["start"]))


def _near(taken: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    at = bisect_left(taken, (start, end))
    # base spans of different kinds may overlap a little, so look some places back
    return taken[max(0, at - 8):at + 8]


def spans(found: Column, accepted: frozenset[int]) -> Column:
    """The spans chosen from a column of candidates, by kind as in :data:`KINDS`, then start."""

    def pick(column: pa.Array) -> pa.Array:
        return pa.array([choose(x or [], accepted) for x in column.to_pylist()], pa.list_(SPAN_TYPE))

    return arrow_column(pick, f"array<{SPAN}>")(found)


def redact_text(text: str, chosen: list[dict]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first to start names the place."""
    out, at = [], 0
    for s in sorted(chosen, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at:s["start"]], f"<{s['kind'].upper()}>"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def redactor(accepted: frozenset[int]):
    """An expression over a text and its column of candidates: the text without its personal data. Null stays null."""

    def clean(texts: pa.Array, found: pa.Array) -> pa.Array:
        rows = []
        for value, spans_ in zip(texts, found, strict=True):
            text = value.as_py()
            rows.append(redact_text(text, choose(spans_.as_py(), accepted)) if text and len(spans_) else text)
        return pa.array(rows, pa.string())

    return F.arrow_udf(clean, "string")


def personal_data(docs: DataFrame) -> DataFrame:
    """``(doc_id, spans)`` per row of ``docs(doc_id, text, ...)``; a null text has no spans.

    Offsets are code points, ends exclusive. Repeated rows stay repeated (and count as often in
    the training); extra columns are ignored; an empty table gives an empty result.
    """
    found = store(docs.select("doc_id", candidates(F.col("text")).alias("spans")), "candidates")
    return found.select("doc_id", spans(F.col("spans"), train(found)).alias("spans"))
