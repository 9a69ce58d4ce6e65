"""Toxicity scores from weak supervision.

Many voters look at a text: one per lexicon term, and patterns such as shouting or disguised
spelling. A generative model (expectation maximisation) estimates each voter's behaviour on
toxic and on clean texts and the correlations between voters; a linear classifier is then
trained on the posterior labels and scores every text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_column, learnable, store, texts
from .linear import fit_linear, sigmoid

#: Labelled rows the models are fitted on, at most, and the least share of them that each class gets if it has so many.
TRAIN_ROWS = 30_000
CLASS_SHARE = 0.1
#: Terms that stand out, at most, of which the mined ones are chosen; the best by score.
CANDIDATE_TERMS = 20_000
#: Terms mined from the labelled rows that become voters.
MINED_TERMS = 200
#: A term that ends in ``~`` stands for all words that start so; stems have these lengths.
STEMS = range(4, 9)
THRESHOLD = 0.3
#: How reliable given labels are taken to be at first, and at most.
LABEL_TRUST = 0.95

#: Insults every model starts with.
SEED_TERMS = (
    "asshole bastard bitch bullshit clown crap creep cretin degenerate disgusting dumb dumbass fool freak garbage "
    "hate idiot imbecile jerk kill loser moron pathetic pig retard scum shit stupid trash vermin whore worthless"
).split()

WORD = re.compile(r"[^\W\d_]+")
SMALL = re.compile(r"\b[A-Z]?[a-z]")
DISGUISED = re.compile(r"[A-Za-z013457@$*]*[013457@$*][A-Za-z013457@$*]+")
SPELLING = str.maketrans("013457@$", "oieastas")
SPACED = re.compile(r"\b(?:[A-Za-z][ .\-]){3,15}[A-Za-z]\b")
DIRECT = frozenset("you your yours youre u ur".split())
PATTERNS = ("disguised", "spaced", "direct", "dense", "repeated", "varied", "shouting", "exclaiming", "silent", "mild")


def units_of(words: list[str]) -> set[str]:
    """The terms a text's words could match: the words and their stems."""
    out = set(words)
    for word in tuple(out):
        out.update([f"{word[:k]}~" for k in STEMS if k < len(word)])
    return out


class Voters:
    """Turns a text into votes (1 toxic, -1 clean, 0 none) and features."""

    def __init__(self, terms: list[str]):
        self.terms = list(terms)
        self.place = {t: k for k, t in enumerate(self.terms)}
        self.stems = frozenset(t[:-1] for t in self.terms if t.endswith("~"))
        self.starts = frozenset(s[:STEMS[0]] for s in self.stems)

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        place = self.place
        words = WORD.findall(text.lower())
        found = [w for w in words if w in place]
        for word in words:
            if word[:STEMS[0]] in self.starts:
                found += [f"{word[:k]}~" for k in STEMS if k < len(word) and word[:k] in self.stems]
        disguised = [w for m in DISGUISED.findall(text) if (w := m.translate(SPELLING).replace("*", "").lower()) in place and w != m.lower()]
        spaced = [w for m in SPACED.findall(text) if (w := re.sub("[^a-z]", "", m.lower())) in place]
        hits = Counter(found)
        hits.update(disguised)
        hits.update(spaced)
        total = sum(hits.values())  # a word counts once for each term it matches
        direct = bool(total) and not DIRECT.isdisjoint(words)
        small = len(SMALL.findall(text))
        shouting = 0 < len(words) and small * 2 < len(words)
        exclaiming = text.count("!") * 20 > len(words) + 20
        share = total / max(1, len(words))
        votes = np.zeros(len(self.terms) + len(PATTERNS), np.int8)
        votes[[place[w] for w in hits]] = 1
        votes[len(self.terms):] = (
            bool(disguised), bool(spaced), direct, share > 0.02, total > len(hits), len(hits) > 1,
            shouting, exclaiming, -(not total), -(share < 0.0005),
        )
        extra = np.array([np.log1p(total), np.log1p(len(hits)), np.log1p(1000 * share), bool(total), shouting, exclaiming], np.float32)
        return votes, np.concatenate([votes, extra]).astype(np.float32)


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 25) -> np.ndarray:
    """The posterior probability of toxic for each row.

    ``votes`` holds -1, 0, 1 by voter. Each voter has a distribution over its votes for either
    class; its evidence is divided by one plus its summed squared correlation, given the class,
    with the others. The given labels (0 or 1) start the estimation, put the summed evidence on
    the scale of a probability, and are one more voter, as reliable as they agree with the others.
    """
    rows = len(votes)
    if not rows:
        return np.zeros(0)
    side, trust = np.where(labels > 0, 1, -1), LABEL_TRUST
    belief = sigmoid(side * np.log(trust / (1 - trust)))
    for _ in range(rounds):
        evidence = np.zeros(votes.shape, np.float32)
        for kind in (-1, 0, 1):
            here = votes == kind
            toxic = (belief @ here + 0.1) / (belief.sum() + 0.3)
            clean = ((1 - belief) @ here + 0.1) / ((1 - belief).sum() + 0.3)
            evidence += here * np.log(toxic / clean).astype(np.float32)
        # correlations between voters within the classes
        rest = votes.astype(np.float32)
        for own in (belief, 1 - belief):
            rest -= np.outer(own, own @ votes / max(own.sum(), 1e-9)).astype(np.float32)
        joint = rest.T @ rest / rows
        spread = np.sqrt(np.maximum(np.diag(joint), 1e-9))
        related = (joint / np.outer(spread, spread)) ** 2
        np.fill_diagonal(related, 0)
        summed = (evidence @ (1 / (1 + related.sum(axis=1))))[:, None]
        slope, start = fit_linear(summed, (labels > 0).astype(float))
        odds = summed[:, 0] * slope + start
        trust = np.clip(sigmoid(side * odds).mean(), 0.6, LABEL_TRUST)
        new = sigmoid(odds + side * np.log(trust / (1 - trust)))
        if np.abs(new - belief).max() < 1e-4:
            break
        belief = new
    return belief


def _labelled(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[DataFrame, float]:
    """Texts and labels of at most ``rows`` labelled ids, and by how much the draw has raised the log odds of toxic.

    Ids are drawn by their hash within each class. A class gets its share of the rows, a rare one more than that:
    ``CLASS_SHARE`` of the rows, or all it has.
    """
    given = store(
        labels.filter(learnable(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "given-labels")
    number = {c: given.filter(F.col("toxic") == c).count() for c in (0, 1)}
    total = sum(number.values())
    share = {c: min(number[c], max(number[c] * rows // max(total, rows), int(rows * CLASS_SHARE))) for c in number}
    rest = {c: min(share[c], rows - share[1 - c]) if share[c] >= share[1 - c] else share[c] for c in share}
    chosen = [given.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rest[c]) for c in (0, 1)]
    raised = float(np.log(rest[1] / rest[0]) - np.log(number[1] / number[0])) if all(rest.values()) else 0.0
    # the broadcast has ``rows`` pairs of numbers at most
    return docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id"), raised


def mine_terms(labelled: DataFrame, limit: int) -> list[str]:
    """The words and stems most tied to toxic rows, by a z-score of document frequencies over all given rows.

    A term is passed over if a longer or shorter one already taken is as exact.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[int]] = {}
            for text, own in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                for unit in {*units_of(WORD.findall(text.lower())), ""}:
                    found.setdefault(unit, [0, 0])[own] += 1
            columns = [pa.array(list(found), pa.string()), *(pa.array([v[c] for v in found.values()], pa.int64()) for c in (1, 0))]
            yield pa.RecordBatch.from_arrays(columns, ["term", "toxic", "clean"])

    counted = store(
        labelled.select("text", "toxic").mapInArrow(count, "term string, toxic long, clean long")
        .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "terms")
    whole = counted.filter("term = ''").first()
    if not whole or not whole.toxic:
        return []
    a, b = (F.col("toxic") + 0.5) / (whole.toxic + 1), (F.col("clean") + 0.5) / (whole.clean + 1)
    z = F.log(a / b) / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    # a term in few toxic texts can't stand out
    telling = counted.filter("term <> '' AND toxic >= 5").select("term", (-z * a).alias("score"), (a / b).alias("ratio"), z.alias("z"), a.alias("a"), b.alias("b"))
    telling = telling.filter("z > 3 AND a > 5 * b").orderBy("score", "term").limit(CANDIDATE_TERMS)
    scored = [(r.score, r.term, r.ratio) for r in telling.select("score", "term", "ratio").collect()]
    kept: list[tuple[str, float]] = []
    for _, term, ratio in sorted(scored):
        bare = term.rstrip("~")
        if not any(ratio <= 2 * r and (bare.startswith(t) or t.startswith(bare)) for t, r in kept):
            kept.append((bare, ratio))
            if len(kept) == limit:
                break
    chosen = {bare for bare, _ in kept}
    return [t for _, t, _ in sorted(scored) if t.rstrip("~") in chosen]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, mined: int = MINED_TERMS) -> tuple[list[str], np.ndarray]:
    """Terms and weights, learnt from labelled rows that aren't held out.

    Without any usable label the seed terms are trusted as they are.
    """
    drawn, raised = _labelled(docs, labels, rows)
    labelled = store(drawn, "labelled")
    terms = sorted({*SEED_TERMS, *mine_terms(labelled, mined)})
    width = len(terms) + len(PATTERNS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(terms)
        for batch in batches:
            pairs = [voters.read(x) for x in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([v.tobytes() + f[width:].tobytes() for v, f in pairs], pa.binary())],
                ["doc_id", "toxic", "features"])

    seen = labelled.select("doc_id", "text", "toxic").mapInArrow(read, "doc_id long, toxic int, features binary")
    found = seen.orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(rows).select("toxic", "features").toPandas()
    if not len(found):
        weights = np.zeros(width + 7)
        weights[:len(terms)], weights[-1] = 1.0, -2.0
        return terms, weights
    # a byte for each vote, then the other features
    packed = np.frombuffer(b"".join(map(bytes, found.features)), np.uint8).reshape(len(found), -1)
    votes, extra = packed[:, :width].view(np.int8), np.ascontiguousarray(packed[:, width:]).view(np.float32)
    belief = label_model(votes, found.toxic.to_numpy())
    weights = fit_linear(np.column_stack([votes, extra]), belief)
    weights[-1] -= raised  # the odds of all labelled rows again
    return terms, weights


def scorer(terms: list[str], weights: np.ndarray):
    """An expression over a text column: the probability of toxic. Null counts as empty."""
    shared = SparkSession.active().sparkContext.broadcast((terms, weights))

    def score(column: pa.Array) -> pa.Array:
        names, own = shared.value
        voters = Voters(names)
        values = [float(voters.read(x)[1] @ own[:-1] + own[-1]) for x in texts(column)]
        return pa.array(sigmoid(np.array(values, float)), pa.float64())

    return arrow_column(score, "double")


def score_documents(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``(doc_id, score)`` per row of ``docs(doc_id, text, ...)``.

    Null and empty texts get the score of a text without any hit. Labels other than 0 and 1 and
    labels of null ids are not learnt from; contradictory labels of an id count as toxic.
    Repeated rows stay repeated and extra columns are ignored. No documents give no row; without a usable
    label the seed terms are trusted as they are. Texts are read whole, whatever their length. Terms that
    stand out alike are taken in their order, and equal draws are told apart by the id.
    """
    return docs.select("doc_id", scorer(*train(docs, labels, rows))(F.col("text")).alias("score"))
