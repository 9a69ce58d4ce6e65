"""Lemmas from a word list, and their use on token columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tellerflow.functions.textprep import lemmatize_with
from tellerflow.sources import catalogue


# A lemma table of at most this many entries is part of the expression; each hit searches it.
LITERAL = 1_000


def _ends(token: Column, endings: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [token.endswith(e) for e in endings])


def noun_lemmas(tokens: DataFrame, lexicon: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """(token, lemma) for every token whose noun lemma differs from it.

    ``tokens(token)`` is the vocabulary, ``lexicon(word)`` the known words and
    ``exceptions(token, lemma)`` irregular forms. A lemma is the shortest known
    word among the token itself and the token with one noun ending detached.
    Work grows with the vocabulary, not with the corpus.
    """
    token = F.col("token")
    own = tokens.select("token").filter(~token.isin(*catalogue.DOMAIN_TERMS))
    # of a token without a noun ending nothing can be detached: it is its own lemma
    vocabulary = own.filter(_ends(token, [ending for ending, _ in catalogue.NOUN_ENDINGS])).distinct()
    forms = [F.struct(F.lit(0).alias("rank"), token.alias("lemma"))]
    for rank, (ending, base) in enumerate(catalogue.NOUN_ENDINGS, 1):
        stem = F.substr(token, F.lit(1), F.length(token) - len(ending))
        forms.append(
            F.when(token.endswith(ending), F.struct(F.lit(rank).alias("rank"), F.concat(stem, F.lit(base)).alias("lemma")))
        )
    candidates = vocabulary.select("token", F.explode(F.array_compact(F.array(*forms))).alias("form")).select(
        "token", "form.rank", "form.lemma"
    )
    if exceptions is not None:
        irregular = exceptions.select("token", F.lit(1).alias("rank"), "lemma")
        candidates = candidates.join(
            irregular.select("token", F.lit(True).alias("irregular")).distinct(), "token", "left"
        ).filter(F.col("irregular").isNull() | (F.col("rank") == 0)).drop("irregular")
        # an irregular form may end anyhow
        themselves = irregular.select("token", F.lit(0).alias("rank"), token.alias("lemma"))
        candidates = candidates.unionByName(irregular.unionByName(themselves).join(own, "token", "left_semi"))
    known = candidates.join(lexicon.select(F.col("word").alias("lemma")), "lemma", "left_semi")
    shortest = known.groupBy("token").agg(F.min(F.struct(F.length("lemma").alias("n"), "rank", "lemma")).alias("best"))
    return shortest.select("token", F.col("best.lemma").alias("lemma")).filter(F.col("token") != F.col("lemma"))


def lemmatize_tokens(
    documents: DataFrame, key: str, tokens: str, lemmas: DataFrame, endings: list[str] | None = None, literal: int = LITERAL
) -> DataFrame:
    """(key, lemmas): token arrays with the lemma table applied; ``key`` identifies a row.

    A table of at most ``literal`` entries is applied where the tokens are read. Of a larger one
    only a document's distinct tokens are looked up, with ``endings`` only those
    that end so (all the table's tokens must). What is found comes back as one
    small map per document and is applied to the array in its place. A frequent
    token makes a skewed partition of the lookup, which AQE splits. Pass a stored
    table (``files.store``), whose size the planner knows.
    """

    few = lemmas.limit(literal + 1).collect()
    if len(few) <= literal:
        kept = F.filter(tokens, lambda t: t.isNotNull())
        return documents.select(key, lemmatize_with(kept, dict(few), keep=[]).alias("lemmas"))

    def may_change(token):
        return _ends(token, endings) if endings else token.isNotNull()

    asked = documents.select(key, F.explode(F.array_distinct(F.filter(tokens, may_change))).alias("token"))
    found = asked.join(lemmas, "token").groupBy(key).agg(
        F.map_from_entries(F.collect_set(F.struct("token", "lemma"))).alias("found")
    )
    words = F.transform(F.filter(tokens, lambda t: t.isNotNull()), lambda t: F.coalesce(F.try_element_at("found", t), t))
    return documents.select(key, tokens).join(found, key, "left").select(
        key, F.when(F.col("found").isNull(), F.filter(tokens, lambda t: t.isNotNull())).otherwise(words).alias("lemmas")
    )
