"""Text preparation as native column expressions.

``clean`` is one chain of JVM expressions per row: no Python worker, no
shuffle, whole texts. Every pattern is linear in the text and loops without
recursion (possessive groups), so a very long text cannot blow the regex stack.
Most texts hold no digit, quote, link or address; a plain test skips the regexes
that could not match them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tellerflow.sources import catalogue

# What the marking steps look for. Whitespace and digits are meant
# as Unicode understands them; the JVM's \s and \d are ASCII.
_SPACE = r"\s\p{Z}\x1c-\x1f\x85"
_DIGITS = r"\p{Nd}"
_WORD = r"[\p{L}\p{N}_]"

# The look-ahead lets the engine pass over most characters with one test.
CURRENCY = (
    r"(?=[$£¥riu\x{20a0}-\x{20bf}])(?:[$€£₹¥₩₽₿]|rs|inr|usd)"
    rf"[{_SPACE}]?{_DIGITS}+(?:[.,]{_DIGITS}+)*+"
)

# A number of at least four characters, separators counted: after its first
# digit the four shapes such a number can have, so that no per-match callback
# is needed.
LONG_NUMBER = f"{_DIGITS}(?:" + "|".join(
    [
        rf"{_DIGITS}{{3,}}(?:[.,]{_DIGITS}+)*+",
        rf"{_DIGITS}{{1,2}}(?:[.,]{_DIGITS}+)++",
        rf"[.,]{_DIGITS}{{2,}}(?:[.,]{_DIGITS}+)*+",
        rf"(?:[.,]{_DIGITS}+){{2,}}+",
    ]
) + ")"
URL = rf"https?://[^{_SPACE}]+|www\.[^{_SPACE}]+"

# A whole whitespace-free run with an inner '@'. Anchored at the start of the
# run, so a run without '@' is read once and not once per position.
EMAIL = rf"(?<![^{_SPACE}])[^{_SPACE}][^@{_SPACE}]*+@[^{_SPACE}]+"

# Everything else, whitespace included, becomes one space.
DROPPED = r"[^\p{L}\p{N}@#%&*\-_/]+"


def mark_currency(text: Column) -> Column:
    return F.regexp_replace(text, CURRENCY, " CURRENCY ")


def mark_numbers(text: Column) -> Column:
    return F.regexp_replace(text, LONG_NUMBER, " NUMBER ")


def expand_contractions(text: Column) -> Column:
    return reduce(
        lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])),
        catalogue.CONTRACTIONS,
        text,
    )


def mark_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, " URL ")


def mark_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, " EMAIL ")


def keep_characters(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, DROPPED, " "))


def _bind(value: Column, step: Callable[[Column], Column]) -> Column:
    """``step`` applied to a value computed once, however often it refers to it."""
    return F.get(F.transform(F.array(value), step), 0)


def _only_if(test: Callable[[Column], Column], step: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda text: F.when(test(text), step(text)).otherwise(text)


# Each marking step behind a cheap test that holds for every text it can change.
_MARKING = [
    _only_if(lambda t: t.rlike(_DIGITS), lambda t: mark_numbers(mark_currency(t))),
    _only_if(lambda t: t.contains("'"), expand_contractions),
    _only_if(lambda t: t.contains("://") | t.contains("www."), mark_urls),
    _only_if(lambda t: t.contains("@"), mark_emails),
]


def clean(text: Column) -> Column:
    """Cleaned text; null becomes the empty string."""
    return keep_characters(reduce(_bind, _MARKING, F.lower(F.coalesce(text.cast("string"), F.lit("")))))


def _token_breaks() -> tuple[str, str]:
    """One pattern for all that is set apart or split in two, and its replacement."""
    whole = [f"({head})({tail})" for head, tail in catalogue.FUSED_FORMS[:-1]]
    head, tail = catalogue.FUSED_FORMS[-1]  # only before a space
    fused = rf"(?:{'|'.join(whole)})(?!{_WORD})|({head})({tail})(?=[\s@#%&]|--|$)"
    pattern = rf"(?=[@#%&\-cglwCGLW])(?:([@#%&]|--)|(?<!{_WORD})(?i:{fused}))"
    n = len(catalogue.FUSED_FORMS)
    firsts = "".join(f"${2 * i + 2}" for i in range(n))
    seconds = "".join(f"${2 * i + 3}" for i in range(n))
    return pattern, f" $1{firsts} {seconds} "


def tokenize(cleaned: Column) -> Column:
    """Tokens of a cleaned text.

    Of the Treebank rules only these can still apply after ``clean``: isolated
    symbols, double dashes and the fused verb forms.
    """
    spaced = F.regexp_replace(cleaned, *_token_breaks())
    return F.filter(F.split(spaced, " "), lambda t: t != "")


def keep_tokens(tokens: Column) -> Column:
    """Drop stop words, except that domain terms always stay."""
    dropped = [w for w in catalogue.STOP_WORDS if w not in catalogue.DOMAIN_TERMS]
    return F.filter(tokens, lambda t: ~t.isin(*dropped))


def lemmatize_with(tokens: Column, lemmas: dict[str, str], keep: list[str] | None = None) -> Column:
    """Replace tokens by a literal table; those to ``keep``, the domain terms if not given, stay as they are.

    Any size gives the same result, but each hit searches the whole literal: large
    tables are for ``lemmas.lemmatize_tokens``, which joins them.
    """
    kept = catalogue.DOMAIN_TERMS if keep is None else keep
    used = {token: lemma for token, lemma in lemmas.items() if token not in kept}
    if not used:
        return tokens
    table = F.from_json(F.lit(json.dumps(used)), "map<string,string>")
    return F.transform(tokens, lambda t: F.when(t.isin(*used), F.try_element_at(table, t)).otherwise(t))


def preprocess(text: Column, lemmas: dict[str, str] | None = None) -> Column:
    """clean -> tokens -> filter -> lemmas -> text, as one expression."""
    kept = keep_tokens(tokenize(clean(text)))
    return F.array_join(lemmatize_with(kept, lemmas if lemmas is not None else catalogue.LEMMAS), " ")


def add_processed(df: DataFrame, columns: list[str], lemmas: dict[str, str] | None = None) -> DataFrame:
    """Add ``processed_<c>`` for each listed column that exists."""
    return df.withColumns({f"processed_{c}": preprocess(F.col(c), lemmas) for c in columns if c in df.columns})
