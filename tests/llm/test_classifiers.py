import random
import re
import tracemalloc
from collections import Counter
from functools import cache

import numpy as np
import pytest
from edge import documents, none
from pyspark.sql import functions as F

from tellerflow.llm import langid, licences, toxicity
from tellerflow.llm.common import held_out
from tellerflow.sources.tables import table

MIDDLE = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def middle(spark):
    return table(spark, MIDDLE, "documents").select("doc_id", "text", "lang"), table(spark, MIDDLE, "labels")


def test_toxicity_on_held_out_rows(middle):
    docs, labels = middle
    rows = toxicity.score_documents(docs, labels).join(labels, "doc_id").filter(held_out(F.col("doc_id"))).collect()
    scores = [(r.score, r.toxic) for r in rows]
    caught = np.mean([s >= 0.3 for s, t in scores if t == 1])
    wrong = np.mean([s >= 0.3 for s, t in scores if t == 0])
    assert caught > 0.9 and wrong < 0.02
    assert all(0 <= s <= 1 for s, _ in scores)


def test_toxicity_edges(spark):
    docs = documents(spark, "score", "toxic")
    labels = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (8, 1, None), (None, 1, 1), (6, 0, 7)], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(docs, labels).count() == docs.count()
    assert toxicity.score_documents(none(spark), labels).count() == 0
    without = toxicity.score_documents(docs.withColumn("text", F.concat(F.col("text"), F.lit(" you stupid idiot"))), labels.limit(0))
    scores = {r.doc_id: r.score for r in without.collect()}
    assert scores[1] > 0.3 > scores[2]


def test_label_model_weighs_voters():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.2
    votes = np.zeros((4000, 5), np.int8)
    for k, share in enumerate((0.95, 0.8, 0.6)):
        votes[:, k] = np.where(rng.random(4000) < share, np.where(truth, 1, -1), np.where(truth, -1, 1))
    votes[:, 3] = votes[:, 4] = votes[:, 2]  # copies of a poor voter
    labels = np.where(rng.random(4000) < 0.9, truth, ~truth)
    belief = toxicity.label_model(votes, labels.astype(int))
    assert ((belief > 0.5) == truth).mean() > (labels == truth).mean()
    assert len(toxicity.label_model(np.zeros((0, 3), np.int8), np.zeros(0))) == 0


def test_disguised_words():
    voters = toxicity.Voters(["idiot", "moro~"])
    votes, _ = voters.read("what an 1d10t")
    assert votes[0] == 1 and votes[2 + toxicity.PATTERNS.index("disguised")] == 1
    assert voters.read("i d i o t")[0][0] == 1
    assert voters.read("Morons")[0][1] == 1


def test_language_on_held_out_rows(middle):
    docs, _ = middle
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter(held_out(F.col("doc_id"))).collect()
    assert np.mean([r.found.lang == r.lang for r in rows]) > 0.99
    assert all(0 <= r.found.score <= 1 for r in rows)
    assert np.mean([r.found.accepted for r in rows]) > 0.97


def test_language_edges(spark):
    docs = documents(spark, "found", "gram").drop("lang").withColumn("lang", F.expr("CASE WHEN doc_id = 8 THEN 'fr' WHEN doc_id < 8 THEN 'en' END"))
    rows = langid.identify(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r.found for r in rows}
    assert [by[k].lang for k in (2, 3, 4, 5)] == ["und"] * 4 and by[2].score == 0
    assert by[1].lang == "en" and by[None].lang != "und"
    assert langid.identify(none(spark)).count() == 0
    assert {r.found.lang for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_probabilities_sum_to_one(spark):
    """Over all characters that may follow, the model's probabilities and its share for unseen ones make one."""
    words = ["abba", "abab", "baab", "caba", "a"]
    docs = spark.createDataFrame([("xx", " ".join(words * 3))], "lang string, text string")
    grams = {r.gram: r.n for r in langid.count_grams(docs, 3).collect()}
    probability, backoff, floor = langid._kneser_ney(grams, 3, 4)
    letters = ["a", "b", "c", langid.END]

    def chance(context, letter):
        for k in range(len(context), -1, -1):
            gram = context[len(context) - k:] + letter
            if gram in probability[k]:
                value = probability[k][gram]
                break
        else:
            value, k = floor, -1
        for longer in range(k + 1, len(context) + 1):
            value *= backoff[longer - 1].get(context[len(context) - longer:], 1.0) if longer else 1.0
        return value

    for context in ("ab", "ba", "ca", langid.START * 2, langid.START + "a"):
        assert abs(sum(chance(context, x) for x in letters) + chance(context, "?") - 1) < 1e-6


def plain_lines(text, order=4):
    return ["\x02" * (order - 1) + w + "\x03" for w in re.findall(r"[^\W\d_]+", text.lower())]


def plain_models(training, order=4):
    """The probability of an n-gram's last character by language, by the textbook's recursion over plain dictionaries."""
    counts = {}
    for lang, sample in training:
        own = counts.setdefault(lang, Counter())
        for line in plain_lines(sample):
            own.update(line[k:k + order] for k in range(len(line) - order + 1))
    letters = {g[-1] for own in counts.values() for g in own}

    def model(own):
        levels = {order: own}
        for k in range(order - 1, 0, -1):
            levels[k] = Counter(g[1:] for g in levels[k + 1])
        discounts, follow = {}, {}
        for k, level in levels.items():
            ones, twos = (sum(n == m for n in level.values()) for m in (1, 2))
            discounts[k] = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
            for gram, n in level.items():
                follow.setdefault(gram[:-1], []).append(n)

        @cache
        def chance(gram):
            if not gram:
                return 1 / (len(letters) + 1)
            after = follow.get(gram[:-1])
            if not after:
                return chance(gram[1:])
            discount = discounts[len(gram)]
            return (max(levels[len(gram)][gram] - discount, 0) + discount * len(after) * chance(gram[1:])) / sum(after)

        return chance

    return {lang: model(own) for lang, own in counts.items()}


def plain_entropy(models, text, order=4):
    """Cross-entropy of a text by language."""
    grams = [line[k:k + order] for line in plain_lines(text) for k in range(len(line) - order + 1)]
    return {lang: -sum(np.log(chance(g)) for g in grams) / len(grams) for lang, chance in models.items()}


def test_entropies_are_those_of_plain_kneser_ney(spark):
    training = [("en", "the cat sat on the mat and the dog ran to the cat"), ("de", "der hund und die katze sind auf der matte"),
                ("en", "a dog and a cat and a man"), ("xx", "zz zzz z")]
    model = langid.train(spark.createDataFrame(training, "lang string, text string"))
    plain = plain_models(training)
    tests = ["the dog sat", "die matte", "unseen Wörter qqq", "a", "zz", "x1y cat-dog THE"]
    found, chars = model.entropies(iter(tests))
    for own, n, text in zip(found, chars, tests):
        want = plain_entropy(plain, text)
        assert n == sum(len(w) + 1 for w in langid.words_of(text))
        assert np.allclose(own, [want[lang] for lang in model.langs], rtol=1e-5), text


def test_words_without_a_break_are_scored_and_counted_in_pieces(spark, monkeypatch):
    rng = random.Random(3)
    letters = "abcdefgh한글日本語"
    long = "".join(rng.choices(letters, k=3000))
    rows = [(f"l{k % 7}", "".join(rng.choices(letters[k % 7:], k=400)) + " " + long[:k]) for k in range(40)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    whole = langid.train(docs)
    tests = [long, long + " ab " + long[:50], "", "a", "12", "hgf " * 30]
    before = whole.entropies(iter(tests))
    for size in (1, 7, 64):
        monkeypatch.setattr(langid, "SCORED_CELLS", size * len(whole.langs))
        monkeypatch.setattr(langid, "HELD_GRAMS", size)
        after = langid.train(docs).entropies(iter(tests))
        assert (before[1] == after[1]).all() and np.allclose(before[0], after[0], rtol=1e-6)


def test_memory_of_very_long_words_and_many_languages():
    """20 million characters without a break, and 100 languages: what scoring takes beyond the text stays small."""

    def model(langs):
        rng = np.random.default_rng(1)
        tables = []
        for order in range(1, 5):
            keys = np.sort(langid.hashes(rng.integers(97, 123, 3000).astype(np.uint64), order))
            tables.append((keys, rng.normal(-3, 1, (len(keys), langs)).astype(np.float32), rng.normal(-1, 1, (len(keys), langs)).astype(np.float32)))
        return langid.Model([f"l{k}" for k in range(langs)], 4, tables, np.full(langs, -5, np.float32))

    for langs, size in ((4, 20_000_000), (100, 400_000)):
        text = "abcdefghijklmnopqrstuvwxyz"[:23] * (size // 23)
        own = model(langs)
        tracemalloc.start()
        entropy, chars = own.entropies(iter([text]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert chars[0] == len(text) + 1 and np.isfinite(entropy).all()
        assert peak < 400 << 20, (langs, peak >> 20)


def test_switch_goes_by_bytes(spark):
    """What fitting takes grows with the n-grams and with the languages."""
    few = spark.createDataFrame([("a", "abcd", 1), ("b", "abcd", 2)], "lang string, gram string, n long")
    many = spark.createDataFrame([(f"l{k}", "abcd", 1) for k in range(50)], "lang string, gram string, n long")
    assert langid.fitting_bytes(few.limit(0), 4) == 0
    assert langid.fitting_bytes(few, 4) == 2 * langid.GRAM_BYTES + 4 * (8 + 16)
    assert langid.fitting_bytes(many, 4) == 50 * langid.GRAM_BYTES + 4 * (8 + 400)


def test_language_of_many_grams_loses_nothing(spark, sf_dir):
    """Above the size of a broadcast model the predictions are the same, and a small language stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").limit(120)
    rare = spark.createDataFrame([(10**6 + k, f"qwxz{chr(97 + k)} vjjk{chr(98 + k)}", "zz") for k in range(12)], "doc_id long, text string, lang string")
    docs = docs.union(rare)
    whole = {r.doc_id: r.found for r in langid.identify(docs).collect()}
    joined = {r.doc_id: r.found for r in langid.identify(docs, model_bytes=100).collect()}
    assert whole.keys() == joined.keys()
    for k, found in whole.items():
        assert (joined[k].lang, joined[k].accepted) == (found.lang, found.accepted)
        assert np.isclose(joined[k].score, found.score, atol=1e-4)
    assert {joined[10**6 + k].lang for k in range(12)} == {"zz"}


def test_language_limits_come_from_all_training_rows(spark, monkeypatch):
    """No sample of the training rows: limits and scale are those of plain sums over every one."""
    rng = random.Random(11)
    rows = [(k, " ".join("".join(rng.choices("abcdef" if k % 2 else "defghi", k=rng.randint(1, 6))) for _ in range(1 + k % 3)), "xy"[k % 2])
            for k in range(6200)]
    given, inner = [], langid._set_limits

    def spy(model, found, *rest):
        given.append((model, found.select("lang", "chars", "entropy").collect()))
        return inner(model, found, *rest)

    monkeypatch.setattr(langid, "_set_limits", spy)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identify(docs).collect()
    (model, known), = given
    assert len(known) == docs.filter(~held_out(F.col("doc_id"))).count() > 4000 and len(found) == 6200
    entropy, own = np.array([r.entropy for r in known]), np.array([model.langs.index(r.lang) for r in known])
    for k in range(2):
        low, mid, high = np.quantile(entropy[own == k, k], [0.25, 0.5, 0.75])
        assert np.isclose(model.limits[k], mid + 8 * max(high - low, 0.01), rtol=1e-12)
    gap = (entropy - entropy.min(axis=1, keepdims=True)) * np.minimum([r.chars for r in known], 100)[:, None]
    assert np.isclose((1 / np.exp(-gap * model.scale).sum(axis=1)).mean(), (entropy.argmin(axis=1) == own).mean(), atol=1e-6)


LICENSED = {
    "Released under the MIT License.": "MIT",
    "some text\nThis work is licensed under the GNU General Public License, version 3.\nmore": "GPL-3.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    "Licensed under CC BY 4.0.": "CC-BY",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files\n"
    "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use": "MIT",
}
FREE = [
    "The version of the story that was licensed to the film studio is free.",
    "Under the terms of the contract the software must be delivered in May.",
    "I renewed my driving license at the office under the bridge.",
    "", "General Public Hearing, version two of the minutes",
]


def test_licences(spark, sf_dir):
    model = licences.train(table(spark, sf_dir, "documents"))
    for text, family in LICENSED.items():
        verdicts = [model.read(words) for _, _, words in licences.paragraphs(text, model.place)]
        assert [v[0] for v in verdicts if v[3]] == [family], text
    for text in FREE:
        assert not any(model.read(words)[3] for _, _, words in licences.paragraphs(text, model.place)), text


def test_every_family_is_told_by_each_of_its_notices(spark, sf_dir):
    model = licences.train(table(spark, sf_dir, "documents"))
    for family, templates in licences.TEMPLATES.items():
        for template in templates:
            for text in (template, f"Some words before.\n{template.upper()}\nand after", f"Copyright (c) 2019 the authors. {template}"):
                assert [(f, sure) for _, _, f, _, _, sure in licences.notices(text, model)] == [(family, True)], text
    # the sharpest neighbours: one word apart
    terms = "it under the terms of the GNU %sGeneral Public License as published by the Free Software Foundation, either version 3 of the " \
        "License, or (at your option) any later version."
    for word, family in (("", "GPL-3.0"), ("Affero ", "AGPL-3.0"), ("Lesser ", "LGPL")):
        assert [f for _, _, f, _, _, sure in licences.notices(terms % word, model) if sure] == [family]


def test_calibration_of_licences():
    """Scale and limit against a plain search, on scores whose true sharpness is known."""
    rng = np.random.default_rng(5)
    scores = rng.normal(0, 1, (6000, 4))
    chance = np.exp(2.5 * scores)
    chance /= chance.sum(axis=1, keepdims=True)
    own = (rng.random(6000)[:, None] > chance.cumsum(axis=1)).sum(axis=1)
    scale, limit, curve = licences.calibrate(scores, own)
    assert abs(scale - 2.5) < 0.15
    assert sum(n for _, _, n in curve) == 6000
    # a band holds what it promises for families alone, as the probability is one of a family
    assert all(abs(p - share) < 0.06 for p, share, n in curve if n > 100)
    chance = np.exp(scale * scores)
    chance /= chance.sum(axis=1, keepdims=True)
    top, right = chance[:, :-1].max(axis=1), chance[:, :-1].argmax(axis=1) == own

    def fits(x):
        return ((~right[top >= x]).sum() + 1) / ((top >= x).sum() + 1) <= licences.FALSE_SHARE

    assert limit == pytest.approx(max(0.5, min(x for x in top if fits(x))))
    # nothing kept back; nothing that any limit could part; ties
    assert licences.calibrate(np.zeros((0, 4)), np.zeros(0, int)) == (1.0, 0.5, ())
    assert licences.calibrate(np.zeros((90, 3)), np.arange(90) % 3)[1] > 1
    same = licences.calibrate(np.repeat([[3.0, 0.0, 0.0]], 200, axis=0), np.r_[np.zeros(100, int), np.ones(100, int)])
    assert same[1] > 1


def test_several_notices_in_a_paragraph(spark, sf_dir):
    model = licences.train(table(spark, sf_dir, "documents"))
    mit, apache, gpl = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", \
        "This work is licensed under the GNU General Public License, version 3."
    prose = "The end of the story was told to the following day of the week, and the rest of the work is in the hands of the people. "

    def confirmed(text):
        return [(text[a:b].strip(" ."), family) for a, b, family, _, _, sure in licences.notices(text, model) if sure]

    pair = [(mit[:-1], "MIT"), (apache[:-1], "Apache-2.0")]
    assert confirmed(f"{mit}\n{apache}") == pair
    assert confirmed(f"{mit} {apache}") == pair
    assert confirmed(f"{prose * 5}{mit} {prose * 9}{apache} {prose * 5}") == pair
    assert confirmed("\n".join([prose, mit, prose, apache, prose, prose, gpl])) == [*pair, (gpl[:-1], "GPL-3.0")]
    assert confirmed(f"{prose}{mit} {prose * 9}{mit} {prose}") == [pair[0]] * 2  # far apart: two notices
    assert confirmed(f"İ {prose}{apache} {mit}") == pair[::-1]
    for text, family in LICENSED.items():
        assert [x[1] for x in confirmed(text)] == [family], text
    # lines that share common word pairs with a template are no part of the notice
    assert confirmed(f"no id but words enough to be of use\n{mit}\nand it has to be the use of this") == pair[:1]
    for text in FREE:
        assert not confirmed(text), text


def test_licence_edges(spark):
    docs = documents(spark, "found", "lines", "h")
    line = "\nReleased under the MIT License.\n"
    rows = licences.scan(docs.withColumn("text", F.concat(F.col("text"), F.lit(line)))).collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for row in rows:
        if texts[row.doc_id] is None:
            assert row.found == []
        else:
            text = texts[row.doc_id] + line
            assert [(text[f.start:f.end], f.family) for f in row.found if f.confirmed] == [(line.strip(), "MIT")]
    assert licences.scan(none(spark)).count() == 0
    # equally likely families: the first one
    even = licences.Model([*licences.TEMPLATES, licences.UNKNOWN], {}, np.zeros((1, len(licences.TEMPLATES) + 1), np.float32), 0.0)
    assert even.read(["any", "words"])[0] == next(iter(licences.TEMPLATES))


def test_licences_in_the_corpus(middle):
    docs, _ = middle
    rows = licences.scan(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    marks = {"MIT License": "MIT", "Apache License": "Apache-2.0", "GNU General": "GPL-3.0", "CC BY-NC": "CC-BY-NC"}
    for r in rows:
        assert {f.family for f in r.found if f.confirmed} == {v for k, v in marks.items() if k in r.text}


def test_rare_toxic_labels_are_drawn_and_the_odds_put_right(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 200 == 0).cast("int").alias("toxic"))
    given = {r.toxic: r["count"] for r in labels.filter(toxicity.learnable(F.col("doc_id"))).groupBy("toxic").count().collect()}
    drawn, raised = toxicity._labelled(docs, labels, 500)
    found = {r.toxic: r["count"] for r in drawn.groupBy("toxic").count().collect()}
    assert found == {0: 450, 1: 50} and given[1] >= 50
    assert raised == pytest.approx(np.log(50 / 450) - np.log(given[1] / given[0]))
    # where classes are common each keeps its share, and all rows are taken where there are few
    half = labels.withColumn("toxic", (F.col("doc_id") % 4 == 0).cast("int"))
    assert abs(toxicity._labelled(docs, half, 400)[1]) < 0.05
    everything, raised = toxicity._labelled(docs, half, 10**6)
    assert raised == pytest.approx(0.0) and everything.count() == sum(given.values())
    assert toxicity._labelled(docs, labels.limit(0), 100)[0].count() == 0
