import random
import re

import pytest
from edge import documents, none

from tellerflow.llm import decontaminate
from tellerflow.sources.tables import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def plain(docs, items, width=10):
    windows = []
    for item, text in items:
        words = WORD.findall(lower(text))
        windows += [(item, words[k:k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    out = []
    for doc, text in docs:
        words, hit, names = WORD.findall(lower(text)), set(), set()
        for item, window in windows:
            for k in range(len(words) - len(window) + 1):
                if words[k] == window[0] and words[k:k + len(window)] == window:
                    hit.update(range(k, k + len(window)))
                    names.add(str(item))
        out.append((doc, len(words), len(hit), sorted(names)))
    return sorted(out, key=str)


def found(frame):
    return sorted([(r.doc_id, r.found.n_words, len(r.found.hits), list(r.found.items)) for r in frame.collect()], key=str)


def pairs(frame):
    return [tuple(r) for r in frame.collect()]


@pytest.mark.parametrize("words", [100_000, 60])
def test_against_plain_search(spark, sf_dir, words):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").limit(80)
    bench = table(spark, sf_dir, "benchmark")
    seen = decontaminate.scanner(bench, automaton_words=words)
    got = docs.select("doc_id", seen(docs.text).alias("found"))
    assert found(got) == plain(pairs(docs), pairs(bench.select("item_id", "text")))


def test_short_items_offsets_and_edges(spark):
    bench = spark.createDataFrame(
        [(1, "Quick BROWN"), (1, "quick brown"), (2, ""), (3, None), (None, "lazy"), (10, "ünïcödé 日本語"), (9, "brown fox")],
        "item_id long, text string")
    docs = documents(spark, "found", "items")
    got = decontaminate.contamination(docs, bench)
    rows = {r.doc_id: r.found for r in got.collect()}
    assert sorted(rows[1]["items"]) == ["1", "9"]
    text = docs.filter("doc_id = 1").first().text
    assert [text[h.start:h.end] for h in rows[1]["hits"]] == ["quick", "brown", "fox", "lazy"]
    assert rows[2].n_words == 0 and rows[4].n_words == 0 and not rows[3]["hits"]
    assert rows[8]["items"] == []  # an accented capital isn't an ASCII one
    assert rows[6].n_words > 30_000
    assert got.count() == docs.count()
    assert decontaminate.contamination(none(spark), bench).count() == 0
    assert {len(r.found.hits) for r in decontaminate.contamination(docs, bench.limit(0)).collect()} == {0}


def test_windows_from_blocks_and_contexts():
    """Small alphabets, so that blocks, contexts and repeats meet in every way."""
    rng = random.Random(9)
    for width in (1, 2, 3, 7, 10):
        for _ in range(60):
            text = lambda n: " ".join(rng.choice("abc" if rng.random() < 0.8 else "d") for _ in range(rng.randint(0, n)))  # noqa: B023, E731
            items = [(i, text(30)) for i in range(4)] + [(None, text(4 * width)), (9, "a " * 25)]
            matcher = decontaminate.Matcher([(None if i is None else str(i), t.encode()) for i, t in items], width)
            for body in (text(80), " ".join([text(9), items[0][1], text(9), items[1][1][:20]]), "a " * 60):
                got = decontaminate.scan_text(body.encode(), matcher)
                _, n, hits, names = plain([(0, body)], items, width)[0]
                assert (got["n_words"], len(got["hits"]), got["items"]) == (n, hits, [x for x in names if x != "None"])


def test_a_large_benchmark_is_one_automaton_read_once(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(1000))) for i in range(300)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = items[7][1].split()
    docs = spark.createDataFrame([(1, "x y z " + " ".join(words[100:115]) + " tail"), (2, " ".join(words[:9])), (3, items[250][1])], "doc_id long, text string")
    assert len(decontaminate._blocks(spark, bench, decontaminate.AUTOMATON_WORDS)) == 1
    text = decontaminate.contamination(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert text.count("[apply(text") == 1
    got = decontaminate.contamination(docs, bench).collect()
    assert {r.doc_id: (len(r.found.hits), list(r.found["items"])) for r in got} == {1: (15, ["7"]), 2: (0, []), 3: (1000, ["250"])}


def test_a_worker_builds_its_automaton_once():
    from tellerflow.llm.common import per_worker

    made = []
    for _ in range(3):
        per_worker("test", lambda: made.append(1) or made)
    assert made == [1]
