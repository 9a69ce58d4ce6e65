import os
import random
import subprocess
import sys
from collections import Counter

import pytest
from edge import documents, none

import __spark_entry__ as entry

from tellerflow.llm import substring


def plain(rows, width):
    split = [(doc, (text or "").encode().split()) for doc, text in rows]
    seen = Counter(tuple(w[k:k + width]) for _, w in split for k in range(len(w) - width + 1))
    out = []
    for doc, words in split:
        gone = set()
        for k in range(len(words) - width + 1):
            if seen[tuple(words[k:k + width])] > 1:
                gone.update(range(k, k + width))
        out.append((doc, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode() if gone else None))
    return sorted(out, key=str)


def found(frame):
    return sorted([tuple(r) for r in frame.collect()], key=str)


def corpus(seed):
    """Texts that share, repeat and nest passages, with few different words and with many."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    passages = [rng.choices(words, k=rng.randrange(10, 60)) for _ in range(12)] + [rng.choices(["a", "b"], k=50), ["x"] * 80]
    rows = []
    for doc in range(60):
        text = []
        for _ in range(rng.randrange(0, 6)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p))
            text += rng.choice([p, p[cut:], p[:cut], rng.choices(words, k=20), rng.choices(["a", "b"], k=30)])
        rows.append((doc, " ".join(text)))
    return rows + [(100, rows[0][1]), (101, rows[1][1].replace(" ", "\n")), (102, None), (103, ""), (102, "y " * 40)]


@pytest.mark.parametrize("seed,width,hot", [(1, 12, substring.HOT_WORDS), (2, 12, 0), (3, 35, 400), (4, 9, 60)])
def test_against_all_windows(spark, seed, width, hot):
    rows = corpus(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(substring.remove_repeats(frame, width, hot)) == plain(rows, width)


@pytest.mark.parametrize("hot", [substring.HOT_WORDS, 500])
def test_periodic_text(spark, monkeypatch, hot):
    """Runs longer than a piece, periods that divide it or not, a break within, copies and shifted copies."""
    monkeypatch.setattr(substring, "RUN_WINDOWS", 50)
    monkeypatch.setattr(substring, "SHARD_WORDS", 300)
    beat = lambda n, size: " ".join(f"p{n}x{k % n}" for k in range(size))
    rows = [(1, beat(7, 900)), (2, beat(20, 1100)), (3, beat(20, 130) + " stop " + beat(20, 400)), (4, beat(1, 300)),
            (5, "a b " + beat(7, 120)), (6, beat(11, 46)), (7, beat(11, 45) + " end"), (8, beat(13, 47)), (9, beat(28, 200)), (9, beat(28, 200))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(substring.remove_repeats(frame, 35, hot)) == plain(rows, 35)


MILLIONS = """
import resource, sys
import pyarrow as pa
from tellerflow.llm import substring
text = " ".join(["w%d" % k for k in range(20)] * 250_000)
batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([b"r"]), pa.array([text])], ["doc_id", "rid", "text"])
runs = [b.column(4).to_pylist()[0] for b in substring._first_pass(35)(iter([batch]))][0]
words = text.encode().split()
lines = {r["seg"]: b" ".join(words[r["start"]:r["start"] + r["len"] + 34]) for r in runs}
hits = substring.find_repeated(list(lines.values()), [1] * len(lines), 35)
print(len(runs), len(lines), sum(map(len, hits)), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
"""


def test_memory_of_five_million_periodic_words():
    done = subprocess.run([sys.executable, "-c", MILLIONS], capture_output=True, text=True, check=True, cwd=os.path.dirname(entry.__file__))
    runs, lines, hits, peak = map(int, done.stdout.split()[-4:])
    assert runs == 5000 and lines <= 2 and hits >= 1000 and peak < 1000, done.stdout


def test_edges(spark):
    docs = documents(spark, "rid", "runs", "key", "kept")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(substring.remove_repeats(docs, 12)) == plain(rows, 12)
    assert substring.remove_repeats(none(spark)).count() == 0


def test_automaton_counts():
    rng = random.Random(5)
    for _ in range(50):
        sequences = [bytes(" ".join(rng.choices("abc", k=rng.randrange(1, 25))), "ascii") for _ in range(6)]
        weights = [rng.randrange(1, 3) for _ in sequences]
        for width in (1, 3, 5):
            seen = Counter()
            for s, w in zip(sequences, weights):
                words = s.split()
                for k in range(len(words) - width + 1):
                    seen[tuple(words[k:k + width])] += w
            want = [[k for k in range(len(s.split()) - width + 1) if seen[tuple(s.split()[k:k + width])] > 1] for s in sequences]
            assert substring.find_repeated(sequences, weights, width) == want
