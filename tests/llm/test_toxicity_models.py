"""The lattice against all its paths, features by levels against counting, and tables that repeat."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from palimpsest.llm import toxicity


def all_paths(letters, token):
    """(cost, restored) of every path through the lattice of a token, by its definition."""
    options, last = [], ""
    for c in token:
        some = [(c, 0.0)] if c.isalpha() else [(x, toxicity.SWAP) for x in toxicity.LEET.get(c, "")]
        if c in toxicity.BETWEEN or not some:
            some.append(("", toxicity.DROP))
        if c == last:
            some.append(("", toxicity.REPEAT))
        options.append(some)
        last = c
    for path in itertools.product(*options):
        word = "".join(x for x, _ in path)
        cost, two = sum(c for _, c in path), "^^"
        for x in [*word, "^"]:
            cost, two = cost + letters.of(two, x), two[1] + x
        yield cost, word


def test_the_restored_word_is_the_cheapest_path():
    rng = random.Random(2)
    for _ in range(60):
        lexicon = ["".join(rng.choices("abest", k=rng.randrange(3, 7))) for _ in range(12)]
        letters = toxicity.Letters(Counter(g for w in lexicon for g in (f"^^{w}^"[i : i + 3] for i in range(len(w) + 1))))
        word = rng.choice(lexicon)
        token = "".join(rng.choice([c, c, c + c, {"a": "@", "b": "8", "e": "3", "s": "$", "t": "7"}[c], c + ".", c + "*"]) for c in word)[:9]
        costs = {}
        for cost, restored in all_paths(letters, token):
            costs[restored] = min(cost, costs.get(restored, math.inf))
        assert costs[letters.restore(token)] <= min(costs.values()) + 1e-9


def test_levels_equal_counting():
    rng = random.Random(3)
    letters = toxicity.Letters({})
    vocabulary = ["".join(rng.choices("ab", k=rng.randrange(1, 12))) for _ in range(40)] + ["x" * 40, "x" * 41]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(20))) for _ in range(30)]
    part = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array(texts), pa.array([i % 2 for i in range(30)])], names=["doc_id", "text", "toxic"])
    got: Counter = Counter()
    for b in toxicity._marks(letters)(iter([part])):
        for r in b.to_pylist():
            got[r["level"], r["t"], r["n"]] += 1
    want: dict = {}
    for i, t in enumerate(texts):
        plain = set(t.split())
        for w in list(plain):  # a run of one letter is restored as well
            if toxicity.TRIPLE.search(w):
                plain.add(letters.restore(w))
        by: Counter = Counter()
        for w in plain:
            by.update([("all", w)] if len(w) >= 3 else [])
            by.update((k, w[:k]) for k in toxicity.SIZES if len(w) >= k)
        for f, n in by.items():
            for level in range(1, min(n, toxicity.LEVELS) + 1):
                t_n = want.setdefault((f, level), [0, 0])
                t_n[0] += i % 2
                t_n[1] += 1
    assert got == Counter((level, t, n) for (_, level), (t, n) in want.items())


def test_families_of_words_and_repeated_ids(spark):
    rng = random.Random(9)
    stems, ends = ["alo", "ben", "cur", "dam", "esk", "fol"], ["a", "en", "ti", "sor", "mul", "gan", "pet", "rix"]
    rows, labels = [], []
    for i in range(900):
        ws = [rng.choice(stems) + rng.choice(ends) + rng.choice(ends) for _ in range(40)]
        if i % 6 == 0:  # toxic texts have several words of a family, clean ones have one now and then
            ws[:3] = ["grobel" + x for x in rng.sample(ends, 3)]
        elif i % 9 == 0:
            ws[0] = "grobel" + rng.choice(ends)
        rng.shuffle(ws)
        rows.append((i, " ".join(ws)))
        labels += [(i, int(i % 6 == 0))] * (1 + i % 3)
    docs, marks = spark.createDataFrame([*rows, *rows[:50]], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, marks)
    asked = [("alosor grobelti benpet grobelrix curgan", True), ("alosor grobelti benpet curgan", False), ("alosor grobelti grobelti grobelti grobelti", False), ("grobelsor grobela grobelpet", True)]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(asked)], "doc_id long, text string"), model).collect()}
    assert [got[i] >= 0.3 for i in range(len(asked))] == [x for _, x in asked]
    none = toxicity.score(docs.where(F.lit(False)), model)
    assert none.count() == 0 and np.isfinite(model.line).all()
