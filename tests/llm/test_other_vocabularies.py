"""Token files with vocabularies whose pieces cross white space, and maximal repeats against their definition."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from palimpsest.llm import quality_rules, shared, token_output

TEXTS = ["Hello  World", None, "", " a\n\nb ", "it's WE'LL 123", "Ünï <|endoftext|> x", "word " * 50]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(spark, name):
    path = public_tokenizers.path(name)
    hf = Tokenizer.from_file(path)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = token_output.read(token_output.write(docs, shared.shared_dir(spark), path, end_id=7)).collect()
    got = {r["doc_id"]: np.frombuffer(r["ids_le"], "<u4").tolist() for r in rows}
    assert got == {i: [*hf.encode(t or "", add_special_tokens=False).ids, 7] for i, t in enumerate(TEXTS)}


def test_maximal_repeats_equal_their_definition(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices("ab", k=rng.randrange(2, 26))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_maximal"] for r in quality_rules.judge(docs, least_repeat=2).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        n, found = len(w), 0
        for length in range(2, n):
            places: dict = {}
            for a in range(n - length + 1):
                places.setdefault(tuple(w[a : a + length]), []).append(a)
            for at in places.values():  # twice or more, and no longer one stands at all of these places
                if len(at) > 1:
                    left = {w[a - 1] if a else a - 1 for a in at}
                    right = {w[a + length] if a + length < n else n for a in at}
                    found += len(left) > 1 and len(right) > 1
        assert got[i] == found, t


@pytest.mark.parametrize(("repeat", "kept"), [(0, True), (30, True), (120, False)])
def test_kept_follows_the_longest_repeat(spark, repeat, kept):
    rng = random.Random(10)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    part = [word() for _ in range(repeat)]
    text = " ".join([*(word() for _ in range(400)), *part, *(word() for _ in range(20)), *part])
    row = quality_rules.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["longest_repeat"] == repeat and row["kept"] == (kept and not row["base_failed"]) and (repeat != 30 or row["kept"])
