"""Toxicity of texts whose words may be disguised (leetspeak, spacing, repetition), as a noisy channel.

A disguised token is decoded: every character of it is a place in a lattice with the letters that it may stand for (or none),
each at a cost, and the Viterbi path with the least cost under a character language model is its restored word. Words and
restored words are scored by features (the word, its beginnings of 4 to 8 bytes, and whether a text has one, two or more
different words with a beginning) that labelled documents have shown to mark toxic ones; a text's score is a logistic function
of its strongest feature and of how many strong words it has."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import language_id, shared, words

U = np.uint64
#: Rows of labelled documents from which features are learned, about: a bounded sample, chosen by a hash of doc_id.
SAMPLE_ROWS = 8_000
#: Letters that other characters stand for. Fixed values.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h",
}
#: Characters that may stand between the letters of a spaced word.
BETWEEN = frozenset(".-_*~'`,:;/\\|+ ")
SWAP, DROP, REPEAT = 0.7, 0.4, 0.3  # costs in nats beside the model's
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: A token is decoded if it has letters and, between or next to them, something that may be a disguise.
DISGUISE = re.compile(r"[a-z][0-9@$!|+(€£¡*#.\-_~'`,:;/\\]+[a-z]|[0-9@$!|(€£¡]+[a-z]|[a-z][0-9@$!|(€£¡]+|([a-z])\1\1")
EDGE = re.compile(r"^[^\w@$!|(€£¡*#]+|[^\w@$!|€£¡]+$|(?<=\w)([$!|#*%&])\1+$")
SPACE_BYTES = words.SPACE
SIZES = (4, 5, 6, 7, 8)
#: A text has a feature at level n if n different words of it have the feature; the last level stands for more as well.
LEVELS = 3


class Letters:
    """A trigram model of letters; ^ begins and ends a word."""

    def __init__(self, counts: dict[str, int]):
        pairs: Counter = Counter()
        for g, n in counts.items():
            pairs[g[:2]] += n
        self.cost = {g: -math.log((n + 0.1) / (pairs[g[:2]] + 2.7)) for g, n in counts.items()}
        self.pairs = {p: -math.log(0.1 / (n + 2.7)) for p, n in pairs.items()}

    def of(self, two: str, c: str) -> float:
        return self.cost.get(two + c) or self.pairs.get(two, 3.3)

    def restore(self, token: str) -> str:
        """The letters on the best path through the token's lattice."""
        paths = {"^^": (0.0, "")}  # by the last two letters
        last = ""
        for c in token:
            options = [(c, 0.0)] if c in LETTERS or c.isalpha() else [(x, SWAP) for x in LEET.get(c, "")]
            if c in BETWEEN or not options:
                options.append(("", DROP))
            if c == last:
                options.append(("", REPEAT))
            after: dict[str, tuple[float, str]] = {}
            for two, (cost, out) in paths.items():
                for x, more in options:
                    to = two[1] + x if x else two
                    total = cost + more + (self.of(two, x) if x else 0.0)
                    if to not in after or total < after[to][0]:
                        after[to] = (total, out + x)
            paths, last = after, c
        return min((cost + self.of(two, "^"), out) for two, (cost, out) in paths.items())[1]


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word's features, and whether it has them: its beginnings of some bytes, and all of it."""
    longest, n = max(SIZES), len(starts)
    at = starts[:, None] + np.arange(longest)
    inside = at < ends[:, None]
    powers = np.multiply.accumulate(np.full(longest, U(0x9E3779B97F4A7C15)))
    sums = np.cumsum(np.where(inside, words._BYTE[data[np.minimum(at, max(len(data) - 1, 0))]] * powers, U(0)), 1, dtype=np.uint64) if n else np.zeros((0, longest), np.uint64)
    length = ends - starts
    out = [words.mix(sums[:, k - 1] + U(k)) for k in SIZES] + [words.mix(hashes + U(64))]
    has = [length >= k for k in SIZES] + [length >= 3]
    return np.stack(out, 1), np.stack(has, 1)


def disguised(texts: list[str]) -> list[list[str]]:
    """For each text its tokens that may be disguised words, without the marks around them, and runs of single characters
    (three or more) put together."""
    out = []
    for text in texts:
        found = ["".join(run.split()) for run in SINGLES.findall(text)]
        for t in set(text.split()):
            if t.isalpha():
                if TRIPLE.search(t):
                    found.append(t.lower())
            elif not t.strip(".,;:?\"'").isalpha():
                core = EDGE.sub("", t).lower()
                if not core.isalpha() and DISGUISE.search(core):
                    found.append(core)
        out.append([f.lower() for f in found if any(c.isalpha() for c in f)])
    return out


TRIPLE = re.compile(r"([^\W\d_])\1\1")
SINGLES = re.compile(r"(?<!\S)\S(?:\s+\S(?!\S)){2,}")


class Restorer:
    """Restores each distinct token once a worker."""

    def __init__(self, letters: Letters):
        self.letters, self.known = letters, {}

    def words(self, texts: list[str]) -> list[str]:
        """A text of restored words for each text."""
        if len(self.known) > 200_000:
            self.known.clear()
        out = []
        for found in disguised(texts):
            for t in found:
                if t not in self.known:
                    self.known[t] = self.letters.restore(t)
            out.append(" ".join(self.known[t] for t in found))
        return out


def _unique(texts: pa.Array, restorer: Restorer) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of the distinct words of texts and of their restored words (hashes, presence), and the distinct pairs of a
    text and a word."""
    restored = pa.array(restorer.words(texts.to_pylist()), pa.string())
    parts, at = [], 0
    for column in (pc.utf8_lower(texts), restored):
        w = words.split(column, space=language_id.NO_LETTER)
        of = np.repeat(np.arange(len(column)), np.diff(w.first))
        parts.append((w.data, w.starts + at, w.ends + at, w.hashes, of))
        at += len(w.data)
    data, starts, ends, keys, of = (np.concatenate([p[i] for p in parts]) for i in range(5))
    keys, first, back = np.unique(keys, return_index=True, return_inverse=True)
    pairs = np.unique(of * max(len(first), 1) + back)
    hashes, has = _features(data, starts[first], ends[first], keys)
    return hashes, has, pairs // max(len(first), 1), pairs % max(len(first), 1)


def _levels(text: np.ndarray, feature: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of a text and a feature (a number) of one of its words: the distinct ones, as text, feature and level, and
    which of them each pair is."""
    got, back, count = np.unique(text * max(n_features, 1) + feature, return_inverse=True, return_counts=True)
    return got // max(n_features, 1), got % max(n_features, 1), np.minimum(count, LEVELS), back


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three letters in a row, over the plain words of texts: words of a-z, with marks around them or without."""
    size = len(LETTERS) + 1
    counts = np.zeros(size**3, np.int64)
    letter = np.zeros(256, np.uint8)
    letter[[*map(ord, LETTERS)]] = np.arange(1, size)
    around = np.zeros(256, bool)
    around[[*b".,;:?!\"'"]] = True
    for _, texts in shared.chunks(batches, "text"):
        data, bounds = words.raw(pc.utf8_lower(texts))
        starts, ends = words.runs(data, bounds)
        if not len(starts):
            continue
        code = letter[data]
        at = np.flatnonzero(code)
        total = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
        before, fit = total(code > 0), total((code > 0) | around[data])
        first, last = before[starts], before[ends]  # letters of each word, by number
        n = last - first
        plain = (n > 0) & (fit[ends] - fit[starts] == ends - starts)
        plain[plain] = at[last[plain] - 1] - at[first[plain]] + 1 == n[plain]  # no mark between letters
        first, n = first[plain], n[plain]
        heads = np.cumsum(n + 3) - (n + 3)
        line = np.zeros(int((n + 3).sum()), np.int64)  # two edges, the letters, an edge, for each word
        inside = np.repeat(heads + 2, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        line[inside] = code[at[np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]]
        triple = np.ones(len(line), bool)
        triple[heads], triple[heads + 1] = False, False  # these would reach into the word before
        to = np.flatnonzero(triple)
        counts += np.bincount((line[to - 2] * size + line[to - 1]) * size + line[to], minlength=size**3)
    some = np.flatnonzero(counts)
    shown = "^" + LETTERS
    names = [shown[g // size**2] + shown[g // size % size] + shown[g % size] for g in some.tolist()]
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts[some])], names=["g", "n"])


def _marks(letters: Letters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(letters)
        for part, texts in shared.chunks(batches, "text"):
            toxic = np.array(part.column("toxic").to_pylist(), np.int64)
            hashes, has, text, word = _unique(texts, restorer)
            if not len(word):
                continue
            known, number = np.unique(hashes, return_inverse=True)
            number, keep = number.reshape(hashes.shape)[word], has[word]
            of, feature, level, _ = _levels(np.broadcast_to(text[:, None], keep.shape)[keep], number[keep], len(known))
            for n in range(1, LEVELS + 1):
                some = level >= n
                t, all_of = np.bincount(feature[some], toxic[of[some]], len(known)).astype(np.int64), np.bincount(feature[some], minlength=len(known))
                at = np.flatnonzero(all_of)
                yield pa.RecordBatch.from_arrays([pa.array(known[at].view(np.int64)), pa.array(np.full(len(at), n, np.int32)), pa.array(t[at]), pa.array(all_of[at])], names=["f", "level", "t", "n"])

    return run


class Model:
    """weights: a row for each of the sorted features, a column for each level; a level has the weights of those below."""

    def __init__(self, letters: Letters, features: np.ndarray, levels: np.ndarray, weights: np.ndarray, line: tuple[float, float, float] = (-6.0, 1.0, 0.5)):
        self.letters, self.line = letters, line
        self.features, back = np.unique(features, return_inverse=True)
        self.weights = np.zeros((len(self.features), LEVELS))
        self.weights[back, levels - 1] = weights
        self.weights = np.maximum.accumulate(self.weights, 1)

    def evidence(self, texts: pa.Array, restorer: Restorer) -> np.ndarray:
        """For each text the weight of its strongest feature and the logarithm of the number of its strong words."""
        hashes, has, text, word = _unique(texts, restorer)
        out = np.zeros((len(texts), 2))
        if not len(word) or not len(self.features):
            return out
        at = np.minimum(np.searchsorted(self.features, hashes), len(self.features) - 1)
        has = has & (self.features[at] == hashes)
        some = has.any(1)[word]
        text, word = text[some], word[some]
        keep = has[word]
        pair = np.broadcast_to(np.arange(len(word))[:, None], keep.shape)[keep]
        of, feature, level, back = _levels(text[pair], at[word][keep], len(self.features))
        weight = self.weights[feature, level - 1]
        np.maximum.at(out[:, 0], of, weight)
        strong = np.unique(pair[weight[back] > STRONG])
        out[:, 1] = np.log1p(np.bincount(text[strong], minlength=len(texts)))
        return out


#: Weight from which a word counts as strong; rare features have small weights, since 3 unseen clean texts count against each.
STRONG = 3.0


def _evidence(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.letters)
        for part, texts in shared.chunks(batches, "text"):
            e = model.evidence(texts, restorer)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(e[:, 0]), pa.array(e[:, 1])], names=["doc_id", "toxic", "top", "many"])

    return run


def learn(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic (0 or 1). The model of letters is counted over all docs, with labels or
    not. Weights come from one half of the sample of labelled rows and the logistic line from the other, so that it sees
    features as new texts show them."""
    shared.bounded_batches(docs.sparkSession)
    some = language_id.sampled(labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most about sample_rows small rows
    half = F.expr("pmod(xxhash64(doc_id, 'half'), 4) > 0")
    counts = docs.select("text").mapInArrow(_trigrams, "g string, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()
    letters = Letters({g: n for g, n in counts})
    totals = dict(rows.where(half).groupBy("toxic").count().collect())
    bad, good = totals.get(1, 0), totals.get(0, 0)
    seen = rows.where(half).select("doc_id", "text", "toxic").mapInArrow(_marks(letters), "f long, level int, t long, n long").groupBy("f", "level").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    weight = F.log((F.col("t") + 0.5) / (bad + 1)) - F.log((F.col("n") - F.col("t") + 3) / (good + 3))
    best = seen.where("t >= 3").select("f", "level", weight.alias("w")).where("w >= 1").toPandas()  # of the sample's words
    model = Model(letters, best["f"].to_numpy(np.int64).view(np.uint64), best["level"].to_numpy(int), best["w"].to_numpy(float))
    # rows alike in evidence, to a hundredth, are one row with a count, however many there are
    shown = rows.where(~half).select("doc_id", "toxic", "text").mapInArrow(_evidence(model), "doc_id long, toxic int, top double, many double")
    rest = shown.groupBy("toxic", F.round("top", 2).alias("top"), F.round("many", 2).alias("many")).agg(F.count("*").alias("n")).toPandas().sort_values(["toxic", "top", "many"])
    if rest["toxic"].nunique() == 2:
        x = np.column_stack([np.ones(len(rest)), rest["top"], rest["many"]])
        y, n, line = rest["toxic"].to_numpy(float), rest["n"].to_numpy(float), np.zeros(3)
        for _ in range(30):  # Newton's method with a little ridge
            p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
            h = (x * (n * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
            line = line + np.linalg.solve(h, x.T @ (n * (y - p)) - 0.05 * line)
        model.line = tuple(line)
    return model


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.letters)
        a, b, c = model.line
        for part, texts in shared.chunks(batches, "text"):
            e = model.evidence(texts, restorer)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(a + b * e[:, 0] + c * e[:, 1], -30, 30))))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row. Defined results: null, empty and wordless texts have the score of a text
    without evidence; a null doc_id stays null; repeated rows stay; an empty table gives no rows; a model learned without
    labels of both kinds finds no evidence anywhere; other columns are ignored; texts are read whole."""
    shared.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_scores(model), "doc_id long, score double")
