"""Language identification of texts that may mix languages.

Each language has a Markov model of bytes (four-grams over their first three bytes, in hashed tables) learned from labelled
rows. A text is taken as a mixture: every word comes from one language of a set, in unknown proportions, which expectation
maximisation estimates from the words' likelihoods. Sets of the 1, 2, ... most likely languages, up to all of them, are
compared by their likelihood less a penalty for each language (as the Bayesian information criterion has it)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import shared, words

U = np.uint64
BUCKETS = 1 << 16
#: Rows of labelled documents from which models are learned, about: a bounded sample, chosen by a hash of doc_id.
SAMPLE_ROWS = 20_000
#: Words are runs of ASCII letters and of bytes of other characters.
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z and the Latin-1 capitals as small letters."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    after = np.concatenate([[False], data[:-1] == 0xC3])
    out[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    return out


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every byte of each word and a space after it: the table's row for it behind the three bytes before (spaces
    before a word), for those three alone, and the word."""
    lengths = ends - starts + 1
    heads = np.cumsum(lengths) - lengths
    narrow = np.int32 if len(data) + int(lengths.sum()) < 1 << 31 else np.int64
    of = np.repeat(np.arange(len(starts), dtype=narrow), lengths)
    place = np.arange(len(of), dtype=narrow) - np.repeat(heads.astype(narrow), lengths)
    at = np.repeat(starts.astype(narrow), lengths)
    at += place
    body = data[np.minimum(at, len(data) - 1)]
    body[heads + lengths - 1] = 32
    del at
    context = np.zeros(len(of), np.uint32)
    for back in (3, 2, 1):
        earlier = np.full(len(of), 32, np.uint8)
        earlier[back:] = np.where(place[back:] >= back, body[:-back], np.uint8(32))
        context = (context << np.uint32(8)) | earlier
    context = context.astype(np.uint64)
    mask = U(BUCKETS - 1)
    return (words.mix(context * U(256) + body + U(1 << 40)) & mask).astype(np.int32), (words.mix(context) & mask).astype(np.int32), of


def _distinct(texts: pa.Array):
    """The texts' words and each distinct one's first place and where each word stands among the distinct."""
    w = words.split(texts, space=NO_LETTER)
    w.data = lower(w.data)
    _, first, back = np.unique(w.hashes, return_index=True, return_inverse=True)
    return w, first, back


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables: dict[str, np.ndarray] = {}
    for part, texts in shared.chunks(batches, "text"):
        langs = np.array(part.column("lang").to_pylist(), object)
        w, first, back = _distinct(texts)
        of_text = np.repeat(np.arange(len(langs)), np.diff(w.first))
        for lang in set(langs.tolist()):
            table = tables.setdefault(lang, np.zeros((2, BUCKETS), np.int64))
            count = np.bincount(back[langs[of_text] == lang], minlength=len(first)).astype(np.int64)
            some = np.flatnonzero(count)
            four, three, of = _grams(w.data, w.starts[first[some]], w.ends[first[some]])
            table[0] += np.bincount(four, count[some][of], BUCKETS).astype(np.int64)
            table[1] += np.bincount(three, count[some][of], BUCKETS).astype(np.int64)
    for lang, table in tables.items():
        for kind in (0, 1):
            at = np.flatnonzero(table[kind])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), kind), pa.int32()), pa.array(at), pa.array(table[kind][at])], names=["lang", "kind", "bucket", "n"])


def sampled(rows: DataFrame, most: int, doc_id: str = "doc_id") -> DataFrame:
    """About so many rows at most, chosen by a hash of doc_id; all where there are fewer."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.expr(f"pmod(xxhash64({doc_id}, 'sample'), 1000000007) < {int(most / n * 1000000007)}"))


class Models:
    """langs and log[kind gram]: a byte's log-probability in each language; own: what a byte of a language's own text has on
    average, where each place is left out of the counts that it is judged by."""

    def __init__(self, langs: list[str], tables: np.ndarray, smooth: float = 0.5):
        self.langs = langs
        self.four = np.log(tables[:, 0] + smooth / 64).T.astype(np.float32)
        self.three = np.log(tables[:, 1] + smooth).T.astype(np.float32)
        four, three = (np.where(tables[:, i] > 0, tables[:, i] * np.log(np.maximum(tables[:, i] - 1, 0) + s), 0.0).sum(1) for i, s in ((0, smooth / 64), (1, smooth)))
        self.own = (four - three) / np.maximum(tables[:, 0].sum(1), 1)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not self.langs:
            return np.zeros((len(starts), 0))
        four, three, of = _grams(data, starts, ends)
        each = self.four[four] - self.three[three]
        return np.stack([np.bincount(of, each[:, k], len(starts)) for k in range(len(self.langs))], 1)


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Models:
    """docs: doc_id, text, lang; rows without lang teach nothing."""
    shared.bounded_batches(docs.sparkSession)
    rows = sampled(docs.where("lang is not null").select("doc_id", "text", "lang"), sample_rows)
    got = rows.mapInArrow(_counts, "lang string, kind int, bucket long, n long").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique().tolist())  # at most two tables of BUCKETS rows a language
    tables = np.zeros((len(langs), 2, BUCKETS))
    tables[got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), got["kind"].to_numpy(int), got["bucket"].to_numpy(int)] = got["n"].to_numpy(float)
    return Models(langs, tables)


def mixtures(likely: np.ndarray, first: np.ndarray, rounds: int = 8, penalty: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the languages in each text and whether each language is in its set. likely: log-likelihoods of the
    words of all texts; first: bounds of the texts' words; texts without words have no language."""
    n, k = len(first) - 1, likely.shape[1]
    counts = np.diff(first)
    some = np.flatnonzero(counts)
    best, chosen = np.zeros((n, k)), np.zeros((n, k), bool)
    if not len(some) or not k:
        return best, chosen
    given = np.exp(likely - likely.max(1, keepdims=True))  # up to a factor for each word
    m = counts[some].astype(float)
    value = np.full(len(some), -np.inf)
    of = np.repeat(np.arange(len(some)), counts[some])

    def fit(at: np.ndarray, allowed: np.ndarray, rounds: int = rounds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shares of the allowed languages in the texts at, their log-likelihoods, and what no shares can exceed."""
        mine = given if len(at) == len(some) else given[np.isin(of, at)]
        n_words = counts[some][at]
        heads, text = np.cumsum(n_words) - n_words, np.repeat(np.arange(len(at)), n_words)
        share = allowed / allowed.sum(1, keepdims=True)
        for _ in range(rounds):
            joint = mine * share[text]
            share = np.add.reduceat(joint / (joint.sum(1, keepdims=True) + 1e-300), heads, 0) / n_words[:, None]
        total = (mine * share[text]).sum(1) + 1e-300
        fitted = np.add.reduceat(np.log(total), heads)
        slope = np.add.reduceat(mine / total[:, None], heads, 0)  # the likelihood is concave: it stays under its tangent
        return share, fitted, np.minimum(fitted + slope.max(1) - (slope * share).sum(1), 0.0)

    at = np.arange(len(some))
    everything, _, most = fit(at, np.ones((len(some), k)))
    rank = np.argsort(np.argsort(-everything, 1, kind="stable"), 1, kind="stable")
    for size in range(1, k + 1):
        at = np.flatnonzero(most + 1e-6 - penalty * (size - 1) * np.log(m + 1) > value)  # elsewhere no larger set can win
        if not len(at):
            break
        allowed = (rank[at] < size).astype(float)
        share, fitted, _ = fit(at, allowed, rounds if size > 1 else 0)
        score = fitted - penalty * (size - 1) * np.log(m[at] + 1)
        better = score > value[at]
        value[at[better]] = score[better]
        best[some[at[better]]], chosen[some[at[better]]] = share[better], allowed[better] > 0
    return best, chosen


def _fit(models: Models, w: words.Words, likely: np.ndarray, share: np.ndarray) -> np.ndarray:
    """For each text the mean log-likelihood of a byte under its mixture, less what its languages' own texts have. Runs of
    letters next to a digit (keys, numbers) count only in texts that have no others."""
    n = len(w.first) - 1
    of = np.repeat(np.arange(n), np.diff(w.first))
    top = likely.max(1, initial=-np.inf)
    each = top + np.log((np.exp(likely - top[:, None]) * share[of]).sum(1) + 1e-300)
    digit = np.concatenate([(w.data >= 48) & (w.data <= 57), [False]])
    plain = ~(digit[w.starts - 1] & (w.starts > w.texts[of])) & ~(digit[w.ends] & (w.ends < w.texts[of + 1]))
    counted = plain | ~(np.bincount(of, plain, n) > 0)[of]
    return np.bincount(of, each * counted, n) / np.maximum(np.bincount(of, (w.ends - w.starts + 1) * counted, n), 1) - share @ models.own


def _run(models: Models, fit: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*models.langs, "und"], object)
        for part, texts in shared.chunks(batches, "text"):
            w, first, back = _distinct(texts)
            likely = models.words(w.data, w.starts[first], w.ends[first])[back] if len(first) else np.zeros((0, len(models.langs)))
            share, chosen = mixtures(likely, w.first)
            ascii_letters = ~NO_LETTER[:128]
            flags = np.concatenate([[0], np.cumsum((w.data < 128) & ascii_letters[w.data & 127])])
            letters = flags[w.texts[1:]] > flags[w.texts[:-1]]
            for i in np.flatnonzero(~letters):
                letters[i] = any(c.isalpha() for c in texts[int(i)].as_py())
            letters &= chosen.any(1)
            pick = np.where(letters, share.argmax(1) if share.shape[1] else 0, len(models.langs))
            score = np.where(letters, share.max(1) if share.shape[1] else 0.0, 0.0)
            mix = [[{"lang": models.langs[k], "share": float(share[i, k])} for k in np.flatnonzero(chosen[i])] if letters[i] else [] for i in range(len(letters))]
            mixture = pa.array(mix, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))
            fits = [pa.array(np.where(letters, _fit(models, w, likely, share), 0.0))] if fit else []
            told = [part.column(0), pa.array(names[pick], pa.string()), pa.array(np.clip(score, 0, 1)), mixture, *fits, *part.columns[2:]]
            yield pa.RecordBatch.from_arrays(told, names=["doc_id", "lang_pred", "score", "mixture", *(["fit"] if fit else []), *part.schema.names[2:]])

    return run


OUTPUT = "doc_id long, lang_pred string, score double, mixture array<struct<lang: string, share: double>>"


def predict(docs: DataFrame, models: Models, *, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), fit: bool = False) -> DataFrame:
    """doc_id, lang_pred (the language with the largest share, und without letters), score (its share), mixture (the chosen
    languages and their shares) and the columns carry of every row. Defined results: null, empty and letterless texts are
    und with score 0 and no mixture, as is every text where nothing was learned; equal shares go to the first language by
    name; a null doc_id stays null; repeated rows stay; an empty table gives no rows; other columns are ignored, and so is
    one to carry whose name an output has; texts are read whole. With fit there is a column fit: by how much a byte is likelier
    (in nats, on average) than in the learned texts of the mixture's languages; und has 0."""
    shared.bounded_batches(docs.sparkSession)
    told = ["doc_id", "lang_pred", "score", "mixture", *(["fit"] if fit else [])]
    carried = [c for c in carry if c not in told]
    renamed = {c: f"c{i}" for i, c in enumerate(carried)}  # text may be carried too
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *(F.col(c).alias(n) for c, n in renamed.items()))
    schema = ", ".join([OUTPUT, *(["fit double"] if fit else []), *(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in renamed.items())])
    return rows.mapInArrow(_run(models, fit), schema).select(*told, *(F.col(n).alias(c) for c, n in renamed.items()))
