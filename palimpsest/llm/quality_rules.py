"""Quality rules on words, symbols and lines, and a suffix-array measure of repetition.

The words of a text form a suffix array (prefix doubling; suffixes that are already alone are left out of later rounds).
Runs of neighbouring suffixes with a common prefix of l words are its longest-common-prefix intervals; an interval that
can't be extended to the left either is a maximal repeated substring. Every occurrence of a repeat lies in the longest
prefix that its suffix shares with a neighbour, so the union of those prefixes is the union of all maximal repeats' spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import shared, words

U = np.uint64
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_LINE = np.zeros(256, bool)
_LINE[10] = True
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, covered_words long, longest_repeat long, n_maximal long, spans array<struct<start: long, stop: long>>"
)


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _owner(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each key: the number of smaller ones, and the order."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(len(keys)), 0))
    return rank, order


def repeats(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For several sequences laid end to end (bounds: first): suffix order, the common prefix of each suffix in it with the
    one before (0 across sequences), start and stop of all sequences' suffixes' owners. symbols: 64-bit hashes."""
    n = len(symbols)
    owner = _owner(first)
    stop = first[1:][owner]
    rank, order = _dense(words.mix(symbols) + owner.astype(np.uint64) * U(0x9E3779B97F4A7C15))
    levels, k = [rank.astype(np.int32)], 1
    while True:
        ordered = rank[order]
        same = np.concatenate([ordered[1:] == ordered[:-1], [False]])
        tied = np.flatnonzero(same | np.concatenate([[False], same[:-1]]))  # places in the order
        if not len(tied):
            break
        at = order[tied]
        after = np.where(at + k < stop[at], rank[np.minimum(at + k, n - 1)] + 1, 0)
        resort = np.lexsort((after, ordered[tied]))
        at, after, was = at[resort], after[resort], ordered[tied][resort]
        order = order.copy()
        order[tied] = at
        new_group = np.concatenate([[True], was[1:] != was[:-1]])
        head = new_group | np.concatenate([[True], after[1:] != after[:-1]])
        rank = rank.copy()
        rank[at] = tied[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        levels.append(rank.astype(np.int32))
        k *= 2
    i, j = order[:-1], order[1:]
    common = np.zeros(n, np.int64)
    live = np.flatnonzero(levels[0][i] == levels[0][j]) if n > 1 else np.zeros(0, np.int64)
    got = np.zeros(len(live), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = i[live] + got, j[live] + got
        fits = (a < stop[i[live]]) & (b < stop[j[live]])
        got += np.where(fits & (levels[level][np.minimum(a, n - 1)] == levels[level][np.minimum(b, n - 1)]), 1 << level, 0)
    common[live + 1] = got
    return order, common, owner, stop


def maximal_count(order: np.ndarray, common: np.ndarray, symbols: np.ndarray, first: np.ndarray, owner: np.ndarray, least: int) -> np.ndarray:
    """How many maximal repeats of least symbols or more each sequence has: intervals whose suffixes have different
    symbols before them (or start a sequence)."""
    out = np.zeros(len(first) - 1, np.int64)
    at = np.flatnonzero(common >= least)
    if not len(at):
        return out
    starts = np.zeros(len(symbols), bool)
    starts[first[:-1][first[:-1] < len(symbols)]] = True
    left = np.where(starts[order], U(0), words.mix(symbols[order - 1]) | U(1))
    runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
    for run in runs:  # a stack of open intervals: [length, left symbol or None if they differ]
        base = int(run[0]) - 1
        stack: list[list] = []
        lefts, lengths = left[base : base + len(run) + 1].tolist(), common[base + 1 : base + len(run) + 1].tolist() + [0]
        found = 0
        for x, length in zip(lefts, lengths, strict=True):
            seen = x if x else None
            while stack and stack[-1][0] > length:
                top = stack.pop()
                seen = seen if top[1] == seen else None
                found += seen is None
            if stack and stack[-1][0] == length:
                stack[-1][1] = stack[-1][1] if stack[-1][1] == seen else None
            elif length:
                stack.append([length, seen])
        out[owner[order[base]]] += found
    return out


def _run(least: int, most_covered: float, longest: int, longest_part: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in shared.chunks(batches, "text", 2 << 20):
            w = words.split(texts)
            data, n = w.data, np.diff(w.first)
            inside = ~words.SPACE[data]
            word_chars = _per_text(inside & ((data & 0xC0) != 0x80), w.texts)
            symbols = _per_text(_SYMBOL[data], w.texts)
            # lines with a word, told apart within each text
            lines = words.split(texts, space=_LINE)
            has = np.concatenate([[0], np.cumsum(inside)])
            full = has[lines.ends] > has[lines.starts]
            owner = _owner(lines.first)[full]
            of = np.unique(words.mix(lines.hashes[full]) + owner.astype(np.uint64) * U(0x9E3779B97F4A7C15), return_index=True)[1]
            dups = np.bincount(owner, minlength=len(n)) - np.bincount(owner[of], minlength=len(n))
            # 8-word windows that a text has twice or more
            total = len(w.hashes)
            cover = np.zeros(total + 1, np.int64)
            owner = _owner(w.first)
            if total >= 8:
                at = np.flatnonzero(owner[7:] == owner[:-7])
                keys = words.mix(words.grams(w.hashes, 8)[at]) + owner[at].astype(np.uint64) * U(0x9E3779B97F4A7C15)
                _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
                at = at[count[back] > 1]
                np.add.at(cover, at, 1)
                np.add.at(cover, at + 8, -1)
            repeat_words = _per_text(np.cumsum(cover[:-1]) > 0, w.first)
            failed = (n < 20) | (100 * repeat_words > 30 * n)

            covered, top, maximal = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            spans: list[list[dict]] = [[] for _ in n]
            if total:
                order, common, owner, _ = repeats(w.hashes, w.first)
                reach = np.zeros(total, np.int64)
                reach[order] = np.maximum(common, np.concatenate([common[1:], [0]]))
                np.maximum.at(top, owner, reach)
                at = np.flatnonzero(reach >= least)
                cover = np.zeros(total + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + reach[at], -1)
                on = np.cumsum(cover[:-1]) > 0
                covered = _per_text(on, w.first)
                edge = np.zeros(total + 1, bool)
                edge[w.first] = True
                begins = np.flatnonzero(on & (edge[:-1] | ~np.concatenate([[False], on[:-1]])))
                ends = np.flatnonzero(on & (edge[1:] | ~np.concatenate([on[1:], [False]]))) + 1
                for d, x, y in zip(owner[begins].tolist(), begins.tolist(), ends.tolist(), strict=True):
                    spans[d].append({"start": x - int(w.first[d]), "stop": y - int(w.first[d])})
                maximal = maximal_count(order, common, w.hashes, w.first, owner, least)
            bad = (covered > most_covered * n) | ((top > longest) & (top > longest_part * n))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(x.astype(np.int64)) for x in (n, word_chars, symbols, dups, repeat_words)), pa.array(failed), pa.array(~failed & ~bad), *(pa.array(x) for x in (covered, top, maximal)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                names=[x.split()[0] for x in SCHEMA.replace("array<struct<start: long, stop: long>>", "x").split(", ")],
            )

    return run


def judge(docs: DataFrame, *, least_repeat: int = 5, most_covered: float = 0.35, longest_repeat: int = 100, longest_part: float = 0.1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of measures for every row of docs; spans are word positions, stop exclusive.

    kept is false where the base rules fail, where repeats of least_repeat words or more cover over most_covered of the
    words, or where the longest repeat has over longest_repeat words and over longest_part of them. Defined results: null,
    empty and blank texts count no words and fail; a null doc_id stays null; repeated rows are judged each; an empty table
    gives no rows; other columns are ignored; texts of any length are read whole."""
    shared.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_run(least_repeat, most_covered, longest_repeat, longest_part), SCHEMA)
