"""SentencePiece ids and texts by a table of distinct chunks.

Where no piece of a model holds a white-space marker after another character, no merge crosses the place before a marker,
so a text is segmented chunk by chunk: each distinct chunk (its markers and what follows up to the next marker) once a
worker, and the ids are joined by position. A line break that no piece contains ends chunks as well. Models for which
this doesn't hold, and those that change text before segmenting, are encoded text by text."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import shared
from palimpsest.llm.token_output import Numbered

MARK = "▁"
END = None  # in the table of chunks, the end id


class ChunkIds:
    """The ids of texts, with the end id, and their texts again."""

    MOST_CHUNKS, MOST_CHARS = 300_000, 24 << 20

    def __init__(self, path: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        # a mark in the text itself would count as a space; the probe shows whether texts reach the model unchanged
        probe = "  Ab  ﬁ　ć\n x\t "
        unchanged = "".join(self.sp.decode(self.sp.encode(c)) for c in (probe, "½", "Ａ")) == probe + "½Ａ"
        dummy = self.sp.encode("a b", out_type=str)[:1] == [MARK + "a"] or self.sp.encode("a", out_type=str)[0].startswith(MARK)
        inside = any(MARK in p.lstrip(MARK) for p in pieces)
        own = any(self.sp.is_control(i) is False and self.sp.is_unused(i) for i in range(len(pieces)))
        self.by_chunk = unchanged and dummy and not inside and not own
        self.breaks = self.by_chunk and not any("\n" in p for p in pieces) and self.sp.encode("\nA")[:2] == [self.sp.piece_to_id(MARK), self.sp.piece_to_id("<0x0A>")]
        self.cut = re.compile(r"\n| *[^ \n]+| +" if self.breaks else r" *[^ ]+| +")
        self.lead = self.sp.encode("\n")
        self._clear()

    def _clear(self) -> None:
        self.index = Numbered({END: 0})
        self.chars = 0
        self.flat, self.counts, self.heads = np.array([self.sp.eos_id()], np.int32), np.array([1], np.int64), np.array([0], np.int64)

    def _new(self, chunks: list) -> list[list[int]]:
        """The model puts one marker before a text itself; a chunk without one is encoded behind a line break."""
        whole = [c[0] if isinstance(c, tuple) else c[1:] if c[0] == " " else "\n" + c for c in chunks]
        got = self.sp.encode(whole, num_threads=1)
        mark, lead = [self.sp.piece_to_id(MARK)], len(self.lead)
        for i, c in enumerate(chunks):
            if isinstance(c, tuple):
                continue
            if c == " ":
                got[i] = mark
            elif c == "\n":
                got[i] = self.lead[1:]
            elif c[0] != " ":
                got[i] = got[i][lead:]
        return got

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and how many each has."""
        if len(self.index) > self.MOST_CHUNKS or self.chars > self.MOST_CHARS:
            self._clear()
        cut: list = []
        lasts = np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                cut += self.cut.findall(" " + text) if self.by_chunk and MARK not in text else [(text,)]
            cut.append(END)
            lasts[i] = len(cut)
        at = np.fromiter(map(self.index.__getitem__, cut), np.int64, len(cut))
        if new := self.index.new:
            got = self._new(new)
            self.chars += sum(len(c[0]) if isinstance(c, tuple) else len(c) for c in new)
            self.counts = np.concatenate([self.counts, np.fromiter(map(len, got), np.int64, len(got))])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(got), np.int32)])
            self.heads = np.cumsum(self.counts) - self.counts
            self.index.new = []
        counts = self.counts[at]
        ends = np.cumsum(counts)
        ids = self.flat[np.arange(int(ends[-1])) + np.repeat(self.heads[at] - (ends - counts), counts)] if len(cut) else np.zeros(0, np.int32)
        return ids, np.diff(ends[lasts - 1], prepend=0) if len(lasts) else np.zeros(0, np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        values, ends = ids.tolist(), np.cumsum(counts).tolist()
        return [self.sp.decode(values[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


_models: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    """One for each worker process."""
    if path not in _models:
        _models[path] = ChunkIds(os.fspath(path))
    return _models[path]


def _run(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = chunk_ids(model)
        for part, texts in shared.chunks(batches, "text", 1 << 20):
            ids, counts = codes.encode(texts.to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(codes.decode(ids, counts), pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, model: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (an array, with the end id) and decoded (the text that the ids give back) of every row.

    model: a SentencePiece file that every executor has. Ids are those that the library gives for the whole text, without
    sampling. Defined results: null and empty texts have the end id alone and decode to an empty text; repeated rows stay;
    a null doc_id stays null; an empty table gives no rows; other columns are ignored; texts of any length are read whole."""
    shared.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_run(model), "doc_id long, ids array<int>, decoded string")
