"""Token ids as directly addressable codes (Brisaboa, Ladra, Navarro, 2013) in files that are read back or addressed.

An id is cut into chunks of 8 bits, lowest first. Level 1 holds the lowest chunk of every id; a level's continuation bitmap
says which of its ids go on, and the next level holds the next chunk of just those. A rank directory counts the ones before
each block of 512 bits, so the id at any position is found with one rank a level, without decoding its neighbours.

A file, all little-endian: magic, then u64 n_docs, n_ids, n_levels; doc ids i64 and their validity u8; first id of each
document u64 (n_docs + 1); for each level: u64 n, chunks u8 * n, and but for the last its bitmap as u64 words and its
rank directory as u32; last the crc32 u32 of all before it."""

from __future__ import annotations

import contextlib
import gc
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import shared

MAGIC = b"PALDAC01"
BLOCK = 8  # bitmap words in a block of the rank directory
MANIFEST = "part long, seq long, path string, n_docs long, n_ids long, n_bytes long"


def _cut(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """(chunks, whether each goes on) by level; the last level has no bits."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        low, more = (rest & np.uint32(255)).astype(np.uint8), rest >> np.uint32(8)
        goes = more > 0
        if not goes.any():
            return [*out, (low, None)]
        out.append((low, goes))
        rest = more[goes]


def encode(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file's bytes."""
    valid = np.array([d is not None for d in doc_ids], np.uint8)
    starts = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
    levels = _cut(ids)
    out = [MAGIC, struct.pack("<3Q", len(doc_ids), len(ids), len(levels)), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), valid.tobytes(), starts.tobytes()]
    for low, goes in levels:
        out += [struct.pack("<Q", len(low)), low.tobytes()]
        if goes is not None:
            bits = np.packbits(goes, bitorder="little")
            bits = np.concatenate([bits, np.zeros(-len(bits) % (8 * BLOCK), np.uint8)])
            ones = np.bitwise_count(bits.view("<u8")).reshape(-1, BLOCK).sum(1)
            out += [bits.tobytes(), (np.cumsum(ones) - ones).astype("<u4").tobytes()]
    body = b"".join(out)
    return body + struct.pack("<I", zlib.crc32(body))


class Codes:
    """A file that has been read."""

    def __init__(self, body: bytes):
        if body[:8] != MAGIC or zlib.crc32(memoryview(body)[:-4]) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError("no token file, or a damaged one")
        self.n_docs, self.n_ids, n_levels = struct.unpack_from("<3Q", body, 8)
        at = 32

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(body, kind, n, at)
            at += got.nbytes
            return got

        ids, valid = take("<i8", self.n_docs), take("u1", self.n_docs)
        self.doc_ids = [int(d) if v else None for d, v in zip(ids, valid, strict=True)]
        self.starts = take("<u8", self.n_docs + 1).astype(np.int64)
        self.levels = []
        for k in range(n_levels):
            n = int(take("<u8", 1)[0])
            low = take("u1", n)
            blocks = -(-n // (64 * BLOCK)) if k < n_levels - 1 else 0
            self.levels.append((low, take("<u8", blocks * BLOCK), take("<u4", blocks)))

    def __getitem__(self, i: int) -> int:
        """The id at a position."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for k, (low, bits, ranks) in enumerate(self.levels):
            value |= int(low[i]) << (8 * k)
            word, bit = divmod(i, 64)
            if k == len(self.levels) - 1 or not (int(bits[word]) >> bit) & 1:
                break
            block = word // BLOCK
            inside = int(bits[word]) & ((1 << bit) - 1)
            i = int(ranks[block]) + int(np.bitwise_count(bits[block * BLOCK : word]).sum()) + inside.bit_count()
        return value

    def all(self) -> np.ndarray:
        """All ids as little-endian unsigned 32-bit integers."""
        upper = None
        for k in range(len(self.levels) - 1, -1, -1):
            low, bits, _ = self.levels[k]
            value = low.astype("<u4")
            if upper is not None:
                goes = np.unpackbits(bits.view(np.uint8), count=len(low), bitorder="little").view(bool)
                value[goes] |= upper << np.uint32(8)
            upper = value
        return upper


def _bytes_of_unicode() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Numbered(dict):
    """Gives each new key the next number and remembers it in new."""

    def __init__(self, *args):
        super().__init__(*args)
        self.new: list = []

    def __missing__(self, key):
        self.new.append(key)
        self[key] = n = len(self)
        return n


@contextlib.contextmanager
def uncollected() -> Iterator[None]:
    """Without the collector of cycles, which would look at every one of many small lists."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Lists:
    """Many short lists of numbers in one array, which grows by doubling."""

    def __init__(self, kind):
        self.flat, self.heads, self.counts = np.empty(1 << 10, kind), np.empty(1 << 8, np.int64), np.empty(1 << 8, np.int64)
        self.used = 0

    def _room(self, name: str, n: int) -> np.ndarray:
        have = getattr(self, name)
        if n > len(have):
            more = np.empty(max(n, 2 * len(have)), have.dtype)
            more[: len(have)] = have
            setattr(self, name, more)
        return getattr(self, name)

    def put(self, numbers: np.ndarray, counts: np.ndarray, flat: np.ndarray) -> None:
        """The lists of some numbers, end to end."""
        if len(numbers):
            to = int(numbers.max()) + 1
            self._room("counts", to)[numbers] = counts
            self._room("heads", to)[numbers] = self.used + np.cumsum(counts) - counts
            self._room("flat", self.used + len(flat))[self.used : self.used + len(flat)] = flat
            self.used += len(flat)

    def add(self, numbers: np.ndarray, lists: list[list[int]]) -> None:
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        self.put(numbers, counts, np.fromiter(chain.from_iterable(lists), self.flat.dtype, int(counts.sum())))

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of some numbers, end to end, and their lengths."""
        counts = self.counts[at]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        narrow = np.int32 if max(total, self.used) < 1 << 31 else np.int64
        place = np.arange(total, dtype=narrow)
        place += np.repeat((self.heads[at] - (ends - counts)).astype(narrow), counts)
        return self.flat[place], counts


class WordIds:
    """Ids of white-space separated words, each distinct word encoded once.

    Where the vocabulary's pieces never cross white space, a text's ids are its words' ids in order. Plain words (printable
    ASCII and Latin-1 letters, for which normalisation is lower-casing) go through a byte-pair encoder built from the
    vocabulary's own ranks; all others go through the tokenizers library. Vocabularies that aren't of this kind encode whole
    texts through the library. A full table of words becomes the old one, from which words are taken over when they occur."""

    MOST_WORDS, MOST_BYTES = 250_000, 24 << 20
    END = b""  # never a word: stands for the end id
    MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
    #: The vocabulary's own cuts, by which letters and marks are separate pieces. Fixed value.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    PLAIN = bytes([*range(9, 14), *range(32, 127), *range(0x80, 0xC0), 0xC3])

    def __init__(self, path: str, end_id: int):
        self.path, self.end_id = path, end_id
        self.slow = Tokenizer.from_file(path)
        self.plain = regex.compile(r"(?:(?!<\|)[\x21-\x7E\xC0-\xD6\xD8-\xF6\xF8-\xFF])+")
        self.fast, self.pieces = self._encoder(path)
        self.index, self.table = Numbered(), Lists(np.uint32)
        self._next()

    def _next(self) -> None:
        self.index.new = []
        self.old, self.old_table = self.index, self.table
        self.index, self.table = Numbered({self.END: 0}), Lists(np.uint32)
        self.table.add(np.zeros(1, np.int64), [[self.end_id]])
        self.known: dict[str, list[int]] = {}
        self.tails: dict[bytes, list[int]] = {}
        self.size = 0

    @staticmethod
    def _encoder(path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, kinds = spec["model"], (spec.get("normalizer") or {}).get("normalizers", [])
        if not isinstance(model.get("vocab"), dict) or "merges" not in model:
            return None, None
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        ordered = [model["vocab"].get(a + b) for a, b in merges]
        if (
            [k["type"] for k in kinds] != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in pre] != ["Split", "ByteLevel"]
            or not pre[0].get("invert") or model.get("end_of_word_suffix") != "</w>" or model.get("ignore_merges") or model.get("dropout")
            or ordered != list(range(512, 512 + len(ordered)))
        ):
            return None, None
        of = _bytes_of_unicode()
        ranks = {}
        for token, i in model["vocab"].items():
            if i < 512 + len(ordered):  # 0xFF, which UTF-8 lacks, stands for the end of a word
                last = token.endswith("</w>") and token != "</w>"
                ranks[bytes(of[c] for c in (token[:-4] if last else token)) + b"\xff" * last] = i
        if len(ranks) != 512 + len(ordered):
            return None, None
        return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe, regex.compile(pre[0]["pattern"]["Regex"])

    def _ids(self, word: bytes, plain: bool) -> list[int]:
        text = word.decode()
        if not (plain or self.plain.fullmatch(text)):
            return self.slow.encode(text, add_special_tokens=False).ids
        text = text.lower()
        if text.isalpha():
            return self._piece(text)
        out: list[int] = []
        for piece in self.pieces.findall(text):
            out += self._piece(piece)
        return out

    def _piece(self, piece: str) -> list[int]:
        got = self.known.get(piece)
        if got is None:
            got = self.known[piece] = self.fast.encode_single_piece(piece.encode() + b"\xff")
        return got

    def _marks(self, tail: bytes) -> list[int]:
        got = self.tails.get(tail)
        if got is None:
            got = self.tails[tail] = self.fast.encode_single_piece(tail + b"\xff")
        return got

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with its end id, and how many each text has."""
        if self.fast is None:
            got = [np.array([*self.slow.encode(t.decode(), add_special_tokens=False).ids, self.end_id], np.uint32) for t in texts]
            return np.concatenate([np.zeros(0, np.uint32), *got]), np.array([len(x) for x in got], np.int64)
        body = b" ".join(texts)
        special = b"<|" in body  # a special token's string is found before lower-casing
        plain = not special and not body.translate(None, self.PLAIN) and b"\xc3\x97" not in body and b"\xc3\xb7" not in body and b"\xc2" not in body
        words: list[bytes] = []
        lasts = np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            words += (t if special else t.lower()).split()
            words.append(self.END)
            lasts[i] = len(words)
        if len(self.index) > self.MOST_WORDS or self.size > self.MOST_BYTES:
            self._next()
        first = len(self.index)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if new := self.index.new:
            before = np.fromiter((self.old.get(w, -1) for w in new), np.int64, len(new))
            numbers, had = np.arange(first, first + len(new)), before >= 0
            flat, counts = self.old_table.take(before[had])
            self.table.put(numbers[had], counts, flat)
            unseen = [w for w, b in zip(new, before.tolist(), strict=True) if b < 0]
            with uncollected():
                if special:
                    got = [self._ids(w, plain) for w in unseen]
                else:  # these are lower case; a word of ASCII letters is one piece, marks behind it are another
                    piece, marks = self.fast.encode_single_piece, self.MARKS if self.pieces.pattern == self.PATTERN else b""
                    got = [
                        piece(w + b"\xff") if w.isalpha()
                        else piece(core + b"\xff") + self._marks(w[len(core) :]) if (core := w.rstrip(marks)).isalpha() and core != w
                        else self._ids(w, plain)
                        for w in unseen
                    ]
            self.table.add(numbers[~had], got)
            self.size += sum(map(len, new))
            self.index.new = []
        ids, counts = self.table.take(at)
        ends = np.cumsum(counts)
        return ids, np.diff(ends[lasts - 1], prepend=0) if len(lasts) else np.zeros(0, np.int64)


_encoders: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, end_id: int) -> WordIds:
    """One for each worker process."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = WordIds(path, end_id)
    return _encoders[path, end_id]


def _put(folder: str, name: str, body: bytes) -> str:
    """Writes under a name of its own, then renames: a file is whole or absent, whichever attempt wrote it."""
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    own = f"{path}/{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(f"{own}.tmp") as f:
        f.write(body)
    fs.move(f"{own}.tmp", f"{own}.dac")
    return f"{folder}/{os.path.basename(own)}.dac"


def _writer(tokenizer: str, end_id: int, folder: str, ids_per_file: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, part, seq = word_ids(tokenizer, end_id), TaskContext.get().partitionId(), 0
        docs, counts, ids, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, counts, ids, held, seq
            body = encode(docs, np.concatenate(counts), np.concatenate(ids))
            row = {"part": part, "seq": seq, "path": _put(folder, f"part-{part:06d}-{seq:06d}", body), "n_docs": len(docs), "n_ids": held, "n_bytes": len(body)}
            docs, counts, ids, held, seq = [], [], [], 0, seq + 1
            return pa.RecordBatch.from_pylist([row])

        for rows, texts in shared.chunks(batches, "text", min(ids_per_file, 2 * shared.CHUNK_BYTES)):
            got, n = codes.encode(texts.cast(pa.binary()).to_pylist())
            docs += rows.column(0).to_pylist()
            counts.append(n)
            ids.append(got)
            held += len(got)
            if held >= ids_per_file:
                yield flush()
        if docs:
            yield flush()

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = 2, ids_per_file: int = 4 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the ids of every row, in ascending doc_id order over the files, and returns the manifest: a row for each file,
    in the order (part, seq). Only files in the manifest count; a failed attempt's files are never named there.

    tokenizer: a file of the tokenizers library; every text ends with end_id. Defined results: null and empty texts are the
    end id alone; rows without doc_id come first; rows with one doc_id stay, ordered by text; an empty table gives an empty
    manifest; other columns are ignored. folder: a URI that executors reach."""
    shared.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return shared.written(
        rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(_writer(tokenizer, end_id, f"{folder}/files", ids_per_file), MANIFEST),
        folder, "manifest",
    )


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            fs, at = pafs.FileSystem.from_uri(path)
            with fs.open_input_file(at) as f:
                codes = Codes(f.read())
            ids, starts = codes.all(), codes.starts
            for a in range(0, codes.n_docs, 500):
                b = min(codes.n_docs, a + 500)
                blobs = [ids[x:y].tobytes() for x, y in zip(starts[a:b], starts[a + 1 : b + 1], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(codes.doc_ids[a:b], pa.int64()), pa.array(first + starts[a:b]), pa.array(np.diff(starts[a : b + 1])), pa.array(blobs, pa.binary())], names=["doc_id", "start", "n_tokens", "ids_le"])


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids before the document in all files), n_tokens and ids_le (little-endian unsigned 32-bit integers)."""
    shared.bounded_batches(manifest.sparkSession)
    by_part = manifest.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = by_part.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    files = manifest.withColumn("inside", inside).join(before, "part").select("path", (F.col("base") + F.col("inside")).alias("first"))
    return files.repartition("path").mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_le binary")
