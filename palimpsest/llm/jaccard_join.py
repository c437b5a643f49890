"""Set-similarity join of documents on word shingles by PartEnum signatures (Arasu, Ganti, Kaushik, VLDB 2006).

Sizes fall into bands; a band's instance covers the sizes from its lower bound up to its upper bound divided by the
threshold, so any two sets that can link meet in the instance of the smaller one's band. An instance divides the feature
domain (64-bit shingle hashes) into equal ranges. Sets that link differ in at most d = (1-t)/(1+t) * (|a|+|b|) features,
so of any d+1 partitions at least one holds the same features in both: a set emits one signature for each of its first
d+1 partitions, plus a slack for partitions that are empty (an empty one says nothing and isn't emitted). Only if a set
has more empty ones than the slack of its smallest partner does it emit those too; if both have, they meet there, else they
share a full one.
So no link is missed, and every candidate pair is checked on the sets themselves.

That slack also lets every set leave out some signatures, those in the largest buckets, which passages that many documents
share would fill. Pairs are first held against sketches (counts of features in ranges of the domain), which bound what they
have in common from above, then against the sets.

Within a signature's bucket, members are compared with its most popular member (whose signatures have most company), which
near copies resemble most. Whatever that joins is one component. Pairs that a bucket leaves open, across components, are
narrowed by a prefix filter before they are formed: with features in one order, two sets that have c features in common
share one among the first n - c + 1 of each. The order has the features of a single component first, which join nothing and
are only counted, then the others, rarest first. So a bucket of thousands of near copies costs a comparison each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import shared, words

U = np.uint64
#: Partitions beyond the least number that a set emits, as a part of it.
SLACK = 0.25


def _sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = words.split(texts, lower=True)
    all_grams = words.grams(w.hashes, n)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(all_grams[a : b - n + 1]))
        elif b > a:  # the whole sequence is one shingle
            out.append(words.grams(w.hashes[a:b], b - a) ^ U(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _key(s: np.ndarray) -> int:
    """64 bits that stand for a set: of n different sets two share them with a chance of n**2 / 2**65."""
    return int(words.mix(words.mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64, keepdims=True) + s.sum(dtype=np.uint64)).view(np.int64)[0])


def sketch(s: np.ndarray) -> bytes:
    """Features counted in about len/4 equal ranges of the domain, a power of two, 255 at most each."""
    k = max(0, (len(s) // 4).bit_length() - 1)
    if not k:
        return bytes([min(len(s), 255)])
    return np.minimum(np.bincount((s >> U(64 - k)).astype(np.int64), minlength=1 << k), 255).astype(np.uint8).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Two sets differ in so many features at least: each range's counts differ by no more than its features do."""
    x, y = (np.frombuffer(v, np.uint8).astype(np.int32) for v in (a, b))
    while len(x) > len(y):
        x = x.reshape(-1, 2).sum(1)
    while len(y) > len(x):
        y = y.reshape(-1, 2).sum(1)
    return int(np.abs(x - y).sum())


def _summaries(n: int, bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in shared.chunks(batches, "text"):
            sets = _sets(texts, n)
            drops = [(droppable(s, bands) if len(s) else []) + [(None, None)] * 2 for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_key(s) if len(s) else None for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary()), pa.array([d[0][0] for d in drops], pa.int32()), pa.array([d[0][1] for d in drops], pa.int32()), pa.array([d[1][1] for d in drops], pa.int32()), *part.columns[2:]], names=["doc_id", "n_shingles", "node", "sketch", "band", "drop", "drop_below", *part.schema.names[2:]])

    return run


class Bands:
    """Instance j covers the sizes from low(j) to low(j+1)/t; low grows by t**-2."""

    def __init__(self, threshold: float):
        self.t, self.step = threshold, threshold**-2

    def low(self, j: int) -> int:
        return math.ceil(self.step**j - 1e-9)

    def of(self, m: int) -> list[int]:
        j = int(math.log(m) / math.log(self.step))
        while self.low(j + 1) <= m:
            j += 1
        while j and self.low(j) > m:
            j -= 1
        return [j, j - 1] if j and m <= math.floor((self.low(j) - 1) / self.t + 1e-9) else [j]

    def differing(self, m: int) -> int:
        """The most features in which a set of m and one that links with it differ: the other has m/t at most."""
        return math.floor((1 - self.t) / (1 + self.t) * (m + math.floor(m / self.t + 1e-9)) + 1e-9)

    def emitted(self, m: int) -> tuple[int, int]:
        """Partitions that a set of m emits, and the slack among them."""
        d = self.differing(m)
        slack = math.ceil(SLACK * d) + 1
        return d + 1 + slack, slack

    def partitions(self, j: int) -> int:
        """As many as the largest set of the instance emits."""
        return self.emitted(math.floor((self.low(j + 1) - 1) / self.t + 1e-9))[0]


def _cuts(s: np.ndarray, bands: Bands, j: int) -> np.ndarray:
    """Where the partitions that a set emits in an instance begin and end in it."""
    total, count = bands.partitions(j), bands.emitted(len(s))[0]
    count = min(count, total)
    bounds = np.searchsorted(s, np.arange(1, count + 1, dtype=np.uint64) * U((1 << 64) // total), "left")
    if count == total:
        bounds[-1] = len(s)
    return np.concatenate([[0], bounds])


def _spare(s: np.ndarray, bands: Bands) -> int:
    """The slack of a set's smallest partner."""
    return bands.emitted(math.ceil(bands.t * len(s) - 1e-9))[1]


def signatures(s: np.ndarray, bands: Bands) -> np.ndarray:
    """The signatures of one set; the lowest 8 bits name the instance."""
    out, spare = [], _spare(s, bands)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(s + U(0x9E3779B97F4A7C15)))])
    for j in bands.of(len(s)):
        bounds = _cuts(s, bands, j)
        full = bounds[1:] > bounds[:-1]
        count = len(full)
        salt = U((j * 0x10001 + 1) * 0xD1342543DE82EF95 % (1 << 64))
        sig = words.mix(words.mix(sums[bounds[1:]] - sums[bounds[:-1]] + salt) + words.mix(np.arange(count, dtype=np.uint64) + U(j << 32)))
        sig = (sig & ~U(255)) | U(j & 255)
        out.append(sig if count - full.sum() > spare else sig[full])
    return np.concatenate(out)


def droppable(s: np.ndarray, bands: Bands) -> list[tuple[int, int]]:
    """(instance, number of signatures that the set may leave out there). Sets that link share over spare - empty full
    ones; if each leaves out so many of its last ones in an order that holds for all, one remains in both."""
    spare = _spare(s, bands)
    return [(j & 255, max(0, spare - int(np.count_nonzero(np.diff(_cuts(s, bands, j)) == 0)))) for j in bands.of(len(s))]


def _signed(n: int, bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of this task: an equal set needs its signatures once
        for _, texts in shared.chunks(batches, "text"):
            sigs, owners = [], []
            for s in _sets(texts, n):
                if not len(s) or (key := _key(s)) in seen:
                    continue
                seen.add(key)
                sigs.append(signatures(s, bands))
                owners.append(np.full(len(sigs[-1]), key, np.int64))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(owners))], names=["sig", "node"])

    return run


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by sig, those whose sig another row has too."""
    left: pa.RecordBatch | None = None  # the last row so far
    told = False  # it has been returned
    for batch in batches:
        if not batch.num_rows:
            continue
        both = pa.Table.from_batches([left, batch] if left is not None else [batch]).combine_chunks().to_batches()[0]
        sig = both.column(0).to_numpy()
        same = sig[1:] == sig[:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        last = bool(keep[-1])
        if left is not None and told:
            keep[0] = False
        if left is not None and both.num_rows == 1:
            last = told
        yield both.filter(pa.array(keep))
        left, told = both.slice(both.num_rows - 1), last


def _similarities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, left, right = (batch.column(i) for i in range(4))
        common, union = [], []
        for x, y in zip(left, right, strict=True):
            p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = np.concatenate([p, q])
            both.sort(kind="stable")
            common.append(int(np.count_nonzero(both[1:] == both[:-1])))
            union.append(len(both) - common[-1])
        yield pa.RecordBatch.from_arrays([a, b, pa.array(common, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "common", "union"])


def _possible(percent: int):
    """Pairs that may link by their sizes and sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(i).to_numpy() for i in (2, 4))
            may = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
            for i in np.flatnonzero(may):
                d = least_difference(batch.column(3)[i].as_py(), batch.column(5)[i].as_py())
                may[i] = (100 + percent) * d <= (100 - percent) * (na[i] + nb[i])
            yield batch.select([0, 1]).filter(pa.array(may))

    return run


def _features(of: str):
    """feature and what it is of (the column node or component), from rows with sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sets = [np.frombuffer(s.as_buffer(), np.int64) for s in batch.column("set")]
                whose = np.repeat(batch.column(of).to_numpy(), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(whose)], names=["feature", of])

    return run


def _blobs(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in shared.chunks(batches, "text"):
            sets = _sets(texts, n)
            yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "set"])

    return run


def similar_groups(docs: DataFrame, *, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs; with carry (small columns) also group, which names a component
    even where doc_ids are null or repeat (null without shingles), and those columns.

    Words are runs of anything but ASCII white space, A-Z as a-z; a text's set is its distinct shingles, with fewer words
    the whole sequence as one. Two documents link when 100 * |a and b| >= percent * |a or b|; component_id is the smallest
    doc_id that links reach. Defined results: null, empty and blank texts have n_shingles 0 and are alone; a null doc_id
    stays null and never is a component's id, unless all of it are null; every row is judged by its own text, so repeated
    rows and doc_ids stay; equal texts are in one component; an empty table gives no rows; other columns are ignored. Texts
    of any length are read whole."""
    spark = docs.sparkSession
    shared.bounded_batches(spark)
    folder = shared.shared_dir(spark)
    bands = Bands(percent / 100)
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    carried = {f"c{i}": c for i, c in enumerate(carry)}
    wide = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *(F.col(c).alias(n) for n, c in carried.items()))
    schema = ", ".join(["doc_id long, n_shingles long, node long, sketch binary, band int, drop int, drop_below int", *(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in carried.items())])
    rows = shared.written(wide.mapInArrow(_summaries(shingle, bands), schema), folder, "rows")
    # equal sets are one node
    full = rows.where("node is not null")
    nodes = shared.written(full.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("band").alias("band"), F.first("drop").alias("drop"), F.first("drop_below").alias("drop_below")), folder, "nodes")

    signed = read.mapInArrow(_signed(shingle, bands), "sig long, node long")
    buckets = shared.written(signed.repartition("sig").sortWithinPartitions("sig").mapInArrow(_shared_rows, "sig long, node long").distinct(), folder, "buckets")
    shared.release(spark)
    # each set leaves out its signatures in the largest buckets, as far as no link is lost: common passages alone fill those
    crowds = buckets.groupBy("sig").agg(F.count("*").alias("size")).where("size > 1")
    by_size = Window.partitionBy("node", "instance").orderBy(F.desc("size"), "sig")
    ranked = buckets.join(crowds, "sig").withColumn("instance", F.expr("sig & 255")).withColumn("place", F.row_number().over(by_size))
    limits = nodes.select("node", "band", "drop", "drop_below")
    thinned = shared.kept(ranked.join(limits, "node").where("place > if(instance = band, drop, drop_below)").select("sig", "node", "size"))
    popular = thinned.groupBy("node").agg(F.sum("size").alias("company"))
    met = thinned.join(popular, "node")
    led = met.groupBy("sig").agg(F.max(F.struct("company", "node")).alias("top"), F.count("*").alias("size")).where("size > 1").select("sig", F.col("top.node").alias("leader"))
    members = shared.written(thinned.select("sig", "node").join(led, "sig").where("node <> leader"), folder, "members")
    thinned.unpersist()
    shared.forget(spark, folder, "buckets")
    shared.release(spark)

    def sources(wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The ids of some nodes, kept, and a text for each."""
        ids = shared.kept(nodes.join(wanted, "node", "left_semi").select(F.col("doc_id").alias("wanted")).distinct())
        return ids, shared.by_ids(read, ids, F.expr("doc_id <=> wanted"), "left_semi")

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        """a, b: those of the pairs that link."""
        a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        b = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        sketched = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "sa", "nb", "sb")
        pairs = shared.kept(sketched.mapInArrow(_possible(percent), "a long, b long"))
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        ids, texts = sources(wanted)
        # ids may repeat; a table that is read again has no partitioning, so Spark may split a popular leader's pairs
        sets = shared.written(texts.mapInArrow(_blobs(shingle), "node long, set binary").dropDuplicates(["node"]), folder, f"{name}_sets")
        left = sets.select(F.col("node").alias("a"), F.col("set").alias("left"))
        right = sets.select(F.col("node").alias("b"), F.col("set").alias("right"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
        done = shared.written(both.mapInArrow(_similarities, "a long, b long, common long, union long").where(linked).select("a", "b").distinct(), folder, name)
        pairs.unpersist()
        ids.unpersist()
        shared.forget(spark, folder, f"{name}_sets")
        shared.release(spark)
        return done

    linked = F.expr(f"100 * common >= {percent} * union")
    links = checked(members.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "first")
    groups = shared.components(links, folder, "groups")

    # what the leaders leave open: members of one bucket, in different components
    seats = members.join(groups, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("component"))
    several = seats.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("sig")
    left_open = shared.written(seats.join(several, "sig", "left_semi").select("node", "component").distinct(), folder, "open")
    shared.forget(spark, folder, "members", "groups")
    ids, texts = sources(left_open.select("node"))
    sets = shared.kept(texts.mapInArrow(_blobs(shingle), "node long, set binary").join(left_open, "node").dropDuplicates(["node"]))
    held = sets.mapInArrow(_features("component"), "feature long, component long").groupBy("feature").agg(F.count("*").alias("held_by"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    several = shared.written(held.where("lo < hi").select("feature", "held_by"), folder, "several")  # of several components
    shared.release(spark)
    of_node = Window.partitionBy("node")
    alone = F.col("n") - F.count("*").over(of_node)  # features of the set's component alone, which come first
    joining = sets.mapInArrow(_features("node"), "feature long, node long").join(several, "feature")
    described = joining.join(sets.select("node", "component", F.expr("cast(octet_length(set) div 8 as long)").alias("n")), "node")
    ordered = described.withColumn("place", alone + F.row_number().over(of_node.orderBy("held_by", "feature")) - 1)
    # two sets that link have common(m, n) features in common at least, so they share one of the first m - common + 1
    common = lambda m, n: f"ceil({percent} * ({m} + {n}) / {100 + percent}D - 1e-9)"
    firsts = ordered.where(f"place <= n - ceil(n * {percent} / 100D - 1e-9)").select("feature", "node", "component", "n", "place")
    firsts = shared.written(firsts, folder, "firsts")
    sets.unpersist()
    ids.unpersist()
    shared.release(spark)
    x = firsts.where(f"place <= n - {common('n', 'n')}").select("feature", F.col("node").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("place").alias("pa"))
    y = firsts.select("feature", F.col("node").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("place").alias("pb"))
    fits = f"(na < nb or na = nb and a < b) and ca <> cb and 100 * na >= {percent} * nb and pa <= na - {common('na', 'nb')} and pb <= nb - {common('na', 'nb')}"
    more = checked(x.join(y, "feature").where(fits).select("a", "b").distinct(), "more")
    joined = shared.components(links.unionByName(more), folder, "components")
    smallest = full.join(joined, "node").groupBy("component").agg(F.min("doc_id").alias("smallest"))
    named = joined.join(smallest, "component").select("node", "smallest", F.col("component").alias("group")).unionByName(nodes.join(joined, "node", "left_anti").select("node", F.col("doc_id").alias("smallest"), F.col("node").alias("group")))
    component = F.when(F.col("n_shingles") > 0, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id")
    told = ["doc_id", "n_shingles", component, *(["group"] if carried else []), *(F.col(n).alias(c) for n, c in carried.items())]
    out = shared.written(rows.select("doc_id", "n_shingles", "node", *carried).join(named, "node", "left").select(*told), folder, "out")
    shared.forget(spark, folder, "rows", "nodes", "components", "open", "several", "firsts", "first", "more")
    shared.release(spark)
    return out
