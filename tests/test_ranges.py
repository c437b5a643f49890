"""Joins with ranges, folds and filters against brute force, with spans of 2**40 and more."""

import random

from pyspark.sql import functions as F

from palimpsest.functions import bloom
from palimpsest.functions.hash32 import hash32, hash32_of
from palimpsest.operators import compact, layout, mvcc, ranges

WIDE = [0, 1, 5, 1 << 20, 1 << 40, (1 << 40) + 7, (1 << 62) + 3, 2**63 - 1]


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_nodes_make_up_ranges(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(60)] + [(-20, 13), (-7, -7), (0, 2**63 - 1), (-(2**63), 2**63 - 1), (1, 1 << 40)]
    got = spark.createDataFrame(pairs, "lo long, hi long").select("lo", "hi", ranges.nodes(F.col("lo"), F.col("hi")).alias("n")).collect()
    for r in got:
        covered = sorted((x["n"] << x["level"], ((x["n"] + 1) << x["level"]) - 1) for x in r["n"] or [])
        if r["lo"] > r["hi"]:
            assert not covered
            continue
        assert covered[0][0] == r["lo"] and covered[-1][1] == r["hi"] and len(covered) <= 126
        assert all(a[1] + 1 == b[0] for a, b in zip(covered, covered[1:], strict=False))


def test_overlaps_of_wide_ranges(spark):
    rng = random.Random(2)
    make = lambda n: [(i, *sorted((rng.choice(WIDE), rng.choice(WIDE)))) for i in range(n)]
    a, b = make(40), make(30)
    files = lambda x: spark.createDataFrame(x, "sst_id long, first_key long, last_key long")
    assert rows(compact.overlaps(files(a), files(b))) == sorted((i, j) for i, lo, hi in a for j, low, high in b if lo <= high and low <= hi)


def test_watermarks_of_long_readers(spark):
    rng = random.Random(3)
    readers = [tuple(sorted((rng.choice(WIDE), rng.choice(WIDE)))) for _ in range(50)] + [(4, 4)]
    moments = [rng.choice(WIDE) + rng.randrange(-1, 1) for _ in range(40)]
    moments = [max(m, 0) for m in moments]
    got = rows(mvcc.watermarks(spark.createDataFrame(readers, "read_ts long, closed_ts long"), spark.createDataFrame([(m,) for m in moments], "ts long")))
    assert got == sorted((m, min((r for r, c in readers if r <= m < c), default=m)) for m in set(moments))


def txns(rng, n, span):
    out, ends = [], rng.sample(range(1, span), n)
    for i, end in enumerate(sorted(ends)):
        sets = [rng.sample("abcdefg", rng.randrange(4)) for _ in range(2)]
        out.append((i, rng.randrange(end), end, *sets))
    return out


def test_conflicts_and_outcomes_of_long_transactions(spark):
    for seed, span in ((4, 1 << 40), (5, 200)):
        some = txns(random.Random(seed), 60, span)
        df = spark.createDataFrame(some, "txn long, read_ts long, commit_ts long, read_set array<string>, write_set array<string>")
        want = sorted((a[0], b[0]) for a in some for b in some if a[4] and a[0] != b[0] and a[1] < b[2] < a[2] and set(a[3]) & set(b[4]))
        assert rows(mvcc.conflicts(df)) == want
        committed = {}
        for t in some:  # in order of commit_ts
            committed[t[0]] = not any(a == t[0] and committed.get(b, False) for a, b in want)
        assert {r["txn"]: r["committed"] for r in mvcc.outcomes(df).collect()} == committed


def test_cuts_equal_row_by_row(spark):
    rng = random.Random(6)
    data = [(s, i, f"k{i // rng.randrange(1, 4)}", -i, rng.randrange(1, 30)) for s in range(5) for i in range(rng.randrange(1, 90))]
    df = spark.createDataFrame(data, "shard int, seq int, k string, neg_ts int, n_bytes long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # parts go on from batch to batch
    try:
        tables = {(r["shard"], r["seq"]): r["memtable"] for r in layout.memtables(df, 50).collect()}
        packed = {(r["shard"], r["k"], r["neg_ts"]): r["block"] for r in layout.blocks(df, 50).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    for s in range(5):
        part = size = 0
        for _, seq, _, _, n in sorted(r for r in data if r[0] == s):
            part, size = (part + 1, n) if size >= 50 else (part, size + n)
            assert tables[s, seq] == part
        part = size = 0
        last = None
        for _, k, neg, n in sorted((r[0], r[2], r[3], r[4]) for r in data if r[0] == s):
            part, size = (part, size + n) if not size or k == last or size + n <= 50 else (part + 1, n)
            last = k
            assert packed[s, k, neg] == part


def test_filters_of_several_pieces(spark):
    keys = spark.range(9000).select(F.when(F.col("id") < 8990, 1).otherwise(2).alias("filter"), hash32(F.col("id").cast("string").cast("binary")).alias("h"))
    bits = bloom.build(keys, 10)
    data = {r["filter"]: bytes(r["data"]) for r in bloom.to_bytes(bits, 10).collect()}
    for f, ids in ((1, range(8990)), (2, range(8990, 9000))):
        assert data[f] == bloom.filter_bytes({hash32_of(str(i).encode()) for i in ids}, 10)
    assert len(data[1]) > bloom.PIECE // 8
    assert all(r["may_contain"] for r in bloom.may_contain(keys, bits, 10).collect())
    other = spark.range(20000, 24000).select(F.lit(1).alias("filter"), hash32(F.col("id").cast("string").cast("binary")).alias("h"))
    assert bloom.may_contain(other, bits, 10).where("may_contain").count() < 120
    assert not bloom.may_contain(other.withColumn("filter", F.lit(3)), bits, 10).where("may_contain").count()
