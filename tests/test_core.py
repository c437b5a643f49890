import random

import pytest
from pyspark.sql import functions as F

from palimpsest import model
from palimpsest.functions import bloom, bytewise
from palimpsest.functions.hash32 import hash32
from palimpsest.operators import compact, layout, merge, mvcc, read
from palimpsest.plans import script
from palimpsest.sources import formats

HASHES = {"": 3164544308, "61": 678337968, "6162": 967615280, "616263": 2237464879, "61626364": 3116905299, "6170706c65": 2088703547, "0000000000000000": 1901488498, "0000000000000001": 72752242, "000000000000002a": 2404816754, "0000000000000102": 1055467213, "8000000000000000": 1043432185}


def log(spark, rows):
    return spark.createDataFrame(rows, "k string, cts long, v string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_visibility_and_tombstones(spark):
    one = log(spark, [("k", 2, "x"), ("k", 5, "y")])
    assert [[r["v"] for r in read.snapshot(one, t).collect()] for t in (1, 2, 4, 5)] == [[], ["x"], ["x"], ["y"]]
    gone = log(spark, [("k", 2, "x"), ("k", 4, ""), ("k", 6, "z")])
    assert [[r["v"] for r in read.get(gone, "k", t).collect()] for t in (3, 4, 5, 6)] == [["x"], [], [], ["z"]]
    assert rows(read.deleted(gone, 5)) == [("k", 4)]


def test_scan_is_inclusive(spark):
    table = log(spark, [("a", 1, "valA"), ("b", 2, "valB"), ("c", 3, "valC")])
    got = lambda lo, hi: "".join(r["k"] for r in read.snapshot(table, None, lo, hi).orderBy("k").collect())
    assert [got(None, None), got("b", None), got("a", "b"), got("d", "e")] == ["abc", "bc", "ab", ""]


def test_reads_equal_a_plain_model(spark):
    rng = random.Random(7)
    versions = [(f"k{rng.randrange(9)}", t, rng.choice(["", "a", "b", "c"])) for t in range(1, 120)]
    table = log(spark, versions).cache()

    def state(t, base=versions):
        got = {}
        for k, ts, v in sorted(base, key=lambda r: r[1]):
            if ts <= t:
                got[k] = v
        return {k: v for k, v in got.items() if v}

    for t in (0, 1, 40, 77, 119):
        assert {r["k"]: r["v"] for r in read.snapshot(table, t).collect()} == state(t)
    for bottom in (False, True):
        left = [tuple(r) for r in compact.collect_garbage(table, 60, bottom).collect()]
        for t in (60, 61, 90, 119):
            assert state(t, left) == state(t)
    change = {r["k"]: (r["before"], r["after"]) for r in read.difference(table, 40, 119).collect()}
    assert change == {k: (state(40).get(k), state(119).get(k)) for k in {*state(40), *state(119)} if state(40).get(k) != state(119).get(k)}


@pytest.mark.parametrize(
    ("versions", "w", "bottom", "left"),
    [
        ([(3, "old"), (5, "")], 10, True, []),
        ([(3, "old"), (5, "")], 10, False, [(5, "")]),
        ([(3, "old"), (5, ""), (9, "n")], 6, True, [(9, "n")]),
        ([(1, "a"), (3, "b"), (8, "c"), (9, "d")], 5, True, [(3, "b"), (8, "c"), (9, "d")]),
    ],
)
def test_garbage(spark, versions, w, bottom, left):
    table = log(spark, [("k", t, v) for t, v in versions])
    assert rows(compact.collect_garbage(table, w, bottom).select("cts", "v")) == left


def test_merges(spark):
    a, b = log(spark, [("a", 1, "A"), ("c", 2, "")]), log(spark, [("a", 1, "B"), ("a", 3, "B"), ("c", 2, "B")])
    assert rows(merge.two_way(a, b)) == rows(merge.k_way([a, b]).select("k", "cts", "v")) == [("a", 1, "A"), ("a", 3, "B"), ("c", 2, "")]
    local = spark.createDataFrame([("a", "mine"), ("b", "")], "k string, v string")
    base = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "k string, v string")
    assert rows(merge.overlay(local, base)) == [("a", "mine", True), ("c", "z", False)]
    files = spark.createDataFrame([(0, 1, 1, 5), (0, 2, 6, 9), (0, 3, 8, 12), (0, 4, 9, 9)], "run int, sst_id int, first_key int, last_key int")
    assert [r["overlaps"] for r in merge.check_run(files).orderBy("sst_id").collect()] == [False, False, True, True]


def test_clock_and_batches(spark):
    calls = spark.createDataFrame([(i,) for i in (4, 9, 70000)], "seq long")
    assert [tuple(r) for r in mvcc.clock(calls, "seq").orderBy("seq").select("read_ts", "commit_ts").collect()] == [(1, 2), (3, 4), (5, 6)]
    batch = spark.createDataFrame([(1, "k", 0, "1"), (1, "k", 1, "2")], "batch int, k string, pos int, v string")
    assert [r["v"] for r in mvcc.last_in_batch(batch, "batch", "k", "pos").collect()] == ["2"]


@pytest.mark.parametrize(("reads", "writes", "committed"), [(["k"], ["j"], False), (["k"], [], True), ([], ["j"], True)])
def test_validation(spark, reads, writes, committed):
    txns = spark.createDataFrame([(1, 1, 4, reads, writes), (2, 2, 3, [], ["k"])], "txn long, read_ts long, commit_ts long, read_set array<string>, write_set array<string>")
    assert {r["txn"]: r["committed"] for r in mvcc.outcomes(txns).collect()} == {1: committed, 2: True}


def test_an_aborted_transaction_stops_nobody(spark):
    txns = spark.createDataFrame([(1, 0, 2, [], ["a"]), (2, 1, 3, ["a"], ["b"]), (3, 2, 4, ["b"], ["c"])], "txn long, read_ts long, commit_ts long, read_set array<string>, write_set array<string>")
    assert {r["txn"]: r["committed"] for r in mvcc.outcomes(txns).collect()} == {1: True, 2: False, 3: True}


def test_watermark(spark):
    readers = spark.createDataFrame([(3, 1), (3, -1), (5, 1)], "read_ts long, n long")
    assert mvcc.watermark(readers, 9).first()[0] == 5
    assert mvcc.watermark(readers.where("read_ts = 3"), 9).first()[0] == 9


def test_levels(spark):
    mib = compact.MIB
    assert compact.leveled_choice([0] * 6, 3) == {"upper": 0, "lower": 6, "bottom": True, "targets": [0, 0, 0, 0, 0, 64 * mib]}
    assert [t // mib for t in compact.leveled_choice([0] * 5 + [200 * mib], 3)["targets"]] == [0, 0, 0, 50, 100, 200]
    got = compact.level_targets(spark.createDataFrame([(1, 200 * mib)], "state int, bottom_bytes long"))
    assert [r["target"] // mib for r in got.orderBy("level").collect()] == [0, 0, 0, 50, 100, 200]
    assert compact.leveled_choice([0] * 6, 2) is None
    assert compact.leveled_choice([0, 0, 0, 0, 300 * mib, 200 * mib], 0)["upper"] == 5


def test_hash_and_bloom(spark):
    data = spark.createDataFrame([(bytearray.fromhex(h),) for h in HASHES], "b binary")
    assert {bytes(r["b"]).hex(): r["h"] for r in data.select("b", hash32("b").alias("h")).collect()} == HASHES
    keys = spark.range(1, 4).select(F.lit(0).alias("filter"), hash32(model.encode_u64("id")).alias("h"))
    assert bloom.bits_per_key(3, 0.01) == 10
    bits = bloom.build(keys, 10)
    data = bloom.to_bytes(bits, 10)
    assert bytes(data.first()["data"]).hex() == "0003006000000c00" + "06"
    assert rows(bloom.from_bytes(data).select("bit")) == rows(bits.select("bit"))
    assert all(r["may_contain"] for r in bloom.may_contain(keys, bits, 10).collect())


def test_layouts(spark):
    entries = [(b"apple", 2, b"red"), (b"apply", 1, b"x")]
    text = "000000056170706c650000000000000002000372656400040001790000000000000001000178000000160002"
    assert formats.block_bytes(entries).hex() == text and formats.block_rows(bytes.fromhex(text)) == entries
    df = spark.createDataFrame([(bytearray(k), t, bytearray(v)) for k, t, v in entries], "k binary, t long, v binary")
    made = df.select(F.collect_list(bytewise.block_entry(F.lit(b"apple"), F.col("k"), F.col("t"), F.col("v"))).alias("e"))
    first = df.select(F.lit(b"").alias("n"), bytewise.log_record(F.col("k"), F.col("t"), F.col("v")).alias("r")).first()
    assert bytes(first["r"]) == formats.log_bytes(entries[:1])
    whole = made.select(F.expr("concat(X'00000005', X'6170706c65')").alias("x")).first()
    assert bytes(whole["x"]).hex() == text[:18]
    assert formats.log_bytes([(b"a", 2, b"v1")]).hex() == "000161000000000000000200027631"
    logged = formats.log_bytes(entries)
    assert list(formats.log_records(logged)) == entries and list(formats.log_records(logged[:-1])) == entries[:1]
    with pytest.raises(formats.Damaged):
        list(formats.log_records(logged[:-1], torn_tail=False))
    with pytest.raises(ValueError):
        formats.block_bytes([])
    metas = [(0, (b"a", 1), (b"m", 2)), (100, (b"n", 3), (b"z", 4))]
    assert formats.meta_rows(formats.meta_bytes(metas)) == metas
    assert [formats.locate(metas, k) for k in (b"a", b"m", b"n", b"0", b"zz")] == [0, 0, 1, 0, 1]
    blocks = [entries[:1], entries[1:]]
    assert formats.sorted_file_rows(formats.sorted_file_bytes(blocks, b"\0" * 9)) == entries


def test_binary_files(spark, tmp_path):
    entries = [(b"a", 2, b"v1"), (b"b", 3, b"")]
    (tmp_path / "00001.wal").write_bytes(formats.log_bytes(entries))
    got = formats.read_logs(spark, f"{tmp_path}/*.wal").orderBy("key").collect()
    assert [(bytes(r["key"]), r["commit_ts"], bytes(r["value"])) for r in got] == entries


def test_cuts(spark):
    df = spark.createDataFrame([(0, i, "k", 10) for i in range(6)], "shard int, seq int, k string, n_bytes long")
    assert [r["memtable"] for r in layout.memtables(df, 20).orderBy("seq").collect()] == [0, 0, 1, 1, 2, 2]
    same = spark.createDataFrame([(0, k, t, -t, 10) for k, t in (("a", 2), ("a", 1), ("b", 3), ("c", 4))], "shard int, k string, cts int, neg_ts int, n_bytes long")
    assert [r["block"] for r in layout.blocks(same, 10).orderBy("k", "neg_ts").collect()] == [0, 0, 1, 2]


def test_script(spark):
    lines = ["fill 1 3", "put 7 hello big world", "get 7", "scan x 2", "delete 7", "get 7", "what", "put 8"]
    ops = script.parse(spark.createDataFrame(list(enumerate(lines)), "seq long, line string"))
    got = script.epochs(ops).orderBy("seq").collect()
    assert [r["valid"] for r in got] == [True, True, True, False, True, True, True, False]
    assert [r["epoch"] for r in got] == [0, 1, 2, 3, 3, 4, 5, 6]
    assert rows(script.gets(ops.where("valid"))) == [(2, 7, "hello big world"), (5, 7, None)]
