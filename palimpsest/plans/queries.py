"""The query catalogue over the sample tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest import model
from palimpsest.folders import shared_dir
from palimpsest.functions import bloom
from palimpsest.functions.bytewise import common_prefix
from palimpsest.functions.hash32 import hash32
from palimpsest.operators import compact, layout, merge, mvcc, read
from palimpsest.plans import script, shell
from palimpsest.sources import formats
from palimpsest.sources.store import Conflict, Store

L = "(SELECT user_id AS k, event_id + 1 AS cts, CASE WHEN event_type = 'error' THEN '' ELSE coalesce(props, '') END AS v FROM events)"
O = "(SELECT o_custkey AS k, o_orderkey + 1 AS cts, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END AS v FROM orders)"  # noqa: E741
R = "(SELECT max(event_id + 1) // 2 FROM events)"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def newest_sql(log: str, where: str = "true") -> str:
    return f"(SELECT k, cts, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY cts DESC) AS rn FROM {log} WHERE {where}) WHERE rn = 1)"


def _half(log: DataFrame) -> int:
    return model.last_ts(log) // 2


@query(f"SELECT k, cts, v FROM {newest_sql(L, f'cts <= {R} AND k BETWEEN 10 AND 100')} WHERE v <> ''")
def snapshot_scan(spark, d):
    log = model.events_log(spark, d)
    return read.snapshot(log, _half(log), 10, 100)


@query("SELECT DISTINCT user_id AS k, printf('%016X', user_id) AS key_hex, user_id AS decoded FROM events")
def key_encoding(spark, d):
    keys = model.table(spark, d, "events").select(F.col("user_id").alias("k")).distinct()
    return keys.select("k", F.hex(model.encode_u64("k")).alias("key_hex"), model.decode_u64(model.encode_u64("k")).alias("decoded"))


@query("SELECT range AS k, 'value' || range || '@7value' AS v FROM range(10, 5001)")
def fill_generator(spark, d):
    return model.fill(spark, 10, 5000, 7)


@query(f"SELECT k, cts, v FROM {newest_sql(L, f'cts <= {R} AND k = 11')} WHERE v <> ''")
def get_latest(spark, d):
    log = model.events_log(spark, d)
    return read.get(log, 11, _half(log))


@query(f"SELECT p.k, s.v FROM (SELECT range * 7 AS k FROM range(0, 300)) p LEFT JOIN (SELECT * FROM {newest_sql(L, f'cts <= {R}')} WHERE v <> '') s ON s.k = p.k")
def multi_get(spark, d):
    log = model.events_log(spark, d)
    return read.multi_get(log, spark.range(300).select((F.col("id") * 7).alias("k")), _half(log))


@query(f"SELECT count(*) AS n FROM {newest_sql(L, f'cts <= {R} AND k BETWEEN 10 AND 100')} WHERE v <> ''")
def scan_count(spark, d):
    log = model.events_log(spark, d)
    return read.count(log, 10, 100, _half(log))


@query(f"SELECT k, cts, v, row_number() OVER (PARTITION BY k ORDER BY cts DESC) AS version FROM {L}")
def version_history(spark, d):
    return read.history(model.events_log(spark, d))


@query(f"SELECT k, cts FROM {newest_sql(L, f'cts <= {R}')} WHERE v = ''")
def deleted_keys(spark, d):
    log = model.events_log(spark, d)
    return read.deleted(log, _half(log))


@query(
    f"WITH x AS (SELECT k, v FROM {newest_sql(L, f'cts <= {R} // 2')} WHERE v <> ''), y AS (SELECT k, v FROM {newest_sql(L, f'cts <= {R}')} WHERE v <> '') "
    "SELECT coalesce(x.k, y.k) AS k, x.v AS before, y.v AS after, CASE WHEN x.k IS NULL THEN 'added' WHEN y.k IS NULL THEN 'removed' ELSE 'changed' END AS change "
    "FROM x FULL JOIN y ON x.k = y.k WHERE x.v IS DISTINCT FROM y.v"
)
def live_keys_diff_two_snapshots(spark, d):
    log = model.events_log(spark, d)
    half = _half(log)
    return read.difference(log, half // 2, half)


@query(f"SELECT k, cts, v FROM {newest_sql(O, 'true')} WHERE v <> ''")
def orders_snapshot(spark, d):
    return read.snapshot(model.orders_log(spark, d))


@query(
    f"SELECT k, cts, src, v FROM (SELECT *, row_number() OVER (PARTITION BY k, cts ORDER BY src) AS rn FROM "
    f"(SELECT k, cts, (cts - 1) % 4 AS src, v || '/' || (cts - 1) % 4 AS v FROM {L} UNION ALL SELECT k, cts, cts % 4, v || '/' || cts % 4 FROM {L})) WHERE rn = 1"
)
def kway_merge_dedupe(spark, d):
    log = model.events_log(spark, d)
    copy = lambda src: log.select("k", "cts", src.alias("src"), F.concat_ws("/", "v", src.cast("string")).alias("v"))
    return merge.dedupe(copy((F.col("cts") - 1) % 4).unionByName(copy(F.col("cts") % 4))).select("k", "cts", "src", "v")


@query(
    f"WITH a AS (SELECT k, cts, v || '/a' AS v FROM {L} WHERE cts % 3 < 2), b AS (SELECT k, cts, v || '/b' AS v FROM {L} WHERE cts % 3 > 0) "
    "SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.k = b.k AND a.cts = b.cts)"
)
def two_way_prefer_a(spark, d):
    log = model.events_log(spark, d)
    tagged = lambda t: F.concat("v", F.lit(t)).alias("v")
    return merge.two_way(log.where("cts % 3 < 2").select("k", "cts", tagged("/a")), log.where("cts % 3 > 0").select("k", "cts", tagged("/b")))


FILES = f"(SELECT run, sst_id, min(k) AS first_key, max(k) AS last_key FROM (SELECT k, k % 3 AS run, k // 12 * 10 + cts % 2 AS sst_id FROM {L}) GROUP BY run, sst_id)"


@query(
    f"SELECT run, sst_id, first_key, last_key, coalesce(max(last_key) OVER (PARTITION BY run ORDER BY first_key, sst_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= first_key, false) AS overlaps FROM {FILES}"
)
def sorted_run_validate(spark, d):
    log = model.events_log(spark, d).select("k", (F.col("k") % 3).alias("run"), F.expr("k div 12 * 10 + cts % 2").alias("sst_id"))
    return merge.check_run(log.groupBy("run", "sst_id").agg(F.min("k").alias("first_key"), F.max("k").alias("last_key")))


@query(
    f"WITH loc AS (SELECT k, CASE WHEN cts % 5 = 0 THEN '' ELSE v || '/own' END AS v FROM {newest_sql(L, f'cts > {R} AND k % 3 = 0')}), base AS (SELECT k, v FROM {newest_sql(L, f'cts <= {R}')} WHERE v <> '') "
    "SELECT k, v, own FROM (SELECT coalesce(loc.k, base.k) AS k, CASE WHEN loc.k IS NULL THEN base.v ELSE loc.v END AS v, loc.k IS NOT NULL AS own FROM loc FULL JOIN base ON loc.k = base.k) WHERE v <> ''"
)
def txn_overlay(spark, d):
    log = model.events_log(spark, d)
    half = _half(log)
    own = read.newest(log.where((F.col("cts") > half) & (F.col("k") % 3 == 0)))
    local = own.select("k", F.when(F.col("cts") % 5 == 0, "").otherwise(F.concat("v", F.lit("/own"))).alias("v"))
    return merge.overlay(local, read.snapshot(log, half).select("k", "v"))


@query(f"SELECT batch, k, v FROM (SELECT *, row_number() OVER (PARTITION BY batch, k ORDER BY cts DESC) AS rn FROM (SELECT (cts - 1) // 10 AS batch, k % 8 AS k, cts, v FROM {L})) WHERE rn = 1")
def write_batch_last_wins(spark, d):
    log = model.events_log(spark, d).select(F.expr("(cts - 1) div 10").alias("batch"), (F.col("k") % 8).alias("k"), "cts", "v")
    return mvcc.last_in_batch(log, "batch", "k", "cts").select("batch", "k", "v")


@query("SELECT event_id, 2 * (row_number() OVER (ORDER BY event_id) - 1) + 1 AS read_ts, 2 * row_number() OVER (ORDER BY event_id) AS commit_ts FROM events WHERE event_type <> 'view'")
def clock_allocation(spark, d):
    return mvcc.clock(model.table(spark, d, "events").where("event_type <> 'view'").select("event_id"), "event_id")


T = "(SELECT event_id // 5 AS txn, greatest(min(event_id) - 20, 0) AS read_ts, max(event_id) + 1 AS commit_ts FROM events GROUP BY event_id // 5)"


def _txns(spark, d) -> DataFrame:
    events = model.table(spark, d, "events")
    return events.groupBy(F.expr("event_id div 5").alias("txn")).agg(
        F.greatest(F.min("event_id") - 20, F.lit(0)).alias("read_ts"), (F.max("event_id") + 1).alias("commit_ts"),
        F.collect_set(F.when(F.col("event_type") == "view", F.col("user_id"))).alias("read_set"),
        F.collect_set(F.when(F.col("event_type") != "view", F.col("user_id"))).alias("write_set"),
    )


@query(
    f"WITH r AS (SELECT read_ts, commit_ts - 3 AS closed_ts FROM {T} WHERE txn % 4 <> 1 AND commit_ts - 3 > read_ts), m AS (SELECT DISTINCT commit_ts AS ts FROM {T}) "
    "SELECT ts, coalesce(min(read_ts), ts) AS watermark FROM m LEFT JOIN r ON read_ts <= ts AND ts < closed_ts GROUP BY ts"
)
def watermark_timeline(spark, d):
    txns = _txns(spark, d)
    readers = txns.where("txn % 4 <> 1 and commit_ts - 3 > read_ts").select("read_ts", (F.col("commit_ts") - 3).alias("closed_ts"))
    return mvcc.watermarks(readers, txns.select(F.col("commit_ts").alias("ts")))


@query(f"SELECT txn, commit_ts FROM {T} WHERE commit_ts >= {R}")
def committed_prune(spark, d):
    return mvcc.prune(_txns(spark, d).select("txn", "commit_ts"), _half(model.events_log(spark, d)))


PAIRS = (
    f"(SELECT DISTINCT a.txn, b.txn AS blocker FROM (SELECT DISTINCT event_id // 5 AS txn, user_id FROM events WHERE event_type = 'view') ra JOIN {T} a ON a.txn = ra.txn "
    f"JOIN (SELECT DISTINCT event_id // 5 AS txn, user_id FROM events WHERE event_type <> 'view') wb ON wb.user_id = ra.user_id JOIN {T} b ON b.txn = wb.txn "
    "WHERE a.txn <> b.txn AND b.commit_ts > a.read_ts AND b.commit_ts < a.commit_ts AND a.txn IN (SELECT event_id // 5 FROM events WHERE event_type <> 'view'))"
)


@query(f"SELECT txn, blocker FROM {PAIRS}")
def occ_candidates(spark, d):
    return mvcc.conflicts(_txns(spark, d))


@query(
    f"WITH RECURSIVE p AS MATERIALIZED (SELECT txn, list(blocker) AS bys FROM {PAIRS} GROUP BY txn), o AS MATERIALIZED (SELECT txn, bys, row_number() OVER (ORDER BY txn) AS i FROM p), "
    "s(i, gone) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT o.i, CASE WHEN len(list_filter(o.bys, lambda b: NOT list_contains(s.gone, b))) > 0 THEN list_append(s.gone, o.txn) ELSE s.gone END FROM s JOIN o ON o.i = s.i + 1) "
    f"SELECT t.txn, NOT coalesce(list_contains((SELECT gone FROM s ORDER BY i DESC LIMIT 1), t.txn), false) AS committed FROM {T} t"
)
def occ_serial_outcome(spark, d):
    return mvcc.outcomes(_txns(spark, d))


OPS = "(SELECT event_id AS seq, CASE event_type WHEN 'view' THEN 'get' WHEN 'error' THEN 'delete' ELSE 'put' END AS cmd, user_id AS k, CASE event_type WHEN 'view' THEN NULL WHEN 'error' THEN '' ELSE props END AS v FROM events)"


def _ops(spark, d) -> DataFrame:
    cmd = F.when(F.col("event_type") == "view", "get").when(F.col("event_type") == "error", "delete").otherwise("put")
    value = F.when(F.col("event_type") == "error", "").when(F.col("event_type") != "view", F.col("props"))
    return model.table(spark, d, "events").select(F.col("event_id").alias("seq"), cmd.alias("cmd"), F.col("user_id").alias("k"), value.alias("v"))


@query(
    f"SELECT seq, k, nullif(last, '') AS v FROM (SELECT *, last_value(CASE WHEN cmd <> 'get' THEN v END IGNORE NULLS) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM {OPS}) WHERE cmd = 'get'"
)
def script_replay_asof_get(spark, d):
    return script.gets(_ops(spark, d))


@query("SELECT event_id AS seq, CAST(coalesce(sum(CASE WHEN value >= 10 THEN 1 ELSE 0 END) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS epoch FROM events")
def script_epoch(spark, d):
    ops = model.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.coalesce(F.col("value") >= 10, F.lit(False)).alias("valid"))
    return script.epochs(ops).select("seq", "epoch")


GC = f"(SELECT *, row_number() OVER (PARTITION BY k, cts <= {R} ORDER BY cts DESC) AS rn FROM {L})"


@query(f"SELECT k, cts, v FROM {GC} WHERE cts > {R} OR rn = 1")
def gc_non_bottom(spark, d):
    log = model.events_log(spark, d)
    return compact.collect_garbage(log, _half(log), bottom=False)


@query(f"SELECT k, cts, v FROM {GC} WHERE cts > {R} OR rn = 1 AND v <> ''")
def gc_bottom(spark, d):
    log = model.events_log(spark, d)
    return compact.collect_garbage(log, _half(log), bottom=True)


@query(f"SELECT DISTINCT k, cts, v FROM {L}")
def full_compaction(spark, d):
    log = model.events_log(spark, d)
    return merge.k_way([log.where("cts % 2 = 0"), log.where("cts % 3 = 0"), log]).select("k", "cts", "v")


META = (
    f"(SELECT sst_id, min(k) AS first_key, max(cts) FILTER (WHERE k = lo) AS first_ts, max(k) AS last_key, min(cts) FILTER (WHERE k = hi) AS last_ts, count(*) AS n_entries, CAST(sum(16 + strlen(v)) AS BIGINT) AS size_bytes, max(cts) AS max_ts "
    f"FROM (SELECT *, min(k) OVER (PARTITION BY sst_id) AS lo, max(k) OVER (PARTITION BY sst_id) AS hi FROM (SELECT *, k // 16 AS sst_id FROM {L})) GROUP BY sst_id)"
)


@query(f"SELECT * FROM {META}")
def sst_metadata(spark, d):
    return compact.files_of(model.events_log(spark, d), F.expr("k div 16"))


@query(
    f"WITH u AS (SELECT (cts - 1) // 7 AS id, min(k) AS lo, max(k) AS hi FROM {L} GROUP BY 1), l AS (SELECT k // 16 AS id, min(k) AS lo, max(k) AS hi FROM {L} GROUP BY 1) "
    "SELECT u.id AS upper_id, l.id AS lower_id FROM u JOIN l ON u.lo <= l.hi AND l.lo <= u.hi"
)
def sst_overlap(spark, d):
    log = model.events_log(spark, d)
    return compact.overlaps(compact.files_of(log, F.expr("(cts - 1) div 7")), compact.files_of(log, F.expr("k div 16")))


@query(f"SELECT sst_id, first_key, last_key FROM {META} WHERE last_key >= 40 AND first_key <= 90")
def sst_range_prune(spark, d):
    return compact.touching(compact.files_of(model.events_log(spark, d), F.expr("k div 16")), 40, 90).select("sst_id", "first_key", "last_key")


@query(
    "WITH RECURSIVE b AS (SELECT p_partkey AS state, CAST(p_size AS BIGINT) * 10 * 1048576 AS bottom FROM part), t(state, level, target) AS (SELECT state, CAST(6 AS BIGINT), greatest(bottom, 67108864) FROM b "
    "UNION ALL SELECT state, level - 1, CASE WHEN target > 67108864 THEN target // 2 ELSE 0 END FROM t WHERE level > 1) SELECT state, level, target FROM t"
)
def level_targets(spark, d):
    parts = model.table(spark, d, "part").select(F.col("p_partkey").alias("state"), (F.col("p_size").cast("long") * 10 * compact.MIB).alias("bottom_bytes"))
    return compact.level_targets(parts)


LEVELS = "(SELECT event_id // 50 AS state, level, count(*) FILTER (WHERE user_id % 4 = level) AS files FROM events, (SELECT range AS level FROM range(0, 4)) GROUP BY 1, 2)"


@query(
    f"SELECT state, min(level) AS upper, min(level) + 1 AS lower FROM (SELECT *, lead(files) OVER (PARTITION BY state ORDER BY level) AS nxt FROM {LEVELS}) "
    "WHERE nxt IS NOT NULL AND files > 0 AND nxt * 100 < files * 80 AND (level > 0 OR files >= 12) GROUP BY state"
)
def simple_level_choice(spark, d):
    counts = model.table(spark, d, "events").groupBy(F.expr("event_id div 50").alias("state")).agg(*(F.sum((F.col("user_id") % 4 == i).cast("long")).alias(f"l{i}") for i in range(4)))
    levels = counts.select("state", F.posexplode(F.array("l0", "l1", "l2", "l3")).alias("p", "files")).select("state", F.col("p").cast("long").alias("level"), "files")
    return compact.simple_choice(levels, trigger=12, ratio_percent=80)


@query(
    "SELECT sst_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY sst_id ORDER BY seq DESC) AS rn FROM (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'add' END AS type, "
    "CASE WHEN event_type = 'error' THEN event_id // 2 ELSE event_id // 3 END AS sst_id FROM events)) WHERE rn = 1 AND type = 'add'"
)
def manifest_replay(spark, d):
    removed = F.col("event_type") == "error"
    records = model.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.when(removed, "remove").otherwise("add").alias("type"), F.when(removed, F.expr("event_id div 2")).otherwise(F.expr("event_id div 3")).alias("sst_id"))
    return compact.replay(records)


# The hash of a key's eight bytes, written out: two words of four bytes (no rest), each in little-endian order.
_WORD = lambda shift: " + ".join(f"((k >> {56 - shift - 8 * j}) & 255) * {256**j}" for j in range(4))
_STEP = lambda h, w: f"CAST(({h} + {w}) % 4294967296 * CAST(3332679571 AS HUGEINT) % 4294967296 AS BIGINT)"
_HASHED = lambda keys: (
    f"(SELECT k, xor(m2, m2 >> 16) AS h FROM (SELECT k, {_STEP('h1', 'w2')} AS m2 FROM (SELECT k, w2, xor(m1, m1 >> 16) AS h1 FROM "
    f"(SELECT k, w2, {_STEP(f'xor(CAST(3164544308 AS BIGINT), CAST(8 * CAST(3332679571 AS HUGEINT) % 4294967296 AS BIGINT))', 'w1')} AS m1 "
    f"FROM (SELECT k, {_WORD(0)} AS w1, {_WORD(32)} AS w2 FROM ({keys}))))))"
)
KEYS = "SELECT DISTINCT user_id AS k FROM events"
HASH = _HASHED(KEYS)


def _hashes(keys: DataFrame) -> DataFrame:
    return keys.select("k", hash32(model.encode_u64("k")).alias("h"))


def _users(spark, d) -> DataFrame:
    return model.table(spark, d, "events").select(F.col("user_id").alias("k")).distinct()


@query(f"SELECT k, h FROM {HASH}")
def hash32_keys(spark, d):
    return _hashes(_users(spark, d))


BITS = (
    f"(SELECT DISTINCT f.filter, nbits, (f.h + i * ((f.h >> 17) | ((f.h << 15) & 4294967295))) % 4294967296 % nbits AS bit FROM (SELECT k % 7 AS filter, h FROM {HASH}) f "
    f"JOIN (SELECT k % 7 AS filter, (greatest(count(*) * 10, 64) + 7) // 8 * 8 AS nbits FROM {HASH} GROUP BY 1) n ON n.filter = f.filter, (SELECT range AS i FROM range(0, 6)))"
)


def _filters(spark, d) -> DataFrame:
    return bloom.build(_hashes(_users(spark, d)).select((F.col("k") % 7).alias("filter"), "h"), bloom.bits_per_key(1000, 0.01))


@query(f"SELECT filter, nbits, bit FROM {BITS}")
def bloom_bits(spark, d):
    return _filters(spark, d)


PROBES = _HASHED(f"{KEYS} UNION ALL SELECT k + 1000000007 FROM ({KEYS})")


@query(
    f"WITH b AS MATERIALIZED (SELECT * FROM {BITS}), n AS (SELECT filter, max(nbits) AS nbits FROM b GROUP BY 1), p AS (SELECT DISTINCT k % 7 AS filter, h FROM {PROBES}) "
    "SELECT p.filter, p.h, count(b.bit) = 6 AS may_contain FROM p LEFT JOIN n ON n.filter = p.filter CROSS JOIN (SELECT range AS i FROM range(0, 6)) "
    "LEFT JOIN b ON b.filter = p.filter AND b.bit = (p.h + i * ((p.h >> 17) | ((p.h << 15) & 4294967295))) % 4294967296 % n.nbits GROUP BY p.filter, p.h"
)
def bloom_probe(spark, d):
    users = _users(spark, d)
    probes = users.unionByName(users.select((F.col("k") + 1000000007).alias("k")))  # all keys, and as many that no filter holds
    return bloom.may_contain(_hashes(probes).select((F.col("k") % 7).alias("filter"), "h"), _filters(spark, d), bloom.bits_per_key(1000, 0.01))


def _sized(spark, d) -> DataFrame:
    log = model.events_log(spark, d)
    return log.select((F.col("k") % 16).alias("shard"), F.col("cts").alias("seq"), "k", (F.lit(16) + F.octet_length("v")).cast("long").alias("n_bytes"))


@query(
    f"WITH RECURSIVE o AS MATERIALIZED (SELECT k % 16 AS shard, cts AS seq, k, 16 + strlen(v) AS n, row_number() OVER (PARTITION BY k % 16 ORDER BY cts) AS i FROM {L}), "
    "s(shard, seq, k, i, size, memtable) AS (SELECT shard, seq, k, i, n, CAST(0 AS BIGINT) FROM o WHERE i = 1 UNION ALL SELECT o.shard, o.seq, o.k, o.i, CASE WHEN size >= 2000 THEN n ELSE size + n END, memtable + CASE WHEN size >= 2000 THEN 1 ELSE 0 END "
    "FROM s JOIN o ON o.shard = s.shard AND o.i = s.i + 1) SELECT shard, seq, k, memtable FROM s"
)
def memtable_freeze_points(spark, d):
    return layout.memtables(_sized(spark, d), 2000).select("shard", "seq", "k", "memtable")


@query(
    f"WITH RECURSIVE o AS MATERIALIZED (SELECT k % 16 AS shard, cts, k, 22 + strlen(v) AS n, row_number() OVER (PARTITION BY k % 16 ORDER BY k, cts DESC) AS i FROM {L}), "
    "s(shard, cts, k, i, size, block) AS (SELECT shard, cts, k, i, n, CAST(0 AS BIGINT) FROM o WHERE i = 1 UNION ALL SELECT o.shard, o.cts, o.k, o.i, CASE WHEN o.k = s.k OR size + n <= 1024 THEN size + n ELSE n END, "
    "block + CASE WHEN o.k = s.k OR size + n <= 1024 THEN 0 ELSE 1 END FROM s JOIN o ON o.shard = s.shard AND o.i = s.i + 1) SELECT shard, k, cts, block FROM s"
)
def block_packing(spark, d):
    rows = model.events_log(spark, d).select((F.col("k") % 16).alias("shard"), "k", "cts", (-F.col("cts")).alias("neg_ts"), (F.lit(22) + F.octet_length("v")).cast("long").alias("n_bytes"))
    return layout.blocks(rows, 1024).select("shard", "k", "cts", "block")


@query(f"SELECT CAST(sum(16 + strlen(v)) AS BIGINT) AS size_bytes FROM {L} WHERE cts > {R}")
def pending_size(spark, d):
    log = model.events_log(spark, d)
    return log.where(F.col("cts") > _half(log)).agg(F.sum(F.lit(16).cast("long") + F.octet_length("v")).alias("size_bytes"))


@query(
    "SELECT k, prev, CAST(CASE WHEN printf('%016X', k)[1:2] <> printf('%016X', prev)[1:2] THEN 0 ELSE list_max([CASE WHEN printf('%016X', k)[1 : 2 * i] = printf('%016X', prev)[1 : 2 * i] THEN i ELSE 0 END FOR i IN range(1, 9)]) END AS BIGINT) AS shared "
    "FROM (SELECT k, lag(k) OVER (PARTITION BY k % 16 ORDER BY k) AS prev FROM (SELECT DISTINCT user_id AS k FROM events)) WHERE prev IS NOT NULL"
)
def key_prefix_lengths(spark, d):
    keys = model.table(spark, d, "events").select(F.col("user_id").alias("k")).distinct()
    pairs = keys.withColumn("prev", F.lag("k").over(Window.partitionBy(F.col("k") % 16).orderBy("k"))).where("prev is not null")
    return pairs.select("k", "prev", common_prefix(model.encode_u64("k"), model.encode_u64("prev")).cast("long").alias("shared"))


# Queries that go through a store.


def _store(spark, **options) -> Store:
    return Store.open(spark, shared_dir(spark), **options)


def _rows(log: DataFrame) -> DataFrame:
    """key, value, pos of a store's large write."""
    return log.select(model.encode_u64("k").alias("key"), F.col("v").cast("binary").alias("value"), F.col("cts").alias("pos"))


def _parts(log: DataFrame, n: int) -> list[DataFrame]:
    """The log in n stretches of its time, all of it."""
    last = model.last_ts(log)
    bounds = [last * i // n for i in range(n + 1)]
    return [log.where((F.col("cts") > a) & (F.col("cts") <= b)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _live(rows: DataFrame) -> DataFrame:
    return rows.select(model.decode_u64("k").alias("k"), F.col("v").cast("string").alias("v"))


@query(f"SELECT k, v FROM {newest_sql(L)} WHERE v <> ''")
def store_writes_reopened(spark, d):
    """Large writes and deletes, one commit each, read by a store that was opened afterwards."""
    store = _store(spark, snapshot_every=2)
    for part in _parts(model.events_log(spark, d), 3):
        store.write(_rows(part))
    return _live(Store.open(spark, store.folder.path).scan())


@query(f"SELECT k, v FROM {newest_sql(L)} WHERE v <> ''")
def store_compaction_roundtrip(spark, d):
    """Leveled steps, full compactions and flushes between the writes change no read."""
    store = _store(spark, trigger=2, base_bytes=20_000, file_bytes=50_000)
    for i, part in enumerate(_parts(model.events_log(spark, d), 5)):
        store.write(_rows(part))
        if i == 1:
            store.compact_all()
        elif i > 1:
            store.compact()
    store.flush()
    return _live(Store.open(spark, store.folder.path).scan())


@query(f"SELECT k, v FROM {newest_sql(L, 'cts <= (SELECT max(event_id + 1) * 2 // 4 FROM events)')} WHERE v <> ''")
def store_snapshot_held(spark, d):
    """A transaction that began halfway reads its snapshot, although later writes and garbage collection have come since."""
    store, parts = _store(spark, trigger=2), _parts(model.events_log(spark, d), 4)
    for part in parts[:2]:
        store.write(_rows(part))
    held = store.begin()
    for part in parts[2:]:
        store.write(_rows(part))
    while store.compact():
        pass
    return _live(held.scan().select("k", "v"))


@query(f"SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(8 + 8 + strlen(v)) AS BIGINT) AS n_bytes FROM (SELECT k, part, v FROM (SELECT k, v, part, row_number() OVER (PARTITION BY k, part ORDER BY cts DESC) AS rn FROM (SELECT *, (cts > (SELECT max(event_id + 1) // 2 FROM events)) AS part FROM {L})) WHERE rn = 1)")
def store_dump(spark, d):
    """What the manifest says of the files of two writes: each has a key's last value."""
    store = _store(spark)
    for part in _parts(model.events_log(spark, d), 2):
        store.write(_rows(part))
    return store.dump().agg(F.sum("n").alias("n_rows"), F.sum("size").alias("n_bytes"))


@query(f"SELECT k, CAST(count(*) AS BIGINT) AS versions FROM (SELECT DISTINCT k, part FROM (SELECT k, least((cts - 1) * 4 // (SELECT max(event_id + 1) FROM events), 3) AS part FROM {L})) GROUP BY k")
def store_simple_compaction(spark, d):
    """Whole levels go into the next, merged only: every version stays."""
    store, log = _store(spark, strategy="simple", trigger=2, ratio_percent=100), model.events_log(spark, d)
    last = model.last_ts(log)
    for i in range(4):
        store.write(_rows(log.where(f"least((cts - 1) * 4 div {last}, 3) = {i}")))
        while store.compact():
            pass
    return store.versions().groupBy(model.decode_u64("k").alias("k")).agg(F.count("*").alias("versions"))


N = "(SELECT n_nationkey AS i, n_regionkey AS r, n_name AS name FROM nation)"


@query("SELECT 'region ' || n_regionkey AS k, CAST(count(*) + 100 AS VARCHAR) AS v FROM nation GROUP BY n_regionkey")
def store_transactions(spark, d):
    """Counters that transactions read and write, one for each nation; then two at once for each region, of which one fails."""
    store = _store(spark)
    nations = model.table(spark, d, "nation").select("n_regionkey").orderBy("n_nationkey").collect()
    for (r,) in nations:
        with store.begin() as txn:
            txn.put(f"region {r}", str(int(txn.get(f"region {r}") or 0) + 1))
    for r in sorted({r for (r,) in nations}):
        first, second = store.begin(), store.begin()
        for txn, more in ((first, 100), (second, 1000)):
            txn.put(f"region {r}", str(int(txn.get(f"region {r}")) + more))
        first.commit()
        try:
            second.commit()
        except Conflict:
            continue
    return store.scan().select(F.col("k").cast("string").alias("k"), F.col("v").cast("string").alias("v"))


@query(f"SELECT name AS k, CASE WHEN r = 2 THEN 'second' ELSE 'first' END AS v FROM {N} WHERE r <> 3")
def store_log_replay(spark, d):
    """Small batches in memory tables that are frozen and flushed as they fill; a store opened later replays the logs."""
    store = _store(spark, flush_bytes=150, tables=3)
    nations = [tuple(r) for r in model.table(spark, d, "nation").select("n_name", "n_regionkey").orderBy("n_nationkey").collect()]
    store.write_batch([n for n, _ in nations], ["first"] * len(nations))
    for name, r in nations:
        if r in (2, 3):
            (store.delete if r == 3 else lambda k: store.put(k, "second"))(name)
    again = Store.open(spark, store.folder.path)
    return again.scan().select(F.col("k").cast("string").alias("k"), F.col("v").cast("string").alias("v"))


@query(f"SELECT k, cts, v FROM {L}")
def sorted_file_roundtrip(spark, d):
    """The log as binary sorted files of blocks, a file for 16 keys, and read back from their bytes."""
    log = model.events_log(spark, d)
    rows = log.select(F.expr("k div 16").alias("file"), model.encode_u64("k").alias("key"), F.col("cts").alias("commit_ts"), F.col("v").cast("binary").alias("value"))
    back = formats.unpacked(formats.packed(rows, "file", block_bytes=1024))
    return back.select(model.decode_u64("key").alias("k"), F.col("commit_ts").alias("cts"), F.col("value").cast("string").alias("v"))


@query(f"SELECT k, v FROM {newest_sql(L, 'k BETWEEN 20 AND 60')} WHERE v <> ''")
def store_range_scan(spark, d):
    """A range of keys from sorted files of several levels; files outside the range aren't opened."""
    store = _store(spark, file_bytes=20_000)
    for part in _parts(model.events_log(spark, d), 2):
        store.write(_rows(part))
        store.compact_all()
    return _live(store.scan(20, 60))


@query("SELECT n_name AS k, n_nationkey || CASE WHEN n_regionkey = 1 THEN ' not exist' ELSE '=' || n_name || ' of region ' || n_regionkey END AS answer FROM nation")
def shell_session(spark, d):
    """Every nation is put, those of a region are deleted, and each is asked for, as lines of commands."""
    nations = [tuple(r) for r in model.table(spark, d, "nation").select("n_nationkey", "n_regionkey", "n_name").orderBy("n_nationkey").collect()]
    lines = [f"put {i} {name} of region {r}" for i, r, name in nations] + [f"delete {i}" for i, r, _ in nations if r == 1] + [f"get {i}" for i, _, _ in nations]
    answers = list(shell.run(_store(spark), lines))[-len(nations) :]
    return spark.createDataFrame([(name, a) for (_, _, name), a in zip(nations, answers, strict=True)], "k string, answer string")


@query(f"SELECT filter, nbits, bit FROM {BITS}")
def bloom_bytes_roundtrip(spark, d):
    return bloom.from_bytes(bloom.to_bytes(_filters(spark, d), bloom.bits_per_key(1000, 0.01)))


@query(f"SELECT printf('%016X', k) || '@' || cts AS shown, printf('%016X', k) AS key_hex, cts FROM {L}")
def versioned_keys(spark, d):
    """Keys with their timestamps, encoded and decoded, and as text."""
    log = model.events_log(spark, d).select(model.encode_u64("k").alias("key"), "cts")
    key, cts = model.decode_versioned(model.encode_versioned("key", "cts"))
    return log.select(model.key_text("key", "cts").alias("shown"), F.hex(key).alias("key_hex"), cts.alias("cts"))
