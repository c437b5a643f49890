"""The models on labelled samples that they haven't seen, on keys and identifiers of other makes, and long texts."""

import base64
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import secret_scan

IDENTIFIERS = """getUserAccountBalance2024Report calculateTotalRevenueForQuarter some_long_identifier_name_2024_backup MAX_CONNECTION_TIMEOUT_SECONDS
application-settings-production-v2 src/main/java/com/example/service org_apache_spark_sql_functions test_compaction_changes_no_result InternationalizationConfiguration2
customer_order_line_items_2023 docker-compose-production-override usr/local/share/applications handleSubmitButtonClickEvent update_user_profile_picture_url
HTTP2ConnectionPoolManager getElementsByClassName2 default_shuffle_partitions_200 backup-2024-03-17-database-full DeviceInformationService3 XMLHttpRequestProgressEvent
parseJSONResponseBody findAllByCustomerIdAndStatus2 kubernetes-ingress-nginx-controller AbstractSingletonProxyFactoryBean report_final_version_2_reviewed
invoice-2023-000417-customer numberOfActiveSessions2022 AUTHENTICATION_BACKEND_CLASS spring-boot-starter-data-jpa node_modules/react-dom/index build/outputs/apk/release/app""".split()
VERBS, NOUNS = "get set update remove parse render validate load".split(), "account invoice session message customer product payment address window report".split()
WORDS = (*VERBS, *NOUNS, *"the request was sent with another value because their server could not answer before timeout when every client is waiting".split())


def ordinary():
    """100 identifiers."""
    rng = random.Random(11)
    out = list(IDENTIFIERS)
    while len(out) < 100:
        a, b, c, n = rng.choice(VERBS), rng.choice(NOUNS), rng.choice(NOUNS), rng.randrange(3000)
        out.append(rng.choice([f"{a}{b.title()}{c.title()}V{n}", f"{a}_{b}_{c}_{n}", f"{a}-{b}-{c}-service", f"{a}/{b}/{c}/index", f"{a}_{b}_{c}".upper()]))
    return [x if len(x) >= 16 else f"{x}_identifier" for x in out]


def keys():
    rng = random.Random(4)
    small, large, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    out = ["".join(rng.choices(alphabet, k=24)) for alphabet in (small + large + digits, small + digits, large + digits, "0123456789abcdef") for _ in range(50)]
    return out + [base64.b64encode(rng.randbytes(24)).decode() for _ in range(50)]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(WORDS, k=rng.randrange(20, 80))) + rng.choice(["", " token=abc123def456"]) for _ in range(600)]
    docs = spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id long, text string")
    return secret_scan.samples(docs).persist()


def test_held_out_precision_and_recall(labelled):
    half = F.pmod(F.xxhash64("token"), F.lit(2))
    models = secret_scan.learn(labelled.where(half == 0))
    held = labelled.where((half == 1) & (F.length("token") >= 16)).distinct()
    got = {(r["random"], r["p"]): r["n"] for r in held.select("random", models.random(F.col("token")).alias("p")).groupBy("random", "p").agg(F.count("*").alias("n")).collect()}
    true, false, missed = (got.get(k, 0) for k in ((True, True), (False, True), (True, False)))
    assert got[False, False] > 200 and true / (true + false) >= 0.9 and true / (true + missed) >= 0.9


def test_keys_are_found_and_identifiers_are_not(spark, labelled):
    models = secret_scan.learn(labelled)
    rows = [(i, f"see {x} there") for i, x in enumerate([*ordinary(), *keys()])]
    got = {r["doc_id"]: [(x["kind"], r["text"][x["start"] : x["end"]]) for x in r["found"]] for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), models).collect()}
    assert [got[i] for i in range(100)] == [[]] * 100
    found = [got[100 + i] == [("random", k)] for i, k in enumerate(keys())]
    assert sum(found) >= 0.9 * len(found)


def test_the_last_column_name_is_free(spark, labelled):
    docs = spark.createDataFrame([(1, "token=abcdefghij", "mine")], "doc_id long, text string, found string")
    row = secret_scan.scan(docs, secret_scan.learn(labelled), found="spans here").first()
    assert row["found"] == "mine" and [x["kind"] for x in row["spans here"]] == ["assign"]


def test_long_texts(spark, labelled):
    rng = random.Random(6)
    parts = [rng.choice(["token=abcdefgh1", "AKIAABCDEFGHIJKL", "deadbeef" * 4, "aZ3kQ9xT7pLm2VbR8sWd5YcG", "é plain words"]) for _ in range(20_000)]
    text = " ".join(parts)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    row = secret_scan.scan(docs, secret_scan.learn(labelled)).withColumn("clean", secret_scan.redacted(F.col("text"), F.col("found"))).first()
    assert time.perf_counter() - began < 30
    assert row["clean"] == " ".join("é plain words" if p.startswith("é") else "[secret]" for p in parts)
    assert [text[x["start"] : x["end"]] for x in row["found"]] == [p for p in parts if not p.startswith("é")]


def test_overlapping_spans_are_replaced_together(spark):
    spans = "array<struct<start: long, rank: int, end: long, kind: string>>"
    rng = random.Random(7)
    rows = []
    for i in range(60):
        text = "".join(rng.choices("abcé🙂", k=30))
        found = sorted((s, rng.randrange(4), rng.randrange(s + 1, 31), "x") for s in rng.choices(range(30), k=rng.randrange(6)))
        rows.append((i, text, found))
    got = spark.createDataFrame(rows, f"id long, text string, found {spans}").select("id", secret_scan.redacted(F.col("text"), F.col("found")).alias("r")).collect()
    for r in got:
        _, text, found = rows[r["id"]]
        out, at = "", 0
        for s, _, e, _ in found:
            if s >= at:
                out += text[at:s] + "[secret]"
            at = max(at, e)
        assert r["r"] == out + text[at:]


def test_runs_beside_rules(spark, labelled):
    models = secret_scan.learn(labelled)
    key = "aZ3kQ9xT7pLm2VbR8sWd5YcG"
    texts = [f"token={key}", f"x {key} {key} AKIA{'A1' * 8} {key}", f"{key}" + "0a1b2c3d" * 5, "=" * 40, "z" * 40, "1234567890" * 4]
    got = {r["doc_id"]: r["found"] for r in secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), models).collect()}
    kinds = {i: [x["kind"] for x in got[i]] for i in got}
    assert kinds == {0: ["assign"], 1: ["random", "random", "access", "random"], 2: ["hex"], 3: [], 4: [], 5: ["hex"]}
    assert all(not re.search(r"\s", texts[i][x["start"] : x["end"]]) for i in got for x in got[i])
