"""Each operator against brute force, an exact round trip or planted cases, and on odd tables."""

import base64
import hashlib
import html
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import decontaminate, html_extract, jaccard_join, language_id, quality_rules, secret_scan, sentence_pieces, shared, token_output, toxicity, warc

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "one", "The the THE", "İ ǅ é Ünïcode ﬁ　日本 🙂", "a\x01b\x00c ▁x", "x" * 5000, "word " * 3000]


def table(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = rng.choice("abcdefgh") * 3
        out.append(" ".join(w))
    return out


def brute_components(texts, n, percent):
    sets = []
    for t in texts:
        w = WORDS.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard_join_equals_brute_force(spark, n, percent):
    rng = random.Random(n)
    texts = list(ODD)
    for size, copies, edits in ((40, 60, 3), (120, 60, 8), (12, 20, 1), (300, 15, 12)):
        base = ["".join(rng.choices("klmnopqrstu", k=4)) for _ in range(size)]
        texts += near_copies(rng, base, copies, edits)
        texts += [" ".join(base)] * 5 + [" ".join(base[: size * 9 // 10]), " ".join(base).upper()]
    texts += [" ".join("".join(rng.choices("ab", k=2)) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    got = by_id(jaccard_join.similar_groups(table(spark, texts), shingle=n, percent=percent))
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == brute_components(texts, n, percent)


def test_signatures_meet_for_every_link():
    rng = np.random.default_rng(5)
    bands = jaccard_join.Bands(0.85)
    for _ in range(400):
        m = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**64 - 1, m, dtype=np.uint64))
        both = len(a)
        drop = int(rng.integers(0, both - int(np.ceil(0.85 * both)) + 1))
        add = int(max(0, (both - drop) / 0.85 - both))
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**64 - 1, int(rng.integers(0, add + 1)), dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if common / (len(a) + len(b) - common) < 0.85:
            continue
        shared_sigs = Counter(int(x) & 255 for x in np.intersect1d(jaccard_join.signatures(a, bands), jaccard_join.signatures(b, bands)))
        drops = [dict(jaccard_join.droppable(s, bands)) for s in (a, b)]
        assert any(n > max(d.get(j, 0) for d in drops) for j, n in shared_sigs.items())
        difference = len(a) + len(b) - 2 * common
        assert jaccard_join.least_difference(jaccard_join.sketch(a), jaccard_join.sketch(b)) <= difference


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(1, 40)] + [(100, 101), (None, 5), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in shared.components(edges, shared.shared_dir(spark)).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100}


def test_token_files(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [*ODD, "it's WE'LL <|endoftext|>x 123 ΑΣ $$$", None]
    docs = table(spark, texts).unionByName(spark.createDataFrame([(None, "lost", "en", "s", 4)], SCHEMA)).repartition(3)
    manifest = token_output.write(docs, shared.shared_dir(spark), path, end_id=2, ids_per_file=500)
    assert manifest.count() > 1
    hf, at = Tokenizer.from_file(path), 0
    rows = sorted(token_output.read(manifest).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))
    for r in rows:
        text = "lost" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        ids = [*hf.encode(text, add_special_tokens=False).ids, 2]
        assert np.frombuffer(r["ids_le"], "<u4").tolist() == ids and (r["start"], r["n_tokens"]) == (at, len(ids))
        at += len(ids)


def test_directly_addressable_codes():
    rng = np.random.default_rng(1)
    ids = (rng.integers(0, 2**32, 5000, dtype=np.uint64) >> rng.integers(0, 32, 5000, dtype=np.uint64)).astype(np.uint32)
    codes = token_output.Codes(token_output.encode([5, None], np.array([4000, 1000]), ids))
    assert (codes.all() == ids).all() and all(codes[i] == ids[i] for i in range(5000)) and codes.doc_ids == [5, None]
    body = bytearray(token_output.encode([1], np.array([2]), ids[:2]))
    body[40] ^= 1
    with pytest.raises(ValueError):
        token_output.Codes(bytes(body))


def test_toxicity(spark):
    rng = random.Random(3)
    clean = ["".join(rng.choices(["the", "ing", "er", "on", "ta"], k=2)) for _ in range(150)]
    bad = ["moronic", "scumbag", "pathetic", "worthless", "disgusting"]
    rows, labels = [], []
    for i in range(700):
        words = rng.choices(clean, k=60)
        if i % 5 == 0:
            words[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, marks)
    asked = ["the ing moronic on ta", "you p@th3tic thing", "w0rthless ta", "s c u m b a g the", "disguuuusting", "the ta on ing", "$$$ 123 the***"]
    got = by_id(toxicity.score(table(spark, asked + ODD).withColumn("score", F.lit("clash")), model))
    assert [got[i]["score"] >= 0.3 for i in range(7)] == [True] * 5 + [False] * 2
    assert all(0 <= got[i]["score"] < 0.3 for i in range(7, 7 + len(ODD)))
    blank = toxicity.learn(docs.limit(0), marks.limit(0))
    assert toxicity.score(table(spark, ["x"]), blank).count() == 1


def test_letters_are_counted_over_all_documents(spark):
    texts = ["biot it"] * 20 + ["blot it"] * 200  # only the first 20 have labels
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    for sample_rows in (8_000, 5):
        letters = toxicity.learn(docs, labels, sample_rows=sample_rows).letters
        assert letters.restore("b1ot") == "blot" and abs(letters.cost["^bi"] + np.log((20 + 0.1) / (220 + 2.7))) < 1e-9


def test_restoring():
    letters = toxicity.Letters(Counter(g for w in ["idiot", "moron", "scum", "clown"] for g in (f"^^{w}^"[i : i + 3] for i in range(len(w) + 1))))
    assert [letters.restore(x) for x in ("1d10t", "m.o.r.o.n", "$cum", "cl0wn", "iiidiot")] == ["idiot", "moron", "scum", "clown", "idiot"]


def test_quality_rules_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [*ODD, *(" ".join(rng.choices("abc", k=rng.randrange(50))) + rng.choice(["", "\nab\nab\n \n", " ### $|"]) for _ in range(80))]
    got = by_id(quality_rules.judge(table(spark, texts).withColumn("kept", F.lit(1)), least_repeat=3))
    for i, t in enumerate(texts):
        w, r = WORDS.findall(t or ""), got[i]
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        count = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        twice = {p for k in range(len(w) - 7) if count[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        failed = len(w) < 20 or 100 * len(twice) > 30 * len(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(twice), failed)
        if len(w) < 100:
            reach = [max((next((k for k in range(len(w)) if max(a, b) + k >= len(w) or w[a + k] != w[b + k]), 0) for b in range(len(w)) if b != a), default=0) for a in range(len(w))]
            covered = {p for a, n in enumerate(reach) if n >= 3 for p in range(a, a + n)}
            assert (r["longest_repeat"], r["covered_words"]) == (max(reach, default=0), len(covered))
            assert {p for s in r["spans"] for p in range(s["start"], s["stop"])} == covered


def test_warc(spark):
    pages = [(1, "http://a/1", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u\n v", None), (4, "u", ""), (4, "u", ""), (5, "u", "é" * 9000), (None, "u", "<p>x</p>"), (None, "u", "alone")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha", F.lit("clash")).repartition(3)
    got = []
    for roll in (1, 1 << 20):
        manifest = warc.write(df, shared.shared_dir(spark), roll_bytes=roll)
        got.append(sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(manifest).collect()), key=str))
    first, want = {}, []
    for p, _, h in sorted(pages, key=lambda x: (x[0] is None, x[0] or 0)):
        b = (h or "").encode()
        to = first.get(b)
        if p is not None:
            first.setdefault(b, p)
        want.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if to is None else "revisit", to))
    assert got[0] == got[1] == sorted(want, key=str)
    member = zlib.decompressobj(31).decompress(warc.record(1, "u", b"payload", None))
    with pytest.raises(ValueError):
        warc.parse(member.replace(b"payload", b"paylord"))
    assert warc.read(warc.write(df.limit(0), shared.shared_dir(spark))).count() == 0


def test_languages(spark):
    rng = random.Random(6)
    parts = {"xx": ["ka", "ro", "mi", "tu"], "yy": ["sch", "ein", "öd", "ung"], "zz": ["é", "aux", "tion", "le"]}
    word = lambda lang: "".join(rng.choices(parts[lang], k=3))
    rows = [(i, " ".join(word(lang) for _ in range(30)), lang) for i, lang in enumerate(list(parts) * 60)]
    models = language_id.learn(spark.createDataFrame([*rows, (999, None, None)], "doc_id long, text string, lang string"))
    assert models.langs == sorted(parts)
    asked = [" ".join(word("yy") for _ in range(9)), " ".join([*(word("xx") for _ in range(60)), *(word("zz") for _ in range(30))]), "123 $$$ …", "ß"]
    got = by_id(language_id.predict(table(spark, asked + ODD), models, carry=("doc_id", "text", "source")))
    assert [got[i]["lang_pred"] for i in range(3)] == ["yy", "xx", "und"] and got[3]["lang_pred"] != "und"
    assert {m["lang"] for m in got[1]["mixture"]} == {"xx", "zz"} and abs(got[1]["score"] - 2 / 3) < 0.1
    assert [got[4 + i]["lang_pred"] == "und" for i in range(3)] == [True] * 3 and got[0]["text"] == asked[0]
    nothing = language_id.learn(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in language_id.predict(table(spark, asked), nothing).collect()} == {"und"}


def test_mixtures_of_all_languages(spark):
    rng = random.Random(16)
    parts = {"uu": ["ka", "ro"], "vv": ["sch", "ein"], "ww": ["é", "aux"], "xx": ["iz", "oj"], "yy": ["pf", "um"]}
    word = lambda lang: "".join(rng.choices(parts[lang], k=4))
    rows = [(i, " ".join(word(lang) for _ in range(30)), lang) for i, lang in enumerate(list(parts) * 60)]
    models = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [" ".join(word(lang) for lang in list(parts)[:n] for _ in range(30)) for n in range(1, 6)]
    got = by_id(language_id.predict(table(spark, asked), models))
    for n in range(1, 6):
        assert {m["lang"] for m in got[n - 1]["mixture"]} == set(list(parts)[:n]) and abs(got[n - 1]["score"] - 1 / n) < 0.05


def test_secrets(spark):
    key = "aZ3kQ9xT7pLm2VbR8sWd5YcG"
    texts = [*ODD, 'é Password = "hunter2hunter2" token:short AKIAABCDEFGHIJKL12 ' + "0a1b2c3d" * 5, f"my {key} here", "token=secret=abcdefghij token: secret: abcdefghij", "some_long_identifier_name_2024_backup", "deadbeef" * 4 + "g", "é\x01passwd:abcdefgh"]
    labelled = spark.createDataFrame([("".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=32)), True) for i in range(200)] + [(w, False) for w in ["some_long_identifier_name", "backup_2024", "another_value", "getTableName"] * 50], "token string, random boolean")
    docs = table(spark, texts).withColumn("found", F.lit("clash"))
    got = secret_scan.scan(docs, secret_scan.learn(labelled))
    rows = by_id(got.withColumn("clean", secret_scan.redacted(F.col("text"), F.col("found"))))
    keys = r"[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    for i, t in enumerate(texts):
        t = t or ""
        want = [("assign", m.start(), m.end()) for m in re.finditer(rf"""(?:{keys})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 8]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 16] + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 32]
        have = [(x["kind"], x["start"], x["end"]) for x in rows[i]["found"]]
        assert [h for h in have if h[0] != "random"] == sorted(want, key=lambda x: x[1]) and (rows[i]["clean"] == texts[i]) == (not have)
    at = len(ODD) + 1
    assert [(x["kind"], texts[at][x["start"] : x["end"]]) for x in rows[at]["found"]] == [("random", key)] and rows[at]["clean"] == "my [secret] here"
    assert rows[len(ODD) + 3]["found"] == []
    assert secret_scan.learn(labelled.limit(0)).ratio[:3] == [0.0] * 3


def test_sentence_pieces(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*ODD, "a  b\n\n c ", " lead", "\n", "x\r\ny  ", "<s> </s>"]
    got = by_id(sentence_pieces.encode(table(spark, texts).withColumn("ids", F.lit(1)), path))
    for i, t in enumerate(texts):
        ids = [*sp.encode(t or ""), sp.eos_id()]
        assert (got[i]["ids"], got[i]["decoded"]) == (ids, sp.decode(ids))


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></ul></nav><div class="ad">Buy this, now, please do it today</div>
<article><h1>Head &amp; line</h1><p><b>Unclosed, bold<br><p>Two   spaces,&nbsp;here and a longer text to count</p><ul><li>one<li>two</ul><div id="comments"><p>bad, long reader comment that must not be kept</p></div></article>
<footer>&copy; someone</footer></body></html>"""


def test_html(spark):
    assert html_extract.extract(PAGE) == "Head & line\nUnclosed, bold\nTwo spaces, here and a longer text to count\none\ntwo"
    plain = "<body><header>Site</header><div><p>" + "A sentence, with commas, of some length. " * 5 + "</p><p>Short.</p></div><div class='sidebar'><p>side, text, with commas enough to score points</p></div><form><p>form, text</p></form>"
    assert html_extract.extract(plain) == ("A sentence, with commas, of some length. " * 5).strip() + "\nShort."
    pages = [(0, "u", None), (1, None, ""), (2, "u", "just &lt;text&gt;"), (3, "u", "<p>" * 3000 + "x"), (4, "u", "<" * 2000), (5, "u", "<a href='unclosed>" + "y " * 500), (None, "u", PAGE), (6, "u", "<b>" * 5000 + "deep")]
    got = {r["page_id"]: r for r in html_extract.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()}
    assert (got[0]["text"], got[1]["text"], got[2]["text"], got[3]["text"], got[6]["text"]) == ("", "", "just <text>", "x", "deep")
    assert got[None]["text"] == html_extract.extract(PAGE) and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html.unescape("&amp;") == "&"


@pytest.mark.parametrize("literals", [20_000, 3])
def test_decontamination_equals_brute_force(spark, literals):
    rng = random.Random(8)
    pool = ["alpha", "Beta", "gamma", "delta", "Épsilon", "zeta", "eta", "theta"]
    say = lambda n: " ".join(rng.choices(pool, k=n))
    items = [say(20), say(13), say(5), "", None, "unique words here", "beta beta beta"]
    items.append(items[0])
    texts = [*ODD, *(say(rng.randrange(40)) for _ in range(30)), f"{say(30)}, {items[0].upper()}; {say(9)}", items[1] * 2, "x " * 300 + items[2], " ".join(["filler"] * 200) + " Unique/words-here", items[0], "beta beta beta beta beta"]
    df = spark.createDataFrame([*((i, t) for i, t in enumerate(items)), (None, "zeta zeta zeta")], "item_id long, text string")
    got = by_id(decontaminate.contamination(table(spark, texts).withColumn("words", F.lit(1)), df, most_literals=literals))
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in [*enumerate(items), (None, "zeta zeta zeta")]:
        w = cut(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(i)
    for i, t in enumerate(texts):
        w, hit, found = cut(t), set(), set()
        for win, of in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found |= of
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) == (len(w), len(hit), sorted(str(x) for x in found if x is not None), bool(hit) and 20 * len(hit) >= len(w))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([], "item_id long, text string")
    assert jaccard_join.similar_groups(none).count() == 0
    assert token_output.read(token_output.write(none, shared.shared_dir(spark), public_tokenizers.path("word_bpe_49k.json"))).count() == 0
    assert quality_rules.judge(none).count() == 0 and sentence_pieces.encode(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    assert decontaminate.contamination(none, items).count() == 0 and decontaminate.contamination(table(spark, ["a b"]), items).first()["n_hit"] == 0
    assert secret_scan.scan(none, secret_scan.learn(secret_scan.samples(none))).count() == 0
    assert html_extract.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    parts = {"xx": ["ka", "ro", "mi", "tu", "pe"], "yy": ["sch", "ein", "öd", "ung", "te"]}
    text = lambda lang, n: " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(n))
    docs = [(i, text(lang, 60), lang, "s", 0) for i, lang in enumerate(["xx", "yy"] * 20)]
    item = text("xx", 30)
    docs += [(100, docs[0][1], "xx", "s", 0), (101, docs[1][1] + " tail", "yy", "s", 0), (102, "123 456", None, "s", 0), (103, None, None, "s", 0), (104, text("xx", 20) + " " + item, "xx", "s", 0), (105, text("yy", 40) + ' password = "abcdefgh1234"', "yy", "s", 0)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, now = None, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = shared.written(stage(spark, now, str(tmp_path)), shared.shared_dir(spark), name)
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids = {r["doc_id"] for r in now.select("doc_id").collect()}
        gone = {"language": {102, 103}, "near_duplicates": {100, 101}, "decontamination": {104}, "secrets": set()}[name]
        assert ids == ({d[0] for d in docs} if kept is None else kept) - gone
        kept = ids
    assert by_id(now)[105]["text"].endswith(" [secret]\"")
    out = by_id(corpus_pipeline.run(spark, str(tmp_path)))
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert set(out) == kept and all(out[i]["ids"] == [*sp.encode(r["text"]), 2] for i, r in by_id(now).items())
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])


def test_pipeline_rejects_texts_without_a_language(spark):
    import corpus_pipeline

    rng = random.Random(19)
    parts = {"uu": ["ka", "ro", "mi"], "vv": ["sch", "ein", "öd"], "ww": ["é", "aux", "tion"], "xx": ["iz", "oj", "bu"]}
    word = lambda some: "".join(rng.choices(some, k=3))
    docs = [(i, " ".join(word(parts[lang]) for _ in range(40)), lang, "s", 0) for i, lang in enumerate(list(parts) * 20)]
    docs += [(100, " ".join(word(parts["uu"]) for _ in range(40)) + ' password = "abcdefgh1234"', None, "s", 0), (101, " ".join(word(parts["vv"]) for _ in range(3)), None, "s", 0)]
    docs += [(102, " ".join(word(parts[lang]) for lang in list(parts)[:2] for _ in range(20)), None, "s", 0)]
    four = [" ".join(word(parts["uu"]) for _ in range(4)) for _ in range(2)]
    docs += [(103, ' token = "b64b244acde2e3b0aa8f051af1ec018ebaba3add" '.join(four), None, "s", 0)]
    clean = {d[0] for d in docs}
    docs += [(200, " ".join(word(p) for p in parts.values() for _ in range(20)), None, "s", 0)]  # four languages in equal parts
    docs += [(201, " ".join(word(["gwyd", "llan", "ych"]) for _ in range(40)), None, "s", 0)]  # a language that isn't learned
    docs += [(202, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(40)), None, "s", 0)]
    kept = corpus_pipeline.language(spark, spark.createDataFrame(docs, SCHEMA), "")
    assert {r["doc_id"] for r in kept.collect()} == clean
