"""Secrets in texts: fixed rules, and random strings found by character Markov models, in DataFrame functions only.

Two Markov chains over characters are learned from labelled samples, one of random strings and one of ordinary identifiers.
A run of token characters is a secret where the log-likelihood ratio of the two over its transitions is above a bound, in sum
and a transition. Random samples are the values of the rules' matches and digests in the usual alphabets; identifiers are
words of the corpus, put together as people do (camelCase, snake_case, kebab-case, paths, with numbers)."""

from __future__ import annotations

import math
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The three base rules: kind, pattern of a match, pattern that a text must hold for one to stand. Fixed values.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
#: Runs that the models judge: of so many token characters, so many different ones, and so many letters and digits.
LEAST, DIFFERENT, ALPHANUMERIC = 16, 8, 12
RUN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}+"
KINDS = ("assign", "access", "hex", "random")
#: Rows from which the samples are drawn, about: a bounded sample, chosen by a hash of doc_id.
SAMPLE_ROWS = 5_000
#: Log-likelihood ratios (in nats) from which a run is a secret: in sum, and a transition.
BOUND, RATE = 10.0, 0.35
FIRST, LAST = 33, 126  # characters of the models
MARK, OTHER = "\x01", "\x02"
#: Weights of a pair of characters, of a character behind a kind of character, and of any token character.
PAIR, KIND, ANY = 0.7, 0.2, 0.1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each value of an array the step (a sum, a maximum) over it and all before: log2(n) passes over the array."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int"))

    def double(a: Column, k: Column) -> Column:
        back = F.shiftleft(F.lit(1), k) if isinstance(k, int) else F.call_function("shiftleft", F.lit(1), k)
        return F.transform(a, lambda x, i: F.when(i >= back, step(x, F.get(a, i - back))).otherwise(x))

    return F.aggregate(rounds, values, double)


def _clean(text: Column) -> Column:
    """The mark that shows matches becomes another character that no rule knows."""
    return F.when(F.instr(text, MARK) > 0, F.translate(text, MARK, OTHER)).otherwise(text)


def _matches(text: Column, pattern: str, present: Column, stands: Callable[[Column], Column] | None = None) -> Column:
    """Start, end and text of the leftmost non-overlapping matches that stand, by code points, in nearly linear time."""
    kind = "array<struct<s: long, e: long, m: string>>"
    parts = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)  # every second part is a match

    def told(p: Column, ends: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            take = i % 2 == 1 if stands is None else (i % 2 == 1) & stands(m)
            return F.when(take, F.struct((F.get(ends, i) - F.length(m)).alias("s"), F.get(ends, i).alias("e"), m.alias("m")))

        return F.filter(F.transform(p, one), lambda x: x.isNotNull())

    ends = lambda p: running(F.transform(p, lambda x: F.length(x).cast("long")), lambda x, y: x + y)
    return F.when(present, let(parts, lambda p: let(ends(p), lambda e: told(p, e))).cast(kind)).otherwise(F.array().cast(kind))


def _base(text: Column) -> dict[str, Column]:
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 8
    return {
        "assign": _matches(text, ASSIGN, text.rlike(ASSIGN), value),
        "access": _matches(text, ACCESS, F.contains(text, F.lit("AKIA"))),
        "hex": _matches(text, HEX, text.rlike(HEX)),
    }


def random_strings(seed: Column) -> Column:
    """An array of random strings, one an alphabet, of 16 to 47 characters: digests of a seed."""
    digest = lambda salt: F.sha2(F.concat_ws("/", seed.cast("string"), F.lit(salt)).cast("binary"), 512)
    base64 = lambda salt: F.base64(F.unhex(digest(salt)))
    plain = lambda salt: F.regexp_replace(base64(salt), "[+/=\\s]", "")
    made = [F.regexp_replace(base64("a"), "\\s", ""), F.translate(base64("b"), "+/\r\n", "-_"), plain("c"), plain("d"), F.lower(plain("e")), F.upper(plain("f")), digest("g")]
    size = lambda i: (F.lit(LEAST) + F.pmod(F.xxhash64(seed, F.lit(i)), F.lit(32))).cast("int")
    return F.array(*(F.substring(x, F.lit(1), size(i)) for i, x in enumerate(made)))


def identifiers(words: Column) -> Column:
    """An array of identifiers from an array of words, three words each, in styles by turns."""
    groups = F.sequence(F.lit(0), F.greatest(F.floor((F.size(words) - 3) / 3), F.lit(-1)).cast("int"))
    low = lambda w: F.lower(w)
    cap = lambda w: F.initcap(w)

    def one(g: Column) -> Column:
        a, b, c = (F.get(words, g * 3 + i) for i in range(3))
        number = F.pmod(F.xxhash64(a, b, c), F.lit(2100)).cast("string")
        styles = [
            F.concat(low(a), cap(b), cap(c)), F.concat_ws("_", low(a), low(b), low(c)), F.concat(cap(a), cap(b), number, cap(c)), F.concat_ws("-", low(a), low(b), low(c)),
            F.upper(F.concat_ws("_", a, b, c)), F.concat_ws("/", low(a), low(b), low(c)), F.concat_ws("_", low(a), low(b), number), F.concat(low(a), cap(b), cap(c), number),
            F.concat(low(a), low(b), low(c)), F.concat_ws("-", cap(a), cap(b), number),
        ]
        out = styles[-1]
        for i, s in enumerate(styles[:-1]):
            out = F.when(g % len(styles) == i, s).otherwise(out)
        return out

    return F.when(F.size(words) >= 3, F.transform(groups, one)).otherwise(F.array().cast("array<string>"))


def samples(docs: DataFrame, *, rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """token, random: labelled samples from a bounded sample of rows, in one pass over it. The values of base matches and
    strings from digests are random; identifiers are made of the words of texts without a match."""
    n = docs.count()
    some = docs if n <= rows else docs.where(F.expr(f"pmod(xxhash64(`{doc_id}`, 'secrets'), 1000000007) < {int(rows / n * 1000000007)}"))

    def told(t: Column) -> Column:
        base = _base(t)
        values = F.concat(F.transform(base["assign"], lambda m: F.regexp_extract(m["m"], ASSIGN, 1)), F.transform(base["access"], lambda m: F.substring(m["m"], 5, 1 << 30)), F.transform(base["hex"], lambda m: m["m"]))
        label = lambda tokens, random: F.transform(tokens, lambda x: F.struct(x.alias("token"), F.lit(random).alias("random")))
        words = F.regexp_extract_all(t, F.lit("([A-Za-z]{2,})"), F.lit(1))
        return let(values, lambda v: F.concat(label(F.filter(v, lambda x: x.rlike("[0-9]")), True), label(random_strings(F.xxhash64(t)), True), F.when(F.size(v) == 0, let(words, lambda w: label(identifiers(w), False))).otherwise(label(F.array().cast("array<string>"), False))))

    cleaned = _clean(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return some.select(F.explode(let(cleaned, told)).alias("s")).select("s.token", "s.random")


class Models:
    """ratio: log P(b|a) of random strings less that of identifiers, for every pair of printable characters."""

    def __init__(self, ratio: list[float]):
        self.ratio = ratio

    def score(self, token: Column) -> Column:
        """The log-likelihood ratio of a token over its transitions; characters outside the models count 0."""
        table = F.expr("array(" + ",".join(f"{x:.4f}D" for x in self.ratio) + ")")  # folded into one constant
        width = LAST - FIRST + 1
        start = F.struct(F.lit(-1).alias("prev"), F.lit(0.0).alias("sum"))

        def step(a: Column, c: Column) -> Column:
            code = F.ascii(c) - FIRST
            known = (a["prev"] >= 0) & code.between(0, width - 1)
            return F.struct(F.when(code.between(0, width - 1), code).otherwise(F.lit(-1)).alias("prev"), (a["sum"] + F.when(known, F.get(table, a["prev"] * width + code)).otherwise(0.0)).alias("sum"))

        return F.aggregate(F.split(token, ""), start, step)["sum"]

    def random(self, token: Column, bound: float = BOUND, rate: float = RATE) -> Column:
        """Is a token a random string?"""
        return let(self.score(token), lambda s: (s >= bound) & (s >= rate * (F.length(token) - 1)))


def _kind(c: str) -> int:
    return 0 if c in string.ascii_lowercase else 1 if c in string.ascii_uppercase else 2 if c in string.digits else 3


def learn(labelled: DataFrame) -> Models:
    """labelled: token, random. Pairs of characters are counted before they are shuffled; at most a few thousand counts come
    back. A pair's chance is that of the pair, of the character behind its kind of character (small, capital, digit, other)
    and of any token character, weighted, so that pairs never seen decide nothing alone. Without samples of either kind every
    ratio is 0, so nothing is found."""
    chars = F.split("token", "")
    pairs = let(chars, lambda c: F.transform(F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))), lambda x, i: F.ascii(x) * 1000 + F.ascii(F.get(c, i + 1))))
    counted = labelled.where(F.length("token") > 1).select("random", F.explode(pairs).alias("p")).groupBy("random", "p").agg(F.count("*").alias("n")).collect()
    shown = [chr(c) for c in range(FIRST, LAST + 1)]
    width, token = len(shown), [c.isalnum() or c in "+/_=-" for c in shown]
    n = {True: [[0.0] * width for _ in range(width)], False: [[0.0] * width for _ in range(width)]}
    for kind, p, k in counted:
        a, b = divmod(p, 1000)
        if FIRST <= a <= LAST and FIRST <= b <= LAST:
            n[kind][a - FIRST][b - FIRST] += k
    if not all(any(map(any, n[k])) for k in (True, False)):
        return Models([0.0] * width * width)

    def chances(counts: list[list[float]]) -> list[list[float]]:
        behind = [[0.0] * 4 for _ in range(4)]  # kind of the first character, kind of the second
        for a, row in zip(shown, counts, strict=True):
            for b, k in zip(shown, row, strict=True):
                behind[_kind(a)][_kind(b)] += k
        members = [sum(_kind(c) == k and t for c, t in zip(shown, token, strict=True)) for k in range(4)]
        out = []
        for a, row in zip(shown, counts, strict=True):
            total, of_kind = sum(row), behind[_kind(a)]
            seen = total / (total + 20)  # few counts say little
            some = (sum(of_kind) > 0) * KIND
            out.append([
                PAIR * seen * (k / total if total else 0.0)
                + (some + PAIR * (1 - seen) * (some > 0)) * (of_kind[_kind(b)] / max(sum(of_kind), 1) / max(members[_kind(b)], 1))
                + (1 - PAIR - some + PAIR * (1 - seen) * (some == 0)) * (t / sum(token) if t else 1e-4)
                for b, k, t in zip(shown, row, token, strict=True)
            ])
        return out

    good, plain = chances(n[True]), chances(n[False])
    return Models([math.log(good[a][b] / plain[a][b]) for a in range(width) for b in range(width)])


def scan(docs: DataFrame, models: Models, *, bound: float = BOUND, rate: float = RATE, doc_id: str = "doc_id", text: str = "text", found: str = "found") -> DataFrame:
    """All columns of docs, and found: an array of structs start, rank, end, kind, sorted by start and rank (the kinds in
    the order assign, access, hex, random), by code points, end exclusive.

    Base matches always stay; a run is added as random where its ratio is bound or more, and rate or more a transition, and
    it overlaps no base match. Defined results: null and empty texts have none; rows, nulls and other columns pass as they
    are, and the column found (its name is a parameter) replaces one of that name; an empty table gives no rows; texts are
    read whole, in time that grows nearly with their length."""
    shape = "array<struct<start: long, rank: int, end: long, kind: string>>"
    span = lambda s, rank, e: F.struct(s.alias("start"), F.lit(rank).alias("rank"), e.alias("end"), F.lit(KINDS[rank]).alias("kind"))
    told = lambda rank: lambda m: span(m["s"], rank, m["e"])
    longest = F.lit(2**62).cast("long")

    def worth(m: Column) -> Column:
        varied = (F.size(F.array_distinct(F.split(m, ""))) >= DIFFERENT) & (F.length(F.regexp_replace(m, "[^A-Za-z0-9]", "")) >= ALPHANUMERIC)
        return m.rlike("[A-Za-z]") & varied & models.random(m, bound, rate)

    def with_runs(base: Column, runs: Column) -> Column:
        """Runs that no base span reaches into: none before it ends after its start, none after it begins before its end."""
        both = F.array_sort(F.concat(base, F.transform(runs, told(3)).cast(shape)))

        def free(a: Column) -> Column:
            reach = running(F.transform(a, lambda x: F.when(x["rank"] < 3, x["end"]).otherwise(F.lit(0).cast("long"))), lambda x, y: F.greatest(x, y))
            ahead = F.reverse(running(F.reverse(F.transform(a, lambda x: F.when(x["rank"] < 3, x["start"]).otherwise(longest))), lambda x, y: F.least(x, y)))
            return let(F.struct(reach.alias("r"), ahead.alias("n")), lambda s: F.filter(a, lambda x, i: (x["rank"] < 3) | (F.get(s["r"], i) <= x["start"]) & (F.get(s["n"], i) >= x["end"])))

        return F.when(F.size(runs) == 0, base).otherwise(let(both, free))

    def judged(t: Column) -> Column:
        spans = [F.transform(v, told(i)).cast(shape) for i, v in enumerate(_base(t).values())]
        runs = _matches(t, RUN, t.rlike(RUN), worth)
        return let(F.array_sort(F.concat(*spans)), lambda b: let(runs, lambda r: with_runs(b, r)))

    return docs.withColumn(found, let(_clean(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))), judged))


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redacted(text: Column, found: Column, by: str = "[secret]") -> Column:
    """The text with every found span, overlapping ones together, replaced. Four bytes a character let every piece be cut
    out where it is."""
    piece = lambda wide, at, to: F.decode(F.substring(wide, (at * 4 + 1).cast("int"), ((to - at) * 4).cast("int")), "UTF-32")

    def done(s: Column) -> Column:
        wide, spans, reach = s["wide"], s["spans"], s["reach"]

        def one(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(reach, i - 1)).otherwise(F.lit(0).cast("long"))
            return F.when(x["start"] < before, F.lit("")).otherwise(F.concat(piece(wide, before, x["start"]), F.lit(by)))

        last = F.get(reach, F.size(reach) - 1)
        return F.concat(F.array_join(F.transform(spans, one), ""), piece(wide, last, F.octet_length(wide).cast("long") / 4))

    held = lambda f: F.struct(F.encode(text, "UTF-32").alias("wide"), f.alias("spans"), running(F.transform(f, lambda x: x["end"]), lambda x, y: F.greatest(x, y)).alias("reach"))
    return let(found, lambda f: F.when(F.size(f) > 0, let(held(f), done)).otherwise(text))
