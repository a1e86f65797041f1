"""Personal data by candidate gradient boosting, in DataFrame functions only.

Two layers of spans come out of each text, in code points, end exclusive.

*Base* spans follow fixed formats (e-mail, IPv4, card with a Luhn check, phone),
leftmost and without overlap per kind; matches that fail their check are dropped
without a retry. *Added* spans come from high-recall generators, which may
overlap one another and also propose parts of a failed base match (a card number
right before an address, say), obfuscated addresses, national phone formats and
secrets. Each candidate gets binary format and context features; boosted
depth-two trees score it, and a threshold for each kind selects: the least score
of at least ``PRECISION`` on calibration examples, and never one below even odds.
Candidates that overlap a base span are dropped; among those that overlap one
another the best scored stays.

The trees learn from ``TRAIN_ROWS`` generated texts (a documented bound) in which
the true spans are marked, so each candidate of a text has a label of its own:
right kind and right place. Thresholds come from other templates than the trees
(``CALIBRATION``). Examples are reduced to counts by feature pattern, at most
2^|features| rows, before they reach the driver.

Regular expressions are written without nested unbounded repetition, which would
recurse once per repeat in the JVM and overflow on very long texts; the base ones
are equal to the formats they stand for (see the comments). Work is linear in a
text's length and number of matches but for terms divided by ``GROUP`` or ``CUT``:
running sums are taken in two levels, overlaps are found by sorting, texts are
redacted in pieces. A row is handled by itself: no shuffle. Null texts are empty:
no spans. Repeated rows get equal results; an empty table gives no rows. Input columns named like an output
column (in any case) are replaced.
"""

from __future__ import annotations

import json
import math
import random
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Plain

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
TRAIN_ROWS, ROUNDS, RATE, PRECISION = 4000, 40, 0.5, 0.99
#: Elements of an array, and characters of a text, that are handled one by one before groups of them are combined.
GROUP, CUT = 64, 4096

_LOCAL, _LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
BASE = {
    # local@label(.label)+ : a local part starts where no local character precedes, or where the last match ended; the labels are one lazy run that stops before "..", or before a dot with no label after it
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++\.{_LABEL}[A-Za-z0-9.-]*?(?=\.\.|\.?(?:[^A-Za-z0-9.-]|\z))",
    # a run of digits is taken whole or not at all
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # 13 to 19 digits with single separators that neither continue nor go on such a run: what remains of the maximal runs after the length check
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GENERATORS = {
    "email": [r"[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{1,63}){1,6}"],
    "ip": [r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"],
    "card": [r"(?<![0-9])[0-9]{13,19}(?![0-9])", r"(?<![0-9])[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}(?![0-9])"],
    "phone": [
        r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
        r"(?:\([0-9]{3}\) ?|(?<![0-9])[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
    ],
    "secret": [r"(?<![A-Z0-9])AKIA[0-9A-Z]{16}(?![A-Z0-9])", r"(?i)(?:token|secret|password|passwd|api_?key) {0,3}[=:] {0,3}(?:\"[A-Za-z0-9_+/=-]{8,128}\"|'[A-Za-z0-9_+/=-]{8,128}'|[\"']?[A-Za-z0-9_+/=-]{8,128})"],
}
#: Words before a candidate that speak for its kind, or against any.
_CUES = {"email": "mail|contact|write", "ip": r"\bip\b|host|server|addr", "card": "card|visa|paid|credit", "phone": "phone|tel|call|mobile", "secret": "token|secret|passw|key"}
_AGAINST = r"version|release|order|isbn|part no|section|page"
_CONTEXT = 24


def _between(values: str, start: str, stop: str) -> str:
    """SQL of the elements start to stop (exclusive, more than none) of an array column; slice() would copy all of it each time."""
    return f"transform(sequence({start}, {stop} - 1), i -> get({values}, i))"


def running(values: str, combine: str = "{a} + {v}", zero: int = 0) -> Column:
    """Of an array column of ints: what ``combine`` (SQL, associative) makes of all values before each one."""

    def inside(x: str, start: str) -> str:
        return f"aggregate({x}, named_struct('at', {start}, 'out', cast(array() AS array<int>)), (acc, v) -> named_struct('at', {combine.format(a='acc.at', v='v')}, 'out', concat(acc.out, array(acc.at))), acc -> acc.out)"

    groups = f"transform(sequence(0, cast((size({values}) - 1) div {GROUP} AS int)), g -> {_between(values, f'g * {GROUP}', f'least(size({values}), (g + 1) * {GROUP})')})"
    starts = inside(f"transform({groups}, x -> aggregate(x, {zero}, (a, v) -> {combine.format(a='a', v='v')}))", str(zero))
    return F.expr(f"CASE WHEN size({values}) > 0 THEN flatten(zip_with({groups}, {starts}, (x, b) -> {inside('x', 'b')})) ELSE cast(array() AS array<int>) END")


def located(df: DataFrame, text: str, patterns: dict[str, tuple[Column, str]]) -> DataFrame:
    """df with a column of matches (s, e, m, and the text before and after, up to the neighbours) for each name in patterns: (cheap test that the text may match, pattern)."""
    t, names = F.col(text), list(patterns)
    none = F.array().cast("array<string>")
    df = df.select("*", *[F.when(may, F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none).alias(f"{n}_found") for n, (may, p) in patterns.items()])
    df = df.select("*", *[F.when(F.size(f"{n}_found") > 0, F.split(t, p, -1)).otherwise(none).alias(f"{n}_gaps") for n, (_, p) in patterns.items()])
    df = df.select("*", *[F.expr(f"transform({n}_found, (m, i) -> length(m) + length(get({n}_gaps, i))) AS {n}_length") for n in names])
    df = df.select("*", *[running(f"{n}_length").alias(f"{n}_at") for n in names])
    place = "get({n}_at, i) + length(get({n}_gaps, i))"
    match = f"transform({{n}}_found, (m, i) -> named_struct('s', {place}, 'e', {place} + length(m), 'm', m, 'before', get({{n}}_gaps, i), 'after', get({{n}}_gaps, i + 1))) AS {{n}}"
    return df.select("*", *[F.expr(match.format(n=n)) for n in names]).drop(*[f"{n}_{x}" for n in names for x in ("found", "gaps", "length", "at")])


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes: every second one from the right counts double, less 9 beyond 9."""
    n = F.length(d)

    def add(acc, i):
        v = F.substring(d, n - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v)

    return (n > 0) & (F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), add) % 10 == 0)


def octets(x: Column, most: int = 255) -> Column:
    """Whether all parts of a dotted quad are at most ``most``, whatever their length."""
    return F.forall(F.split(x, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(999)) <= most))


_VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: octets(m),
    "card": lambda m: F.length(digits(m)).between(13, 19) & luhn(digits(m)),
    "phone": lambda m: F.length(digits(m)).between(9, 15),
}
#: Cheap tests that a text may hold the kind at all.
_MAY = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike("[0-9]"), "phone": lambda t: t.contains("+")}


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """df with ``base_<kind>``: arrays of the base spans."""
    df = located(df, text, {f"match_{k}": (_MAY[k](F.col(text)), BASE[k]) for k in KINDS})
    valid = lambda k: F.filter(f"match_{k}", lambda x: _VALID[k](x["m"]))
    return df.select("*", *[valid(k).alias(f"base_{k}") for k in KINDS]).drop(*[f"match_{k}" for k in KINDS])


def _sql_octets(x: str, most: int = 255) -> str:
    return rf"forall(split({x}, r'\.'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(right(p, 3) AS INT), 999) <= {most})"


def _sql_digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _sql_luhn(x: str) -> str:
    digit = f"cast(substring({_sql_digits(x)}, length({_sql_digits(x)}) - i, 1) AS INT)"
    return f"aggregate(sequence(0, greatest(length({_sql_digits(x)}) - 1, 0)), 0, (a, i) -> a + CASE WHEN i % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END) % 10 = 0"


_M, _BEFORE, _AFTER = "x.m", f"substring(x.before, -{_CONTEXT}, {_CONTEXT})", "substring(x.after, 1, 1)"
_CHECKS = {"email": f"contains({_M}, '@')", "ip": _sql_octets(_M), "card": _sql_luhn(_M), "phone": f"length({_sql_digits(_M)}) BETWEEN 9 AND 15", "secret": f"{_M} rlike '[0-9]' AND {_M} rlike '[A-Za-z]'"}
#: Features of a candidate of a kind, by name, as SQL on its match x (one string each: building columns call by call takes the driver seconds).
FEATURES = {f"is_{k}": (lambda k: lambda kind: str(kind == k))(k) for k in ALL_KINDS} | {
    "checks": lambda kind: _CHECKS[kind],
    "cue": lambda kind: f"lower({_BEFORE}) rlike r'{_CUES[kind]}'",
    "against": lambda kind: f"lower({_BEFORE}) rlike '{_AGAINST}'",
    "free_left": lambda kind: rf"""{_BEFORE} = '' OR {_BEFORE} rlike r"[\s'(<:=,;]\z" OR {_BEFORE} rlike r'["]\z'""",
    "free_right": lambda kind: f"{_AFTER} = '' OR {_AFTER} rlike '[^A-Za-z0-9]'",
    "spaced": lambda kind: f"{_M} rlike '[ -]'",
    "obfuscated": lambda kind: rf"{_M} rlike r'(?i)\((?:at|dot)\)|\[(?:at|dot)\]'",
    "uniform": lambda kind: rf"NOT {_sql_digits(_M)} rlike r'(.).*(?!\1).'",
    "small_parts": lambda kind: _sql_octets(_M, 20) if kind == "ip" else "false",
    "plus": lambda kind: f"startswith({_M}, '+')",
}


def candidates(df: DataFrame, text: str) -> DataFrame:
    """df with ``candidates``: array<struct<s, e, kind, f>>, f the features as bits."""
    t = F.col(text)
    may = {"email": t.rlike(r"@|\(at\)|\[at\]| at "), "ip": _MAY["ip"](t), "card": t.rlike("[0-9]{4}"), "phone": t.rlike("[0-9][ .-]?[0-9]{2}"), "secret": t.rlike(r"AKIA|[=:] {0,3}[\"']?[A-Za-z0-9_+/=-]{8}")}
    names = {f"made_{k}_{i}": (k, p) for k in ALL_KINDS for i, p in enumerate(GENERATORS[k])}
    df = located(df, text, {n: (may[k], p) for n, (k, p) in names.items()})

    bits = lambda kind: " + ".join(f"CASE WHEN {f(kind)} THEN {1 << i} ELSE 0 END" for i, f in enumerate(FEATURES.values()))
    each = ", ".join(f"transform({n}, x -> named_struct('s', x.s, 'e', x.e, 'kind', '{k}', 'f', {bits(k)}))" for n, (k, _) in names.items())
    df = df.select("*", F.expr(f"concat({each})").alias("candidates"))
    return df.drop(*names)


# ---- training ---------------------------------------------------------------

#: Texts, true spans marked as <kind:...>; {n} is a number of n digits, {h} eight hex digits, {k} 16 capitals and digits, {l} a card number that
#: passes the check, {x} one that fails it, {b1} an octet from 21, {w} a word. Trees learn from the first list, thresholds come from the second. Fixed values.
TRAINING = [
    "{w} <email:{w}.{2}@{w}.example.com> {w}", "mail <email:{w}.{w} (at) {w} (dot) com> {w}", "contact: <email:{w} [at] {w} [dot] org> {w}", "write to <email:{w}@{w}.net>.", "{w} <email:{w}@{w}.{w}>, {w}",
    "{w} at {w}.{w} {w}", "look at {w} dot {w} {w}", "{w} at the dot {w}", "{w} was at {w}.{w}", "{w} of at {w} dot {w}. {w}", "arrived at {w}. {w} {w}",
    "{w} <ip:{b1}.{b1}.{b1}.{b1}> {w}", "{w} <card:{l}> <ip:{b1}.{b1}.{b1}.{b1}> {w}", "server <ip:{b1}.{b1}.{b1}.{b1}>, {w}", "{w} <ip:{b1}.{b1}.{b1}.{b1}>!! {w}",
    "version {1}.{1}.{1}.{1} {w}", "release 1{1}.{1}.{1}.{1} of {w}", "{w} 9{2}.8{2}.7{2}.6{2} {w}", "section {1}.{1}.{1}.{1} {w}", "{w} {1}.{2}.{1}.{1}: {w}",
    "{w} <card:{l}> {w}", "{w} <card:{l}> {2}.{w}", "{w} <card:{l}>!! {w}", "card <card:{l}>, {w}", "{w} {w}{l}{w}",
    "order {x} {w}", "{w} {x} {w}", "isbn 978{x} {w}", "{w} 0000000000000000 {w}", "{w} {x}, {w}", "order {4} {4} {4} {4} {w}", "{w} {x} {b1}.{w}",
    "{w} <phone:+1 ({3}) 555-{4}> {w}", "{w} <phone:+1 ({3}) 555-{4}> {x}", "call <phone:+44 20 {4} {4}> {w}", "phone <phone:({3}) {3}-{4}> {w}", "tel <phone:{3}-{3}-{4}> {w}", "{w} <phone:+1 ({3}) 555-{4}>!! {w}", "{w} <phone:+1 ({3}) 555-{4}> <card:{l}> {w}",
    "part no {3}-{3}-{4} {w}", "order {3}-{3}-{4} {w}", "{w} {3}-{3}-{4} {w}", "isbn {3}-{3}-{4} {w}", "{w} {3}.{3}.{4} {w}", "version {3}.{3}.{4} {w}",
    "{w} <secret:token = \"{h}{h}{h}{h}{h}\"> {w}", "{w} <secret:password={h}{h}> {w}", "{w} <secret:AKIA{k}> {w}", "<secret:api_key: {h}{h}{h}> {w}", "{w} <secret:secret='{h}{h}'>, {w}",
    "{w} token = {w}{w}{w} {w}", "{w} password: {w}{w}{w}", "{w} key=value {w} secret: undisclosed", "page {x} {w}", "the password: {w}{w} {w}",
]
CALIBRATION = [
    "{w}, <email:{w}{2}@{w}.org> {w}", "<email:{w}_{w} [at] {w} [dot] net> {w}", "e-mail: <email:{w} (at) {w} (dot) de>; {w}", "{w} sat at {w} dot {w}", "meet at {w}.{w} at {w}", "{w} at {w} dot. {w}",
    "host <ip:{b1}.{b1}.{b1}.{b1}>; {w}", "{w}: <ip:{b1}.{b1}.{b1}.{b1}> <card:{l}>", "from <ip:{b1}.{b1}.{b1}.{b1}>. {w}", "page {1}.{1}.{1}.{1}, {w}", "version 2{1}.{2}.{2}.{2} {w}",
    "visa <card:{l}>. {w}", "{w}: <card:{l}> {w}", "{w}, <card:{l}> <phone:+1 ({3}) 555-{4}>", "{w}, {x}. {w}", "order {x} of {w}", "release {x}: {w}",
    "mobile <phone:({3}) {3}-{4}>, {w}", "call <phone:{3}-{3}-{4}>. {w}", "<phone:+49 30 {4} {4}> {w}", "section {3}-{3}-{4}: {w}", "{w} {3}-{3}-{4}, {w}", "page {3}.{3}.{4} {w}",
    "{w}: <secret:AKIA{k}>, {w}", "<secret:passwd = {h}{h}{h}> {w}", "{w} (<secret:token={h}{h}{h}{h}>) {w}", "{w} token: {w}{w}, {w}", "secret = {w}{w}{w}; {w}", "password: {w}{w}{w}.",
]


def example_texts(templates: list[str], n: int, seed: int) -> list[dict]:
    """n texts {"t", "spans"} from the templates in turn; spans are (kind, s, e)."""
    rng = random.Random(seed)
    some = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))

    def card(off: int) -> str:
        body = "4" + some("0123456789", 14)
        doubled = [int(c) * (2 if i % 2 == 0 else 1) for i, c in enumerate(body)]
        return body + str((-sum(v - 9 * (v > 9) for v in doubled) + off) % 10)

    make = {
        "l": lambda: card(0), "x": lambda: card(rng.randint(1, 9)), "h": lambda: some("0123456789abcdef", 8), "k": lambda: some("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16),
        "w": lambda: some("abcdefghijklmnopqrstuvwxyz", rng.randint(3, 9)), "b1": lambda: str(rng.randint(21, 255)),
    }
    examples = []
    for i in range(n):
        filled = re.sub(r"\{(\w+)\}", lambda m: make[m[1]]() if m[1] in make else some("0123456789", int(m[1])), templates[i % len(templates)])
        text, spans = "", []
        for plain, kind, inner in re.findall(r"([^<]*)(?:<(\w+):([^>]*)>)?", filled):
            text += plain
            if kind:
                spans.append({"kind": kind, "s": len(text), "e": len(text) + len(inner)})
                text += inner
        examples.append({"t": text, "spans": spans})
    return examples


def labelled(spark: SparkSession, *sets: list[dict]) -> DataFrame:
    """(part, f, label, n): feature patterns of the candidates of each set of examples, whether they are true spans, and their counts."""
    told = json.dumps([e | {"part": i} for i, examples in enumerate(sets) for e in examples])
    told = F.from_json(F.lit(told), "array<struct<part: int, t: string, spans: array<struct<kind: string, s: int, e: int>>>>")
    rows = spark.range(1).select(F.posexplode(told).alias("id", "x")).select("id", "x.*").repartition(8, "id")
    true = F.exists("spans", lambda y: (y["kind"] == F.col("c.kind")) & (y["s"] == F.col("c.s")) & (y["e"] == F.col("c.e")))
    return candidates(rows, "t").select("part", "spans", F.explode("candidates").alias("c")).groupBy("part", "c.f", true.alias("label")).agg(F.count("*").alias("n"))


def boost(rows: list[tuple[int, bool, int]], n_features: int, rounds: int = ROUNDS, rate: float = RATE) -> list[tuple]:
    """Depth-two trees (i, j, k, four leaves: bits i then j or k off and on) by Newton boosting of (features, label, count)."""
    score, trees = [0.0] * len(rows), []
    for _ in range(rounds):
        grad = []
        for (_, y, n), s in zip(rows, score, strict=True):
            p = 1 / (1 + math.exp(-s))
            grad.append((n * (y - p), n * max(p * (1 - p), 1e-6)))

        def split(of):
            best = None
            for i in range(n_features):
                sides = [[0.0, 1.0], [0.0, 1.0]]
                for r in of:
                    side = sides[rows[r][0] >> i & 1]
                    side[0] += grad[r][0]
                    side[1] += grad[r][1]
                gain = sum(g * g / h for g, h in sides)
                if best is None or gain > best[0] + 1e-12:
                    best = gain, i, [rate * g / h for g, h in sides]
            return best

        every = range(len(rows))
        _, i, _ = split(every)
        halves = [split([r for r in every if rows[r][0] >> i & 1 == side]) for side in (0, 1)]
        tree = (i, halves[0][1], halves[1][1], *halves[0][2], *halves[1][2])
        trees.append(tree)
        score = [s + leaf(tree, f) for (f, _, _), s in zip(rows, score, strict=True)]
    return trees


def leaf(tree: tuple, f: int) -> float:
    i, j, k, a, b, c, d = tree
    if f >> i & 1:
        return d if f >> k & 1 else c
    return b if f >> j & 1 else a


class Model:
    """Trees and a threshold for each kind."""

    def __init__(self, trees: list[tuple], thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def score(self, f: str) -> str:
        """SQL of the score of the features f."""
        bit = lambda i: f"({f} & {1 << i}) != 0"
        return " + ".join(f"CASE WHEN {bit(i)} THEN CASE WHEN {bit(k)} THEN {d!r}D ELSE {c!r}D END WHEN {bit(j)} THEN {b!r}D ELSE {a!r}D END" for i, j, k, a, b, c, d in self.trees)


def train(spark: SparkSession) -> Model:
    rows = labelled(spark, example_texts(TRAINING, TRAIN_ROWS, 20), example_texts(CALIBRATION, TRAIN_ROWS // 2, 21)).collect()
    trees = boost(sorted((r["f"], bool(r["label"]), r["n"]) for r in rows if r["part"] == 0), len(FEATURES))
    held = [(sum(leaf(t, r["f"]) for t in trees), r["f"], bool(r["label"]), r["n"]) for r in rows if r["part"] == 1]
    thresholds = {}
    for i, kind in enumerate(ALL_KINDS):
        thresholds[kind], right, all_ = math.inf, 0, 0
        own = sorted((x for x in held if x[1] >> i & 1), reverse=True)
        for at, (s, _, y, n) in enumerate(own):
            right, all_ = right + n * y, all_ + n
            below = own[at + 1][0] if at + 1 < len(own) else s - 1
            if right >= PRECISION * all_ and below < s:
                thresholds[kind] = max(0.0, (s + below) / 2)
    return Model(trees, thresholds)


# ---- the operator -------------------------------------------------------------


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


_SPANS = "array<struct<s: int, e: int, kind: string>>"
_SCORED = "array<struct<s: int, e: int, kind: string, score: double>>"


def _free(df: DataFrame, good: str, base: str) -> DataFrame:
    """df with ``free``: the spans of ``good`` that overlap none of ``base``, in order."""
    told = lambda x, own: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(own).alias("own"), x["kind"].alias("kind"), (x["score"] if own else F.lit(0.0)).alias("score"))
    df = df.select("*", F.when(F.size(good) > 0, F.array_sort(F.concat(F.transform(base, lambda x: told(x, 0)), F.transform(good, lambda x: told(x, 1))))).alias("both"))
    # how far base spans before each reach, and where those after it begin
    end = F.transform("both", lambda x: F.when(x["own"] == 0, x["e"]).otherwise(0))
    begin = F.transform(F.reverse("both"), lambda x: F.when(x["own"] == 0, x["s"]).otherwise(2**31 - 1))
    df = df.select("*", end.alias("ends"), begin.alias("begins"))
    df = df.select("*", F.when(F.size(good) > 0, running("ends", "greatest({a}, {v})")).alias("upto"), F.when(F.size(good) > 0, F.reverse(running("begins", "least({a}, {v})", 2**31 - 1))).alias("next"))
    # zipped: an array that a lambda looks into may be made anew for each element
    kept = F.expr("transform(filter(arrays_zip(both, upto, next), z -> z.both.own = 1 AND z.upto <= z.both.s AND z.next >= z.both.e), z -> named_struct('s', z.both.s, 'e', z.both.e, 'kind', z.both.kind, 'score', z.both.score))")
    return df.select("*", F.coalesce(kept.cast(_SCORED), F.array().cast(_SCORED)).alias("free")).drop("both", "ends", "begins", "upto", "next")


def _best(df: DataFrame) -> DataFrame:
    """df with ``added``: of the spans of ``free`` that overlap, the best scored (the longer, the earlier); spans that hang together by overlaps are chosen from best to worst."""
    df = df.select("*", F.transform("free", lambda x: x["e"]).alias("ends"))
    df = df.select("*", running("ends", "greatest({a}, {v})").alias("upto"))
    first = F.expr("filter(transform(arrays_zip(free, upto), (z, i) -> CASE WHEN z.free.s >= z.upto THEN i END), i -> i IS NOT NULL)")
    df = df.select("*", first.alias("first"))
    run = _between("free", "a", "coalesce(get(first, k + 1), size(free))")
    ranked = f"array_sort(transform({run}, x -> named_struct('minus', -x.score, 'short', x.s - x.e, 's', x.s, 'e', x.e, 'kind', x.kind)))"
    take = "CASE WHEN exists(acc, y -> y.s < x.e AND x.s < y.e) THEN acc ELSE concat(acc, array(named_struct('s', x.s, 'e', x.e, 'kind', x.kind))) END"
    chosen = F.expr(f"cast(flatten(transform(first, (a, k) -> aggregate({ranked}, cast(array() AS {_SPANS}), (acc, x) -> {take}))) AS {_SPANS})")
    return df.select("*", chosen.alias("added")).drop("ends", "upto", "first", "free")


def _redacted(text: str, spans: str) -> Column:
    """The text with each of the sorted spans replaced by its kind, made in pieces of CUT characters."""
    pieces = F.regexp_extract_all(F.col(text), F.lit("(?s).{1,%d}" % CUT), F.lit(0))

    def piece(x, i):
        from_, n = i * CUT, F.length(x)
        own = F.filter(spans, lambda y: (y["s"] < from_ + n) & (y["e"] > from_))
        step = lambda acc, y: F.struct(
            F.greatest(acc["at"], F.least(y["e"] - from_, n)).alias("at"),
            # a span's name stands in the piece where it begins
            F.when(y["s"] - from_ < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(x, acc["at"] + 1, y["s"] - from_ - acc["at"]), F.lit("<"), F.upper(y["kind"]), F.lit(">"))).alias("out"),
        )
        return F.aggregate(own, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(x, acc["at"] + 1, n)))

    return F.when(F.size(spans) > 0, F.array_join(F.transform(pieces, piece), "")).otherwise(F.col(text))


def find_pii(docs: DataFrame, model: Model | None = None, keep: list[str] | None = None, text: str = "text", redact: bool = False) -> DataFrame:
    """docs with n_<kind> and base_sha256 of the base spans, spans (all, as kind:start:end), and redacted (if asked for)."""
    model = model or train(docs.sparkSession)
    plain, new = Plain(docs), [*[f"n_{k}" for k in KINDS], "base_sha256", "spans", *["redacted"] * redact]
    kept = plain.kept(keep, new)
    df = plain.df.select(*kept, F.coalesce(plain[text], F.lit("")).alias("t"))
    df = candidates(base_spans(df, "t"), "t")
    whole = lambda k: F.transform(f"base_{k}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(k).alias("kind")))
    df = df.select("*", F.concat(*[whole(k) for k in KINDS]).cast(_SPANS).alias("base"))
    threshold = lambda kind: reduce(lambda a, k: F.when(kind == k, F.lit(model.thresholds[k])).otherwise(a), ALL_KINDS, F.lit(math.inf))
    scored = F.expr(f"transform(candidates, x -> named_struct('s', x.s, 'e', x.e, 'kind', x.kind, 'score', {model.score('x.f')}))")
    df = df.select("*", F.when(F.size("candidates") > 0, scored).alias("scored"))
    df = df.select("*", F.coalesce(F.filter("scored", lambda x: x["score"] >= threshold(x["kind"])).cast(_SCORED), F.array().cast(_SCORED)).alias("good"))
    df = _best(_free(df, "good", "base"))
    df = df.select("*", F.concat("base", "added").alias("all"))
    of_kind = lambda k: F.array_sort(F.filter("all", lambda x: x["kind"] == k))
    by_kind = F.concat(*[of_kind(k) for k in ALL_KINDS])
    out = [F.size(f"base_{k}").cast("bigint").alias(f"n_{k}") for k in KINDS] + [F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(by_kind).alias("spans")]
    if redact:
        df = df.select("*", F.array_sort("all").alias("sorted"))
        out.append(_redacted("t", "sorted").alias("redacted"))
    return plain.restore(df.select(*kept, *out), new, keep)
