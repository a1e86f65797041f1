"""WARC archives, conversation repair and source divergence against brute-force versions."""

import collections
import gzip
import hashlib
import itertools
import json
import random
import re
import zlib

import pytest

from tallyfeed.llm import repair as R
from tallyfeed.llm import warc as W
from tallyfeed.llm.divergence import _cells, divergence

# --- op11 ---

BIG, LINES = "x" * 1200, "é" * 600 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
PAGES = [
    (1, "http://a/\r\nb", BIG), (2, None, BIG), (2, "u2", BIG), (2, "u1", BIG), (2, "u1", BIG), (None, "n", BIG), (3, "é", LINES), (3, "é", LINES), (4, "s", "short"), (4, "s", "short"),
    (5, "n", None), (None, None, None), (None, "q", "y" * 999), (None, "q", "y" * 999), (None, "m", "w" * 2000), (None, "m", "w" * 2000), (9, "c", "\r\n\r\n"), (10, "", ""),
]


def pages_of(spark, rows=PAGES):
    """With columns that clash with the operator's own."""
    return spark.createDataFrame([(*r, "z", 7) for r in rows], "Page_ID bigint, URL string, html string, `type` string, sha256 int").repartition(3)


def archived(spark, pages, tmp_path, **more):
    W.write_archives(W.plan_records(pages, **more), str(tmp_path / "whole"), **more)
    told = W.normalise(spark, str(tmp_path / "whole"), str(tmp_path / "members"))
    return told, W.read_archives(spark, str(tmp_path / "members"), payload=True)


def expected(rows, least=1000):
    groups, want = collections.defaultdict(list), collections.Counter()
    for page_id, _, html in rows:
        groups[(html or "").encode()].append(page_id)
    for data, ids in groups.items():
        ids.sort(key=lambda p: (p is not None, p or 0), reverse=True)
        for i, p in enumerate(ids):
            again = i > 0 and len(data) >= least
            want[p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", ids[0] if again else None] += 1
    return want


@pytest.mark.parametrize("least", [1000, 3])
def test_pages_come_back(spark, tmp_path, least):
    told, records = archived(spark, pages_of(spark), tmp_path, least=least)
    rows = records.collect()
    assert collections.Counter(map(tuple, W.archived_pages(records).collect())) == expected(PAGES, least)
    assert sum(r["records"] for r in told.collect()) == len(PAGES)
    ids = [r["record_id"] for r in rows]
    assert len(set(ids)) == len(ids) and all(r["refers_to"] in ids for r in rows if r["type"] == "revisit")
    responses = collections.Counter(bytes(r["payload"]) for r in rows if r["type"] == "response")
    assert {d for d in responses} == {(h or "").encode() for _, _, h in PAGES} and responses[BIG.encode()] == 1
    assert {r["uri"] for r in rows} == {"http://a/%0D%0Ab", None, "u2", "u1", "n", "é", "s", "q", "m", "c", ""}


def test_every_record_is_a_member_at_its_offset(spark, tmp_path):
    archived(spark, pages_of(spark), tmp_path)
    seen = 0
    for side in (tmp_path / "members").glob("*.cdxj"):
        data = (tmp_path / "members" / side.name.replace(".cdxj", ".warc.gz")).read_bytes()
        at = 0
        for line in side.read_text().splitlines():
            entry = json.loads(line)
            assert entry["offset"] == at
            at += entry["length"]
            one = zlib.decompressobj(31)
            text = one.decompress(data[entry["offset"] : at])
            assert one.eof and not one.unused_data and text.startswith(b"WARC/1.1\r\nWARC-Type: " + entry["type"].encode()) and text.endswith(b"\r\n\r\n")
            head, _, body = text.partition(b"\r\n\r\n")
            assert int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(body) - 4
            seen += 1
        assert at == len(data)
    assert seen == len(PAGES)
    whole = list((tmp_path / "whole").glob("*.gz"))
    for f in whole:  # what was normalised is one gzip stream each
        one = zlib.decompressobj(31)
        assert gzip.decompress(f.read_bytes()) == one.decompress(f.read_bytes()) and not one.unused_data


def test_empty_and_long_pages(spark, tmp_path):
    _, none = archived(spark, pages_of(spark).where("false"), tmp_path / "none")
    assert none.count() == 0
    long = [(7, "u", "long page " * 5_000_000), (8, "u", "long page " * 5_000_000)]
    told, records = archived(spark, spark.createDataFrame(long, "page_id bigint, url string, html string"), tmp_path / "long")
    assert collections.Counter(map(tuple, W.archived_pages(records).collect())) == expected(long)


def test_a_hot_payload_is_told_once(spark, tmp_path):
    rows = [(i, "u", BIG if i % 3 == 0 else f"{i} " * 400) for i in range(3000)]
    _, records = archived(spark, spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(8), tmp_path)
    got = collections.Counter((r["record_type"], r["refers_to"]) for r in W.archived_pages(records).collect())
    assert got == {("response", None): 2001, ("revisit", 2997): 999}


def test_other_archives(spark, tmp_path):
    """Members, continued and odd headers, line ends between records; cut-off ones are refused by name."""
    record = lambda body, more="": f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:{len(body)}>\r\nWARC-Target-URI: http://a\r\n b\r\n{more}Content-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(gzip.compress(record("one")) + gzip.compress(b"\r\n\r\n" + record("two!", "WARC-Payload-Digest: sha1:BASE32\r\n") + record("")))
    assert W.normalise(spark, str(tmp_path / "in"), str(tmp_path / "out")).first()["records"] == 3
    rows = {r["record_id"]: r for r in W.read_archives(spark, str(tmp_path / "out"), payload=True).collect()}
    assert {k: bytes(r["payload"]) for k, r in rows.items()} == {"<urn:x:3>": b"one", "<urn:x:4>": b"two!", "<urn:x:0>": b""}
    assert all(r["uri"] == "http://a b" and r["payload_digest"] == hashlib.sha1(bytes(r["payload"])).hexdigest() for r in rows.values())
    whole = gzip.compress(record("x" * 100))
    for i, bad in enumerate((whole[:-12], gzip.compress(record("y" * 50)[:-30]), gzip.compress(b"no archive\r\n\r\n"), gzip.compress(record("z").replace(b"Length: 1", b"Length: -1")), b"no gzip")):
        (tmp_path / f"bad{i}").mkdir()
        (tmp_path / f"bad{i}" / "b.gz").write_bytes(bad)
        with pytest.raises(Exception, match="b.gz"):
            W.normalise(spark, str(tmp_path / f"bad{i}"), str(tmp_path / f"out{i}"))
        assert not list((tmp_path / f"out{i}").glob("*.warc.gz"))


# --- op12 ---


def cheapest(turns):
    """All edit sequences, bounded by deleting every turn."""
    gone = [max(1, n) for *_, n in turns]
    best = (4 * sum(gone), "D" * sum(gone))

    def rec(i, initials, cost, audit, inserted):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", initials):
            best = min(best, (cost, audit))
        if inserted < 2:
            for r in "ua":
                rec(i, initials + r, cost + 3, audit + "I", inserted + 1)
        if i < len(turns):
            initial, short, n = turns[i]
            if n:
                rec(i + 1, initials, cost + 4 * n, audit + "D" * n, 0)
                return
            rec(i + 1, initials, cost + 4, audit + "D", 0)
            rec(i + 1, initials + initial, cost + 3 * short, audit + "K", 0)
            for r in "ua":
                rec(i + 1, initials + r, cost + 3 + 3 * short, audit + "R", 0)

    rec(0, "", 0, "", 0)
    return best


def turns_of(rng, n):
    return [(rng.choice("suuaat"), rng.random() < 0.3, rng.choice([0, 0, 0, 1, 2])) for _ in range(n)]


def edits_of(turns):
    edits = R.Edits()
    for t in turns:
        edits.add(t)
    return edits.finish()


def test_edits_are_the_cheapest_and_least():
    rng = random.Random(3)
    for _ in range(120):
        turns = turns_of(rng, rng.randint(0, 4))
        assert edits_of(turns) == cheapest(turns), turns


@pytest.mark.parametrize("chunk", [1, 2, 3, 7])
def test_long_conversations_in_chunks(monkeypatch, chunk):
    rng = random.Random(chunk)
    for _ in range(120):
        turns = turns_of(rng, rng.randint(0, 40))
        monkeypatch.setattr(R, "CHUNK", 10**6)
        want = edits_of(turns)
        monkeypatch.setattr(R, "CHUNK", chunk)
        assert edits_of(turns) == want, turns


def brute_repair(rows, ids):
    """From (conv_id, turn, role, text) after damage, to the contract's columns."""
    out = {}
    null_first = lambda x: (x is not None, x or 0)
    for conv in ids:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (null_first(r[1]), r[2], r[3]))
        seen, turns, counts = set(), [], collections.Counter()
        for _, _, role, text in mine:
            solid = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            turns.append((role[:1] or "?", fault == "truncated", int(fault in ("blank", "duplicate"))))
        numbers = [r[1] for r in mine if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit = cheapest(turns)
        lines, i, last = [], 0, ""
        for edit in audit:
            due = {"": "user", "s": "user", "a": "user", "u": "assistant"}[last]
            if edit == "D":
                i += 1
                continue
            role, text = (due, "") if edit == "I" else (mine[i][2] if edit == "K" else due, mine[i][3])
            i += edit != "I"
            last = role[:1]
            lines.append(f"{role}:{text}")
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def damaged(rows):
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        yield from [row] * (0 if kind == 0 else 2 if kind == 3 else 1)


def test_repair_of_hostile_conversations(spark):
    rng = random.Random(6)
    texts = ["Hi.", "Hi.", "What?", "Yes!", "cut off", "", " \n", None, "É.", "line\nline.", "a.  ", "ok . b"]
    rows = [(c, t if rng.random() > 0.1 else None, rng.choice(["user", "assistant", "system", "tool", None, "u", "a"]), rng.choice(texts)) for c in [*range(60), None] for t in range(rng.randint(1, 4))]
    rows += [(1000, 0, "user", "Same."), (1000, 0, "user", "Same."), (1000, 0, "user", "Same."), (1001, -(2**62), "user", "Far."), (1001, 2**62, "assistant", "Far."), (1002, None, "", "No role.")]
    told = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, Role string, text string, `in_1` string, n int").repartition(3)
    faults, edits = R.repair(R.damage(told), told.select("conv_id"))
    digests = {r["conv_id"]: r["repaired_sha256"] for r in R.repaired_digests(faults, edits).collect()}
    got = {r["conv_id"]: (*r[1:8], digests[r["conv_id"]]) for r in edits.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit").collect()}
    want = brute_repair(list(damaged(rows)), {r[0] for r in rows})
    assert got == want
    turns = collections.defaultdict(list)
    for r in R.repaired_turns(faults, edits).orderBy("position").collect():
        turns[r["conv_id"]].append(r)
    for conv, rows in turns.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][:1] for r in rows)) and [r["position"] for r in rows] == list(range(len(rows)))
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in rows).encode()).hexdigest() == want[conv][-1]
    empty = told.where("false")
    faults, edits = R.repair(R.damage(empty), empty.select("conv_id"))
    assert edits.count() == 0 and R.repaired_digests(faults, edits).count() == 0


def test_repair_of_long_and_repeated_turns(spark):
    """A conversation of a third of all rows, one turn repeated 20,000 times, and a text of 20 MB."""
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}." if t % 50 else "cut") for t in range(12_000)] + [(2, 0, "user", "Again."), (2, 1, "assistant", "Yes.")] + [(3, t % 2, ["user", "assistant"][t % 2], f"Hi {t}.") for t in range(2)]
    rows = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").union(spark.range(20_000).selectExpr("2L", "0L", "'user'", "'Again.'")).union(spark.sql("SELECT 4L, 0L, 'user', repeat('long text ', 2000000)"))
    faults, edits = R.repair(rows)
    got = {r["conv_id"]: r for r in edits.collect()}
    assert got[2]["audit"] == "K" + "D" * 20_000 + "K" and got[2]["duplicate"] == 20_000 and got[3]["audit"] == "KK" and got[4]["audit"] == "D"
    keep = ["user:Again.", "assistant:Yes."]
    digests = {r["conv_id"]: r["repaired_sha256"] for r in R.repaired_digests(faults, edits).collect()}
    assert digests[2] == hashlib.sha256("\n".join(keep).encode()).hexdigest()
    # turn 0 is cut and turns 50, 100, ... repeat its text
    assert got[1]["truncated"] == 1 and got[1]["duplicate"] == 239 and len(got[1]["audit"]) >= 12_000


# --- op13 ---


def brute_divergence(rows, min_docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, counts, out = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), []
    for text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    for lang in docs:
        kept = {t for t, n in docs[lang].items() if n >= min_docs}
        groups = {s: {t: n for t, n in c.items() if t in kept} for (g, s), c in counts.items() if g == lang}
        total = sum((collections.Counter(c) for c in groups.values()), collections.Counter())
        p = lambda n, of: 1 + 10**9 * (n + 2) // (sum(of.values()) + 2 * len(kept))  # noqa: B023, E731
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in groups.items():
            pairs = sorted((-sum(f(p(c.get(t, 0), c), p(o.get(t, 0), o)) for t in kept), x.encode()) for x, o in groups.items() if x != s)
            terms = sorted((-f(p(n, c), p(total[t], total)), t.encode()) for t, n in c.items() if p(n, c) > p(total[t], total))[:10]
            out += [(lang, s, part, x.decode(), -v, i + 1) for part, ranked in (("pair", pairs), ("term", terms)) for i, (v, x) in enumerate(ranked)]
    return sorted(out)


def test_divergence_equals_brute_force(spark, monkeypatch):
    rng = random.Random(13)
    words = ["Alpha", "alpha", "BETA", "été", "Été", "ß", "日本", "x1y", "don't", "　", "naïve", "K", "aİb", "\x85z"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", "s10", None, "é"])) for _ in range(160)]
    rows += [(None, "en", "empty"), ("", "xx", "alone"), ("rare words only", "yy", "a"), (None, "yy", "b"), ("12 34", "zz", "n")] + [("alpha " * 50, "en", "s1")] * 40
    schema = "text string, LANG string, source string, term string, n string, docs int, lang_n int, `v` int"
    table = spark.createDataFrame([(*r, "t", "n", 1, 2, 3) for r in rows], schema).repartition(5)
    got = sorted(map(tuple, divergence(table).collect()))
    assert got == brute_divergence(rows, 10)
    monkeypatch.setattr("tallyfeed.llm.divergence.HELD", 3)  # tasks hand on what they hold again and again
    monkeypatch.setattr("tallyfeed.llm.divergence.PIECE", 40)
    assert sorted(map(tuple, divergence(table, min_docs=3).collect())) == brute_divergence(rows, 3)
    assert divergence(table.where("false")).count() == 0


def test_cells_of_many_blocks(monkeypatch):
    """Whole terms, however rows are batched and blocks and tallies cut."""
    import pyarrow as pa

    rng = random.Random(1)
    rows = sorted({(rng.choice("xy"), f"t{rng.randint(0, 60)}", f"s{rng.randint(0, 9)}"): rng.randint(1, 3) for _ in range(500)}.items())
    want = collections.Counter()
    for (k, group) in itertools.groupby(rows, lambda r: r[0][:2]):
        for (a, x), (b, y) in itertools.combinations([(r[0][2], r[1]) for r in group], 2):
            want[k[0], a, b, x, y] += 1
    cols = [[*zip(*[r[0] for r in rows], strict=True)][i] for i in range(3)] + [[n for _, n in rows]]
    table = pa.table(cols, names=["lang", "term", "source", "n"])
    for size, block, held in ((1000, 1 << 16, 10**6), (7, 10, 5)):
        monkeypatch.setattr("tallyfeed.llm.divergence.ROWS_AT_ONCE", block)
        monkeypatch.setattr("tallyfeed.llm.divergence.HELD", held)
        got = collections.Counter()
        for out in _cells(iter(table.to_batches(max_chunksize=size))):
            for *cell, m in zip(*[out[c] for c in ("lang", "a", "b", "x", "y", "m")], strict=True):
                got[tuple(cell)] += int(m)
        assert got == want
