"""Conversation repair against a brute-force version: shortest edit strings by uniform-cost search, without signatures, halves or chunks."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stratavox.llm import conversations as conv

SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        plain = re.sub(r"[\x20\x09-\x0D]+", "", text)
        out.append("blank" if not plain else "duplicate" if (role, text) in seen else "truncated" if plain[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, bad):
    """(cost, audit, repaired rows): all edit strings in order of cost, then ASCII."""
    queue = [(0, "", 0, ())]
    while queue:
        cost, audit, i, made = heapq.heappop(queue)
        initials = "".join(r[:1] or "?" for r, _ in made)
        if i == len(rows) and GOOD.fullmatch(initials):
            return cost, audit, made
        if not re.fullmatch(r"s?(ua)*u?", initials):
            continue
        if not audit.endswith("III"):
            for r in ("user", "assistant"):
                heapq.heappush(queue, (cost + 5, audit + "I", i, (*made, (r, ""))))
        if i < len(rows):
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, made))
            if bad[i] not in ("blank", "duplicate"):
                more = 5 if bad[i] else 0
                heapq.heappush(queue, (cost + more, audit + "K", i + 1, (*made, rows[i])))
                for r in ("user", "assistant"):
                    heapq.heappush(queue, (cost + more + 1, audit + "R", i + 1, (*made, (r, rows[i][1]))))


def report(rows):
    """conv_id -> figures, of rows that are damaged already."""
    groups = defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((t is not None, t or 0, " " if r is None else r, " " if x is None else x))
    out = {}
    for c, g in groups.items():
        g.sort()
        turns, rows_ = [t for there, t, _, _ in g if there], [(r, x) for _, _, r, x in g]
        bad = faults(rows_)
        cost, audit, made = cheapest(rows_, bad)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows_))
        text = "\n".join(f"{r}:{x}" for r, x in made)
        out[c] = (gaps, bad.count("blank"), bad.count("duplicate"), bad.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def damage(rows):
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if how:
            x = "" if how == 1 else re.sub("[.!?]", "", x) if how == 2 else x
            yield from [(c, t, "user" if how == 4 else r, x)] * (2 if how == 3 else 1)


def found(df):
    return {r[0]: tuple(r[1:9]) for r in df.collect()}


def some(r, n, roles=("user", "assistant", "system", "tool", "", None)):
    return [(r.choice(roles), r.choice(["Yes.", "No!", "half", " ", "", None, "a?", "b. ", f"t{r.random()}."])) for _ in range(n)]


@pytest.mark.parametrize("chunk", [1, 2, 3, 256])
def test_reports_equal_brute_force(spark, monkeypatch, chunk):
    # Chunks are cut by the workers, so the size goes there in the function, not by this process.
    r = random.Random(chunk)
    rows = [(c if c else None, r.choice([None, *range(9)]), *x) for c in range(120) for x in some(r, r.randrange(1, 7))]
    if chunk != 256:
        tables = conv.solve("".join(conv.mark(a or " ", f) for (_, _, a, _), f in zip(rows[:60], ["", "truncated", "blank"] * 20)))
        parts = ["".join(conv.mark(a or " ", f) for (_, _, a, _), f in zip(rows[:60], ["", "truncated", "blank"] * 20))[i : i + chunk] for i in range(0, 60, chunk)]
        whole, cut = conv.best_edits([tables]), conv.best_edits([conv.solve(p) for p in parts])
        assert whole[0] == cut[0] and "".join(e for _, e in whole[1]) == "".join(e for _, e in cut[1])
        return
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(conv.repair_report(df)) == report(rows)


def test_long_conversations_are_repaired_in_chunks(spark):
    r = random.Random(2)
    long = [(7, i, ["user", "assistant"][i % 2] if r.random() < 0.9 else "tool", f"t{i}" + r.choice([".", ".", ".", ".", ""])) for i in range(1000)]
    rows = [*long, (8, 0, "user", "Hello?"), (8, 1, "assistant", "Hello."), (9, 0, "system", "Only.")]
    got = found(conv.repair_report(spark.createDataFrame(rows, SCHEMA).repartition(4)))
    bad = faults([(a, x) for _, _, a, x in long])
    table = conv.solve("".join(conv.mark(a, f) for (_, _, a, _), f in zip(long, bad)))
    cost, parts = conv.best_edits([table])
    turns = [(a, x) for s, e in parts for _, a, x in conv.replay(s, e, [(a, x) for _, _, a, x in long])]
    assert GOOD.fullmatch("".join(a[0] for a, _ in turns))
    assert got[7][5:] == (cost, "".join(e for _, e in parts), hashlib.sha256("\n".join(f"{a}:{x}" for a, x in turns).encode()).hexdigest())
    assert got[8][5:7] == (0, "KK") and got[9][5:7] == (2, "D")
    out = conv.repair_rows(spark.createDataFrame(rows, SCHEMA)).filter("conv_id = 7").orderBy("place").collect()
    assert [(x.role, x.text) for x in out] == turns and [x.place for x in out] == list(range(len(turns)))


def test_all_short_signatures_equal_brute_force():
    for n in range(4):
        for signature in itertools.product("suaxSUAXd", repeat=n):
            rows = [({"s": "system", "u": "user", "a": "assistant", "x": "tool", "d": "tool"}[m.lower()], "" if m == "d" else f"{i}" + ("" if m.isupper() else ".")) for i, m in enumerate(signature)]
            cost, audit, _ = cheapest(rows, ["blank" if m == "d" else "truncated" if m.isupper() else "" for m in signature])
            if n:
                assert (cost, audit) == (lambda c, p: (c, "".join(e for _, e in p)))(*conv.best_edits([conv.solve("".join(signature))])), signature


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conv.repair_report(empty).count() == 0 and conv.repair_rows(empty).count() == 0
    odd = spark.createDataFrame([(1, 0, "user", "a.", "k", 0), (1, 1, "assistant", "b" * 100_000 + ".", "k", 1)], SCHEMA + ", key string, chunk int")
    assert found(conv.repair_report(odd))[1][5:7] == (0, "KK")


def test_query_equals_brute_force(spark, small):
    rows = [tuple(x) for x in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = report(list(damage(rows)))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = found(conv.op11_conversation_repair(spark, small))
    assert got == {c: want.get(c, nothing) for c in {x[0] for x in rows}}


def test_damage_of_nulls_and_lost_conversations(spark, tmp_path):
    r = random.Random(9)
    rows = [(None if c % 50 == 0 else c, r.choice([None, 0, 1, 2, 3]), *x) for c in range(300) for x in some(r, r.randrange(1, 4))]
    spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    want = report(list(damage(rows)))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = found(conv.op11_conversation_repair(spark, str(tmp_path)))
    assert got == {c: want.get(c, nothing) for c in {x[0] for x in rows}} and nothing in got.values()
