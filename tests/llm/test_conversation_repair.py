"""Conversation repair against a search over all edit scripts, and its edge cases."""
import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from shipshape.llm import conversation_repair as cr
from shipshape.llm.queries import LLM_QUERIES
from shipshape.sources.tables import table
from tests.conftest import SMALL

KIND = StructType([StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("role", StringType()),
                   StructField("text", StringType())])
GOOD = re.compile(r"(s?(ua)+)?")


def brute(rows):
    """Cheapest scripts by uniform-cost search over (row, role initials); ties by the audit. ``rows``: (turn, role, text)."""
    faults, seen = [], set()
    for _, role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen
                      else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    # only the last two initials and whether an s began matter for the pattern: a small state, independent of the library's
    heap, done, best = [(0, "", 0, "", ())], set(), None
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        short = roles if len(roles) < 3 else ("s" if roles[0] == "s" else "") + "ua" + roles[-1:]
        if best is not None and cost > best[0]:
            break
        if i == len(rows) and GOOD.fullmatch(roles):
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, out)
            continue
        if (i, short, audit) in done or len(audit) > 2 * len(rows) + 4:
            continue
        done.add((i, short, audit))
        ok = lambda r: re.fullmatch(r"(s?(ua)*u?)?", roles + r)
        for r, name in (("u", "user"), ("a", "assistant")):
            if ok(r):
                heapq.heappush(heap, (cost + 2, audit + "I", i, roles + r, out + (f"{name}:",)))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, roles, out))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                if role[:1] in ("s", "u", "a") and ok(role[:1]):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + role[:1], out + (f"{role}:{text}",)))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if ok(r):
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, roles + r, out + (f"{name}:{text}",)))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = zip([r for _, r, _ in rows], [r for _, r, _ in rows][1:])
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in pairs), best[0], best[1],
            hashlib.sha256("\n".join(best[2]).encode()).hexdigest())


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def test_program_against_search():
    rng = random.Random(5)
    for n in range(250):
        rows = in_order([(rng.choice([None, *range(7)]), rng.choice(["user", "assistant", "system", "tool", " "]),
                          rng.choice(["One.", "two", "Three!", "", " \n", "Is it?"])) for _ in range(rng.randrange(7))])
        c, seen = cr.Conversation(cr.Steps(), 2), set()
        for turn, role, text in rows:
            c.add(turn, role, text, (role, text) in seen)
            seen.add((role, text))
        assert c.result() == brute(rows), (n, rows)


def damage(rows):
    """The contract's damage in plain Python."""
    out = {}
    for conv, turn, role, text in rows:
        group = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(key.encode()) % 20
        if k:
            row = (turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            group += [row] * (1 + (k == 3))
    return {k: in_order(v) for k, v in out.items()}


def test_query_against_search(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = {k: brute(v) for k, v in damage(rows).items()}
    got = LLM_QUERIES["op11_conversation_repair"](spark, SMALL).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                                    "repaired_sha256")) == want[r.conv_id]


def test_edges(spark):
    rows = [(1, None, None, None), (1, None, None, None), (1, 3, "user", "Hi."), (None, 1, "user", "Alone"),
            (None, None, "assistant", "Yes."), (2, 0, "user", ""), (2, 5, "tool", "x" * 300_000 + "."), (3, 1, "user", "A."),
            (3, 1, "user", "A."), (3, 1, "assistant", "B."), (4, 7, "", "No role."), (5, 2, "system", "S."),
            (6, 2, "user", "\U0001f600."), (6, 3, "assistant", "tail  ")]
    df = spark.createDataFrame(rows, KIND).withColumn("seen", F.lit("clash")).withColumn("copy", F.lit(1))
    got = {r.conv_id: tuple(r)[2:] for r in cr.repair(df).collect()}
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert got == {k: brute(in_order(v)) for k, v in groups.items()}
    assert cr.repair(df.limit(0)).count() == 0
    hurt = {r.conv_id: tuple(r)[2:] for r in cr.repair(cr.damaged(df)).collect()}
    assert hurt == {k: brute(v) for k, v in damage(rows).items()}


def test_conversation_without_rows(spark):
    gone = [c for c in range(1, 200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    df = spark.createDataFrame([(c, 0, "user", "Hi.") for c in gone], KIND)
    got = cr.repair(cr.damaged(df)).collect()
    assert {r.conv_id for r in got} == set(gone)
    assert {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("spill", [1, 7, 1 << 16])
def test_giant_conversation_streams(spark, spill):
    """One conversation over many batches and partitions, among small ones, with backpointers spilled."""
    rng = random.Random(9)
    rows = [(7, i, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "", f"{i}."])) for i in range(30_000)]
    small = [(c, 0, "user", "Hi.") for c in range(100, 140)]
    df = spark.createDataFrame(rows + small, KIND).repartition(9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    try:
        got = {r.conv_id: tuple(r)[2:] for r in cr.repair(df, spill).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    c, seen = cr.Conversation(cr.Steps(), 1 << 20), set()
    for _, turn, role, text in rows:
        c.add(turn, role, text, (role, text) in seen)
        seen.add((role, text))
    assert got[7] == c.result() and len(got) == 41
    kept = [(k, r) for k, r in zip(got[7][6].replace("I", ""), rows)]
    assert len(kept) == len(rows)
