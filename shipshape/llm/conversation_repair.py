"""Repair of conversation structure: a dynamic program over the turns, streamed.

Rows are repartitioned by conversation and sorted by turn; ``mapInPandas`` then carries the program's
state across Arrow batches, so a conversation may be of any length. The roles wanted, ``(s?(ua)+)?``,
are an automaton of four states. Of each state the cheapest way to reach it is kept, ties by the
audit that is least in ASCII; since the audits of different states never are prefixes of one
another when they end in an edit of a row, the order of the four is all that later ties need.
Costs relative to the cheapest state and that order take few values, so a row's step is looked up in
a table of the steps met so far, and the backpointers of a row are one small number: they are spilled
to a temporary file of the task once a conversation has more than ``SPILL_ROWS`` rows.
"""
from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shipshape.llm.common import ship

#: Rows whose backpointers a task holds in memory before they go to its temporary file.
SPILL_ROWS = 1 << 16
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Automaton: state -> {role initial: next state}. 0 nothing yet, 1 after s, 2 after u, 3 after a (accepts, as 0).
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTS = (0, 3)
#: What a reroled or inserted turn becomes in each state.
WANTED = ("u", "u", "a", "u")
ROLE = {"u": "user", "a": "assistant"}

SCHEMA = ("conv_id long, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, repaired_sha256 string")
_SPACES = " \t\n\x0b\x0c\r"


def _inserts(state: int, most: int) -> list[tuple[str, int]]:
    """(block of inserts, state after them) for 0 to ``most`` inserts."""
    out, block = [], ""
    for _ in range(most + 1):
        out.append((block, state))
        block, state = block + "I", NEXT[state][WANTED[state]]
    return out


class Steps:
    """The steps of the program. ``at`` is a tuple of (cost above the least, rank) or None for each state."""

    FIRST = ((0, 0), None, None, None)

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.rows: list[tuple] = []  # by number: (next at, cost added, ((previous state, block) or None) by state)

    def step(self, at: tuple, initial: str, must_go: bool, truncated: bool) -> int:
        key = (at, initial, must_go, truncated)
        got = self.known.get(key)
        if got is None:
            got = self.known[key] = len(self.rows)
            self.rows.append(self._solve(*key))
        return got

    @staticmethod
    def _solve(at, initial, must_go, truncated) -> tuple:
        best: list = [None] * 4
        for s, held in enumerate(at):
            if held is None:
                continue
            for block, mid in _inserts(s, 2):
                base, more = held[0] + INSERT * len(block), TRUNCATED * truncated
                edits = [("D", mid, DELETE)]
                if not must_go:
                    if initial in NEXT[mid]:
                        edits.append(("K", NEXT[mid][initial], KEEP + more))
                    edits.append(("R", NEXT[mid][WANTED[mid]], REROLE + more))
                for letter, to, price in edits:
                    found = (base + price, held[1], block + letter, s)
                    if best[to] is None or found < best[to]:
                        best[to] = found
        least = min(b[0] for b in best if b)
        order = sorted((b[1], b[2], s) for s, b in enumerate(best) if b)
        rank = {s: i for i, (_, _, s) in enumerate(order)}
        return (tuple(b and (b[0] - least, rank[s]) for s, b in enumerate(best)), least,
                tuple(b and (b[3], b[2]) for b in best))

    @staticmethod
    def end(at: tuple) -> tuple[int, int, str]:
        """(cost above the least, state left, closing inserts) of the cheapest end."""
        found = [(held[0] + INSERT * len(block), held[1], block, s) for s, held in enumerate(at) if held
                 for block, end in _inserts(s, 3) if end in ACCEPTS]
        cost, _, block, s = min(found)
        return cost, s, block


class Spill:
    """Numbers appended in order and read back from the last to the first."""

    def __init__(self, most: int = SPILL_ROWS):
        self.most, self.part, self.file, self.parts = most, array("I"), None, 0

    def append(self, n: int) -> None:
        self.part.append(n)
        if len(self.part) >= self.most:
            if self.file is None:
                self.file = tempfile.TemporaryFile()  # of this task only: gone when closed
            self.part.tofile(self.file)
            self.part, self.parts = array("I"), self.parts + 1

    def backwards(self) -> Iterator[int]:
        yield from reversed(self.part)
        size = self.most * array("I").itemsize
        for i in reversed(range(self.parts)):
            self.file.seek(i * size)
            part = array("I")
            part.frombytes(self.file.read(size))
            yield from reversed(part)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Conversation:
    """The program over one conversation; ``add`` takes its damaged rows in order."""

    def __init__(self, steps: Steps, spill_rows: int = SPILL_ROWS):
        self.steps, self.at, self.cost, self.path = steps, Steps.FIRST, 0, Spill(spill_rows)
        self.blank = self.duplicate = self.truncated = self.illegal = self.rows = self.distinct = 0
        self.first = self.last = self.before = None
        #: For each state the digest of what has been repaired on the cheapest way to it, and whether it has a line.
        self.digests: list = [(hashlib.sha256(), False), None, None, None]

    def _lines(self, digest, blocks: str, state: int, role: str, text: str):
        """The digest after the edits of ``blocks`` from ``state`` on; role and text are the row's."""
        if blocks == "D":
            return digest
        sha, begun = digest[0].copy(), digest[1]
        for letter in blocks:
            if letter == "D":
                continue
            kept = letter == "K"
            to = role[:1] if kept else WANTED[state]
            line = f"{role if kept else ROLE[to]}:{'' if letter == 'I' else text}"
            sha.update((("\n" if begun else "") + line).encode("utf-8", "surrogatepass"))
            begun, state = True, NEXT[state][to]
        return sha, begun

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        words = text.rstrip(_SPACES)
        blank, duplicate = not words, bool(words) and seen
        truncated = bool(words) and not seen and words[-1] not in ".!?"
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        if self.rows and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None:
            if self.first is None:
                self.first = turn
            self.distinct += self.last != turn
            self.last = turn
        self.rows, self.before = self.rows + 1, role[:1]
        number = self.steps.step(self.at, role[:1], blank or duplicate, truncated)
        self.at, more, back = self.steps.rows[number]
        self.cost += more
        self.path.append(number)
        self.digests = [b and self._lines(self.digests[b[0]], b[1], b[0], role, text) for b in back]

    def result(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, sha256 of the repaired lines."""
        more, state, block = self.steps.end(self.at)
        sha = self._lines(self.digests[state], block, state, "", "")[0].hexdigest()
        parts = [block]
        for number in self.path.backwards():
            state, block = self.steps.rows[number][2][state]
            parts.append(block)
        self.path.close()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + more,
                "".join(reversed(parts)), sha)


def repair(rows: DataFrame, spill_rows: int = SPILL_ROWS) -> DataFrame:
    """One row per conversation: conv_id, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` has conv_id, turn, role, text; further columns are not read, and a column ``gone`` of
    true marks a row that is left out but whose conversation is still reported (zeros, empty audit,
    digest of nothing). Null roles and texts are read as one space, so such a text is blank and such
    a role has to be changed; a null conv_id is a conversation of its own. Turns sort nulls first,
    equal turns by role and then text; null turns count for no gap. A row is a duplicate if role and
    text were seen earlier. Repeated rows are duplicates of one another. Roles are matched by their
    first letter: s, u, a; others are changed or deleted. Texts may have any length; a conversation
    of any length is streamed through one task, as its digest asks for. An empty table gives none.
    """
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        steps, out, names = Steps(), [], [c.split()[0] for c in SCHEMA.split(", ")]
        now, key = None, None

        def closed():
            out.append((key[0], now.rows, *now.result()))

        def frame():
            f = pd.DataFrame(out, columns=names)
            f["conv_id"] = f["conv_id"].astype("Int64")
            out.clear()
            return f

        for b in batches:
            for conv, turn, role, text, seen, gone in zip(*(b[c].array for c in ("conv_id", "turn", "role", "text", "seen",
                                                                                  "gone"))):
                conv = None if pd.isna(conv) else int(conv)
                if now is None or key[0] != conv:
                    if now is not None:
                        closed()
                        if len(out) >= 2000:
                            yield frame()
                    now, key = Conversation(steps, spill_rows), (conv,)
                if not gone:
                    now.add(None if pd.isna(turn) else int(turn), role, text, bool(seen))
        if now is not None:
            closed()
        if out:
            yield frame()

    ship(rows.sparkSession)
    space = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" ")).alias(c)
    gone = F.coalesce(rows["gone"], F.lit(False)) if "gone" in rows.columns else F.lit(False)
    d = rows.select(rows["conv_id"].cast("long").alias("conv_id"), rows["turn"].cast("long").alias("turn"), space("role"),
                    space("text"), gone.alias("gone")).repartition("conv_id")
    # one shuffle: both orders below are within the partitions that the repartitioning made
    first = Window.partitionBy("conv_id", "gone", "role", F.sha2("text", 256)).orderBy("turn")
    d = d.withColumn("seen", F.row_number().over(first) > 1)
    return d.sortWithinPartitions("conv_id", "turn", "role", "text", "seen").mapInPandas(run, SCHEMA)


def damaged(conversations: DataFrame) -> DataFrame:
    """The conversations after damage by crc32 of ``conv_id:turn`` (nulls as one space), modulo 20: 0 marks the
    row as gone, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3
    repeats it, 4 makes its role user."""
    c = conversations
    space = lambda x: F.coalesce(x.cast("string"), F.lit(" "))
    fault = F.crc32(F.encode(F.concat(space(c["conv_id"]), F.lit(":"), space(c["turn"])), "UTF-8")) % 20
    text, role = space(c["text"]), space(c["role"])
    out = c.select(c["conv_id"].alias("conv_id"), c["turn"].alias("turn"), fault.alias("fault"),
                   F.when(fault == 4, "user").otherwise(role).alias("role"),
                   F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return out.select("conv_id", "turn", "role", "text", (F.col("fault") == 0).alias("gone"), copies.alias("copy")).drop("copy")
