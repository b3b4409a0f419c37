"""Repair of conversations' structure by least edits, found by an auction.

A conversation's roles must read ``(s?(ua)+)?`` by their initials. Its rows and the
states of that pattern make a lattice: an arc keeps a row (0), gives it the role user
or assistant (2), deletes it (3) or inserts an empty turn before the next row (2); a
truncated row that stays costs 1 more; blank and repeated ones have to go. Nodes have
prices, and a path grows from a node along the arc whose cost and far price are least:
where that is more than the node's price, the price rises and the path contracts, else
it extends. Columns are settled from the last row to the first, so a path ends where it
meets a settled price; columns of equal kind and prices are settled once. The prices are
then the least costs to the end, arcs whose cost is the difference of their prices are
tight, and following tight arcs by the least letter gives the first cheapest audit.

A task reads the rows of a conversation twice in one sorted stream: first their marks
without texts, from which the prices and the audit follow, then the texts, which are
repaired as they pass. It holds some bytes a row, about as many as the audit, and one
text, so a conversation may have any number of rows; but all of it is one task's, as
its digest is one hash over its texts in order.

Defined cases: a null role or text is one space; rows are ordered by turn, nulls first,
then by role, then by the hash of role and text; repeated rows are duplicates; a null
conv_id is a conversation; an empty table gives no rows; other columns, whatever their
names, are ignored. A conversation named in ``every`` without rows has zeros, an empty
audit and the hash of the empty string.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, byte_slices, give_back

WHITE = " \t\n\v\f\r"
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
KEEP, REROLE, DELETE, INSERT, ROUGH = 0, 2, 3, 2, 1
#: States: nothing yet, after the system's turn, after a user's, after an assistant's; and where each role's initial leads.
NEXT: list[dict[str, int]] = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
ROLE = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: The state that a turn of user or assistant leads to, and that turn's role.
TURN = [next((t, ROLE[c]) for c, t in own.items() if c in ROLE) for own in NEXT]
END = ("", -1)
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


@functools.cache
def arcs(kind: tuple[str, int]) -> list[list[tuple[str, int, int]]]:
    """Letter, cost and target of the arcs of each state in a column of a row's initial and fault; targets from 4 on are the next column's."""
    out: list[list[tuple[str, int, int]]] = []
    for state, own in enumerate(NEXT):
        here = [("I", INSERT, TURN[state][0])]
        if kind == END:
            here += [("", 0, 4)] if state in (0, 3) else []
        else:
            initial, fault = kind
            here.append(("D", DELETE, 4 + state))
            if fault in (SOUND, TRUNCATED):
                rough = ROUGH * (fault == TRUNCATED)
                here += [("K", KEEP + rough, 4 + own[initial])] if initial in own else []
                here.append(("R", REROLE + rough, 4 + TURN[state][0]))
        out.append(sorted(here))
    return out


@functools.lru_cache(100_000)
def settled(kind: tuple[str, int], right: tuple[int, ...]) -> tuple[int, ...]:
    """The prices of a column, given the settled ones of the next (or of the end alone)."""
    # no arc costs less than nothing, so the least price of the next column is none too high
    price = [min(right)] * 4 + list(right)
    for origin in range(4):
        path = [origin]
        while path[-1] < 4:
            i = path[-1]
            best, j = min((cost + price[j], j) for _, cost, j in arcs(kind)[i])
            if price[i] < best:
                price[i] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(j)
    return tuple(price[:4])


class Lattice:
    """A conversation's rows by initial and fault, and the prices of each column above the last one's least."""

    def __init__(self) -> None:
        self.kinds: list[tuple[str, int]] = []
        self.numbers: dict[tuple[str, int], int] = {}
        self.rows = bytearray()

    def add(self, initial: str, fault: int) -> None:
        kind = (initial if initial in ("s", "u", "a") else "", fault)
        if kind not in self.numbers:
            self.numbers[kind] = len(self.kinds)
            self.kinds.append(kind)
        self.rows.append(self.numbers[kind])

    def audit(self) -> tuple[int, bytearray]:
        """The least cost, and the first of the cheapest edits' letters."""
        right = settled(END, (0,))
        above = bytearray(right)  # prices less the column's least, and by how much that rises from column to column
        rises = bytearray(1)
        total = 0
        for row in reversed(self.rows):
            own = settled(self.kinds[row], right)
            least = min(own)
            total += least
            rises.append(least)
            right = tuple(p - least for p in own)
            above += bytes(right)
        out, state, column = bytearray(), 0, len(self.rows)
        cost = total + right[0]
        while True:
            kind = self.kinds[self.rows[-column]] if column else END
            price = above[4 * column + state] + rises[column]
            for letter, paid, j in arcs(kind)[state]:
                far = above[4 * column + j] + rises[column] if j < 4 else above[4 * (column - 1) + j - 4] if column else 0
                if price == paid + far:
                    break
            if not letter:
                return cost, out
            out += letter.encode()
            if j >= 4:
                column -= 1
            state = j % 4


class Conversation:
    """One conversation as its rows pass: first marks, then texts."""

    def __init__(self) -> None:
        self.lattice = Lattice()
        self.counts = [0, 0, 0, 0]
        self.illegal = self.distinct = 0
        self.low = self.high = self.turn = self.before = self.key = None
        self.audit: bytearray | None = None
        self.cost = self.at = self.state = 0
        self.digest, self.wrote = hashlib.sha256(), False

    def mark(self, turn: int | None, initial: str, key: bytes, fault: int, again: bool) -> None:
        if self.before is not None:
            self.illegal += self.before + initial not in LEGAL
            again = again or (self.turn == turn and self.key == key)
        if turn is not None and turn != self.high:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.distinct += 1
        fault = BLANK if fault == BLANK else DUPLICATE if again else fault
        self.counts[fault] += 1
        self.lattice.add(initial, fault)
        self.before, self.turn, self.key = initial, turn, key

    def say(self, edit: str, role: str, text: str) -> tuple[str, str, str]:
        self.digest.update((("\n" if self.wrote else "") + f"{role}:{text}").encode())
        self.wrote = True
        return edit, role, text

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        if self.audit is None:
            self.cost, self.audit = self.lattice.audit()
        while self.at < len(self.audit) and self.audit[self.at] == ord("I"):
            self.at += 1
            self.state, role = TURN[self.state]
            yield self.say("I", role, "")

    def read(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """The turns that come of the next row: edit, role and text."""
        yield from self.inserted()
        letter = chr(self.audit[self.at])
        self.at += 1
        if letter == "K":
            self.state = NEXT[self.state][role[:1]]
            yield self.say("K", role, text)
        elif letter == "R":
            self.state, role = TURN[self.state]
            yield self.say("R", role, text)

    def report(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (gaps, *self.counts[1:], self.illegal, self.cost, self.audit.decode(), self.digest.hexdigest())


def stream(conversations: DataFrame, every: DataFrame) -> DataFrame:
    """The sorted stream that tasks read: for each conversation a row of its own, its rows' marks, its rows' texts."""
    own = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *own)
    rows = rows.withColumn("key", F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"))))
    said = F.rtrim("text", F.lit(WHITE))
    fault = F.when(said == "", BLANK).when(~F.right(said, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    marks = rows.select("conv_id", "turn", "role", "key", fault.alias("fault"))
    # of a role and text said several times the least turn, nulls first
    several = marks.groupBy("conv_id", "key").agg(F.count("*").alias("n"), F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("first")).where("n > 1")
    same = F.col("m.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("m.key") == F.col("s.key"))
    again = F.col("first").isNotNull() & ~F.equal_null("first.turn", F.col("turn"))
    marks = marks.alias("m").join(several.alias("s"), same, "left").select("m.conv_id", "turn", "role", "m.key", "fault", again.alias("again"))
    parts = [
        every.select("conv_id").distinct().withColumn("part", F.lit(0)),
        marks.withColumn("part", F.lit(1)),
        rows.withColumn("part", F.lit(2)),
    ]
    all_ = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return all_.repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "key")


def repair(conversations: DataFrame, every: DataFrame | None = None, turns: bool = False) -> DataFrame:
    """conv_id and its report: gaps in the turns' numbers, rows by fault, illegal neighbours, least cost, audit
    and the hash of the repaired turns. With turns, the repaired turns instead: conv_id, pos, edit, role, text.

    conversations: conv_id, turn, role, text. every: conversations (conv_id) to be reported besides."""
    kind = dict(conversations.dtypes)["conv_id"]
    rows = stream(bounded(conversations), conversations if every is None else every.select("conv_id").unionByName(conversations.select("conv_id")))
    names = ["conv_id", "pos", "edit", "role", "text"] if turns else ["conv_id", *(c.split()[0] for c in REPORT.split(", "))]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, who, pos = None, None, 0
        types = None

        def ended(out: list) -> None:
            nonlocal pos
            for turn in now.inserted():
                pos += 1
                if turns:
                    out.append((who, pos, *turn))
            if not turns:
                out.append((who, *now.report()))

        def packed(out: list) -> pa.RecordBatch:
            kinds = [types, pa.int64(), *[pa.string()] * 3] if turns else [types, *[pa.int64()] * 6, *[pa.string()] * 2]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], names=names)

        for batch in byte_slices(batches, "text", 1 << 20):
            types = batch.schema.field("conv_id").type
            out: list = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "part", "turn", "role", "key", "fault", "again", "text")]
            for conv, part, turn, role, key, fault, again, text in zip(*columns):
                if part == 0:
                    if now is not None:
                        ended(out)
                    now, who, pos = Conversation(), conv, 0
                elif part == 1:
                    now.mark(turn, role[:1], key, fault, again)
                else:
                    for one in now.read(role, text):
                        pos += 1
                        if turns:
                            out.append((who, pos, *one))
            if out:
                yield packed(out)
        if now is not None:
            out = []
            ended(out)
            if out:
                yield packed(out)
        give_back()

    return rows.mapInArrow(of, f"conv_id {kind}, pos long, edit string, role string, text string" if turns else f"conv_id {kind}, {REPORT}")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows as a fixed rule damages them, by the checksum of conv_id and turn modulo 20: 0 drops a row, 1 empties its
    text, 2 takes its full stops and the like, 3 repeats it, 4 makes it a user's. Nulls are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    chance: Column = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), chance.alias("c")).where("c != 0")
    text = F.when(F.col("c") == 1, "").when(F.col("c") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("c") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("c") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def sql() -> str:
    """The query's report in DuckDB's SQL: edits by recursion over a conversation's rows from the last to the first, whose
    costs and letters are one string that compares like both, then over the audit's letters."""
    said = "coalesce(CAST({} AS VARCHAR), ' ')".format
    step = "list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(w, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: {step}), 4294967295)"
    add = lambda v, n, letter: f"(lpad(CAST(CAST({v}[:9] AS BIGINT) + {n} AS VARCHAR), 9, '0') || '{letter}' || {v}[10:])"
    none = "'099999999'"
    rough = f"(CASE WHEN fault = {TRUNCATED} THEN {ROUGH} ELSE 0 END)"
    options = []
    for s, own in enumerate(NEXT):
        keeps = "".join(f" WHEN '{c}' THEN {add(f'p{t}', f'{KEEP} + {rough}', 'K')}" for c, t in own.items())
        options.append(f"least({add(f'p{s}', DELETE, 'D')}, CASE WHEN fault IN ({SOUND}, {TRUNCATED}) THEN least(CASE initial{keeps} END, {add(f'p{TURN[s][0]}', f'{REROLE} + {rough}', 'R')}) END) AS x{s}")
    # of two states whose inserted turns lead to each other, one insertion is enough
    settle = f"SELECT conv_id, n, least(x0, {add('q2', INSERT, 'I')}) AS p0, least(x1, {add('q2', INSERT, 'I')}) AS p1, q2 AS p2, q3 AS p3 FROM (SELECT *, least(x2, {add('x3', INSERT, 'I')}) AS q2, least(x3, {add('x2', INSERT, 'I')}) AS q3 FROM ({{}}) x) q"
    first = settle.format(f"SELECT conv_id, max(pos) AS n, '000000000' AS x0, {none} AS x1, {none} AS x2, '000000000' AS x3 FROM marks GROUP BY conv_id")
    then = settle.format(f"SELECT prices.conv_id, n - 1 AS n, {', '.join(options)} FROM prices JOIN marks ON marks.conv_id IS NOT DISTINCT FROM prices.conv_id AND pos = n")
    turned = "CASE state " + " ".join(f"WHEN {s} THEN {t}" for s, (t, _) in enumerate(TURN)) + " END"
    role_of = "CASE state " + " ".join(f"WHEN {s} THEN '{r}'" for s, (_, r) in enumerate(TURN)) + " END"
    kept = "CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END"
    white = " || ".join(f"chr({ord(c)})" for c in WHITE)
    return f"""
WITH RECURSIVE damaged AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE r END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(t, '.!?', '') ELSE t END AS text
  FROM (SELECT conv_id, turn, r, t, d, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM
    (SELECT conv_id, turn, {said("role")} AS r, {said("text")} AS t, {crc} % 20 AS d FROM (SELECT *, {said("conv_id")} || ':' || {said("turn")} AS w FROM conversations) a) b) c),
marks AS (SELECT *, CASE WHEN ending = '' THEN {BLANK} WHEN again > 1 THEN {DUPLICATE} WHEN right(ending, 1) NOT IN ('.', '!', '?') THEN {TRUNCATED} ELSE {SOUND} END AS fault FROM
  (SELECT *, role[:1] AS initial, rtrim(text, {white}) AS ending, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS again FROM
    (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS pos FROM damaged) o) a),
prices AS ({first} UNION ALL {then}),
audits AS (SELECT conv_id, CAST(p0[:9] AS BIGINT) AS cost, p0[10:] AS audit FROM prices WHERE n = 0),
replay AS (SELECT conv_id, audit, 0 AS k, 0 AS j, 0 AS state, CAST(NULL AS VARCHAR) AS said FROM audits
  UNION ALL SELECT r.conv_id, audit, k + 1, CASE letter WHEN 'I' THEN j ELSE j + 1 END, CASE letter WHEN 'D' THEN state WHEN 'K' THEN {kept} ELSE {turned} END,
    CASE WHEN letter = 'D' THEN said ELSE concat_ws(chr(10), said, CASE letter WHEN 'I' THEN {role_of} || ':' WHEN 'R' THEN {role_of} || ':' || text ELSE role || ':' || text END) END
  FROM (SELECT *, audit[k + 1 : k + 1] AS letter FROM replay WHERE k < length(audit)) r LEFT JOIN marks ON marks.conv_id IS NOT DISTINCT FROM r.conv_id AND pos = j + 1),
pairs AS (SELECT conv_id, initial, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM marks),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = {BLANK}) AS blank, count(*) FILTER (fault = {DUPLICATE}) AS duplicate, count(*) FILTER (fault = {TRUNCATED}) AS truncated FROM marks GROUP BY conv_id),
breaks AS (SELECT conv_id, count(*) FILTER (before || initial NOT IN ({", ".join(f"'{x}'" for x in sorted(LEGAL))})) AS illegal FROM pairs GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(a.audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN breaks b ON b.conv_id IS NOT DISTINCT FROM e.conv_id
  LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN replay r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND k = length(a.audit)
"""
