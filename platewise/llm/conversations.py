"""Repair of conversation structure by iterative-deepening A*.

A repaired conversation has roles whose initials read ``(s?(ua)+)?``: maybe a system turn, then user and assistant in turn.
Edits lead there: keep a turn (K, cost 0), name its role anew (R, 1), delete it (D, 2) or insert an empty one (I, 5). A blank or
duplicate turn must be deleted, and a truncated one that stays costs 5 more.

The search is a depth-first one over (turn, what the roles before it allow), in ASCII order of the edits, under a bound on cost
that starts at an admissible estimate and grows by one. A table keeps the largest budget that failed at each state. The first
path that is accepted is the cheapest, and of the cheapest the least in ASCII order. Its estimate counts two for each faulty turn
ahead; over LONG turns it is the exact cost to go, from one backward sweep, so the first bound holds a path and no state on it fails.

Turns are told by a 128-bit hash of role and text. For the search a turn is one byte, so a task holds one byte (and over LONG
turns 16 more) per turn of one conversation, and never its texts: they come in order after the search, are edited and hashed as
they stream by. The audit and the hash of one conversation are one value each, so they are made in one task, like any value.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from platewise.llm.common import table

#: What an edit costs; TRUNCATED is for a truncated turn that stays.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Conversations of more turns are searched with the exact cost to go as the estimate.
LONG = 512

#: Allowed next: at the start, after system, after user, after assistant. A conversation may end at START or ASSISTANT.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: State after an initial (s, u, a) from a state; None: not allowed.
NEXT = ((SYSTEM, USER, None), (None, USER, None), (None, None, ASSISTANT), (None, USER, None))
#: State after the one of user and assistant that may be named or inserted in a state.
NAMED = (USER, USER, ASSISTANT, USER)

#: A turn's symbol is its initial (0 s, 1 u, 2 a, 3 other) plus 4 times its fault.
CLEAN, MUST_GO, CUT_OFF = range(3)


def steps(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of the edits that use up a turn, in ASCII order."""
    initial, fault = symbol & 3, symbol >> 2
    found = [("D", DELETE, state)]
    if fault != MUST_GO:
        more = TRUNCATED if fault == CUT_OFF else 0
        if initial < 3 and NEXT[state][initial] is not None:
            found.append(("K", more, NEXT[state][initial]))
        found.append(("R", RENAME + more, NAMED[state]))
    return found


STEPS = [[steps(symbol, state) for state in range(4)] for symbol in range(12)]


def cost_to_go(symbols: bytes) -> array:
    """The exact cost from (turn, state) to an accepted end, at 4 * turn + state; the last four are the end."""
    far = 1 << 30
    todo = array("i", bytes(16 * (len(symbols) + 1)))

    def with_inserts(row: list[int]) -> list[int]:
        for _ in range(2):
            row = [min(c, INSERT + row[NAMED[s]]) for s, c in enumerate(row)]
        return row

    row = with_inserts([0 if s in ENDS else far for s in range(4)])
    todo[4 * len(symbols) :] = array("i", row)
    for i in range(len(symbols) - 1, -1, -1):
        row = with_inserts([min(cost + row[to] for _, cost, to in STEPS[symbols[i]][s]) for s in range(4)])
        todo[4 * i : 4 * i + 4] = array("i", row)
    return todo


def faulty_ahead(symbols: bytes) -> array:
    """An admissible estimate in the same places: a faulty turn costs two at least."""
    todo = array("i", bytes(16 * (len(symbols) + 1)))
    ahead = 0
    for i in range(len(symbols) - 1, -1, -1):
        ahead += min(DELETE, TRUNCATED) * (symbols[i] >> 2 != CLEAN)
        todo[4 * i : 4 * i + 4] = array("i", [ahead] * 4)
    return todo


def search(symbols: bytes, todo: array) -> tuple[int, str]:
    """(cost, audit) by iterative deepening under the estimate ``todo``."""
    n, failed, bound = len(symbols), {}, todo[0]
    if not n:
        return 0, ""
    while True:
        # a frame is a place, the budget left there, and the edits that are still to be tried
        path, frames = [], [(START, bound, _edits(symbols, 0, START))]
        while frames:
            place, left, options = frames[-1]
            for edit, cost, i, state in options:
                now = left - cost
                at = 4 * i + state
                if now < todo[at] or now <= failed.get(at, -1):
                    continue
                path.append(edit)
                if i == n and state in ENDS:
                    return bound, "".join(path)
                frames.append((at, now, _edits(symbols, i, state)))
                break
            else:
                failed[place] = max(left, failed.get(place, -1))
                frames.pop()
                if path:
                    path.pop()
        bound += 1


def descend(symbols: bytes) -> tuple[int, str]:
    """(cost, audit) with the exact cost to go as the estimate: the first bound holds a path, and no state on the way fails."""
    n, todo, path = len(symbols), cost_to_go(symbols), bytearray()
    i, state, left = 0, START, todo[0]
    while i < n or state not in ENDS:
        edit, cost, i, state = next(e for e in _edits(symbols, i, state) if left - e[1] >= todo[4 * e[2] + e[3]])
        left -= cost
        path += edit.encode()
    return todo[0], path.decode()


def _edits(symbols: bytes, i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
    """(edit, cost, turn, state) in ASCII order: D, I, K, R."""
    options = STEPS[symbols[i]][state] if i < len(symbols) else ()
    for edit, cost, to in options[:1]:
        yield edit, cost, i + 1, to
    yield "I", INSERT, i, NAMED[state]
    for edit, cost, to in options[1:]:
        yield edit, cost, i + 1, to


@lru_cache(1 << 14)
def _repair_short(symbols: bytes) -> tuple[int, str]:
    return search(symbols, faulty_ahead(symbols))


def repair(symbols: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair, the least in ASCII order of the cheapest."""
    return _repair_short(symbols) if len(symbols) <= LONG else descend(symbols)


def roles_of(audit: str) -> Iterator[str | None]:
    """For each edit the role that it names or inserts, None where the turn's own stays or goes."""
    at = (len(audit) - audit.count("D")) % 2  # an odd number of turns starts with system
    place = 0
    for edit in audit:
        role = ("user", "assistant")[(place - at) % 2]
        yield role if edit in "RI" else None
        place += edit != "D"


class Conversation:
    """What streams by of one conversation: first its turns' symbols, then their texts."""

    def __init__(self, ident: int | None):
        self.ident, self.symbols = ident, bytearray()
        self.counts, self.illegal, self.turns, self.least, self.most, self.last = [0, 0, 0], 0, 0, None, None, None
        self.audit: str | None = None

    def add(self, turn: int | None, initial: int, fault: int, copies: int, again: bool) -> None:
        """``copies`` equal turns in a row; ``again``: an earlier turn has the same role and text."""
        if not copies:
            return
        if turn is not None and turn != self.last:
            self.least, self.most, self.last = turn if self.least is None else self.least, turn, turn
            self.turns += 1
        for k in range(copies):
            kind = 0 if fault == 1 else 1 if again or k else 2 if fault == 2 else None
            if kind is not None:
                self.counts[kind] += 1
            if self.symbols and (self.symbols[-1] & 3, initial) not in ((0, 1), (1, 2), (2, 1)):
                self.illegal += 1
            self.symbols.append(initial + 4 * (CLEAN if kind is None else CUT_OFF if kind == 2 else MUST_GO))

    def settle(self) -> None:
        self.cost, self.audit = repair(bytes(self.symbols))
        self.edits, self.roles, self.digest, self.any = iter(self.audit), roles_of(self.audit), hashlib.sha256(), False

    def _put(self, role: str, text: str) -> None:
        self.digest.update(("\n" if self.any else "").encode() + role.encode() + b":" + text.encode())
        self.any = True

    def read(self, role: str, text: str) -> None:
        """The next turn: what is inserted before it, then what becomes of it."""
        for edit, named in zip(self.edits, self.roles, strict=False):
            if edit == "I":
                self._put(named, "")
                continue
            if edit != "D":
                self._put(named or role, text)
            return

    def row(self) -> tuple:
        if self.audit is None:
            self.settle()
        for _, named in zip(self.edits, self.roles, strict=False):
            self._put(named, "")
        gaps = 0 if self.least is None else min(self.most - self.least + 1 - self.turns, (1 << 63) - 1)
        return (self.ident, gaps, *self.counts, self.illegal, self.cost, self.audit, self.digest.hexdigest())


OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (conv_id, reads, turn, hash): a conversation's turns without their texts, then with them."""
    names = [c.split()[0] for c in OUT.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in OUT.split(", ")]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    now, done = None, []
    for batch in batches:
        for conv, reads, turn, initial, fault, copies, again, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv != now.ident:
                if now is not None:
                    done.append(now.row())
                now = Conversation(conv)
            if not reads:
                now.add(turn, initial, fault, copies, again)
                continue
            if now.audit is None:
                now.settle()
            for _ in range(copies):
                now.read(role, text)
        if done:
            yield packed(done)
            done = []
    if now is not None:
        yield packed([now.row()])


def repair_conversations(turns: DataFrame) -> DataFrame:
    """One row per conv_id of ``turns`` (conv_id, turn, role, text, copies): faults, cost, audit and the hash of what is repaired.

    ``copies`` says how often a row stands in its conversation; a conversation whose rows all have 0 comes out empty. Turns are
    taken by turn, null first; rows of one turn come in order of their hash, equal ones side by side. Null role or text is one
    space; a null conv_id is a conversation of its own. A role counts by its first character. Other columns are not read, and an empty table gives an empty result.
    """
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.col("copies").cast("long").alias("copies"))
    rows = rows.withColumn("hash", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    end = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(end == "", 1).when(~end.isin(".", "!", "?"), 2).otherwise(0)
    place = F.when(F.col("copies") > 0, F.struct(F.col("turn").isNotNull().alias("k"), "turn"))
    told = rows.select("conv_id", "turn", "hash", initial.alias("initial"), fault.alias("fault"), "copies").groupBy("conv_id", "turn", "hash", "initial", "fault").agg(F.sum("copies").alias("copies"))
    again = F.min(place).over(W.partitionBy("conv_id", "hash")) < F.struct(F.col("turn").isNotNull().alias("k"), "turn")
    none = F.lit(None).cast("string")
    codes = told.select("conv_id", F.lit(False).alias("reads"), "turn", "initial", "fault", "copies", F.coalesce(again, F.lit(False)).alias("again"), none.alias("role"), none.alias("text"), "hash")
    texts = rows.where("copies > 0").select("conv_id", F.lit(True).alias("reads"), "turn", F.lit(0).alias("initial"), F.lit(0).alias("fault"), "copies", F.lit(False).alias("again"), "role", "text", "hash")
    order = ["conv_id", "reads", "turn", "hash"]
    dealt = codes.unionByName(texts).repartition("conv_id").sortWithinPartitions(*order)
    return dealt.drop("hash").mapInArrow(_repaired, OUT)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of conversations with faults put in by a hash of conv_id and turn."""
    spaced = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat_ws(":", spaced(F.col("conv_id")), spaced(F.col("turn")))) % 20
    rows = conversations.select("conv_id", "turn", spaced(F.col("role")).alias("role"), spaced(F.col("text")).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def op13_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))


# The same in SQL, by dynamic programming from each conversation's end.

_NEXT = ({"s": 2, "u": 3}, {"u": 3}, {"a": 4}, {"u": 3})
_NAMED = (3, 3, 4, 3)


def _built(state: int) -> str:
    """The cheapest edit of a turn from a state, with what follows it; h has the best of each state after the turn."""
    step = lambda to, letter, cost: f"{{'c': h[{to}].c + {cost}, 'a': '{letter}' || h[{to}].a}}"
    kept = " ".join(f"WHEN initial = '{x}' THEN {step(to, 'K', 'more')}" for x, to in _NEXT[state].items())
    return f"list_min(list_filter([{step(state + 1, 'D', '2')}, CASE WHEN fault <> 1 THEN CASE {kept} END END, CASE WHEN fault <> 1 THEN {step(_NAMED[state], 'R', '1 + more')} END], lambda x: x IS NOT NULL))"


def _inserted(name: str) -> str:
    """One more insertion before what a list of states has."""
    return "[" + ", ".join(f"list_min([{name}[{s + 1}], {{'c': {name}[{n}].c + 5, 'a': 'I' || {name}[{n}].a}}])" for s, n in enumerate(_NAMED)) + "]"


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc % 2 = 1 THEN xor(crc >> 1, 3988292384::BIGINT) ELSE crc >> 1 END), 4294967295::BIGINT) % 20"
_LAST = r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*$"
OP13_SQL = f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} AS kind FROM conversations),
e AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS k FROM c),
o AS (SELECT *, md5(length(role) || ':' || role || text) AS h FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, h, k) AS i, regexp_extract(text, '{_LAST}', 1) AS final FROM o),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again FROM n),
d AS (SELECT *, substr(role, 1, 1) AS initial, CASE WHEN final = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' END AS name,
  CASE WHEN final = '' OR again > 1 THEN 1 WHEN final NOT IN ('.', '!', '?') THEN 2 ELSE 0 END AS fault, CASE WHEN final <> '' AND again = 1 AND final NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS more, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM p),
s AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE name = 'blank') AS blank, count(*) FILTER (WHERE name = 'duplicate') AS duplicate, count(*) FILTER (WHERE name = 'truncated') AS truncated,
  count(*) FILTER (WHERE i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM d GROUP BY conv_id),
r AS (SELECT conv_id, n AS i, [{{'c': 0::BIGINT, 'a': ''}}, {{'c': 10::BIGINT, 'a': 'II'}}, {{'c': 5::BIGINT, 'a': 'I'}}, {{'c': 0::BIGINT, 'a': ''}}] AS h FROM s
  UNION ALL SELECT conv_id, i, {_inserted('two')} AS h FROM (SELECT conv_id, i, {_inserted('one')} AS two FROM (SELECT r.conv_id, r.i - 1 AS i, [{", ".join(_built(s) for s in range(4))}] AS one FROM (SELECT conv_id, i, h FROM r WHERE i > 0) r JOIN (SELECT conv_id, i, initial, fault, more FROM d) d ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.i = d.i))),
b AS (SELECT conv_id, h[1].c AS cost, h[1].a AS audit, (length(h[1].a) - length(replace(h[1].a, 'D', ''))) AS gone FROM r WHERE i = 0),
l AS (SELECT conv_id, p, audit[p] AS edit, (length(audit) - gone) % 2 AS odd, length(replace(audit[1:p], 'I', '')) AS used, length(replace(audit[1:p], 'D', '')) - 1 AS place FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS p FROM b)),
t AS (SELECT l.conv_id, string_agg(CASE WHEN edit = 'K' THEN d.role ELSE CASE WHEN (place - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN edit = 'I' THEN '' ELSE d.text END, chr(10) ORDER BY p) AS repaired
  FROM l LEFT JOIN d ON l.conv_id IS NOT DISTINCT FROM d.conv_id AND l.used = d.i AND l.edit <> 'I' WHERE edit <> 'D' GROUP BY l.conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN s ON a.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN b ON a.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN t ON a.conv_id IS NOT DISTINCT FROM t.conv_id
"""
