"""Repair of a conversation's structure at least cost, by divide and conquer over four-state cost vectors.

The roles of a repaired conversation read (s?(ua)+)?, an automaton of four states: nothing yet, after s, after u, after a. A row's
edits take the automaton from state to state at a cost, so a stretch of rows is a vector of four costs from a state, forward from
its start or backward from its end. At the middle of a stretch the two vectors meet: the crossing state is the cheapest,
and of equal ones that whose audit is least, and both halves are solved by themselves in the same way, in space linear in the rows.

Rows of one conversation are numbered by distributed sorting and cut into blocks. The blocks' cost tables (four by four) decide
the crossings between blocks first; then every block is solved on its own, so a very long conversation is spread over tasks.
Its text is brought together only to be hashed, row by row in order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WHITE, discard, ranked, staged, table

#: Fixed values of the contract: costs of edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
STATES, ENDS = 4, (0, 3)
#: A row's kind: 0 must go (blank or duplicate); else 1 + 2 * (its initial's place in this text) + truncated.
INITIALS = "sua?"
FAR = 1 << 40


def next_states(state: int) -> dict[str, int]:
    """What the automaton reads in a state, and where that leads."""
    return {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[state]


@lru_cache(None)
def steps(kind: int) -> tuple[tuple[tuple[int, str] | None, ...], ...]:
    """For each state before and after a row of a kind the least (cost, audit), with insertions before the row."""
    table_ = []
    for start in range(STATES):
        before, best = {start: (0, "")}, {}
        for _ in range(STATES):  # insertions: further rounds only come back at a higher cost
            for s, (cost, audit) in list(before.items()):
                for role, t in next_states(s).items():
                    if role != "s" and (t not in before or (cost + INSERT, audit + "I") < before[t]):
                        before[t] = (cost + INSERT, audit + "I")
        for s, (cost, audit) in before.items():
            found = [(s, DELETE, "D")]
            if kind:
                initial, late = INITIALS[(kind - 1) // 2], TRUNCATED * ((kind - 1) % 2)
                found += [(t, (KEEP if role == initial else REROLE) + late, "K" if role == initial else "R") for role, t in next_states(s).items() if role != "s" or initial == "s"]
            for t, more, letter in found:
                if t not in best or (cost + more, audit + letter) < best[t]:
                    best[t] = (cost + more, audit + letter)
        table_.append(tuple(best.get(t) for t in range(STATES)))
    return tuple(table_)


#: The kind of what follows the last row: insertions until the automaton may end, which is counted as state 0.
END = 9
_END_STEPS = tuple(((0, ""), None, None, None) if s in ENDS else ((INSERT * (3 - s), "I" * (3 - s)), None, None, None) for s in range(STATES))
Vector = tuple[tuple[int, int] | None, ...]


def forward(v: Vector, item) -> Vector:
    """v: for each state the least cost to reach it and the rank of its least audit among those of all states (no audit of one state begins
    another's, as each ends with a row's own edit). item: steps() of a row, or table_of() a block, which has ranks in place of audits."""
    best: dict[int, tuple] = {}
    for s, at in enumerate(v):
        if at is not None:
            for t, step in enumerate(item[s]):
                if step is not None and (t not in best or (at[0] + step[0], at[1], step[1]) < best[t]):
                    best[t] = (at[0] + step[0], at[1], step[1])
    order = {t: k for k, t in enumerate(sorted(best, key=lambda t: best[t][1:]))}
    return tuple((best[t][0], order[t]) if t in best else None for t in range(STATES))


def backward(v: tuple[int, ...], item) -> tuple[int, ...]:
    """v: for each state the least cost from it to the end of what follows; FAR where there is no way."""
    return tuple(min([FAR, *(step[0] + v[t] for t, step in enumerate(row) if step is not None)]) for row in item)


def only(state: int) -> Vector:
    return tuple((0, 0) if s == state else None for s in range(STATES))


class Rows:
    """forward() and backward() over rows. Costs count from the least, so that few vectors occur and each step is looked up."""

    def __init__(self):
        self.seen: dict = {}

    def forward(self, v: Vector, kind: int) -> Vector:
        found = self.seen.get((v, kind))
        if found is None:
            w = forward(v, _END_STEPS if kind == END else steps(kind))
            least = min(x[0] for x in w if x is not None)
            found = self.seen[v, kind] = tuple(None if x is None else (x[0] - least, x[1]) for x in w)
        return found

    def backward(self, v: tuple[int, ...], kind: int) -> tuple[int, ...]:
        found = self.seen.get((kind, v))
        if found is None:
            w = backward(v, _END_STEPS if kind == END else steps(kind))
            least = min(w)
            found = self.seen[kind, v] = tuple(min(FAR, x - least) for x in w)
        return found


class Blocks:
    """The same over blocks' tables."""

    forward, backward = staticmethod(forward), staticmethod(backward)


def crossings(items: Sequence, start: int, end: int, over) -> list[int]:
    """The state before each item and after the last of the least audit among the cheapest from start to end."""
    states = [start, *[0] * (len(items) - 1), end]

    def solve(lo: int, hi: int) -> None:
        if hi - lo < 2:
            return
        mid, ahead = (lo + hi) // 2, only(states[lo])
        for k in range(lo, mid):
            ahead = over.forward(ahead, items[k])
        back = tuple(0 if s == states[hi] else FAR for s in range(STATES))
        for k in reversed(range(mid, hi)):
            back = over.backward(back, items[k])
        states[mid] = min((x[0] + back[s], x[1], s) for s, x in enumerate(ahead) if x is not None)[2]
        solve(lo, mid)
        solve(mid, hi)

    solve(0, len(items))
    return states


def audits(kinds: Sequence[int], start: int, end: int, over: Rows) -> list[str]:
    """Each row's letters, of insertions before it and its own."""
    states = crossings(kinds, start, end, over)
    return [(_END_STEPS if k == END else steps(k))[states[i]][states[i + 1]][1] for i, k in enumerate(kinds)]


def table_of(kinds: Sequence[int]) -> list[list[tuple[int, int] | None]]:
    """A block's cost table: for each state before and after, the least cost and the rank of its audit among those from the same state."""
    found = []
    for s in range(STATES):
        v = only(s)
        for k in kinds:
            v = forward(v, _END_STEPS if k == END else steps(k))
        found.append(list(v))
    return found


def damaged(rows: DataFrame) -> DataFrame:
    """rows: conv_id, turn, role, text. The contract's damage, by a checksum of conversation and turn; nulls are one space, but for the ids."""
    one = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one))
    role, text = F.coalesce("role", one), F.coalesce("text", one)
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("k")).filter("k != 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def group_key(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("1"), conv_id.cast("string")), F.lit("0"))


def faults(rows: DataFrame) -> DataFrame:
    """Adds to rows (conv_id, turn, role, text) g, rank, n, fault (blank, duplicate, truncated or null) and kind.

    Rows of a conversation are in the order of their turns (nulls first), of one turn by the digest of role and text."""
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    own = staged(rows.select(group_key(F.col("conv_id")).alias("g"), "turn", "role", "text", digest.alias("digest"), F.monotonically_increasing_id().alias("row")), "repair-rows")
    # of equal texts the first counts, whatever their number: only their least rank is brought together
    order = ranked(own.drop("role", "text"), "g", ["turn", "digest", "row"], "repair-ranked")
    first = order.groupBy("g", "digest").agg(F.min("rank").alias("first"))
    order = order.select("row", "g", "digest", "rank", "n").join(first, ["g", "digest"]).select("row", "rank", "n", (F.col("rank") > F.col("first")).alias("again"))
    ends = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(ends == "", "blank").when(F.col("again"), "duplicate").when(~F.right(ends, F.lit(1)).isin(".", "!", "?"), "truncated")
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    found = own.drop("digest").join(order, "row").withColumn("fault", fault)
    kind = F.when(F.col("fault").isin("blank", "duplicate"), 0).otherwise(1 + 2 * place + F.coalesce((F.col("fault") == "truncated").cast("int"), F.lit(0)))
    out = staged(found.select("g", "turn", "role", "text", "rank", "n", "fault", initial.alias("initial"), kind.cast("int").alias("kind")), "repair-faults")
    discard(own)
    return out


def edits(blocks: DataFrame, block_rows: int) -> DataFrame:
    """blocks: g, n, block, kinds. The letters of each row: g, block, letters (of insertions after a conversation's last row too, in a last entry)."""

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tables = [[x for row in table_of(kinds) for at in row for x in (at or (-1, -1))] for kinds in b["kinds"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["g"], b["block"], pa.array(tables, pa.list_(pa.int64()))], ["g", "block", "tables"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for tables in b["tables"].to_pylist():
                items = [[[None if flat[8 * s + 2 * t] < 0 else (flat[8 * s + 2 * t], flat[8 * s + 2 * t + 1]) for t in range(STATES)] for s in range(STATES)] for flat in tables]
                found.append(crossings(items, 0, 0, Blocks))
            yield pa.RecordBatch.from_arrays([b["g"], pa.array(found, pa.list_(pa.int32()))], ["g", "states"])

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = Rows()
        for b in batches:
            letters = [audits(k, s, e, over) for k, s, e in zip(b["kinds"].to_pylist(), b["start"].to_pylist(), b["stop"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["g"], b["block"], pa.array(letters, pa.list_(pa.string()))], ["g", "block", "letters"])

    zero, out = F.lit(0).alias("start"), "g string, block bigint, letters array<string>"
    whole = blocks.filter(F.col("n") <= block_rows).select("g", "block", "kinds", zero, F.lit(0).alias("stop"))
    if (blocks.agg(F.max("n")).first()[0] or 0) > block_rows:
        several = blocks.filter(F.col("n") > block_rows)
        tables = several.select("g", "block", "kinds").mapInArrow(summaries, "g string, block bigint, tables array<bigint>")
        states = tables.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("block", "tables"))).alias("t")).select("g", F.col("t.tables").alias("tables")).mapInArrow(ends, "g string, states array<int>")
        states = states.select("g", F.posexplode(F.arrays_zip(F.slice("states", F.lit(1), F.size("states") - 1).alias("start"), F.slice("states", F.lit(2), F.size("states") - 1).alias("stop"))).alias("block", "x"))
        parts = several.join(states.select("g", F.col("block").cast("long").alias("block"), "x.start", "x.stop"), ["g", "block"])
        whole = whole.unionByName(parts.select("g", "block", "kinds", "start", "stop"))
    return whole.mapInArrow(solved, out)


def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole conversations in order: g, role, text, letters, late. Of each conversation its audit, cost and the digest of its repaired
    text, which grows row by row: no conversation is held."""
    g, sha, audit, cost, state, lines = None, None, [], 0, 0, 0
    done: list[tuple] = []

    def line(role: str, text: str) -> None:
        nonlocal lines
        sha.update((("\n" if lines else "") + role + ":" + text).encode())
        lines += 1

    def finish() -> None:
        if g is not None:
            done.append((g, "".join(audit), cost, sha.hexdigest()))

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.string()))], ["g", "audit", "cost", "repaired_sha256"])
        done.clear()
        return out

    for b in batches:
        for key, role, text, letters, late in zip(*(b[c].to_pylist() for c in ("g", "role", "text", "letters", "late"))):
            if key != g:
                finish()
                g, sha, audit, cost, state, lines = key, hashlib.sha256(), [], 0, 0, 0
            audit.append(letters)
            for x in letters:
                cost += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[x] + TRUNCATED * (late and x in "KR")
                if x == "D":
                    continue
                if x == "K" and role[:1] == "s":
                    state = 1
                    line(role, text)
                    continue
                turn, state = ("assistant", 3) if state == 2 else ("user", 2)
                line(role if x == "K" else turn, "" if x == "I" else text)
        if done:
            yield batch()
    finish()
    if done:
        yield batch()


def repair(rows: DataFrame, block_rows: int = 1 << 16) -> DataFrame:
    """rows: conv_id, turn, role, text (nulls are one space). A row a conversation: g (its key), gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A role's initial is its first character; a row without one, or with another than s, u and a, can't be kept. A null conv_id is a conversation
    of its own. Rows of one turn are in the order of the digest of role and text, so repeated rows are next to each other. Texts of any
    length are read whole. An empty table gives no rows; other columns are not read. Conversations of more than block_rows rows are solved in blocks.
    A conversation's digest can only be made in its order, so its rows pass one task, one after the other."""
    found = faults(rows)
    block = F.floor(F.col("rank") / block_rows).cast("long").alias("block")
    held = F.sort_array(F.collect_list(F.struct("rank", "kind", "initial")))
    blocks = found.groupBy("g", "n", block).agg(held.alias("rows"))
    last = (F.col("block") + 1) * block_rows >= F.col("n")
    kinds = F.concat("rows.kind", F.when(last, F.array(F.lit(END))).otherwise(F.array().cast("array<int>")))
    legal = lambda a, b: F.concat(a, b).isin("su", "ua", "au")
    initials = F.col("rows.initial")
    inside = F.size(F.filter(F.zip_with(F.slice(initials, F.lit(1), F.size("rows") - 1), F.slice(initials, F.lit(2), F.size("rows")), legal), lambda x: ~x))
    blocks = staged(blocks.select("g", "n", "block", kinds.alias("kinds"), inside.alias("illegal"), initials[0].alias("first"), F.element_at(initials, -1).alias("last")), "repair-blocks")
    between = ~legal(F.lag("last").over(W.partitionBy("g").orderBy("block")), F.col("first"))
    illegal = blocks.select("g", (F.col("illegal") + F.coalesce(between.cast("int"), F.lit(0))).alias("x")).groupBy("g").agg(F.sum("x").cast("long").alias("illegal"))

    letters = edits(blocks, block_rows).select("g", F.col("block"), F.posexplode("letters").alias("i", "letters")).withColumn("rank", F.col("block") * block_rows + F.col("i"))
    told = found.select("g", "rank", "role", "text", (F.col("fault") == "truncated").alias("late")).join(letters.select("g", "rank", "letters"), ["g", "rank"], "right")
    told = told.select("g", "rank", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "letters", F.coalesce("late", F.lit(False)).alias("late"))
    repaired = told.repartition("g").sortWithinPartitions("g", "rank").mapInArrow(written, "g string, audit string, cost bigint, repaired_sha256 string")

    count = lambda x: F.count(F.when(F.col("fault") == x, 1)).alias(x)
    turns = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    sums = found.groupBy("g").agg(turns.alias("gaps"), count("blank"), count("duplicate"), count("truncated"))
    return sums.join(illegal, "g").join(repaired, "g")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = repair(damaged(rows))
    every = rows.select("conv_id", group_key(F.col("conv_id")).alias("g")).distinct()
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, "g", "left").select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


ORACLE = r"""
WITH RECURSIVE hits AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
 lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, _: xor(v >> 1, (v & 1) * 3988292384)))) % 20 AS k FROM conversations),
damaged AS (SELECT coalesce('1' || conv_id, '0') AS g, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE k WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM hits WHERE k <> 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS n, count(*) OVER (PARTITION BY g) AS m FROM damaged),
marked AS (SELECT *, left(role, 1) AS i, regexp_extract(text, '[^\x20\x09-\x0D](?:[\x20\x09-\x0D]*)$')[1:1] AS e, row_number() OVER (PARTITION BY g, role, text ORDER BY n) > 1 AS again FROM ranked),
f AS MATERIALIZED (SELECT *, CASE WHEN e = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN e NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault, CASE WHEN e NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS late FROM marked),
fold AS (SELECT g, 0::BIGINT AS n, '1000000' AS w0, NULL::VARCHAR AS w1, NULL::VARCHAR AS w2, NULL::VARCHAR AS w3 FROM (SELECT DISTINCT g FROM f)
 UNION ALL SELECT g, n, d0, least(d1, k1), least(d2, k2, r2), least(d3, k3, r3) FROM (
 SELECT g, n, left(v0, 7)::BIGINT + 2 || substr(v0, 8) || 'D' AS d0, left(v1, 7)::BIGINT + 2 || substr(v1, 8) || 'D' AS d1, left(v2, 7)::BIGINT + 2 || substr(v2, 8) || 'D' AS d2, left(v3, 7)::BIGINT + 2 || substr(v3, 8) || 'D' AS d3,
  CASE WHEN stays AND i = 's' THEN left(v0, 7)::BIGINT + late || substr(v0, 8) || 'K' END AS k1, CASE WHEN stays AND i = 'u' THEN left(u, 7)::BIGINT + late || substr(u, 8) || 'K' END AS k2, CASE WHEN stays AND i = 'a' THEN left(v2, 7)::BIGINT + late || substr(v2, 8) || 'K' END AS k3,
  CASE WHEN stays THEN left(u, 7)::BIGINT + late + 1 || substr(u, 8) || 'R' END AS r2, CASE WHEN stays THEN left(v2, 7)::BIGINT + late + 1 || substr(v2, 8) || 'R' END AS r3
 FROM (SELECT *, least(v0, v1, v3) AS u FROM (SELECT *, least(w3, left(v2, 7)::BIGINT + 5 || substr(v2, 8) || 'I') AS v3 FROM (
  SELECT f.g, f.n, f.i, f.late, f.fault NOT IN ('blank', 'duplicate') AS stays, w0 AS v0, w1 AS v1, w3,
   least(w2, left(w0, 7)::BIGINT + 5 || substr(w0, 8) || 'I', left(w1, 7)::BIGINT + 5 || substr(w1, 8) || 'I', left(w3, 7)::BIGINT + 5 || substr(w3, 8) || 'I') AS v2
  FROM fold JOIN f ON f.g = fold.g AND f.n = fold.n + 1))))),
won AS (SELECT g, least(w0, w3, left(w2, 7)::BIGINT + 5 || substr(w2, 8) || 'I', left(w1, 7)::BIGINT + 10 || substr(w1, 8) || 'II') AS best FROM fold JOIN (SELECT g, max(n) AS n FROM f GROUP BY g) USING (g, n)),
letters AS (SELECT *, count(*) FILTER (x <> 'I') OVER w AS n, count(*) FILTER (x <> 'D') OVER w AS e FROM (SELECT g, unnest(string_split(substr(best, 8), '')) AS x, generate_subscripts(string_split(substr(best, 8), ''), 1) AS pos FROM won) WINDOW w AS (PARTITION BY g ORDER BY pos)),
lines AS (SELECT l.*, f.role, f.text, bool_or(l.x = 'K' AND f.i = 's') OVER (PARTITION BY l.g) AS s FROM letters l LEFT JOIN f ON l.g = f.g AND l.n = f.n AND l.x <> 'I' WHERE l.x <> 'D'),
fixed AS (SELECT g, sha256(string_agg(CASE WHEN x = 'K' THEN role WHEN (e - s::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos)) AS sha FROM lines GROUP BY g),
sums AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (p || i NOT IN ('su', 'ua', 'au')) AS illegal
 FROM (SELECT *, lag(i) OVER (PARTITION BY g ORDER BY n) AS p FROM f) GROUP BY g)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(left(best, 7)::BIGINT - 1000000, 0) AS cost, coalesce(substr(best, 8), '') AS audit,
 coalesce(sha, sha256('')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id, coalesce('1' || conv_id, '0') AS g FROM conversations) LEFT JOIN sums USING (g) LEFT JOIN won USING (g) LEFT JOIN fixed USING (g)
"""
