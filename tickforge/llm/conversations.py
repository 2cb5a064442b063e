"""Repair of conversations at least cost, by Dial's shortest paths.

A repaired conversation is empty or an optional system turn and then user and assistant turns in pairs. Rows are kept (0), given
the role user or assistant (1) or deleted (2), and empty user or assistant turns are inserted anywhere (5). Blank and repeated rows
must be deleted; a truncated one that stays costs 5 more. A node is (rows done, what the repaired roles end with): nothing yet, a system
turn, a user turn or an assistant turn. Costs are integers of at most 6, so a bucket for each distance is the queue. Distances to the goal are
recorded for all nodes; then the walk from the start takes, of the arcs that lie on a shortest path, the one with the least letter (Delete,
Insert, Keep, Rerole), which spells the audit. The role that an edit gives follows from the node, so an audit says all.

Rows are dealt by ranges of (conversation, turn, role, start and digest of the text, row) and sorted so; the last key parts equal rows. A
task packs its range into segments of bounded size. Conversations that lie within one segment are solved there. One that is cut, by size or by
a range's end, is solved by segments, and no task ever holds it whole:

1. a segment's costs from each of the four states before it to each after it, by four runs of Dial's algorithm;
2. costs to the goal after each segment, by streaming the conversation's 4 x 4 tables backwards;
3. where the walk leaves a segment from each state, and the state in which it enters each, by streaming those forwards;
4. each segment's walk.

What was said in an earlier segment is found by a digest of role and text (SHA-256), a row a segment and digest. A conversation's digest is
one hash over its repaired text, so its segments are streamed through one task in the end, in bounded memory.

Nulls and edge cases: a null role or text is one space (in the query also a null in the key that picks the damage). Null turns come
first and don't count for gaps. Rows of one turn are in order of role, then of the text's first 64 characters, then of its digest. Rows
without a conv_id are one conversation. Repeated rows are duplicates in it. A conversation of which no rows are left has zeros, an
empty audit and the digest of an empty string. A role counts by its first letter, as it stands; an empty one matches nothing. Extra columns
are left out. An empty table gives an empty result. Long texts are hashed, never cut.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_sql, save, shuffle_partitions, table

WHITE = " \t\n\x0b\x0c\r"
#: A segment ends at so many rows or characters.
SEGMENT_ROWS, SEGMENT_CHARS = 1024, 1 << 20
DELETE, INSERT, RELABEL, TRUNCATED = 2, 5, 1, 5
FAR = 1 << 60
#: States: nothing yet, system, user, assistant. What an inserted or relabelled turn leads to, and where a kept one leads (by initial s, u, a).
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NAMES = {USER: "user", ASSISTANT: "assistant"}
BEFORE_NEXT = tuple([p for p in range(4) if NEXT[p] == s] for s in range(4))
LEGAL = {"su", "ua", "au"}
#: Costs to the goal behind the last row: insert what a pair still lacks.
GOAL = (0, 2 * INSERT, INSERT, 0)
FREE, CUT_OFF, DOOMED = range(3)


def fault(role: str, text: str, seen: set) -> str:
    """A row's first fault; seen: what was said before, of which it becomes part."""
    bare = text.rstrip(WHITE)
    if not bare:
        return "blank"
    if (role, text) in seen:
        return "duplicate"
    seen.add((role, text))
    return "" if bare[-1] in ".!?" else "truncated"


def arcs_back(kept: list[str], kinds: list[int], i: int, s: int, inserts: bool):
    """(node before, cost) of all arcs into (i, s)."""
    if inserts:
        for p in BEFORE_NEXT[s]:
            yield i, p, INSERT
    if i:
        yield i - 1, s, DELETE
        if kinds[i - 1] != DOOMED:
            more = TRUNCATED if kinds[i - 1] == CUT_OFF else 0
            for p in range(4):
                if KEPT[p].get(kept[i - 1]) == s:
                    yield i - 1, p, more
                if NEXT[p] == s:
                    yield i - 1, p, RELABEL + more


def distances(kept: list[str], kinds: list[int], goal) -> list[list[int]]:
    """Cost from each node (rows done, state) to behind the rows, where `goal` has what is left to pay in each state."""
    n = len(kept)
    found = [[FAR] * 4 for _ in range(n + 1)]
    least = min(goal)
    buckets: list[list[tuple[int, int]]] = []

    def put(i: int, s: int, d: int) -> None:
        if d < found[i][s]:
            found[i][s] = d
            while len(buckets) <= d - least:
                buckets.append([])
            buckets[d - least].append((i, s))

    for s, d in enumerate(goal):
        if d < FAR:
            put(n, s, d)
    at = 0
    while at < len(buckets):
        for i, s in buckets[at]:  # arcs that cost nothing lengthen this very bucket
            if found[i][s] == at + least:
                for j, p, cost in arcs_back(kept, kinds, i, s, i < n):
                    put(j, p, at + least + cost)
        buckets[at] = []
        at += 1
    return found


def walk(kept: list[str], kinds: list[int], found: list[list[int]], s: int):
    """(edits, states after each, cost, state behind the rows): tight arcs from state s, the least letter first."""
    edits, states, i, began = [], [], 0, found[0][s]
    while i < len(kept):
        d, more = found[i][s], TRUNCATED if kinds[i] == CUT_OFF else 0
        stays, to = kinds[i] != DOOMED, KEPT[s].get(kept[i])
        if found[i + 1][s] + DELETE == d:
            edits.append("D")
            i += 1
        elif found[i][NEXT[s]] + INSERT == d:
            edits.append("I")
            s = NEXT[s]
        elif stays and to is not None and found[i + 1][to] + more == d:
            edits.append("K")
            i, s = i + 1, to
        else:
            edits.append("R")
            i, s = i + 1, NEXT[s]
        states.append(s)
    return edits, states, began - found[i][s], s


def finish(s: int) -> tuple[list[str], list[int], int]:
    """What is inserted behind the last row."""
    states = []
    while GOAL[s]:
        s = NEXT[s]
        states.append(s)
    return ["I"] * len(states), states, INSERT * len(states)


def rows_of(edits: list[str], states: list[int], roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """The repaired roles and texts."""
    out_roles, out_texts, i = [], [], 0
    for e, s in zip(edits, states):
        if e in "IR":
            out_roles.append(NAMES[s])
            out_texts.append("" if e == "I" else texts[i])
        elif e == "K":
            out_roles.append(roles[i])
            out_texts.append(texts[i])
        i += e != "I"
    return out_roles, out_texts


_TEXTS = "turns array<long>, roles array<string>, texts array<string>"
_STATS = "n_rows long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, first_turn long, last_turn long, n_turns long"
_SOLVED = f"{_STATS}, audit string, cost long, roles array<string>, texts array<string>"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary())}


def _batch(rows: list[tuple], conv: pa.DataType, schema: str) -> pa.RecordBatch:
    """A batch of (conv, fields of schema)."""
    fields = [f.split(" ", 1) for f in schema.split(", ")]
    columns = [pa.array([r[0] for r in rows], conv)] + [pa.array([r[k + 1] for r in rows], _ARROW[t]) for k, (_, t) in enumerate(fields)]
    return pa.RecordBatch.from_arrays(columns, names=["conv", *(n for n, _ in fields)])


def segments(turns: DataFrame, rows_each: int = SEGMENT_ROWS, chars_each: int = SEGMENT_CHARS) -> DataFrame:
    """(conv, part, seg, cut, digests, turns, roles, texts), saved: conversations in order of part and seg. turns: (conv, turn, role, text, copies).

    cut: the conversation may have other segments; then digests has its rows' (conversation, role, text), else none.
    """
    schema = f"part int, seg int, cut boolean, digests array<binary>, {_TEXTS}"

    def pack(batches):
        kind = pa.null()
        part = seg = chars = 0
        rows: list[tuple] = []
        conv, known, whole, ready = None, False, False, []

        def close(cut: bool) -> None:
            nonlocal rows, seg, chars
            said = {(r, t) for _, r, t in rows if t.rstrip(WHITE)} if cut else ()
            digests = [hashlib.sha256(f"{conv!r}\n{len(r)}\n{r}{t}".encode()).digest() for r, t in said]
            ready.append((conv, part, seg, cut, digests, *([r[k] for r in rows] for k in range(3))))
            rows, seg, chars = [], seg + 1, 0

        first = True
        for b in batches:
            kind = b.schema.field(0).type
            for c, turn, role, text, copies, part in zip(*(col.to_pylist() for col in b.columns)):
                if not known or c != conv:
                    if known:
                        close(first or not whole)
                        first = False
                    conv, known, whole = c, True, True
                for _ in range(copies):
                    if len(rows) >= rows_each or chars > chars_each:
                        whole = False
                        close(True)
                    rows.append((turn, role, text))
                    chars += len(text)
            if ready:
                yield _batch(ready, kind, schema)
                ready.clear()
        if known:
            close(True)
            yield _batch(ready, kind, schema)

    text = F.coalesce("text", F.lit(" "))
    rows = turns.select("conv", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), "copies")
    keys = ["conv", "turn", "role", "_head", "_md5", "_row"]
    keyed = rows.withColumns({"_head": F.substring("text", 1, 64), "_md5": F.md5(F.col("text").cast("binary")), "_row": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(shuffle_partitions(turns.sparkSession), *keys).sortWithinPartitions(*keys)
    return save(dealt.select("conv", "turn", "role", "text", "copies", F.spark_partition_id().alias("part")).mapInArrow(pack, f"conv {dict(turns.dtypes)['conv']}, {schema}"), "segments")


def _judged(conv, roles: list[str], texts: list[str], seen=()) -> tuple[list[str], list[int], list[str]]:
    """Initials, what may be done with each row, and faults; seen: digests of what earlier segments said."""
    before: set = set()
    if seen:
        seen = set(seen)
        before = {(r, t) for r, t in set(zip(roles, texts)) if hashlib.sha256(f"{conv!r}\n{len(r)}\n{r}{t}".encode()).digest() in seen}
    faults = [fault(r, t, before) for r, t in zip(roles, texts)]
    return [r[:1] for r in roles], [FREE if not f else CUT_OFF if f == "truncated" else DOOMED for f in faults], faults


def _stats(turns: list, initials: list[str], faults: list[str]) -> tuple:
    known = [t for t in turns if t is not None]
    count = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    ends = (initials[0], initials[-1]) if initials else (None, None)
    return len(initials), *count, illegal, *ends, known[0] if known else None, known[-1] if known else None, len(set(known))


def _map(df: DataFrame, answer, schema: str) -> DataFrame:
    """answer(row as a dict) for each row; gives the fields of schema behind conv."""

    def work(batches):
        for b in batches:
            if b.num_rows:
                yield _batch([(r["conv"], *answer(r)) for r in b.to_pylist()], b.schema.field("conv").type, schema)

    return df.mapInArrow(work, f"conv {dict(df.dtypes)['conv']}, {schema}")


def solve(segs: DataFrame) -> DataFrame:
    """(conv, part, seg, cut, _SOLVED): each segment's edits, its repaired rows, and what it says of the conversation."""
    key, schema = ["part", "seg"], f"part int, seg int, cut boolean, {_SOLVED}"

    def solved(r, goal, enter: int, last: bool, seen=()):
        initials, kinds, faults = _judged(r["conv"], r["roles"], r["texts"], seen)
        edits, states, cost, s = walk(initials, kinds, distances(initials, kinds, goal), enter)
        if last:
            more = finish(s)
            edits, states, cost = edits + more[0], states + more[1], cost + more[2]
        return r["part"], r["seg"], r["cut"], *_stats(r["turns"], initials, faults), "".join(edits), cost, *rows_of(edits, states, r["roles"], r["texts"])

    whole = _map(segs.where("not cut"), lambda r: solved(r, GOAL, START, True), schema)
    cut = segs.where("cut")
    said = cut.select(*key, F.explode("digests").alias("digest"))
    first = said.groupBy("digest").agg(F.min(F.struct(*key)).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = said.join(first, "digest").where(F.struct(*key) > F.col("first")).groupBy(*key).agg(F.collect_list("digest").alias("seen"))

    def costs(r):
        initials, kinds, _ = _judged(r["conv"], r["roles"], r["texts"], r["seen"] or ())
        to = [distances(initials, kinds, [0 if s == e else FAR for s in range(4)])[0] for e in range(4)]
        return r["part"], r["seg"], initials, kinds, [to[e][s] for s in range(4) for e in range(4)], r["seen"]

    judged = save(_map(cut.join(later, key, "left"), costs, "part int, seg int, initials array<string>, kinds array<long>, costs array<long>, seen array<binary>"), "judged")

    def backwards(batches):
        conv, known, goal = None, False, GOAL
        for b in batches:
            out = []
            for c, part, seg, table_ in zip(*(col.to_pylist() for col in b.columns)):
                last = not known or c != conv
                if last:
                    conv, known, goal = c, True, GOAL
                out.append((c, part, seg, list(goal), last))
                goal = [min(min(table_[4 * s + e] + goal[e] for e in range(4)), FAR) for s in range(4)]
            yield _batch(out, b.schema.field(0).type, "part int, seg int, goal array<long>, last boolean")

    conv_type = dict(segs.dtypes)["conv"]
    chain = judged.select("conv", *key, "costs").repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("seg"))
    goals = chain.mapInArrow(backwards, f"conv {conv_type}, part int, seg int, goal array<long>, last boolean")

    def exits(r):
        found = distances(r["initials"], r["kinds"], r["goal"])
        return r["part"], r["seg"], r["goal"], r["last"], r["seen"], [walk(r["initials"], r["kinds"], found, s)[3] if found[0][s] < FAR else s for s in range(4)]

    left = save(_map(judged.join(goals.drop("conv"), key), exits, "part int, seg int, goal array<long>, last boolean, seen array<binary>, exits array<long>"), "exits")

    def forwards(batches):
        conv, known, s = None, False, START
        for b in batches:
            out = []
            for c, part, seg, leave in zip(*(col.to_pylist() for col in b.columns)):
                if not known or c != conv:
                    conv, known, s = c, True, START
                out.append((c, part, seg, s))
                s = leave[s]
            yield _batch(out, b.schema.field(0).type, "part int, seg int, enter int")

    enters = left.select("conv", *key, "exits").repartition("conv").sortWithinPartitions("conv", *key).mapInArrow(forwards, f"conv {conv_type}, part int, seg int, enter int")
    ready = cut.drop("digests").join(left.drop("conv", "exits"), key).join(enters.drop("conv"), key)
    return whole.unionByName(_map(ready, lambda r: solved(r, r["goal"], r["enter"], r["last"], r["seen"] or ()), schema))


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def report(done: DataFrame) -> DataFrame:
    """(conv, _REPORT), a row a conversation, from its solved segments."""

    def stream(batches):
        conv, known, kind = None, False, None
        sums = audit = digest = low = high = n_turns = role = empty = None

        def result():
            gaps = 0 if low is None else high - low + 1 - n_turns
            return conv, gaps, *sums[:5], "".join(audit), digest.hexdigest()

        for b in batches:
            out, kind = [], b.schema.field("conv").type
            for r in b.to_pylist():
                if not known or r["conv"] != conv:
                    if known:
                        out.append(result())
                    conv, known = r["conv"], True
                    sums, audit, digest, low, high, n_turns, role, empty = [0] * 5, [], hashlib.sha256(), None, None, 0, None, True
                for k, c in enumerate(("blank", "duplicate", "truncated", "illegal", "cost")):
                    sums[k] += r[c]
                if r["n_rows"]:
                    sums[3] += role is not None and role + r["first_role"] not in LEGAL
                    role = r["last_role"]
                if r["n_turns"]:
                    n_turns += r["n_turns"] - (r["first_turn"] == high)
                    low, high = r["first_turn"] if low is None else low, r["last_turn"]
                audit.append(r["audit"])
                for x, t in zip(r["roles"], r["texts"]):
                    digest.update((f"{x}:{t}" if empty else f"\n{x}:{t}").encode())
                    empty = False
            if out:
                yield _batch(out, kind, _REPORT)
        if known:
            yield _batch([result()], kind, _REPORT)

    schema = f"conv {dict(done.dtypes)['conv']}, {_REPORT}"
    parts = done.where("cut").repartition("conv").sortWithinPartitions("conv", "part", "seg")
    return done.where("not cut").mapInArrow(stream, schema).unionByName(parts.mapInArrow(stream, schema))


def solved_turns(turns: DataFrame, conv_col: str = "conv_id", copies: str | None = None, rows_each: int = SEGMENT_ROWS) -> DataFrame:
    """Solved segments (see solve) of rows (conversation, turn, role, text); a column `copies` says how often each row counts, 0 for one that only names its conversation."""
    n = F.col(copies).cast("int") if copies else F.lit(1)
    return solve(segments(turns.select(F.col(conv_col).alias("conv"), "turn", "role", "text", n.alias("copies")), rows_each))


def repaired_turns(turns: DataFrame, conv_col: str = "conv_id", rows_each: int = SEGMENT_ROWS) -> DataFrame:
    """(conversation, place, role, text): the repaired rows; place orders those of a conversation."""
    rows = solved_turns(turns, conv_col, rows_each=rows_each).select("conv", "part", "seg", F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "r"))
    return rows.select(F.col("conv").alias(conv_col), F.struct("part", "seg", "i").alias("place"), F.col("r.roles").alias("role"), F.col("r.texts").alias("text"))


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows with the damage that their ids pick."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat_ws(":", *spaced[:2]).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", spaced[2].alias("role"), spaced[3].alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def op12_repair(spark, sf_dir: str) -> DataFrame:
    return report(solved_turns(damaged(table(spark, sf_dir, "conversations")), copies="copies")).withColumnRenamed("conv", "conv_id")


def _ways(state: str, keeps: dict[str, int], to: int) -> str:
    """SQL: the cheapest way on from a state, by deleting, keeping or relabelling a row."""
    kept = " ".join(f"WHEN '{i}' THEN v{s}" for i, s in keeps.items())
    piece = "chr(10) || {role} || ':' || text || "
    name = NAMES[to]
    return f"""list_min([struct_pack(c := v{state}.c + {DELETE}, a := 'D' || v{state}.a, t := v{state}.t),
    CASE WHEN kind < {DOOMED} AND initial IN ({', '.join(f"'{i}'" for i in keeps)}) THEN struct_pack(c := (CASE initial {kept} END).c + more, a := 'K' || (CASE initial {kept} END).a, t := {piece.format(role='role')}(CASE initial {kept} END).t) END,
    CASE WHEN kind < {DOOMED} THEN struct_pack(c := v{to}.c + more + {RELABEL}, a := 'R' || v{to}.a, t := {piece.format(role=f"'{name}'")}v{to}.t) END])"""


def _inserted(state: int, to: str) -> str:
    """SQL: as it is, or with a turn inserted first."""
    return f"list_min([w{state}, struct_pack(c := {to}.c + {INSERT}, a := 'I' || {to}.a, t := chr(10) || '{NAMES[NEXT[state]]}:' || {to}.t)])"


OP12_SQL = f"""WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations
), picked AS (SELECT *, {crc_sql('key')} % 20 AS kind FROM named),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM picked
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substring(text, 1, 64), md5(text), copy) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, left(role, 1) AS initial FROM damaged
), judged AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM ordered
), rows_ AS (
  SELECT conv_id AS conv, i, role, text, initial, CASE fault WHEN 'truncated' THEN {CUT_OFF} WHEN 'blank' THEN {DOOMED} WHEN 'duplicate' THEN {DOOMED} ELSE {FREE} END AS kind, CASE fault WHEN 'truncated' THEN {TRUNCATED} ELSE 0 END AS more FROM judged
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM judged GROUP BY conv_id
), best AS (
  SELECT conv_id, n + 1 AS place, struct_pack(c := 0::BIGINT, a := '', t := '') AS v0, struct_pack(c := {2 * INSERT}::BIGINT, a := 'II', t := chr(10) || 'user:' || chr(10) || 'assistant:') AS v1,
    struct_pack(c := {INSERT}::BIGINT, a := 'I', t := chr(10) || 'assistant:') AS v2, struct_pack(c := 0::BIGINT, a := '', t := '') AS v3 FROM counted
  UNION ALL
  SELECT conv_id, place, {_inserted(START, 'x2')}, {_inserted(SYSTEM, 'x2')}, x2, x3 FROM (
    SELECT *, {_inserted(USER, 'w3')} AS x2, {_inserted(ASSISTANT, 'w2')} AS x3 FROM (
      SELECT b.conv_id, r.i AS place, {_ways('0', {'s': 1, 'u': 2}, 2)} AS w0, {_ways('1', {'u': 2}, 2)} AS w1, {_ways('2', {'a': 3}, 3)} AS w2, {_ways('3', {'u': 2}, 2)} AS w3
      FROM best b JOIN rows_ r ON r.i = b.place - 1 AND r.conv IS NOT DISTINCT FROM b.conv_id
    )
  )
), found AS (SELECT conv_id AS conv, v0 FROM best WHERE place = 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v0.c, 0) AS cost,
  coalesce(v0.a, '') AS audit, sha256(coalesce(substring(v0.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN found f ON f.conv IS NOT DISTINCT FROM o.conv_id"""
