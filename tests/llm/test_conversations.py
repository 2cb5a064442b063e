"""Conversation repair against a plain search over all edits, whole and cut into short segments."""

import hashlib
import random
import zlib

import pytest

from tickforge.llm import conversations as C

from .cases import write

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, part int, roles string, conv string"


def cheapest(roles, texts, kinds):
    """(cost, audit, repaired rows): the best way on from each (row, state), by letters written out."""
    to, keep = {"": "u", "s": "u", "u": "a", "a": "u"}, {"": "su", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    after = {"": (0, "", []), "a": (0, "", [])}
    after["u"] = (5, "I", [("assistant", "")])
    after["s"] = (10, "II", [("user", ""), ("assistant", "")])
    for r, t, k in reversed(list(zip(roles, texts, kinds))):
        now = {}
        for s in ("", "s", "u", "a"):
            ways = [(after[s][0] + 2, "D" + after[s][1], after[s][2])]
            if k != "doomed":
                more = 5 if k == "truncated" else 0
                if r[:1] and r[:1] in keep[s]:
                    c, a, x = after[r[:1]]
                    ways.append((c + more, "K" + a, [(r, t), *x]))
                c, a, x = after[to[s]]
                ways.append((c + more + 1, "R" + a, [(name[to[s]], t), *x]))
            now[s] = min(ways, key=lambda w: w[:2])
        for _ in range(3):  # inserted turns, up to a round
            for s in ("", "s", "u", "a"):
                c, a, x = now[to[s]]
                now[s] = min(now[s], (c + 5, "I" + a, [(name[to[s]], ""), *x]), key=lambda w: w[:2])
        after = now
    return after[""]


def wanted(rows):
    """The report of one conversation's (turn, role, text), after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(), hashlib.md5(r[2].encode()).hexdigest()))
    kinds, count, seen = [], dict(blank=0, duplicate=0, truncated=0), set()
    for _, r, t in rows:
        bare = t.rstrip(WHITE)
        f = "blank" if not bare else "duplicate" if (r, t) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((r, t))
        if f:
            count[f] += 1
        kinds.append("doomed" if f in ("blank", "duplicate") else f)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, kept = cheapest([r for _, r, _ in rows], [t for _, _, t in rows], kinds)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    return (gaps, *count.values(), illegal, cost, audit, digest), kept


def damage(rows):
    """{conv_id: rows after damage}, as the query's contract has it."""
    out = {}
    for conv, turn, role, text in rows:
        spaced = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        h, role, text = zlib.crc32(":".join(spaced[:2]).encode()) % 20, spaced[2], spaced[3]
        mine = out.setdefault(conv, [])
        if h == 1:
            text = ""
        if h == 2:
            text = text.translate(str.maketrans("", "", ".!?"))
        if h == 4:
            role = "user"
        mine += [(turn, role, text)] * {0: 0, 3: 2}.get(h, 1)
    return out


def conversations(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for _ in range(rng.choice([1, 2, 3, 6, 8, 15])):
            turn = rng.choice([None, *range(9), 1 << 40])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "User", "tool", "été"])
            text = rng.choice([None, "", " \n", "Yes.", "Yes.", "no", "Ok! ", "why?\t", "é" * 40 + "long text. " * rng.randrange(12)])
            rows += [(conv, turn, role, text)] * rng.choice([1, 1, 1, 3])
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(5)


def answers(df):
    return {r.conv_id: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


@pytest.mark.parametrize("seed", range(3))
def test_dial_finds_the_cheapest_edits(seed):
    rng = random.Random(seed)
    for _ in range(2000):
        n = rng.randrange(12)
        roles, texts = [rng.choice("uasx") for _ in range(n)], [str(i) for i in range(n)]
        kinds = [rng.choice(["", "", "truncated", "doomed"]) for _ in range(n)]
        as_numbers = [{"": C.FREE, "truncated": C.CUT_OFF, "doomed": C.DOOMED}[k] for k in kinds]
        edits, states, cost, s = C.walk(roles, as_numbers, C.distances(roles, as_numbers, C.GOAL), C.START)
        more = C.finish(s)
        got = cost + more[2], "".join(edits + more[0])
        assert got == cheapest(roles, texts, kinds)[:2]
        kept = list(zip(*C.rows_of(edits + more[0], states + more[1], roles, texts)))
        assert kept == cheapest(roles, texts, kinds)[2]


def test_query(spark, tmp_path):
    rows = conversations(1)
    d = write(spark, tmp_path, conversations=frame(spark, rows))
    got = C.op12_repair(spark, d)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert answers(got) == {conv: wanted(mine)[0] for conv, mine in damage(rows).items()}


@pytest.mark.parametrize("rows_each", [1, 3, 7])
def test_long_conversations_are_solved_by_segments(spark, rows_each):
    rng = random.Random(rows_each)
    rows = [r for r in conversations(2, 30) if r[2] is not None and r[3] is not None]
    rows += [(7, rng.randrange(400), rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b.", "c", f"{i}!"])) for i in range(600)]
    rows += [(8, 5, "user", "All alike.")] * 300
    by_conv = {}
    for conv, *row in rows:
        by_conv.setdefault(conv, []).append(tuple(row))
    df = frame(spark, rows)
    done = C.solved_turns(df, rows_each=rows_each)
    assert done.where("conv = 7").count() > 20 and done.agg({"n_rows": "max"}).first()[0] <= rows_each
    got = answers(C.report(done).withColumnRenamed("conv", "conv_id"))
    assert got == {conv: wanted(mine)[0] for conv, mine in by_conv.items()}
    kept = {}
    for r in C.repaired_turns(df, rows_each=rows_each).orderBy("conv_id", "place").collect():
        kept.setdefault(r.conv_id, []).append((r.role, r.text))
    assert kept == {conv: x for conv, mine in by_conv.items() if (x := wanted(mine)[1])}


def test_dropped_and_empty(spark, tmp_path):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    d = write(spark, tmp_path / "a", conversations=frame(spark, [(gone, 0, "user", "Hi.")]))
    assert answers(C.op12_repair(spark, d)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    d = write(spark, tmp_path / "b", conversations=frame(spark, []))
    assert C.op12_repair(spark, d).count() == 0


def test_sql(spark, duck, sf_dir, tmp_path):
    d = write(spark, tmp_path, conversations=frame(spark, conversations(5)))
    for where, sql in ((sf_dir, C.OP12_SQL), (d, C.OP12_SQL.replace("FROM conversations", f"FROM read_parquet('{d}/conversations.parquet/*.parquet')"))):
        got = sorted(map(str, (tuple(r) for r in C.op12_repair(spark, where).collect())))
        assert got == sorted(map(str, duck.execute(sql).fetchall()))
