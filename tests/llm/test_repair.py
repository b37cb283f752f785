"""op11: conversation repair against every edit of small conversations and a plain left-to-right search."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tessella.llm import queries, repair

TURNS = "conv_id long, turn long, role string, text string, n long, first string, block int, _copies int, at string"
RULE = re.compile("(s?(ua)+)?")


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 1, 9, "y") for r in rows], TURNS).repartition(4)


def every_edit(rows):
    """Cheapest (cost, audit) of rows (initial, truncated, gone) by trying all edits with up to two inserts in a place."""
    inserts = [(2 * n, "I" * n, "".join(x)) for n in range(3) for x in itertools.product("ua", repeat=n)]
    options = []
    for initial, truncated, gone in rows:
        own = [(3, "D", "")] + ([] if gone else [(truncated, "K", initial), (2 + truncated, "R", "u"), (2 + truncated, "R", "a")])
        options.append([(a + c, b + d, x + y) for a, b, x in inserts for c, d, y in own])
    return min((sum(e[0] for e in way), "".join(e[1] for e in way)) for way in itertools.product(*options, inserts) if RULE.fullmatch("".join(e[2] for e in way)))


def left_to_right(rows):
    """The same by states of the roles so far, inserts relaxed until nothing gets cheaper."""
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}

    def relax(best):
        while True:
            new = dict(best)
            for state, (cost, audit) in best.items():
                for role in set(legal[state]) & set("ua"):
                    new[role] = min(new.get(role, (10**9, "")), (cost + 2, audit + "I"))
            if new == best:
                return best
            best = new

    best = {"": (0, "")}
    for initial, truncated, gone in rows:
        best, new = relax(best), {}
        for state, (cost, audit) in best.items():
            ways = [(state, cost + 3, audit + "D")]
            if not gone:
                ways += [(r, cost + truncated + 2, audit + "R") for r in set(legal[state]) & set("ua")]
                ways += [(initial, cost + truncated, audit + "K")] if initial and initial in legal[state] else []
            for to, c, a in ways:
                new[to] = min(new.get(to, (10**9, "")), (c, a))
        best = new
    best = relax(best)
    return min(best[s] for s in ("", "a") if s in best)


def plain(turns):
    """The query's rows by its rules, one conversation at a time."""
    convs = {}
    for conv, turn, role, text in turns:
        rows = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        rows += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, judged, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in rows:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                count[fault] += 1
            judged.append((role[:1], fault == "truncated", fault in ("blank", "duplicate")))
        cost, audit = left_to_right(judged)
        known = [t for t, _, _ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(judged))
        lines, left, state = [], iter(rows), ""
        for e in audit:
            row = None if e == "I" else next(left)
            if e == "D":
                continue
            state = row[1][:1] if e == "K" else "a" if state == "u" else "u"
            lines.append((row[1] if e == "K" else {"u": "user", "a": "assistant"}[state]) + ":" + (row[2] if row else ""))
        out.append((conv, gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def by_matrices(rows):
    total = repair.UNIT
    for initial, truncated, gone in rows:
        total = repair.product(total, repair.turn_matrix(initial, truncated, gone, 1))
    return repair.cheapest(total)


def test_product_finds_the_cheapest_of_all_edits():
    rng = random.Random(1)
    kinds = [(i, t, g) for i in ("s", "u", "a", "t") for t in (False, True) for g in (False, True) if not (t and g)]
    for n in range(3):
        for rows in itertools.product(kinds, repeat=n):
            assert by_matrices(rows) == every_edit(rows) == left_to_right(rows)
    for _ in range(8):
        rows = [rng.choice(kinds) for _ in range(3)]
        assert by_matrices(rows) == every_edit(rows)
    for _ in range(300):
        rows = [rng.choice(kinds) for _ in range(rng.randrange(4, 30))]
        assert by_matrices(rows) == left_to_right(rows)


def test_product_is_associative_and_copies_are_deletions():
    rng = random.Random(2)
    ms = [repair.turn_matrix(rng.choice("suat"), rng.random() < 0.3, rng.random() < 0.2, rng.randrange(1, 3)) for _ in range(40)]
    for a, b, c in zip(ms, ms[1:], ms[2:]):
        assert repair.product(repair.product(a, b), c) == repair.product(a, repair.product(b, c))
    assert repair.turn_matrix("u", False, False, 3) == repair.product(repair.turn_matrix("u", False, False, 1), repair._one({(i, i): (6, "DD") for i in range(4)}))


def conversations(rng, n, most):
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, most)):
            rows.append((c, t, rng.choice(("system", "user", "assistant", "user", "assistant", "tool", "")), rng.choice(("Good day.", "Well", "  \n", "", "Ha!", "é …", f"Point {rng.randrange(4)}.", f"x{t}?"))))
    return rows


def odd_rows():
    long = "x" * 50_000
    return [
        (None, 1, "user", "a."), (None, None, "assistant", "b."), (500, None, None, None), (500, None, "user", "hey."), (500, 3, "user", None), (501, 5, "user", long), (501, 6, "assistant", long + "."),
        (501, 9, "assistant", long + "."), (502, 1, "user", "a."), (502, 1, "user", "a."), (502, 1, "assistant", "b."), (502, 1, "user", "a."), (503, -4, "user", "\x85"), (504, 2, "Ünsal", "é."),
    ]


@pytest.mark.parametrize("size", [(512, 64), (3, 2), (1, 2)])
def test_query_equals_plain_rules_whatever_the_blocks(spark, monkeypatch, size):
    """Blocks of any size, conversations over many partitions, odd rows, clashing names."""
    monkeypatch.setattr(repair, "BLOCK_ROWS", size[0])
    monkeypatch.setattr(repair, "FAN", size[1])
    rng = random.Random(5)
    rows = conversations(rng, 40, 12) + [(90, t % 230, *r[2:]) for t, r in enumerate(conversations(rng, 60, 9))] + odd_rows()
    got = sorted((tuple(r) for r in repair.repair_digest(frame(spark, rows)).collect()), key=str)
    assert got == plain(rows)


def test_one_conversation_over_all_partitions(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"Point {t}.") for t in range(3000)]
    turns, copies = repair.damage(frame(spark, rows))
    parts = repair.blocks(turns, copies)
    assert parts.select("part").distinct().count() >= 6
    assert [tuple(r) for r in repair.repair_digest(frame(spark, rows)).collect()] == plain(rows)


def test_repaired_turns_and_nothing(spark):
    rows = [(1, 0, "user", "Hi"), (1, 1, "user", "Hi"), (1, 2, "tool", "Yes."), (2, 0, "assistant", " ")]
    parts = repair.blocks(frame(spark, rows))
    plan = repair.repair_plan(parts)
    fixed = repair.repaired_turns(parts, plan).orderBy("conv_id", "block", "pos").select("conv_id", "turn", "role", "text", "edit").collect()
    assert [tuple(r) for r in fixed] == [(1, 0, "user", "Hi", "K"), (1, 2, "assistant", "Yes.", "R")]
    assert {(r.conv_id, r.cost, r.audit) for r in plan.collect()} == {(1, 6, "KDR"), (2, 3, "D")}
    assert repair.repair_digest(frame(spark, rows).limit(0)).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.op11_conversation_repair(spark, sf).collect()), key=str) == plain(rows)


def test_sql_equals_plain_rules_over_odd_rows():
    duckdb = pytest.importorskip("duckdb")
    rows = conversations(random.Random(5), 60, 12) + odd_rows()
    c = duckdb.connect()
    c.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(c.execute(queries.ORACLES["op11_conversation_repair"]).fetchall(), key=str) == plain(rows)
