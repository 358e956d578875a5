import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from gleaner.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def slow_rows(rows):
    """conv_id -> damaged rows in order."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        show = lambda x: " " if x is None else x
        k = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        own += [(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def slow_repair(rows):
    """Counts, cost, audit and digest by the least (cost, letters) from each place and state, tried over all edits."""
    seen, faults = set(), []
    for _, role, text in rows:
        t = text.strip(SPACE)
        faults.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ()), "s": None, "u": None, "a": (0, "", ())}

    def inserted(best):
        for _ in range(4):
            for s in best:
                for to, role in (("u", "user"), ("a", "assistant")):
                    if (s, to) in step and best[to]:
                        got = (best[to][0] + 2, "I" + best[to][1], (f"{role}:", *best[to][2]))
                        best[s] = min(best[s] or got, got)
        return best

    best = inserted(best)
    for (_, role, text), fault in reversed(list(zip(rows, faults))):
        new = {}
        for s in best:
            found = [(best[s][0] + 3, "D" + best[s][1], best[s][2])]
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                for to, cost, letter, name in ((role[:1], 0, "K", role), ("u", 2, "R", "user"), ("a", 2, "R", "assistant")):
                    if (s, to) in step:
                        found.append((best[to][0] + cost + more, letter + best[to][1], (f"{name}:{text}", *best[to][2])))
            new[s] = min(found)
        best = inserted(new)
    cost, audit, lines = best[""]
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def got(spark, rows, partitions=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    return {r.conv_id: tuple(r)[1:] for r in C.summary(C.repair(C.damaged(df))).collect()}


def check(spark, rows):
    want = {c: slow_repair(r) for c, r in slow_rows(rows).items()}
    found = got(spark, rows)
    assert found == want


ROLES = ["user", "assistant", "user", "assistant", "system", "tool", "u", "", None, "Assistant"]
TEXTS = ["Hello.", "Why?", "cut off", "", " \t", None, "a.b", "Yes!  ", "é… no", "x" * 5000 + ".", "Yes! "]


def test_many_small_conversations(spark):
    rng = random.Random(1)
    rows = []
    for conv in range(300):
        for turn in range(rng.randint(1, 7)):
            rows.append((conv, rng.choice([turn, turn, 2 * turn, None]), rng.choice(ROLES), rng.choice(TEXTS) if rng.random() < 0.6 else f"text {rng.random()}."))
    check(spark, rows)


def test_well_formed_conversations_are_kept(spark):
    rows = [(c, t, ["system", "user", "assistant", "user", "assistant"][t], f"{c} {t}.") for c in range(50) for t in range(5)]
    found = got(spark, rows)
    whole = [c for c in range(50) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 or t in (1, 3) and zlib.crc32(f"{c}:{t}".encode()) % 20 == 4 for t in range(5))]
    assert whole and all(found[c][:7] == (0, 0, 0, 0, 0, 0, "KKKKK") for c in whole)


def test_long_conversation_over_many_partitions(spark):
    """Stretches of one conversation meet: the same edits as in one piece, and null ids are a conversation too."""
    rng = random.Random(2)
    rows = [(7, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["same.", "cut", f"text {t}.", f"text {t}", ""])) for t in range(3000)]
    rows += [(None, t, rng.choice(["user", "assistant"]), f"{t}!") for t in range(500)] + [(8, None, "user", "no turn.")] * 40 + [(9, 3, "user", "x.")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, rows)
        edits = C.repair(C.damaged(spark.createDataFrame(rows, SCHEMA)))
        assert edits.where("conv_id = 7").select("block").distinct().count() >= 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_copies_are_one_step(spark):
    """Many equal rows: one row stays, the rest are one edit."""
    df = spark.range(20_000).select(F.lit(5).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("Hi.").alias("text"))
    edits = C.repair(C.damaged(df))
    copies = 20_000 * {0: 0, 3: 2}.get(zlib.crc32(b"5: ") % 20, 1)
    assert edits.count() < 5
    row = C.summary(edits).first()
    assert (row.duplicate, row.illegal, row.gaps) == (max(0, copies - 1), max(0, copies - 1), 0)


def test_dropped_and_empty(spark):
    gone = [c for c in range(2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:5]
    found = got(spark, [(c, 0, "user", "Hi.") for c in gone])
    assert found == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone}
    assert got(spark, []) == {}


def test_edits_carry_the_repaired_rows(spark):
    rows = [(1, t, r, x, 1) for t, (r, x) in enumerate([("user", "Hi."), ("user", "Hi."), ("tool", "out."), ("user", "more")])]
    edits = C.repair(spark.createDataFrame(rows, SCHEMA + ", n long")).orderBy("block", "seq", "step").collect()
    assert "".join(e.edit * e.n for e in edits) == slow_repair([r[1:4] for r in rows])[6]
    assert [(e.new_role, e.text) for e in edits if e.new_role][0] == ("user", "Hi.")
    assert all(e.text is None for e in edits if e.edit == "D")


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", "a", 5, "b"), (1, 1, "assistant", "Yo.", "c", 6, "d")], SCHEMA + ", block string, n int, first string")
    assert C.summary(C.repair(C.damaged(df))).count() == 1
