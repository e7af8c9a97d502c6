import hashlib
import re
import zlib
from itertools import product

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm.structure_repair import FINAL, _walk, code, damage, repair_conversations, repair_report

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = ("su", "ua", "au")


def faults(rows):
    """The plain reading: each row's first fault."""
    out, seen = [], set()
    for role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]", "", text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Every way of editing with at most three inserts, by brute force: (cost, audit, repaired turns)."""
    wrong, best = faults(rows), None
    choices = [["D"] if w in ("blank", "duplicate") else ["D", "K", "Ruser", "Rassistant"] for w in wrong]
    fills = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for edit in product(*choices):
        for put in product(fills, repeat=len(rows) + 1):
            if sum(map(len, put)) > 3:
                continue
            out, audit, cost = [], "", 0
            for k in range(len(rows) + 1):
                for role in put[k]:
                    out.append((role, ""))
                    audit, cost = audit + "I", cost + 5
                if k == len(rows):
                    break
                audit += edit[k][0]
                cost += {"D": 2, "K": 0, "R": 1}[edit[k][0]] + (5 if wrong[k] == "truncated" and edit[k] != "D" else 0)
                if edit[k] != "D":
                    out.append((rows[k][0] if edit[k] == "K" else edit[k][1:], rows[k][1]))
            if any(not r for r, _ in out) or not re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out)):
                continue
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, out)
    return best


def report(rows):
    """(turn, role, text) rows of a conversation, in order."""
    pairs = [(r, t) for _, r, t in rows]
    wrong, turns = faults(pairs), [t for t, _, _ in rows if t is not None]
    cost, audit, out = cheapest(pairs)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        "blank": wrong.count("blank"),
        "duplicate": wrong.count("duplicate"),
        "truncated": wrong.count("truncated"),
        "illegal": sum(a[0][:1] + b[0][:1] not in LEGAL for a, b in zip(pairs, pairs[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    }, out


def check(spark, rows, longest):
    given_rows = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("conv", "label", "copies", "code", "tail", "kind")}).repartition(3)
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    got = {r.conv_id: r.asDict() for r in repair_report(given_rows, longest=longest).collect()}
    repaired = {}
    for r in sorted(repair_conversations(given_rows, longest=longest).collect(), key=lambda r: r.place):
        repaired.setdefault(r.conv_id, []).append((r.role, r.text))
    assert set(got) == set(by_conv)
    for conv, turns in by_conv.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        want, out = report(turns)
        assert got[conv] == {"conv_id": conv, **want}, turns
        assert repaired.get(conv, []) == out


row = st.tuples(
    st.sampled_from([1, 2, None]),
    st.sampled_from([None, 0, 1, 2, 5]),
    st.sampled_from(["user", "assistant", "system", "user", "assistant", "tool", "", None]),
    st.sampled_from(["yes.", "no!  \n", "cut", "", " \t", None, "a\nb?", "ü"]),
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, min_size=1, max_size=9), st.sampled_from([1, 2, 1000]))
def test_brute_force(spark, rows, longest):
    by_conv = {}
    rows = [r for r in rows if by_conv.setdefault(r[0], []).append(r) or len(by_conv[r[0]]) <= 4]
    check(spark, rows, longest)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool"]), st.sampled_from(["ok.", "fine.", "cut", ""])), max_size=4))
def test_paths_alone(pairs):
    wrong = faults(pairs)
    codes = bytes(code(r[0] if r[0] in "sua" else "", w) for (r, _), w in zip(pairs, wrong))
    labels, tail, _ = _walk(codes, (1,) * len(codes), FINAL, 0, True)
    assert "".join(labels) + tail == cheapest(pairs)[1]


def test_long_conversation(spark):
    """One conversation over many segments, with a flood of equal rows, is repaired as in one piece."""
    rows = [(7, k, ("user", "assistant")[k % 2], f"text {k}.") for k in range(60)] + [(7, 30, "user", "same.")] * 40 + [(7, None, "system", "s.")]
    given_rows = spark.createDataFrame(rows, SCHEMA)
    one = repair_report(given_rows).collect()
    assert repair_report(given_rows, longest=7).collect() == one
    assert (one[0].duplicate, one[0].gaps, one[0].truncated) == (39, 0, 0)
    # text 30 and the first "same." are both the user's: one goes, with the copies
    assert one[0].cost == 80 and one[0].audit.count("D") == 40 and "R" not in one[0].audit


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(12) for t in range(12)] + [(None, None, None, None)]
    want = []
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or " ", text or " "
        if h:
            want += [(conv, turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)] * (2 if h == 3 else 1)
    got = [tuple(r) for r in damage(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(set(map(len, got))) == 1


def test_listed_without_rows(spark):
    ids = spark.createDataFrame([(1,), (1,), (2,)], "conv_id long")
    got = repair_report(spark.createDataFrame([(1, 0, "user", "only.")], SCHEMA), also=ids).orderBy("conv_id").collect()
    assert [(r.conv_id, r.cost, r.audit) for r in got] == [(1, 2, "D"), (2, 0, "")]
    assert got[0].repaired_sha256 == got[1].repaired_sha256 == hashlib.sha256(b"").hexdigest()


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair_report(none).count() == 0 and repair_conversations(none).count() == 0
