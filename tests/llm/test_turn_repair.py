"""Turn repair against an enumeration of edits, cut into stretches, under skew, and on odd rows."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from vegaflow.llm import turn_repair
from vegaflow.llm.common import table
from vegaflow.llm.queries import op11_turn_repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()
NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def after_damage(rows):
    """{conv: (turn, role, text) in order} by the contract's words."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept.extend([(turn, "user" if kind == 4 else role, text)] * (kind != 0) * (1 + (kind == 3)))
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, x in out.items()}


def faults(rows):
    out = []
    for i, (_, role, text) in enumerate(rows):
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not marks else "duplicate" if (role, text) in [r[1:] for r in rows[:i]] else "truncated" if marks[-1] not in ".!?" else "")
    return out


def counts(rows):
    f, turns = faults(rows), [r[0] for r in rows if r[0] is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal)


def enumerated(rows):
    """Every edit of every row and up to two inserts of any role before each and at the end: the least (cost, audit)."""
    f = faults(rows)
    runs = [x for n in range(3) for x in itertools.product(("user", "assistant"), repeat=n)]
    best = None

    def go(i, cost, audit, said):
        nonlocal best
        if best and cost > best[0]:
            return
        for run in runs:
            c, a, s = cost + 3 * len(run), audit + "I" * len(run), said + [f"{r}:" for r in run]
            if i == len(rows):
                if re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in s)) and (best is None or (c, a) < best[:2]):
                    best = c, a, "\n".join(s)
                continue
            _, role, text = rows[i]
            go(i + 1, c + 4, a + "D", s)
            if f[i] not in ("blank", "duplicate"):
                c += 3 * (f[i] == "truncated")
                if role:
                    go(i + 1, c, a + "K", [*s, f"{role}:{text}"])
                for r in ("user", "assistant"):
                    go(i + 1, c + 3, a + "R", [*s, f"{r}:{text}"])

    go(0, 0, "", [])
    return best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest()


def by_strings(rows):
    """The same by a plain table of audit strings, for conversations too long to enumerate."""
    grammar = {"": "", "s": "s", "u": "u", "a": "a"}
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(states):
        out = dict(states)
        for _ in range(2):
            for g, (c, a, said) in list(out.items()):
                for r in ("user", "assistant"):
                    n = after.get((g, r[0]))
                    if n is not None:
                        out[n] = min(out.get(n, (10**9,)), (c + 3, a + "I", (*said, f"{r}:")))
        return out

    states = {grammar[""]: (0, "", ())}
    for (_, role, text), fault in zip(rows, faults(rows), strict=True):
        new = {}
        for g, (c, a, said) in inserted(states).items():
            ways = [(g, (c + 4, a + "D", said))]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                ways += [(after.get((g, role[:1])), (c + more, a + "K", (*said, f"{role}:{text}")))]
                ways += [(after.get((g, r[0])), (c + more + 3, a + "R", (*said, f"{r}:{text}"))) for r in ("user", "assistant")]
            for n, w in ways:
                if n is not None:
                    new[n] = min(new.get(n, (10**9,)), w)
        states = new
    c, a, said = min(w for g, w in inserted(states).items() if g in ("", "a"))
    return c, a, hashlib.sha256("\n".join(said).encode()).hexdigest()


def random_rows(rng, n):
    roles, texts = ["user", "assistant", "system", "tool", "", " "], ["Yes.", "no", "", " \t", "What?", "x.y", "Ok!  "]
    return sorted(((int(rng.integers(0, 9)), str(rng.choice(roles, p=[0.35, 0.35, 0.12, 0.08, 0.05, 0.05])), str(rng.choice(texts))) for _ in range(n)), key=lambda r: r)


def test_enumeration():
    rng = np.random.default_rng(2)
    for _ in range(150):
        rows = random_rows(rng, int(rng.integers(0, 5)))
        got = turn_repair.solve([(*r, 1) for r in rows])
        assert got == (*counts(rows), *enumerated(rows)) == (*counts(rows), *by_strings(rows))


def test_long_ones_and_copies_against_strings():
    rng = np.random.default_rng(3)
    for _ in range(200):
        rows = random_rows(rng, int(rng.integers(5, 40)))
        folded = [(*r, len(list(g))) for r, g in itertools.groupby(rows)]
        want = (*counts(rows), *by_strings(rows))
        assert turn_repair.solve([(*r, 1) for r in rows]) == want == turn_repair.solve(folded)


def test_many_copies_are_one_layer():
    cost, audit = turn_repair.solve([(0, "user", "a.", 200_000), (1, "assistant", "b.", 1)])[5:7]
    assert cost == 4 * 199_999 and audit == "K" + "D" * 199_999 + "K"
    assert len(turn_repair.layers_of([("u", turn_repair.FINE, 10**12)], 0)) < 10


@pytest.mark.parametrize("stretch", [4096, 3])
def test_a_table_by_spark(spark, sf, monkeypatch, stretch):
    """Whole table; with stretches of three turns every conversation goes through the matrices."""
    monkeypatch.setattr(turn_repair, "STRETCH", stretch)
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rng = np.random.default_rng(5)
    rows += [(10**6 + int(rng.integers(0, 3)), *r) for r in random_rows(rng, 300)]
    got = {r["conv_id"]: tuple(r[c] for c in NAMES) for r in turn_repair.repair(spark, spark.createDataFrame(rows, SCHEMA), damage=True).collect()}
    want = {c: (*counts(x), *by_strings(x)) for c, x in after_damage(rows).items()}
    assert got == want


def test_query_gives_every_conversation(spark, sf):
    r = op11_turn_repair(spark, sf)
    ids = table(spark, sf, "conversations").select("conv_id").distinct()
    assert r.columns == ["conv_id", *NAMES] and r.count() == ids.count() == r.join(ids, "conv_id").count()


def test_one_conversation_holds_a_third_of_all_rows(spark, monkeypatch):
    """A long conversation, and a turn that is repeated very often, are split over tasks with the result of one."""
    monkeypatch.setattr(turn_repair, "STRETCH", 16)
    rng = np.random.default_rng(6)
    hot = [(1, i, ("user", "assistant")[i % 2] if rng.random() < 0.9 else "system", str(rng.choice(["a.", "b", ""])) + (f"{i}." if rng.random() < 0.8 else "")) for i in range(600)]
    rows = hot + [(2, 5, "user", "same.")] * 500 + [(i, t, "user", "x.") for i in range(3, 200) for t in range(2)]
    got = {r["conv_id"]: tuple(r[c] for c in NAMES) for r in turn_repair.repair(spark, spark.createDataFrame(rows, SCHEMA).repartition(7), damage=True).collect()}
    assert got == {c: (*counts(x), *by_strings(x)) for c, x in after_damage(rows).items()}


def test_odd_rows(spark):
    gone = next(i for i in range(10**4) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "x."), (None, None, None, None), (None, 3, "user", "Hi."), (-1, None, "user", "Hi."), (-1, None, "assistant", "Yes."), (-1, 2, "", "Yes."), (-1, 2, "", "Yes."), (-2, 1, "user", "日本 " * 300_000 + "."), (-2, 2**62, "assistant", "ok")]
    df = spark.createDataFrame([(*r, "a", 1, "p") for r in rows], SCHEMA + ", audit string, copies int, place string")
    got = {r["conv_id"]: tuple(r[c] for c in NAMES) for r in turn_repair.repair(spark, df, damage=True).collect()}
    want = {c: (*counts(x), *by_strings(x)) if x else (0, 0, 0, 0, 0, 0, "", EMPTY) for c, x in after_damage(rows).items()}
    assert got == want and got[gone] == (0, 0, 0, 0, 0, 0, "", EMPTY)
    assert turn_repair.repair(spark, df.where("false")).count() == 0
    plain = turn_repair.repair(spark, df.where("conv_id = -2")).first()
    assert plain["cost"] == 3 and plain["audit"] == "KK" and plain["gaps"] == 2**62 - 2
