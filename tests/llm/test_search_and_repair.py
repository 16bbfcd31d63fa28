"""Top-k search, whitening and conversation repair against brute force, on small awkward tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from fieldweave.llm import conversations, topk, whitening

NAN, INF = float("nan"), float("inf")


def whole(v):
    if v is None or any(c is None or c != c or abs(c) == INF or abs(c) * 256 >= 2**63 for c in v):
        return None
    return [int(np.floor(256 * c)) for c in v]


# top-k


def brute_top(rows, k, every):
    valid = [(i, x) for i, v, *_ in rows if (x := whole(v)) is not None and i is not None]
    out = []
    for i, q in valid:
        if i % every == 0:
            found = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, x)))), j) for j, x in valid if j != i and len(x) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def vectors(seed, n, dim, scale=1.0):
    rng = np.random.default_rng(seed)
    return [[float(c) for c in v] for v in rng.standard_normal((n, dim)) * scale]


@pytest.mark.parametrize("scale", [1.0, 3000.0, 1e9])
def test_top_k_is_the_brute_force_one(spark, scale):
    rows = [(i, v, "own") for i, v in enumerate(vectors(3, 300, 9, scale))]
    rows += [(1000 + i, rows[4][1], "own") for i in range(150)]  # a third of all rows are equal
    rows += [(2000, None, "x"), (None, rows[0][1], "x"), (2010, [0.5] * 8 + [None], "x"), (2020, [NAN] * 9, "x"), (2030, [INF] * 9, "x"), (2040, [1e300] * 9, "x")]
    rows += [(2050, [], "x"), (2051, [], "x"), (2060, [0.25, 1.0], "x"), (2061, [2.0, 1.0], "x"), (50, rows[7][1], "x"), (77, rows[77][1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, piece string").repartition(5).cache()
    want = brute_top(rows, 5, 10)
    usual = topk.search(df.filter("vec_id % 10 = 0"), df).collect()
    tiny = topk.search(df.filter("vec_id % 10 = 0"), df, group_bytes=2000, least_groups=7, fan=2).collect()
    assert sorted(map(tuple, usual)) == want and sorted(map(tuple, tiny)) == want
    assert sorted(map(tuple, topk.search(df.filter("vec_id = 2060"), df, k=3).collect())) == [(2060, 1, 2061, 64 * 512 + 256 * 256)]


def test_tiles_of_every_size_agree():
    rng = np.random.default_rng(5)
    q, x = rng.integers(-200, 200, (1500, 4)), np.repeat(rng.integers(-200, 200, (900, 4)), 10, axis=0)
    ids = np.sort(rng.permutation(20000)[: len(x)])
    scores, found = topk.best(q, ids[:1500], x, ids, 5)
    for r in range(0, 1500, 50):
        s = x @ q[r]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[r]][:5]
        assert found[r].tolist() == ids[order].tolist() and scores[r].tolist() == s[order].tolist()


def test_search_without_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert topk.search(empty, empty).count() == 0 and topk.search(one, one).count() == 0
    assert topk.search(one, empty).count() == 0 and topk.search(empty, one).count() == 0


# whitening


def brute_whiten(rows, k):
    valid = [(i, x) for i, v, *_ in rows if (x := whole(v)) is not None]
    lengths = [len(x) for _, x in valid]
    dim = min(set(lengths), key=lambda d: (-lengths.count(d), d))
    valid = [(i, x) for i, x in valid if len(x) == dim]
    fit = np.array(sorted({tuple(x) for _, x in valid}), dtype=np.float64)
    n = len(fit)
    sums = [sum(int(r[j]) for r in fit) for j in range(dim)]
    y = fit - fit.mean(axis=0)
    values, u = np.linalg.eigh(y.T @ y / n)
    values, u = values[::-1][:k], u[:, ::-1][:, :k]
    out = []
    for i, x in valid:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        z = (np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)]) @ u) / np.sqrt(values)
        out += [(i, c + 1, n, deviation, z[c], values[c] / np.trace(y.T @ y / n)) for c in range(len(values))]
    return out


def same_whitened(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], abs(r[4]))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    sign: dict[int, float] = {}
    for a, b in zip(got, want):
        if abs(b[4]) > 1e-6:
            assert sign.setdefault(a[1], np.sign(a[4] * b[4])) == np.sign(a[4] * b[4])
        assert abs(abs(a[4]) - abs(b[4])) < 1e-9 * max(1, abs(b[4])) and abs(a[5] - b[5]) < 1e-10 and a[6] < 1e-9


@pytest.mark.parametrize("dim,block", [(40, 16), (40, 3), (3, 16), (1, 4)])
def test_whitening_is_the_brute_force_one(spark, dim, block):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in v], "own") for i, v in enumerate(rng.standard_normal((200, dim)) * np.geomspace(4, 0.2, dim) + 7)]
    rows += [(500 + i, rows[3][1], "own") for i in range(100)]
    rows += [(900, None, "x"), (901, [NAN] * dim, "x"), (902, [None] * dim, "x"), (903, [0.1] * (dim + 1), "x"), (None, rows[5][1], "x"), (3, rows[9][1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, at string").repartition(3)
    model = whitening.fit(df, block=block)
    same_whitened([tuple(r) for r in whitening.whiten(df, model).collect()], brute_whiten(rows, 4))


def test_whitening_without_variance_or_rows(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])] * 3, [(1, []), (2, [])]):
        df = frame(rows)
        assert whitening.whiten(df, whitening.fit(df)).count() == 0
    line = frame([(i, [float(i), 2.0 * i, 0.5]) for i in range(9)])  # one direction only
    model = whitening.fit(line)
    assert len(model.values) == 1 and abs(model.values[0] / model.trace - 1) < 1e-12 and whitening.whiten(line, model).count() == 9


def test_lanczos_restarts_and_finds_equal_values():
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.standard_normal((60, 60)))[0]
    for values in (np.ones(60), np.r_[5.0, 5, 5, 5, 5, 5, np.ones(54)], np.r_[9.0, 4, 2, 1, np.zeros(56)], np.linspace(1, 2, 60)):
        v = turn @ np.diag(values) @ turn.T
        for block in (1, 2, 7, 64):
            got, u = whitening.block_lanczos(lambda b: v @ b, 60, 4, block=block)  # noqa: B023
            if block >= 2 or len(set(values)) > 50:
                assert np.allclose(got, np.sort(values)[::-1][:4], atol=1e-12)
            assert np.abs(v @ u - u * got).max() < 1e-12 and np.abs(u.T @ u - np.eye(4)).max() < 1e-12


def test_deviations_are_exact_at_any_size():
    x = np.array([[3, -(2**55)], [7, 2**60]], dtype=np.int64)
    assert whitening.deviations(x, 10**6, [12, 2**61]) == [sum((10**6 * a - s) ** 2 for a, s in zip(map(int, r), [12, 2**61])) for r in x]


# conversations


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def brute_repair(rows):
    """The cheapest edits by trying all of them, shortest costs first, with the texts that they give."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        stripped = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not stripped else "d" if (role, text) in seen else "t" if stripped[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {0: {"": (0, "", [])}}
    layer = {"": (0, "", ())}  # roles so far, folded to their last two kinds: cost, audit, lines

    def fold(state, role):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, role))

    def put(into, state, value):
        if state is not None and (state not in into or value[:2] < into[state][:2]):
            into[state] = value

    def with_inserts(layer):
        out = dict(layer)
        for _ in range(3):
            for state, (cost, audit, lines) in list(out.items()):
                for role in ("user", "assistant"):
                    put(out, fold(state, role[0]), (cost + 3, audit + "I", (*lines, role + ":")))
        return out

    del best
    for (_, role, text), fault in zip(rows, faults):
        after: dict = {}
        for state, (cost, audit, lines) in with_inserts(layer).items():
            put(after, state, (cost + 4, audit + "D", lines))
            if fault not in ("b", "d"):
                more = 3 * (fault == "t")
                put(after, fold(state, role[:1]), (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                for to in ("user", "assistant"):
                    put(after, fold(state, to[0]), (cost + 3 + more, audit + "R", (*lines, f"{to}:{text}")))
        layer = after
    last = with_inserts(layer)
    cost, audit, lines = min((last[s] for s in ("", "a") if s in last), key=lambda v: v[:2])
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(4)
    rows = []
    for conv in range(160):
        for turn in range(rng.choice([1, 2, 4, 7])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User"])
            rows.append((conv, turn * rng.choice([1, 1, 3]), role, rng.choice(["Yes.", "No!", "and so", " ", "what?  \n", f"text {turn}.", "long " * 50])))
    rows += [(900, t, ("user", "assistant")[t % 2], rng.choice(["Yes.", "No", f"text {t}.", "End."])) for t in range(90)]
    rows += [(901, None, "user", "Hi."), (901, None, None, None), (901, 5, "assistant", "So."), (None, None, "user", "Hi."), (None, 1, "assistant", "Yes.")]
    rows += [(902, 1, "assistant", "Same."), (902, 1, "assistant", "Same."), (902, 1, "assistant", "Other."), (903, 0, "system", "Be brief.")]
    return rows


@pytest.mark.parametrize("chunk", [4096, 3])
def test_repair_is_the_brute_force_one(spark, turns, chunk):
    df = spark.createDataFrame([(*r, "own", 1) for r in turns], "conv_id long, turn long, role string, text string, at string, chunk int").repartition(4)
    damaged = conversations.damaged(df)
    want = {}
    for conv in {r[0] for r in turns}:
        want[conv] = brute_repair([r[1:] for r in brute_damage([r for r in turns if r[0] == conv])])
    got = {r[0]: tuple(r)[1:] for r in conversations.repair(damaged, chunk).collect()}
    assert got == want and len(got) == conversations.repair(damaged, chunk).count()
    assert any(w[5] == 0 and w[6] == "" for w in want.values()) and {"D", "I", "K", "R"} <= set("".join(w[6] for w in want.values()))


def test_each_signature_is_solved_once(spark, turns):
    df = spark.createDataFrame([(c * 1000 + k, *r) for k in range(20) for c, *r in turns if c is not None], "conv_id long, turn long, role string, text string").withColumn("there", conversations.F.lit(True))
    own = conversations.numbered(df).withColumn("chunk", conversations.F.lit(0).cast("long"))
    asked = own.groupBy("conv_id").agg(conversations.F.array_sort(conversations.F.collect_list(conversations.F.struct("at", "symbol"))).alias("s"))
    signatures = asked.select(conversations.F.expr("array_join(transform(s, x -> x.symbol), '')").alias("signature"))
    assert signatures.distinct().count() * 15 < signatures.count()


def test_a_long_conversation_goes_by_chunks():
    whole_text = "".join(random.Random(1).choices("0123456789abcdef", k=3000))
    ops, last = conversations.edits(whole_text, 0, conversations.END)
    cut = [whole_text[i : i + 700] for i in range(0, 3000, 700)]
    left, ends = list(conversations.END), []
    for s in cut[::-1]:
        ends.append(tuple(left))
        t = conversations.costs(s)
        left = [min(t[4 * a + b] + left[b] for b in range(4)) for a in range(4)]
    state, parts = 0, []
    for s, end in zip(cut, ends[::-1]):
        found, state = conversations.edits(s, state, end)
        parts += found
    assert parts == ops and state == last


def test_conversations_without_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(conversations.damaged(empty)).count() == 0
    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    gone = spark.createDataFrame([(7, turn, "user", "Hi.")], empty.schema)
    assert tuple(conversations.repair(conversations.damaged(gone)).first()) == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
