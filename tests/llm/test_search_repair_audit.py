"""Exact top-k search, conversation repair and the filter audit against brute force: nulls, empty and long values, ties, repeated
rows, empty tables, extra columns."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from graphloom.llm import filter_audit, maxscore, repair

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sorted_rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# ---- exact top-k search ----

VECTORS = "vec_id long, embedding array<float>, label int, v int, score string"


def brute_top_k(rows, k, every):
    v = []
    for row in rows:
        e = row[1]
        if e is not None and all(x is not None and math.isfinite(x) for x in e):
            v.append((row[0], [math.floor(256 * float(np.float32(x))) for x in e]))
    out = []
    for i, (q, a) in enumerate(v):
        if q is None or q % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a, b, strict=False)), c is None, c or 0, c) for j, (c, b) in enumerate(v) if j != i), key=lambda t: t[:3])
        out += [(q, r + 1, s[3], -s[0]) for r, s in enumerate(scored[:k])]
    return sorted(out, key=repr)


def test_top_k_is_exact(spark):
    r = random.Random(5)
    hot = [r.gauss(0, 0.3) for _ in range(6)]
    rows = [(i, [r.gauss(0, 0.3) for _ in range(6)]) for i in range(300)]
    rows += [(i, list(hot)) for i in range(300, 450)]  # a third of all rows: one vector, ties everywhere
    rows += [(0, list(hot)), (10, list(hot)), (10, list(hot)), (None, list(hot)), (None, None), (20, None), (30, [float("nan")] * 6), (40, [None] * 6), (50, [float("inf")] * 6), (60, []), (70, [0.5]), (80, [0.0] * 6), (90, [-2.0] * 6), (100, [900.0] * 6)]
    df = spark.createDataFrame([(a, b, 1, 2, "x") for a, b in rows], VECTORS).repartition(3)
    got = sorted_rows(maxscore.top_k(df, k=5, every=10, size=64, block=8), "query_id", "rank", "vec_id", "score")
    assert got == brute_top_k(rows, 5, 10)
    assert got == sorted_rows(maxscore.top_k(df, k=5, every=10), "query_id", "rank", "vec_id", "score")


def test_top_k_of_few_and_no_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, [0.25, -1.0]), (7, [0.0, 0.1])]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], VECTORS)
    assert sorted_rows(maxscore.top_k(df), "query_id", "rank", "vec_id", "score") == brute_top_k(rows, 5, 50)
    assert maxscore.top_k(df.filter("vec_id = 0")).collect() == []
    assert maxscore.top_k(df.limit(0)).collect() == []


@pytest.mark.parametrize("scale", [1, 200, 10**6, 5 * 10**7])
def test_every_number_type_gives_the_same_vectors(scale):
    r = np.random.default_rng(3)
    q, p = r.integers(-9, 9, (20, 12)) * scale, r.integers(-9, 9, (12, 400)) * scale
    scores = q @ p
    threshold = np.partition(scores, -6, axis=1)[:, -6]
    got = {(int(a), int(b), int(c)) for a, b, c in zip(*maxscore.competitive(q, p, p.min(1), p.max(1), threshold), strict=True)}
    assert got == {(a, b, int(scores[a, b])) for a, b in zip(*np.nonzero(scores >= threshold[:, None]), strict=True)}


def test_non_essential_terms_are_probed_for_few_vectors(monkeypatch):
    """Thresholds leave some terms out of the traversal, and most vectors out of probing."""
    r = np.random.default_rng(4)
    q, p = (r.normal(0, 32, (8, 64))).astype(np.int64), (r.normal(0, 32, (64, 4000))).astype(np.int64)
    scores = q @ p
    threshold = np.partition(scores, -6, axis=1)[:, -6]
    bound = np.maximum(q * p.min(1), q * p.max(1))
    sums = np.cumsum(np.sort(bound, axis=1), axis=1)
    assert ((sums < threshold[:, None]).sum(1) > 15).all()
    found = maxscore.competitive(q, p, p.min(1), p.max(1), threshold)
    assert len(found[0]) == (scores >= threshold[:, None]).sum()


# ---- conversation repair ----

TURNS = "conv_id long, turn long, role string, text string, at int, chunk int, conv string, h int"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute_repair(conv, turns):
    """turns: (turn, role, text) in any order."""
    key = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()
    turns = sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, key(x[1], x[2])))
    seen, faults = set(), []
    for _, role, text in turns:
        bare = text.rstrip(" \t\n\v\f\r")
        faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    initials = [r[:1] or " " for _, r, _ in turns]
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    follow = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    name = {"u": "user", "a": "assistant"}

    def inserted(states):
        todo = list(states.items())
        while todo:
            s, (cost, audit, lines) = todo.pop()
            for c, t in follow[s].items():
                new = (cost + 2, audit + "I", [*lines, f"{name.get(c)}:"])
                if c != "s" and (t not in states or new[:2] < states[t][:2]):
                    states[t] = new
                    todo.append((t, new))
        return states

    states = inserted({0: (0, "", [])})
    for (_, role, text), initial, fault in zip(turns, initials, faults, strict=True):
        after, cut = {}, text.rstrip(" \t\n\v\f\r")[-1:] not in (".", "!", "?")

        def reach(t, new, after=after):
            if t not in after or new[:2] < after[t][:2]:
                after[t] = new

        for s, (cost, audit, lines) in states.items():
            reach(s, (cost + 3, audit + "D", lines))
            if fault in (0, 3):
                for c, t in follow[s].items():
                    if c == initial:
                        reach(t, (cost + cut, audit + "K", [*lines, f"{role}:{text}"]))
                    if c != "s":
                        reach(t, (cost + 2 + cut, audit + "R", [*lines, f"{name[c]}:{text}"]))
        states = inserted(after)
    cost, audit, lines = min((states[s] for s in (0, 3) if s in states), key=lambda x: x[:2])
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return (conv, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def expected(rows, damaged):
    by = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in brute_damage(rows) if damaged else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]:
        by[conv].append((turn, role, text))
    return sorted((brute_repair(c, t) for c, t in by.items()), key=repr)


def conversation(r, conv, n, roles, texts):
    return [(conv, t, r.choice(roles), r.choice(texts)(r)) for t in range(n)]


@pytest.fixture(scope="module")
def turns():
    r = random.Random(11)
    texts = [lambda r: f"t{r.random()}.", lambda r: f"t{r.random()}", lambda r: "same.", lambda r: f"t{r.random()}? \n"]
    rows = [x for conv in range(40) for x in conversation(r, conv, r.randrange(1, 9), ["user", "assistant"], texts)]
    rows += [x for conv in range(40, 60) for x in conversation(r, conv, r.randrange(1, 12), ["system", "user", "assistant", "tool", "ua", "", None], [*texts, lambda r: "", lambda r: None, lambda r: " \t\v"])]
    rows += [(60, None, "user", "a."), (60, None, "user", "a."), (60, 5, "user", "b."), (60, 2, "assistant", "c!"), (61, None, None, None), (None, 1, "user", "q?"), (None, 0, "system", "s."), (None, None, "assistant", "a.")]
    rows += [(62, 3, "user", "x" * 300_000), (62, 10, "assistant", "y. " * 100_000), (63, 0, "system", "only."), (64, 0, "assistant", " ")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x, 1, 2, "c", 3) for x in rows], TURNS).repartition(3)


def test_repair_after_damage(spark, turns):
    rows = [*turns, *((7, t, "user", f"again {t}.") for t in range(20, 60)), *turns[:25]]  # repeated rows too
    assert sorted_rows(repair.repair_digests(frame(spark, rows)), *COLUMNS) == expected(rows, True)


def test_chunks_give_the_same_edits(spark, turns):
    """Chunks of four turns: alternating roles converge, runs of one role do not and take the exact way; duplicates between."""
    r = random.Random(2)
    dot = [lambda r: f"t{r.random()}."]
    rows = [*turns, *conversation(r, 100, 70, ["user"], dot), *conversation(r, 101, 61, ["user", "assistant"], dot), *conversation(r, 102, 40, ["tool", "assistant"], dot)]
    rows += [(103, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(50)] + [(104, t, "user", "again.") for t in range(50)] + [(104, 50, "assistant", "end.")]
    rows += [(105, 0, "system", "s."), *((105, t, "user", f"{t}.") for t in range(1, 40))]
    want = expected(rows, False)
    assert sorted_rows(repair.repair_digests(frame(spark, rows), bits=2, damaged=False), *COLUMNS) == want
    assert sorted_rows(repair.repair_digests(frame(spark, rows), bits=2, passes=0, damaged=False), *COLUMNS) == want


def test_nothing_to_repair(spark):
    assert repair.repair_digests(frame(spark, [(0, 0, "user", "a.")]).limit(0)).collect() == []
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "gone.")]
    got = sorted_rows(repair.repair_digests(frame(spark, rows)), *COLUMNS)
    assert got == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())] == expected(rows, True)


def test_a_chunk_of_one_role_differs_by_more_than_a_constant():
    """Why fix-up passes alone would not do: the costs before a run of user turns depend on those behind it."""
    chunks = repair._Chunks(np.array([0]), np.ones(50, np.int64))
    a, b = (chunks.costs(np.array([v]))[0][0] for v in ([0, 4, 2, 0], [0, 4, 0, 1]))
    assert len(set(a - b)) > 1
    mixed = repair._Chunks(np.array([0]), np.array([1, 2] * 8))
    a, b = (mixed.costs(np.array([v]))[0][0] for v in ([0, 4, 2, 0], [2, 0, 0, 2]))
    assert len(set((a - b)[1:])) == 1


# ---- filter audit ----

DOCS = "doc_id long, text string, lang string, source string, n long, cell int, part string"
LABELS = "doc_id long, quality int, toxic int, lang string, n int"


def brute_audit(rows, labels):
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[i] == 1} for i in (0, 1))
    first = {}
    for d, text, _ in rows:
        if d is not None:
            first[text or ""] = min(first.get(text or "", d), d)
    docs = []
    for d, text, lang in rows:
        text = text or ""
        words = WORD.findall(text)
        same = first.get(text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": same is not None and (d is None or d > same)}
        docs.append((lang or "", {f for f in fails if fails[f]}, d in good, d in toxic))
    out = []
    for part in {p for p, *_ in docs}:
        own = [x[1:] for x in docs if x[0] == part]
        removed = {}
        for order in itertools.permutations("ABCDE"):
            for i, f in enumerate(order):
                gone = [x for x in own if x[0] & set(order[:i])]
                left = [x for x in own if not x[0] & set(order[:i])]
                here = [x for x in left if f in x[0]]
                removed[f] = removed.get(f, 0) + len(here)
                out.append([part, "".join(order), i + 1, len(left) - len(here), len(here), sum(f in x[0] for x in gone), sum(x[0] == {f} for x in own), sum(x[1] for x in here), sum(x[2] for x in here), f])
        out = [[*r[:-1], removed[r[-1]]] if r[0] == part and isinstance(r[-1], str) else r for r in out]
    return sorted((tuple(r) for r in out), key=repr)


def test_filter_audit(spark):
    r = random.Random(8)
    rows = [(i, r.choice(["", None, "a B", "x " * 300, " ".join(f"w{r.randrange(400)}" for _ in range(r.randrange(150, 400))) + r.choice(["", " #", " UPPER CASE" * 20, "\n|\v"])]), r.choice(["en", "de", None, ""])) for i in range(120)]
    rows += [(i, "hot text", "en") for i in range(200, 260)] + [(None, "hot text", "fr"), (None, "alone", "fr"), (None, "alone", "fr"), (5, "twice", "de"), (5, "twice", "de"), (6, "twice", "en"), (7, "é" * 200_000, "de"), rows[0], rows[0]]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 250, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1), (210, None, None)]
    docs = spark.createDataFrame([(*x, "s", 1, 2, "p") for x in rows], DOCS).repartition(3)
    said = spark.createDataFrame([(*x, "z", 0) for x in labels], LABELS)
    names = ["part", "filter_order", "step", *filter_audit.COUNTS]
    assert sorted_rows(filter_audit.audit(docs, said), *names) == brute_audit(rows, labels)
    assert filter_audit.audit(docs.limit(0), said).collect() == []
    assert sorted_rows(filter_audit.audit(docs, said.limit(0)), *names) == brute_audit(rows, [])
