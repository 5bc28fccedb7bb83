"""Plans with interacting moves against a replay that applies one move after the other."""

import os
import random

import pytest

from marlstone.operators import moves

FILES = "rel_path string, parent_dir string, name string, file_hash string, analysed boolean"


def file_rows(state):
    return [(p, os.path.dirname(p), os.path.basename(p), h, a) for p, (h, a) in state.items()]


def replay(plan, snapshot, state):
    """[(idx, from, to, result, target)] and the files at the end; plan: (idx, from, to)."""
    state, out = dict(state), []
    is_dir = lambda d: any(p.startswith(f"{d}/") for p in state)
    for idx, src, dst in sorted(plan, key=lambda m: (-m[1].count("/"), *m)):
        target = None
        if src == dst:
            result = "noop"
        elif src not in state:
            result = "not_found"
        elif snapshot.get(src) and snapshot[src] != state[src][0]:
            result = "stale_source"
        elif is_dir(dst) or any("/".join(dst.split("/")[:i]) in state for i in range(1, dst.count("/") + 1)):
            result = "conflict"
        elif dst in state and state[src][0] == state[dst][0] != "":
            result = "noop"
        elif dst in state and not state[dst][1]:
            result = "meta_only"
            state[dst] = (state[dst][0], state[dst][1] or state[src][1])
        else:
            result, target, n = "moved", dst, 1
            stem, ext = os.path.basename(dst), ""
            if "." in stem:
                stem, _, ext = stem.rpartition(".")
                ext = f".{ext}"
            while target in state:
                target = f"{os.path.dirname(dst)}/{stem} ({n}){ext}"
                n += 1
            state[target] = state.pop(src)
        out.append((idx, src, dst, result, target))
    return out, state


def run(spark, plan, snapshot, state, root="r"):
    m = spark.createDataFrame(plan, "idx long, from_path string, to_path string")
    snap = spark.createDataFrame(list(snapshot.items()) or [("", "")], "rel_path string, file_hash string")
    return moves.applied(m, snap, spark.createDataFrame(file_rows(state), FILES), root).collect()


#: Literal cases: files (hash, analysed), moves in order, a snapshot, and what some moves come to.
CASES = {
    "free": ({"a.txt": ("A", True), "b.txt": ("B", True), "c.txt": ("A", True)}, [("a.txt", "new.txt"), ("b.txt", "new.txt"), ("c.txt", "new.txt")], {},
             {"a.txt": ("moved", "new.txt"), "b.txt": ("moved", "new (1).txt"), "c.txt": ("noop", None)}),
    "taken": ({f"s{i:03d}.txt": (f"h{i}", True) for i in range(60)} | {"t.txt": ("T", True), "t (2).txt": ("x", True), "t (3).txt": ("y", True), "t (7).txt": ("z", True), "t (07).txt": ("n", True)},
              [(f"s{i:03d}.txt", "t.txt") for i in range(60)], {}, {"s000.txt": ("moved", "t (1).txt"), "s001.txt": ("moved", "t (4).txt"), "s004.txt": ("moved", "t (8).txt")}),
    "chain": ({c: (c, True) for c in "abcd"}, [("d", "e"), ("c", "d"), ("b", "c"), ("a", "b")], {}, {"a": ("moved", "b"), "d": ("moved", "e")}),
    "against": ({c: (c, True) for c in "abcd"}, [("a", "b"), ("b", "c"), ("c", "d")], {}, {"a": ("moved", "b (1)"), "c": ("moved", "d (1)")}),
    "swap": ({c: (c, True) for c in "ab"}, [("a", "b"), ("b", "a")], {}, {"a": ("moved", "b (1)"), "b": ("moved", "a")}),
    "refilled": ({c: (c, True) for c in "ab"}, [("b", "x"), ("a", "b"), ("b", "y")], {"b": "b"}, {"b": ("stale_source", None)}),
    "twice": ({"a": ("A", True)}, [("a", "x"), ("a", "y")], {}, {"a": ("not_found", None)}),
    "told": ({"t": ("T", False), "a": ("A", False), "b": ("B", True), "c": ("C", True), "d": ("T", True)}, [(c, "t") for c in "abcd"], {},
             {"a": ("meta_only", None), "b": ("meta_only", None), "c": ("moved", "t (1)"), "d": ("noop", None)}),
    "folders": ({"d/e/x": ("X", True), "a": ("A", True), "b": ("B", True), "c": ("C", True)}, [("d/e/x", "y"), ("a", "d"), ("b", "d/z"), ("c", "n/m"), ("y", "n")], {},
                {"a": ("moved", "d"), "b": ("conflict", None), "y": ("conflict", None)}),
    "numbered": ({"a (1).txt": ("1", True), "a.txt": ("A", True), "b": ("B", True), "c": ("C", True)}, [("b", "a (1).txt"), ("c", "a.txt")], {}, {"b": ("moved", "a (1) (1).txt"), "c": ("moved", "a (2).txt")}),
}


def random_plans(seed, count):
    rng = random.Random(seed)
    state, plan, snapshot = {}, set(), {}
    for p in range(count):
        names = [f"r/{p}/{n}" for n in ("a.txt", "a (1).txt", "a (1) (1).txt", "b.txt", "b (2).txt", "d", "d/a.txt", "d/e", "d/e/a.txt", "c", ".h", "x/y/z")]
        own = {}
        for n in rng.sample(names, 7):
            if not any(o.startswith(f"{n}/") or n.startswith(f"{o}/") for o in own):
                own[n] = (rng.choice(["A", "B", "C", ""]), rng.random() < 0.6)
        state |= own
        snapshot |= {n: h for n, (h, _) in own.items() if rng.random() < 0.3}
        plan |= {(i, rng.choice([*own, rng.choice(names)]), rng.choice(names)) for i in range(rng.randint(2, 7))}
    return state, sorted(plan), snapshot


@pytest.fixture(scope="module")
def results(spark):
    """All literal cases and 150 random plans, each in a directory of its own, applied at once; the replay of the same."""
    state, plan, snapshot = random_plans(1, 150)
    for name, (files, moved, then, _) in CASES.items():
        state |= {f"r/{name}/{k}": v for k, v in files.items()}
        snapshot |= {f"r/{name}/{k}": v for k, v in then.items()}
        plan += [(i, f"r/{name}/{a}", f"r/{name}/{b}") for i, (a, b) in enumerate(moved)]
    return run(spark, plan, snapshot, state), replay(plan, snapshot, state)


def test_plans_equal_a_replay(results):
    got, (want, after) = results
    assert sorted((r["from_path"], r["to_path"], r["result"], r["target"] or "") for r in got) == sorted((s, t, r, x or "") for _, s, t, r, x in want)
    assert {r["result"] for r in got} == {"noop", "not_found", "stale_source", "conflict", "meta_only", "moved"}


@pytest.mark.parametrize("name", CASES)
def test_literal_cases(results, name):
    last = {}
    _, moved, _, expected = CASES[name]
    found = {(r["from_path"], r["to_path"]): (r["result"], r["target"]) for r in results[0]}
    for a, b in moved:
        last[a] = found[f"r/{name}/{a}", f"r/{name}/{b}"]
    for a, (result, target) in expected.items():
        assert last[a] == (result, target and f"r/{name}/{target}")


def test_no_file_is_lost(results):
    """A move's target is taken by nothing else unless that left again later in the replay."""
    got, (want, after) = results
    left = {r["from_path"] for r in got if r["result"] == "moved"}
    targets = [r["target"] for r in got if r["target"]]
    assert all(targets.count(t) == 1 or t in left for t in targets)


def test_rejected_and_idle_moves(spark):
    state = {"r/a": ("A", True), "q/b": ("B", True)}
    got = {(r["from_path"], r["to_path"]): r["result"] for r in run(spark, [(1, "r/a", "r/a"), (2, "q/b", "r/b"), (3, "r/a", "q/a"), (4, "r/none", "r/x"), (5, "r/a", "")], {}, state)}
    assert got == {("r/a", "r/a"): "noop", ("q/b", "r/b"): "rejected", ("r/a", "q/a"): "rejected", ("r/none", "r/x"): "not_found", ("r/a", ""): "rejected"}
    none = moves.applied(spark.createDataFrame([], "from_path string, to_path string"), spark.createDataFrame([("", "")], "rel_path string, file_hash string"), spark.createDataFrame(file_rows(state), FILES), "r")
    assert none.collect() == []
