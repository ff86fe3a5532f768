"""Lineage by content against all pairs."""

import random

from loomgraph.operators import content


def plain(removed, added, t):
    def runs(text):
        w = (text or "").split()
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    base, head = ({i: s for i, x in side if (s := runs(x))} for side in (removed, added))
    pairs = {}
    for a, x in base.items():
        for b, y in head.items():
            n = len(x & y)
            if n * 1000 >= t * min(len(x), len(y)):
                pairs[a, b] = (n * 1000 // (len(x) + len(y) - n), n, len(x), len(y))
    good = {p: v[0] for p, v in pairs.items() if v[0] >= t}
    best = lambda k, i: min((-s, p[1 - i]) for p, s in good.items() if p[i] == k)[1]
    same = {p for p in good if best(p[0], 0) == p[1] and best(p[1], 1) == p[0]}
    gone = ({p[0] for p in same}, {p[1] for p in same})
    out = {("renamed", *p, good[p]) for p in same}
    rest = {p: v for p, v in pairs.items() if p[0] not in gone[0] and p[1] not in gone[1]}
    for change, i, size in (("split", 0, 3), ("merged", 1, 2)):
        inside = {p: v for p, v in rest.items() if v[1] * 1000 >= t * v[size]}
        for p, v in inside.items():
            if sum(q[i] == p[i] for q in inside) > 1:
                out.add((change, *p, v[0]))
    return out


def test_lineage_is_that_of_all_pairs(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common = say(30)
    texts = [say(rng.choice([1, 2, 3, 40, 80])) + " " + common for _ in range(25)]
    removed = [(f"r{i:02}", t) for i, t in enumerate(texts)] + [("rx", None), ("ry", ""), ("rz", "one two")]
    parts = [say(50) for _ in range(6)]
    removed += [("whole", " ".join(parts[:3])), ("p3", parts[3]), ("p4", parts[4]), ("p5", parts[5])]
    added = [("whole2", " ".join(parts[3:]) + " " + say(4)), *[(f"q{i}", parts[i]) for i in range(3)], ("az", "one two"), ("an", None)]
    for i, t in enumerate(texts):
        w = t.split()
        for _ in range(rng.choice([0, 1, 6, 30])):
            w[rng.randrange(len(w))] = rng.choice(words)
        added.append((f"a{i:02}", " ".join(w)))
    added += [("copy", texts[0]), ("copy2", texts[0])]
    frame = lambda rows: spark.createDataFrame(rows, "id string, text string")
    for t in (500, 800):
        got = {tuple(r) for r in content.content_lineage(frame(removed), frame(added), t).collect()}
        assert got == plain(removed, added, t)
    assert {("split", "whole", f"q{i}") for i in range(3)} <= {r[:3] for r in got}
    assert {("merged", f"p{i}", "whole2") for i in (3, 4, 5)} <= {r[:3] for r in got}
    assert content.content_lineage(frame(removed).limit(0), frame(added)).collect() == []


def test_copies_are_compared_once(spark, tmp_path):
    """the runs of a pair are counted for each pair of different texts, not for each pair of their copies."""
    text = lambda k, n: " ".join(f"{k}w{i}" for i in range(n))
    removed = [(f"r{k}-{c}", text(k, 20)) for k in range(3) for c in range(12)]
    added = [(f"a{k}-{c}", text(k, 20 + k)) for k in range(3) for c in range(12)]
    frame = lambda rows: spark.createDataFrame(rows, "id string, text string")
    held = []
    write = content.materialize

    def kept(df, label):
        held.append((label, out := write(df, label)))
        return out

    content.materialize = kept
    try:
        got = {tuple(r) for r in content.content_lineage(frame(removed), frame(added)).collect()}
    finally:
        content.materialize = write
    assert got == plain(removed, added, 500)
    runs = sum(df.count() for label, df in held if label in ("content-lead", "content-shared"))
    assert 0 < runs < 200
