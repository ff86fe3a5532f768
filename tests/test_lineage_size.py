"""Lineage of many copies: pairs of units are made for the result alone."""

from loomgraph.operators import content
from tests.test_content import plain


def test_pairs_of_copies_are_not_written(spark, monkeypatch):
    """what is written between the steps has a row for each class or unit, not for each pair of copies, and the rows are those of all pairs."""
    text = lambda k, n: " ".join(f"{k}w{i}" for i in range(n))
    removed = [(f"r{k}-{c:03}", text(k, 20)) for k in range(2) for c in range(40)] + [("lone", text(1, 21))]
    added = [(f"a{k}-{c:03}", text(k, 20 + k)) for k in range(2) for c in range(25)] + [("none", None)]
    frame = lambda rows: spark.createDataFrame(rows, "id string, text string")
    held = []
    write = content.materialize
    monkeypatch.setattr(content, "materialize", lambda df, label: held.append((label, out := write(df, label))) or out)
    got = [tuple(r) for r in content.content_lineage(frame(removed), frame(added)).collect()]
    assert set(got) == plain(removed, added, 500) and len(got) == len(set(got)) > 2000
    assert all(df.count() < 400 for _, df in held)
