import collections
import random
import re
import zlib

import pytest

from loomgraph.llm.spelling import Settings, spelling_variants, word_counts

from . import brute


def plain(texts, s=Settings()):
    """Rows of the operator for (id, text), each word's neighbours found by editing it in every way."""
    counts = collections.Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            if h % s.thin == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= s.min_length
    words = {w: n for w, n in counts.items() if n >= s.min_count}
    letters = {c for w in words for c in w}
    near, form = {}, {}
    for w in words:
        at = range(len(w) + 1)
        edits = {w[:k] + w[k + 1 :] for k in at} | {w[:k] + c + w[k + d :] for k in at for c in letters for d in (0, 1)}
        near[w] = [x for x in edits - {w} if x in words]
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= s.ratio * words[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def check(spark, texts, s=Settings()):
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in texts], "doc_id long, text string, word string, n int")
    got = [tuple(r) for r in spelling_variants(df, s).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain(texts, s)
    return got


def test_small_alphabet(spark):
    """Words of three letters have all kinds of neighbours, ties and chains of forms."""
    rng = random.Random(3)
    texts = [(i, " ".join("".join(rng.choice("aabÉé") for _ in range(rng.randint(4, 7))) for _ in range(rng.choice([0, 1, 300])))) for i in range(60)]
    texts += [(None, "aaaaa aaaaab " * 9), (None, None), (4, ""), texts[7], texts[7], (9, "Zebra×÷ÿ zebrA×÷ÿ, zebra×÷ÿ")]
    got = check(spark, texts, Settings(thin=3))
    assert max(r[4] for r in got) > 4 and any(r[2] not in (r[0], r[1]) for r in got)


def test_chain_of_forms_and_many_copies(spark):
    """A word with a third of all rows, and a chain whose root is many forms away."""
    chain = ["aaaaaaaa"] * 3 + ["aaaaaaab"] * 6 + ["aaaaaabb"] * 12 + ["aaaaabbb"] * 24 + ["aaaabbbb"] * 48 + ["aaabbbbb"] * 96 + ["aabbbbbb"] * 4000
    got = {r[0]: r for r in check(spark, [(None, " ".join(chain)), (None, "other words " * 2000)])}
    assert got["aaaaaaaa"][2] == "aabbbbbb" and got["aabbbbbb"][1] is None


def test_corpus_and_empty(spark):
    check(spark, [r[:2] for r in brute.corpus()])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_variants(empty).collect() == []
    assert word_counts(empty).columns == ["word", "n"]


@pytest.mark.parametrize("thin", [1, 2])
def test_thinned_below_the_shortest(spark, thin):
    check(spark, [(i, "abcde abcdef Abcdeé " * 5) for i in range(8)], Settings(thin=thin))
