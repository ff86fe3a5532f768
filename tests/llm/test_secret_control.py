import hashlib
import os
import random
import string
import time
from collections import Counter

import pytest

from loomgraph.llm.secret_scan import KINDS, ScanRules, base_spans, battery, candidates, cutoffs, decoys, find_secrets

from . import brute

WORDS = (
    "alpha river stone kingdom retrieve purchase customer invoice mountain bright yellow network packet garden silver orange "
    "thread worker parse token stream buffer shuffle planet method update remove insert select where group having limit offset vector matrix"
).split()


def mixture(random_tokens, natural, seed):
    """(tokens, whether random): tokens of 20 to 40 characters among identifiers and paths."""
    rng = random.Random(seed)
    alphabet = string.ascii_letters + string.digits + "+/"
    keys = ["".join(rng.choice(alphabet) for _ in range(rng.randint(20, 40))) for _ in range(random_tokens)]
    names = []
    while len(names) < natural:
        w = [rng.choice(WORDS) for _ in range(rng.randint(3, 6))]
        forms = ("_".join(w), "-".join(w), w[0] + "".join(x.title() for x in w[1:]), "/".join(w), "_".join(w).upper(), "_".join(w) + str(rng.randint(1, 9999)))
        name = rng.choice(forms)
        if 20 <= len(name) <= 40:
            names.append(name)
    return [(k, True) for k in keys] + [(n, False) for n in names]


def reported(tokens):
    own, null, found = Counter(), Counter(), []
    for token, is_random in tokens:
        text = f"x {token} y"
        c = candidates(text, [])
        found.append((is_random, c))
        own.update((s, b) for _, _, s, b in c)
        null.update(decoys(text, c))
    cut = cutoffs([(*k, n) for k, n in own.items()], [(*k, n) for k, n in null.items()], ScanRules())
    hit = [r for r, c in found if any(b <= cut[s] for _, _, s, b in c)]
    return sum(hit), len(hit) - sum(hit)


@pytest.mark.parametrize(("keys", "least"), [(0, 0), (20, 0), (100, 40), (500, 300)])
def test_few_reported_spans_are_natural(keys, least):
    """The share of natural tokens among those reported stays below the rate, also where secrets are rare."""
    true = false = 0
    for seed in range(3):
        t, f = reported(mixture(keys, 1500, seed))
        assert t >= least
        true, false = true + t, false + f
    assert false <= max(3, 0.1 * (true + false))


def test_battery_uses_the_whole_alphabet():
    # Evenly spread over four quarters of the alphabet, but made of four letters only.
    assert battery("AQgwAgQwwAQgQwAggAwQAwgQ")[1] < 1e-3
    rng = random.Random(1)
    p = sorted(battery("".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40)))[1] for _ in range(1000))
    assert 0.3 < p[500] < 0.7 and p[50] > 0.005


def test_padding_and_names(spark):
    key = "aB3xQ9zR7kLm2Vt8Yw4NpS6dH1jU0cEf"
    for text in (f"k {key}===", f"k {key}==== x", f"a={key}", f"{key}"):
        (start, end, *_), = candidates(text, [])
        assert text[start:end].rstrip("=") == key and end - start <= len(key) + 2
    assert candidates(f"{key}=value", []) == [] and candidates(f"{key}===v", []) == []


def test_time_in_proportion():
    text = " ".join(f"password=abcdefgh{i}" for i in range(20_000)) + " " + " ".join(f"Qz{i}xY9wK{i * 7}mNb{i * 13}vCx" + "T" * 8 for i in range(20_000))
    began = time.time()
    spans = base_spans(text)
    assert len(candidates(text, spans)) == 20_000 and len(spans) == 20_000
    assert time.time() - began < 10


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_base_and_added_spans_on_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    own, null, more = Counter(), Counter(), {}
    for i, t in texts.items():
        more[i] = candidates(t or "", brute.base_spans(t))
        own.update((s, b) for _, _, s, b in more[i])
        null.update(decoys(t or "", more[i]))
    cut = cutoffs([(*k, n) for k, n in own.items()], [(*k, n) for k, n in null.items()], ScanRules())
    for r in find_secrets(docs).collect():
        base = brute.base_spans(texts[r["doc_id"]])
        line = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        added = [(s, 3, e) for s, e, stratum, b in more[r["doc_id"]] if b <= cut[stratum]]
        assert r["spans"] == ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(base + added))
