"""Plain versions of the operators, and a small awkward corpus."""

import collections
import hashlib
import itertools
import random
import re

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, kept string, fp string"


def words(text):
    return WORD.findall((text or "").encode())


def corpus(seed=7, n=120):
    """Rows with nulls, empty and long texts, exact and near copies, shared passages, repeated and null ids."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["Straße", "naïve", "Éa", "日本", "x\u0085y", " z"]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage, long_text = say(50), say(3000)
    texts = [say(rng.choice([0, 1, 2, 3, 34, 35, 36, 60, 150])) for _ in range(n)]
    texts += [None, None, "", "   \n\t", long_text, long_text + " tail", "a b", "a", "A B"]
    for i in range(0, 40, 4):
        texts[i] = say(20) + "\n" + passage + " " + say(10)
    texts += [texts[5]] * 7 + [passage, passage + " " + passage, " ".join(["same"] * 120)]
    near = say(300).split()
    for _ in range(12):
        copy = near[:]
        copy[rng.randrange(300)] = rng.choice(vocab)
        texts.append(" ".join(copy))
    texts += ["line one here\nline one here\nother line\n\n" * 20, "#*$%&|<> " * 30]
    sources = ["hot"] * 60 + ["a", "b", None, "c"] * n
    rows = [(i, t, "en", s, len(t) if t else 0, "clash", "clash", "clash") for i, (t, s) in enumerate(zip(texts, sources))]
    rows += [rows[3], rows[3], (None, texts[8], None, None, None, None, None, None), (None, None, None, "hot", None, None, None, None)]
    return rows


def substring(texts, k=35):
    split = [words(t) for t in texts]
    seen = collections.Counter(tuple(w[i : i + k]) for w in split for i in range(len(w) - k + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def simhash(text):
    w = WORD.findall((text or "").encode().lower())
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(keys, linked):
    """The smallest index reachable from each, given a test of two keys."""
    parent = list(range(len(keys)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(keys)), 2):
        if linked(keys[i], keys[j]):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(keys))]


ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and characters in repeated n-grams by length."""
    w = words(text)
    text = text or ""
    lines = [x for x in text.split("\n") if words(x)]
    firsts, dups = set(), 0
    for x in lines:
        dups += x in firsts
        firsts.add(x)

    def marked(k):
        seen = collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        on = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                on.update(range(i, i + k))
        return on

    three = marked(3)
    chars = [len(x.decode()) for x in w]
    failed = len(w) < 50 or 100 * len(three) > 50 * len(w)
    cover = {k: sum(chars[i] for i in marked(k)) for k in (5, 8, 10)}
    return len(w), sum(chars), sum(c in "#*$%&|<>" for c in text), dups, len(three), failed, cover


def good(text):
    """The verdict of the rules: base, and the shares of characters in repeated n-grams and lines."""
    n, chars, _, _, _, failed, cover = rules(text)
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            again += sum(len(x.decode()) for x in words(line)) if line in seen else 0
            seen.add(line)
    limits = {5: 15, 8: 12, 10: 10}
    return not failed and all(100 * cover[k] <= pct * chars for k, pct in limits.items()) and 100 * again <= 20 * chars


def kept_words(texts, k=35):
    """The words of each text that no window covers which starts anywhere else."""
    split = [words(t) for t in texts]
    seen = collections.Counter(tuple(w[i : i + k]) for w in split for i in range(len(w) - k + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out
