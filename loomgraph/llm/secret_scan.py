"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

The battery says how random a token looks; what is reported is controlled against natural tokens. For
every candidate of the corpus a few decoys of its encoding and length are made of words of its own
text (identifiers, paths, numbers). They are the null hypothesis: the share of decoys that look as
random as a candidate is its p-value, and Benjamini and Hochberg's rule over the candidates of a
stratum bounds the share of natural tokens among those reported.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass
from operator import mul, ne

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, map_batches, materialize, raw_texts

#: The fixed kinds, in the order that breaks ties, and the kind that the battery adds.
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A token may follow "=" (NAME=value, ?name=value); "=" after it is padding, unless more text follows: then it is a name.
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{20,}={0,2})=*(?![A-Za-z0-9+/_=-])")
#: Words that decoys are made of; random tokens hold few such runs.
_WORD = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{4,}")

#: Encodings from narrow to wide: name, alphabet in index order.
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = (
    ("hex", _DIGITS + "abcdef"),
    ("HEX", _DIGITS + "ABCDEF"),
    ("base32", _UPPER + "234567"),
    ("base62", _UPPER + _LOWER + _DIGITS),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_"),
)
_INDEX = [{c: i for i, c in enumerate(alphabet)} for _, alphabet in ENCODINGS]
#: Length classes end before these; with the encoding they make the stratum, so that short tokens, on which the
#: tests have little power, are not judged by the threshold that long ones allow.
LENGTHS = (24, 32, 48, 80)
#: Resolution of the corpus histogram: bins a decade of p, and decades.
BINS, DECADES = 20, 20
#: Decoys for each candidate, and those that every stratum has besides.
DECOYS, FIXED_DECOYS = 4, 200
#: Words for decoys where a text has too few of its own.
WORDS = (
    "account action address archive buffer button cache channel client command config content context count "
    "create current customer default delete detail device domain element entry error event export filter folder "
    "format frame handler header identifier image import index input instance internal language layout length "
    "library list local manager message method model module name network number object option order output "
    "package page parameter parent path pattern payment process product profile project property provider query "
    "record reference region remote report request resource response result return scheme search section select "
    "service session setting source state status stream string system table target template test thread time "
    "title transfer type update upload user value version view window worker"
).split()


@dataclass(frozen=True)
class ScanRules:
    """``false_discovery_rate``: the largest expected share of natural tokens among those reported."""

    false_discovery_rate: float = 0.1
    #: No token is taken for random below this, however few natural tokens look like it.
    least_p: float = 1e-3


def _stratum(encoding: int, length: int) -> int:
    return encoding * (len(LENGTHS) + 1) + bisect.bisect_right(LENGTHS, length)


def _bin(p: float) -> int:
    return min(BINS * DECADES, int(-math.log10(max(p, 1e-300)) * BINS))


def battery(token: str) -> tuple[int, float] | None:
    """(encoding index, combined p-value of a random token's looking so little random), None if no encoding fits.

    Tests: chi-squared uniformity over the whole alphabet (its tail by Wilson and Hilferty); runs
    above and below the alphabet's middle (Wald and Wolfowitz); lag-1 serial correlation of alphabet
    indices. Combined by Fisher's method.
    """
    body = token.rstrip("=")
    chars = set(body)
    for e, index in enumerate(_INDEX):
        if chars <= index.keys():
            break
    else:
        return None
    n, a = len(body), len(index)
    chi = a / n * sum(k * k for k in Counter(body).values()) - n
    df = a - 1
    z = ((max(chi, 0.0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    p1 = 0.5 * math.erfc(z / math.sqrt(2))
    x = [index[c] for c in body]
    high = [2 * v >= a for v in x]
    up = sum(high)
    down = n - up
    if up and down:
        runs = 1 + sum(map(ne, high[1:], high))
        mean = 1 + 2 * up * down / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p2 = math.erfc(abs(runs - mean) / math.sqrt(2 * var)) if var > 0 else 1.0
    else:
        p2 = 2.0 ** (1 - n)
    middle = sum(x) / n
    c = [v - middle for v in x]
    power = sum(map(mul, c, c))
    p3 = math.erfc(abs(sum(map(mul, c[1:], c)) / power) * math.sqrt(n / 2)) if power else 2.0 ** (1 - n)
    half = -sum(math.log(max(p, 1e-300)) for p in (p1, p2, p3))
    return e, min(1.0, math.exp(-half) * (1 + half + half * half / 2))


def decoy(words: list[str], encoding: int, token: str, rng: random.Random) -> str:
    """A natural token of the length of ``token``, with its case, its separators and its digits, made of words.

    Of hexadecimal tokens the natural kind is the decimal number.
    """
    length = len(token)
    if encoding < 2:
        return str(rng.randrange(1, 10)) + "".join(rng.choices(_DIGITS, k=length - 1))
    case = str.upper if token.upper() == token else str.lower if token.lower() == token else str.capitalize
    marks = [c for c in token if not c.isalnum()]
    digits = [c for c in token if c in _DIGITS]
    rng.shuffle(digits)
    room, parts = length - len(marks) - len(digits), []
    while room > 0:  # no word twice before all have been used, as repeats look less random
        for word in rng.sample(words, min(len(words), 1 + room // 3)):
            if room > 0:
                parts.append(case(word)[:room])
                room -= len(parts[-1])
    # Digits stand together after one word; separators between words, those left over at the end.
    parts = parts or [""]
    parts[rng.randrange(len(parts)) if rng.random() < 0.5 else -1] += "".join(digits)
    ends = sorted(rng.sample(range(len(parts) - 1), min(len(marks), len(parts) - 1)))
    for k, c in zip(ends, marks):
        parts[k] += c
    return "".join(parts) + "".join(marks[len(ends) :])


#: What the fixed decoys are modelled on, by encoding: case, separators and digits as identifiers have them.
SHAPES = (("0",), ("0",), ("A", "A2"), ("Aa", "a0", "Aa0", "a"), ("a/", "Aa/", "a/0"), ("a_", "a-", "A_", "a_0", "A_0"))


@functools.cache
def fixed_decoys() -> list[tuple[int, int, int]]:
    """(stratum, bin, count) of the decoys that every corpus has, from ``WORDS``."""
    rng, seen = random.Random(42), Counter()
    for encoding, shapes in enumerate(SHAPES):
        for low, high in zip((20, *LENGTHS), (*LENGTHS, 120)):
            for k in range(FIXED_DECOYS):
                shape, length = shapes[k % len(shapes)], rng.randrange(low, high)
                mark = "".join(c for c in shape if not c.isalnum()) * rng.randrange(1, 4)
                digits = "".join(rng.choices("234567", k=rng.randrange(1, 5))) if shape[-1] in "02" else ""
                letters = "".join(c for c in shape if c.isalpha())
                model = (letters * length)[: length - len(mark) - len(digits)] + mark + digits
                found = battery(decoy(WORDS, encoding, model, rng))
                seen[_stratum(encoding, length), _bin(found[1])] += 1
    return [(*k, n) for k, n in seen.items()]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping for each kind."""
    spans = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    # A failing run holds no passing one, so these two patterns state the least length themselves.
    spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def _free(taken: list[tuple[int, int, int]]):
    """A test of (start, end) for meeting none of the spans ``taken``, which are sorted; a search, not a scan, for each."""
    starts, reach = [s for s, _, _ in taken], []
    for _, _, e in taken:
        reach.append(max(e, reach[-1]) if reach else e)

    def free(start: int, end: int) -> bool:
        before = bisect.bisect_left(starts, end)
        return not before or reach[before - 1] <= start

    return free


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, stratum, bin) of long tokens free of ``taken`` spans; bin: of -log10 p, finely."""
    free, out = _free(taken), []
    for m in _TOKEN.finditer(text):
        start, end = m.span(1)
        if free(start, end) and (found := battery(m[1])):
            out.append((start, end, _stratum(found[0], len(m[1].rstrip("="))), _bin(found[1])))
    return out


def decoys(text: str, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """(stratum, bin) of ``DECOYS`` natural tokens for each candidate, of words of the whole text; the same for the same text."""
    if not found:
        return []
    words = sorted(set(_WORD.findall(text)))
    if len(words) < 2:
        words = WORDS
    rng, out = random.Random(zlib.crc32(text.encode())), []
    for start, end, stratum, _ in found:
        encoding, token = stratum // (len(LENGTHS) + 1), text[start:end].rstrip("=")
        for _ in range(DECOYS):
            out.append((stratum, _bin(battery(decoy(words, encoding, token, rng))[1])))
    return out


def cutoffs(found: list[tuple[int, int, int]], natural: list[tuple[int, int, int]], rules: ScanRules) -> dict[int, int]:
    """For each stratum the largest bin that is reported, -1 for none; both are histograms (stratum, bin, count).

    A candidate's p-value is the share of natural tokens of its stratum, one more counted, that look at least as random. By Benjamini and Hochberg the reported bins are the
    largest set whose p-value times the candidates does not exceed the rate times those reported.
    """
    own, background, out = defaultdict(Counter), defaultdict(Counter), {}
    for stratum, b, n in found:
        own[stratum][b] += n
    for stratum, b, n in [*natural, *fixed_decoys()]:
        background[stratum][b] += n
    floor = _bin(rules.least_p)
    for stratum, counts in own.items():
        null = background[stratum]
        total, size, reported, alike = sum(counts.values()), sum(null.values()), 0, 0
        out[stratum] = -1
        for b in range(floor + 1):  # from the most random
            reported += counts[b]
            alike += null[b]
            if reported and (alike + 1) / (size + 1) * total <= rules.false_discovery_rate * reported:
                out[stratum] = b
    return out


def _scanned(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with each row's base spans, candidates and decoys, written once."""
    own = [c for c in keep if c != text_col]
    rows = df.select(text_col, *own)
    names = [*([text_col] if text_col in keep else []), *own]
    first = 0 if text_col in keep else 1
    nested = pa.list_(pa.list_(pa.int32()))

    def make():
        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            base, more, natural = [], [], []
            for raw in raw_texts(batch.column(0)):
                text = (raw or b"").decode()
                base.append(base_spans(text))
                more.append(candidates(text, base[-1]))
                natural.append(decoys(text, more[-1]))
            cols = [pa.array(c, nested) for c in (base, more, natural)]
            return pa.RecordBatch.from_arrays([*batch.columns[first:], *cols], [*names, "__ss_base", "__ss_more", "__ss_null"])

        return kernel

    schema = f"{ddl(rows.select(*names))}, `__ss_base` array<array<int>>, `__ss_more` array<array<int>>, `__ss_null` array<array<int>>"
    return materialize(map_batches(rows, make, schema), "secrets")


def _cutoffs_of(scanned: DataFrame, rules: ScanRules) -> dict[int, int]:
    """From histograms over all candidates and decoys: their cells are bounded by strata and bins, whatever the corpus."""
    both = F.concat(
        F.transform("__ss_more", lambda c: F.struct(F.lit(True).alias("own"), c[2].alias("s"), c[3].alias("b"))),
        F.transform("__ss_null", lambda c: F.struct(F.lit(False).alias("own"), c[0].alias("s"), c[1].alias("b"))),
    )
    each = scanned.where(F.size("__ss_more") > 0).select(F.explode(both).alias("c")).select("c.*")
    rows = each.groupBy("own", "s", "b").agg(F.count(F.lit(1)).alias("n")).collect()
    return cutoffs([(r.s, r.b, r.n) for r in rows if r.own], [(r.s, r.b, r.n) for r in rows if not r.own], rules)


def _all_spans(base, more, cuts: dict[int, int]):
    return sorted([tuple(s) for s in base] + [(s, 3, e) for s, e, stratum, b in more if b <= cuts[stratum]])


def find_secrets(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: ScanRules = ScanRules()
) -> DataFrame:
    """One row per document: n_assign, n_access, n_hex, base_sha256, n_random, spans, found.

    ``spans`` joins kind:start:end (code points, end exclusive) by start, then kind; ``found`` has
    them as structs. Texts are read once; only spans are written and read again.

    Null or empty text: no spans; base_sha256 is that of the empty string. Very long texts are searched
    whole, in time in proportion to them. Repeated rows: a row each, each a candidate of its own. Null
    ids stay null. Empty table: no rows. Other input columns are not read.
    """
    scanned = _scanned(df, text_col, [id_col])
    cuts = _cutoffs_of(scanned, rules)
    id_type = df.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def make():
        def line(spans):
            return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols = [[], [], [], [], [], [], []]
            for base, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                every = _all_spans(base, more, cuts)
                kinds = [k for _, k, _ in every]
                row = [kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(line(base).encode()).hexdigest()]
                row += [kinds.count(3), line(every), [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in every]]
                for c, v in zip(cols, row):
                    c.append(v)
            types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.string(), span]
            names = [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "n_random", "spans", "found"]
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names)

        return kernel

    schema = (
        f"{id_col} {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, n_random long, "
        "spans string, found array<struct<kind:string,start:int,end:int>>"
    )
    return map_batches(scanned, make, schema)


def redact_secrets(
    df: DataFrame, text_col: str = "text", mark: str = "[secret]", rules: ScanRules = ScanRules()
) -> DataFrame:
    """``df`` with every span of ``find_secrets`` replaced by ``mark``; overlapping spans share one.

    Other columns, rows and texts without a span stay as they are; null text stays null. Very long
    texts are masked whole. Repeated rows: alike. Empty table: no rows. Input columns may have any names.
    """
    scanned = _scanned(df, text_col, df.columns)
    cuts = _cutoffs_of(scanned, rules)
    scanned = scanned.select(*df.columns, "__ss_base", "__ss_more")
    names = df.columns
    at, n = names.index(text_col), len(names)

    def make():
        def redact(raw: bytes | None, spans):
            if raw is None or not spans:
                return raw
            text, out, end = raw.decode(), [], 0
            for s, _, e in spans:
                if s >= end:
                    out += [text[end:s], mark]
                end = max(end, e)
            return ("".join(out) + text[end:]).encode()

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            spans = [_all_spans(b, m, cuts) for b, m in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist())]
            cols = list(batch.columns[:n])
            if any(spans):
                texts = [redact(raw, s) for raw, s in zip(raw_texts(cols[at]), spans)]
                cols[at] = pa.array(texts, pa.binary()).cast(cols[at].type)
            return pa.RecordBatch.from_arrays(cols, names)

        return kernel

    return map_batches(scanned, make, ddl(df))
