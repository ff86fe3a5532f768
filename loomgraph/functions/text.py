"""Text functions: normal form, code tokens, safe patterns, route keys."""

from __future__ import annotations

import re
import unicodedata

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds of search patterns.
MAX_WILDCARDS, MIN_LITERALS = 4, 2
#: Runs of letters, digits and the marks on them, and where such a run is cut: between letters and digits, before a
#: capital after a small letter, before the last of several capitals if a small letter follows. Both as the JVM and
#: Python's ``regex`` read them.
RUN = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"
_M = r"\p{M}{0,9}"
CUT = "|".join(
    rf"(?<={before}{_M})(?={after})"
    for before, after in ((r"\p{L}", r"\p{N}"), (r"\p{N}", r"\p{L}"), (r"\p{Ll}", r"\p{Lu}"), (r"\p{Lu}", rf"\p{{Lu}}{_M}\p{{Ll}}"))
)


def fold(text: str) -> str:
    """Compatibility of spelling: decomposed, case-folded, composed."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).casefold())


def folded(column: Column | str) -> Column:
    """``fold`` by built-in functions: of composed text, as there is none that composes, and of ß alone among the letters that fold to several."""
    return F.replace(F.translate(F.lower(F.upper(column)), "ς", "σ"), F.lit("ß"), F.lit("ss"))


def code_tokens(text: str) -> list[str]:
    """The tokens of code in a text, folded; marks stay with their letter."""
    return [fold(t) for run in regex.findall(RUN, text) for t in regex.split(CUT, run, flags=regex.V1)]


def token_column(column: Column | str) -> Column:
    """``code_tokens`` by built-in functions."""
    runs = F.regexp_extract_all(column, F.lit(f"({RUN})"))
    return F.transform(F.flatten(F.transform(runs, lambda r: F.split(r, CUT))), folded)


class PatternRejected(ValueError):
    pass


def safe_pattern(text: str, glob: bool) -> str:
    """An anchored regular expression for a restricted pattern; raises PatternRejected.

    Regex: ``.`` and ``*`` are wildcards; glob: ``*`` and ``?``, and a dot is itself. No leading wildcard,
    no two stars in a row, at most four wildcards, two literals at least, also before the first wildcard.
    """
    wild = {"*": "s", "?": "o"} if glob else {"*": "s", ".": "o"}
    plain = "_-:/$." if glob else "_-:/$"
    shape = "".join(wild.get(c) or ("l" if c.isalnum() or c in plain else "x") for c in text)
    # In a regex the star repeats the letter before it, which may then be missing.
    sure = shape if glob else shape.replace("ls", "s")
    faults = {
        "leading_wildcard": shape[:1] in ("s", "o"),
        "unsupported_pattern": "x" in shape or "ss" in shape,
        "too_many_wildcards": len(shape) - shape.count("l") > MAX_WILDCARDS,
        "insufficient_literal": min(sure.count("l"), len(sure) - len(sure.lstrip("l"))) < MIN_LITERALS,
    }
    for fault, found in faults.items():
        if found:
            raise PatternRejected(fault)
    star = {"s": ".*" if glob else "*", "o": "."}
    return "^" + "".join(star.get(kind) or re.escape(c) for kind, c in zip(shape, text)) + "$"


def route_key(method: Column, path: Column) -> Column:
    """METHOD /path with empty segments dropped and {x} or :x segments as {}; null for what is no plain route."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    plain = F.transform(segments, lambda s: F.when(s.rlike(r"^(\{.+\}|:.+)$"), F.lit("{}")).otherwise(s))
    good = F.forall(plain, lambda s: (s == "{}") | (s.rlike("^[A-Za-z0-9._~%+@-]+$") & ~s.isin(".", "..")))
    ok = method.rlike("^[A-Za-z]{1,16}$") & path.startswith("/") & ~path.rlike(r"[?#\\\x00-\x1f\x7f]") & good
    return F.when(ok, F.concat(F.upper(method), F.lit(" /"), F.array_join(plain, "/")))
