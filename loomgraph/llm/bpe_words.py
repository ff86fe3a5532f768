"""The word-end vocabulary (lower case, white space dropped): splitting, counting, identifiers."""

from __future__ import annotations

import functools
import heapq
import json
import re

#: The file's own split pattern, over letters of which Unicode versions and composition leave no doubt: ASCII, Latin-1 and Latin Extended-A.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
#: Finds a character beyond those.
PLAIN = re.compile(rf"[^\x00-\x7f{_LETTERS}‐-‧€¡«°»¿]")
_SPACES = " \\t\\n\\r\\x0b\\x0c"
_QUICK = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_SPACES}0-9{_LETTERS}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordVocabulary:
    """What a tokenizer file says: merge ranks, special strings, normalisation and splitting."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.raw = json.load(f)
        model = self.raw["model"]
        self.end = model["end_of_word_suffix"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.symbols = byte_symbols()
        self.special = {t["content"]: t["id"] for t in self.raw["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def parts(self, text: str):
        """(special string, None) or (None, pieces) in order: special strings are found in the raw text."""
        if not any(s in text for s in self.special):
            yield None, self.pieces(text)
            return
        for part in self.special_at.split(text):
            if part in self.special:
                yield part, None
            elif part:
                yield None, self.pieces(part)

    def pieces(self, text: str) -> list[str]:
        """The matches that are encoded one by one, of the normalised text.

        A text of plain characters, composed already, is split here; for any other the library
        normalises and splits, since its tables of characters may be of another Unicode version.
        """
        if PLAIN.search(text) is None:
            return _QUICK.findall(text.lower())
        library = self.splitter
        return [p for p, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))]

    @functools.cached_property
    def splitter(self):
        from tokenizers import Tokenizer

        split = [x for x in self.raw["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"]
        return Tokenizer.from_str(json.dumps(self.raw | {"pre_tokenizer": {"type": "Sequence", "pretokenizers": split}}))

    def count(self, piece: str) -> int:
        """Tokens of one piece, by a heap of adjacent pairs over a linked list of symbols.

        The pair of lowest rank (leftmost of equals) is popped again and again; a stale entry, one
        side of which has since been merged, is skipped. The count is symbols minus merges.
        """
        sym = [self.symbols[b] for b in piece.encode()]
        n = len(sym)
        if n < 2:
            return n
        sym[-1] += self.end
        ranks, after, before = self.ranks, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := ranks.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            r, i, j = heapq.heappop(heap)
            if sym[i] is None or after[i] != j or ranks.get((sym[i], sym[j])) != r:
                continue
            sym[i] += sym[j]
            sym[j] = None
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, (r, i, k))
            if (h := before[i]) >= 0 and (r := ranks.get((sym[h], sym[i]))) is not None:
                heapq.heappush(heap, (r, h, i))
        return n - merges

    def piece_encoder(self):
        """A function from a piece to its identifiers, by the model of the tokenizers library without its outer steps."""
        from tokenizers import Tokenizer

        tokenize = Tokenizer.from_str(json.dumps(self.raw)).model.tokenize
        symbols = {b: s for b, s in enumerate(self.symbols)}
        return lambda piece: [t.id for t in tokenize(piece.encode().decode("latin-1").translate(symbols))]
