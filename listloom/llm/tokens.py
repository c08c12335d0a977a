"""Token ids of whole texts by a public byte-level BPE, for tasks: the library encodes each distinct piece once.

Byte-level BPE never merges across the boundaries that its pattern makes, and a boundary lies before every run of white
space. So a text is cut before its spaces and around its line feeds, and the pieces' ids, from the library, are kept and
joined. A text with other white space at a cut is cut with a regular expression into pieces of white space and what
follows it; a text with control characters on which the engines' ideas of white space differ goes to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array


#: Distinct pieces kept by a worker, in two generations: bounds its memory (about 200 bytes each).
KEPT = 600_000
#: On these the engines differ about white space; on the others they agree.
_ODD = re.compile("[\x00\x1c-\x1f\x85\u180e\u200b\ufeff]")
_SPACES = re.compile("[\t\x0b\x0c\r\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x00\x1c-\x1f\x85\u180e\u200b\ufeff]")
#: Punctuation without the apostrophe, which the pattern treats apart.
_TAIL = ",.!?;:|%*$&#)"
_PIECES = re.compile(r"\s*\S+|\s+")
_loaded: dict[str, Encoder] = {}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # such strings in a text are ordinary text
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids as unsigned 32-bit integers, little-endian on the platforms Spark runs on."""
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _know(self, pieces: set[str]) -> None:
        """Makes ``new`` hold every piece. Keys with a leading NUL stand for themselves, others for a space and themselves."""
        if len(self.new) > KEPT // 2:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        missing, tailed, cores = [], [], set()
        for p in pieces:
            if p not in new:
                if p in old:
                    new[p] = old[p]
                    continue
                # letters and then punctuation are two pieces to the pattern, so the letters' ids serve all such words
                core = p.rstrip(_TAIL)
                if len(core) < len(p) and core.lstrip("\0").isalpha():
                    tailed.append((p, core, "\0" + p[len(core) :]))
                    cores.update(tailed[-1][1:])
                else:
                    missing.append(p)
        if cores:
            for p in cores - pieces:
                if p in old and p not in new:
                    new[p] = old[p]
                elif p not in new:
                    missing.append(p)
        if missing:
            new.update(zip(missing, self.whole([p[1:] if p[:1] == "\0" else " " + p for p in missing]), strict=True))
        for p, core, tail in tailed:
            if tail not in new:  # it is among the pieces itself, with punctuation only
                new[tail] = self.whole([tail[1:]])[0]
            new[p] = new[core] + new[tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut: list = []
        pieces: set[str] = set()
        plain = []  # texts that go to the library whole
        for i, text in enumerate(texts):
            parts = None
            odd = _SPACES.search(text)
            if odd and _ODD.search(text):
                plain.append(i)
            else:
                parts = ["\0" + p for p in _PIECES.findall(text)] if odd else self._cut(text)
                pieces.update(parts)
            cut.append(parts)
        self._know(pieces)
        get = self.new.__getitem__
        out = [b"" if p is None else b"".join(map(get, p)) for p in cut]
        for i, ids in zip(plain, self.whole([texts[i] for i in plain]), strict=True):
            out[i] = ids
        return out

    @staticmethod
    def _cut(text: str) -> list[str]:
        if not text:
            return []
        parts: list[str] = []
        for k, line in enumerate(text.split("\n")):
            words = line.split(" ")
            # a cut is safe between characters that aren't white space: no space or line feed beside another
            if not all(words):
                return ["\0" + p for p in _PIECES.findall(text)]
            if k:
                parts.append("\0\n")
            words[0] = "\0" + words[0]
            parts += words
        return parts


def encoder(path: str) -> Encoder:
    """The worker's encoder, kept from task to task."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
