"""Token ids of whole texts by a public byte-level BPE, with the library's results remembered by word.

The pre-tokenizer never lets a token cross a single space between two other characters, so a text whose white space is single spaces
and single line feeds is encoded piece by piece, each with the space or line feed before it, and pieces that came before
are looked up. All other texts (runs of white space, other kinds of it, white space at the ends, control characters, the content of an added
token such as the end of text) go to the library whole. Both give its ids.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Pieces remembered by a worker; later ones are encoded each time, so memory is bounded.
REMEMBERED = 600_000
#: Longer pieces are not remembered.
LONGEST = 64
#: Runs of white space, white space at the ends, white space other than space and line feed, and control characters: a text with any of these is encoded whole.
_ODD = r"[\x00-\x09\x0b-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z"
#: Pieces given to the library at once, and bytes of text looked at together.
_AT_ONCE, _BYTES = 20_000, 4 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder(dict):
    """piece -> its ids as little-endian unsigned 16-bit integers. A piece is what follows a space, or begins with a line feed, or, after NUL, begins the text."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        super().__init__()
        self.remembered = remembered
        self.library = Tokenizer.from_file(path)
        self.whole = "|".join([_ODD, *(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values())])
        self.first_free = 1 + max(self.library.get_vocab(with_added_tokens=True).values())
        self.signs = {x: np.asarray(self.library.encode(x, add_special_tokens=False).ids, dtype="<u2").tobytes() for x in ".,"}
        if self.first_free > 1 << 16:
            raise ValueError("ids of more than 16 bits")

    def _encoded(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces, by one call of the library."""
        got = self.library.encode([p if p[0] == "\n" else p[1:] if p[0] == "\x00" else " " + p for p in pieces], is_pretokenized=True, add_special_tokens=False)
        raw = np.asarray(got.ids, dtype="<u2").tobytes()
        ends = (2 * np.searchsorted(np.asarray(got.word_ids), np.arange(len(pieces)), side="right")).tolist()
        return {p: raw[x:y] for p, x, y in zip(pieces, [0, *ends], ends, strict=False)}

    def _learned(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of pieces not remembered; they are from now on, as long as there is room."""
        base = {p: p[:-1] if p[-1] in self.signs and p[-2:-1].isalpha() else p for p in pieces}  # no token holds a letter and the sign after it
        fresh = self._encoded(list({b for b in base.values() if b not in self}))
        known = {p: (fresh[b] if b in fresh else self[b]) + (self.signs[p[-1]] if b is not p else b"") for p, b in base.items()}
        if len(self) < self.remembered:
            self.update((p, v) for p, v in (fresh | known).items() if len(p) <= LONGEST)
        return known

    def ids(self, text: str | None) -> np.ndarray:
        """One text's ids."""
        return self.batch(pa.array([text], pa.string()))[0]

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """Each text's ids, without special tokens; a null text is empty. Pieces are told apart in Arrow, and each distinct one is looked up once."""
        out: list[np.ndarray] = []
        texts = texts.fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _BYTES, side="right")))
            out += self._some(texts.slice(at, stop - at))
            at = stop
        return out

    def _some(self, texts: pa.Array) -> list[np.ndarray]:
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        filled = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.zeros(0, dtype="<u2")] * len(texts)
        for i in np.flatnonzero(whole).tolist():
            out[i] = np.asarray(self.library.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype="<u2")
        plain = np.flatnonzero(filled & ~whole)
        if len(plain):
            marked = pc.binary_join_element_wise("\x00", pc.replace_substring(texts.take(pa.array(plain)), "\n", " \n"), "")
            lists = pc.split_pattern(marked, " ")
            pieces = lists.flatten().dictionary_encode()
            distinct = pieces.dictionary.to_pylist()
            found = list(map(self.get, distinct))
            missing = [i for i, v in enumerate(found) if v is None]
            for at in range(0, len(missing), _AT_ONCE):
                some = missing[at : at + _AT_ONCE]
                new = self._learned({distinct[i] for i in some})
                for i in some:
                    found[i] = new[distinct[i]]
            length = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 2
            start = np.cumsum(length) - length
            code = pieces.indices.to_numpy()
            n = length[code]
            ends = np.cumsum(n)
            flat = np.frombuffer(b"".join(found), dtype="<u2")[np.repeat(start[code] - ends + n, n) + np.arange(int(ends[-1]))]
            cuts = ends[lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py() - 1].tolist()
            for i, x, y in zip(plain.tolist(), [0, *cuts], cuts, strict=False):
                out[i] = flat[x:y]
        return out


@lru_cache(maxsize=2)
def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """One encoder a worker process."""
    return Encoder(path, remembered)
