"""Whole-text tokenization with public vocabularies in the `tokenizers` file format.

Both encoders read the JSON file of the vocabulary and give the ids that the
`tokenizers` library gives for the whole text (without added tokens; strings
of special tokens are ordinary text). They run its merges on a faster BPE core
with ids as merge ranks, after checking that ids follow the merge order; texts
that this path does not cover go to the `tokenizers` library itself. Ids are
little-endian unsigned 32-bit integers in bytes.
"""

from __future__ import annotations

import json
import os
import re
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

_loaded: dict[tuple, object] = {}


def byte_signs() -> dict[str, int]:
    """Signs of the byte-level alphabet: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        self.path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.ids, pairs = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [self.ids["".join(pair)] for pair in pairs]
        self.ordered = all(a < b for a, b in zip(made, made[1:])) and (not made or made[0] >= len(self.ids) - len(made))

    @property
    def library(self):
        """The `tokenizers` library's own encoder, loaded when a text first needs it."""
        if self._library is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.encode_special_tokens = True
        return self._library

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class ByteLevelEncoder(Vocabulary):
    """Byte-level BPE with the pattern of the first byte-level vocabularies."""

    #: Fixed pattern of the vocabulary.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        super().__init__(path)
        import tiktoken

        if not self.ordered:
            raise ValueError(f"{path}: ids do not follow the order of merges")
        signs = byte_signs()
        ranks = {bytes(signs[c] for c in token): at for token, at in self.ids.items()}
        self.core = tiktoken.Encoding("byte-level", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [self._one(t) if t else b"" for t in texts]

    def _one(self, text: str) -> bytes:
        try:
            return bytes(self.core._core_bpe.encode_to_tiktoken_buffer(text, set()))
        except ValueError:  # its pattern gives up on runs of about a million white spaces
            return self.whole(text)


class WordEndEncoder(Vocabulary):
    """BPE over lower-cased words whose last sign carries an end mark; white space is dropped.

    Words are found by the vocabulary's pattern, in the bytes of all texts at hand
    at once; the distinct ones are joined with an end mark and a space after each,
    and one call encodes them. The mark is a private sign, whose bytes merge before
    all others. Texts with signs beyond PLAIN are cut at spaces, which no token
    crosses, and only the pieces with such signs go to the library.
    """

    END = "\uf8ff"
    #: Of the vocabulary's fixed pattern, 's|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+: kinds of signs, and endings.
    SPACE, LETTER, NUMBER, OTHER = range(4)
    KINDS = regex.compile(r"(\s)|(\p{L})|(\p{N})|([^\s\p{L}\p{N}])")
    ENDINGS = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")
    #: Signs for which composing and lower-casing act on each alone.
    PLAIN = re.compile("[\n\x20-\x7e\xa1-ɏ]*")

    def __init__(self, path: str):
        super().__init__(path)
        import tiktoken

        if not self.ordered:
            raise ValueError(f"{path}: ids do not follow the order of merges")
        mark = self.END.encode()
        self.shift = len(mark) - 1  # ranks of the mark's own merges
        signs, ranks = byte_signs(), {mark[: n + 2]: n for n in range(self.shift)}
        for token, at in self.ids.items():
            body, end = (token[:-4], mark) if token.endswith("</w>") else (token, b"")
            raw = bytes(signs[c] for c in body)
            if mark[:1] not in raw or len(raw) == 1:
                ranks[raw + end] = at + self.shift
        self.core = tiktoken.Encoding("word-end", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        self.closes = np.zeros(max(self.ids.values()) + 1, bool)
        self.closes[[at for token, at in self.ids.items() if token.endswith("</w>")]] = True
        lowered = {c for at in range(0x250) if self.PLAIN.fullmatch(chr(at)) for c in chr(at).lower()}
        self.kinds = np.zeros(ord(max(lowered)) + 1, np.uint8)
        for c in lowered:
            self.kinds[ord(c)] = self.KINDS.fullmatch(c).lastindex - 1
        self.kinds_of_bytes = self.kinds[:128].tobytes() + bytes(128)

    def _begins(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Kind of the sign of every byte, and whether a word or white space begins there; two line feeds end the data."""
        kind = np.frombuffer(bytearray(data.tobytes().translate(self.kinds_of_bytes)), np.uint8)
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):  # signs of two bytes, or of three
            a, b, c = (data[lead + k].astype(np.int32) for k in range(3))
            three = a >= 0xE0
            own = self.kinds[np.where(three, (a & 15) << 12 | (b & 63) << 6 | c & 63, (a & 31) << 6 | b & 63)]
            kind[lead], kind[lead + 1] = own, own
            kind[lead[three] + 2] = own[three]
        begins = (kind == self.NUMBER) & ((data & 0xC0) != 0x80)
        begins[0] = True
        begins[1:] |= kind[1:] != kind[:-1]
        quote = np.flatnonzero((data == ord("'")) & begins)  # elsewhere it goes on with the signs before
        for ending in self.ENDINGS:
            at = quote
            for k, sign in enumerate(ending, 1):
                at = at[data[at + k] == sign]
            begins[at + 1] = False
            begins[at + 1 + len(ending)] = True
        return kind, begins

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of each text of plain signs."""
        lowered = [t.lower().encode() for t in texts]
        data = np.frombuffer(b"\n".join([*lowered, b"", b""]), np.uint8)
        kind, begins = self._begins(data)
        at = np.flatnonzero(begins)
        sizes, is_word = np.diff(at, append=len(data)), kind[at] != self.SPACE
        edges = np.searchsorted(at[is_word], np.cumsum([0, *(len(r) + 1 for r in lowered)]))
        upto = np.concatenate([[0], np.cumsum(sizes[is_word])])
        words = [None, pa.py_buffer(upto), pa.py_buffer(data[kind != self.SPACE])]
        found = pa.Array.from_buffers(pa.large_binary(), len(upto) - 1, words).dictionary_encode()
        if not len(found):
            return [b""] * len(texts)
        distinct = pa.ListArray.from_arrays([0, len(found.dictionary)], found.dictionary.cast(pa.large_string()))
        marked = pc.binary_join(distinct, pa.scalar(f"{self.END} ", pa.large_string()))[0].as_py() + self.END
        ids = np.frombuffer(self.core._core_bpe.encode_to_tiktoken_buffer(marked, set()), "<u4") - np.uint32(self.shift)
        closes = np.flatnonzero(self.closes[ids]) + 1
        begins = np.concatenate([[0], closes[:-1]])
        at = found.indices.to_numpy()
        sizes = (closes - begins)[at]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        raw = ids[np.repeat(begins[at] - upto[:-1], sizes) + np.arange(upto[-1])].astype("<u4", copy=False).tobytes()
        cuts = (4 * upto[edges]).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def _mixed(self, text: str) -> bytes:
        pieces, out = text.split(" "), []
        for at in range(0, len(pieces), 10000):
            found = groupby(pieces[at : at + 10000], key=lambda piece: bool(self.PLAIN.fullmatch(piece)))
            runs = [(plain, " ".join(run)) for plain, run in found]
            done = iter(self._plain([run for plain, run in runs if plain]))
            out.append(b"".join(next(done) if plain else self.whole(run) for plain, run in runs))
        return b"".join(out)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        plain = [not t or bool(self.PLAIN.fullmatch(t)) for t in texts]
        done = iter(self._plain([t or "" for t, p in zip(texts, plain, strict=True) if p]))
        return [next(done) if p else self._mixed(t) for t, p in zip(texts, plain, strict=True)]


def encoder(kind: type, path: str):
    """The worker's own encoder for a file; loaded once in each Python process."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]
