"""Exact SentencePiece BPE encoding by backtracking, and decoding.

A text becomes signs as the model's normalizer makes them: a space before it,
and every space written as U+2581. No piece has that sign after another one, so
the text is cut before each run of it, and every distinct part is encoded once.

Neighbouring signs that stand together in no piece are never merged, so a new
part is cut there as well, and its own parts are looked up first.

A part is encoded left to right with the longest piece that an Aho-Corasick
automaton finds at each position. A piece may follow another only if merging
their joined signs anew gives the same two pieces; such answers are kept. Where
no piece fits, the position is marked in a bitfield of failed positions and the
piece before it is replaced by its next shorter prefix. A sequence whose
neighbours are all compatible is the one that merging gives, so the ids are the
library's. Signs that no piece covers become byte pieces.

Only normal pieces that merging their own signs can produce are in the
automaton; models with user-defined or unused pieces, or with a normalizer that
changes more than spaces, are refused.

Defined results: a null or empty text has no ids and decodes to the empty text.
Rows are kept one for one; only the columns asked for are read.
"""

from __future__ import annotations

import re
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch, slices

SPACE = "▁"
#: Parts of texts (twice: the latest and the ones before) and pairs of pieces that a worker keeps.
MAX_PARTS, MAX_PAIRS = 400_000, 2_000_000

_PART = re.compile(f"{SPACE}+[^{SPACE}]*")
_loaded: dict[str, "PieceModel"] = {}


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, kinds = proto.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        if (
            proto.trainer_spec.model_type != 2
            or norm.precompiled_charsmap
            or norm.remove_extra_whitespaces
            or not norm.add_dummy_prefix
            or proto.trainer_spec.treat_whitespace_as_suffix
            or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces)
        ):
            raise ValueError(f"{path}: only BPE models with plain spaces and normal pieces are covered")
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == kinds.NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError(f"{path}: a piece has a space after another sign")
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.text = [p.piece.replace(SPACE, " ").encode() for p in proto.pieces]
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.CONTROL:
                self.text[i] = b""
        for value, i in self.bytes.items():
            self.text[i] = bytes([value])
        self.text[self.unknown] = proto.trainer_spec.unk_surface.encode()
        self.byte_ids = frozenset(self.bytes.values())
        self.special = frozenset(i for i, p in enumerate(proto.pieces) if p.type in (kinds.CONTROL, kinds.UNKNOWN))

        self.whole = {piece for piece in self.ids if self.merged(piece) == [piece]}
        self.automaton = ahocorasick.Automaton()
        for piece in self.whole:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}

    def merged(self, signs: str) -> list[str]:
        """Plain merging: the best-scored, then leftmost, pair whose join is a piece, until none is left."""
        parts, scores = list(signs), self.scores
        while len(parts) > 1:
            best = max(
                ((scores[j], -i) for i, j in enumerate(map(str.__add__, parts, parts[1:])) if j in scores), default=None
            )
            if best is None:
                break
            at = -best[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return known

    def split(self, signs: str) -> list[str]:
        """The pieces of a part, by backtracking over the matches at each position."""
        size, whole = len(signs), self.whole
        if signs in whole:
            return [signs]
        longest = list(range(1, size + 1))  # a sign without a piece stands alone
        for last, n in self.automaton.iter(signs):  # in order of ends, so the longest comes last
            longest[last + 1 - n] = last + 1
        failed, out, at, end, pairs = 0, [], 0, longest[0], self.pairs
        while at < size:
            before = out[-1] if out else None
            while end > at:
                piece = signs[at:end]
                if not (failed and failed >> end & 1):
                    if before is None:
                        break
                    fits = pairs.get((before, piece))
                    if self.compatible(before, piece) if fits is None else fits:
                        break
                end -= 1
                while end > at + 1 and signs[at:end] not in whole:
                    end -= 1
            if end > at:
                out.append(piece)
                at = end
                end = longest[at] if at < size else size
            else:  # nothing fits here: mark it, and shorten the piece before
                failed |= 1 << at
                end = at - 1
                at -= len(out.pop())
                while end > at + 1 and signs[at:end] not in whole:
                    end -= 1
        return out

    def part_ids(self, signs: str) -> tuple[int, ...]:
        """Ids of a new part, from the parts that it falls into."""
        got = self.older.get(signs)
        if got is None:
            inside = self.inside
            cuts = [i for i in range(1, len(signs)) if signs[i - 1 : i + 1] not in inside]
            if cuts:
                out: list[int] = []
                for a, b in zip([0, *cuts], [*cuts, len(signs)]):
                    some = signs[a:b]
                    out += self.parts.get(some) or self.part_ids(some)
                got = tuple(out)
            else:
                got = self._uncut_ids(signs)
        self.parts[signs] = got
        return got

    def _uncut_ids(self, signs: str) -> tuple[int, ...]:
        out: list[int] = []
        for piece in self.split(signs):
            at = self.ids.get(piece)
            if at is not None:
                out.append(at)
            elif self.bytes:
                out.extend(self.bytes[b] for b in piece.encode("utf-8", "surrogatepass"))
            else:
                out.append(self.unknown)
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if "  " in text or SPACE in text or text[0] == " ":
            parts = _PART.findall(SPACE + text.replace(" ", SPACE))
        else:
            parts = [SPACE + p for p in text.split(" ")]
        if len(self.parts) > MAX_PARTS:
            self.older, self.parts = self.parts, {}
        kept, out = self.parts, []
        for p in parts:
            got = kept.get(p)
            if got is None:
                got = self.part_ids(p)
            out += got
        return out

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, byte pieces as UTF-8 (a wrong byte is U+FFFD), without the first space."""
        table, text = self.text, None
        if self.special.isdisjoint(ids):
            try:
                text = b"".join([table[i] for i in ids]).decode()
            except UnicodeDecodeError:
                pass
        if text is None:
            text = self._decode_runs(ids)
        first = next((i for i in ids if table[i]), None)
        spaced = first is not None and first not in self.byte_ids and first not in self.special
        return text[1:] if spaced and text[:1] == " " else text

    def _decode_runs(self, ids: list[int]) -> str:
        out, run = [], bytearray()

        def close():
            left = bytes(run)
            while left:
                try:
                    out.append(left.decode())
                    break
                except UnicodeDecodeError as wrong:
                    out.append(left[: wrong.start].decode() + "�")
                    left = left[wrong.start + 1 :]
            run.clear()

        for i in ids:
            if i in self.byte_ids:
                run += self.text[i]
            else:
                close()
                out.append(self.text[i].decode())
        close()
        return "".join(out)


def model(path: str) -> PieceModel:
    """The worker's own model for a file; loaded once in each Python process."""
    if path not in _loaded:
        _loaded[path] = PieceModel(path)
    return _loaded[path]


SCHEMA = "doc_id long, ids array<int>, decoded string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def encode_and_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids of the whole text, and the text that those ids decode to; map-only."""

    def run(batches):
        pieces = model(model_path)
        for b in slices(batches):
            ids = [pieces.encode(t) for t in b.column(1).to_pylist()]
            sizes = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(sizes[-1])))
            yield batch(_ARROW, [b.column(0), pa.ListArray.from_arrays(pa.array(sizes), flat), [pieces.decode(x) for x in ids]])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, SCHEMA)


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows with the text of an array of ids; null ids give null."""

    @F.pandas_udf("string")
    def run(ids):
        pieces = model(model_path)
        return ids.map(lambda x: None if x is None else pieces.decode(list(x)))

    return rows.withColumn(out_col, run(F.col(ids_col)))
