"""SentencePiece BPE by backtracking instead of a merge queue.

A sequence of pieces is what merging gives exactly if each two neighbours, put
together and merged anew, come out as the same two pieces. So the encoder walks
a text with the longest piece that an Aho-Corasick automaton finds at each
place, takes shorter ones while a neighbour does not fit, and steps back when
none does; a bitfield remembers the places from which no way on exists. Checks
of neighbours are remembered, as are the ids of short units of text.

A unit is a run of the space mark and what follows it up to the next mark. No
piece of the vocabulary has a mark after another character (checked on
loading), so no merge crosses units. Characters without a piece become bytes.

The automaton's matches are taken as the walk goes, for a stretch of a unit at a
time, so a long unit takes the memory of its ids and no more, and long units are
not remembered.

Null texts count as empty. Very long units work in linear time. Of pairs with the
same score the leftmost is merged, as the library does. Repeated rows get a row
each; null ids pass through; columns called `ids` and `decoded` give way, others
may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TwoAges

MARK = "▁"
_STRETCH = 256
_REMEMBERED = 200
_UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class PieceEncoder:
    """Encodes and decodes with a SentencePiece BPE model of identity normalisation and byte fallback."""

    def __init__(self, path: str, max_units: int = 800_000, max_pairs: int = 1_000_000):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.max_pairs = max_pairs
        self.text: dict[int, str] = {}
        self.score: dict[str, tuple[float, int]] = {}
        self.byte = {}
        for i in range(m.get_piece_size()):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.text[i], self.score[piece] = piece, (m.get_score(i), i)
        if len(self.byte) != 256 or any(re.search(f"[^{MARK}]{MARK}", p) for p in self.score):
            raise ValueError("the model needs byte fallback, and no piece with a mark after another character")
        self.longest = max(map(len, self.score), default=1)
        self.automaton = ahocorasick.Automaton()
        for piece, (_, i) in self.score.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.single = {p for p in self.score if len(p) == 1}
        #: Characters that only larger pieces have: a unit with one is merged plainly.
        self.inner = {c for p in self.score if len(p) > 1 for c in p} - self.single
        self.fits: dict[tuple[int, int], bool] = {}
        self.held = TwoAges(max_units)
        self.bos, self.eos = m.bos_id(), m.eos_id()

    def merged(self, text: str) -> list[str]:
        """The pieces (or characters without one) that merging the best pair again and again gives, the leftmost of equally good ones first."""
        score, n = self.score, len(text)
        size, before = [1] * n, list(range(-1, n - 1))  # of the part that starts at a place; 0: no part does any more

        def pair(a: int) -> tuple[float, int, int] | None:
            b = a + size[a]
            found = score.get(text[a : b + size[b]]) if b < n else None
            return found and (-found[0], a, b + size[b])

        waiting = [x for a in range(n) if (x := pair(a))]
        heapify(waiting)
        while waiting:
            _, a, end = heappop(waiting)
            b = a + size[a]
            if not size[a] or b >= n or b + size[b] != end:
                continue  # one of the two has been merged since
            size[a], size[b] = end - a, 0
            if end < n:
                before[end] = a
            for left in (before[a], a):
                if left >= 0 and (x := pair(left)):
                    heappush(waiting, x)
        return [text[a : a + k] for a, k in enumerate(size) if k]

    def fit(self, left: int, right: int) -> bool:
        """Whether two neighbours survive a merge of their text; left -1: whether one piece does."""
        key = (left, right)
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= self.max_pairs:
                self.fits.clear()
            want = [self.text[right]] if left < 0 else [self.text[left], self.text[right]]
            found = self.fits[key] = self.merged("".join(want)) == want
        return found

    def known(self, text: str) -> array:
        """The ids of a text all of whose characters have pieces."""
        n, score, fit = len(text), self.score, self.fit
        dead = bytearray(n // 8 + 1)
        sizes, ids = array("H"), array("I")
        place, size = 0, 0  # 0: the longest piece at the place, else the longest that may still be tried
        ahead, until = None, 0  # the automaton's longest matches one after another, from a place on and for a stretch
        while place < n:
            if not size:
                if ahead is None or (place + self.longest > until and until < n):
                    until = min(n, place + _STRETCH)
                    ahead = self.automaton.iter_long(text[place:until])
                size = next(ahead)[1][0]
                longest = size
            else:
                ahead, longest = None, 0
            last = ids[-1] if ids else -1
            while size:
                found = score.get(text[place : place + size])
                end = place + size
                if found is not None and not dead[end >> 3] >> (end & 7) & 1 and fit(last, found[1]):
                    break
                size -= 1
            if size:
                if size != longest:
                    ahead = None
                ids.append(found[1])
                sizes.append(size)
                place, size = end, 0
                continue
            while not size:  # nothing fits: back to a place where something shorter may
                if not ids:
                    raise ValueError("no sequence of pieces gives this text")
                dead[place >> 3] |= 1 << (place & 7)
                ids.pop()
                size = sizes.pop()
                place -= size
                size -= 1
        return ids

    def unit(self, text: str) -> array:
        """The ids of a unit; characters without a piece become their bytes."""
        if self.inner and not self.inner.isdisjoint(text):
            out = array("I")
            for p in self.merged(text):
                s = self.score.get(p)
                out.extend([s[1]] if s else [self.byte[x] for x in p.encode()])
            return out
        if self.single.issuperset(text):
            return self.known(text)
        out = array("I")
        begin = 0
        for k, c in enumerate(text):
            if c not in self.single:
                if begin < k:
                    out.extend(self.known(text[begin:k]))
                out.extend([self.byte[x] for x in c.encode()])
                begin = k + 1
        if begin < len(text):
            out.extend(self.known(text[begin:]))
        return out

    def _encoded(self, key: str) -> bytes:
        ids = self.unit(key if key[:1] in ("\n", MARK) else MARK + key)
        return np.array(ids, dtype="<u4").tobytes()

    def _learn(self, held: dict[str, bytes], keys: set[str]) -> None:
        for key in keys:
            held[key] = self._encoded(key)

    def encode(self, text: str) -> bytes:
        """The ids of a text, without begin and end, as little-endian unsigned 32-bit integers.

        Units are looked up by what follows their mark. A line break has no
        piece, so what follows one is a unit as well, without a mark.
        """
        if not text:
            return b""
        spaced = text.replace(MARK, " ").replace("\n", " \n")
        if "  " in spaced or spaced[0] == " " or spaced[-1] == " ":
            keys = _UNITS.findall(MARK + text.replace(" ", MARK))
        else:
            keys = spaced.split(" ")
        distinct = set(keys)
        held = self.held.fill({k for k in distinct if len(k) <= _REMEMBERED}, self._learn)
        long = {k: self._encoded(k) for k in distinct if len(k) > _REMEMBERED}
        return b"".join([held[k] if len(k) <= _REMEMBERED else long[k] for k in keys])

    def encode_with_ends(self, text: str) -> np.ndarray:
        ids = np.frombuffer(self.encode(text), dtype="<u4")
        return np.concatenate((np.array([self.bos], "<u4"), ids, np.array([self.eos], "<u4")))

    def decode(self, ids: np.ndarray) -> str:
        return self.model.decode(ids.tolist())


_encoders: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    """This worker's encoder for a model file; it stays between tasks."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encode_pieces(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """`docs` with `ids` (array of int, with begin and end ids) and `decoded`; columns of those names give way."""
    own = [c for c in docs.columns if c not in ("ids", "decoded")]
    schema = docs.select(*own).schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(model)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                found = [encoder.encode_with_ends(t or "") for t in part.column(own.index(text)).to_pylist()]
                ids = pa.array([x.view("<i4") for x in found], pa.list_(pa.int32()))
                decoded = pa.array([encoder.decode(x) for x in found], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, ids, decoded], names=[*own, "ids", "decoded"])

    return docs.select(*own).mapInArrow(run, schema)


def piece_digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what `encode_pieces` gives, as digests made in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(model)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            n, of_ids, of_text = [], [], []
            for t in b.column(1):
                ids = encoder.encode_with_ends(t.as_py() or "")
                n.append(len(ids))
                of_ids.append(sha(ids.tobytes()))
                of_text.append(sha(encoder.decode(ids).encode()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
