"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs, ordered by score and then from the left, and merges the best pair until no
pair of neighbours is a piece. Merges can't reach over a word's start when no piece has the space mark behind another
character, nor over characters that only stand alone; texts are cut there, and equal segments are encoded once per
worker. The new segments of an Arrow batch have their agendas side by side as rows of a matrix, of which each step merges every row's
best pair; long ones, and those with characters that are no pieces, have an agenda of their own. Decoding joins pieces, gathers
byte pieces into UTF-8 and drops the space that encoding put in front.

Both are held against the sentencepiece library, an Arrow batch at a time: decoding text by text, encoding by each new segment's ids
before they are remembered, and by the cuts of every text. Its segments joined must be the text, and no piece may hold the two
characters on both sides of a cut, so that no merge reaches over it and the whole text's ids are those of its segments. Should a
segment or a cut not hold, or where the vocabulary doesn't allow for this, the library encodes the batch's texts whole and its ids are given.

Edge cases: null text: empty; the empty text gives the end id alone. Characters outside the vocabulary fall back to bytes, or
to the unknown id where a vocabulary has no byte pieces. U+2581 in a text reads as a space, as in the library. Very long texts
are encoded whole, in time n log n; repeated rows each; an empty table gives no rows; null doc_id stays null; further
columns are ignored. Only models with identity normalisation, kept white space and a leading space are taken; others raise
ValueError, as do models of another type.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
import struct
from array import array
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table, text_column, worker_state

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: Segments that a worker remembers, in two generations: what the older one has and isn't asked for again goes.
REMEMBERED = 300_000
#: Characters of the texts whose new segments are gathered, if they aren't one text's.
TOGETHER = 1_000_000
#: Bits of the places of pairs.
PLACES = 20
#: Symbols of a segment up to which the agenda is scanned, and columns of the matrices of agendas.
SHORT, WIDTHS = 32, (6, 9, 12, 16, 32)
NONE = float("-inf")
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5


def fields(data: bytes):
    """The fields of a protocol-buffer message: number and value."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        elif key & 7 == 5:
            yield key >> 3, struct.unpack_from("<f", data, at)[0]
            at += 4
        elif key & 7 == 1:
            yield key >> 3, data[at : at + 8]
            at += 8
        else:
            raise ValueError("this is no model file")


class Segments(dict):
    """The ids of segments, as the bytes of 32-bit numbers."""

    def __init__(self):
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.new: list[str] = []
        #: Whether all were held against the library.
        self.held = False

    def look_up(self, segments: set[str]) -> None:
        """What the older generation has of segments comes back; those that are unknown are noted as new."""
        older, absent = self.older, segments.difference(self)
        self.new = [s for s in absent if s not in older]
        self.update((s, older[s]) for s in absent.difference(self.new))

    def fill(self, solved: list[list[int]]) -> None:
        """The ids of the new segments."""
        self.update(zip(self.new, [array("i", ids).tobytes() for ids in solved], strict=True))

    def turn(self) -> None:
        """What was known becomes the older generation."""
        self.older = dict(self)
        super().clear()

    def settle(self) -> None:
        """Texts have been put together; long segments aren't kept, and no more than REMEMBERED // 2 new ones at once."""
        new, self.new = self.new, []
        if len(new) > REMEMBERED // 2:
            self.clear()
            return
        for segment in new:
            if len(segment) > 64:
                del self[segment]

    def clear(self) -> None:
        super().clear()
        self.older, self.new = {}, []


class Vocabulary:
    """A merge-type vocabulary, read from the bytes of a model file."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.types: list[int] = []
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids: dict[int, int] = {}
        self.unknown, self.end, self.byte_fallback = 0, 2, False
        for number, value in fields(model):
            if number == 1:
                self._piece(dict(fields(value)))
            elif number == 2:
                trainer = dict(fields(value))
                if trainer.get(3, 1) != 2:
                    raise ValueError("the vocabulary isn't of the merge type")
                self.byte_fallback = bool(trainer.get(35, 0))
                self.end = trainer.get(42, 2)
            elif number == 3:
                rules = dict(fields(value))
                if rules.get(2) or not rules.get(3, 1) or rules.get(4, 1) or not rules.get(5, 1):
                    raise ValueError("the model normalises texts in a way that isn't supported")
        if any(kind in (USER, UNUSED) for kind in self.types):
            raise ValueError("user-defined and unused pieces aren't supported")
        joined = [p for p in self.ids if len(p) > 1]
        cuts = not any(MARK in p.lstrip(MARK) for p in joined)
        self.alone = alone = "".join(c for c in "\n\t\r" if not any(c in p for p in joined))
        #: Whether a text's ids are those of its segments, and the library can be asked for a segment's (behind a line feed).
        self.by_segment = cuts and self.byte_fallback and "\n" in alone
        inner = f"[^{MARK}{re.escape(alone)}]" if alone else f"[^{MARK}]"
        self.segments = re.compile(f"{MARK}*{inner}+|{MARK}+" + (f"|[{re.escape(alone)}]" if alone else "") if cuts else "(?s).+")
        self.known = Segments()
        #: How pieces read; None where neighbours decide.
        self.spoken = [self._spoken(k) for k in range(len(self.pieces))]
        #: Ids as they are written in digests, after a space and with zero bytes behind.
        self.names = np.array([f" {k}".encode() for k in range(len(self.pieces))])
        self._pairs()

    def _pairs(self) -> None:
        """Tables of numbers: the pieces of single characters, and the pairs of pieces that form a piece, in the order of their keys."""
        self.none = len(self.pieces)
        self.letters = np.full(0x110000, -1, np.int32)
        found = []
        for piece, number in self.ids.items():
            if len(piece) == 1:
                self.letters[ord(piece)] = number
            halves = ((self.ids.get(piece[:k]), self.ids.get(piece[k:])) for k in range(1, len(piece)))
            found += [(a * (self.none + 1) + b, number, self.scores[piece]) for a, b in halves if a is not None and b is not None]
        # The last entry is met by no pair, and stands for all that form no piece.
        found = [*sorted(found), (np.iinfo(np.int64).max, self.none, NONE)]
        self.pair_keys, self.pair_made = np.array([x[0] for x in found]), np.array([x[1] for x in found], np.int32)
        self.pair_scores = np.array([x[2] for x in found])
        # Where to look a key up first; keys whose place another one took are searched for.
        places, order = self._place(self.pair_keys), np.arange(len(found), dtype=np.int32)
        self.places = np.full(1 << PLACES, len(found) - 1, np.int32)
        self.places[places] = order
        self.ousted = np.flatnonzero(self.places[places] != order)
        self.shared = np.zeros(1 << PLACES, bool)
        self.shared[places[self.ousted]] = True

    @staticmethod
    def _place(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PLACES)

    def _spoken(self, number: int) -> str | None:
        kind, piece = self.types[number], self.pieces[number]
        if kind == BYTE:
            value = int(piece[3:5], 16)
            return chr(value) if value < 128 else None
        return {CONTROL: "", UNKNOWN: " ⁇ "}.get(kind, piece.replace(MARK, " "))

    def _piece(self, entry: dict) -> None:
        piece, kind, number = entry.get(1, b"").decode(), entry.get(3, NORMAL), len(self.pieces)
        self.pieces.append(piece)
        self.types.append(kind)
        if kind == NORMAL:
            self.ids.setdefault(piece, number)
            self.scores.setdefault(piece, entry.get(2, 0.0))
        elif kind == BYTE:
            self.byte_ids[int(piece[3:5], 16)] = number
        elif kind == UNKNOWN:
            self.unknown = number

    def merge(self, text: str) -> list[str]:
        """The symbols of a segment once no two neighbours form a piece."""
        return self._merge_short(list(text)) if len(text) <= SHORT else self._merge_long(list(text))

    def _merge_short(self, symbols: list[str]) -> list[str]:
        """The agenda as a list by place: the best score is found by scanning, which is faster for a few symbols."""
        score = self.scores.get
        agenda = [score(a + b, NONE) for a, b in zip(symbols, symbols[1:], strict=False)]
        while agenda and (best := max(agenda)) != NONE:
            at = agenda.index(best)
            symbols[at] += symbols.pop(at + 1)
            del agenda[at]
            if at:
                agenda[at - 1] = score(symbols[at - 1] + symbols[at], NONE)
            if at < len(agenda):
                agenda[at] = score(symbols[at] + symbols[at + 1], NONE)
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The agenda as a heap; entries whose symbols have changed since are skipped."""
        n, score = len(symbols), self.scores.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(-s, k, k + 1, symbols[k] + symbols[k + 1]) for k in range(n - 1) if (s := score(symbols[k] + symbols[k + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, both = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != len(both):
                continue
            symbols[left], symbols[right] = both, ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            for a, b in ((before[left], left), (left, after[left])):
                if a >= 0 and b >= 0 and (s := score(symbols[a] + symbols[b])) is not None:
                    heapq.heappush(agenda, (-s, a, b, symbols[a] + symbols[b]))
        return [x for x in symbols if x]

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where the pairs stand in the tables."""
        keys = left.astype(np.int64) * (self.none + 1) + right
        places = self._place(keys)
        at = self.places[places]
        missed = self.pair_keys[at] != keys
        at[missed] = len(self.pair_keys) - 1
        again = np.nonzero(missed & self.shared[places])
        if len(self.ousted) and len(again[0]):
            near = self.ousted[np.minimum(np.searchsorted(self.pair_keys[self.ousted], keys[again]), len(self.ousted) - 1)]
            at[again] = np.where(self.pair_keys[near] == keys[again], near, len(self.pair_keys) - 1)
        return at

    def _merge_rows(self, symbols: np.ndarray) -> list[list[int]]:
        """The agendas of all rows of symbols, which end in self.none: each step merges the best pair, the leftmost of equals, of every row."""
        rows, last = len(symbols), symbols.shape[1] - 1
        after = np.tile(np.minimum(np.arange(1, last + 2), last).astype(np.int8), (rows, 1))
        before = np.tile(np.array([last, *range(last)], np.int8), (rows, 1))
        pairs = np.full(symbols.shape, len(self.pair_keys) - 1, np.int32)
        pairs[:, :-1] = self._pair(symbols[:, :-1], symbols[:, 1:])
        agenda, rows = self.pair_scores[pairs], np.arange(rows)
        while True:
            best = agenda[rows].argmax(axis=1)
            some = agenda[rows, best] != NONE
            rows, best = rows[some], best[some]
            if not len(rows):
                break
            right = after[rows, best]
            follows, precedes = after[rows, right], before[rows, best]
            symbols[rows, best] = self.pair_made[pairs[rows, best]]
            symbols[rows, right], agenda[rows, right] = self.none, NONE
            after[rows, best], before[rows, follows] = follows, best
            for a, b in ((precedes, best), (best, follows)):
                pairs[rows, a] = found = self._pair(symbols[rows, a], symbols[rows, b])
                agenda[rows, a] = self.pair_scores[found]
        held = symbols != self.none
        flat, ends = symbols[held].tolist(), held.sum(axis=1).cumsum().tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def solve(self, segments: list[str]) -> list[list[int]]:
        """The ids of segments, most of them side by side."""
        out: list[list[int] | None] = [None] * len(segments)
        lengths, low = np.fromiter(map(len, segments), np.int64, len(segments)), 0
        for width in WIDTHS:
            at = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            letters = self.letters[np.frombuffer("".join([segments[k] for k in at.tolist()]).encode("utf-32-le"), np.uint32)]
            held = np.arange(width + 1) < lengths[at][:, None]
            symbols = np.full(held.shape, self.none, np.int32)
            symbols[held] = letters
            pieces = (symbols >= 0).all(axis=1)
            for k, ids in zip(at[pieces].tolist(), self._merge_rows(symbols[pieces]), strict=True):
                out[k] = ids
        return [self.segment_ids(s) if ids is None else ids for s, ids in zip(segments, out, strict=True)]

    def segment_ids(self, segment: str) -> list[int]:
        out: list[int] = []
        for symbol in self.merge(segment):
            if (number := self.ids.get(symbol)) is not None:
                out.append(number)
            elif self.byte_fallback:
                out.extend(self.byte_ids[b] for b in symbol.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def _segments(self, text: str) -> list[str]:
        return self.segments.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of texts, the end id last."""
        return [np.frombuffer(ids, np.int32).tolist() for ids in self.encode_bytes(texts)]

    def encode_bytes(self, texts: list[str], lib=None) -> list[bytes] | None:
        """The ids of texts as the bytes of 32-bit numbers; with lib, None unless new segments' ids are the library's and cuts are right."""
        if self.known.held != (lib is not None):
            self.known.clear()
            self.known.held = lib is not None
        out: list[bytes] = []
        while len(out) < len(texts):
            some = self._encode_some(texts[len(out) : self._end(texts, len(out))], lib)
            if some is None:
                return None
            out += some
        return out

    def _holds(self, lib, segments: list[str], solved: list[list[int]]) -> bool:
        """Whether the library has the same ids of segments; it puts a mark in front of what it encodes."""
        marked = [len(s) > 1 and s[0] == MARK for s in segments]
        found, front = lib.encode([s[1:] if m else "\n" + s for s, m in zip(segments, marked, strict=True)], num_threads=1), lib.encode("\n")
        return all(f == (ids if m else front + ids) for f, ids, m in zip(found, solved, marked, strict=True))

    def _cut_right(self, text: str, segments: list[str], odd: set[str]) -> bool:
        """Whether segments are the whole text and no piece reaches over a cut; odd: those which begin without a mark or end with one."""
        if "".join(segments) != (MARK + text.replace(" ", MARK) if text else ""):
            return False
        if odd.isdisjoint(segments):
            return True
        alone, cuts = self.alone, {c for k, s in enumerate(segments) if s in odd for c in (k, k + 1) if 0 < c < len(segments)}
        return all(b[0] in alone or a[-1] in alone or (b[0] == MARK and a[-1] != MARK) for a, b in ((segments[c - 1], segments[c]) for c in cuts))

    @staticmethod
    def _end(texts: list[str], start: int) -> int:
        """Where to stop, so that texts together have no more than TOGETHER characters, or are one."""
        end, size = start + 1, len(texts[start])
        while end < len(texts) and (size := size + len(texts[end])) <= TOGETHER:
            end += 1
        return end

    def _encode_some(self, texts: list[str], lib) -> list[bytes] | None:
        known, end = self.known, array("i", [self.end]).tobytes()
        if len(known) > REMEMBERED // 2:
            known.turn()
        try:
            segments = [self._segments(text) for text in texts]
            distinct = set(chain.from_iterable(segments))
            known.look_up(distinct)
            solved = self.solve(known.new)
            if lib is not None:
                odd = {s for s in distinct if s[0] != MARK or s[-1] == MARK}
                if not self._holds(lib, known.new, solved) or not all(self._cut_right(text, some, odd) for text, some in zip(texts, segments, strict=True)):
                    known.clear()
                    return None
            known.fill(solved)
            found = [b"".join(map(known.__getitem__, some)) + end for some in segments]
        except BaseException:
            known.clear()
            raise
        known.settle()
        return found

    def decode(self, ids: list[int]) -> str:
        if not ids:
            return ""
        try:
            text = "".join([self.spoken[k] for k in ids])
        except TypeError:
            return self._decode_bytes(ids)
        if self.types[ids[0]] == CONTROL:
            return self._decode_bytes(ids)
        return text[1:] if self.types[ids[0]] == NORMAL and self.pieces[ids[0]].startswith(MARK) else text

    def _decode_bytes(self, ids: list[int]) -> str:
        """Decoding piece by piece, where byte pieces have to be gathered."""
        out: list[str] = []
        held = bytearray()
        first = True
        for number in ids:
            kind = self.types[number]
            if kind == BYTE:
                held.append(int(self.pieces[number][3:5], 16))
                first = False
                continue
            if held:
                out.append(bytes_text(held))
                held.clear()
            if kind == CONTROL:
                continue
            if kind == UNKNOWN:
                out.append(" ⁇ ")
            else:
                piece = self.pieces[number]
                out.append((piece[1:] if first and piece.startswith(MARK) else piece).replace(MARK, " "))
            first = False
        if held:
            out.append(bytes_text(held))
        return "".join(out)


def bytes_text(data: bytes | bytearray) -> str:
    """UTF-8, in which each byte that starts no whole character is one U+FFFD, as the library has it."""
    out, at, data = [], 0, bytes(data)
    while at < len(data):
        for width in (1, 2, 3, 4):
            try:
                out.append(data[at : at + width].decode())
            except UnicodeDecodeError:
                continue
            at += width
            break
        else:
            out.append("�")
            at += 1
    return "".join(out)


def prepared(model: bytes):
    """The vocabulary and the library's processor for a model, made once per worker."""
    import sentencepiece

    state = worker_state()
    key = ("pieces", hashlib.sha256(model).hexdigest())
    if key not in state:
        state[key] = Vocabulary(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    return state[key]


def read_model(path: str | None = None) -> bytes:
    """The model's bytes, some 0.5 MB, which go to the executors with the function."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    with open(path, "rb") as f:
        return f.read()


@contextmanager
def uncollected():
    """No search for cycles meanwhile: a batch makes a list per segment, and each search would walk all that are remembered."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def checked(texts: list[str], model: bytes) -> tuple[list[np.ndarray], list[list[int]], list[str], list[bool]]:
    """Ids as arrays and as lists, decoded texts, and whether the sentencepiece library has the same of both, for a batch of texts.

    Where segments and cuts don't hold, the library encodes every text whole. Should one differ, its ids are given and the worker
    forgets all segments.
    """
    own, lib = prepared(model)
    with uncollected():
        ours = own.encode_bytes(texts, lib) if own.by_segment else None
        if ours is not None:
            arrays, same = [np.frombuffer(b, np.int32) for b in ours], [True] * len(texts)
        else:
            arrays, same = whole(texts, own, lib)
        ids = [a.tolist() for a in arrays]
        decoded = lib.decode(ids)
        return arrays, ids, decoded, [a and own.decode(b) == d for a, b, d in zip(same, ids, decoded, strict=True)]


def whole(texts: list[str], own: Vocabulary, lib) -> tuple[list[np.ndarray], list[bool]]:
    """The library's ids of whole texts, and whether ours are the same."""
    ours = own.encode_bytes(texts)
    theirs = lib.encode(texts, num_threads=1, add_eos=True, out_type="numpy")
    same = [a == b.tobytes() for a, b in zip(ours, theirs, strict=True)]
    if not all(same):
        own.known.clear()
    return theirs, same


def encode_batch(texts: list[str], model: bytes) -> list[tuple[list[int], str, bool]]:
    """Ids, decoded text, and whether the library has the same of both, text by text."""
    return list(zip(*checked(texts, model)[1:], strict=True))


def encode_texts(docs: DataFrame, model: bytes | None = None) -> DataFrame:
    """doc_id, ids array<int>, decoded, agrees for the texts of docs."""
    model = model or read_model()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, decoded, agrees = zip(*encode_batch(batch.column(1).to_pylist(), model), strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())], ["doc_id", "ids", "decoded", "agrees"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), text_column().alias("text")), run, "doc_id long, ids array<int>, decoded string, agrees boolean")


def digest_texts(docs: DataFrame, model: bytes | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, agrees: what encode_texts() gives, as digests made beside it."""
    model = model or read_model()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        arrays, _, decoded, agrees = checked(batch.column(1).to_pylist(), model)
        names = prepared(model)[0].names
        sha = lambda data: hashlib.sha256(data).hexdigest()
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(ids) for ids in arrays], pa.int64()),
                pa.array([sha(names[ids].tobytes().replace(b"\0", b"")[1:]) for ids in arrays], pa.string()),
                pa.array([sha(text.encode()) for text in decoded], pa.string()),
                pa.array(agrees, pa.bool_()),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"],
        )

    return map_batches(docs.select(F.col("doc_id").cast("long"), text_column().alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_texts(table(spark, sf_dir, "documents"))
