"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass over a trie of distinct marked words.

Distinct words are sorted, which makes a depth-first walk of their trie: a word starts from the forward states of the
longest prefix that it shares with the word before it, and only its remaining letters are new. With each letter goes the
longest end of the prefix that begins a piece, a place in the trie of pieces: it tells which pieces end here, and one step
from it leads to the place of the next letter. The forward state of a prefix is (score, last piece, state before it): over
all pieces that end here the best sum of the score before and the piece's own; the pieces of a word are read off the states
backwards.

The vocabulary is a score-ordered one whose encoder joins the best-scored neighbours first. For it a split is the encoding
exactly if each two neighbours in it stay apart when encoded together, so only such pieces are candidates. That leaves one
for nearly every prefix; the best score decides among them.

Marked words: blanks become the mark and one mark is put first, as the vocabulary's settings say; a word is a run of marks
with the letters after it (no piece holds a mark after a letter; the loader checks that). Letters that are no piece become
byte pieces. Decoding inverts all of this.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Set
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorwright.llm.common import keeps, lean, table, tidy
from floorwright.llm.text import STEP, steps

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words in each of the two generations that a Python worker remembers between steps; half of the neighbour checks and of
#: the ways between places, which start anew beyond that.
_REMEMBERED = 60_000
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


#: (score of the best split of a prefix, its last piece, the state before that piece)
State = tuple[float, str | None, "State | None"]


class Place(dict):
    """A beginning of a piece (or a letter that begins none): the next place by letter, found when first asked for.

    ends: (length, piece, rank, its neighbour checks) of the pieces that end here, the longest first; at last the letter
    itself, piece or not.
    """

    __slots__ = ("text", "own", "ends")

    def __init__(self, text: str, own: Pieces):
        self.text, self.own = text, own
        kept = [text[k:] for k in range(len(text)) if text[k:] in own.ranks or k == len(text) - 1]
        self.ends = [(len(p), p, own.ranks.get(p, own.least), own.apart.setdefault(p, {})) for p in kept]

    def __missing__(self, letter: str) -> Place:
        text = self.text + letter
        while len(text) > 1 and text not in self.own.begins:
            text = text[1:]
        found = self[letter] = self.own.place(text)
        self.own.learned += 1
        return found


@dataclass
class Pieces:
    """A vocabulary: ranks of joinable pieces, ids of bytes, and what decoding needs."""

    ids: dict[str, int]
    ranks: dict[str, float]
    byte_ids: list[int]
    unknown: int
    begins: set[str]  # what pieces begin with
    texts: list[str]
    kinds: list[int]  # 0 text, 1 byte, 2 control
    raw: list[bytes] = field(default_factory=list)  # the bytes that a piece decodes to
    apart: dict[str, dict[str | None, bool]] = field(default_factory=dict)  # by right and left neighbour
    edges: dict[str, tuple | None] = field(default_factory=dict)  # what sides() found
    places: dict[str, Place] = field(default_factory=dict)
    words: dict[str, bytes] = field(default_factory=dict)  # ids as little-endian 32-bit numbers
    older: dict[str, bytes] = field(default_factory=dict)  # the generation before
    checked: int = 0
    learned: int = 0

    @classmethod
    def load(cls, path: str = DEFAULT_MODEL) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, ranks, byte_ids, texts, kinds = {}, {}, [0] * 256, [], []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            texts.append(p)
            if sp.is_byte(i):
                byte_ids[int(_BYTE.fullmatch(p)[1], 16)] = i
                kinds.append(1)
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                kinds.append(2)
            else:
                ids[p], ranks[p] = i, sp.get_score(i)
                kinds.append(0)
                if MARK in p.lstrip(MARK):
                    raise ValueError(f"a piece holds a mark after a letter: {p!r}")
        raw = [b"" if k == 2 else t.encode() if k == 0 else bytes([int(t[3:5], 16)]) for t, k in zip(texts, kinds, strict=True)]
        return cls(ids, ranks, byte_ids, sp.unk_id(), {p[:k] for p in ids for k in range(1, len(p) + 1)}, texts, kinds, raw)

    def __post_init__(self) -> None:
        self.least = min(self.ranks.values()) - 10.0  # the score of a letter that is no piece: below all others
        self.codes = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}

    def joined(self, text: str, seen: list[tuple[float, str, str]] | None = None) -> list[str]:
        """The encoding of a short text by joining: the definition that the forward pass has to meet.

        seen: takes of each join its rank and the first and last parts after it.
        """
        own, rank, none = list(text), self.ranks.get, -math.inf
        near = [rank(a + b, none) for a, b in pairwise(own)]
        while near:
            best = max(near)
            if best == none:
                break
            i = near.index(best)
            own[i : i + 2] = [own[i] + own[i + 1]]
            del near[i]
            if seen is not None:
                seen.append((best, own[0], own[-1]))
            if i:
                near[i - 1] = rank(own[i - 1] + own[i], none)
            if i < len(near):
                near[i] = rank(own[i] + own[i + 1], none)
        return own

    def stay_apart(self, left: str | None, right: str) -> bool:
        """Whether the encoding of both together is one and the other; left: None where a word begins."""
        checks = self.apart.setdefault(right, {})
        found = checks.get(left)
        if found is None:
            self.checked += 1
            if self.checked > 2 * _REMEMBERED:
                for x in self.apart.values():
                    x.clear()
                self.checked = 1
            found = checks[left] = self.uncrossed(left, right) if left else self.joined(right) == [right]
        return found

    def sides(self, piece: str) -> tuple[list[tuple[float, str]], list[tuple[float, str]]] | None:
        """(rank of the join, part) of the first and of the last parts while a piece is joined, from its letters on; None if
        it doesn't come out as one, or a later join ranks above an earlier one."""
        if piece not in self.edges:
            seen: list[tuple[float, str, str]] = []
            whole = self.joined(piece, seen) == [piece] and all(a[0] >= b[0] for a, b in pairwise(seen))
            parts = [(math.inf, piece[0], piece[-1]), *seen]
            first, last = ([(r, p) for k, (r, p) in enumerate(x) if not k or p != x[k - 1][1]] for x in ([(r, a) for r, a, _ in parts], [(r, b) for r, _, b in parts]))
            self.edges[piece] = (first, last) if whole else None
        return self.edges[piece]

    def uncrossed(self, left: str, right: str) -> bool:
        """joined(left + right) == [left, right], from how the two are joined alone: both go on side by side, the best rank
        first and of equals the leftmost, until a join across the seam comes first or both are whole."""
        a, b = self.sides(left), self.sides(right)
        if a is None or b is None:
            return self.joined(left + right) == [left, right]
        ours, theirs, i, j, none = a[1], b[0], 0, 0, -math.inf
        while True:
            across = self.ranks.get(ours[i][1] + theirs[j][1], none)
            own = ours[i + 1][0] if i + 1 < len(ours) else none
            other = theirs[j + 1][0] if j + 1 < len(theirs) else none
            if across > own and across >= other:
                return False
            if own == other == none:
                return True
            if own >= other:
                i += 1
            else:
                j += 1

    def place(self, text: str) -> Place:
        found = self.places.get(text)
        if found is None:
            found = self.places[text] = Place(text, self)
        return found

    def forward(self, words: list[str]) -> Iterator[tuple[str, list[State]]]:
        """For each of the sorted distinct words the states of all its prefixes; those of a shared prefix are the same objects."""
        if self.learned > 2 * _REMEMBERED:
            self.places, self.apart, self.edges, self.learned, self.checked = {}, {}, {}, 0, 0
        states: list[State] = [(0.0, None, None)]
        places = [self.place("")]
        before = ""
        for w in words:
            k, n = 0, min(len(before), len(w))
            while k < n and before[k] == w[k]:
                k += 1
            del states[k + 1 :], places[k + 1 :]
            place = places[k]
            for letter in w[k:]:
                place = place[letter]
                best, top = None, -math.inf
                for n, p, r, checks in place.ends:
                    at = states[-n]
                    score = at[0] + r
                    if score > top:
                        good = checks.get(at[1])
                        if good or good is None and self.stay_apart(at[1], p):
                            top, best = score, (score, p, at)
                states.append(best or (score, p, at))  # nothing else fits: the letter
                places.append(place)
            before = w
            yield w, states

    def code(self, letter: str) -> bytes:
        """The byte pieces of a letter that is no piece."""
        return b"".join(self.byte_ids[b].to_bytes(4, "little") for b in letter.encode())

    def encode_words(self, words: Set[str]) -> dict[str, bytes]:
        """Ids of distinct marked words; those already known are taken from memory."""
        if len(self.words) > _REMEMBERED:
            self.words, self.older = {}, self.words
        known, older, code = self.words, self.older, self.codes.get
        new = [w for w in words if w not in known]
        for w in new:
            if w in older:  # those that come again now stay
                known[w] = older[w]
        for w, states in self.forward(sorted(w for w in new if w not in older)):
            out = []
            _, p, at = states[-1]
            while at is not None:  # backwards from the end, reversed below
                out.append(code(p) or self.code(p))
                _, p, at = at
            out.reverse()
            known[w] = b"".join(out)
        return known

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian 32-bit numbers."""
        one: dict[str, str] = {}  # a word is held once, however often it stands here
        units = [list(map(one.setdefault, own, own)) for own in (_UNIT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts)]
        known = self.encode_words(one.keys())
        return [b"".join(map(known.__getitem__, own)) for own in units]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts."""
        return [np.frombuffer(x, "<i4").tolist() for x in self.packed(texts)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; byte pieces that are no UTF-8 become U+FFFD, control pieces nothing."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The vocabulary, once for each Python worker."""
    if path not in _loaded:
        keeps(__name__, _loaded.clear)
        _loaded[path] = Pieces.load(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """docs with piece_ids array<int> and decoded string added (columns of these names are replaced).

    Null and empty texts have no pieces and decode to an empty text. decoded equals the text, but that a mark in a text
    comes back as a blank, as the vocabulary writes both alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = pieces(model)
        for b, texts in steps(batches, most=STEP // 8):
            packed = sp.packed([t.decode() for t in texts])
            ids = np.frombuffer(b"".join(packed), "<i4")
            at = np.cumsum([0, *[len(x) // 4 for x in packed]])
            decoded = [sp.decode(ids[i:j].tolist()) for i, j in pairwise(at.tolist())]
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            yield b.append_column("piece_ids", lists).append_column("decoded", pa.array(decoded, pa.string()))

    lean(docs.sparkSession)
    docs = docs.drop("piece_ids", "decoded")
    schema = docs.select("*", F.lit(None).cast("array<int>").alias("piece_ids"), F.lit(None).cast("string").alias("decoded")).schema
    return docs.mapInArrow(tidy(run), schema)


def ids_digest(ids: np.ndarray) -> int:
    """crc32 of the ids as little-endian 32-bit numbers."""
    return zlib.crc32(ids.astype("<i4").tobytes())


def digests(docs: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, n_pieces, pieces_crc32, round_trip) of each row of docs, from encode_documents' columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("piece_ids")
            ids = [x.values.to_numpy(zero_copy_only=False) for x in col]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([ids_digest(x) for x in ids], pa.int64()), b.column("round_trip")], ["doc_id", "n_pieces", "pieces_crc32", "round_trip"])

    out = encode_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    same = F.translate(F.coalesce("text", F.lit("")), MARK, " ") == F.col("decoded")
    return out.select("doc_id", "piece_ids", same.alias("round_trip")).mapInArrow(tidy(run), "doc_id long, n_pieces long, pieces_crc32 long, round_trip boolean")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
