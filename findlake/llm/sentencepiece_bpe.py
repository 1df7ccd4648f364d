"""SentencePiece merge-type (BPE) encoding by backtracking, and decoding.

A text's encoding is the one sequence of pieces in which every two neighbours are what merging
their characters gives. An Aho-Corasick pass finds the longest piece at every character; the
encoder takes it, falls back to shorter pieces while the neighbour check fails, and steps back one
piece when none is left. A bit for every position that led nowhere keeps it from being tried again,
so the work is linear in the text. The neighbour check merges the two pieces' characters again by
score; its answers are kept.

No merge crosses two neighbours that no piece holds side by side. So words are cut where the space
mark stands behind another character, and where a character of the largest group that pieces hold
together (letters, as a rule) meets one outside of it; what is cut is encoded apart and kept. A
character outside the vocabulary becomes its UTF-8 bytes' pieces.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import pairwise

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from findlake.llm.scratch import prepare

MARK = "▁"
#: Entries that a worker keeps of words and of neighbour checks, and the longest word kept.
KEPT_WORDS, KEPT_PAIRS, KEPT_LENGTH = 300_000, 1_000_000, 48


class Encoder:
    """A merge-type model read through the library; identity normaliser with a dummy prefix."""

    def __init__(self, model_path: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        every = range(lib.get_piece_size())
        self.byte = {int(lib.id_to_piece(i)[3:5], 16): i for i in every if lib.is_byte(i)}
        plain = [i for i in every if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.score = {lib.id_to_piece(i): lib.get_score(i) for i in plain}
        self.ids = {lib.id_to_piece(i): i for i in plain}
        if any(MARK in piece.lstrip(MARK) for piece in self.ids):
            raise ValueError("a piece holds the space mark behind another character; words can't be encoded apart")
        if lib.encode("a Å  b") != lib.encode("a Å  b", out_type=int) or lib.decode(lib.encode("  a ")) != "  a ":
            raise ValueError("only models with the identity normaliser are read")
        self.bos, self.eos = lib.bos_id(), lib.eos_id()
        letters = {c for piece in self.ids for c in piece}
        # pieces that merging can't reach never stand in an encoding
        reached = [p for p in self.ids if len(p) == 1 or self.merged(p) == [p]]
        self.longest = ahocorasick.Automaton()
        for piece in reached:
            self.longest.add_word(piece, len(piece))
        self.longest.make_automaton()
        reached = set(reached)
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in reached), None) for p in reached}
        if not letters <= self.ids.keys():
            raise ValueError("only models whose characters are all pieces are read")
        self.width = max(map(len, reached))
        known = "".join(map(re.escape, sorted(letters)))
        self.stretches = re.compile(f"([{known}]+)|([^{known}]+)").findall
        line = "" if "\n" in letters else "\n"
        group = "".join(map(re.escape, sorted(_largest_group(self.ids))))
        own = f"{MARK}*[{group}]+|" if group else ""
        self.words = re.compile(f"{own}{MARK}*[^{MARK}{line}{group}]+|{MARK}+" + (f"|{line}" if line else "")).findall
        self.pairs: dict[tuple[str, str], bool] = {}
        self.kept = _Kept(self)

    def merged(self, text: str) -> list[str]:
        """The characters of ``text`` merged: always the neighbours whose union scores best, the first among equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether ``left`` and ``right`` stay two pieces where they meet."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            found = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return found

    def at(self, text: str, start: int) -> str:
        """The longest piece that ``text`` of known characters has from ``start``."""
        piece = text[start : start + self.longest.longest_prefix(text[start : start + self.width])]
        while piece not in self.shorter:
            piece = piece[:-1]
        return piece

    def run(self, text: str) -> list[str]:
        """Pieces of a text of known characters: the longest from left to right while all of them fit, then by stepping back."""
        n, at, last = len(text), 0, None
        shorter, pairs, fits = self.shorter, self.pairs, self.fits
        out: list[str] = []
        for end, length in self.longest.iter_long(text):
            piece = text[at : end + 1]
            if length != end + 1 - at:
                break
            if last is not None:
                good = pairs.get((last, piece))
                if not (fits(last, piece) if good is None else good):
                    break
            out.append(piece)
            at, last = end + 1, piece
        if at == n:
            return out
        open_ = bytearray(b"\x01") * (n + 1)
        piece = self.at(text, at)
        while at < n:
            while piece is not None:
                if open_[at + len(piece)]:
                    if last is None:
                        break
                    good = pairs.get((last, piece))
                    if fits(last, piece) if good is None else good:
                        break
                piece = shorter[piece]
            if piece is not None:
                out.append(piece)
                at += len(piece)
                last, piece = piece, self.at(text, at) if at < n else None
            else:  # nothing leads on from here
                open_[at] = 0
                piece = out.pop()
                at -= len(piece)
                last = out[-1] if out else None
                piece = shorter[piece]
        return out

    def word(self, text: str) -> bytes:
        """Ids of a word as little-endian 32-bit integers."""
        ids, out = self.ids, array("I")
        for known, stretch in self.stretches(text):
            if known:
                out.extend([ids[p] for p in self.run(known)])
            else:
                out.extend(self.byte[b] for b in stretch.encode("utf-8", "surrogatepass"))
        return _little(out)

    def encode(self, text: str) -> bytes:
        """All ids, begin and end among them."""
        marked = MARK + text.replace(" ", MARK) if text else ""
        body = b"".join(map(self.kept.__getitem__, self.words(marked)))
        return self.bos.to_bytes(4, "little") + body + self.eos.to_bytes(4, "little")

    def decode(self, ids: bytes) -> str:
        values = array("I", ids)
        if values.itemsize != 4:
            raise RuntimeError("32-bit integers are needed")
        return self.library.decode(values.tolist())


def _largest_group(pieces: Iterable[str]) -> set[str]:
    """Of the groups of characters that pieces hold next to each other, directly or through others, the largest."""
    group: dict[str, set[str]] = {}
    for piece in pieces:
        for a, b in pairwise(piece.lstrip(MARK)):
            one, other = group.setdefault(a, {a}), group.setdefault(b, {b})
            if one is not other:
                if len(one) < len(other):
                    one, other = other, one
                one |= other
                group.update(dict.fromkeys(other, one))
    return max(group.values(), key=lambda g: (len(g), min(g)), default=set())


def _little(values: array) -> bytes:
    return b"".join(v.to_bytes(4, "little") for v in values) if values.itemsize != 4 else values.tobytes()


class _Kept(dict):
    """Encoded words. When there are too many, those not asked for since the last time are forgotten."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder
        self.before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        found = self.before.get(word)
        if found is None:
            found = self.encoder.word(word)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS // 2:
                self.before = dict(self)
                self.clear()
            self[word] = found
        return found


@functools.lru_cache(maxsize=2)
def encoder(model_path: str) -> Encoder:
    """One encoder for each worker and model."""
    return Encoder(model_path)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_tokens``, ``ids`` (binary: little-endian
    unsigned 32-bit integers, begin and end ids included) and ``decoded``, the library's decoding.

    A null text counts as empty: begin and end ids only, decoded to the empty text. ``model_path``
    names a file that every executor has. Rows are independent: repeated rows repeat their result,
    an empty table gives an empty one, other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path)
        for batch in source:
            ids = [own.encode(t or "") for t in batch.column(1).to_pylist()]
            columns = [
                batch.column(0),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array(ids, pa.binary()),
                pa.array([own.decode(x) for x in ids], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"])

    return rows.mapInArrow(batches, f"doc_id {kind}, n_tokens bigint, ids binary, decoded string")
