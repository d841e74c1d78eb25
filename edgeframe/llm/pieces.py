"""SentencePiece encoding and decoding by one walk over a trie of marked words.

The library's own normaliser turns spaces into the mark U+2581.  No piece has a
mark after another character and none has a character that no piece knows, so
a text falls into *units* - marks, then one word - that encode on their own.
The distinct units of a batch are sorted, which is a depth-first walk of their
trie: a unit keeps the forward values of the prefix that it shares with the
unit before and computes the rest.

The forward value of a prefix is the last piece of its encoding.  For a
unigram model it is the best-scored one (Viterbi).  For a byte-pair model the
best sum of scores would *not* give the library's result; there the last piece
is the one that merging leaves whole next to the last piece before it, which
is unique and makes the walk exact.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeframe.llm import textops
from edgeframe.llm.shared import batched, named, others, quoted

MARK = "▁"
#: Distinct units whose ids a process keeps from slice to slice, about.
KEPT_UNITS = 300_000
#: Pairs of pieces whose merging a process remembers.
KEPT_PAIRS = 250_000
#: Steps of the automaton over the pieces that a process remembers.
KEPT_STEPS = 250_000
#: A text with this many characters that no piece knows is taken apart by the pattern.
FEW_STRANGE = 8
#: Units over this many characters don't share; their ids would be copied at each step.
LONG_UNIT = 256
#: Bytes of text encoded at once: the more, the more prefixes are shared.
SLICE = 2 << 20


class Pairs(dict):
    """Of the piece ``left``: whether a piece stands whole to its right."""

    __slots__ = ("left", "machine")

    def __init__(self, machine: Encoder, left: str):
        self.machine, self.left = machine, left

    def __missing__(self, right: str) -> bool:
        return self.machine.stands(self, right)


class Ending(dict):
    """A state of the automaton over the pieces, and by character the state that follows.

    ``text`` is the longest end of what was read that begins a piece, or else
    its last character.  ``pieces`` has the pieces of two characters or more
    that end there, longest first: their lengths, themselves, their ids and
    what stands to their right.  ``single`` is the last character's, likewise.
    """

    __slots__ = ("machine", "pieces", "single", "text")

    def __init__(self, machine: Encoder, text: str):
        self.machine, self.text = machine, text
        ends = (text[i:] for i in range(len(text) - 1))
        self.pieces = tuple((len(p), p, *machine.entry(p)) for p in ends if p in machine.score)
        self.single = machine.entry(text[-1:])

    def __missing__(self, char: str) -> Ending:
        return self.machine.follow(self, char)


class Encoder:
    """The forward walk for one model file's content."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) or lib.is_byte(i) for i in range(lib.vocab_size())]
        self.pieces = [lib.id_to_piece(i) for i in range(lib.vocab_size())]
        self.id = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.score = {p: lib.get_score(i) for p, i in self.id.items()}
        self.byte = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = lib.is_byte(self.byte[0])
        self.spelt = np.array([p.encode() for p in self.pieces], dtype=object)
        self.is_byte = np.zeros(len(self.pieces), dtype=bool)
        if self.fallback:
            self.spelt[self.byte] = [bytes([b]) for b in range(256)]
            self.is_byte[self.byte] = True
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("pieces that cross a word's start are not supported")
        # byte-pair models score their pieces by rank
        self.merging = all(float(s).is_integer() for s in self.score.values() if s > -1e8)
        #: What a character without a piece costs: the library's penalty of 10 under the least score.
        self.unknown = min(self.score.values(), default=0.0) - 10.0
        known = {c for p in self.id for c in p}
        # the lengths of pieces that end in three given characters, and in two, longest first
        sizes: dict[str, set[int]] = {}
        for p in self.id:
            if len(p) > 2:
                sizes.setdefault(p[-3:], set()).add(len(p))
        twos = {p for p in self.id if len(p) == 2}
        self.sizes = {k: (*sorted(v, reverse=True), *((2,) if k[1:] in twos else ())) for k, v in sizes.items()}
        self.sizes2 = dict.fromkeys(twos, (2,))
        letters = "".join(re.escape(c) for c in sorted(known - {MARK}))
        self.unit = re.compile(f"{MARK}*[{letters}]+|{MARK}+|.", re.DOTALL) if letters else re.compile(".", re.DOTALL)
        self.plain = known | {MARK}
        #: A character that no piece knows begins the key of a unit without a mark.  The others' keys
        #: have the first mark taken off, so that most take a byte a character.
        self.bare = next(c for c in map(chr, itertools.count()) if c not in self.plain)
        # ids as 32-bit integers in a row
        self.known = {p: struct.pack("=i", i) for p, i in self.id.items()}
        self.right: dict[str, Pairs] = {}
        self.right_size = 0
        #: The states by text: one for each beginning of a piece, made when first met.
        self.states: dict[str, Ending | None] = dict.fromkeys(p[:n] for p in self.id for n in range(1, len(p) + 1))
        self.steps = 0
        self.start = Ending(self, "")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _merged(self, text: str) -> list[str]:
        """What byte-pair merging by score, leftmost first, leaves of ``text``."""
        score, never = self.score.get, -float("inf")
        parts = list(text)
        gain = [score(a + b, never) for a, b in itertools.pairwise(parts)]
        while gain and (best := max(gain)) > never:
            i = gain.index(best)
            parts[i] += parts.pop(i + 1)
            del gain[i]
            if i:
                gain[i - 1] = score(parts[i - 1] + parts[i], never)
            if i < len(gain):
                gain[i] = score(parts[i] + parts[i + 1], never)
        return parts

    def _fits(self, left: str, right: str) -> bool:
        if not left:
            return len(right) == 1 or self._merged(right) == [right]
        return self._merged(left + right) == [left, right]

    def stands(self, pairs: Pairs, right: str) -> bool:
        """Whether merging leaves the piece ``right`` whole after that of ``pairs``; remembered."""
        if self.right_size >= KEPT_PAIRS:
            # each table is emptied where it is; states and walks hold references to them
            for table in self.right.values():
                table.clear()
            self.right_size = 0
        found = pairs[right] = self._fits(pairs.left, right)
        self.right_size += 1
        return found

    def entry(self, piece: str) -> tuple[bytes, Pairs]:
        """The ids of a piece, or of a character that is none, and what stands to its right."""
        if (table := self.right.get(piece)) is None:
            table = Pairs(self, piece)
            if piece in self.known or not piece:
                self.right[piece] = table
        return self._ids(piece), table

    def follow(self, state: Ending, char: str) -> Ending:
        """The state after ``char``; remembered, but for characters that begin no piece."""
        text = state.text + char
        while text and text not in self.states:
            text = text[1:]
        if not text:
            return Ending(self, char)
        if (found := self.states[text]) is None:
            found = self.states[text] = Ending(self, text)
        if self.steps >= KEPT_STEPS:
            self.start.clear()
            for other in filter(None, self.states.values()):
                other.clear()
            self.steps = 0
        state[char] = found
        self.steps += 1
        return found

    def _last(self, unit: str, n: int, total: list[float]) -> tuple[str, float]:
        """The last piece of the best-scored encoding of ``unit[:n]``, and its score."""
        best = ("", -float("inf"))
        sizes = (self.sizes.get(unit[n - 3 : n]) if n > 2 else None) or (self.sizes2.get(unit[n - 2 : n], ()) if n > 1 else ())
        for size in sizes:
            if size > n:
                continue
            piece = unit[n - size : n]
            if piece in self.score and (value := total[n - size] + self.score[piece]) > best[1]:
                best = (piece, value)
        # one character that is no piece costs dearly
        single = unit[n - 1]
        value = total[n - 1] + self.score.get(single, self.unknown)
        return (single, value) if value > best[1] else best

    def _ids(self, piece: str) -> bytes:
        if piece in self.known:
            return self.known[piece]
        ids = [self.byte[b] for b in piece.encode()] if self.fallback else [self.library.unk_id()]
        return struct.pack(f"={len(ids)}i", *ids)

    def walk(self, units: list[str]) -> dict[str, bytes]:
        """The ids of distinct units."""
        return self._walk_merging(sorted(units)) if self.merging else self._walk_scored(sorted(units))

    def _walk_merging(self, units: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        # of each prefix of the unit at hand: the state, the ids, and what stands whole after its last piece
        before, states, ids, after = "", [self.start], [b""], [self.entry("")[1]]
        for unit in units:
            if len(unit) > LONG_UNIT:
                out[unit] = self._alone(unit)
                continue
            shared = 0
            for x, y in zip(before, unit, strict=False):
                if x != y:
                    break
                shared += 1
            del states[shared + 1 :], ids[shared + 1 :], after[shared + 1 :]
            state = states[-1]
            for char in unit[shared:]:
                state = state[char]
                for size, piece, its_ids, pairs in state.pieces:
                    if after[-size][piece]:
                        ids.append(ids[-size] + its_ids)
                        break
                else:
                    # a single character stands if nothing longer does
                    its_ids, pairs = state.single
                    ids.append(ids[-1] + its_ids)
                after.append(pairs)
                states.append(state)
            out[unit] = ids[-1]
            before = unit
        return out

    def _walk_scored(self, units: list[str]) -> dict[str, bytes]:
        """Viterbi: of each prefix the best-scored last piece and the score."""
        out: dict[str, bytes] = {}
        before, total, ids = "", [0.0], [b""]
        step, known = self._last, self.known
        for unit in units:
            if len(unit) > LONG_UNIT:
                out[unit] = self._alone(unit)
                continue
            shared = 0
            for x, y in zip(before, unit, strict=False):
                if x != y:
                    break
                shared += 1
            del total[shared + 1 :], ids[shared + 1 :]
            for n in range(shared + 1, len(unit) + 1):
                piece, value = step(unit, n, total)
                total.append(value)
                ids.append(ids[n - len(piece)] + (known.get(piece) or self._ids(piece)))
            out[unit] = ids[-1]
            before = unit
        return out

    def _keys(self, text: str) -> list[str]:
        """The keys of a normalised text's units; that of an empty unit may be among them."""
        bare = self.bare
        if MARK * 2 not in text and bare not in text and len(strange := set(text) - self.plain) <= FEW_STRANGE:
            # single marks start units, unknown characters are units
            for c in strange:
                text = text.replace(c, f"{MARK}{bare}{c}{MARK}{bare}")
            first, *found = text.split(MARK)
            return [bare + first, *found] if first else found
        return [u[1:] if u[0] == MARK else bare + u for u in self.unit.findall(text)]

    def _alone(self, unit: str) -> bytes:
        """The ids of one long unit, read back from its last pieces."""
        sizes, found = [0], []
        if self.merging:
            state, after, last = self.start, [self.entry("")[1]], [b""]
            for char in unit:
                state = state[char]
                for size, piece, its_ids, pairs in state.pieces:
                    if after[-size][piece]:
                        break
                else:
                    size, (its_ids, pairs) = 1, state.single
                sizes.append(size)
                last.append(its_ids)
                after.append(pairs)
        else:
            total, last = [0.0], [b""]
            for n in range(1, len(unit) + 1):
                piece, value = self._last(unit, n, total)
                sizes.append(len(piece))
                last.append(self.known.get(piece) or self._ids(piece))
                total.append(value)
        n = len(unit)
        while n:
            found.append(last[n])
            n -= sizes[n]
        return b"".join(reversed(found))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has."""
        keys = [self._keys(self.library.normalize(t)) if t else [] for t in texts]
        # units not met for a while go with their generation
        if len(self.young) > KEPT_UNITS // 2:
            self.old, self.young = self.young, {}
        young, old, new = self.young, self.old, []
        young[self.bare] = b""
        for k in set(itertools.chain.from_iterable(keys)).difference(young):
            if (ids := old.get(k)) is None:
                new.append(k)
            else:
                young[k] = ids
        new.sort()
        units = [k[1:] if k[:1] == self.bare else MARK + k for k in new]
        young.update(zip(new, map(self.walk(units).__getitem__, units), strict=True))
        found = [b"".join(map(young.__getitem__, k)) for k in keys]
        return np.frombuffer(b"".join(found), np.int32), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes joined, marks as spaces, the first mark dropped."""
        out, pending = [], bytearray()
        for i in ids:
            if self.fallback and self.byte[0] <= i <= self.byte[255]:
                pending.append(i - self.byte[0])
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending = bytearray()
            out.append(self.pieces[i])
        out.append(pending.decode("utf-8", "replace"))
        return "".join(out).removeprefix(MARK).replace(MARK, " ")

    def decode_all(self, ids: np.ndarray, count: np.ndarray) -> Iterator[bytes]:
        """The UTF-8 text of each list of ids, as ``decode`` gives it."""
        spelt, single = self.spelt[ids], np.concatenate([[0], np.cumsum(self.is_byte[ids])])
        ends = np.cumsum(count)
        for a, b in zip((ends - count).tolist(), ends.tolist(), strict=True):
            raw = b"".join(spelt[a:b].tolist())
            if single[b] > single[a]:
                # bytes that make no character are replaced run by run
                try:
                    raw.decode()
                except UnicodeDecodeError:
                    yield self.decode(ids[a:b].tolist()).encode()
                    continue
            yield raw.removeprefix(MARK.encode()).replace(MARK.encode(), b" ")


_encoders: dict[bytes, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    """One encoder for each model and process."""
    key = hashlib.sha256(model).digest()
    if key not in _encoders:
        _encoders[key] = Encoder(model)
    return _encoders[key]


def encode_pieces(docs: DataFrame, model: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``docs`` with ``n_pieces`` and ``piece_ids`` instead of the text.

    With ``decoded``, the ids are decoded again and ``decoded_sha256`` has the
    digest of that text.

    ``model`` is the path, on the driver, of a SentencePiece model; its content
    (of fixed size) goes to the executors.  The ids are the library's, without
    begin or end pieces.

    Null and empty texts have no pieces.  Other columns are kept, but for those
    named like the new ones, which are replaced; repeated rows pass through.
    An empty table gives an empty result.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(Path(model).read_bytes())
    new = [T.StructField("n_pieces", T.LongType()), T.StructField("piece_ids", T.ArrayType(T.IntegerType())), *([T.StructField("decoded_sha256", T.StringType())] if decoded else [])]
    rest, keep = batched(docs, text_col, *(f.name for f in new))
    out = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(keep)), *new])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = encoder(shipped.value)
        for batch in batches:
            for part in textops.slices(batch, "text", SLICE):
                ids, count = machine.encode(textops.as_arrow(part.column("text")).to_pylist())
                offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
                digests = [pa.array([hashlib.sha256(t).hexdigest() for t in machine.decode_all(ids, count)], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(count), pa.ListArray.from_arrays(offsets, pa.array(ids)), *digests], out.fieldNames())

    return named(rest.mapInArrow(rows, out), keep)


def decode_pieces(docs: DataFrame, model: str, ids_col: str = "piece_ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of its ids, as the library decodes them.

    A null list gives a null text, an empty one an empty text.  Other columns
    are kept, whatever their names; one named like the new one is replaced;
    repeated rows pass through.  An empty table gives an empty result.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(Path(model).read_bytes())
    keep = others(docs, text_col)
    rest = docs.select(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(keep)), F.col(quoted(ids_col)).alias("ids"))
    fields = [T.StructField(c, f.dataType) for c, f in zip(keep, rest.schema, strict=False)]
    out = T.StructType([*rest.schema.fields[:-1], T.StructField(text_col, T.StringType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = encoder(shipped.value)
        for batch in batches:
            texts = [None if ids is None else machine.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], out.fieldNames())

    return named(rest.mapInArrow(rows, out), fields)


def op10(spark, sf_dir: str) -> DataFrame:
    """Every document's piece ids and the text they decode to, as digests."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    return found.select("doc_id", "n_pieces", F.sha2(F.concat_ws(",", F.transform("piece_ids", lambda i: i.cast("string"))), 256).alias("ids_sha256"), "decoded_sha256")
