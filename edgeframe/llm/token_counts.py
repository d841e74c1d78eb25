"""Token counts by a byte-pair tokenizer compiled to finite-state transducers.

Two machines in sequence, both deterministic:

* The *splitter* cuts a text into pre-tokens.  Its pattern is local: whether a
  pre-token starts at a character depends on the classes of at most three
  characters on either side, so the machine's run over any chunk is known from
  the chunk and that halo, and is evaluated for all characters at once.
* The *merger* reads the bytes of a pre-token.  Its state holds, for every
  recent position from which a longer token could still end, the trie node
  reached, the last token before that position and how many tokens lie
  between; a transition carries the change of the token count.  States are
  numbered as they are met.  When there are ``max_states`` of them, even in the
  middle of a run, those that were visited most and those in use stay and the
  others go, so memory is bounded whatever the input.

Pre-tokens are cut into chunks of ``CHUNK`` bytes that run side by side, at most
``LANES`` at once.  A chunk's state map goes from the states in which the
machine can be after the bytes before it - found by running from several places
shortly before the chunk - to exit states and token counts.  The maps are
composed in a parallel prefix scan that doubles its stride.  Exits that are no
entry of the next chunk's map yet are added to it until the scan gets through.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeframe.llm import textops
from edgeframe.llm.shared import batched, named

CHUNK = 64
#: Chunks of a pre-token are entered from runs that begin so many bytes before them.
RUN_UPS = (24, 17)
LANES = 1 << 15
MAX_STATES = 1 << 17
LIMIT = 512

_LETTER, _NUMBER, _SPACE, _OTHER, _UNKNOWN = 0, 1, 2, 3, 255


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merger:
    """The lazily built transducer over the bytes of one pre-token."""

    def __init__(self, vocab: dict[bytes, int], ranks: dict[tuple[bytes, bytes], int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        self.text: dict[int, bytes] = {}
        for piece, token in vocab.items():
            node = 0
            for b in piece:
                node = self.child[node].setdefault(b, len(self.child))
                if node == len(self.child):
                    self.child.append({})
                    self.token.append(-1)
            self.token[node] = token
            self.text[token] = piece
        self.fits = functools.lru_cache(maxsize=1 << 17)(self._fits)
        self.width = 64  # bytes get a column of the table when they first occur
        self.column = np.full(256, -1, np.int64)
        self.byte = []
        self._reset()

    def _reset(self) -> None:
        self.number: dict[tuple, int] = {}
        self.active: list[tuple] = []
        self.next = np.full((1 << 10, self.width), -1, np.int32)
        self.emit = np.zeros((1 << 10, self.width), np.int8)
        self.visits = np.zeros(1 << 10, np.int64)
        self._state(((0, -1, 0),))

    def _state(self, active: tuple) -> int:
        state = self.number.setdefault(active, len(self.active))
        if state == len(self.active):
            self.active.append(active)
            if state >= len(self.next):
                more = max(1 << 10, len(self.next) // 4)
                self.next = np.concatenate([self.next, np.full((more, self.width), -1, np.int32)])
                self.emit = np.concatenate([self.emit, np.zeros((more, self.width), np.int8)])
                self.visits = np.concatenate([self.visits, np.zeros(more, np.int64)])
        return state

    def _forget(self, used: list[np.ndarray]) -> None:
        """Keep the start, the most visited states and those in ``used``, which are numbered anew in place."""
        n = len(self.active)
        stay = np.zeros(n, dtype=bool)
        stay[np.argsort(-self.visits[:n], kind="stable")[: self.max_states // 2]] = True
        stay[0] = True
        for states in used:
            stay[states] = True
        old = np.flatnonzero(stay)
        new = np.full(n + 1, -1, np.int32)
        new[old] = np.arange(len(old))
        table, emits, visits, active = self.next, self.emit, self.visits, self.active
        self.active = [active[i] for i in old.tolist()]
        self.number = {x: i for i, x in enumerate(self.active)}
        size = max(1 << 10, len(old))
        self.next, self.emit = np.full((size, self.width), -1, np.int32), np.zeros((size, self.width), np.int8)
        self.next[: len(old)], self.emit[: len(old)] = new[table[old]], emits[old]
        self.visits = np.zeros(size, np.int64)
        self.visits[: len(old)] = visits[old] // 2
        for states in used:
            states[:] = new[states]

    def merged(self, data: bytes) -> list[bytes]:
        """The pieces that byte-pair merging leaves of ``data``."""
        rank, never = self.ranks.get, 1 << 30
        parts = [data[i : i + 1] for i in range(len(data))]
        order = [rank(pair, never) for pair in zip(parts, parts[1:], strict=False)]
        while order and (best := min(order)) < never:
            i = order.index(best)
            parts[i] += parts.pop(i + 1)
            del order[i]
            if i:
                order[i - 1] = rank((parts[i - 1], parts[i]), never)
            if i < len(order):
                order[i] = rank((parts[i], parts[i + 1]), never)
        return parts

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging leaves ``right`` whole after ``left`` (-1: at the start)."""
        pieces = [self.text[right]] if left < 0 else [self.text[left], self.text[right]]
        if tuple(pieces) in self.ranks:
            return False
        return self.merged(b"".join(pieces)) == pieces

    def _build(self, state: int, column: int) -> None:
        active, after, byte = [], None, self.byte[column]
        for node, last, since in self.active[state]:
            down = self.child[node].get(byte)
            if down is None:
                continue
            if self.child[down]:
                active.append((down, last, since))
            token = self.token[down]
            if after is None and token >= 0 and self.fits(last, token):
                after = (token, since)
        if after is None:
            raise ValueError(f"no token for byte {byte}")
        change = 1 - after[1]  # tokens after minus tokens before
        key = tuple((node, last, since + change) for node, last, since in active)
        new = self._state((*key, (0, after[0], 0)))
        self.next[state, column], self.emit[state, column] = new, change

    def _columns(self, raw: np.ndarray) -> np.ndarray:
        """The table column of each byte."""
        for b in np.flatnonzero((np.bincount(raw, minlength=256) > 0) & (self.column < 0)).tolist():
            self.column[b] = len(self.byte)
            self.byte.append(b)
        if len(self.byte) > self.width:
            self.width = 128 if len(self.byte) <= 128 else 256
            self._reset()
        return self.column[raw]

    def run(self, raw: np.ndarray, at: np.ndarray, size: np.ndarray, entry: np.ndarray, held: tuple[np.ndarray, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and tokens of each run over columns ``raw[at : at + size]``.

        States in ``entry`` and ``held`` stay known; they are numbered anew in place if need be.
        """
        state, count = entry.astype(np.int64), np.zeros(len(at), np.int64)
        order = np.argsort(-size, kind="stable")
        for lanes in (order[i : i + LANES] for i in range(0, len(order), LANES)):
            here, left, begin, total = state[lanes], size[lanes], at[lanes], np.zeros(len(lanes), np.int64)
            live = np.searchsorted(-left, -np.arange(int(left[0])), side="left")
            for t, k in enumerate(live):
                if len(self.active) > self.max_states:
                    self._forget([here, state, entry, *held])
                self.visits[here[:k]] += 1
                place = here[:k] * self.width + raw[begin[:k] + t]
                to = self.next.ravel()[place]
                if (missing := np.unique(place[to < 0])).size:
                    for p in missing.tolist():
                        self._build(p // self.width, p % self.width)
                    to = self.next.ravel()[place]
                total[:k] += self.emit.ravel()[place]
                here[:k] = to
            state[lanes], count[lanes] = here, total
        return state, count

    def count(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token ``raw[start : end]``."""
        raw = self._columns(raw)
        short = end - start <= CHUNK
        out = np.zeros(len(start), np.int64)
        out[short] = self.run(raw, start[short], (end - start)[short], np.zeros(int(short.sum()), np.int64))[1]
        for i in np.flatnonzero(~short).tolist():
            out[i] = self._long(raw, int(start[i]), int(end[i]))
        return out

    def _long(self, raw: np.ndarray, start: int, end: int) -> int:
        """Tokens of a long pre-token, from the composed state maps of its chunks."""
        at = np.arange(start, end, CHUNK)
        n, size = len(at), np.minimum(end - at, CHUNK)
        # the maps, flat: an entry state of a chunk, the state after it and the tokens between
        chunk, entry, leave, tokens = (np.zeros(0, np.int64) for _ in range(4))
        new, state = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]  # the first chunk is entered in state 0
        later = np.arange(1, n)
        for up in RUN_UPS:
            new.append(later)
            state.append(self.run(raw, at[1:] - up, np.full(n - 1, up), np.zeros(n - 1, np.int64), tuple(state))[0])
        more, states = np.concatenate(new), np.concatenate(state)
        while True:
            order = np.lexsort((states, more))
            order = order[textops.changes(more[order], states[order])]
            more, states = more[order], states[order]
            left, passed = self.run(raw, at[more], size[more], states, (entry, leave))
            chunk, entry, leave, tokens = (np.concatenate(x) for x in ((chunk, more), (entry, states), (leave, left), (tokens, passed)))
            # where each map's exit enters the next chunk; two places beyond stand for the end and for the unknown
            m, many = len(chunk), len(self.active) + 1
            key = chunk * many + entry
            order = np.argsort(key)
            want = (chunk + 1) * many + leave
            place = order[np.minimum(np.searchsorted(key, want, sorter=order), m - 1)]
            known = key[place] == want
            to = np.concatenate([np.where(chunk == n - 1, m, np.where(known, place, m + 1)), [m, m + 1]])
            total = np.concatenate([tokens, [0, 0]])
            for _ in range(n.bit_length()):
                total, to = total + total[to], to[to]
            first = int(np.flatnonzero(chunk == 0)[0])
            if to[first] == m:
                return int(total[first])
            lost = np.flatnonzero(~known & (chunk < n - 1))
            more, states = chunk[lost] + 1, leave[lost]


class Counter:
    """Both machines of a byte-level byte-pair ``tokenizer.json``."""

    def __init__(self, definition: bytes, max_states: int = MAX_STATES):
        from tokenizers import pre_tokenizers

        spec = json.loads(definition)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE without normalizer or prefix space is supported")
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"]):
            raise ValueError("added tokens that strip or match words are not supported")
        self.special = sorted((a["content"].encode() for a in spec["added_tokens"]), key=len, reverse=True)
        alphabet = _byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        skip = {a["content"] for a in spec["added_tokens"]}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ranks = {(as_bytes(a), as_bytes(b)): r for r, (a, b) in enumerate(pairs)}
        self.merger = Merger({as_bytes(k): v for k, v in model["vocab"].items() if k not in skip}, ranks, max_states)
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.classes = np.full(0x110000, _UNKNOWN, np.uint8)

    def _learn(self, points: np.ndarray) -> None:
        """Ask the library's own splitter for the classes of new characters."""
        for p in points.tolist():
            joined = [len(self.library.pre_tokenize_str(x + chr(p))) == 1 for x in "a1!"]
            self.classes[p] = next((k for k, yes in zip((_LETTER, _NUMBER, _OTHER), joined, strict=True) if yes), _SPACE)

    def _pieces(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of stretches without special strings, and those strings' places."""
        found, blob = [], raw.tobytes()
        if any(s in blob for s in self.special):
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                i = a
                while hits := [(j, -len(s)) for s in self.special if (j := blob.find(s, i, b)) >= 0]:
                    j, size = min(hits)
                    found.append((j, j - size))
                    i = j - size
        marks = np.array(found, np.int64).reshape(-1, 2)
        return np.unique(np.concatenate([off, marks.ravel()])), marks

    def count(self, array: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        raw, off = textops.text_bytes(array)
        tokens = np.zeros(len(array), np.int64)
        if not len(raw):
            return tokens
        edges, marks = self._pieces(raw, off)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        b = raw[lead].astype(np.int32)
        wide = np.flatnonzero(b >= 0x80)
        point = b.copy()
        if wide.size:
            at, first = lead[wide], b[wide]
            size = 2 + (first >= 0xE0) + (first >= 0xF0)
            value = np.where(size == 2, first & 0x1F, np.where(size == 3, first & 0x0F, first & 0x07))
            for k in (1, 2, 3):
                more = size > k
                value[more] = (value[more] << 6) | (raw[at[more] + k] & 0x3F)
            point[wide] = value
        group = self.classes[point]
        if (new := np.unique(point[group == _UNKNOWN])).size:
            self._learn(new)
            group = self.classes[point]
        n = len(lead)
        first = np.zeros(n + 1, dtype=bool)
        first[np.searchsorted(lead, edges)] = True
        last, first = first[1:], first[:-1]
        last[-1] = True
        white = group == _SPACE
        before = lambda x, none: np.concatenate([[none], x[:-1]])
        prev_white, prev_blank = before(white, False), before(point == 32, False)
        next_white = np.concatenate([white[1:], [True]])
        start = first | np.where(white, ~prev_white | (~next_white & ~last), np.where(prev_white, ~prev_blank, group != before(group, _UNKNOWN)))
        # a quote that starts a pre-token takes one of these endings with it
        quote = np.flatnonzero((point == 39) & start & ~last)
        if quote.size:
            at = lambda i: np.where(i < n, point[np.minimum(i, n - 1)], 0)
            one, two = at(quote + 1), at(quote + 2)
            roomy = ~last[quote + 1]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = roomy & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
            for q, width in ((quote[short], 2), (quote[long & ~short], 3)):
                for k in range(1, width):
                    start[q + k] = False
                stop = q + width
                start[stop[stop < n]] = True
        begin = lead[start]
        end = np.concatenate([begin[1:], [len(raw)]])
        if len(marks):
            special = np.isin(begin, marks[:, 0]) & (begin < len(raw))
            inside = np.searchsorted(marks[:, 0], begin, side="right") - 1
            covered = (inside >= 0) & (begin < marks[np.maximum(inside, 0), 1])
            count = np.where(special, 1, 0)
            plain = np.flatnonzero(~covered)
        else:
            count, plain = np.zeros(len(begin), np.int64), np.arange(len(begin))
        count[plain] = self.merger.count(raw, begin[plain], end[plain])
        return np.bincount(np.searchsorted(off, begin, side="right") - 1, weights=count, minlength=len(array)).astype(np.int64)[: len(array)]


_counters: dict[bytes, Counter] = {}


def counter(definition: bytes, max_states: int = MAX_STATES) -> Counter:
    """The compiled machines, one set for each definition and process."""
    key = hashlib.sha256(definition).digest() + max_states.to_bytes(4, "little")
    if key not in _counters:
        _counters[key] = Counter(definition, max_states)
    return _counters[key]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, text_col: str = "text", max_states: int = MAX_STATES) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` instead of the text.

    ``tokenizer`` is the path, on the driver, of a byte-level BPE
    ``tokenizer.json``; its content (of fixed size) goes to the executors.
    Special strings inside a text count as one token each, as in the library;
    no begin or end tokens, truncation or padding.

    Null texts count as empty ones (0 bytes, 0 tokens); null ids and repeated
    rows pass through; other columns are kept, but for those named like the
    three new ones, which are replaced.  An empty table gives an empty result.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    rest, keep = batched(docs, text_col, "n_bytes", "n_tokens", "over_limit")
    new = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    out = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(keep)), *new])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(shipped.value, max_states)
        for batch in batches:
            for part in textops.slices(batch, "text"):
                array = textops.as_arrow(part.column("text"))
                _, off = textops.text_bytes(array)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.diff(off)), pa.array(machine.count(array))], out.fieldNames())

    return named(rest.mapInArrow(rows, out).withColumn("over_limit", F.col("n_tokens") > limit), keep)


def op2(spark, sf_dir: str) -> DataFrame:
    """Contract query over whole ``documents``."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
