"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are taken in blocks bounded by items and by distinct words, so
nearly every benchmark is one block.  For one block:

1. Documents become runs of ``STRIDE`` words, each the set of its words in the
   block's vocabulary; a passage is two neighbouring runs.  Frequencies over all
   runs of all documents give the TF-IDF weights.
2. A randomised SVD finds the leading right singular vectors of the matrix A of
   all passages of all documents and of the items: each task adds up its share
   of A'(A G) for a narrow G, and the driver orthonormalises the sums.  After
   the last pass, Q and Y = A'A Q give A'A as Y (Q'Y)^-1 Y' (Nystroem), which
   is diagonalised.
3. Passages are searched by cosine in that space.  Runs in which too little of
   an item's rare words stands for step 4 to accept any passage there are
   skipped; that loses nothing.  A cosine in few dimensions can miss a leak
   that other words surround, so passages with enough of an item's telling
   words are candidates too.
4. Candidates are read again.  In some stretch little longer than the item, the
   weighted longest common subsequence must cover enough of it, and some of its
   most informative words (its answer, where the benchmark has no column for
   one) must be there.  Half an item in its order is enough, so replaced words
   and swapped halves don't hide a leak.

Items too short for this are found by their exact word sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeframe.llm import textops
from edgeframe.llm.near_dups import _only
from edgeframe.llm.shared import dropped, quoted, stored

PASSAGE, STRIDE = 96, 48
#: Items and distinct words of a block, at most: the broadcast basis has BLOCK_WORDS * RANK numbers at most.
BLOCK, BLOCK_WORDS = 4096, 1 << 16
#: Dimensions of the latent space, further random directions, passes over A.
RANK, EXTRA, ROUNDS, SEED = 64, 8, 2, 7
#: Words whose products are dense, and runs multiplied at once; the sums are the same with any numbers here.
COMMON, GRAM_RUNS = 512, 2048
#: Least latent cosine of a candidate without enough telling words nearby.
COSINE = 0.3
#: Least share of the item's weight in the common subsequence: half of the words replaced leave half on average, and spread around it.
SHARE = 0.36
#: Telling words of an item, the least share of them that a candidate needs if its cosine is low, and that any leak needs.
TELLING, TELLING_SHARE, ANSWER_SHARE = 6, 0.5, 1 / 6
#: A common subsequence must lie within so many times the item's words, and so many words more.
STRETCH, SLACK = 1.5, 8
#: Stretches read together.
TOGETHER = 512
#: Items with fewer words are found by their exact sequence.
LEAST_WORDS = 8

_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def normal_words(array: pa.Array) -> tuple[textops.Words, np.ndarray]:
    """Lower-cased words without ASCII punctuation at their ends, and their hashes."""
    words = textops.Words(array, lower=True)
    at = np.flatnonzero(_PUNCT[words.raw[words.start]])
    while at.size:
        words.start[at] += 1
        at = at[words.start[at] < words.end[at]]
        at = at[_PUNCT[words.raw[words.start[at]]]]
    at = np.flatnonzero(_PUNCT[words.raw[words.end - 1]])
    while at.size:
        # a word of nothing else is gone already
        at = at[words.start[at] < words.end[at]]
        words.end[at] -= 1
        at = at[_PUNCT[words.raw[words.end[at] - 1]]]
    solid = words.end > words.start
    words.start, words.end, words.doc = words.start[solid], words.end[solid], words.doc[solid]
    words.first = np.searchsorted(words.doc, np.arange(words.rows + 1))
    return words, words.hashes()


class _Lookup:
    """Places in a sorted table of hashes, by the table's part with the same leading bits."""

    def __init__(self, table: np.ndarray):
        bits = len(table).bit_length() + 3
        self.table, self.shift = table, np.uint64(64 - bits)
        first = np.searchsorted(table, np.arange(1 << bits, dtype=np.uint64) << self.shift)
        self.many = np.diff(np.append(first, len(table)))
        self.first = np.minimum(first, len(table) - 1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each hash in the table, -1 if absent."""
        part = (hashes >> self.shift).view(np.int64)
        at = self.first[part]
        out = np.where(self.table[at] == hashes, at, -1)
        left, step = np.flatnonzero((out < 0) & (self.many[part] > 1)), 1
        while left.size:
            at = self.first[part[left]] + step
            same = self.table[at] == hashes[left]
            out[left[same]] = at[same]
            step += 1
            left = left[~same & (self.many[part[left]] > step)]
        return out


def _block_rows(vocabulary: np.ndarray):
    """One row a document: how many distinct known words each ``STRIDE`` words have, and those words."""
    width = len(vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _Lookup(vocabulary)
        for batch in batches:
            for part in textops.slices(batch, "text"):
                words, hashes = normal_words(textops.as_arrow(part.column("text")))
                feature = find(hashes)
                blocks = -(-np.diff(words.first) // STRIDE)
                ends = np.concatenate([[0], np.cumsum(blocks)])
                known = np.flatnonzero(feature >= 0)
                place = ends[words.doc[known]] + (known - words.first[words.doc[known]]) // STRIDE
                place, feature = np.divmod(textops.distinct(place * width + feature[known]), width)
                size = np.bincount(place, minlength=ends[-1])
                per_doc = np.diff(np.concatenate([[0], np.cumsum(size)])[ends])
                yield pa.RecordBatch.from_arrays([part.column("doc"), textops.lists(size, blocks).cast(pa.list_(pa.int32())), textops.lists(feature, per_doc).cast(pa.list_(pa.int32()))], ["doc", "sizes", "features"])

    return rows


class _Items:
    """The items of a block over its vocabulary, and the sieve's tables."""

    def __init__(self, block: list[tuple], vocabulary: np.ndarray, idf: np.ndarray):
        self.hashes, self.weight, self.telling = [], [], []
        entries: list[tuple] = []
        need = []
        for k, (_, hashes) in enumerate(block):
            at = np.searchsorted(vocabulary, hashes)
            weight = idf[at].astype(float) + 0.05
            word, first, times = np.unique(at, return_index=True, return_counts=True)
            order = np.lexsort((first, -weight[first]))
            mass = (weight[first] * times)[order]
            whole = mass.sum()
            # the rare words without which the others fall short of half the least share
            rest = whole - np.cumsum(mass)
            rare = int(np.argmax(rest <= SHARE / 2 * whole)) + 1
            need.append(SHARE * whole - rest[rare - 1])
            told = min(TELLING, len(word))
            entries += [(w, k, m, i < told) for i, (w, m) in enumerate(zip(word[order[: max(rare, told)]].tolist(), mass.tolist(), strict=False))]
            self.hashes.append(hashes)
            self.weight.append(weight)
            self.telling.append(hashes[first[order[:told]]])
        self.need = np.array(need) - 1e-9
        self.least_told = np.ceil(TELLING_SHARE * np.array([len(t) for t in self.telling]))
        feature, item, mass, told = (np.array(x) for x in zip(*entries, strict=True))
        order = np.argsort(feature, kind="stable")
        self.item, self.mass, self.told = item[order], mass[order], told[order]
        self.owners = np.bincount(feature, minlength=len(vocabulary))
        self.first = np.cumsum(self.owners) - self.owners
        #: Runs that a stretch can touch.
        longest = max(len(h) for h in self.hashes)
        self.span = -(-int(STRETCH * longest + SLACK) // STRIDE) + 1


class _Blocks:
    """Runs of several documents: the run of each word, the document of each run."""

    def __init__(self, part: pa.RecordBatch):
        sizes, features = part.column("sizes"), part.column("features")
        self.doc = np.repeat(np.arange(part.num_rows), np.asarray(pc.list_value_length(sizes)))
        self.row = np.repeat(np.arange(len(self.doc)), np.asarray(sizes.flatten()))
        self.feature = np.asarray(features.flatten()).astype(np.int64)
        n = len(self.doc)
        # a passage is a run and the next one; a document's only run is a passage too
        self.joined = np.zeros(n, dtype=bool)
        self.joined[:-1] = self.doc[1:] == self.doc[:-1]
        alone = np.ones(n, dtype=bool)
        alone[1:] = self.doc[1:] != self.doc[:-1]
        self.passage = np.flatnonzero(self.joined | (alone & ~self.joined))
        self.place = np.arange(n) - np.searchsorted(self.doc, self.doc)

    def _masses(self, window: np.ndarray, feature: np.ndarray, items: _Items) -> tuple[np.ndarray, ...]:
        """Windows and items (as one number each) where the window's distinct words reach the need, with their telling words."""
        size, many = len(items.owners), len(items.need)
        window, feature = np.divmod(textops.distinct(window * size + feature), size)
        owners = items.owners[feature]
        ends = np.cumsum(owners)
        at = np.repeat(items.first[feature] - ends + owners, owners) + np.arange(int(owners.sum()))
        pairs, inverse = np.unique(np.repeat(window, owners) * many + items.item[at], return_inverse=True)
        enough = np.bincount(inverse, weights=items.mass[at], minlength=len(pairs)) >= items.need[pairs % many]
        return pairs[enough], np.bincount(inverse, weights=items.told[at], minlength=len(pairs))[enough]

    def windows(self, items: _Items) -> tuple[np.ndarray, ...]:
        """First run, runs, item and telling words of the windows where a leak of the item can be.

        A stretch lies in ``span`` runs.  First, windows of twice as many that
        begin every ``span`` runs are tried, then, where those have enough, the
        windows of ``span`` runs inside them.
        """
        span, many, none = items.span, len(items.need), np.zeros(0, np.int64)
        own = items.owners[self.feature] > 0
        row, feature = self.row[own], self.feature[own]
        begin = row - self.place[row] % span
        back = self.place[row] >= span
        row, feature, begin = np.concatenate([row, row[back]]), np.concatenate([feature, feature[back]]), np.concatenate([begin, begin[back] - span])
        wide, _ = self._masses(begin, feature, items)
        if not len(wide):
            return none, none, none, none
        left = np.zeros(len(self.doc), dtype=bool)
        left[wide // many] = True
        near = left[begin]
        row, feature, begin = row[near], feature[near], begin[near]
        # each word counts in the windows that begin up to span - 1 runs before it and not before the wide one
        shift = np.arange(span)
        start = (row[:, None] - shift).ravel()
        inside = (start >= np.repeat(begin, span)) & (start <= np.repeat(begin, span) + span)
        pairs, told = self._masses(start[inside], np.repeat(feature, span)[inside], items)
        start, item = np.divmod(pairs, many)
        stop = np.minimum(start + span, np.searchsorted(self.doc, self.doc[start], side="right"))
        # windows of one item that overlap become one
        order = np.lexsort((start, item))
        start, stop, item, told = start[order], stop[order], item[order], told[order]
        fresh = textops.changes(item)
        fresh[1:] |= start[1:] >= stop[:-1]
        if not len(start):
            return none, none, none, none
        first = np.flatnonzero(fresh)
        stop, told = np.maximum.reduceat(stop, first), np.maximum.reduceat(told, first)
        return start[first], stop - start[first], item[first], told

    def passages(self, values: np.ndarray) -> np.ndarray:
        """Run values added up for each passage."""
        out = values.copy()
        at = np.flatnonzero(self.joined)
        out[at] += values[at + 1]
        return out[self.passage]

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Passage values added up for each run."""
        out = np.zeros((len(self.doc), values.shape[1]), values.dtype)
        out[self.passage] = values
        back = self.joined[self.passage]
        out[self.passage[back] + 1] += values[back]
        return out


def _pieces(batch: pa.RecordBatch, limit: int = 4096) -> Iterator[pa.RecordBatch]:
    """Row slices with about ``limit`` blocks each."""
    if batch.num_rows:
        size = np.asarray(pc.list_value_length(batch.column("sizes")))
        cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // limit)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def _frequency_rows(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, blocks = np.zeros(size, np.int64), 0
        for batch in batches:
            for part in _pieces(batch):
                total += np.bincount(np.asarray(part.column("features").flatten()), minlength=size)
                blocks += int(pc.sum(pc.list_value_length(part.column("sizes"))).as_py() or 0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([blocks, *total[at].tolist()], pa.int64())], ["feature", "df"])

    return rows


def _product(row: np.ndarray, feature: np.ndarray, right: np.ndarray, rows: int) -> np.ndarray:
    """The sparse rows of ones times ``right``."""
    out = np.zeros((rows, right.shape[1]), np.float32)
    if len(row):
        starts = np.flatnonzero(textops.changes(row))
        out[row[starts]] = np.add.reduceat(right[feature], starts, axis=0)
    return out


def _gram_share(found: _Blocks, right: np.ndarray, weight: np.ndarray, common: np.ndarray, slot: np.ndarray, total: np.ndarray) -> None:
    """Add A'(A G) of these passages to ``total``; ``right`` is G times the weights.

    The ``common`` words, with ``slot`` their places there (-1 for others), go
    through a dense matrix, the others through sums by run and by word.
    """
    at = slot[found.feature]
    rare = at < 0
    row, feature = found.row[rare], found.feature[rare].astype(np.uint16)
    dense = np.zeros((len(found.doc), len(common)), np.float32)
    dense[found.row[~rare], at[~rare]] = 1
    seen = found.spread(found.passages(dense @ right[common] + _product(row, feature, right, len(found.doc))))
    total[common] += (dense.T @ seen) * weight[common][:, None]
    # sorting 16 bits takes time in proportion
    order = np.argsort(feature, kind="stable")
    feature = feature[order]
    starts = np.flatnonzero(textops.changes(feature))
    if len(starts):
        ids = feature[starts]
        total[ids] += np.add.reduceat(seen[row[order]], starts, axis=0) * weight[ids][:, None]


def _gram_rows(idf, basis):
    """Each task's share of A'(A G), as rows (place, values)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = idf.value
        right = basis.value * weight[:, None]
        total = np.zeros(right.shape, np.float64)
        # the most frequent words have the least weights
        common = np.argsort(weight, kind="stable")[:COMMON]
        slot = np.full(len(weight), -1)
        slot[common] = np.arange(len(common))
        for batch in batches:
            for part in _pieces(batch, GRAM_RUNS):
                _gram_share(_Blocks(part), right, weight, common, slot, total)
        at = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(c) for c in total[at].T)], ["place", *(f"y{i}" for i in range(total.shape[1]))])

    return rows


def latent_space(passages: DataFrame, item_row: np.ndarray, item_feature: np.ndarray, many: int, idf: np.ndarray, scale: float, rank: int = RANK) -> np.ndarray:
    """The leading right singular vectors (columns) of the passages and, ``scale`` times, the items."""
    sc, size = passages.sparkSession.sparkContext, len(idf)
    width = min(rank + EXTRA, size)
    shared_idf = sc.broadcast(idf)
    names = [f"y{i}" for i in range(width)]
    schema = "place int, " + ", ".join(f"{y} double" for y in names)

    def summed(basis: np.ndarray) -> np.ndarray:
        shared = sc.broadcast(basis.astype(np.float32))
        out = np.zeros((size, width))
        shares = passages.select("sizes", "features").mapInArrow(_gram_rows(shared_idf, shared), schema)
        for place, *values in shares.groupBy("place").agg(*(F.sum(y) for y in names)).collect():
            out[place] = values
        shared.destroy()
        seen = _product(item_row, item_feature, (basis * idf[:, None]).astype(np.float32), many).astype(np.float64) * scale
        np.add.at(out, item_feature, seen[item_row] * (scale * idf[item_feature])[:, None])
        return out

    basis = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, width)))[0]
    for _ in range(ROUNDS - 1):
        basis = np.linalg.qr(summed(basis))[0]
    image = summed(basis)
    shared_idf.destroy()
    core = basis.T @ image
    strength, turn = np.linalg.eigh((core + core.T) / 2)
    solid = strength > 1e-6 * max(strength.max(), 1e-30)
    vectors, strength, _ = np.linalg.svd(image @ (turn[:, solid] / np.sqrt(strength[solid])), full_matrices=False)
    lead = np.flatnonzero(strength[:rank] ** 2 > 1e-9 * max(strength.max(initial=0.0) ** 2, 1e-30))
    return vectors[:, lead].astype(np.float32)


def _search_rows(idf, basis, queries, tables, cosine: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, latent_items = tables.value, queries.value
        right = basis.value * idf.value[:, None]
        for batch in batches:
            for part in _pieces(batch):
                found = _Blocks(part)
                window, length, item, told = found.windows(items)
                # the passages of the windows that are left, and their places in the latent space
                ends = np.cumsum(length)
                run = np.repeat(window - ends + length, length) + np.arange(int(length.sum()))
                used = np.zeros(len(found.doc) + 1, dtype=bool)
                used[run] = True
                used[1:] |= used[:-1]
                here = used[found.row]
                latent = found.passages(_product(found.row[here], found.feature[here], right, len(found.doc)))
                latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
                number = np.full(len(found.doc), -1)
                number[found.passage] = np.arange(len(found.passage))
                pair = np.repeat(np.arange(len(window)), length)[number[run] >= 0]
                score = np.full(len(window), -1.0)
                at = number[run[number[run] >= 0]]
                np.maximum.at(score, pair, np.einsum("ij,ij->i", latent[at], latent_items[item[pair]]))
                good = np.flatnonzero((score >= cosine) | (told >= items.least_told[item]))
                first = window[good]
                start = found.place[first] * STRIDE
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc").take(pa.array(found.doc[first])), pa.array(start.astype(np.int32)), pa.array((start + length[good] * STRIDE).astype(np.int32)), pa.array(item[good].astype(np.int32)), pa.array(score[good])],
                    ["doc", "start", "stop", "item", "cosine"],
                )

    return rows


def weighted_lcs(left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> float:
    """Weight of the heaviest common subsequence; ``weight`` belongs to ``right``."""
    return float(_lcs([(left[np.isin(left, right)], right, weight)])[0])


def _lcs(pairs: list[tuple]) -> np.ndarray:
    """:func:`weighted_lcs` of (left, right, weight) each, all in step."""
    size = np.array([len(left) for left, _, _ in pairs])
    order = np.argsort(-size, kind="stable")
    width = max(len(right) for _, right, _ in pairs)
    lefts = np.zeros((size.max(initial=0), len(pairs)), np.int64)
    # a column a pair; places past an item's end weigh nothing
    rights, weights = np.zeros((width, len(pairs)), np.int64), np.zeros((width, len(pairs)))
    for c, k in enumerate(order.tolist()):
        left, right, weight = pairs[k]
        lefts[: len(left), c], rights[: len(right), c], weights[: len(right), c] = left, right, weight
    row = np.zeros((width + 1, len(pairs)))
    live = np.searchsorted(-size[order], -np.arange(len(lefts)), side="left")
    for x, n in zip(lefts, live.tolist(), strict=True):
        taken = row[:-1, :n] + weights[:, :n] * (rights[:, :n] == x[:n])
        np.maximum.accumulate(np.maximum(row[1:, :n], taken), axis=0, out=row[1:, :n])
    out = np.empty(len(pairs))
    out[order] = row[-1]
    return out


class _Item:
    """One item's words by number, and what the reading of a stretch needs."""

    def __init__(self, hashes: np.ndarray, weight: np.ndarray, telling: np.ndarray):
        self.known, self.word = np.unique(hashes, return_inverse=True)
        self.weight, self.whole = weight, weight.sum()
        self.mass = np.bincount(self.word, weights=weight)
        self.telling = np.searchsorted(self.known, telling)
        self.length, self.step = int(STRETCH * len(hashes) + SLACK), max(1, len(hashes) // 4)

    def stretches(self, own: np.ndarray, share: float) -> Iterator[tuple[np.ndarray, float]]:
        """The item's words in each stretch that can have ``share`` of its weight, and their weight."""
        place = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        at = np.flatnonzero(self.known[place] == own)
        if not len(at):
            return
        word = place[at]
        begin = np.arange(max(0, int(at[0]) // self.step * self.step - self.length), int(at[-1]) + 1, self.step)
        first, last = np.searchsorted(at, begin), np.searchsorted(at, begin + self.length)
        # those with the same words as the stretch before add nothing
        fresh = textops.changes(first, last) & (first < last)
        for a, b in zip(first[fresh].tolist(), last[fresh].tolist(), strict=True):
            near = word[a:b]
            there = np.bincount(near, minlength=len(self.known)) > 0
            # no subsequence weighs more than the item's words that are there
            most = self.mass[there].sum()
            if most >= share * self.whole - 1e-9 and there[self.telling].sum() >= ANSWER_SHARE * len(self.telling) - 1e-9:
                yield near, most


class _Reading:
    """The best share of each hit, its stretches read many at a time."""

    def __init__(self, share: float):
        self.share, self.best, self.waiting = share, [], []

    def add(self, item: _Item, own: np.ndarray) -> None:
        hit = len(self.best)
        self.best.append(0.0)
        for near, most in item.stretches(own, self.share):
            self.waiting.append((hit, item, near, most))
            if len(self.waiting) == TOGETHER:
                self.read()

    def read(self) -> None:
        # what was read before can be out of reach
        left = [x for x in self.waiting if x[3] >= self.best[x[0]] * x[1].whole - 1e-9]
        self.waiting = []
        if left:
            for (hit, item, _, _), weight in zip(left, _lcs([(near, item.word, item.weight) for _, item, near, _ in left]).tolist(), strict=True):
                self.best[hit] = max(self.best[hit], weight / item.whole)

    def shares(self) -> list[float]:
        """The greatest share of the item's weight in one stretch's common subsequence, by hit; 0 where no stretch is enough."""
        self.read()
        return [x if x >= self.share - 1e-9 else 0.0 for x in self.best]


def _check_rows(items, share: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own_items = items.value, {}
        for batch in batches:
            for part in textops.slices(batch, "text"):
                words, hashes = normal_words(textops.as_arrow(part.column("text")))
                reading, hits = _Reading(share), []
                for r, listed in enumerate(part.column("hits").to_pylist()):
                    own = hashes[words.first[r] : words.first[r + 1]]
                    for hit in listed:
                        k = hit["item"]
                        if k not in own_items:
                            own_items[k] = _Item(known.hashes[k], known.weight[k], known.telling[k])
                        reading.add(own_items[k], own[hit["start"] : hit["stop"]])
                        hits.append((r, k, hit["cosine"]))
                best: dict = {}
                for (r, k, cosine), covered in zip(hits, reading.shares(), strict=True):
                    if covered:
                        best[r, k] = max(best.get((r, k), (0.0, 0.0)), (covered, cosine))
                doc, item = [r for r, _ in best], [k for _, k in best]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc").take(pa.array(doc, pa.int64())), pa.array(item, pa.int32()), pa.array([x for x, _ in best.values()], pa.float64()), pa.array([x for _, x in best.values()], pa.float64())],
                    ["doc", "item", "share", "cosine"],
                )

    return rows


def _exact_rows(wanted: dict[int, tuple[np.ndarray, np.ndarray]]):
    """wanted: by number of words, the sorted sequence hashes and their items."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch, "text"):
                words, hashes = normal_words(textops.as_arrow(part.column("text")))
                doc, item = [], []
                for size, (sought, items) in wanted.items():
                    grams, valid = words.grams(hashes, size)
                    at = np.flatnonzero(valid)
                    first, last = np.searchsorted(sought, grams[at]), np.searchsorted(sought, grams[at], side="right")
                    hit = np.flatnonzero(last > first)
                    for i in hit.tolist():
                        for j in range(int(first[i]), int(last[i])):
                            doc.append(int(words.doc[at[i]]))
                            item.append(int(items[j]))
                pairs = sorted(set(zip(doc, item, strict=True)))
                ones = pa.array([1.0] * len(pairs))
                yield pa.RecordBatch.from_arrays([part.column("doc").take(pa.array([d for d, _ in pairs], pa.int64())), pa.array([i for _, i in pairs], pa.int32()), ones, ones], ["doc", "item", "share", "cosine"])

    return rows


def _parts(hashes: np.ndarray) -> list[np.ndarray]:
    """An item in parts of a passage's length; a short rest joins the part before it."""
    cuts = list(range(0, len(hashes), PASSAGE))
    if len(cuts) > 1 and len(hashes) - cuts[-1] < LEAST_WORDS:
        cuts.pop()
    return [hashes[a:b] for a, b in zip(cuts, [*cuts[1:], len(hashes)], strict=True)]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[bool, list[tuple]]]:
    """Blocks of (item id, hashes) of the items' parts, streamed to the driver; and whether they are short ones."""
    long: list[tuple] = []
    short: list[tuple] = []
    words: set = set()
    rows = benchmark.select(F.col(quoted(item_col)).alias("i"), F.col(quoted(text_col)).alias("t")).filter("t is not null")
    for item, text in rows.toLocalIterator():
        _, hashes = normal_words(pa.array([text]))
        if 0 < len(hashes) < LEAST_WORDS:
            short.append((item, hashes))
            if len(short) == BLOCK:
                yield True, short
                short = []
            continue
        for piece in _parts(hashes) if len(hashes) else ():
            if len(long) == BLOCK or len(words) + len(piece) > BLOCK_WORDS:
                yield False, long
                long, words = [], set()
            long.append((item, piece))
            words.update(piece.tolist())
    if long:
        yield False, long
    if short:
        yield True, short


_FOUND = (T.StructField("item", T.IntegerType()), T.StructField("share", T.DoubleType()), T.StructField("cosine", T.DoubleType()))


def _exact_leaks(texts: DataFrame, block: list[tuple]) -> DataFrame:
    wanted = {}
    for size in sorted({len(h) for _, h in block}):
        own = [(k, h) for k, (_, h) in enumerate(block) if len(h) == size]
        flat = textops.sequence_hashes(np.stack([h for _, h in own]))
        order = np.argsort(flat, kind="stable")
        wanted[size] = (flat[order], np.array([k for k, _ in own])[order])
    return texts.select("doc", "text").mapInArrow(_exact_rows(wanted), T.StructType([texts.schema["doc"], *_FOUND])).distinct()


def _block_leaks(texts: DataFrame, block: list[tuple], cosine: float, share: float) -> DataFrame:
    sc, kind = texts.sparkSession.sparkContext, texts.schema["doc"].dataType
    vocabulary = np.unique(np.concatenate([h for _, h in block]))
    size = len(vocabulary)
    schema = T.StructType([T.StructField("doc", kind), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("features", T.ArrayType(T.IntegerType()))])
    passages = stored(texts.select("doc", "text").mapInArrow(_block_rows(vocabulary), schema), "op9-passages")

    df, total = np.zeros(size), 1
    for feature, n in passages.select("sizes", "features").mapInArrow(_frequency_rows(size), "feature int, df long").groupBy("feature").agg(F.sum("df")).collect():
        if feature < 0:
            total = max(1, n)
        else:
            df[feature] = n
    idf = np.log((total + 1) / (df + 1)).astype(np.float32)
    items = _Items(block, vocabulary, idf)

    item_row = np.concatenate([np.full(len(np.unique(h)), k) for k, (_, h) in enumerate(block)])
    item_feature = np.concatenate([np.searchsorted(vocabulary, np.unique(h)) for _, h in block])
    space = latent_space(passages, item_row, item_feature, len(block), idf, float(np.sqrt(max(1.0, total / len(block)))))
    latent = _product(item_row, item_feature, space * idf[:, None], len(block))
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)

    hit = T.StructType([T.StructField("doc", kind), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("item", T.IntegerType()), T.StructField("cosine", T.DoubleType())])
    shared = [sc.broadcast(x) for x in (idf, space, latent, items)]
    candidates = stored(passages.mapInArrow(_search_rows(*shared, cosine), hit), "op9-candidates")
    for x in shared[:3]:
        x.destroy()
    dropped(passages)
    hits = candidates.groupBy("doc").agg(F.collect_list(F.struct("start", "stop", "item", "cosine")).alias("hits"))
    needed = _only(texts, stored(candidates.select("doc").distinct(), "op9-docs"))
    return needed.join(hits, "doc").select("doc", "text", "hits").mapInArrow(_check_rows(shared[3], share), T.StructType([T.StructField("doc", kind), *_FOUND]))


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, ``lcs_share``, ``cosine``): each document with each item it holds.

    One row per pair, with the best stretch's figures.  Null or empty texts and
    rows with a null id leak nothing; items without words or with a null text
    are not searched; items with fewer than ``LEAST_WORDS`` words are found by
    their exact sequence (both figures are then 1), longer ones than a passage
    are searched in parts; repeated rows count once.  Other columns are not
    read.  An empty table on either side gives an empty result.
    """
    texts = docs.select(F.col(quoted(id_col)).alias("doc"), F.col(quoted(text_col)).alias("text")).filter("doc is not null")
    spark, kind, item_kind = docs.sparkSession, texts.schema["doc"].dataType, benchmark.select(quoted(item_col)).schema[0].dataType
    parts = []
    for short, block in _blocks(benchmark, item_col, item_text):
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", item_kind)]))
        found = _exact_leaks(texts, block) if short else _block_leaks(texts, block, cosine, share)
        # a block's names are BLOCK rows at most
        parts.append(found.join(F.broadcast(names), "item").select("doc", "item_id", "share", "cosine"))
    if not parts:
        empty = T.StructType([T.StructField("doc", kind), T.StructField("item_id", item_kind), T.StructField("share", T.DoubleType()), T.StructField("cosine", T.DoubleType())])
        parts = [spark.createDataFrame([], empty)]
    best = reduce(DataFrame.unionByName, parts).groupBy("doc", "item_id").agg(F.max(F.struct("share", "cosine")).alias("best"))
    return best.select(F.col("doc").alias(id_col), F.col("item_id").alias(item_col), F.round("best.share", 6).alias("lcs_share"), F.round("best.cosine", 6).alias("cosine"))


def op9(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` against all of ``benchmark``."""
    return benchmark_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
