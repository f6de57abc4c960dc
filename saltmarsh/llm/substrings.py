"""Substring dedup by prefix-partitioned suffix trees.

A suffix starts at every word that has `words - 1` words after it; its first `words` words are its window. Suffixes go to
groups by a prefix of their window, each group's subtree is built in memory, and its internal nodes at least `words` deep are
the repeats: the smallest doc_id below such a node keeps the passage, the others lose it.

Two steps partition the suffixes. Between tasks the prefix is reduced to its minimizer, the three neighbouring words of
least hash in the window: neighbouring suffixes mostly share it, so they travel as one run of words, some three times the text in all
instead of `words` times. Runs are packed and compressed by group. A group of more than MOST_WINDOWS suffixes is divided once more by the minimizers (a byte of
each run tells them apart), run by run, so that each part is read as often as a small group is. What one minimizer has too many of is parted by prefixes, which are made longer (one word,
two, four, ...) where more suffixes share one, until a part fits MOST_WINDOWS; a single window that more suffixes begin with is a node by
itself, walked a blob at a time. A part's subtree is its suffixes, each to the end of its run, in sorted order with the words that
neighbours share; an internal node is a run of neighbours that share as much. A suffix loses the words down to its deepest
node below which a smaller id is too; a repeat that goes on in the next run, which all its copies have, is joined to it by its place in the
document. Words are compared, not hashes; a suffix whose window's hash is alone in its part is a leaf and left out before.

What the same task has had under a smaller id is not sent, since it repeats whatever others have: whole texts, and windows that a table of
SLOTS recent ones still holds (known by 128 bits). So each task sends a passage that many documents share a few times, and not once for each of them.

Defined cases: a null text has no words. Texts with fewer words than a window lose nothing. Rows that repeat an id are
judged each by its own text; windows of equal ids don't remove each other, nor does a document its own. A null
id is larger than all others. An empty table gives an empty result. Columns of docs pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.llm.common import contents, shuffle_partitions, slices, text_of

WINDOW, GRAM = 13, 3
#: Groups for each shuffle partition; bytes of runs that a task packs at a time.
GROUPS, PACKED_BYTES = 3, 40 << 20
#: What a group's minimizers are told apart by, where it has to be divided (a byte of each run).
KINDS = 256
#: Suffixes that one subtree is built of.
MOST_WINDOWS = 1_000_000
#: Windows that a task remembers (a power of two).
SLOTS = 1 << 20
NULL_ID = (1 << 63) - 1
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
TAG = 0xFFFFFFFF


POWERS = np.cumprod(np.full(64, ODD[0], np.uint64), dtype=np.uint64)


def hashed(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte of each word, the one after the last, and the word's hash."""
    global POWERS
    b = np.frombuffer(text, np.uint8)
    inside = (b > 32) | (b < 9) | ((b > 13) & (b < 32))
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    length = ends - starts
    if (longest := int(length.max())) > len(POWERS):
        POWERS = np.cumprod(np.full(2 * longest, ODD[0], np.uint64), dtype=np.uint64)
    first = np.cumsum(length) - length
    place = np.arange(int(first[-1] + length[-1]), dtype=np.int32) - np.repeat(first.astype(np.int32), length)
    h = np.add.reduceat((b[inside] + np.uint64(1)) * POWERS[place], first)
    h = (h ^ (h >> np.uint64(31))) * ODD[1]
    return starts, ends, h ^ (h >> np.uint64(29))


def runs(hashes: np.ndarray, window: int, lost: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of suffixes that share their minimizer and aren't lost: first suffix, the one after the last, and the minimizer."""
    grams = hashes[: len(hashes) - GRAM + 1] * ODD[0]
    for k in range(1, GRAM):
        grams = (grams ^ hashes[k : len(hashes) - GRAM + 1 + k]) * ODD[k]
    grams ^= grams >> np.uint64(32)
    width = window - GRAM + 1
    at = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(len(grams) - width + 1)
    turns = np.diff(at) != 0 if lost is None else (np.diff(at) != 0) | (lost[1:] != lost[:-1])
    first = np.concatenate(([0], np.flatnonzero(turns) + 1))
    after = np.append(first[1:], len(at))
    if lost is not None:
        stay = ~lost[first]
        first, after = first[stay], after[stay]
    return first, after, grams[at[first]]


class Recent:
    """Windows that a task had lately, each with the least id it was seen under; a slot holds the last one that falls on it."""

    def __init__(self, window: int, slots: int = SLOTS) -> None:
        self.window, self.mask = window, np.uint64(slots - 1)
        self.keys, self.checks, self.ids = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.full(slots, NULL_ID, np.int64)

    def lost(self, docs: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
        """For each document (id, its words' hashes, a window or more) which of its windows a smaller id has had."""
        sizes = [len(h) for _, h in docs]
        words = np.concatenate([h for _, h in docs])
        starts = np.array([n - self.window + 1 for n in sizes])
        begin = np.cumsum(sizes) - sizes
        at = np.arange(int(starts.sum())) + np.repeat(begin - (np.cumsum(starts) - starts), starts)
        ids = np.repeat(np.array([i for i, _ in docs], np.int64), starts)
        keys, checks = windows(words, self.window)[at], windows(words * ODD[1] ^ ODD[2], self.window)[at]
        slots = (keys >> np.uint64(20)) & self.mask
        gone = self._has(keys, checks, slots, ids)
        left = np.flatnonzero(~gone)
        left = left[np.argsort(-ids[left], kind="stable")]  # the least id is written last, and stays
        self.keys[slots[left]], self.checks[slots[left]], self.ids[slots[left]] = keys[left], checks[left], ids[left]
        gone[left] = self._has(keys[left], checks[left], slots[left], ids[left])
        return np.split(gone, np.cumsum(starts)[:-1])

    def _has(self, keys: np.ndarray, checks: np.ndarray, slots: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return (self.keys[slots] == keys) & (self.checks[slots] == checks) & (self.ids[slots] < ids)


class Packer:
    """Collects runs by group and packs them."""

    def __init__(self, level: int = 3) -> None:
        self.level = level
        self.texts: dict[int, list[bytes]] = {}
        self.heads: dict[int, list[int]] = {}
        self.kinds: dict[int, bytearray] = {}
        self.size = 0

    def add(self, group: int, text: bytes, head: tuple[int, int, int, int], kind: int = 0) -> None:
        if group not in self.texts:
            self.texts[group], self.heads[group], self.kinds[group] = [], [], bytearray()
        self.texts[group].append(text)
        self.heads[group].extend(head)
        self.kinds[group].append(kind)
        self.size += len(text) + 41

    def extend(self, group: int, texts: list[bytes], heads: Iterable[int], kinds: Iterable[int]) -> None:
        if group not in self.texts:
            self.texts[group], self.heads[group], self.kinds[group] = [], [], bytearray()
        self.texts[group] += texts
        self.heads[group].extend(heads)
        self.kinds[group].extend(kinds)
        self.size += sum(map(len, texts)) + 41 * len(texts)

    def packed(self) -> Iterator[tuple[int, bytes]]:
        press = zstandard.ZstdCompressor(level=self.level)
        for group, texts in self.texts.items():
            head = np.array(self.heads[group], np.int64).reshape(-1, 4)
            head[1:, 0] -= head[:-1, 0].copy()
            parts = [head[:, 0].tobytes(), *[head[:, k].astype(np.uint32).tobytes() for k in (1, 2, 3)], bytes(self.kinds[group])]
            yield group, press.compress(len(texts).to_bytes(8, "little") + b"".join(parts) + b" ".join(texts))
        self.__init__(self.level)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """ids, tags, first words and numbers of words of the runs, and their text."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    ids = np.cumsum(np.frombuffer(raw, np.int64, n, 8))
    rest = [np.frombuffer(raw, np.uint32, n, 8 + 8 * n + 4 * n * k).astype(np.int64) for k in range(3)]
    return ids, *rest, raw[8 + 21 * n :]


def kinds_of(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each run, and its number of words."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    return np.frombuffer(raw, np.uint8, n, 8 + 20 * n), np.frombuffer(raw, np.uint32, n, 8 + 16 * n).astype(np.int64)


def divided(blobs: list[bytes], window: int, most: int) -> Iterator[tuple[list[bytes], int]]:
    """The blobs of a group and the number of its suffixes, or if these are more than `most`, its runs in new blobs, list by list: each of neighbouring kinds that
    have no more suffixes together, or of one kind. Equal windows are in one list, as their minimizers are equal. Blobs that are divided are taken from the list, so that they
    aren't held twice."""
    sizes = np.zeros(KINDS, np.int64)
    for blob in blobs:
        kinds, n = kinds_of(blob)
        sizes += np.bincount(kinds, n - window + 1, KINDS).astype(np.int64)
    to, last, held = np.zeros(KINDS, np.int64), 0, 0
    for kind, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            last, held = last + 1, 0
        to[kind], held = last, held + size
    if not last:
        yield blobs, int(sizes.sum())
        return
    lists: list[list[bytes]] = [[] for _ in range(last + 1)]
    packer = Packer(level=1)

    def flush() -> None:
        for part, blob in packer.packed():
            lists[part].append(blob)

    while blobs:
        (kinds, _), (ids, tags, first, n, text) = kinds_of(blobs[-1]), unpacked(blobs.pop())
        b = np.frombuffer(text, np.uint8)
        inside = (b > 32) | (b < 9) | ((b > 13) & (b < 32))
        starts = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0) == 1)[np.cumsum(n) - n]
        begins, ends = starts.tolist(), np.append(starts[1:] - 1, len(text)).tolist()
        heads, part_of = np.stack([ids, tags, first, n], axis=1), to[kinds]
        for part in np.unique(part_of).tolist():
            own = np.flatnonzero(part_of == part)
            packer.extend(part, [text[begins[k] : ends[k]] for k in own.tolist()], heads[own].ravel().tolist(), kinds[own].tobytes())
        if packer.size > PACKED_BYTES:
            flush()
    flush()
    for part in range(last, -1, -1):
        yield lists.pop(), int(sizes[to == part].sum())


class Subtree:
    """The suffix tree of a part, as its suffixes in order and the number of words that each shares with the next.

    words: a row of word numbers for each suffix, padded behind its own `length` of words, which reaches to the end of its run.
    """

    def __init__(self, words: np.ndarray, length: np.ndarray) -> None:
        self.order = _ordered(words)
        words, length = words[self.order], length[self.order]
        same = words[1:] == words[:-1]
        shared = np.where(same.all(axis=1), words.shape[1], same.argmin(axis=1))
        self.common = np.minimum(shared, np.minimum(length[1:], length[:-1]))

    def nodes(self, depth: int) -> np.ndarray:
        """Where the subtrees begin, in order, that hang below `depth` words: one suffix each, or an internal node with all its suffixes."""
        return np.concatenate(([0], np.flatnonzero(self.common < depth) + 1))

    def repeats(self) -> Iterator[tuple[int, np.ndarray]]:
        """The internal nodes, deepest first: their depth and their suffixes. No word follows all suffixes of a node, so a repeat ends there."""
        for depth in np.unique(self.common)[::-1].tolist():
            begins = self.nodes(depth)
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(self.order)]):
                if b - a > 1 and self.common[a : b - 1].min() == depth:
                    yield depth, self.order[a:b]

    def lost(self, ids: np.ndarray, least: int) -> np.ndarray:
        """For each suffix, the depth of its deepest node that a smaller id has a suffix of too; 0 if that is less than `least`."""
        ids, deep = ids[self.order], np.zeros(len(self.order), np.int64)
        for depth in range(least, int(self.common.max(initial=0)) + 1):
            begins = self.nodes(depth)
            below = np.repeat(np.minimum.reduceat(ids, begins), np.diff(np.append(begins, len(ids))))
            deep[ids > below] = depth
        found = np.zeros(len(deep), np.int64)
        found[self.order] = deep
        return found


def _ordered(words: np.ndarray) -> np.ndarray:
    """The rows in order. Neighbouring columns are sorted by as one number, as many as 63 bits hold."""
    bits = max(1, int(words.max(initial=0) + 1).bit_length())
    keys = []
    for k in range(0, words.shape[1], each := 63 // bits):
        key = np.zeros(len(words), np.int64)
        for column in words.T[k : k + each]:
            key = (key << bits) | (column + 1)
        keys.append(key)
    return np.lexsort(keys[::-1])


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each place of the `size` words from there on; the last places have none."""
    n = len(hashes) - size + 1
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = (h ^ hashes[k : k + n]) * ODD[0]
        h ^= h >> np.uint64(29)
    return h


class Prefixes:
    """The parts of a group. Suffixes are told apart by prefixes of one word, two, four, ... a window, each as long as
    it takes until half of `most` suffixes or fewer have it; neighbouring prefixes share a part of `most` suffixes at most.
    """

    def __init__(self, blobs: list[bytes], window: int, most: int) -> None:
        self.parts, self.levels, self.common = 0, [], np.zeros(0, np.uint64)
        half, shorter, length, above = max(1, most // 2), 0, 1, None
        while True:
            keys, counts = self._counted(blobs, window, length, shorter, above)
            fits = counts <= half
            part = (np.cumsum(counts[fits]) - counts[fits]) // half
            part = np.cumsum(np.diff(part, prepend=part[:1]) > 0) + self.parts
            self.levels.append((length, keys[fits], part))
            self.parts = int(part[-1]) + 1 if len(part) else self.parts
            above = keys[~fits]
            if length == window or not len(above):
                self.common = above  # windows that more suffixes begin with: nodes that no part can hold
                return
            shorter, length = length, min(window, 2 * length)

    @staticmethod
    def _counted(blobs: list[bytes], window: int, length: int, shorter: int, above: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for blob in blobs:
            *_, n, text = unpacked(blob)
            h, at = hashed(text)[2], _suffixes(n, window)[1]
            if above is not None:
                at = at[np.isin(windows(h, shorter)[at], above)]
            own, times = np.unique(windows(h, length)[at], return_counts=True)
            keys, back = np.unique(np.concatenate([keys, own]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, times])).astype(np.int64)
        return keys, counts

    def of(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The part of each suffix; -1 for those of a node that is larger than a part."""
        part = np.full(len(at), -1)
        for length, keys, parts in self.levels:
            if len(keys):
                own = windows(h, length)[at]
                near = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                part = np.where((part < 0) & (keys[near] == own), parts[near], part)
        return part


def repeats(blobs: list[bytes], window: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a group, the passages that a smaller id has too: ids, tags, first words, and the words after the last. Blobs of a group that is divided are taken from the list."""
    for some, total in divided(blobs, window, most):
        yield from _repeats(some, total, window, most)


def _repeats(blobs: list[bytes], total: int, window: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The same of blobs that are judged together."""
    prefixes = Prefixes(blobs, window, most) if total > most else None
    for part in range(prefixes.parts if prefixes else min(total, 1)):
        # leaves first: suffixes whose window's hash is alone
        found = []
        for blob in blobs:
            *_, n, text = unpacked(blob)
            starts, ends, h = hashed(text)
            at = _suffixes(n, window)[1]
            if prefixes:
                at = at[prefixes.of(h, at) == part]
            # a group in parts is large: its words are found again for the few that need them
            found.append((at, windows(h, window)[at], None if prefixes else (starts.astype(np.int32), ends.astype(np.int32))))
        h = np.sort(np.concatenate([x for _, x, _ in found]))
        twice = np.unique(h[1:][h[1:] == h[:-1]])
        if not len(twice):
            continue
        # then the tree of the others
        numbers: dict[bytes, int] = {}
        rows, lengths, where = [], [], []
        for blob, (at, own, edges) in zip(blobs, found):
            near = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
            chosen = at[twice[near] == own]
            if not len(chosen):
                continue
            ids, tags, first, n, text = unpacked(blob)
            run, every = _suffixes(n, window)
            k = np.searchsorted(every, chosen)
            begin = (np.cumsum(n) - n)[run[k]]
            offset, length = chosen - begin, begin + n[run[k]] - chosen
            starts, ends = edges or hashed(text)[:2]
            inside = np.arange(int(length.max())) < length[:, None]
            used, back = np.unique((chosen[:, None] + np.arange(inside.shape[1]))[inside], return_inverse=True)
            codes = np.array([numbers.setdefault(text[a:b], len(numbers)) for a, b in zip(starts[used].tolist(), ends[used].tolist())], np.int32)
            words = np.full(inside.shape, -1, np.int32)
            words[inside] = codes[back]
            rows.append(words)
            lengths.append(length)
            where.append(np.stack([ids[run[k]], tags[run[k]], first[run[k]] + offset]))
        width = max(words.shape[1] for words in rows)
        padded = [np.pad(words, ((0, 0), (0, width - words.shape[1])), constant_values=-1) for words in rows]
        place = np.concatenate(where, axis=1)
        deep = Subtree(np.concatenate(padded), np.concatenate(lengths)).lost(place[0], window)
        yield from _spans_of(*place[:, deep > 0], deep[deep > 0])
    if prefixes and len(prefixes.common):
        yield from _of_one_node(blobs, window, prefixes)


def _of_one_node(blobs: list[bytes], window: int, prefixes: Prefixes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Passages of windows that more suffixes begin with than a part may have: their least ids first, then what has them, a blob at a time."""
    least: dict[bytes, int] = {}
    for last in (False, True):
        for blob in blobs:
            ids, tags, first, n, text = unpacked(blob)
            starts, ends, h = hashed(text)
            run, at = _suffixes(n, window)
            own = prefixes.of(h, at) < 0
            run, at = run[own], at[own]
            passages = [b" ".join(text[a:b].split()) for a, b in zip(starts[at].tolist(), ends[at + window - 1].tolist())]
            if last:
                lost = ids[run] > np.array([least[p] for p in passages], np.int64)
                begin = (np.cumsum(n) - n)[run]
                yield from _spans_of(ids[run][lost], tags[run][lost], (first[run] + at - begin)[lost], np.full(int(lost.sum()), window))
            else:
                for i, passage in zip(ids[run].tolist(), passages):
                    least[passage] = min(i, least.get(passage, i))


def _suffixes(n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The run and the place among all words of each suffix, of runs with n words."""
    starts = n - window + 1
    run = np.repeat(np.arange(len(n)), starts)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(starts) - starts, starts) + np.repeat(np.cumsum(n) - n, starts)


def _spans_of(i: np.ndarray, tag: np.ndarray, first: np.ndarray, deep: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Passages of `deep` words from first on, those joined that overlap or touch."""
    if not len(i):
        return
    order = np.lexsort((first, tag, i))
    i, tag, first, last = i[order], tag[order], first[order], (first + deep)[order]
    text = np.cumsum(np.concatenate(([0], (np.diff(i) != 0) | (np.diff(tag) != 0))))
    reach = np.maximum.accumulate(last + (text << 40)) - (text << 40)  # the furthest word so far of the same text
    begins = np.flatnonzero(np.concatenate(([True], (np.diff(text) > 0) | (first[1:] > reach[:-1]))))
    yield i[begins], tag[begins], first[begins], reach[np.append(begins[1:], len(i)) - 1]


def _tag(text: Column) -> Column:
    return F.xxhash64(text).bitwiseAND(F.lit(TAG))


def _spans(docs: DataFrame, window: int, most: int, slots: int) -> DataFrame:
    """(id, tag, first, last) of repeated passages of docs (id, content)."""
    n = shuffle_partitions(docs.sparkSession)
    groups = GROUPS * n

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen, recent = Packer(), {}, Recent(window, slots)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["group", "blob", "id", "tag", "first", "last"])

        for whole in batches:
            for batch in slices(whole):
                told, docs = [], []
                for i, text in zip(batch.column(0).to_pylist(), contents(batch.column(1))):
                    begin, end, h = hashed(text)
                    if len(h) < window:
                        continue
                    i, key = NULL_ID if i is None else i, xxhash.xxh3_128_digest(text)
                    tag = xxhash.xxh64_intdigest(text, 42) & TAG
                    if (before := seen.get(key)) is not None and before <= i:
                        if before < i:
                            told.append((i % groups, None, i, tag, 0, len(h)))
                        continue
                    seen[key] = i
                    docs.append((i, tag, text, begin, end, h))
                for (i, tag, text, begin, end, h), lost in zip(docs, recent.lost([(d[0], d[5]) for d in docs]) if docs else []):
                    edges = np.flatnonzero(np.diff(lost.view(np.int8), prepend=0, append=0)).tolist()
                    told += [(i % groups, None, i, tag, a, b + window - 1) for a, b in zip(edges[::2], edges[1::2])]
                    first, after, least = runs(h, window, lost)
                    starts, stops = begin[first].tolist(), end[after + window - 2].tolist()
                    to = (((least * ODD[2]) >> np.uint64(20)) % np.uint64(groups)).tolist()
                    kinds = (((least * ODD[1]) >> np.uint64(40)) % np.uint64(KINDS)).tolist()
                    for g, kind, a, b, f, e in zip(to, kinds, starts, stops, first.tolist(), after.tolist()):
                        packer.add(g, text[a:b], (i, tag, f, e - f + window - 1), kind)
                    if packer.size > PACKED_BYTES:
                        for g, blob in packer.packed():
                            yield out([(g, blob, None, None, None, None)])
                if told:
                    yield out(told)
        rows = [(g, blob, None, None, None, None) for g, blob in packer.packed()]
        for k in range(0, len(rows), 100):
            yield out(rows[k : k + 100])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        group = None

        def out(*columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "tag", "first", "last"])

        for whole in batches:
            for batch in slices(whole, 64):
                told = []
                for g, blob, i, tag, first, last in zip(*[c.to_pylist() for c in batch.columns]):
                    if blob is None:
                        told.append((i, tag, first, last))
                        continue
                    if g != group:
                        for found in repeats(held, window, most):
                            yield out(*found)
                        held, group = [], g
                    held.append(blob)
                if told:
                    yield out(*zip(*told))
        for found in repeats(held, window, most):
            yield out(*found)

    packed = docs.mapInArrow(pack, "group int, blob binary, id long, tag long, first long, last long")
    return packed.repartition(n, "group").sortWithinPartitions("group").mapInArrow(find, "id long, tag long, first long, last long")


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, most: int = MOST_WINDOWS, slots: int = SLOTS) -> DataFrame:
    """Adds n_words, n_removed, removed (spans of words, as first and last + 1) and kept_text, the other words joined by blanks; columns of these names are replaced."""
    if window <= GRAM:
        raise ValueError(f"a window has more than {GRAM} words")
    new = ["n_words", "n_removed", "removed", "kept_text"]
    kept = [c for c in docs.columns if c not in new or c in (doc_id, text)]
    ids = F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))
    spans = _spans(docs.select(F.col(doc_id).cast("long").alias("id"), text_of(text).alias("content")), window, most, slots)
    by_row = spans.groupBy(F.col("id").alias("__id"), F.col("tag").alias("__tag")).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("__spans"))
    plain = docs.select(*[docs[f"`{c}`"] for c in kept]).withColumns({"__own": ids, "__own_tag": _tag(text_of(text))})
    joined = plain.join(by_row, (F.col("__own") == F.col("__id")) & (F.col("__own_tag") == F.col("__tag")), "left").select(*[F.col(f"`{c}`") for c in kept], "__spans")
    fields = [f for f in docs.schema.fields if f.name in kept]
    span = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(span)), T.StructField("kept_text", T.StringType())])
    at = kept.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for whole in batches:
            for batch in slices(whole):
                columns: list[list] = [[], [], [], []]
                for content, found in zip(contents(batch.column(at)), batch.column(len(kept)).to_pylist()):
                    words, merged, rest, done = content.split(), [], [], 0
                    for s in found or []:
                        if merged and s["first"] <= merged[-1]["last"]:
                            merged[-1]["last"] = max(merged[-1]["last"], s["last"])
                        else:
                            merged.append(dict(s))
                    for s in merged:
                        rest += words[done : s["first"]]
                        done = s["last"]
                    rest += words[done:]
                    for column, value in zip(columns, (len(words), len(words) - len(rest), merged, b" ".join(rest).decode())):
                        column.append(value)
                types = [pa.int64(), pa.int64(), arrow, pa.string()]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *[pa.array(c, t) for c, t in zip(columns, types)]], names=schema.names)

    return joined.mapInArrow(cut, schema)
