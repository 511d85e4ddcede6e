"""Removal of repeated byte strings by a hash-compared suffix sort.

Every string of LENGTH bytes belongs to the smallest of the hashes of its GRAM-byte
substrings, wherever it stands, so equal strings meet under one hash, and neighbouring
strings of a text that share theirs travel as one segment.

1. Blocks send their distinct smallest hashes; those met in two documents come back.
2. Blocks send their distinct segments under such hashes, with the smallest and largest
   document that has each. Under a hash the suffixes behind its substring, and the
   reversed ones before it, are sorted. Prefix polynomial hashes and binary search find
   the common extension of two suffixes, so that a comparison takes a logarithmic number
   of steps; merges compare whole runs at once. The extensions common to neighbours of
   both orders, verified on the bytes, tell which strings are equal, in equal segments
   as in others, and the smallest document of each goes back.
3. A string is removed in every document with a number above that one.

A hash with more than HOT segments, whose group would be too large for a task, is dealt
anew by its strings: a grouped minimum, combined before the shuffle, that is exact too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocked, release
from .storage import stored
from .textkernels import column_bytes, mix, pieces, powers, prefix_hashes

LENGTH = 50
GRAM = 24
#: Strings of one segment at most; longer runs under one hash, as in periodic texts, are cut.
RUN = 256
#: Segments of one hash that are sorted in one task.
HOT = 1 << 15
#: Bytes of segments sorted at once (or one hash's), and hashes looked through at once.
SORTED, MET = 2 << 20, 1 << 20
_MARK = np.uint64(16)
_COUNT = 14
_SALTS = 16


def extensions(data: np.ndarray, starts: np.ndarray, limit: int) -> np.ndarray:
    """Prefix polynomial hashes of the first 0 to limit bytes of every suffix, a row each."""
    prefix = prefix_hashes(data)
    _, inverse = powers(len(prefix))
    out = prefix[starts[:, None] + np.arange(limit + 1)]
    out -= out[:, :1].copy()
    out *= inverse[starts][:, None]
    return out


def common_extension(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length over which the suffixes numbered a and b agree, by binary search on their prefix hashes."""
    width = hashes.shape[1]
    flat, a, b = hashes.ravel(), a * width, b * width
    low, high = np.zeros(len(a), np.int64), np.full(len(a), width - 1, np.int64)
    for _ in range(int(width - 1).bit_length()):
        middle = (low + high + 1) >> 1
        same = flat[a + middle] == flat[b + middle]
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def suffix_order(data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """Order of the suffixes at starts, group by group, by the bytes (at least 8) that have hashes: a stable merge sort.

    Runs begin as those that share group and eight bytes; in each, halves are merged, the
    place of every element in the other half being found by comparisons through common
    extensions.
    """
    limit = hashes.shape[1] - 1
    key = np.zeros(len(starts), np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | data[starts + j].astype(np.uint64)
    order = np.argsort(key, kind="stable") if group is None else np.lexsort((key, group))
    key = key[order]
    same = key[1:] == key[:-1]
    if group is not None:
        same &= group[order][1:] == group[order][:-1]
    new = np.flatnonzero(np.concatenate([[True], ~same])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([new, [len(key)]]))
    many = size > 1
    first, size = new[many], size[many]
    width = 1
    while len(first):
        base, length = np.repeat(first, size), np.repeat(size, size)
        local = np.arange(len(base)) - np.repeat(np.cumsum(size) - size, size)
        run = local // width
        other = (run ^ 1) * width
        count = np.clip(length - other, 0, width)
        right = (run & 1).astype(bool)
        own = order[base + local]
        low, high = np.zeros(len(base), np.int64), count.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            there = order[base[open_] + other[open_] + middle]
            x = own[open_]
            same = common_extension(hashes, there, x)
            past = np.minimum(same, limit - 1)
            p, q = data[starts[there] + past], data[starts[x] + past]
            before = np.where(same == limit, right[open_], p < q)  # equal: the left half stays first
            low[open_] = np.where(before, middle + 1, low[open_])
            high[open_] = np.where(before, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        place = base + (run >> 1) * (2 * width) + local - run * width + low
        order[place] = own
        width *= 2
        keep = size > width
        first, size = first[keep], size[keep]
    return order


def sorted_suffixes(data: np.ndarray, starts: np.ndarray, limit: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes, and what each has in common with the one before: up to limit, -1 with another group.

    Every neighbour is verified: the bytes in common are equal and the next are in order,
    which proves the whole order. If hashes ever deceived, the bytes are sorted instead.
    """
    hashes = extensions(data, starts, limit)
    order = suffix_order(data, hashes, starts, group)
    common = np.full(len(order), -1, np.int64)
    at = np.flatnonzero(group[order][1:] == group[order][:-1]) + 1
    common[at] = common_extension(hashes, order[at - 1], order[at])
    span = np.arange(limit)
    for i in range(0, len(at), 1 << 16):
        part = at[i : i + (1 << 16)]
        p, q = data[starts[order[part - 1], None] + span], data[starts[order[part], None] + span]
        differ = p != q
        where = np.where(differ.any(axis=1), differ.argmax(axis=1), limit)
        edge = np.minimum(where, limit - 1)
        row = np.arange(len(part))
        if not ((where == common[part]) & ((where == limit) | (p[row, edge] < q[row, edge]))).all():
            return _by_bytes(data, starts, limit, group)
    return order, common


def _by_bytes(data: np.ndarray, starts: np.ndarray, limit: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = data[starts[:, None] + np.arange(limit)]
    order = np.lexsort((*rows.T[::-1], group))
    differ = rows[order][1:] != rows[order][:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), limit)
    common[group[order][1:] != group[order][:-1]] = -1
    return order, np.concatenate([[-1], common])


class Segments:
    """Runs of neighbouring strings that share their smallest hash, over the documents of a block."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        self.prefix = prefix_hashes(data)
        n = len(data)
        none = np.zeros(0, np.int64)
        self.hash, self.first, self.count, self.doc = none.astype(np.uint64), none, none, none
        if n < LENGTH:
            return
        _, inverse = powers(n + 1)
        h = mix((self.prefix[GRAM:] - self.prefix[:-GRAM]) * inverse[: n + 1 - GRAM])
        width, low = LENGTH - GRAM + 1, h
        step = 1
        while step * 2 <= width:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if step < width:
            low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
        m = n - LENGTH + 1
        low = low[:m]
        lengths = np.diff(offsets)
        usable = np.zeros(n + 1, np.int64)
        wide = lengths >= LENGTH
        np.add.at(usable, offsets[:-1][wide], 1)
        np.add.at(usable, (offsets[1:] - LENGTH + 1)[wide], -1)
        valid = np.cumsum(usable)[:m] > 0
        start = valid.copy()
        start[1:] &= ~(valid[:-1] & (low[1:] == low[:-1]))
        start[offsets[:-1][wide]] = True
        first = np.flatnonzero(start)
        stop = np.flatnonzero(valid & np.concatenate([start[1:] | ~valid[1:], [True]])) + 1
        count = stop - first
        if (count > RUN).any():
            parts = -(-count // RUN)
            at = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            first, stop = np.repeat(first, parts) + at * RUN, np.repeat(stop, parts)
            count = np.minimum(RUN, stop - first)
        self.first, self.count, self.hash = first, count, low[first]
        self.doc = np.searchsorted(offsets, first, side="right") - 1

    def chosen(self, keep: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the segments in keep: hash, first, count, doc, and the number of the distinct segment.

        Distinct segments are numbered in the order of hash, hash of all bytes and count: it
        does not depend on the order of documents.
        """
        first, count, h, doc = self.first[keep], self.count[keep], self.hash[keep], self.doc[keep]
        _, inverse = powers(len(self.prefix))
        whole = (self.prefix[first + count + LENGTH - 1] - self.prefix[first]) * inverse[first]
        order = np.lexsort((count, whole, h))
        key = np.stack([h, whole, count.astype(np.uint64)])[:, order]
        new = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]) if len(order) else np.zeros(0, bool)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        return h, first, count, doc, number


def gathered(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of spans end to end, and their offsets."""
    offsets = np.concatenate([[0], np.cumsum(length)])
    at = np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], length)
    return data[at], offsets


def _answers(block: np.ndarray, values: np.ndarray, kind: int) -> pa.RecordBatch:
    """Values (one or more columns) sorted into one row for each block."""
    order = np.argsort(block, kind="stable")
    block, values = block[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
    stop = np.concatenate([first[1:], [len(block)]]).astype(np.int64) if len(first) else first
    return pa.RecordBatch.from_arrays(
        [pa.array(block[first], pa.int32()), pa.array(np.full(len(first), kind), pa.int32()), pa.array([values[i:j].tobytes() for i, j in zip(first, stop, strict=True)], pa.binary())],
        names=["block", "kind", "found"],
    )


def _sent(table: pa.Table, sent: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Ids, bytes and offsets of a block's documents but for copies, and the answers by kind."""
    found: dict[int, list[np.ndarray]] = {}
    for kind, blob in zip(sent.column("kind").to_pylist(), sent.column("found").to_pylist(), strict=True):
        found.setdefault(kind, []).append(np.frombuffer(blob, np.int64))
    answers = {k: np.concatenate(v) for k, v in found.items()}
    ids = table.column("id").to_numpy().astype(np.int64)
    digests = table.column("digest").to_pylist()
    copies = set(answers.get(0, np.zeros(0, np.int64)).tolist())
    rows, seen = [], set()
    for r in range(len(ids)):
        if (ids[r], digests[r]) not in seen and _copy_key(int(ids[r]), digests[r]) not in copies:
            rows.append(r)
            seen.add((ids[r], digests[r]))
    rows = np.array(sorted(rows, key=lambda r: (ids[r], digests[r])), np.int64)
    data, offsets = column_bytes(table.column("text").take(pa.array(rows)))
    return ids[rows], data, offsets, answers | {-1: rows}


def _copy_key(number: int, digest: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(digest, digest_size=8, key=number.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)


def _smallest(key: tuple, docs: pa.Table, sent: pa.Table) -> pa.Table:
    """Each smallest hash of a block once, with how many segments have it and, as the last bit, whether two documents have."""
    if not docs.num_rows:
        return pa.table({"h": pa.array([], pa.int64()), "block": pa.array([], pa.int32())})
    _, data, offsets, _ = _sent(docs, sent)
    s = Segments(data, offsets)
    order = np.lexsort((s.doc, s.hash))
    h, doc = s.hash[order] >> _MARK, s.doc[order]
    new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    lo, hi = (f.reduceat(doc, first) if len(first) else first for f in (np.minimum, np.maximum))
    count = np.minimum(np.diff(np.concatenate([first, [len(h)]])), (1 << _COUNT) - 1)
    out = (((h[first].astype(np.int64) << _COUNT) | count) << 1) | (lo != hi)
    return pa.table({"h": pa.array(out, pa.int64()), "block": pa.array(np.full(len(out), key[0].as_py()), pa.int32())})


def _whole_keys(batches: Iterator[pa.RecordBatch], column: str, enough) -> Iterator[pa.Table]:
    """Rows sorted by a key, in tables that hold every row of their keys and are closed once enough(table) says so."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if enough(rows, size):
            table = pa.Table.from_batches(held)
            keys = table.column(column).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield table.slice(0, cut)
                rest = table.slice(cut).combine_chunks()
                held = rest.to_batches()
                rows, size = rest.num_rows, rest.nbytes
    if held:
        yield pa.Table.from_batches(held)


def _repeated(hot: int):
    """Of hashes in order, those that two documents have, to the blocks that have them: kind 1, or 3 with more than hot segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_keys(batches, "plain", lambda rows, size: rows >= MET):
            h, plain, block = (table.column(c).to_numpy() for c in ("h", "plain", "block"))
            first = np.flatnonzero(np.concatenate([[True], plain[1:] != plain[:-1]]))
            size = np.diff(np.concatenate([first, [len(h)]]))
            met = (size > 1) | (np.maximum.reduceat(h & 1, first) > 0)
            count = (h >> 1) & ((1 << _COUNT) - 1)
            many = (np.add.reduceat(count, first) > hot) | (np.maximum.reduceat(count, first) == (1 << _COUNT) - 1)
            for kind, chosen in ((1, met & ~many), (3, met & many)):
                if chosen.any():
                    keep = np.repeat(chosen, size)
                    yield _answers(block[keep], plain[keep], kind)

    return run


def _known(s: Segments, answers: dict[int, np.ndarray], kinds: tuple[int, ...] = (1, 3)) -> np.ndarray:
    marks = np.unique(np.concatenate([answers.get(k, np.zeros(0, np.int64)) for k in kinds]))
    if not len(marks):
        return np.zeros(0, np.int64)
    h = (s.hash >> _MARK).astype(np.int64)
    return np.flatnonzero(marks[np.minimum(np.searchsorted(marks, h), len(marks) - 1)] == h)


def _binaries(body: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])


def _segments(hot: bool):
    """A block's distinct segments; with hot, the strings of those under hot hashes, `at` being the place in the segment."""

    def run(key: tuple, docs: pa.Table, sent: pa.Table) -> pa.Table:
        names = ["h", "segment", "lo", "hi", "block", "number", "at"]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        if not docs.num_rows or not sent.num_rows:
            return pa.table({n: pa.array([], k) for n, k in zip(names, kinds, strict=True)})
        ids, data, offsets, answers = _sent(docs, sent)
        s = Segments(data, offsets)
        h, first, count, doc, number = s.chosen(_known(s, answers))
        order = np.argsort(number, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], number[order][1:] != number[order][:-1]])) if len(order) else order
        who = ids[doc[order]]
        lo, hi = (f.reduceat(who, at) if len(at) else who for f in (np.minimum, np.maximum))
        one = order[at]
        mark, heads = (h[one] >> _MARK).astype(np.int64), np.unique(answers.get(3, np.zeros(0, np.int64)))
        use = np.isin(mark, heads) == hot
        one, lo, hi = one[use], lo[use], hi[use]
        start, length, place = first[one], count[one] + LENGTH - 1, np.zeros(len(one), np.int64)
        if hot:
            row = np.repeat(np.arange(len(one)), count[one])
            place = np.arange(len(row)) - np.repeat(np.cumsum(count[one]) - count[one], count[one])
            start, length, lo, hi, one = start[row] + place, np.full(len(row), LENGTH), lo[row], hi[row], one[row]
        segment = _binaries(*gathered(data, start, length))
        values = [pa.array(h[one].view(np.int64)), segment, pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(np.full(len(one), key[0].as_py()), pa.int32()), pa.array(number[one], pa.int64()), pa.array(place, pa.int64())]
        return pa.table(dict(zip(names, values, strict=True)))

    return run


def anchors(h: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the substring with the hash of a segment stands: (segment, place, first, last string it is the leftmost one in)."""
    prefix = prefix_hashes(data)
    _, inverse = powers(len(prefix))
    owner = np.repeat(np.arange(len(h)), np.diff(offsets))
    grams = mix((prefix[GRAM:] - prefix[:-GRAM]) * inverse[: len(prefix) - GRAM])
    place = np.flatnonzero(grams == h.view(np.uint64)[owner[: len(grams)]])
    of = owner[place]
    inside = place + GRAM <= offsets[of + 1]
    place, of = place[inside], of[inside]
    after = np.full(len(place), -1, np.int64)
    if len(place):
        after[1:] = np.where(of[1:] == of[:-1], place[:-1], -1)
    first = np.maximum(np.maximum(after + 1, place - (LENGTH - GRAM)), offsets[of])
    last = np.minimum(place, offsets[of + 1] - LENGTH)
    some = first <= last
    return of[some], place[some], first[some], last[some]


def least_documents(h: np.ndarray, data: np.ndarray, offsets: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For segments in the order of their hashes: runs (segment, first string, stop, smallest document) over all of each one's strings.

    A string is known by the place of its substring in it, by what stands before that and
    by what stands behind. Equal strings are therefore neighbours, over as many bytes as
    they have there, in the order of the suffixes behind and in that of the reversed ones before.
    """
    of, place, first, last = anchors(h, data, offsets)
    n, wide = len(place), LENGTH - GRAM
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    padded = np.concatenate([data, np.zeros(LENGTH, np.uint8)])
    _, group = np.unique(h[of], return_inverse=True)
    inside = padded[place[:, None] + np.arange(GRAM)].view(f"V{GRAM}").ravel()
    if (inside[1:] != inside[:-1])[group[1:] == group[:-1]].any():  # two substrings share a hash
        _, group = np.unique(np.stack([group, np.unique(inside, return_inverse=True)[1]], axis=1), axis=0, return_inverse=True)
    behind, common = sorted_suffixes(padded, place + GRAM, wide, group)
    reverse = np.concatenate([data[::-1], np.zeros(LENGTH, np.uint8)])
    before, shared = sorted_suffixes(reverse, len(data) - place, wide, group)
    at_behind, at_before = np.empty(n, np.int64), np.empty(n, np.int64)
    at_behind[behind], at_before[before] = np.arange(n), np.arange(n)
    index = np.arange(n)
    size = last - first + 1
    ends = np.concatenate([[0], np.cumsum(size)])
    best = np.empty(ends[-1], np.int64)
    least = lo[of]
    for k in range(wide + 1):  # strings in which the substring stands behind k bytes
        rows = np.flatnonzero((place - last <= k) & (k <= place - first))
        if not len(rows):
            continue
        left = np.maximum.accumulate(np.where(shared < k, index, 0))[at_before[rows]]
        right = np.maximum.accumulate(np.where(common < wide - k, index, 0))[at_behind[rows]]
        key = left * n + right
        order = np.argsort(key)
        key = key[order]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        smallest = np.minimum.reduceat(least[rows[order]], edge)
        out = np.empty(len(rows), np.int64)
        out[order] = np.repeat(smallest, np.diff(np.concatenate([edge, [len(rows)]])))
        best[ends[rows] + place[rows] - k - first[rows]] = out
    row = np.repeat(of, size)
    string = np.arange(ends[-1]) - np.repeat(ends[:-1] - first, size) - offsets[row]
    cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (best[1:] != best[:-1])]))
    stop = np.concatenate([cut[1:], [len(row)]])
    return row[cut], string[cut], string[stop - 1] + 1, best[cut]


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for table in _whole_keys(batches, "h", lambda rows, size: size >= SORTED):
        data, offsets = column_bytes(table.column("segment"))
        row, a, b, best = least_documents(table.column("h").to_numpy(), data, offsets, table.column("lo").to_numpy())
        use = best < table.column("hi").to_numpy()[row]
        row, a, b, best = row[use], a[use], b[use], best[use]
        held.append((table.column("block").to_numpy()[row], np.stack([table.column("number").to_numpy()[row], a, b, best], axis=1)))
        if sum(len(x) for x, _ in held) >= MET:
            yield _answers(*(np.concatenate(x) for x in zip(*held, strict=True)), 2)
            held = []
    if held:
        yield _answers(*(np.concatenate(x) for x in zip(*held, strict=True)), 2)


def _packed_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        number, at, best = (batch.column(c).to_numpy() for c in ("number", "at", "best"))
        yield _answers(batch.column("block").to_numpy(), np.stack([number, at, at + 1, best], axis=1), 2)


def _removed(spans: bool):
    def run(key: tuple, docs: pa.Table, sent: pa.Table) -> pa.Table:
        names = ["id", "digest", "n_removed", "n_spans", "kept_sha256"]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string()]
        if spans:
            names, kinds = [*names, "spans"], [*kinds, pa.list_(pa.int64())]
        out: list[tuple] = []
        if docs.num_rows and sent.num_rows:
            ids, data, offsets, answers = _sent(docs, sent)
            digests = docs.column("digest").take(pa.array(answers[-1])).to_pylist()
            s = Segments(data, offsets)
            _, first, _, doc, number = s.chosen(_known(s, answers))
            r = answers.get(2, np.zeros(0, np.int64)).reshape(-1, 4)
            r = r[np.argsort(r[:, 0], kind="stable")]
            low = np.searchsorted(r[:, 0], number)
            runs = np.searchsorted(r[:, 0], number, side="right") - low
            seg = np.repeat(np.arange(len(number)), runs)
            pick = np.arange(len(seg)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(low, runs)
            use = r[pick, 3] < ids[doc[seg]] if len(seg) else np.zeros(0, bool)
            seg, pick = seg[use], pick[use]
            change = np.zeros(len(data) + 1, np.int32)
            np.add.at(change, first[seg] + r[pick, 1], 1)
            np.add.at(change, first[seg] + r[pick, 2] + LENGTH - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            for d in np.unique(doc[seg]):
                i, j = offsets[d], offsets[d + 1]
                mask = gone[i:j]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                kept = hashlib.sha256(data[i:j][~mask].tobytes()).hexdigest()
                out.append((int(ids[d]), digests[d], int(mask.sum()), len(edges) // 2, kept, *([edges.tolist()] if spans else [])))
        return pa.table({n: pa.array([x[i] for x in out], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})

    return run


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", 8 << 20):
        data, offsets = column_bytes(batch.column(1))
        view = memoryview(data)
        digests = [hashlib.sha256(view[i:j]).digest() for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
        ids = batch.column(0).to_pylist()
        keys = [None if i is None else _copy_key(i, d) for i, d in zip(ids, digests, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(np.diff(offsets), pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.int64())],
            names=["id", "block", "n_bytes", "digest", "own"],
        )


def _packed_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _answers(batch.column(0).to_numpy(), batch.column(1).to_numpy(), 0)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans: bool = False, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row for each row of docs.

    Removed is every byte covered by a LENGTH-byte string that also starts in a document
    with a smaller id; strings are judged on the whole input texts. n_spans counts the
    maximal removed runs, kept_sha256 is of the bytes that are left. With spans, a column
    has the runs as start, stop, start, stop ... in bytes. hot is the number of segments
    of one hash beyond which it is dealt by its strings; results do not depend on it.

    Null counts as empty. Texts under LENGTH bytes lose nothing. Rows without an id
    neither lose bytes nor take any from others. Rows that share an id do not take bytes
    from each other. A text that equals that of a smaller id goes as a whole. Other
    columns are not read.
    """
    spark = docs.sparkSession
    rows, _ = blocked(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))
    profile = stored(rows.select("id", "text", "block").mapInArrow(_digested, "id long, block int, n_bytes long, digest binary, own long"), "digests")
    known = profile.where("id is not null")
    # A block asks for a text once, however many copies it holds, so that no text is a hot key.
    asked = known.groupBy("block", "digest").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    first = asked.groupBy("digest").agg(F.min("lo").alias("least"), F.max("hi").alias("most")).where("least < most")
    told = asked.join(first.select("digest", "least"), "digest").where("hi > least").select("block", "digest", "least")
    copies = stored(known.join(told, ["block", "digest"]).where("id > least").select("id", "digest", "block", "own"), "copies")
    answer = "block int, kind int, found binary"
    sent0 = copies.select("block", "own").mapInArrow(_packed_copies, answer)
    texts = rows.where("id is not null").withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    by_block = lambda: texts.select("block", "id", "text", "digest").groupBy("block")

    smallest = by_block().cogroup(sent0.groupBy("block")).applyInArrow(_smallest, "h long, block int").withColumn("plain", F.shiftright("h", _COUNT + 1))
    met = stored(smallest.repartition("plain").sortWithinPartitions("plain").mapInArrow(_repeated(hot), answer), "repeated")
    sent1 = sent0.unionByName(met)
    release(spark)

    def segments(hot: bool) -> DataFrame:
        shape = "h long, segment binary, lo long, hi long, block int, number long, at long"
        return by_block().cogroup(sent1.groupBy("block")).applyInArrow(_segments(hot), shape)

    least = stored(segments(False).drop("at").repartition("h").sortWithinPartitions("h").mapInArrow(_sorted, answer), "least")
    release(spark)
    if met.where("kind = 3").head(1):
        strings = segments(True).withColumn("salt", F.pmod("block", F.lit(_SALTS)))
        best = strings.groupBy("segment").agg(F.min("lo").alias("best"), F.max("hi").alias("most")).where("best < most")
        salted = best.select("segment", "best", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
        found = strings.join(salted, ["segment", "salt"]).where("best < hi").select("block", "number", "at", "best")
        least = least.unionByName(stored(found.mapInArrow(_packed_strings, answer), "strings"))
        release(spark)
    shape = "id long, digest binary, n_removed long, n_spans long, kept_sha256 string" + ", spans array<long>" * spans
    hit = by_block().cogroup(sent1.unionByName(least).groupBy("block")).applyInArrow(_removed(spans), shape)
    whole = copies.select("id", "digest", F.lit(True).alias("copy")).distinct()
    out = profile.join(whole, ["id", "digest"], "left").join(hit, ["id", "digest"], "left")
    gone = F.col("copy") & (F.col("n_bytes") >= LENGTH)
    empty = hashlib.sha256(b"").hexdigest()
    columns = [
        F.col("id").alias("doc_id"), "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(empty)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
    ]
    if spans:
        none = F.array().cast("array<long>")
        columns.append(F.when(gone, F.array(F.lit(0).cast("long"), F.col("n_bytes"))).otherwise(F.coalesce("spans", none)).alias("spans"))
    return out.select(*columns)
