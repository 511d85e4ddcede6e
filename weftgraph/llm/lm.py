"""Scoring texts by a log-bilinear language model trained with noise-contrastive estimation.

P(word | two words before) = P(class | their classes) P(word | class, class of the word
before). The CLASSES most frequent tokens of the training texts and the end of a text are
classes of their own; all others are dealt by hash into groups, whose number grows with
the square root of the vocabulary.

1. The class model: for either place of the context a context's vector times a matrix
   predicts the vector of the next class, score = (r C) . e + b. The counts of all pairs
   of classes are a sufficient statistic, so that every step takes the expected gradient
   over all of them as products of matrices. Both predictions, normalised over all
   classes, are mixed with a weight for each class before, found by EM.
2. The word model: every token seen FEW times or more has a vector and a bias within its
   group, trained from the counts of all pairs of a class before and the token, one group
   a task. What is less frequent shares a vector there and is told apart by its count.
   Scores are normalised over the group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocked, release
from .storage import stored
from .textkernels import column_bytes, mix, pieces, word_hashes, words

#: Tokens that are classes of their own, and how often a token of a group must occur for a vector.
CLASSES = 1024
FEW = 3
WIDTH = 24
STEPS = 120
NOISE = 8.0
INNER = 14
_ROUNDS, _DRAWN, _CHUNK = 8, 64, 2048
_BINS, _BIN = 81, 0.25
_END = np.uint64(0x0E0D_0E0D_0E0D_0E0D)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, an end after each, and each one's text."""
    starts, ends, doc = words(data, offsets)
    h = word_hashes(data, starts, ends)
    n = len(offsets) - 1
    at = np.arange(len(h)) + doc
    out, owner = np.empty(len(h) + n, np.uint64), np.empty(len(h) + n, np.int64)
    out[at], owner[at] = h, doc
    last = np.cumsum(np.bincount(doc, minlength=n)) + np.arange(n)
    out[last], owner[last] = _END, np.arange(n)
    return out, owner


def _packed(values: np.ndarray) -> bytes:
    """Unsigned integers in the fewest bytes that hold the largest, behind their size."""
    top = int(values.max()) if len(values) else 0
    size = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([size]) + values.astype(f"u{size}").tobytes()


def _unpacked(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(v, f"u{v[0]}", offset=1) for v in column.to_pylist()]


def _counted(parts: int):
    """Training counts of a block's tokens, a row for each part of the hashes."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        h, owner = tokens(*column_bytes(table.column("text")))
        u, c = np.unique(h[table.column("train").to_numpy(zero_copy_only=False).astype(bool)[owner]], return_counts=True)
        of = (mix(u ^ _END) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        found, edges = np.unique(of[order], return_index=True)
        rows = np.split(order, edges[1:]) if len(found) else []
        return pa.table({"part": pa.array(found, pa.int32()), "words": pa.array([u[i].tobytes() for i in rows], pa.binary()), "n": pa.array([_packed(c[i]) for i in rows], pa.binary())})

    return run


def _summed(key: tuple, table: pa.Table) -> pa.Table:
    """N, V and the most frequent tokens of a part."""
    u, at = np.unique(np.concatenate([np.frombuffer(w, np.uint64) for w in table.column("words").to_pylist()]), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(_unpacked(table.column("n"))), minlength=len(u)).astype(np.int64)
    top = np.lexsort((u, -total))[: CLASSES + 1]
    stats = np.concatenate([[total.sum(), len(u)], np.stack([u[top].view(np.int64), total[top]], axis=1).ravel()]).astype(np.int64)
    return pa.table({"found": pa.array([stats.tobytes()], pa.binary())})


@dataclass
class Vocabulary:
    """n: training tokens, v: distinct ones, top: the hashes of the most frequent (sorted), count: their counts, end: of the end."""

    n: int
    v: int
    top: np.ndarray
    count: np.ndarray
    end: int

    @property
    def groups(self) -> int:
        return max(1, math.isqrt(max(0, self.v - len(self.top))) // 4)

    @property
    def size(self) -> int:
        """Classes: the most frequent tokens, the groups and last the end."""
        return len(self.top) + self.groups + 1

    def classes(self, h: np.ndarray) -> np.ndarray:
        m = len(self.top)
        out = m + (mix(h.copy()) % np.uint64(self.groups)).astype(np.int64)
        if m:
            at = np.minimum(np.searchsorted(self.top, h), m - 1)
            out = np.where(self.top[at] == h, at, out)
        return np.where(h == _END, self.size - 1, out)

    def read(self, h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes of tokens, of those before and of those two before; what precedes a text is its end."""
        now, end = self.classes(h), self.size - 1
        out = [now]
        for k in (1, 2):
            before = np.full(len(now), end, np.int64)
            same = owner[k:] == owner[:-k]
            before[k:][same] = now[:-k][same]
            out.append(before)
        return out[0], out[1], out[2]


def _vocabulary(parts: list[bytes]) -> Vocabulary:
    n = v = 0
    h, c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p in parts:
        x = np.frombuffer(p, np.int64)
        n, v = n + int(x[0]), v + int(x[1])
        h.append(x[2::2])
        c.append(x[3::2])
    h, c = np.concatenate(h).view(np.uint64), np.concatenate(c)
    end = int(c[h == _END].sum())
    h, c = h[h != _END], c[h != _END]
    top = np.lexsort((h, -c))[:CLASSES]
    top = top[np.argsort(h[top])]
    return Vocabulary(n, v, h[top], c[top], end)


def _pairs(vocabulary: Vocabulary):
    m = vocabulary.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(2 * m * m, np.int32)
        for batch in pieces(batches, "text"):
            h, owner = tokens(*column_bytes(batch.column(0)))
            now, first, second = vocabulary.read(h, owner)
            u, n = np.unique(np.concatenate([first * m + now, (m + second) * m + now]), return_counts=True)
            count[u] += n.astype(np.int32)
        at = np.flatnonzero(count)
        for part in np.split(at, np.flatnonzero(np.diff(at >> 16)) + 1) if len(at) else []:
            yield pa.RecordBatch.from_arrays([pa.array([part[0] >> 16], pa.int64()), pa.array([_packed(part & 0xFFFF)], pa.binary()), pa.array([_packed(count[part])], pa.binary())], names=["part", "pair", "n"])

    return run


def _pair_sums(key: tuple, table: pa.Table) -> pa.Table:
    count = np.bincount(np.concatenate(_unpacked(table.column("pair"))), weights=np.concatenate(_unpacked(table.column("n")))).astype(np.int64)
    at = np.flatnonzero(count)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "pair": pa.array([_packed(at)], pa.binary()), "n": pa.array([_packed(count[at])], pa.binary())})


def train(counts: np.ndarray, unigram: np.ndarray, width: int = WIDTH, steps: int = STEPS, seed: int = 5) -> np.ndarray:
    """log10 P(class | context), contexts by classes, after noise-contrastive estimation on pair counts."""
    m = len(unigram)
    rng = np.random.default_rng(seed)
    total = max(1.0, counts.sum())
    row = counts.sum(axis=1, keepdims=True)
    data = (counts / total).astype(np.float32)
    noise = (NOISE * row / total * unigram).astype(np.float32)
    base = np.log(unigram).astype(np.float32)
    parts = [rng.normal(0, 0.1, (m, width)).astype(np.float32), np.eye(width, dtype=np.float32), rng.normal(0, 0.1, (m, width)).astype(np.float32), np.zeros(m, np.float32)]
    scale = [np.maximum(row / total, 1e-9).astype(np.float32), 1.0, np.maximum(data.sum(axis=0), 1e-9)[:, None].astype(np.float32), np.maximum(data.sum(axis=0), 1e-9).astype(np.float32)]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    shift = np.float32(np.log(NOISE))
    for step in range(1, steps + 1):
        r, c, e, b = parts
        q = r @ c
        # Against the noise the score stands without the unigram part, which the bias holds.
        sigma = 1 / (1 + np.exp(-np.clip(q @ e.T + b - shift, -30, 30)))
        g = data - (data + noise) * sigma
        gq = g @ e
        grads = [gq @ c.T, r.T @ gq, g.T @ q, g.sum(axis=0)]
        rate = 0.05 * min(1.0, 2 - 2 * step / steps)
        for i, x in enumerate(grads):
            x = x / scale[i] - 1e-4 * (parts[i] if i != 1 else 0)
            first[i] += 0.1 * (x - first[i])
            second[i] += 0.02 * (x * x - second[i])
            parts[i] = parts[i] + rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.98**step)) + 1e-6)
    r, c, e, b = parts
    s = (r @ c) @ e.T + b + base
    s = s.astype(np.float64)
    s -= s.max(axis=1, keepdims=True)
    s -= np.log(np.exp(s).sum(axis=1, keepdims=True))
    return (s / np.log(10)).astype(np.float32)


def context_features(table: np.ndarray, mass: np.ndarray, width: int = INNER) -> np.ndarray:
    """The main directions in which the rows of a log-probability table differ, each of variance one by mass."""
    p = mass / mass.sum()
    x = table.astype(np.float64)
    x = x - p @ x
    x = (x - x @ p[:, None]) * np.sqrt(p)[None, :]
    values, vectors = np.linalg.eigh((x * p[:, None]).T @ x)
    x = x @ vectors[:, ::-1][:, :width]
    x = x / np.maximum(np.sqrt(p @ (x * x)), 1e-9)
    out = np.zeros((len(table), width), np.float32)
    out[:, : x.shape[1]] = np.clip(x, -4, 4)
    return out


def train_group(word: np.ndarray, context: np.ndarray, n: np.ndarray, weight: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, biases and, for each context, the logarithm of the sum over all words of a group.

    (word, context, n) are the pair counts, sorted by word; weight is what each word has of
    the group without a context. Vectors are multiples of 1/32, biases of 1/256, and the
    sums are those of the rounded values, so that probabilities sum to one.
    """
    k, width = len(weight), x.shape[1]
    q, b = np.zeros((k, width), np.float32), np.zeros(k, np.float32)
    base = np.log(weight / weight.sum()).astype(np.float32)
    if len(word):
        mass = np.bincount(context, weights=n, minlength=len(x))
        drawn = x[np.searchsorted(np.cumsum(mass), (np.arange(_DRAWN) + 0.5) / _DRAWN * mass.sum())]
        total = np.bincount(word, weights=n, minlength=k).astype(np.float32)
        shift = np.float32(np.log(NOISE))
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        cuts = np.unique(np.concatenate([[0], np.searchsorted(word, np.arange(0, k, _CHUNK)), [len(word)]]))
        near = x[context]
        for _ in range(_ROUNDS):
            g, hess = -q, np.ones_like(q)
            gb, hb = -0.1 * b, np.full(k, 0.1, np.float32)
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                w, y = word[i:j], near[i:j]
                starts = first[np.searchsorted(first, i) : np.searchsorted(first, j)] - i
                at = w[starts]
                miss = n[i:j] / (1 + np.exp(np.clip((q[w] * y).sum(axis=1) + b[w] - shift, -30, 30)))
                g[at] += np.add.reduceat(miss[:, None] * y, starts, axis=0)
                gb[at] += np.add.reduceat(miss, starts)
            for i in range(0, k, _CHUNK):
                part = slice(i, i + _CHUNK)
                sigma = 1 / (1 + np.exp(-np.clip(q[part] @ drawn.T + b[part, None] - shift, -30, 30)))
                share = (NOISE * total[part] / _DRAWN)[:, None]
                g[part] -= (share * sigma) @ drawn
                gb[part] -= (share * sigma).sum(axis=1)
                # Where model and counts agree, data and noise together curve as the noise alone times sigma.
                curve = share * sigma
                hess[part] += curve @ (drawn * drawn)
                hb[part] += curve.sum(axis=1)
            q += np.clip(0.7 * g / hess, -0.5, 0.5)
            b += np.clip(0.7 * gb / hb, -0.5, 0.5)
    q = np.round(np.clip(q, -3.9, 3.9) * 32) / 32
    b = np.round(np.clip(b + base, -120, 120) * 256) / 256
    z = np.zeros(len(x))
    for i in range(0, k, _CHUNK):
        z += np.exp((x @ q[i : i + _CHUNK].T + b[i : i + _CHUNK]).astype(np.float64)).sum(axis=1)
    return q.astype(np.float32), b.astype(np.float32), np.log(z)


def mixture(hist: np.ndarray, rounds: int = 30) -> np.ndarray:
    """The weight of the word before for each class before, by EM on counts of binned log ratios."""
    ratio = np.exp((np.arange(_BINS) - _BINS // 2) * _BIN)
    out = np.full(len(hist), 0.7)
    for _ in range(rounds):
        took = out[:, None] * ratio / (out[:, None] * ratio + 1 - out[:, None])
        out = ((hist * took).sum(axis=1) + 7) / (hist.sum(axis=1) + 10)
    return out


def _asked(vocabulary: Vocabulary, tables: np.ndarray):
    """The words of every group in a block with the training counts of their contexts, and (group -1) binned ratios for the mixture."""
    top, m = len(vocabulary.top), vocabulary.size

    def run(key: tuple, table: pa.Table) -> pa.Table:
        h, owner = tokens(*column_bytes(table.column("text")))
        train = table.column("train").to_numpy(zero_copy_only=False).astype(bool)[owner]
        now, first, second = vocabulary.read(h, owner)
        ratio = np.log(10) * (tables[0][first[train], now[train]] - tables[1][second[train], now[train]])
        bins = np.clip(np.round(ratio / _BIN) + _BINS // 2, 0, _BINS - 1).astype(np.int64)
        cell, n = np.unique(first[train] * _BINS + bins, return_counts=True)
        rows = [(-1, b"", b"", _packed(cell), _packed(n))]
        grouped = (now >= top) & (now < m - 1)
        word, group, context, taught = h[grouped], now[grouped] - top, first[grouped], train[grouped]
        u, back = np.unique(word, return_inverse=True)
        order = np.lexsort((u, of := vocabulary.classes(u) - top))
        place = np.empty(len(u), np.int64)
        place[order] = np.arange(len(u))
        u, of = u[order], of[order]
        pair, n = np.unique(place[back[taught]] * m + context[taught], return_counts=True)
        at, context = pair // m, pair % m
        each = np.bincount(at, minlength=len(u))
        edges, stops = np.searchsorted(of, np.arange(vocabulary.groups + 1)), np.concatenate([[0], np.cumsum(each)])
        for g in np.unique(of):
            i, j = edges[g], edges[g + 1]
            part = slice(stops[i], stops[j])
            rows.append((int(g), u[i:j].tobytes(), _packed(each[i:j]), _packed(context[part]), _packed(n[part])))
        names = ("part", "words", "each", "context", "n")
        kinds = (pa.int32(), *[pa.binary()] * 4)
        return pa.table({"block": pa.array([key[0].as_py()] * len(rows), pa.int32()), **{c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(zip(names, kinds, strict=True))}})

    return run


def _grouped(x: np.ndarray):
    """A group's counts, vectors and biases back to the blocks, and what all blocks need of it (block -1)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        context, n = (np.concatenate(_unpacked(table.column(c))).astype(np.int64) for c in ("context", "n"))
        blocks, found = table.column("block").to_pylist(), []
        if group < 0:
            blocks, found = [-1], [np.bincount(context, weights=n, minlength=len(x) * _BINS).astype(np.float64).tobytes()]
        else:
            words = [np.frombuffer(w, np.uint64) for w in table.column("words").to_pylist()]
            u, back = np.unique(np.concatenate(words), return_inverse=True)
            word = np.repeat(back, np.concatenate(_unpacked(table.column("each"))))
            count = np.bincount(word, weights=n, minlength=len(u)).astype(np.int64)
            often = count >= FEW
            few = int(often.sum())
            place = np.where(often, np.cumsum(often) - 1, few)
            rare = count[~often]
            rare_n, rare_v = int(rare.sum()), int((rare > 0).sum())
            pair, at = np.unique(place[word] * len(x) + context, return_inverse=True)
            total = np.bincount(at, weights=n, minlength=len(pair)).astype(np.float32)
            weight = np.concatenate([count[often] + 1.0, [rare_n + rare_v + 1.0]])
            q, b, z = train_group(pair // len(x), pair % len(x), total, weight, x)
            record = np.zeros(len(u), _ANSWER)
            record["c"], record["q"], record["b"], record["rare"] = count, np.round(q[place] * 32), np.round(b[place] * 256), ~often
            stops = np.cumsum([0, *map(len, words)])
            found = [record[back[i:j]].tobytes() for i, j in zip(stops[:-1], stops[1:], strict=True)]
            blocks, found = [*blocks, -1], [*found, np.concatenate([[rare_n + rare_v + 1.0], z]).tobytes()]
        return pa.table({"block": pa.array(blocks, pa.int32()), "part": pa.array([group] * len(blocks), pa.int32()), "found": pa.array(found, pa.binary())})

    return run


_ANSWER = np.dtype([("c", np.int64), ("q", np.int8, INNER), ("b", np.int16), ("rare", np.bool_)])


def _scored(vocabulary: Vocabulary, tables: np.ndarray, x: np.ndarray, mixed: np.ndarray, rare: np.ndarray, z: np.ndarray, carry: tuple[str, ...]):
    n, v, top, m = vocabulary.n, vocabulary.v, len(vocabulary.top), vocabulary.size

    def run(key: tuple, docs: pa.Table, sent: pa.Table) -> pa.Table:
        h, owner = tokens(*column_bytes(docs.column("text")))
        rows = docs.num_rows
        now, first, second = vocabulary.read(h, owner)
        grouped = (now >= top) & (now < m - 1)
        c = np.concatenate([vocabulary.count, np.zeros(vocabulary.groups, np.int64), [vocabulary.end]])[now]
        if vocabulary.n:
            share = mixed[first]
            own = np.log10(share * 10.0 ** tables[0][first, now] + (1 - share) * 10.0 ** tables[1][second, now])
            u, back = np.unique(h[grouped], return_inverse=True)
            of = vocabulary.classes(u) - top
            order = np.lexsort((u, of))
            place = np.empty(len(u), np.int64)
            place[order] = np.arange(len(u))
            parts = sorted(zip(sent.column("part").to_pylist(), sent.column("found").to_pylist(), strict=True))
            record = np.concatenate([np.zeros(0, _ANSWER), *(np.frombuffer(f, _ANSWER) for _, f in parts)])
            at, g, before = place[back], of[back], first[grouped]
            c[grouped] = record["c"][at]
            s = record["b"][at] / 256.0 - z[g, before]
            for i in range(0, len(at), 1 << 16):
                part = slice(i, i + (1 << 16))
                s[part] += np.einsum("ij,ij->i", record["q"][at[part]].astype(np.float32), x[before[part]]) / 32
            own[grouped] += s / np.log(10) + np.where(record["rare"][at], np.log10((c[grouped] + 1.0) / rare[g]), 0.0)
        base = np.log10((c + 1.0) / (n + 1.0 * (v + 1)))
        if not vocabulary.n:
            own = base
        sums = lambda w: np.bincount(owner, weights=w, minlength=rows)
        return pa.table({
            **{c: docs.column(c) for c in carry}, "n_tokens": pa.array(sums(np.ones(len(h))).astype(np.int64)), "n_known": pa.array(sums(c > 0).astype(np.int64)),
            "base_score": pa.array(sums(base)), "score": pa.array(sums(own)),
        })

    return run


def language_model_scores(docs: DataFrame, train_col: str, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `carry` of docs with n_tokens, n_known, train_tokens, base_score and score, one row for each row.

    Tokens are the words of a text, A-Z lower-cased, and one end. Rows whose train_col is
    true teach the model and the counts; all rows are scored. base_score is the sum of
    log10((c + 1) / (N + V + 1)), score the model's log10 probability. Tokens are told
    apart by 64-bit hashes. Null and empty texts have the end as their only token. If
    no row teaches, all tokens score as the base does.
    """
    spark = docs.sparkSession
    names = {c: f"carried_{i}" for i, c in enumerate(carry)}
    rows = docs.select(*(F.col(c).alias(n) for c, n in names.items()), F.coalesce(F.col(train_col), F.lit(False)).alias("train"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows, blocks = blocked(rows.withColumn("id", F.struct(*names.values())))
    body = rows.select("block", *names.values(), "train", "text")
    asked = body.select("block", "train", "text").groupBy("block").applyInArrow(_counted(-(-blocks // 4)), "part int, words binary, n binary")
    stats = asked.groupBy("part").applyInArrow(_summed, "found binary")
    vocabulary = _vocabulary([r.found for r in stats.collect()])
    del asked, stats
    release(spark)
    m = vocabulary.size
    tables, x = np.zeros((2, m, m), np.float32), np.zeros((m, INNER), np.float32)
    mixed, rare, z = np.full(m, 0.7), np.ones(vocabulary.groups), np.zeros((vocabulary.groups, m))
    sent = spark.createDataFrame([], "block int, part int, found binary")
    if vocabulary.n:
        counts = np.zeros(2 * m * m, np.float32)
        pairs = rows.where("train").select("text").mapInArrow(_pairs(vocabulary), "part long, pair binary, n binary")
        sums = pairs.groupBy("part").applyInArrow(_pair_sums, "part long, pair binary, n binary").toArrow()
        for part, at, n in zip(sums.column("part").to_pylist(), _unpacked(sums.column("pair")), _unpacked(sums.column("n")), strict=True):
            counts[(part << 16) + at.astype(np.int64)] = n
        counts = counts.reshape(2, m, m)
        unigram = counts[0].sum(axis=0, dtype=np.float64) + 1
        for i in (0, 1):
            tables[i] = train(counts[i], unigram / unigram.sum())
        x = context_features(tables[0], counts[0].sum(axis=1, dtype=np.float64) + 1e-3)
        del counts, pairs, sums
        release(spark)
        wanted = body.select("block", "train", "text").groupBy("block").applyInArrow(_asked(vocabulary, tables), "block int, part int, words binary, each binary, context binary, n binary")
        answers = stored(wanted.groupBy("part").applyInArrow(_grouped(x), "block int, part int, found binary"), "words")
        for r in answers.where("block = -1").collect():
            values = np.frombuffer(r.found, np.float64)
            if r.part < 0:
                mixed = mixture(values.reshape(m, _BINS))
            else:
                rare[r.part], z[r.part] = values[0], values[1:]
        sent = answers.where("block >= 0")
        del wanted
        release(spark)
    shape = ", ".join([*(f"{n} {body.schema[n].dataType.simpleString()}" for n in names.values()), "n_tokens long, n_known long, base_score double, score double"])
    out = body.drop("train").groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(_scored(vocabulary, tables, x, mixed, rare, z.astype(np.float32), tuple(names.values())), shape)
    return out.select(*(F.col(n).alias(c) for c, n in names.items()), "n_tokens", "n_known", F.lit(vocabulary.n).cast("long").alias("train_tokens"), "base_score", "score")
