"""Language identification by rank-order profiles of letter n-grams.

A profile lists the most frequent n-grams (one to three characters, words padded with a
blank) in order. A document's own list is compared with each language's by the
out-of-place distance: the sum of the differences of rank, or the length of a profile
for an n-gram that the language lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored
from .textkernels import pieces

#: N-grams of a language's profile and of a document's.
PROFILE = 400
DOCUMENT = 300
#: Languages that are compared at once; further ones in further rounds, so that a task never holds more profiles.
LANGUAGES = 64
_PIECE = 1 << 19
_CODE = np.uint64(1 << 21)
#: The blank has a code of its own, which is no letter; 0 is no character at all, so that " a", "a" and "a " differ.
_BLANK = 1

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts with one blank for what stands between, and each one's text."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(low)), [len(t) for t in low])
    codes = np.where(_is_letter()[codes], codes, _BLANK)
    n = len(codes)
    blank = codes == _BLANK
    again = np.zeros(n, bool)
    again[1:] = blank[1:] & blank[:-1] & (owner[1:] == owner[:-1])
    keep = ~again
    return codes[keep], owner[keep]


def gram_counts(texts: list[str], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, code, count) of all n-grams, sorted by group and code; group numbers the texts.

    Each text starts and ends with a blank. A code holds three characters of 21 bits, the
    first ones 0 in n-grams of fewer. Blanks alone are no n-gram, and none has one inside.
    """
    codes, owner = _characters([f" {t} " for t in texts])
    alphabet, small = np.unique(codes, return_inverse=True)
    alphabet, small = np.concatenate([[0], alphabet]), small.astype(np.int64) + 1
    bits = max(1, int(len(alphabet) - 1).bit_length())
    letter = alphabet[small] != _BLANK
    groups = int(group.max()) + 1 if len(group) else 0
    if 3 * bits + max(1, groups.bit_length()) > 62:  # many scripts at once
        if len(texts) > 1:
            half = len(texts) // 2
            parts = [gram_counts(texts[:half], group[:half]), gram_counts(texts[half:], group[half:])]
            g, c, k = (np.concatenate([p[i] for p in parts]) for i in range(3))
            order = np.lexsort((c, g))
            g, c, k = g[order], c[order], k[order]
            first = np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])]) if len(g) else np.zeros(0, bool)
            return g[first], c[first], np.add.reduceat(k, np.flatnonzero(first)) if len(g) else k
    shift = np.int64(3 * bits)
    at = group.astype(np.int64)[owner] << shift
    same2 = owner[1:] == owner[:-1]
    same3 = same2[1:] & same2[:-1]
    one = (at | small)[letter]
    two = (at[1:] | small[:-1] << np.int64(bits) | small[1:])[same2]
    three = (at[2:] | small[:-2] << np.int64(2 * bits) | small[1:-1] << np.int64(bits) | small[2:])[same3 & letter[1:-1]]
    keys = np.sort(np.concatenate([one, two, three]))
    if not len(keys):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count = np.diff(np.concatenate([first, [len(keys)]]))
    keys = keys[first]
    mask = np.int64((1 << bits) - 1)
    wide = alphabet.astype(np.uint64)
    code = (wide[keys >> np.int64(2 * bits) & mask] * _CODE + wide[keys >> np.int64(bits) & mask]) * _CODE + wide[keys & mask]
    return keys >> shift, code, count


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams by language, summed over the task."""
    names: dict[str, int] = {}
    total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in pieces(batches, "text", _PIECE):
        langs = batch.column(0).to_pylist()
        group = np.array([names.setdefault(x, len(names)) for x in langs], np.int64)
        g, c, k = gram_counts(batch.column(1).to_pylist(), group)
        for i in np.unique(g):
            of = g == i
            codes, counts = c[of], k[of]
            if i in total:
                codes, at = np.unique(np.concatenate([total[i][0], codes]), return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate([total[i][1], counts])).astype(np.int64)
            total[i] = codes, counts
    for name, i in names.items():
        if i in total:
            codes, counts = total[i]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])


def learn_profiles(labelled: DataFrame) -> DataFrame:
    """labelled(lang, text) to profiles(lang, rank, gram), of all its rows; null langs and texts teach nothing."""
    used = labelled.where("lang is not null and text is not null").select("lang", "text")
    counts = used.mapInArrow(_learned, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE).select("lang", (F.col("rank") - 1).alias("rank"), "gram")


def _predicted(langs: list[str], grams: np.ndarray, ranks: np.ndarray, at: str, again: bool):
    """ranks: for each gram (sorted) and language its rank, or PROFILE. With again, rows have a prediction, which a nearer language replaces."""

    def scored(texts: list[str]) -> tuple[list[str], list[float]]:
        m = len(texts)
        g, c, k = gram_counts(texts, np.arange(m))
        out, score = ["und"] * m, [0.0] * m
        if not len(g) or not langs:
            return out, score
        order = np.argsort((g << np.int64(32)) | (np.int64(2**32 - 1) - np.minimum(k, 2**32 - 1)), kind="stable")
        g, c = g[order], c[order]
        first = np.searchsorted(g, np.arange(m + 1))
        own = np.arange(len(g)) - first[g]
        top = own < DOCUMENT
        g, c, own = g[top], c[top], own[top]
        place = np.minimum(np.searchsorted(grams, c), max(0, len(grams) - 1))
        away = np.full((len(g), len(langs)), PROFILE, np.int64)
        known = grams[place] == c
        there = ranks[place[known]]
        away[known] = np.where(there < PROFILE, np.abs(there - own[known, None]), PROFILE)
        first = np.searchsorted(g, np.arange(m))
        some = np.flatnonzero(np.bincount(g, minlength=m))
        distance = np.add.reduceat(away, first[some], axis=0)
        n = np.bincount(g, minlength=m)[some]
        best = distance.argmin(axis=1)
        close = 1.0 - distance[np.arange(len(some)), best] / (n * float(PROFILE))
        for r, d in enumerate(some):
            out[d], score[d] = langs[best[r]], float(min(1.0, max(0.0, close[r])))
        return out, score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at, _PIECE):
            names, scores = scored(["" if t is None else t for t in batch.column(at).to_pylist()])
            columns = list(batch.columns)
            if again:
                old = list(zip(columns[-2].to_pylist(), columns[-1].to_pylist(), strict=True))
                best = [new if new[1] > was[1] else was for new, was in zip(zip(names, scores, strict=True), old, strict=True)]
                names, scores, columns = [n for n, _ in best], [x for _, x in best], columns[:-2]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[: len(columns)], "_lang_pred", "_score"])

    return run


def _profile_table(rows: pa.Table, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    code = rows.column("gram").to_numpy().astype(np.int64).view(np.uint64) if rows.num_rows else np.zeros(0, np.uint64)
    grams = np.unique(code)
    ranks = np.full((len(grams), max(1, len(langs))), PROFILE, np.int64)
    place = {x: i for i, x in enumerate(langs)}
    for x, g, r in zip(rows.column("lang").to_pylist(), np.searchsorted(grams, code), rows.column("rank").to_pylist(), strict=True):
        ranks[g, place[x]] = r
    return grams, ranks


def identify(docs: DataFrame, profiles: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `carry` of docs with lang_pred and score, one row for each row.

    A text that is null or has no letter is `und`, with score 0, as is every text if no
    language was learned. The score is 1 less the mean distance by the longest possible.
    Equal distances go to the language first in code-point order. All n-grams of a text
    are counted; its DOCUMENT most frequent are compared. LANGUAGES profiles of PROFILE
    rows at a time are read to the driver and sent to the tasks; each further round
    compares the texts with the next ones and keeps what is nearer.
    """
    langs = sorted(r.lang for r in profiles.select("lang").distinct().collect())
    names = {c: f"carried_{i}" for i, c in enumerate(carry)}
    out = docs.select(*(F.col(c).alias(n) for c, n in names.items()), F.col(text_col).cast("string").alias("_text"))
    shape = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in out.schema), "_lang_pred string", "_score double"])
    for i in range(0, max(1, len(langs)), LANGUAGES):
        part = langs[i : i + LANGUAGES]
        grams, ranks = _profile_table(profiles.where(F.col("lang").isin(part)).toArrow(), part)
        out = out.mapInArrow(_predicted(part, grams, ranks, "_text", i > 0), shape)
    return out.select(*(F.col(n).alias(c) for c, n in names.items()), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2):
    """Whether the CRC-32 of the id as text leaves `part` when divided by `parts`; a null id: no."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of documents, learned from those not held out."""
    taught = docs.where(~held_out()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    profiles = stored(learn_profiles(taught), "profiles")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return identify(rows, profiles, carry=("doc_id", "held_out"))
