"""Lines that many documents share: dropped but in the last document, decided without moving texts.

1. Every document sends the hash, the document and the position of each line that may be
   dropped. These rows are dealt by ranges of (hash, document, position) and sorted, so
   that a line that everybody has fills several ranges instead of one.
2. A task streams its range. The first document of a hash is the one that keeps it; once
   the number of documents is reached, all that follow lose theirs. Only the hash that a
   range begins with and the one it ends with may go on elsewhere: their rows are left
   open, and a table of two rows a range at most decides them.
3. The positions of a document become a bitmap of the lines to keep, compressed.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored
from .textkernels import pieces

#: Code points of a key at least, and documents with it.
LEAST_LENGTH = 20
LEAST_DOCUMENTS = 3
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_NO_ID = -(1 << 63)
#: Rows of a range of hashes (about 40 bytes each).
_RANGE = 1 << 20


def line_key(line: bytes) -> bytes:
    """What lines are compared by: without the white space at both ends, A-Z in lower case."""
    return line.strip(_SPACE).lower()


def _hashed(least_length: int):
    """(doc, content, text) to (high, low, doc, content, place) of the lines long enough to be dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            digests, docs, contents, places = [], [], [], []
            for doc, content, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for place, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
                    key = line_key(line)
                    if len(key) >= least_length and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= least_length):
                        digests.append(hashlib.blake2b(key, digest_size=16).digest())
                        docs.append(doc)
                        contents.append(content)
                        places.append(place)
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            columns = [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(docs, pa.int64()), pa.array(contents, pa.int64()), pa.array(places, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["high", "low", "doc", "content", "place"])

    return run


def _streamed(least: int):
    """A sorted range to the lines that go, and to open rows of the hashes at its ends.

    Open rows carry their hash. Those with place -1 only say that a document has it: of
    the last hash, which begins here unless it is the first too, the first `least`
    documents are enough for the ranges behind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None  # the hash the range begins with
        current, seen, held = None, [], []  # the hash of the last row, its documents up to `least`, its rows while they are fewer

        def out(rows: dict[str, np.ndarray], open_: bool) -> pa.RecordBatch:
            n = len(rows["doc"])
            hashes = [pa.array(rows[c]) if open_ else pa.nulls(n, pa.int64()) for c in ("high", "low")]
            return pa.RecordBatch.from_arrays([*hashes, *(pa.array(rows[c]) for c in ("doc", "content", "place"))], names=["high", "low", "doc", "content", "place"])

        for batch in batches:
            rows = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
            n = batch.num_rows
            if not n:
                continue
            high, low, doc = rows["high"], rows["low"], rows["doc"]
            starts = np.concatenate([[0], np.flatnonzero((high[1:] != high[:-1]) | (low[1:] != low[:-1])) + 1])
            ends = np.concatenate([starts[1:], [n]])
            if first is None:
                first = (int(high[0]), int(low[0]))
            # Groups that lie within the batch and are not the range's first or the batch's last need no state.
            inner = np.arange(len(starts))[1:-1]
            if len(inner):
                a, b = starts[inner[0]], ends[inner[-1]]
                group = np.repeat(np.arange(len(inner)), (ends - starts)[inner])
                top = doc[starts[inner]][group]
                fresh = np.concatenate([[True], (doc[a + 1 : b] != doc[a : b - 1]) | (group[1:] != group[:-1])])
                count = np.bincount(group, weights=fresh, minlength=len(inner))
                gone = np.flatnonzero((count[group] >= least) & (doc[a:b] != top)) + a
                ready = {c: v[gone] for c, v in rows.items()}
            else:
                ready = {c: v[:0] for c, v in rows.items()}
            for k in dict.fromkeys((0, len(starts) - 1)):
                part = {c: v[starts[k] : ends[k]] for c, v in rows.items()}
                key = (int(part["high"][0]), int(part["low"][0]))
                if k and len(ready["doc"]):
                    yield out(ready, False)
                if key != current:
                    current, seen, held = key, [], []
                if key == first:
                    yield out(part, True)
                    continue
                docs = part["doc"][np.concatenate([[True], part["doc"][1:] != part["doc"][:-1]])]
                before = len(seen)
                seen += [int(d) for d in docs[: least + 1] if d not in seen][: least - len(seen)]
                if len(seen) < least:
                    held.append(part)
                else:
                    if before < least:
                        held.append(part)
                        part = {c: np.concatenate([h[c] for h in held]) for c in rows}
                        held = []
                    yield out({c: v[part["doc"] != seen[0]] for c, v in part.items()}, False)
        if current is not None and current != first:
            if held:
                yield out({c: np.concatenate([h[c] for h in held]) for c in held[0]}, True)
            n = len(seen)
            yield out({"high": np.full(n, current[0]), "low": np.full(n, current[1]), "doc": np.array(seen, np.int64), "content": np.zeros(n, np.int64), "place": np.full(n, -1, np.int32)}, True)

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for places in batch.column(2).to_pylist():
            gone = np.array(places, np.int64)
            bits = np.ones(-(-(int(gone.max()) + 1) // 8) * 8, bool)
            bits[gone] = False
            maps.append(zlib.compress(np.packbits(bits).tobytes()))
        columns = [batch.column(0), batch.column(1), pa.array([len(p) for p in batch.column(2).to_pylist()], pa.int64()), pa.array(maps, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc", "content", "n_dropped", "keep"])


def kept_lines(text: str, keep: bytes | None) -> str:
    """The lines of a text that a bitmap keeps; lines behind its end stay, as all do without one."""
    if keep is None:
        return text
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i >= len(bits) or bits[i])


def _identity(id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64(text).alias("content"), text.alias("text")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(doc, content, n_dropped, keep): for each text that loses lines, the compressed bitmap of those it keeps.

    doc is the id (null: the smallest long) and content the 64-bit hash of the text, by
    which a text is found again. Keys are told apart by hashes of 128 bits. Bits are in the
    order of lines, 1 for those that stay and for what fills the last byte.
    """
    doc, content, text = _identity(id_col, text_col)
    rows = docs.select(doc, content, text).where(F.length("text") >= least_length)
    lines = stored(rows.mapInArrow(_hashed(least_length), "high long, low long, doc long, content long, place int"), "lines")
    ranges = max(1, lines.count() // _RANGE, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("high"), F.col("low"), F.col("doc").desc(), F.col("content"), F.col("place")]
    dealt = lines.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    found = stored(dealt.mapInArrow(_streamed(least_documents), lines.schema), "found")
    open_ = found.where("high is not null")
    ends = open_.select("high", "low", "doc").distinct().groupBy("high", "low").agg(F.count("*").alias("n"), F.max("doc").alias("last"))
    # At most two hashes a range.
    decided = open_.where("place >= 0").join(F.broadcast(ends.where(F.col("n") >= least_documents)), ["high", "low"]).where("doc <> last")
    gone = found.where("high is null").select("doc", "content", "place").unionByName(decided.select("doc", "content", "place"))
    # Rows that repeat both id and text are in the lines more than once.
    return gone.groupBy("doc", "content").agg(F.collect_set("place").alias("places")).mapInArrow(_packed, "doc long, content long, n_dropped long, keep binary")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        kept = [kept_lines(t, k) for t, k in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n_dropped"), pa.array(kept, pa.string())], names=["row", "n_dropped", "kept"])


def without_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All rows and columns of docs with `n_dropped` and `kept`, the text without the lines it loses; options are those of keep_bitmaps.

    A text is split at newlines; null counts as empty, one empty line. A line whose key
    has at least `least_length` code points and is found in at least `least_documents`
    documents goes, however often a document has it, but not from the document with the
    largest id among those that have it. Rows that share an id are one document here, rows
    without an id (the smallest) too; each is still a row of the result. Ends other than
    newlines, as of carriage returns, stay with their lines.
    """
    doc, content, text = _identity(id_col, text_col)
    rows = docs.select(F.struct(*docs.columns).alias("row"), doc, content, text)
    joined = rows.join(keep_bitmaps(docs, id_col, text_col, **options), ["doc", "content"], "left")
    shape = f"row {rows.schema['row'].dataType.simpleString()}, n_dropped long, kept string"
    out = joined.select("row", "n_dropped", "text", "keep").mapInArrow(_applied, shape)
    return out.select("row.*", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), "kept")


def line_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256), one row for each row of docs; see without_shared_lines."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = without_shared_lines(own)
    lines = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("\n")).cast("long") + 1
    return out.select("doc_id", lines.alias("n_lines"), "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


LINES_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
d AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.last AS gone FROM k LEFT JOIN s ON s.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(CASE WHEN gone THEN 1 END) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
