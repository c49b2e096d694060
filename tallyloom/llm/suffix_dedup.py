"""Removal of long repeated strings, by a column-wise Burrows-Wheeler transform of text segments.

What is removed: every byte covered by a string of ``size`` bytes (400) that also starts
anywhere else in the corpus.  No two documents are compared and no text is sorted whole:

1. Every ``size``-byte window has an anchor: of its ``gram``-byte strings, the one with the
   smallest hash (the leftmost of equals).  Equal windows have equal anchors at equal
   places, so windows with one anchor form a *segment*, and a window can only be repeated
   in segments whose anchors have the same hash.  Every window belongs to one segment.
2. Anchor hashes are counted.  Those that occur once are done: nothing in them is repeated.
   Those that come with one segment text only are done too: all of it is repeated.
   Segments are called equal by 128 bits of BLAKE2b over their bytes.  Where a text repeats
   itself with a short period, neighbouring segments are equal; such a run (compared byte by
   byte) is one row with a count, and all of it is repeated.
3. For the rest, segment texts that are equal become one class with a count, and tasks
   take whole groups of classes with one anchor hash.  A collection of such groups is
   read column by column from the right, lined up at the anchors: each round inserts one
   symbol of every segment, re-sorts the collection's transform by that symbol and updates
   the common prefixes of neighbours (``repeated_windows``).  A common prefix of ``size``
   bytes marks two repeated windows.  The transform is positional: suffixes are sorted
   among those of their own column, which is enough because equal windows stand at equal
   places from their anchors, and it takes one step a symbol where the transform of all
   suffixes would take as many as there are shorter suffixes.  Columns are read in
   sequence and a collection is bounded, so it needs no files of its own.
4. A group with more than ``most`` classes is too much for one task.  Its segments are cut
   into parts with fewer windows, by the distance from the window's start to the anchor;
   all windows of a part share the bytes in its middle (``narrower``), so parts group by
   the hash of those, much longer than an anchor, and steps 2 and 3 begin again with them.
   A part of one window has only equal ones in its group, so that this always ends.
5. Repeated runs go back to their documents by (hash, segment) and then by document.

Rows that are equal in id and text are interchangeable, each counts as a document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import column_bytes, mix64, text_slices
from ..storage import saved

SIZE, GRAM = 400, 96
#: Bytes of text that an anchor kernel handles at once; positions in it take _PLACE bits.
_CHUNK, _PLACE = 1 << 20, np.uint64((1 << 21) - 1)
_BASES = (np.uint64(0x9E3779B97F4A7C15),)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, at least n of each."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        base = int(_BASES[which])
        up = np.full(n, base, np.uint64)
        down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[which] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS[which]


def prefix_sums(data: np.ndarray, which: int) -> np.ndarray:
    up, _ = _powers(which, len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for many spans."""
    _, down = _powers(which, len(sums))
    return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[p : p + width] for each p that has so many."""
    n = len(x)
    blocks = -(-n // width)
    full = np.full(blocks * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    full[:n] = x
    grid = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def segments(data: np.ndarray, offsets: np.ndarray, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, start, length, place of the anchor, anchor hash, segment digest, number, reach) of all segments; start counts from the row's first byte.

    ``number`` equal segments that follow each other are one; the last of them starts ``reach`` bytes behind the first.
    """
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, object, np.int64, np.int64))
    n = len(data)
    if n < size:
        return empty
    sums = prefix_sums(data, 0)
    at = np.arange(n - gram + 1)
    hashes = span_hash(sums, 0, at, at + gram)
    least = _sliding_min((hashes & ~_PLACE) | at.astype(np.uint64), size - gram + 1)
    counts = np.maximum(np.diff(offsets) - size + 1, 0)
    total = int(counts.sum())
    if not total:
        return empty
    rows = np.repeat(np.arange(len(counts)), counts)
    starts = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(offsets[:-1], counts)
    chosen = least[starts]
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.concatenate([first[1:], [total]]) - 1
    begin, end, row = starts[first], starts[last] + size, rows[first]
    anchor = (chosen[first] & _PLACE).astype(np.int64)
    kept, number, reach = _periods(data, begin, end, np.stack([row, end - begin, anchor - begin, hashes[anchor].view(np.int64)]))
    row, begin, end, anchor = row[kept], begin[kept], end[kept], anchor[kept]
    return row, begin - offsets[row], end - begin, anchor - begin, hashes[anchor], digests(data, begin, end), number, reach


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of each span's bytes."""
    raw = memoryview(np.ascontiguousarray(data))
    out = np.empty(len(start), object)
    for k, (a, b) in enumerate(zip(start.tolist(), end.tolist())):
        out[k] = hashlib.blake2b(raw[a:b], digest_size=16).digest()
    return out


def _periods(data: np.ndarray, begin: np.ndarray, end: np.ndarray, looks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which segments to keep, how many equal ones each stands for, how far behind it the last of them starts).

    Neighbours that look alike and follow each other at one distance are equal if the
    bytes from the first to the last repeat themselves at that distance, which is looked up.
    """
    n = len(begin)
    number, reach, kept = np.ones(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    like = np.concatenate([(looks[:, 1:] == looks[:, :-1]).all(axis=0), [False]])
    step = np.append(np.diff(begin), 0)
    k = 0
    for k in np.flatnonzero(like & ~np.concatenate([[False], like[:-1] & (step[1:] == step[:-1])])):
        if not kept[k]:
            continue
        more = np.flatnonzero(~(like[k:] & (step[k:] == step[k])))
        last, d = k + int(more[0]), int(step[k])
        if last > k and (data[begin[k] : end[last] - d] == data[begin[k] + d : end[last]]).all():
            number[k], reach[k] = last - k + 1, begin[last] - begin[k]
            kept[k + 1 : last + 1] = False
    where = np.flatnonzero(kept)
    return where, number[where], reach[where]


def long_rows(data: np.ndarray, offsets: np.ndarray, size: int = SIZE, gram: int = GRAM, chunk: int = _CHUNK) -> Iterator[tuple[np.ndarray, ...]]:
    """``segments`` for rows of any length: one that is longer than ``chunk`` is read in parts that share size - 1 bytes.

    A segment that is cut by a part's end becomes two; both have the anchor that the whole had.
    """
    if len(data) <= chunk + size or len(offsets) > 2:
        yield segments(data, offsets, size, gram)
        return
    for at in range(0, len(data) - size + 1, chunk):
        part = data[at : at + chunk + size - 1]
        row, start, *rest = segments(part, np.array([0, len(part)]), size, gram)
        yield (row, start + at, *rest)


def repeated_windows(texts: list[bytes], group: np.ndarray, place: np.ndarray, size: int = SIZE) -> np.ndarray:
    """flags[k, w]: does window w of segment k also occur in another segment of its group?

    group is sorted.  Columns are taken from right to left; ``order`` holds the segments
    whose text reaches the column, sorted by group and by what follows, and ``common[i]``
    the common prefix of order[i] and order[i - 1], 0 where a group begins.
    """
    n = len(texts)
    lengths = np.array([len(t) for t in texts])
    left, right = -place, lengths - place
    low, high = int(left.min()), int(right.max())
    grid = np.zeros((n, high - low), np.uint8)
    for k, t in enumerate(texts):
        grid[k, left[k] - low : right[k] - low] = np.frombuffer(t, np.uint8)
    columns = np.ascontiguousarray(grid.T)
    flags = np.zeros((n, int(lengths.max()) - size + 1), bool)
    enters = np.argsort(-right, kind="stable")
    entry = -right[enters]
    order, common = np.zeros(0, np.int64), np.zeros(0, np.int32)
    for col in range(high - 1, low - 1, -1):
        new = enters[np.searchsorted(entry, -(col + 1)) : np.searchsorted(entry, -(col + 1), side="right")]
        alive = left[order] <= col
        if not alive.all():
            kept = np.flatnonzero(alive)
            common = np.minimum.reduceat(common[: kept[-1] + 1], np.concatenate([[0], kept[:-1] + 1])) if len(kept) else common[:0]
            order = order[kept]
        if len(new):
            # an ended text is the least of its group: it goes to the front, with nothing in common
            new = new[np.argsort(group[new], kind="stable")]
            at = np.searchsorted(group[order], group[new])
            front = np.unique(at[at < len(order)])
            common[front] = 0
            order, common = np.insert(order, at, new), np.insert(common, at, 0)
        if not len(order):
            continue
        key = group[order] * 256 + columns[col - low][order]
        sort = np.argsort(key, kind="stable")
        ordered = key[sort]
        same = np.flatnonzero(ordered[1:] == ordered[:-1]) + 1
        fresh = np.zeros(len(order), np.int32)
        if len(same):
            before, here = sort[same - 1], sort[same]
            bounds = np.empty(2 * len(same), np.int64)
            bounds[0::2], bounds[1::2] = before + 1, here + 1
            padded = np.append(common, np.int32(0))
            fresh[same] = np.minimum.reduceat(padded, bounds)[0::2] + 1
        order, common = order[sort], fresh
        hit = np.flatnonzero(common >= size)
        if len(hit):
            for k in (order[hit], order[hit - 1]):
                flags[k, col - left[k]] = True
    return flags


def _runs(flags: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, to) of the bytes that flagged windows cover, a run for each row of neighbouring flags."""
    wide = np.zeros((flags.shape[0], flags.shape[1] + 2), np.int8)
    wide[:, 1:-1] = flags
    turn = np.diff(wide, axis=1)
    row, begin = np.nonzero(turn == 1)
    _, end = np.nonzero(turn == -1)
    return row, begin, end - 1 + size


_SPANS = "array<struct<from:int,to:int>>"


def _spans_array(row: np.ndarray, begin: np.ndarray, end: np.ndarray, n: int) -> pa.Array:
    offsets = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
    pairs = pa.StructArray.from_arrays([pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], ["from", "to"])
    return pa.ListArray.from_arrays(offsets, pairs)


def _anchor_rows(size: int, gram: int):
    names = ["k1", "k2", "start", "len", "place", "h", "fp", "n", "reach"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", _CHUNK):
                data, offsets = column_bytes(part.column("text"))
                for row, start, length, place, h, fp, number, reach in long_rows(data, offsets, size, gram):
                    rows = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("k1").take(rows), part.column("k2").take(rows), *(pa.array(x.astype(np.int32)) for x in (start, length, place)), pa.array(h.view(np.int64)), pa.array(fp, pa.binary()), pa.array(number), pa.array(reach)],
                        names=names,
                    )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per class: its text, cut out of the text that represents it."""
    names = ["h", "fp", "n", "place", "seg"]
    for batch in batches:
        docs, wanted = batch.column("text"), batch.column("wanted")
        for k in range(batch.num_rows):
            raw = docs[k].as_py()
            rows = wanted[k].as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows], t) for c, t in (("h", pa.int64()), ("fp", pa.binary()), ("n", pa.int64()), ("place", pa.int32()))] + [pa.array([raw[r["start"] : r["start"] + r["len"]] for r in rows], pa.binary())], names=names
            )


def _collections(size: int, most_rows: int = 8192):
    """Whole groups, sorted by h, in collections of about ``most_rows`` classes."""

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        h = table.column("h").to_numpy()
        group = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
        texts = table.column("seg").to_pylist()
        flags = repeated_windows(texts, group, table.column("place").to_numpy().astype(np.int64), size)
        whole = np.flatnonzero(table.column("n").to_numpy() >= 2)
        for k in whole:
            flags[k] = False
            flags[k, : len(texts[k]) - size + 1] = True
        row, begin, end = _runs(flags, size)
        return pa.RecordBatch.from_arrays([table.column("h").chunk(0), table.column("fp").chunk(0), _spans_array(row, begin, end, len(texts))], names=["h", "fp", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if rows >= most_rows:
                # the last group may go on in this batch: what comes before it is whole
                table = pa.Table.from_batches(held).combine_chunks()
                h = table.column("h").to_numpy()
                edge = int(np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))[-1])
                if edge:
                    yield solve(table.slice(0, edge).to_batches())
                    held, rows = table.slice(edge).to_batches(), len(h) - edge
            held.append(batch)
            rows += batch.num_rows
        if rows:
            yield solve(held)

    return run


def narrower(seg: np.ndarray, place: int, anchor: np.uint64, width: int, size: int = SIZE) -> tuple[np.ndarray, ...]:
    """(start, length, place of the anchor, group hash, digest) of the parts of a segment, each of at most ``width`` windows.

    A part has the windows that begin b * width to (b + 1) * width - 1 bytes before the
    anchor.  They all hold the bytes from b * width before the anchor to size - (b + 1) * width
    behind it: equal windows of two segments are in parts of the same group.
    """
    least, most = place - (len(seg) - size), place
    b = np.arange(least // width, most // width + 1)
    far, near = np.minimum((b + 1) * width - 1, most), np.maximum(b * width, least)
    start, end = place - far, place - near + size
    middle = span_hash(prefix_sums(seg, 0), 0, place - b * width, place + size - (b + 1) * width + 1)
    return start, end - start, far, mix64(middle + mix64(anchor + b.astype(np.uint64))), digests(seg, start, end)


def _part_rows(size: int, width: int):
    names = ["k1", "k2", "start", "len", "place", "h", "fp", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n, place = (batch.column(c).to_numpy() for c in ("h", "n", "place"))
            found = [narrower(np.frombuffer(seg.as_py(), np.uint8), int(place[k]), h[k : k + 1].view(np.uint64)[0], width, size) for k, seg in enumerate(batch.column("seg"))]
            if not found:
                continue
            row = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            start, length, place, group, part = (np.concatenate(c) for c in zip(*found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[row]), batch.column("fp").take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in (start, length, place)), pa.array(group.view(np.int64)), pa.array(part, pa.binary()), pa.array(n[row])], names=names
            )

    return run


def _with_keys(docs: DataFrame, text: str, doc_id: str, keep: list[str]) -> DataFrame:
    """k1, k2 (a 128-bit key of id and text), doc (the columns to keep) and text (a null text is empty)."""
    body = F.coalesce(F.col(text), F.lit(""))
    named = F.coalesce(F.col(doc_id).cast("string"), F.lit("\x00"))
    return docs.select(F.xxhash64(named, body).alias("k1"), F.xxhash64(body, named, F.lit(1)).alias("k2"), F.struct(*(F.col(c) for c in keep)).alias("doc"), body.alias("text"))


def _spans_of(texts: DataFrame, pieces: DataFrame, size: int, width: int, most: int) -> DataFrame:
    """k1, k2 and ``spans`` of the texts (k1, k2, text as bytes) with repeated windows.

    pieces (k1, k2, start, len, place, h, fp, n, reach) are parts of the texts with at most
    ``width`` windows each, n the rows that hold the text; h is equal where windows can be.
    Equal parts up to ``reach`` bytes behind a piece belong to it.
    """
    deal = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = pieces.groupBy("h").agg(F.sum("n").alias("all"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    # written first, so that nothing but an exchange stands below the join and a hot anchor is split over tasks
    groups = saved(groups.where("all >= 2").select("h", (F.col("lo") == F.col("hi")).alias("alike")), "anchor-groups")
    hits = saved(pieces.join(groups, "h"), "hits")

    mixed = hits.where("NOT alike")
    one = F.min(F.struct("k1", "k2", "start", "len", "place")).alias("one")
    classes = saved(mixed.groupBy("h", "fp").agg(F.sum("n").alias("n"), one).select("h", "fp", "n", "one.*"), "classes")
    sizes = saved(classes.groupBy("h").agg(F.count(F.lit(1)).alias("m")), "class-counts")
    wanted = classes.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "fp", "n", "start", "len", "place")).alias("wanted"))  # at most a text's own pieces
    cut = texts.join(wanted, ["k1", "k2"]).select("text", "wanted").mapInArrow(_cut, "h long, fp binary, n long, place int, seg binary")
    sized = saved(cut, "segments").join(sizes, "h")
    fits = F.col("m") <= most if width > 1 else F.lit(True)
    solved = sized.where(fits).repartition(deal, "h").sortWithinPartitions("h", "fp").select("h", "fp", "n", "place", "seg").mapInArrow(_collections(size), f"h long, fp binary, spans {_SPANS}")
    if width > 1 and not sizes.where(~fits).isEmpty():
        hot, width = sized.where(~fits), -(-width // 8)
        parts = saved(hot.select("h", "fp", "n", "place", "seg").mapInArrow(_part_rows(size, width), "k1 long, k2 binary, start int, len int, place int, h long, fp binary, n long").withColumn("reach", F.lit(0).cast("long")), "parts")
        inner = _spans_of(hot.select(F.col("h").alias("k1"), F.col("fp").alias("k2"), F.col("seg").alias("text")), parts, size, width, most)
        solved = solved.unionByName(inner.select(F.col("k1").alias("h"), F.col("k2").alias("fp"), "spans"))
    found = mixed.where("reach = 0").join(solved, ["h", "fp"]).select("k1", "k2", F.explode(F.transform("spans", lambda s: F.struct((F.col("start") + s["from"]).alias("from"), (F.col("start") + s["to"]).alias("to")))).alias("span"))
    whole = hits.where("alike OR reach > 0").select("k1", "k2", F.struct(F.col("start").alias("from"), (F.col("start") + F.col("len") + F.col("reach")).cast("int").alias("to")).alias("span"))
    return found.unionByName(whole).groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"))


def repeated_spans(docs: DataFrame, keep: list[str], text: str = "text", doc_id: str = "doc_id", size: int = SIZE, gram: int = GRAM, most: int = 20_000) -> DataFrame:
    """doc (the columns to keep), text and ``spans`` of every row: byte runs that repeated windows cover (they may overlap), or null."""
    keyed = _with_keys(docs, text, doc_id, keep)
    flat = keyed.where(F.octet_length("text") >= size).select("k1", "k2", "text")
    anchors = saved(flat.mapInArrow(_anchor_rows(size, gram), "k1 long, k2 long, start int, len int, place int, h long, fp binary, n long, reach long"), "anchors")
    bytes_of = keyed.select("k1", "k2", F.col("text").cast("binary").alias("text"))
    spans = _spans_of(bytes_of, anchors, size, size - gram + 1, most)
    return keyed.join(spans, ["k1", "k2"], "left").select("doc", "text", "spans")


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted((s["from"], s["to"]) for s in spans or ()):
        if out and begin <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((begin, end))
    return out


def _long_runs(raw: bytes, runs: list[tuple[int, int]], least_words: int, enough: int) -> list[tuple[int, int]]:
    """Runs with at least so many words, or so many bytes (in scripts without spaces)."""
    return [(a, b) for a, b in runs if b - a >= enough or len(raw[a:b].split()) >= least_words]


def _kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SIZE, keep: list[str] | None = None, least_words: int = 0, **options) -> DataFrame:
    """The columns in ``keep`` (all by default), then left, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    left is the text without the repeats, characters that were cut in two left out;
    kept_sha256 is of the bytes that stay, halves of characters included.  A null text counts
    as empty.  Texts shorter than ``size`` lose nothing.  All occurrences go, the first one
    too.  With ``least_words``, runs of fewer words (parts between ASCII white space, cut ones
    at the ends included) stay unless they have SIZE bytes.  Kept columns of the five names
    are replaced.
    """
    added = T._parse_datatype_string("left string, n_bytes long, n_removed long, n_spans long, kept_sha256 string").fields
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in {f.name for f in added}]
    schema = T.StructType([*(docs.schema[c] for c in keep), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = [], []
            for value, spans in zip(batch.column("text"), batch.column("spans")):
                raw = value.as_py().encode()
                runs = _long_runs(raw, _merged(spans.as_py()), least_words, SIZE)
                left = _kept(raw, runs) if runs else raw
                texts.append(left.decode(errors="ignore"))
                rows.append((len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest()))
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            passed = [batch.column("doc").field(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*passed, pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=schema.names)

    # a struct without a column has no Arrow form
    return repeated_spans(docs, keep or [doc_id], text, doc_id, size, **options).mapInArrow(run, schema)


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """docs with what is left of each text in the place of it."""
    names = [F.col("__left").alias(c) if c == text else F.col(c) for c in docs.columns]
    found = remove_repeats(docs, text, doc_id, keep=docs.columns, **options)
    return found.withColumnRenamed("left", "__left").select(*names)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 400-byte strings of all documents: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"]).drop("left")
