"""Encoding and decoding with merge-type sentencepiece vocabularies.

The method is an agenda of adjacent symbol pairs: the pair whose joined piece has the
highest score is merged (of equals the leftmost), until no joined pair is a piece.
Characters without a piece become their bytes.

No piece holds a blank mark after another character, so no merge crosses the start of a
word and each distinct word of an Arrow batch is worked out once.  All new words go
through their agendas side by side, a merge of every word in each step, and are checked
against the sentencepiece library in the same batch.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import text_slices
from .word_ids import Ids, WordIds, gathered, numbered, offsets_of

BLANK = "▁"
#: Lengths up to which words go through their agendas together; longer ones go alone.
_WIDTHS = (5, 9, 15, 31)
#: Bytes of text that are worked on at once.
_SLICE = 8 << 20


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceVocabulary:
    """Pieces, scores and the table of pairs whose concatenation is a piece."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(n)]
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) for i in range(n)]
        self.unknown = self.library.unk_id()
        self.bytes = {int(names[i][1:-1], 16): i for i in range(n) if self.library.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.ids = {names[i]: i for i in range(n) if not special[i]}
        self.names = names
        # symbols: ids of pieces, and for characters that occur in pieces only, numbers from n on
        self.symbols = dict(self.ids)
        for piece in self.ids:
            for c in piece:
                self.symbols.setdefault(c, len(self.symbols) + n)
        self.size = max(self.symbols.values()) + 2  # the last number stands for any other character
        self.other = self.size - 1
        self.symbol_of = np.full(0x110000, self.other, np.int32)
        for symbol, number in self.symbols.items():
            if len(symbol) == 1:
                self.symbol_of[ord(symbol)] = number
        order = sorted({self.library.get_score(i) for i in self.ids.values()}, reverse=True)
        place = {s: k for k, s in enumerate(order)}
        rows = []
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = self.symbols.get(piece[:k]), self.symbols.get(piece[k:])
                if a is not None and b is not None:
                    rows.append((a * self.size + b, place[self.library.get_score(i)], i))
        rows.sort()
        self.keys, self.ranks, self.joined = (np.array(x, np.int64) for x in zip(*rows))
        self.pair = {k: (r, i) for k, r, i in rows}

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index into the pair table, or its length where the two don't join."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        found = self.keys[np.minimum(at, len(self.keys) - 1)] == key
        return np.where(found, at, len(self.keys))

    def agenda(self, text: str) -> list[int]:
        """Symbols of one text, by a heap of pairs."""
        symbols = [self.symbols.get(c, self.other) for c in text]
        before, after = list(range(-1, len(text) - 1)), [*range(1, len(text)), -1]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (hit := self.pair.get(symbols[a] * self.size + symbols[b])):
                heapq.heappush(heap, (hit[0], a, b, symbols[a], symbols[b]))

        for k in range(len(text) - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, x, y = heapq.heappop(heap)
            if symbols[a] != x or symbols[b] != y or after[a] != b:
                continue
            symbols[a], symbols[b] = self.pair[x * self.size + y][1], -1
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [s for s in symbols if s >= 0]

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of ids of each) of many short texts, a merge of each in every step."""
        lengths = np.array([len(t) for t in texts])
        width = int(lengths.max())
        grid = np.full((len(texts), width + 1), -1, np.int64)
        grid[np.repeat(np.arange(len(texts)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = self.symbol_of[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        none = len(self.keys)
        ranks, joined = np.append(self.ranks, 1 << 40), np.append(self.joined, -1)
        pairs = np.full((len(texts), width), none, np.int64)
        row, col = np.nonzero(grid[:, 1:] >= 0)
        pairs[row, col] = self.lookup(grid[row, col], grid[row, col + 1])
        live, done = np.arange(len(texts)), np.full((len(texts), width + 1), -1, np.int64)
        while len(live):
            best = ranks[pairs].argmin(axis=1)
            line = np.arange(len(live))
            hit = pairs[line, best]
            over = hit == none
            if over.any():
                done[live[over], : grid.shape[1]] = grid[over]
                go = ~over
                live, grid, pairs, best, hit = live[go], grid[go], pairs[go], best[go], hit[go]
                line = np.arange(len(live))
                if not len(live):
                    break
            cols = np.arange(grid.shape[1] - 1)
            grid = np.where(cols[None, :] <= best[:, None], grid[:, :-1], grid[:, 1:])
            grid[line, best] = joined[hit]
            if pairs.shape[1] < 2:
                done[live, : grid.shape[1]] = grid
                break
            cols = cols[:-1]
            pairs = np.where(cols[None, :] <= best[:, None], pairs[:, :-1], pairs[:, 1:])
            for at in (best - 1, best):
                some = np.flatnonzero((at >= 0) & (at < pairs.shape[1]))
                if len(some):
                    k = at[some]
                    left, right = grid[some, k], grid[some, k + 1]
                    pairs[some, k] = np.where(right >= 0, self.lookup(left, right), none)
        sizes = (done >= 0).sum(axis=1)
        flat = done[done >= 0]
        odd = np.flatnonzero((done >= len(self.names)).any(axis=1))
        if len(odd):  # characters without a piece of their own
            offsets = offsets_of(sizes)
            own = [self.to_ids(texts[k], flat[offsets[k] : offsets[k + 1]].tolist()) for k in odd]
            which = np.arange(len(texts))
            which[odd] = len(texts) + np.arange(len(odd))
            more = np.array([len(r) for r in own])
            flat, ends = gathered((np.concatenate([flat, np.array([i for r in own for i in r], np.int64)]), offsets_of(np.concatenate([sizes, more]))), which)
            sizes = np.diff(ends)
        return flat, sizes

    def to_ids(self, text: str, symbols: Iterable[int]) -> list[int]:
        """Piece ids; a character without a piece gives its bytes, or the unknown id where the vocabulary has none."""
        out, at = [], 0
        for s in symbols:
            if s < len(self.names):
                out.append(s)
                at += len(self.names[s])
                continue
            c = text[at]
            at += 1
            out += [self.bytes[b] for b in c.encode()] if self.bytes else [self.unknown]
        return out


class Codec:
    """Words to ids, and ids to text, for whole Arrow slices."""

    _SPLIT = re.compile(f"{BLANK}+[^{BLANK}]*")
    #: Words that go through their agendas at once.
    _TOGETHER = 8192

    def __init__(self, path: str, most: int = 100_000, check: bool = True):
        self.vocabulary, self.check = PieceVocabulary(path), check
        self.memory = WordIds(self.learn, most)
        v = self.vocabulary
        self.digits = pa.array([str(i) for i in range(len(v.names))], pa.string())
        pieces = [bytes([v.byte_of[i]]) if i in v.byte_of else name.replace(BLANK, " ").encode() for i, name in enumerate(v.names)]
        # every piece, and again without the blank that it begins with
        self.pieces = pa.array(pieces + [p.removeprefix(b" ") for p in pieces], pa.binary())

    def words(self, text: str) -> list[str]:
        """Words without the blank mark that each begins with."""
        return [w[1:] for w in self._SPLIT.findall(BLANK + text.replace(" ", BLANK))] if text else []

    def lists(self, texts: pa.Array) -> pa.ListArray:
        """Words of each text.  Where every blank stands between two words, they are what is between the blanks."""
        odd = pc.or_(pc.or_(pc.equal(texts, ""), pc.starts_with(texts, " ")), pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, BLANK)))
        lists = pc.split_pattern(texts, " ")
        if not pc.any(odd).as_py():
            return lists
        both = pa.concat_arrays([lists, pa.array([self.words(t) for t in texts.filter(odd).to_pylist()], pa.list_(pa.string()))])
        place, at = np.arange(len(texts)), np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        place[at] = len(texts) + np.arange(len(at))
        return both.take(pa.array(place))

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of ids of each) of distinct words, held against the library."""
        v = self.vocabulary
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        sizes = np.zeros(len(words), np.int64)
        lengths = np.array([len(w) for w in words]) + 1
        group = np.searchsorted(np.array(_WIDTHS), lengths)
        flats, places = [], []
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            if g == len(_WIDTHS):
                found = [np.array(v.to_ids(BLANK + words[k], v.agenda(BLANK + words[k])), np.int64) for k in at]
                sizes[at] = [len(f) for f in found]
                flats += found
                places.append(at)
                continue
            for k in range(0, len(at), self._TOGETHER):
                some = at[k : k + self._TOGETHER]
                flat, n = v.ids_of([BLANK + words[i] for i in some])
                flats.append(flat)
                places.append(some)
                sizes[some] = n
        order = np.concatenate(places) if places else np.zeros(0, np.int64)
        back = np.empty(len(words), np.int64)
        back[order] = np.arange(len(order))
        flat, offsets = gathered((np.concatenate(flats) if flats else np.zeros(0, np.int64), offsets_of(sizes[order])), back)
        if self.check:
            self.compare(words, flat, offsets)
        return flat.astype(np.int32), sizes

    def compare(self, words: list[str], flat: np.ndarray, offsets: np.ndarray) -> None:
        """Raise where the library gives other ids for a word; it has none for the empty one."""
        told = self.vocabulary.library.encode([w.replace(BLANK, " ") for w in words], num_threads=1)
        expected = np.fromiter((i for ids in told for i in ids), np.int64)
        ours = flat
        for k in [k for k, w in enumerate(words) if not w]:
            ours = np.delete(ours, np.arange(offsets[k], offsets[k + 1]))
        if len(ours) == len(expected) and (ours == expected).all():
            return
        for w, k, ids in zip(words, range(len(words)), told):
            if w and flat[offsets[k] : offsets[k + 1]].tolist() != ids:
                raise RuntimeError(f"the agenda gives {flat[offsets[k] : offsets[k + 1]].tolist()} for {w!r}, the library {ids}")

    def encode(self, texts: pa.Array) -> Ids:
        """(ids one after another, bounds of the texts) of texts without nulls."""
        words, which, bounds = numbered(self.lists(texts))
        flat, ends = gathered(self.memory.table(words, np.bincount(which, minlength=len(words))), which)
        return flat, ends[bounds]

    def decode(self, ids: Ids) -> pa.Array:
        """Texts of ids; the blank that each begins with goes.  Bytes that are no text become U+FFFD."""
        which = ids[0].astype(np.int32)
        which[ids[1][:-1][np.diff(ids[1]) > 0]] += len(self.digits)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ids[1].astype(np.int32)), self.pieces.take(pa.array(which))), b"")
        try:
            out = joined.cast(pa.string())
            out.validate(full=True)
            return out
        except pa.ArrowInvalid:
            return pa.array([b.decode(errors="replace") for b in joined.to_pylist()], pa.string())

    def decimal(self, ids: Ids) -> pa.Array:
        """Decimal ids joined by commas."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ids[1].astype(np.int32)), self.digits.take(pa.array(ids[0]))), ",")


_CODECS: dict[tuple[str, bool], Codec] = {}


def codec(path: str, check: bool = True) -> Codec:
    """One codec for each Python worker; what it remembers is a few MB."""
    if (path, check) not in _CODECS:
        _CODECS[path, check] = Codec(path, check=check)
    return _CODECS[path, check]


def encode_decode(docs: DataFrame, path: str | None = None, text: str = "text", keep: list[str] | None = None, check: bool = True) -> DataFrame:
    """The columns in ``keep`` (all by default), then ids, n_tokens and decoded of every row.

    No begin or end ids.  A null text counts as empty: no ids and an empty text.  Columns of
    the three names are replaced.  ``check`` compares each new word with the library.
    """
    return _run(docs, path, text, keep, check, digest=False)


def digests(docs: DataFrame, path: str | None = None, text: str = "text", keep: list[str] | None = None, check: bool = True) -> DataFrame:
    """Like ``encode_decode`` with hashes in the place of ids and text: n_tokens, ids_sha256, decoded_sha256."""
    return _run(docs, path, text, keep, check, digest=True)


def _run(docs: DataFrame, path: str | None, text: str, keep: list[str] | None, check: bool, digest: bool) -> DataFrame:
    path = path or vocabulary_path()
    added = T._parse_datatype_string("n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, n_tokens long, decoded string").fields
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in {f.name for f in added}]
    schema = T.StructType([*(docs.schema[c] for c in keep), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, check)
        sha = lambda column: pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in column], pa.string())
        for batch in batches:
            for part in text_slices(batch, "__text", _SLICE):
                ids = coder.encode(pc.fill_null(part.column("__text"), "").cast(pa.string()))
                n, decoded = pa.array(np.diff(ids[1])), coder.decode(ids)
                if digest:
                    extra = [n, sha(coder.decimal(ids)), sha(decoded)]
                else:
                    extra = [pa.ListArray.from_arrays(pa.array(ids[1].astype(np.int32)), pa.array(ids[0])), n, decoded]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *extra], names=schema.names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document and the text they give back: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, keep=["doc_id"])
