"""Secret scans: fixed patterns, and character Markov models for what they don't name.

Three patterns find assigned passwords and tokens, access keys and long runs of hex digits.
Anything else that looks like key material is found by likelihood: a token of key
characters is read by first-order Markov models, one for each kind of random string that the
patterns label (hex digits, capitals and digits, mixed) and one for ordinary identifiers and
words, which are the tokens of the same texts outside of labelled spans.  A token whose
best random model beats the ordinary one by enough, in all and a character, is a secret.

Models are tables of counts, learnt from a bounded number of distinct texts; each random
model starts from the even distribution over its characters, so a corpus without a
labelled secret has models too.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import text_slices

#: Patterns by kind, in the order in which spans of one start are listed; all but the last find no shorter match that counts.
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]{12,}"),
    "hex": re.compile(r"[0-9a-f]{32,}"),
}
LEARNT = "markov"
#: Least length of an assigned value, and of tokens that the models judge or learn from.
LEAST_VALUE, LEAST_JUDGED, LEAST_LEARNT = 8, 16, 4

_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+")
_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Place of a character in the models' tables; the last place is the beginning of a token.
_PLACE = np.full(128, -1, np.int64)
_PLACE[[ord(c) for c in _CHARS]] = np.arange(len(_CHARS))
_SIZE = len(_CHARS) + 1
#: How much of the ordinary model goes by what followed a character; the rest by characters alone, and evenly.
_SEEN = 0.85
#: Characters of the random kinds before anything is learnt.
_ALPHABETS = {"hex": "0123456789abcdef", "access": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "assign": _CHARS}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the patterns find, by start, then kind as listed."""
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text):
            if kind != "assign" or m.end(2) - m.start(2) >= LEAST_VALUE:
                out.append((m.start(), order, m.end(), kind))
    return [(start, end, kind) for start, _, end, kind in sorted(out)]


def free_tokens(text: str, spans: list[tuple[int, int, str]], least: int) -> list[tuple[int, int]]:
    """(start, end) of tokens of key characters that touch no span."""
    out, at = [], 0
    spans = sorted(s[:2] for s in spans)
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        if end - start < least:
            continue
        while at < len(spans) and spans[at][1] <= start:
            at += 1
        # spans may overlap each other, so a later one can begin earlier than it ends
        if not any(a < end and b > start for a, b in spans[at : at + 4]):
            out.append((start, end))
    return out


def transitions(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place in a flattened table for each character, where each token begins there)."""
    joined = "".join(tokens).encode("ascii")
    now = _PLACE[np.frombuffer(joined, np.uint8)]
    begins = np.concatenate([[0], np.cumsum([len(t) for t in tokens])[:-1]]).astype(np.int64) if tokens else np.zeros(0, np.int64)
    before = np.concatenate([[0], now[:-1]]) if len(now) else now
    before[begins] = _SIZE - 1
    return before * _SIZE + now, begins


def case_steps(tokens: list[str]) -> np.ndarray:
    """For each character, a place in a table of (before: beginning, small, capital, other; now: small, capital, other)."""
    codes = np.frombuffer("".join(tokens).encode("ascii"), np.uint8)
    now = np.where((codes >= 97) & (codes <= 122), 0, np.where((codes >= 65) & (codes <= 90), 1, 2))
    before = np.concatenate([[0], now[:-1] + 1]) if len(now) else now
    before[np.concatenate([[0], np.cumsum([len(t) for t in tokens])[:-1]]).astype(np.int64) if tokens else []] = 0
    return before * 3 + now


@dataclass
class Models:
    """Log-likelihood tables, flattened: of random kinds, and of ordinary tokens (characters without case, and case)."""

    random: np.ndarray
    ordinary: np.ndarray
    case: np.ndarray

    def judge(self, tokens: list[str]) -> np.ndarray:
        """How much likelier, as a logarithm, each token is as a random string of any kind than as an ordinary one."""
        at, begins = transitions(tokens)
        if not len(begins):
            return np.zeros(0)
        random = np.array([np.add.reduceat(table[at], begins) for table in self.random])
        ordinary = np.add.reduceat(self.ordinary[transitions([t.lower() for t in tokens])[0]] + self.case[case_steps(tokens)], begins)
        return random.max(axis=0) - math.log(len(self.random)) - ordinary


def fit(docs: DataFrame, sample_docs: int = 20_000, prior: float = 2000.0, text: str = "text") -> Models:
    """Models of the labelled and the other tokens of about ``sample_docs`` distinct texts, picked by a hash.

    prior: characters that the even distribution of a random kind counts for.  Null and
    empty texts teach nothing.
    """
    given = docs.where(F.length(text) > 0).select(F.col(text).alias("text"))
    n = given.agg(F.approx_count_distinct(F.xxhash64("text"))).first()[0]
    share = min(1.0, sample_docs / max(n, 1))
    picked = given.where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < int(share * (1 << 40)) + 1).distinct()
    kinds = [*PATTERNS, "ordinary"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(kinds) + 1, _SIZE * _SIZE), np.int64)
        for batch in batches:
            for (value,) in zip(batch.column("text")):
                t = value.as_py()
                spans = base_spans(t)
                tokens: dict[str, list[str]] = {k: [] for k in kinds}
                for start, end, kind in spans:
                    found = PATTERNS[kind].match(t, start, end)
                    tokens[kind].append(re.sub(r"[^A-Za-z0-9+/_=-]", "", found.group(2) if kind == "assign" else found.group()))
                written = [t[a:b] for a, b in free_tokens(t, spans, LEAST_LEARNT)]
                tokens["ordinary"] = [w.lower() for w in written]
                for k, at in enumerate([transitions(tokens[kind])[0] for kind in kinds] + [case_steps(written)]):
                    place, n = np.unique(at, return_counts=True)
                    total[k, place] += n
        k, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[k, at])], names=["kind", "place", "n"])

    counts = np.zeros((len(kinds) + 1, _SIZE, _SIZE))
    for r in picked.mapInArrow(count, "kind int, place int, n long").groupBy("kind", "place").agg(F.sum("n").alias("n")).collect():  # at most one row a place
        counts[r["kind"]].flat[r["place"]] = r["n"]
    random = []
    for k, kind in enumerate(PATTERNS):
        even = np.zeros(_SIZE)
        even[_PLACE[[ord(c) for c in _ALPHABETS[kind]]]] = 1 / len(_ALPHABETS[kind])
        # characters outside of the kind's alphabet cost much, but can happen
        random.append(np.log((counts[k] + prior / _SIZE * even + 1e-6) / (counts[k] + prior / _SIZE * even + 1e-6).sum(axis=1, keepdims=True)).ravel())
    # ordinary tokens are read without case, as identifiers are written in any; any character may follow any
    seen, folded = counts[-2], sorted({_PLACE[ord(c)] for c in _CHARS.lower()})
    even = np.zeros(_SIZE)
    even[folded] = 1 / len(folded)
    alone = (seen.sum(axis=0) + even) / (seen.sum() + 1)
    ordinary = np.log(_SEEN * (seen + even) / (seen.sum(axis=1, keepdims=True) + 1) + (1 - _SEEN) * (alone + even) / 2 + 1e-12).ravel()
    steps = counts[-1].ravel()[:12].reshape(4, 3)
    letters = steps[:, :2] + 0.5
    case = np.zeros((4, 3))  # digits and marks cost nothing more than as characters
    case[:, :2] = np.log(letters / letters.sum(axis=1, keepdims=True) / 2 + 0.25)
    return Models(np.array(random), ordinary, case.ravel())


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, models: Models, doc_id: str = "doc_id", text: str = "text", least: float = 8.0, least_a_char: float = 0.3) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every whole text.

    spans: all spans as kind:start:end (code points, end exclusive), by start, then kind as
    listed in ``PATTERNS``, then the learnt ones: tokens of 16 characters or more that touch
    no base span and are likelier random by ``least`` in all and ``least_a_char`` a character.
    A null text is empty; a row of a repeated id is scanned by itself; null ids stay null;
    other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text"):
                texts = ["" if v is None else v for v in batch.column("text").to_pylist()]
                base = [base_spans(t) for t in texts]
                tokens = [(k, a, b) for k, (t, s) in enumerate(zip(texts, base)) for a, b in free_tokens(t, s, LEAST_JUDGED)]
                ratio = models.judge([texts[k][a:b] for k, a, b in tokens])
                spans = [list(s) for s in base]
                for (k, a, b), r in zip(tokens, ratio):
                    if r >= max(least, least_a_char * (b - a)):
                        spans[k].append((a, b, LEARNT))
                order = {kind: n for n, kind in enumerate([*PATTERNS, LEARNT])}
                columns = [batch.column("doc_id")]
                columns += [pa.array([sum(s[2] == kind for s in found) for found in base], pa.int64()) for kind in PATTERNS]
                columns.append(pa.array([hashlib.sha256(listed(found).encode()).hexdigest() for found in base], pa.string()))
                columns.append(pa.array([listed(sorted(s, key=lambda x: (x[0], order[x[2]]))) for s in spans], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{kind}" for kind in PATTERNS), "base_sha256", "spans"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, by the patterns and by models learnt from what they label."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, fit(docs))
