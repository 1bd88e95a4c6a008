"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece of text exactly one token can come last in the prefix's encoding. The
tokens that end at a position are the matches of an Aho-Corasick automaton over the vocabulary (in place of
a suffix automaton: it gives the same matches); the last token is the one among them that is compatible with the last token of the prefix before it: the pair must
encode to itself, which following the merges back decides. Back-pointers from the end give the ids.

Pieces repeat, so each Python worker keeps the ids of up to 2 * CACHED pieces and
as many runs. An encoder's size is
that of its vocabulary and cache, whatever the corpus.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.llm.common import text_batches

#: Fixed values of the byte-level format: the pattern that cuts a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE_AFTER_SPACE = regex.compile(r"\s ")
#: Pieces, and runs of pieces, in each of the two generations of a worker's cache.
CACHED = 250_000
#: Pairs of tokens whose compatibility a worker remembers.
PAIRS = 500_000
#: Longer pieces are not kept.
KEPT_CHARS = 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a vocabulary file: itself if it prints, else the next free one from 256."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(prints))
    letters = {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [letters[b] for b in range(256)]


class Encoder:
    """Encodes and decodes with the vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.letters = byte_letters()
        self.latin = {b: letter for b, letter in enumerate(self.letters)}
        #: (left id, right id): the rank of their merge and its id; id: rank and parts of the merge that makes it.
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for i, (a, b) in enumerate(merges):
            pair = vocab[a], vocab[b]
            self.rank.setdefault(pair, i)
            self.made.setdefault(vocab[a + b], (i, *pair))
        self.automaton = ahocorasick.Automaton()
        reachable = {*self.made, *(vocab[c] for c in self.letters if c in vocab)}
        for token, at in vocab.items():
            if at in reachable:
                self.automaton.add_word(token, (at, len(token)))
        self.automaton.make_automaton()
        self.size_of = {i: len(t) for t, i in vocab.items()}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.added = {t: str(i) for t, i in added.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        byte = {letter: b for b, letter in enumerate(self.letters)}
        self.bytes_of = {str(i): bytes(byte[c] for c in t) for t, i in vocab.items()} | {str(i): t.encode() for t, i in added.items()}
        self.pieces = regex.compile(PIECES)
        self.known: dict[int, bool] = {}  # pairs of ids: whether they are compatible
        self.new: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.new_runs: dict[str, str] = {}
        self.old_runs: dict[str, str] = {}

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of left's and right's text is [left, right].

        The text's merges run by rank. A merge across the boundary would join the piece that then ends
        left to the one that begins right; it happens if it comes before the merges that extend these
        two further. So both tokens are taken apart from their latest merge on, and each pair of edge
        pieces is held against the ranks at which it exists.
        """
        until = float("inf")  # the rank at which the pair of edge pieces ends
        rank, made = self.rank.get, self.made.get
        while True:
            across = rank((left, right))
            a, b = made(left), made(right)
            ra, rb = a[0] if a else -1, b[0] if b else -1
            if across is not None and across < until:
                # of equal ranks the leftmost pair merges first; an overlap can only be a merge inside right
                return False
            if a is None and b is None:
                return True
            if ra > rb:
                left, until = a[2], ra
            elif rb > ra:
                right, until = b[1], rb + 1
            else:  # the same token on both sides: right's latest merge is undone first, left's before it in the text
                right, until = b[1], rb + 1

    def piece(self, text: str) -> str:
        """The ids of a piece, joined by commas."""
        mapped = text.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.latin)
        last = [-1] * (len(mapped) + 1)  # of each prefix: the id of its last token
        known, broken = self.known, self._broken
        for end, (at, size) in self.automaton.iter(mapped):
            end += 1
            if last[end] >= 0:
                continue
            if size == end:
                if at not in broken:
                    last[end] = at
                continue
            left = last[end - size]
            if left >= 0:
                fits = known.get(left << 32 | at)
                if fits is None:
                    if len(known) >= PAIRS:
                        known.clear()
                    fits = known[left << 32 | at] = self._compatible(left, at)
                if fits:
                    last[end] = at
        out: list[str] = []
        end = len(mapped)
        while end:
            at = last[end]
            if at < 0:
                raise ValueError(f"no encoding of {text!r}")
            out.append(str(at))
            end -= self.size_of[at]
        return ",".join(reversed(out))

    @functools.cached_property
    def _broken(self) -> set[int]:
        """Ids whose own text does not encode to them (none in a vocabulary whose merges made it)."""
        return {at for at, (_, a, b) in self.made.items() if not self.compatible_before(a, b, at)}

    def compatible_before(self, a: int, b: int, at: int) -> bool:
        """Whether merging the parts a and b is how their joined text reaches the id at."""
        rank = self.made[at][0]
        left, right = a, b
        until = float("inf")
        first = True
        while True:
            across = self.rank.get((left, right))
            if across is not None and across < until and not (first and across == rank):
                return False
            first = False
            x, y = self.made.get(left), self.made.get(right)
            if x is None and y is None:
                return True
            rx, ry = x[0] if x else -1, y[0] if y else -1
            if rx > ry:
                left, until = x[2], rx
            else:
                right, until = y[1], ry + 1

    def _words(self, text: str, out: list[str]) -> None:
        """Append the ids of each piece of a text."""
        new, old = self.new, self.old
        for p in self.pieces.findall(text):
            ids = new.get(p)
            if ids is None:
                ids = old.get(p)
                if ids is None:
                    ids = self.piece(p)
                if len(p) <= KEPT_CHARS:
                    if len(new) >= CACHED:
                        self.old = old = new
                        self.new = new = {}
                    new[p] = ids
            out.append(ids)

    def encode(self, text: str) -> str:
        """The ids of a text, joined by commas; the text of an added token gets its id wherever it stands.

        No piece goes on past white space that follows something else, so where every space stands
        alone, the runs from one space to the next are encoded, and kept, as wholes.
        """
        parts = self.cut.split(text) if self.cut else [text]
        out: list[str] = []
        new, old = self.new_runs, self.old_runs
        for part in parts:
            if part in self.added:
                out.append(self.added[part])
                continue
            if SPACE_AFTER_SPACE.search(part):
                self._words(part, out)
                continue
            lead = ""
            for run in part.split(" "):
                run = lead + run
                lead = " "
                ids = new.get(run)
                if ids is None:
                    ids = old.get(run)
                    if ids is None:
                        own: list[str] = []
                        self._words(run, own)
                        ids = ",".join(own)
                    if len(run) <= KEPT_CHARS:
                        if len(new) >= CACHED:
                            self.old_runs = old = new
                            self.new_runs = new = {}
                        new[run] = ids
                if ids:
                    out.append(ids)
        return ",".join(out)

    def decode(self, ids: str) -> str:
        """The text of ids joined by commas; bytes that are no UTF-8 become U+FFFD."""
        if not ids:
            return ""
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))).decode("utf-8", "replace")


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder per vocabulary and Python worker."""
    return Encoder(path)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row's whole text.

    path: a tokenizer file that every executor has. docs: doc_id, text; other columns are ignored. A
    null text is empty: no tokens, and the digests of empty strings. Repeated rows come back as often.
    """
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for text in b.column(1).to_pylist():
                ids = e.encode(text or "")
                n.append(ids.count(",") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(e.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array<int>) of every row's whole text; nulls as in encode_digests."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            ids = [[int(i) for i in s.split(",")] if (s := e.encode(t or "")) else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids (array<int>; null counts as empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            texts = [e.decode(",".join(map(str, ids or []))) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
