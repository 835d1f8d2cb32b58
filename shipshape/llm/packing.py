"""Packing documents into training sequences: vector bin packing by dot product.

A piece asks for a vector (tokens, one segment, loss-bearing tokens); a sequence offers what is
left of its three limits. The open sequence takes, from a pool of waiting pieces, the one that
fits and whose demand has the largest dot product with what is left; when none fits whole, the
largest is cut to fill it exactly. Each partition packs its own documents in one pass over them,
with a pool of bounded size: no shuffle, no group, nothing on the driver.
"""
from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipshape.llm import caches
from shipshape.llm.common import ship, text_of

MAX_TOKENS = 2048
MAX_SEGMENTS = 256
#: Closes every document.
END_ID = 1
#: Pieces that wait for a place at once in a task.
POOL = 512
#: Distinct words whose ids a Python worker remembers.
WORDS = 1_200_000

SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, "
          "sequence_id long, offset long, padded_length long")


def _visible() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where it is printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_VISIBLE = _visible()
#: Words by which a tokenizer shows whether its merges alone give a plain word's ids.
_PROBES = ("a", "the", "tokenizer", "straße", "ñandú", "œuvre", "éééê", "x" * 40, "łódź", "unbelievableness")


class WordTokenizer:
    """A ``tokenizers`` vocabulary that ignores white space between words: texts are cut at
    spaces and line feeds, which no token crosses, and each distinct word is encoded once.
    With ``added`` the vocabulary's added tokens, which hold no white space, are found in texts as the
    library does by default; without, their names are words like any other."""

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.model.encode_special_tokens = not added
        self.words: dict[str, bytes] = {}
        self.direct = all(self._merged(w) == self._whole(w) for w in _PROBES)

    def _whole(self, w: str) -> bytes:
        return array("I", self.model.encode(w, add_special_tokens=False).ids).tobytes()

    def _merged(self, w: str) -> bytes:
        """The ids of a lower-case word of Latin letters by the vocabulary's merges alone: normalising and
        splitting leave such a word as it is, and take longer than the merges."""
        return array("I", [t.id for t in self.model.model.tokenize(w.encode().decode("latin-1").translate(_VISIBLE))]).tobytes()

    def word(self, w: str) -> bytes:
        """The ids of one word as little-endian unsigned 32-bit numbers."""
        got = self.words.get(w)
        if got is None:
            plain = lambda s: s.isalpha() and max(s) < "ɐ" and "İ" not in s
            if len(w) > 1 and w[-1] in ".," and plain(w[:-1]):
                got = self.word(w[:-1]) + self.word(w[-1])
            elif plain(w) and w.lower() != w:
                got = self.word(w.lower())
            elif self.direct and plain(w):
                got = self._merged(w)
            else:
                got = self._whole(w)
            if len(self.words) >= WORDS:
                self.words.clear()
            self.words[w] = got
        return got

    def encode(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            return b"".join(map(self.word, words))


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path, added=True)


caches.register("packing", tokenizer.cache_clear)


class _Piece:
    __slots__ = ("doc", "start", "ids", "total", "quiet")

    def __init__(self, doc, start: int, ids: bytes | memoryview, total: int, quiet: int):
        self.doc, self.start, self.ids, self.total, self.quiet = doc, start, ids, total, quiet

    @property
    def tokens(self) -> int:
        return len(self.ids) >> 2

    def free(self) -> int:
        """Leading tokens of this piece that bear no loss."""
        return min(self.tokens, max(0, self.quiet - self.start))

    def loss(self) -> int:
        return self.tokens - self.free()

    def cut(self, n: int) -> _Piece:
        """Takes the first n tokens off; where the ids are a view, nothing is copied."""
        head = _Piece(self.doc, self.start, self.ids[:4 * n], self.total, self.quiet)
        self.ids, self.start = self.ids[4 * n:], self.start + n
        return head


class Packer:
    """Packs a stream of documents; ``add`` and ``finish`` yield closed sequences (lists of pieces)."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, pool: int = POOL):
        import numpy as np
        if min(max_tokens, max_segments, max_loss, pool) < 1:
            raise ValueError("every limit has to be at least 1")
        self.np, self.limits, self.most = np, np.array([max_tokens, max_segments, max_loss], float), pool
        self.pool: list[_Piece] = []
        self.need = np.zeros((pool + 1, 3))

    def add(self, doc, ids: bytes, quiet: int = 0) -> Iterator[list[_Piece]]:
        tokens, _, loss = map(int, self.limits)
        rest = _Piece(doc, 0, memoryview(ids), len(ids) >> 2, quiet)
        while rest.tokens > tokens or rest.loss() > loss:
            n = min(tokens, rest.free() + loss)
            if n == tokens:
                yield [rest.cut(n)]
            else:
                yield from self._wait(rest.cut(n))
        if rest.tokens == tokens:
            yield [rest]
        elif rest.tokens:
            yield from self._wait(rest)

    def _wait(self, piece: _Piece) -> Iterator[list[_Piece]]:
        piece.ids = bytes(piece.ids)  # a waiting piece doesn't hold its whole document
        self.need[len(self.pool)] = piece.tokens, 1, piece.loss()
        self.pool.append(piece)
        while len(self.pool) > self.most:
            yield from self._closed(self._fill())

    def _take(self, i: int) -> _Piece:
        piece, last = self.pool[i], self.pool.pop()
        if last is not piece:
            self.pool[i] = last
            self.need[i] = self.need[len(self.pool)]
        return piece

    def _fill(self) -> list[_Piece]:
        """One sequence from the pool."""
        np, left, out = self.np, self.limits.copy(), []
        while self.pool and left.min() >= 0 and left[0] and left[1]:
            need = self.need[:len(self.pool)]
            fits = (need <= left).all(1)
            if fits.any():
                gain = (need / self.limits) @ (left / self.limits)
                piece = self._take(int(np.argmax(np.where(fits, gain, -1.0))))
            else:  # cut the largest, so that nothing is left over
                i = int(np.argmax(need[:, 0]))
                n = min(int(left[0]), self.pool[i].free() + int(left[2]))
                if n < 1 or n >= self.pool[i].tokens:
                    break
                piece = self.pool[i].cut(n)
                self.need[i] = self.pool[i].tokens, 1, self.pool[i].loss()
            out.append(piece)
            left -= (piece.tokens, 1, piece.loss())
        return out

    def finish(self) -> Iterator[list[_Piece]]:
        """What still waits."""
        while self.pool:
            yield from self._closed(self._fill())

    def _closed(self, pieces: list[_Piece]) -> Iterator[list[_Piece]]:
        """A full sequence as it is; one that another limit closed, or the last one, cut at powers of two, which
        need no padding."""
        size = sum(p.tokens for p in pieces)
        if size == int(self.limits[0]):
            yield pieces
            return
        while size:
            room, out = 1 << (size.bit_length() - 1), []
            size -= room
            while room:
                piece = pieces[0]
                if piece.tokens > room:
                    piece = piece.cut(room)
                else:
                    pieces.pop(0)
                out.append(piece)
                room -= piece.tokens
            yield out


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS,
         max_loss: int | None = None, quiet: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    loss_tokens, sequence_id, offset in the sequence, padded_length of the sequence.

    A document is its ids and then ``END_ID``; a null or empty text is ``END_ID`` alone. Every id
    lies in exactly one piece. ``quiet`` names a column with the number of a document's first
    tokens that bear no loss, as the prompt of an instruction does (null: none). A sequence keeps
    ``max_tokens``, ``max_segments`` and ``max_loss`` (unless given, ``max_tokens``). Repeated rows
    and null ids are documents like any other; an empty table gives no pieces. Other columns are
    not read. sequence_id holds the partition and a count in it. Sequences are padded to
    ``max_tokens`` except where their length is a power of two.
    """
    most = max_tokens if max_loss is None else max_loss

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        caches.only("packing")
        words, packer = tokenizer(tokenizer_path), Packer(max_tokens, max_segments, most)
        number, rows = TaskContext.get().partitionId() << 33, []
        end = END_ID.to_bytes(4, "little")

        def closed(sequences):
            nonlocal number
            for pieces in sequences:
                at, size = 0, sum(p.tokens for p in pieces)
                full = size if size & (size - 1) == 0 else max_tokens
                for p in pieces:
                    rows.append((p.doc, p.start, p.tokens, bytes(p.ids), p.total, p.loss(), number, at, full))
                    at += p.tokens
                number += 1

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema=kinds)
            rows.clear()
            return out

        types = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 5
        kinds = pa.schema(list(zip((x.split()[0] for x in SCHEMA.split(", ")), types)))
        for b in batches:
            for doc, text, still in zip(*(c.to_pylist() for c in b.columns)):
                closed(packer.add(doc, words.encode(text) + end, max(0, still)))
                if len(rows) >= 4096:
                    yield batch()
        closed(packer.finish())
        if rows:
            yield batch()

    ship(docs.sparkSession)
    still = F.lit(0).cast("long") if quiet is None else F.coalesce(docs[quiet].cast("long"), F.lit(0))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"),
                       still.alias("quiet")).mapInArrow(run, SCHEMA)
