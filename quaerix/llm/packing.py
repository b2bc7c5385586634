"""Harmonic packing of token sequences.

Class k holds pieces of at most capacity / k tokens (and more than capacity / (k + 1));
a bin of class k takes exactly k pieces. Texts may be cut, so a text is cut into whole
bins and then into pieces of just ``capacity // k`` tokens, the largest first, until
the cuts would be smaller than they are worth. Every task fills its own bins, a
class at a time, and never waits for another; only what is left in its open bins
at its end is cut again and laid end to end, so that a task leaves one short
sequence at most.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaerix.llm.common import record

CAPACITY = 1024
#: Words of one generation that a worker remembers, a few hundred bytes each.
WORDS = 1 << 18
#: Cuts of one text after its whole sequences; the piece after the last cut goes to the class that it fits.
CUTS = 2
SEPARATOR = 0
#: Sequences of one task; a task's sequence ids start at its partition's number times this.
PER_TASK = 1 << 40

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class _Words(dict):
    """The ids of words, as little-endian bytes that need only be joined; words that are missing are asked for, and those of the present and
    the last generation are remembered."""

    def __init__(self, model, most: int) -> None:
        super().__init__()
        self.ask, self.most, self.before = model.tokenize, most, {}
        # Byte-level vocabularies write each byte as a printable character: itself if it is one in Latin-1, else the next from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        self.written = {b: b for b in printable} | {b: 256 + k for k, b in enumerate(rest)}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = packed([t.id for t in self.ask(word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.written))])
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """The ids that a vocabulary's tokenizer gives for whole texts.

    Byte-level BPE merges inside the words of a fixed pattern alone, and words come again: texts are parted into words
    here, and the library's model is asked once for each new word. A text with characters that the
    pattern may class otherwise than the library (all but Latin letters and common signs), or with the string of an added token, and any other kind of
    vocabulary, goes through the library as a whole.
    """

    _LETTERS, _BLANKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r" \t\n\r\f\v"
    # Fixed value: the pattern of the vocabulary's words, for the characters that _OTHER does not match. Letters come first, as most words do.
    _WORD = re.compile(rf" ?[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^{_BLANKS}{_LETTERS}0-9]+|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+")
    _OTHER = re.compile(rf"[^\x09-\x0d\x20-\x7e{_LETTERS}\u2010-\u2027\u20ac\u00a1-\u00a9\u00ab\u00ac\u00ae-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7]")

    def __init__(self, vocabulary: str, by_word: bool, added: list[str], words: int = WORDS) -> None:
        # One thread, since Spark's tasks are the threads.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_str(vocabulary)
        self.by_word, self.added = by_word, added
        self.known = _Words(self.own.model, words)

    def ids(self, text: str) -> bytes:
        """The ids, as `packed` gives them."""
        if not self.by_word or self._OTHER.search(text) or any(t in text for t in self.added):
            return packed(self.own.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.known.__getitem__, self._WORD.findall(text)))


def described(vocabulary: str) -> tuple[bool, list[str]]:
    """Whether a vocabulary's ids can be found word by word, and the strings of its added tokens."""
    said = json.loads(vocabulary)
    words, model = said.get("pre_tokenizer") or {}, said.get("model") or {}
    by_word = (
        said.get("normalizer") is None and words.get("type") == "ByteLevel" and not words.get("add_prefix_space") and words.get("use_regex", True)
        and model.get("type", "BPE") == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not said.get("truncation") and not said.get("padding")
    )
    return by_word, [t["content"] for t in said.get("added_tokens", [])]


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(vocabulary: str, by_word: bool, added: list[str], words: int = WORDS) -> Encoder:
    """A worker process's own encoder, which remembers words from task to task, up to its bound."""
    key = vocabulary, words
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary, by_word, added, words)
    return _ENCODERS[key]


def cut(n: int, capacity: int = CAPACITY, cuts: int = CUTS) -> list[int]:
    """Lengths of the pieces of a text of n tokens: whole bins, then reciprocal parts."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n and cuts:
        size = capacity // -(-capacity // n)  # the largest capacity // k that is not above n
        out.append(size)
        n -= size
        cuts -= 1
    if n:
        out.append(n)
    return out


class Bins:
    """The open bins of one task. `take` adds a piece and returns the bins that became full."""

    def __init__(self, capacity: int = CAPACITY) -> None:
        self.capacity, self.open = capacity, {}

    def take(self, piece: tuple) -> list[list[tuple]]:
        k = self.capacity // piece[2]
        held = self.open.setdefault(k, [])
        held.append(piece)
        return [self.open.pop(k)] if len(held) == k else []

    def rest(self) -> list[list[tuple]]:
        """What is left, cut anew and laid end to end."""
        out: list[list[tuple]] = []
        room = 0
        for doc, start, length, ids, total in (p for k in sorted(self.open) for p in self.open[k]):
            while length:
                if not room:
                    out.append([])
                    room = self.capacity
                now = min(room, length)
                out[-1].append((doc, start, now, ids[:now], total))
                start, length, ids, room = start + now, length - now, ids[now:], room - now
        self.open = {}
        return out


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, cuts: int = CUTS, text: str = "text", id_col: str = "doc_id", with_ids: bool = False, words: int = WORDS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    *vocabulary* is the path of a tokenizer's JSON file on the driver, which sends its contents to the tasks.
    A document is its token ids and then a separator (id 0); null text counts as
    empty, so every row gives a piece. Ids that repeat are documents of their
    own, and a null id stays null. Every token id lies in one piece; pieces of a sequence follow each other
    from offset 0. Nothing is shuffled: a task packs the rows that it reads and a
    rerun of it gives the same. A worker remembers the ids of up to twice *words* words: fewer take less memory and more time. An empty table gives no rows; other columns are ignored.
    """
    with open(vocabulary, encoding="utf-8") as f:
        json_text = f.read()
    shipped = docs.sparkSession.sparkContext.broadcast((json_text, *described(json_text)))
    schema = SCHEMA + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, bins = encoder(*shipped.value, words), Bins(capacity)
        base, made, end = TaskContext.get().partitionId() * PER_TASK, 0, packed([SEPARATOR])

        def laid(full: list[list[tuple]]) -> list[tuple]:
            nonlocal made
            rows = []
            for sequence in full:
                at = 0
                for doc, start, length, ids, total in sequence:
                    rows.append((doc, start, length, zlib.crc32(ids.tobytes()), total, base + made, at, *([ids.tolist()] if with_ids else [])))
                    at += length
                made += 1
            return rows

        def batched(rows: list[tuple]) -> pa.RecordBatch:
            return record(schema, *(zip(*rows, strict=True) if rows else [[]] * (7 + with_ids)))

        for batch in batches:
            rows: list[tuple] = []
            for doc, body in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.frombuffer(own.ids(body.decode("utf-8", "replace")) + end, dtype="<u4")
                at = 0
                for n in cut(len(ids), capacity, cuts):
                    rows += laid(bins.take((doc, at, n, ids[at : at + n], len(ids))))
                    at += n
            yield batched(rows)
        yield batched(laid(bins.rest()))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, schema)
