"""Packing documents into sequences: order-preserving dynamic programming.

Every partition of the documents is packed where it is, in the order of ids (and, of
rows with one id, of texts), so no text is shuffled and nothing depends on how large the
optimiser takes the table to be. Runs of some megabytes of text become one run of
token ids with an end id after each document. The run is cut into windows of at most
`size` ids. Cuts are free of charge after a document, cost a little after a sentence, and
more elsewhere (used only where sentences exceed a window); a window costs its padding,
none where its length is a power of two from 64 on. The cheapest cuts come from
f[j] = penalty[j] + min(f[i] + padding(i, j)), where the minimum over a sliding range of i
is kept in a monotone queue.

Defined results: a null text is an empty one, whose document is the end id alone.
Repeated ids are documents of their own, one after the other; so are rows with a null id,
however many there are, as rows are dealt by their bytes and not by their ids. Other columns
are ignored, whatever their names. No documents, no rows.
"""

from __future__ import annotations

import string
import unicodedata
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixspark.llm.common import table
from mixspark.llm.text import pieces, texts_of

SIZE = 4096
END = 2
#: Penalties in ids of padding: for a cut after a sentence, and elsewhere within a document.
AFTER_SENTENCE, WITHIN = 2, 64
#: Bytes of text that are cut into windows together.
SHARD = 3 << 20
#: Words that a worker remembers the ids of, at most; then it starts anew.
REMEMBERED = 400_000
#: Shortest window whose length counts as a power of two.
LEAST_POWER = 64
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_PUNCTUATION = string.punctuation
_WHITE = regex.compile(r"[^\S\x1c-\x1f]+")


class Encoder:
    """Ids of texts, by way of their words: the tokenizer drops white space and never joins across it.

    A word that isn't known yet is normalised and split here as the tokenizer file says
    (NFC, lower case, its pattern, its bytes as characters); its model gives the ids.
    Words of letters with punctuation behind them, which are most, need no pattern;
    what words consist of is remembered too, as it recurs in words of other case or ending.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path) as f:
            pattern = json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # White space to the tokenizer is what Unicode calls so; Python adds the four separators.
        self.pattern = regex.compile(pattern.replace(r"\s", r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"))
        # Printable bytes stand for themselves, the others for the characters from 256 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in set(plain)]
        self.character = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}
        self.integers = list(range(self.tokenizer.get_vocab_size()))
        self.forget()

    def forget(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.parts: dict[str, tuple[int, ...]] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.length, self.stops = (np.zeros(1 << 14, k) for k in (np.int64, np.int32, bool))

    def _part(self, part: str) -> tuple[int, ...]:
        text = part if part.isascii() and part.isprintable() else "".join([self.character[b] for b in part.encode()])
        # One object for each id, however often it is remembered.
        ids = self.parts[part] = tuple([self.integers[t.id] for t in self.tokenizer.model.tokenize(text)])
        return ids

    def _learn(self, words: list[str], n: int) -> None:
        """The ids of words, which have the numbers from n on."""
        got: list[int] = []
        ends, known, part = [], self.parts.get, self._part
        for word in words:
            if not word.isascii():
                word = unicodedata.normalize("NFC", word)
            word = "".join([c.lower() for c in word]) if "\u03a3" in word else word.lower()
            stem = word.rstrip(_PUNCTUATION)
            if stem.isalpha():
                got += known(stem) or part(stem)
                if len(stem) < len(word):
                    tail = word[len(stem) :]
                    got += known(tail) or part(tail)
            else:
                for x in self.pattern.findall(word):
                    got += known(x) or part(x)
            ends.append(len(got))
        sizes = np.diff(np.array(ends, np.int64), prepend=0)
        while n + len(words) > len(self.at):
            self.at, self.length, self.stops = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.length, self.stops))
        total = len(got)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = np.array(got, np.uint32)
        self.at[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.length[n : n + len(words)] = sizes
        self.stops[n : n + len(words)] = [w[-1] in ".!?" for w in words]
        self.used += total

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, the end of each text in them, and where sentences end."""
        words, counts = [], []
        for t in texts:
            # str.split also splits at the four separators 0x1C to 0x1F, which are ordinary characters to the tokenizer.
            own = [x for x in _WHITE.split(t) if x] if any(x in t for x in _SEPARATORS) else t.split()
            words += own
            counts.append(len(own))
        if len(self.number) > REMEMBERED:
            self.forget()
        known = len(self.number)
        # A word that isn't known gets the next number.
        n = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if len(self.number) > known:
            self._learn([*islice(reversed(self.number), len(self.number) - known)][::-1], known)
        length = self.length[n].astype(np.int64)
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(n) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.at[n] - (ends - length), length)]
        return ids, np.concatenate([[0], ends])[np.cumsum(counts)], ends[self.stops[n]]


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def cheapest_cuts(positions: np.ndarray, penalty: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, int]:
    """Positions of the cuts and their cost. positions: where cuts may be, ascending, first 0 and last the end, no gap over size."""
    n = len(positions)
    if n < 2:
        return positions[:1], 0
    powers: dict[int, list[int]] = {}
    p = LEAST_POWER
    while p < size:
        i = np.minimum(np.searchsorted(positions, positions - p), n - 1)
        j = np.flatnonzero(positions[i] == positions - p)
        for a, b in zip(j.tolist(), i[j].tolist(), strict=True):
            powers.setdefault(a, []).append(b)
        p *= 2
    pos = positions.tolist()
    cost, came = [0] * n, [0] * n
    # The monotone queue, from `head` on: positions, least costs plus position, numbers.
    at, least, number, head = [0], [0], [0], 0
    get = powers.get
    for j, (x, pen) in enumerate(zip(pos, penalty.tolist(), strict=True)):
        if not j:
            continue
        low = x - size
        while at[head] < low:
            head += 1
        best, i = least[head] - low, number[head]
        if (more := get(j)) is not None:
            for k in more:
                if cost[k] < best:
                    best, i = cost[k], k
        best += pen
        cost[j], came[j] = best, i
        v = best + x
        while len(least) > head and least[-1] >= v:
            del at[-1], least[-1], number[-1]
        at.append(x)
        least.append(v)
        number.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(pos[j])
        j = came[j]
    return np.array([0, *reversed(cuts)], np.int64), cost[-1]


def _merged(runs: list[np.ndarray]) -> np.ndarray:
    """Distinct numbers of some ascending runs, ascending."""
    x = np.concatenate(runs)
    x.sort(kind="stable")
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


def may_cut(doc_ends: np.ndarray, sentence_ends: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Where cuts may be, with their penalties: after documents and sentences, and within those that exceed a window."""
    positions = _merged([np.zeros(1, np.int64), doc_ends, sentence_ends])
    wide = np.flatnonzero(np.diff(positions) > size)
    if len(wide):
        positions = _merged([positions, *[np.arange(positions[k] + size, positions[k + 1], size) for k in wide]])
    penalty = np.full(len(positions), WITHIN)
    penalty[np.searchsorted(positions, sentence_ends)] = AFTER_SENTENCE
    penalty[np.searchsorted(positions, doc_ends)] = 0
    return positions, penalty


class _Run:
    """Token ids of the documents that are cut into windows together."""

    def __init__(self):
        self.names, self.parts, self.sentences, self.ends, self.total, self.bytes = [], [], [], [], 0, 0

    def add(self, encoder: Encoder, names: pa.Array, texts: list[str], size: int) -> None:
        ids, stop, stops = encoder.encode(texts)
        # An end id goes in after each text: what lies behind it moves by one for each.
        self.sentences.append(stops + np.searchsorted(stop, stops) + self.total)
        ids = np.insert(ids, stop, END)
        self.ends.append(stop + np.arange(1, len(stop) + 1) + self.total)
        self.parts.append(ids)
        self.names.append(names)
        self.total += len(ids)
        self.bytes += size

    def cut(self, first: int, size: int, with_ids: bool) -> tuple[list[pa.Array], int]:
        """Columns of the pieces, whose sequences are numbered from `first` on, and how many sequences there are."""
        ids, doc_ends = np.concatenate(self.parts).astype("<u4"), np.concatenate(self.ends)
        sizes = np.diff(doc_ends, prepend=0)
        cuts, _ = cheapest_cuts(*may_cut(doc_ends, np.concatenate(self.sentences), size), size)
        edges = _merged([doc_ends, cuts])
        begin, end = edges[:-1], edges[1:]
        doc, seq = np.searchsorted(doc_ends, begin, "right"), np.searchsorted(cuts, begin, "right") - 1
        raw = memoryview(ids).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        columns = [pa.concat_arrays(self.names).take(pa.array(doc)), pa.array(begin - (doc_ends - sizes)[doc]), pa.array(end - begin), pa.array(crc, pa.int64()), pa.array(sizes[doc]), pa.array(seq + first), pa.array(begin - cuts[seq])]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int32))))
        return columns, len(cuts) - 1


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json", size: int = SIZE, shard_bytes: int = SHARD, with_ids: bool = False) -> DataFrame:
    """A row for each piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids the ids (array<int>)."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def run(batches):
        import os

        import public_tokenizers
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoder(public_tokenizers.path(vocabulary))
        now, first = _Run(), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in pieces(batch, "_text"):
                now.add(encoder, part.column("_id"), texts_of(part.column("_text")), pc.sum(pc.binary_length(part.column("_text"))).as_py())
                if now.bytes >= shard_bytes:
                    columns, n = now.cut(first, size, with_ids)
                    yield pa.RecordBatch.from_arrays(columns, names)
                    now, first = _Run(), first + n
        if now.parts:
            yield pa.RecordBatch.from_arrays(now.cut(first, size, with_ids)[0], names)

    schema = f"{id_col} {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # In order, a task that runs again gives the same pieces, however its input was fetched.
    return rows.sortWithinPartitions("_id", "_text").mapInArrow(run, schema)


def op6_dp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids."""
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op6_dp_packing": op6_dp_packing}
