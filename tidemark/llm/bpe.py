"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token is a linked list of byte tokens. Every adjacent pair whose joined bytes have a rank is put into the bucket
of that rank; a bucket holds list positions. Two levels of bitmaps tell which buckets are not empty, so the next rank is
found by two find-first-set steps. Entries whose pair has changed meanwhile are stale and skipped. A pre-token
of n bytes takes O(n log n) steps, however long it is.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A worker remembers pre-tokens of at most KEEP_BYTES bytes in two generations of about KEEP each.
KEEP, KEEP_BYTES = 300_000, 64
#: Characters of text that are encoded together.
SLICE = 6_000_000
#: Ids are below 2**SHIFT; a pair is one integer.
SHIFT = 24


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """The rank of the joined bytes of every pair of tokens whose joined bytes have one."""
    out = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                out[left << SHIFT | right] = rank
    return out


def merge(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """Merges the byte tokens of one pre-token; of equal ranks the leftmost pair goes first.

    The queue has a bucket for each rank: one position, or a heap of them. Two levels of bitmaps say which buckets hold any:
    `low` has a 64-bit word for each 64 ranks, `top` one bit for each word that is not 0.
    """
    n = len(ids)
    get = pairs.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    due = [get(a << SHIFT | b, -1) for a, b in zip(ids, ids[1:])]  # the rank of the pair that starts here
    due.append(-1)
    buckets: dict[int, int | list[int]] = {}
    low: dict[int, int] = {}
    top = 0

    def push(rank: int, at: int) -> None:
        held = buckets.get(rank)
        if held is None:
            buckets[rank] = at
        elif held.__class__ is int:
            buckets[rank] = [held, at] if held < at else [at, held]
        else:
            heapq.heappush(held, at)

    for i, rank in enumerate(due):
        if rank >= 0:
            if rank not in buckets:
                word = rank >> 6
                low[word] = low.get(word, 0) | 1 << (rank & 63)
                top |= 1 << word
            push(rank, i)
    while top:
        # find first set: the lowest word, its lowest bit
        word = (top & -top).bit_length() - 1
        bits = low[word]
        bit = bits & -bits
        rank = word << 6 | bit.bit_length() - 1
        held = buckets[rank]
        if held.__class__ is int:
            i = held
            last = True
        else:
            i = heapq.heappop(held)
            last = not held
        if last:
            del buckets[rank]
            low[word] = bits = bits ^ bit
            if not bits:
                top ^= 1 << word
        if due[i] != rank:
            continue  # stale: the pair has changed since it was put in
        j = after[i]
        ids[i] = rank
        ids[j] = due[j] = -1
        k = after[i] = after[j]
        h = before[i]
        if k < n:
            before[k] = i
            due[i] = r = get(rank << SHIFT | ids[k], -1)
            if r >= 0:
                if r not in buckets:
                    w = r >> 6
                    low[w] = low.get(w, 0) | 1 << (r & 63)
                    top |= 1 << w
                push(r, i)
        else:
            due[i] = -1
        if h >= 0:
            due[h] = r = get(ids[h] << SHIFT | rank, -1)
            if r >= 0:
                if r not in buckets:
                    w = r >> 6
                    low[w] = low.get(w, 0) | 1 << (r & 63)
                    top |= 1 << w
                push(r, h)
    return [x for x in ids if x >= 0]


class Pool:
    """The same queue for many pre-tokens at once: one linked list, whose links never cross from one pre-token to the next.

    A bucket holds the positions of all of them. When a rank's turn comes, the leftmost live position of each pre-token is
    merged, all in one numpy step; others of the same pre-token go back, so each pre-token sees the order it would see alone.
    """

    def __init__(self, byte_ids: list[int], pairs: dict[int, int]):
        self.byte_ids = np.array(byte_ids, np.int32)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int32)

    def ranks_of(self, left, right) -> np.ndarray:
        key = np.left_shift(left, SHIFT, dtype=np.int64) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has. No word is empty."""
        size = np.array([len(w) for w in words])
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(ids)
        word_of = np.repeat(np.arange(len(words), dtype=np.int32), size)
        first = np.cumsum(size) - size
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        before[first], after[first + size - 1] = -1, -1
        due = np.full(n, -1, np.int32)
        inner = np.flatnonzero(after >= 0)
        due[inner] = self.ranks_of(ids[inner], ids[inner + 1])
        buckets: dict[int, list[np.ndarray]] = {}
        low: dict[int, int] = {}
        top = 0
        fresh = inner
        while True:
            if len(fresh):  # put in what is new, by rank
                ranks = due[fresh]
                fresh, ranks = fresh[ranks >= 0], ranks[ranks >= 0]
                order = np.argsort(ranks, kind="stable")
                fresh, ranks = fresh[order], ranks[order]
                cuts = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]])) if len(ranks) else ranks
                ends = np.append(cuts[1:], len(ranks)).tolist()
                for r, c, e in zip(ranks[cuts].tolist(), cuts.tolist(), ends, strict=False):
                    held = buckets.get(r)
                    if held is None:
                        buckets[r] = [fresh[c:e]]
                        w = r >> 6
                        low[w] = low.get(w, 0) | 1 << (r & 63)
                        top |= 1 << w
                    else:
                        held.append(fresh[c:e])
            if not top:
                break
            w = (top & -top).bit_length() - 1
            bits = low[w]
            bit = bits & -bits
            rank = w << 6 | bit.bit_length() - 1
            held = buckets.pop(rank)
            low[w] = bits = bits ^ bit
            if not bits:
                top ^= 1 << w
            p = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            p = p[due[p] == rank]  # others are stale
            if len(p) > 1:
                p.sort()
                owner = word_of[p]
                lead = np.ones(len(p), bool)
                lead[1:] = owner[1:] != owner[:-1]
                if not lead.all():
                    buckets[rank] = [p[~lead]]
                    low[w] = low.get(w, 0) | bit
                    top |= 1 << w
                    p = p[lead]
            elif not len(p):
                fresh = p
                continue
            j = after[p]
            k = after[j]
            ids[p], ids[j] = rank, -1
            due[p], due[j] = -1, -1
            after[p] = k
            right = k >= 0
            pr, kr = p[right], k[right]
            before[kr] = pr
            due[pr] = self.ranks_of(np.int64(rank), ids[kr])
            h = before[p]
            h = h[h >= 0]
            due[h] = self.ranks_of(ids[h], np.int64(rank))
            fresh = np.concatenate([pr, h])
        live = ids >= 0
        return ids[live], np.bincount(word_of[live], minlength=len(words))


class Codec:
    """Encodes and decodes whole texts by a file of ranks; each match of the pattern is merged by itself."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {str(i): b for b, i in self.ranks.items()}
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs = pair_ranks(self.ranks)
        self.pool = Pool(self.byte_ids, self.pairs)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def _learn(self, words: set[str]) -> dict[str, str]:
        """Ids of words that are not known: those of the vocabulary, short ones in one pool, long ones each by itself."""
        out, short = {}, []
        for word in words:
            ids = self.older.get(word)
            if ids is None:
                raw = word.encode("utf-8")
                whole = self.ranks.get(raw)
                if whole is not None:
                    ids = str(whole)
                elif len(raw) <= KEEP_BYTES:
                    short.append((word, raw))
                    continue
                else:
                    ids = " ".join(map(str, merge([self.byte_ids[b] for b in raw], self.pairs)))
            out[word] = ids
        if short:
            ids, count = self.pool.merge([raw for _, raw in short])
            text, at = list(map(str, ids.tolist())), 0
            for (word, _), n in zip(short, count.tolist(), strict=True):
                out[word] = " ".join(text[at : at + n])
                at += n
        return out

    def encode_texts(self, texts: list[str]) -> list[str]:
        """Of each text its decimal ids joined by one space; an empty text has none."""
        split = [self.split(t) for t in texts]
        used = set().union(*split)
        if len(self.known) > KEEP:
            self.older, self.known = self.known, {}
        known = self.known
        known.update(self._learn({w for w in used if w not in known}))
        out = [" ".join([known[w] for w in words]) for words in split]
        for word in [w for w in used if len(w) > KEEP_BYTES]:
            del known[word]
        return out

    def encode_text(self, text: str) -> str:
        return self.encode_texts([text])[0]

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_text(text).split()]

    def decode_text(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_text(" ".join(map(str, ids)))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encoded(c: Codec, column: pa.Array):
    """Ids of each text, sliced so that memory is bounded; null is empty."""
    held, size = [], 0
    for value in column:
        text = value.as_py() or ""
        held.append(text)
        size += len(text)
        if size >= SLICE:
            yield from c.encode_texts(held)
            held, size = [], 0
    yield from c.encode_texts(held)


def encode_column(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with an array<int> column of token ids, whole texts, no special tokens. Null is read as the empty text.

    All other columns are kept; a column named like out is replaced. Rows stay where they are: no shuffle.
    """
    @F.pandas_udf("array<int>")
    def ids(s):
        c = codec(ranks_path, pattern)
        return s.map(lambda x: c.encode(x or ""))

    return docs.withColumn(out, ids(F.col(text)))


def decode_column(docs: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """docs with a binary column of the decoded bytes; null ids decode to no bytes, an unknown id is an error."""
    @F.pandas_udf("binary")
    def raw(s):
        c = codec(ranks_path, pattern)
        return s.map(lambda x: b"" if x is None else c.decode(list(x)))

    return docs.withColumn(out, raw(F.col(ids)))


def digests(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of each row: encodes the text, decodes the ids, keeps neither.

    Null texts count as empty: no tokens, the digest of nothing. Rows of equal or null keys stay rows of their own; no
    other column is read, so their names cannot clash. One pass over the text without a shuffle; a worker holds one
    batch of texts and a bounded store of pre-tokens.
    """
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        c = codec(ranks_path, pattern)
        for batch in batches:
            n, ids, raw = [], [], []
            for x in encoded(c, batch.column(1)):
                n.append(x.count(" ") + 1 if x else 0)
                ids.append(hashlib.sha256(x.encode("ascii")).hexdigest())
                raw.append(hashlib.sha256(c.decode_text(x)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, text).mapInArrow(run, schema)
