"""Byte-pair encoding with a pair occurrence index, and decoding.

A worker gathers the words it has not met yet from a block of texts (``BLOCK`` characters of a
partition, or one longer text). Their symbols stand in one list; an index
maps each pair's rank to all its positions. Active ranks are applied in ascending order:
the positions of the lowest rank are merged from left to right and the lists of the pairs
at their sides are updated. When a merge makes a pair of lower rank, the rest of the list goes
back to the index and that rank comes first, as the merge order of a word demands.

Normalization and the split into words follow the vocabulary file; merges and decoding are
done here. Decoding starts from the ids alone: it joins their token strings by a blank,
as the library does for a vocabulary without a decoder.

Defined results: null text is the empty text (no ids, empty decoded text). Repeated rows
are encoded alike; other columns are kept out of the result; empty tables give no row.
"""

from __future__ import annotations

import hashlib
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.tokens import Splitter, chunks_of, vocabulary_path

REMEMBERED = 600_000
BLOCK = 4_000_000
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Encoder:
    """Ids of words, which are independent of each other, and the text of ids."""

    def __init__(self, path: str):
        self.splitter = Splitter(path)
        model = self.splitter.table["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.names = {i: t for t, i in self.vocabulary.items()} | {i: t for t, i in self.splitter.special.items()}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks[self.vocabulary[a], self.vocabulary[b]] = (rank, self.vocabulary[a + b])
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str | int, bytes] = {}

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, all words at once."""
        vocabulary, suffix, ranks = self.vocabulary, self.suffix, self.ranks
        symbols: list[int] = []
        firsts: list[int] = []
        for word in words:
            firsts.append(len(symbols))
            symbols += [vocabulary[c] for c in word[:-1]]
            symbols.append(vocabulary[word[-1] + suffix])
            symbols.append(-1)  # between words
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        pair_of: dict[int, tuple[int, int, int]] = {}
        find = ranks.get
        for i in range(n - 1):
            pair = (symbols[i], symbols[i + 1])
            hit = find(pair)
            if hit:
                rank = hit[0]
                if rank in index:
                    index[rank].append(i)
                else:
                    index[rank] = [i]
                    pair_of[rank] = (*pair, hit[1])
        active = list(index)
        active.sort()
        while active:
            rank = heappop(active)
            positions = index.pop(rank, None)
            if not positions:
                continue
            a, b, made = pair_of[rank]
            positions.sort()
            lower = False
            for k, i in enumerate(positions):
                if symbols[i] != a:
                    continue
                j = after[i]
                if j >= n or symbols[j] != b:
                    continue
                symbols[i], symbols[j] = made, -2
                nxt = after[j]
                after[i] = nxt
                if nxt < n:
                    before[nxt] = i
                    hit = find((made, symbols[nxt]))
                    if hit:
                        r = hit[0]
                        if r in index:
                            index[r].append(i)
                        else:
                            index[r] = [i]
                            pair_of[r] = (made, symbols[nxt], hit[1])
                            heappush(active, r)
                        lower = r < rank
                p = before[i]
                if p >= 0:
                    hit = find((symbols[p], made))
                    if hit:
                        r = hit[0]
                        if r in index:
                            index[r].append(p)
                        else:
                            index[r] = [p]
                            pair_of[r] = (symbols[p], made, hit[1])
                            heappush(active, r)
                        lower = lower or r < rank
                if lower:
                    rest = positions[k + 1 :]
                    if rest:
                        if rank in index:
                            index[rank] += rest
                        else:
                            index[rank] = rest
                            heappush(active, rank)
                    break
        out = []
        for i in firsts:
            ids = []
            while symbols[i] != -1:
                ids.append(symbols[i])
                i = after[i]
            out.append(ids)
        return out

    def learn(self, chunks: list[str]) -> None:
        for memory in (self.known, self.pieces):
            if len(memory) > REMEMBERED:
                memory.clear()
        split = [self.splitter.words(c) for c in chunks]
        pieces = self.pieces
        new = list(dict.fromkeys(w for words in split for w in words if w not in pieces))
        merged = [w for w in new if not isinstance(w, int)]
        spelled = [self.splitter.spelled(w) for w in merged]
        pieces.update((w, array("I", ids).tobytes()) for w, ids in zip(merged, self.merge(spelled), strict=True))
        pieces.update((w, array("I", [w]).tobytes()) for w in new if isinstance(w, int))
        for chunk, words in zip(chunks, split, strict=True):
            self.known[chunk] = pieces[words[0]] if len(words) == 1 else b"".join([pieces[w] for w in words])

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as native unsigned 32-bit integers; the new words of all texts are merged at once."""
        chunks = [chunks_of(text) if text else [] for text in texts]
        known = self.known
        new = list(dict.fromkeys(c for own in chunks for c in own if c not in known))
        if new:
            if len(known) > REMEMBERED:  # the memory is cleared, so all of the block is learnt
                new = list(dict.fromkeys(c for own in chunks for c in own))
            self.learn(new)
        return [b"".join(map(known.__getitem__, own)) for own in chunks]

    def decode(self, ids: array) -> str:
        return " ".join(map(self.names.__getitem__, ids))


def text_blocks(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Consecutive texts of about ``BLOCK`` characters, or one longer text."""
    block: list[str | None] = []
    held = 0
    for text in texts:
        if block and held + len(text or "") > BLOCK:
            yield block
            block, held = [], 0
        block.append(text)
        held += len(text or "")
    if block:
        yield block


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text of every document."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            counts, ids_digest, text_digest = [], [], []
            for texts in text_blocks(batch.column(1).to_pylist()):
                for packed in coder.encode_all(texts):
                    ids = array("I", packed)
                    if sys.byteorder == "big":
                        ids.byteswap()
                        packed = ids.tobytes()
                        ids.byteswap()
                    counts.append(len(ids))
                    ids_digest.append(hashlib.sha256(packed).hexdigest())
                    text_digest.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)
