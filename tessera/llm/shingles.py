"""Hashed word shingles and how common they are, for operators that look for shared text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.shared import beside, bounded_batches, dropped, sized, stored, texts_of

#: Bits of the maps of common tokens: between these powers of two, about two for each common token.
LEAST_BITS, MOST_BITS = 20, 27
#: Most tokens that a block of the count holds on average, and tokens that a worker gathers before it passes them on.
BLOCK_TOKENS, GATHERED = 2 << 20, 1 << 19
#: Characters of texts that are hashed at once.
PORTION = 1 << 19

_ROUND = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _ROUND
    return h ^ (h >> np.uint64(32))


class Words:
    """64-bit hashes of words. A word is a run of bytes without ASCII white space; A-Z count as a-z. The hash of a word
    depends on nothing else, so workers agree."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(20_240_601 + seed)
        self.of_byte = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.power = np.ones(0, dtype=np.uint64)

    def _powers(self, n: int) -> np.ndarray:
        if len(self.power) < n:
            m = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                self.power = np.cumprod(np.full(m, np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)
        return self.power[:n]

    def __call__(self, text: str) -> np.ndarray:
        """One hash for each word of a whole text, in order."""
        return self.joined([text])[0]

    def joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words of many whole texts behind each other, and how many each text has. Many short texts at
        once take far less time than one by one."""
        split = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
        counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        raw = np.frombuffer(b" ".join([w for each in split for w in each]), dtype=np.uint8)
        if not len(raw):
            return np.zeros(0, dtype=np.uint64), counts
        gaps = np.flatnonzero(raw == 32)
        starts = np.r_[0, gaps + 1]
        lengths = np.diff(np.r_[starts, len(raw) + 1]) - 1
        # place in the word, from 0; a gap takes part with weight 0
        place = np.arange(len(raw)) - np.repeat(starts, lengths + 1)[: len(raw)]
        value = self.of_byte[raw] * self._powers(int(lengths.max()) + 1)[place]
        value[gaps] = 0
        return _mixed(np.add.reduceat(value, starts) + lengths.astype(np.uint64) * _ROUND), counts

    def each(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The hashes of each text's words."""
        for part in portions(texts):
            hashes, counts = self.joined(part)
            yield from np.split(hashes, np.cumsum(counts)[:-1])


def portions(texts: list[str], most: int = PORTION) -> Iterator[list[str]]:
    """texts in order, in lists of about `most` characters or one longer text."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, in order; of fewer words, of the whole run."""
    if not len(words):
        return words
    k = min(n, len(words))
    h = np.full(len(words) - k + 1, np.uint64(k), dtype=np.uint64)
    for i in range(k):
        h = h * _ROUND + words[i : len(words) - k + 1 + i]
    return _mixed(h)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct shingles, in order of their hashes. 64 bits tell the shingles of one document or of a pair apart; that
    other documents may share a hash by chance only makes a candidate more."""
    return np.unique(grams(words, n))


class Common:
    """Which tokens occur in more documents than each of some bounds, by hash: a class for each place in a map of bits.
    Tokens that share a place share the greater class, so a class is a function of the token, the same everywhere; the
    maps are at most 2 ** MOST_BITS bits each, whatever the corpus."""

    def __init__(self, bits: int, maps: list[np.ndarray]):
        self.bits, self.maps = bits, maps

    def over(self, tokens: np.ndarray, bound: int) -> np.ndarray:
        """Whether each token's class is above that bound (by its place in the list of bounds)."""
        at = tokens >> np.uint64(64 - self.bits)
        return (self.maps[bound][at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def count_common(docs: DataFrame, tokens_of, bounds: tuple[int, ...], text_col: str = "text", expected: int = 600) -> Common:
    """The Common map of the distinct tokens of all rows of docs; tokens_of(texts) gives an array for each text.

    Each task sends its tokens in blocks by leading bits, 32 further bits of each; so a count may take tokens for one
    that agree in these bits, which raises a class but never lowers one. A block's tokens are counted by sorting. A token
    that a task meets more often than the highest bound is sent that many times only, so no block grows with one token.
    `expected` is about the number of tokens of a row and sizes the blocks.
    """
    bounded_batches(docs.sparkSession)
    n = docs.count()
    top = min(18, max(6, (n * expected // BLOCK_TOKENS).bit_length()))
    bits = min(MOST_BITS, max(LEAST_BITS, (n * expected // 4).bit_length()))
    most = max(bounds) + 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def blocks() -> pa.RecordBatch:
            t = np.concatenate(held) >> np.uint64(32 - top)
            t.sort()
            first = np.r_[True, t[1:] != t[:-1]]
            start = np.flatnonzero(first)
            rank = np.arange(len(t)) - np.repeat(start, np.diff(np.r_[start, len(t)]))
            t = t[rank < most]
            block = (t >> np.uint64(32)).astype(np.int32)
            cut = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(block)]
            low = (t & np.uint64(0xFFFFFFFF)).astype("<u4")
            rows = [(int(block[a]), low[a:b].tobytes()) for a, b in zip(cut, cut[1:], strict=False) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "tokens"])

        for b in batches:
            for t in tokens_of(texts_of(b)):
                if len(t):
                    held.append(t)
                    size += len(t)
                if size >= GATHERED:
                    yield blocks()
                    held, size = [], 0
        if size:
            yield blocks()

    def classes(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        t = np.concatenate([np.frombuffer(x, dtype="<u4") for x in pdf["tokens"]])
        t.sort()
        start = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        n_each = np.diff(np.r_[start, len(t)])
        value = t[start].astype(np.uint64)
        at = (value >> np.uint64(32 - (bits - top))).astype(np.int64)
        maps = []
        for bound in bounds:
            hit = np.zeros(1 << (bits - top), dtype=np.uint8)
            hit[at[n_each > bound]] = 1
            maps.append(np.packbits(hit, bitorder="little").tobytes())
        return pd.DataFrame({"block": [block], "maps": [maps]})

    sent = docs.select(docs[text_col].alias("text")).mapInArrow(send, "block int, tokens binary")
    told = stored(sent.groupBy("block").applyInPandas(classes, "block int, maps array<binary>"))
    width = 1 << (bits - top - 3)
    maps = [np.zeros(1 << (bits - 3), dtype=np.uint8) for _ in bounds]
    for r in told.toLocalIterator():
        for m, raw in zip(maps, r["maps"], strict=True):
            m[r["block"] * width : (r["block"] + 1) * width] = np.frombuffer(raw, dtype=np.uint8)
    dropped(told)
    return Common(bits, maps)


def of_ids(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, pack, name: str) -> DataFrame:
    """(id, name) rows of those documents whose id is in wanted["id"], built from their whole texts: pack(texts) gives bytes for
    each."""
    cols = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(sized(wanted, 24), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield beside(b.column("id"), **{name: pa.array(list(pack(texts_of(b))), pa.binary())})

    kind = docs.schema[id_col].dataType.simpleString()
    return cols.mapInArrow(run, f"id {kind}, {name} binary")
