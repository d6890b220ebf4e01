"""Best-fit packing: a configuration linear program over the histogram of lengths."""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.shared import beside, bounded_batches, stored, texts_of

#: Passes of the multiplicative weights, their step width, and the power of its size that a length's price starts from.
PASSES, WIDTH, POWER = 6, 0.5, 1.1
#: Pieces that one part of a length's order holds on average; white space in a row that the fast encoder is trusted with.
PART_ROWS, BLANKS = 20_000, 1_000
PIECE_SCHEMA = "id {id}, piece int, start bigint, length int, ids_crc32 bigint, ids array<int>"


class Tokens:
    """ids of texts by a byte-level BPE vocabulary in a tokenizers JSON file.

    Texts are encoded by tiktoken from the ranks in that file, which is several times as fast and gives the same ids.
    Those that hold the string of an added token or a very long run of white space, on which tiktoken fails, go through
    tokenizers itself; so does everything if the file asks for more than byte-level BPE with the usual split.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.path = path
        self.added = [t["content"] for t in told.get("added_tokens", [])]
        self.blanks = re.compile(r"\s{%d}" % BLANKS)
        self.fast = None
        split, model = told.get("pre_tokenizer") or {}, told["model"]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if not plain or told.get("normalizer") or model.get("type") != "BPE" or any(model.get(k) for k in odd):
            return
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable}
        byte_of |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in printable)}
        vocab = {k: v for k, v in model["vocab"].items() if k not in self.added}
        ranks = {bytes(byte_of[c] for c in k): v for k, v in vocab.items()}
        # fixed value: the split of byte-level BPE
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("from_file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def full(self):
        """The library's own encoder; most workers never need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(a in text for a in self.added) or self.blanks.search(text):
            return self.full.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_loaded: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _loaded[path] = Tokens(path)
    return _loaded[path]


def pieces(
    docs: DataFrame, tokenizer: str, most: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """The pieces of each document's ids, followed by end_id: one of all ids where they fit into most, else pieces of
    most ids of which the first may be shorter. Columns: id, piece, start, length, ids_crc32 (of the ids as unsigned
    little-endian 32-bit numbers) and, with with_ids, ids."""
    kind = docs.schema[id_col].dataType.simpleString()
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens(tokenizer)
        for b in batches:
            row, piece, start, length, crc, own = [], [], [], [], [], []
            for k, text in enumerate(texts_of(b)):
                ids = np.array([*encode(text), end_id], dtype="<u4")
                cut = [0, *range(len(ids) % most or most, len(ids) + 1, most)]
                for n, (s, e) in enumerate(zip(cut, cut[1:], strict=False)):
                    row.append(k)
                    piece.append(n)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(ids[s:e].tobytes()))
                    own.append(ids[s:e].astype(np.int32) if with_ids else None)
            yield beside(
                b.column("id").take(pa.array(row, pa.int64())), piece=pa.array(piece, pa.int32()), start=pa.array(start, pa.int64()),
                length=pa.array(length, pa.int32()), ids_crc32=pa.array(crc, pa.int64()), ids=pa.array(own, pa.list_(pa.int32())),
            )

    cols = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return cols.mapInArrow(run, PIECE_SCHEMA.format(id=kind))


class Priced:
    """Knapsack by a dynamic program over room: the patterns of most value for every room, at most left of each size. A
    size comes in bundles of 1, 2, 4 and so on."""

    def __init__(self, value: np.ndarray, sizes: np.ndarray, left: np.ndarray, room: int):
        self.best = np.zeros(room + 1)
        self.bundles: list[tuple[int, int, int]] = []
        took = []
        for k in np.flatnonzero((left > 0) & (sizes <= room)).tolist():
            size, most, n = int(sizes[k]), int(min(left[k], room // sizes[k])), 1
            while most > 0:
                n = min(n, most)
                s = size * n
                with_it = self.best[: room + 1 - s] + value[k] * n
                better = np.zeros(room + 1, dtype=bool)
                better[s:] = with_it > self.best[s:] * (1 + 1e-12)
                np.copyto(self.best[s:], with_it, where=better[s:])
                self.bundles.append((k, n, s))
                took.append(better)
                most -= n
                n *= 2
        self.took = np.ascontiguousarray(np.array(took).T) if took else np.zeros((room + 1, 0), dtype=bool)

    def pattern(self, room: int) -> dict[int, int]:
        """(place of a size: times) of the best pattern for that room."""
        out: dict[int, int] = {}
        before = len(self.bundles)
        while len(hit := np.flatnonzero(self.took[room, :before])):
            before = int(hit[-1])
            k, n, s = self.bundles[before]
            out[k] = out.get(k, 0) + n
            room -= s
        return out


def program(histogram: dict[int, int], room: int, passes: int = PASSES) -> tuple[list[tuple[tuple[int, ...], int]], float]:
    """(plan, bound): (pattern, times) rows that pack histogram (length: pieces) into bins of room, and a number of bins
    that no plan can go below.

    Configuration program: fewest patterns such that each length is covered as often as it occurs. A length has a price,
    its weight times a power of its size. A pass covers all lengths: in a step, the longest length that is not covered
    yet is completed to the pattern of most value by the knapsack, over what is uncovered, and that pattern enters as
    often, a whole number of times, as the counts left allow; so what a pattern leaves over is priced again in the next
    step, until nothing is left, and a pass is rounded as it is made. Each step uses up one length at least, so there are
    as many steps as lengths, whatever the counts. After a pass a length's weight grows by exp(WIDTH * the room that its
    patterns left unfilled, as a share). Prices bound the program from below by duality: value of all pieces over that of
    the best pattern. The passes end when one meets the bound; the best one counts.
    """
    sizes = np.array(sorted(s for s, n in histogram.items() if n > 0 and s < room), dtype=np.int64)
    full = [((room,), histogram[room])] if histogram.get(room, 0) else []
    if not len(sizes):
        return full, float(sum(n for _, n in full))
    count = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    weight, best, bound = np.ones(len(sizes)), None, 0.0
    for value in (sizes.astype(float), sizes * 2.0 > room):
        bound = max(bound, _bound(value.astype(float), sizes, count, room))
    for _ in range(passes):
        value = weight * sizes.astype(float) ** POWER
        bound = max(bound, _bound(value, sizes, count, room))
        left, found, unfilled = count.copy(), {}, np.zeros(len(sizes))
        while left.any():
            k = int(np.flatnonzero(left)[-1])
            rest = room - int(sizes[k])
            left[k] -= 1
            pattern = Priced(value, sizes, left, rest).pattern(rest)
            left[k] += 1
            pattern[k] = pattern.get(k, 0) + 1
            times = min(int(left[j]) // n for j, n in pattern.items())
            gap = 1 - sum(int(sizes[j]) * n for j, n in pattern.items()) / room
            for j, n in pattern.items():
                left[j] -= n * times
                unfilled[j] += n * times * gap
            key = tuple(int(sizes[j]) for j in sorted(pattern, reverse=True) for _ in range(pattern[j]))
            found[key] = found.get(key, 0) + times
        if best is None or sum(found.values()) < sum(best.values()):
            best = found
        if sum(best.values()) <= np.ceil(bound - 1e-6):
            break
        weight *= np.exp(WIDTH * unfilled / count)
    return full + list(best.items()), bound + sum(n for _, n in full)


def _bound(value: np.ndarray, sizes: np.ndarray, count: np.ndarray, room: int) -> float:
    """Bins that any plan needs, by the value of all pieces over that of the best pattern."""
    best = Priced(value, sizes, count, room).best[room]
    return float(value @ count / best) if best > 0 else 0.0


def solve(histogram: dict[int, int], room: int, passes: int = PASSES) -> list[tuple[tuple[int, ...], int]]:
    """The plan of program(); where best-fit decreasing takes fewer bins, that one. The work grows with the square of the
    number of lengths times room and not with the number of pieces."""
    plan, bound = program(histogram, room, passes)
    bins = sum(n for _, n in plan)
    if bins <= np.ceil(bound - 1e-6):
        return plan
    plain = best_fit(histogram, room)
    return plain if sum(n for _, n in plain) < bins else plan


def best_fit(histogram: dict[int, int], room: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: equal bins are kept as one with a count, so the work depends on the number
    of lengths and rooms and not on that of pieces."""
    bins: dict[int, dict[tuple[int, ...], int]] = {}  # by room left
    free: list[int] = []

    def put(rest: int, lengths: tuple[int, ...], n: int) -> None:
        if rest not in bins:
            bins[rest] = {}
            bisect.insort(free, rest)
        bins[rest][lengths] = bins[rest].get(lengths, 0) + n

    for size in sorted((s for s, n in histogram.items() if n > 0), reverse=True):
        left = histogram[size]
        while left:
            at = bisect.bisect_left(free, size)
            if at == len(free):
                each = room // size
                whole, rest = divmod(left, each)
                if whole:
                    put(room - each * size, (size,) * each, whole)
                if rest:
                    put(room - rest * size, (size,) * rest, 1)
                break
            gap = free[at]
            lengths, n = next(iter(bins[gap].items()))
            each = min(gap // size, left)
            n_now = min(n, left // each)
            if n == n_now:
                del bins[gap][lengths]
                if not bins[gap]:
                    del bins[gap]
                    free.pop(at)
            else:
                bins[gap][lengths] = n - n_now
            put(gap - each * size, lengths + (size,) * each, n_now)
            left -= each * n_now
    return [(lengths, n) for same in bins.values() for lengths, n in same.items()]


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, runs of ranks: first rank, first sequence, times a sequence takes it, place of the first one."""
    out: dict[int, list[list[int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, n in plan:
        at = 0
        for size in dict.fromkeys(lengths):
            each = lengths.count(size)
            run = out.setdefault(size, [[], [], [], []])
            first = used.get(size, 0)
            for column, v in zip(run, (first, sequence, each, at), strict=True):
                column.append(v)
            used[size] = first + each * n
            at += each * size
        sequence += n
    return {size: tuple(np.array(c, dtype=np.int64) for c in run) for size, run in out.items()}


def pack(
    docs: DataFrame, tokenizer: str, most: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of the documents (see pieces()): id_col, piece, start, length, ids_crc32, sequence_id, offset,
    and ids with with_ids. The pieces of a sequence lie gapless from offset 0 and have most ids at most together; the
    number of sequences is near the least.

    The histogram of lengths (at most `most` rows) goes to the driver, which solves the configuration program; its plan
    is bounded by that histogram. Pieces of a length are numbered by sums over many parts of their order, so no task
    holds a length, and a piece's number gives its sequence.

    Null text counts as empty; an empty document is one piece with end_id. Null ids and repeated rows are packed like
    others. Other columns are ignored. An empty table gives no rows.
    """
    rows = pieces(docs, tokenizer, most, end_id, id_col, text_col, with_ids)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = solve(histogram, most)
    slots = _slots(plan)

    parts = max(16, sum(histogram.values()) // PART_ROWS)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    counts = stored(rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(W.partitionBy("length", "part").orderBy("row")) - 1
    ranked = rows.join(firsts, ["length", "part"]).withColumn("rank", F.col("first") + inside)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for size in pc.unique(b.column("length")).to_pylist():
                hit = np.flatnonzero(length == size)
                first, start, each, at = slots[size]
                run = np.searchsorted(first, rank[hit], side="right") - 1
                inner = rank[hit] - first[run]
                sequence[hit] = start[run] + inner // each[run]
                offset[hit] = at[run] + inner % each[run] * size
            yield beside(b.column("id"), **{c: b.column(c) for c in cols[1:]}, sequence_id=pa.array(sequence), offset=pa.array(offset))

    kind = docs.schema[id_col].dataType.simpleString()
    cols = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = PIECE_SCHEMA.format(id=kind) if with_ids else PIECE_SCHEMA.format(id=kind).removesuffix(", ids array<int>")
    out = ranked.select(*cols, "rank").mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")
    named = [F.col(c).cast("long").alias(c) if c == "length" else F.col(c) for c in out.columns if c != "id"]
    return out.select(F.col("id").alias(id_col), *named)
