"""Removal of long repeated passages (every byte under a string of ``length`` bytes that also starts elsewhere) by prefix-free parsing
(Boucher et al., 2019): rolling-hash triggers cut texts into phrases, and suffixes are compared by phrases, not byte by byte.

A trigger is an 8-byte gram whose hash falls under a bound, about one in ``EVERY`` bytes, wherever it stands; a phrase runs from one trigger to the end of
the next, so equal strings are parsed alike. Of corpus order only one thing is asked: whether a suffix agrees with a neighbour in ``length`` bytes or
more. Suffixes that do are one class of that order, and classes get 128-bit names in place of ranks, level by level:

1. dictionary: phrases that occur once in the corpus cannot lie in a repeated string; the places of all others come back.
2. parse: for a trigger, all strings whose first trigger it is lie between two byte positions; where that whole stretch is made of repeated phrases, its
   name tells whether it occurs again, which settles all its strings at once (about nine tenths of them).
3. suffixes: strings at the ends of repeats, left open by 2 though all their phrases are repeated, are named one by one. Their like may lie in a settled
   stretch, so one stretch of each settled name is named again where its first phrase is also the first phrase of an open one.

Strings without a whole phrase (sparse triggers, as in runs of one character) are named in step 1 already. Every step sends one row per slice of texts
and name, with all its places in the slice, so a passage that a third of all documents hold makes as many rows as there are slices. The
texts are dealt once, into buckets by row key, and stay there: later steps only send places to them. Longer texts are read in overlapping pieces.

Defined results: null texts count as empty; texts under ``length`` bytes keep all; strings never cross documents; rows that repeat a text repeat its
strings; no rows give no rows; further columns are ignored. Offsets count UTF-8 bytes and may cut characters, so ``kept`` is binary.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillset.llm.shared import Scratch, own_columns

GRAM, EVERY, SLICE_BYTES, BUCKET_BYTES, MOST_BUCKETS = 8, 24, 1 << 20, 8 << 20, 50_000
MULTIPLY, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
# A code is position * 4096 plus the number of further strings it stands for, and a mark: a phrase, strings to be named again, or a string without a whole
# phrase that its text repeats by itself.
LOCAL, PHRASE, AGAIN, FURTHER = 1 << 11, 1 << 10, 1 << 9, (1 << 9) - 1


@dataclass
class Slice:
    """Bytes of some texts side by side, or a piece of one long text with a margin on both sides.

    ``begin``/``end`` are a unit's bytes in ``data``, ``first``/``last`` the starts it answers for, ``shift`` its offset in the whole text, ``whole``
    whether it is the whole text.
    """

    data: np.ndarray
    row: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    last: np.ndarray
    shift: np.ndarray
    whole: bool

    def __post_init__(self):
        n = len(self.data)
        padded = np.zeros(n + GRAM, dtype=np.uint8)
        padded[:n] = self.data
        gram = np.ndarray((n,), dtype="<u8", buffer=padded, strides=(1,)) * MULTIPLY
        gram ^= gram >> np.uint64(29)
        gram *= MIX
        self.gram = gram ^ (gram >> np.uint64(32))
        at = np.flatnonzero(self.gram < np.uint64(2**64 // EVERY))
        self.trigger = at[at + GRAM <= self.end[self.unit(at)]]
        self.totals: dict[int, np.ndarray] = {}

    def unit(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.end, at, side="right")

    def owned(self, at: np.ndarray) -> np.ndarray:
        unit = self.unit(at)
        return (at >= self.first[unit]) & (at < self.last[unit])

    def phrases(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the phrases that a string of ``length`` bytes can hold."""
        a, b = self.trigger[:-1], self.trigger[1:] + GRAM
        fits = (self.unit(a) == self.unit(b - GRAM)) & (b - a <= length)
        return a[fits], b[fits]

    def named(self, a: np.ndarray, b: np.ndarray, kind: int | np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray]:
        """Two halves of the name of the bytes from a to b; the second is 0 unless ``wide``."""
        salt = (b - a).astype(np.uint64) * MULTIPLY + np.asarray(kind).astype(np.uint64)
        halves = []
        for base in BASES[: 1 + wide]:
            power, inverse = _powers(base, len(self.data))
            if base not in self.totals and len(a):
                self.totals[base] = np.zeros(len(self.data) + 1, dtype=np.uint64)
                np.cumsum(np.multiply(self.gram, power, out=self.totals[base][1:]), out=self.totals[base][1:])
            total = self.totals.get(base, np.zeros(0, dtype=np.uint64))
            value = ((total[b - GRAM + 1] - total[a]) * inverse[a] ^ salt) * MIX
            halves.append((value ^ (value >> np.uint64(31))).view(np.int64))
        return halves[0], halves[1] if wide else np.zeros(len(a), dtype=np.int64)

    def inside(self, a: np.ndarray, b: np.ndarray, length: int, weight: np.ndarray | int = 1) -> np.ndarray:
        """Weight of the stretches from a to b that lie in the string of ``length`` bytes that starts at each byte."""
        low = np.maximum(b - length, self.begin[self.unit(a)])
        return self.depth(low, a, weight)

    def depth(self, low: np.ndarray, high: np.ndarray, weight: np.ndarray | int = 1) -> np.ndarray:
        """Weight of the ranges low to high, both included, that hold each byte."""
        change = np.zeros(len(self.data) + 1, dtype=np.int32)
        np.add.at(change, low, np.asarray(weight, dtype=np.int32))
        np.subtract.at(change, np.minimum(high, len(self.data) - 1) + 1, np.asarray(weight, dtype=np.int32))
        return np.cumsum(change, dtype=np.int32, out=change)[:-1]

    def starts(self, length: int) -> np.ndarray:
        """Whether a string of ``length`` bytes starts at each byte."""
        out = np.ones(len(self.data), dtype=bool)
        for low, high in zip(np.maximum(self.begin, self.end - length + 1).tolist(), self.end.tolist(), strict=True):
            out[low:high] = False
        return out

    def located(self, codes: list[np.ndarray | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, position in ``data``, code) of the codes of this slice's rows, less those of other pieces."""
        units = np.arange(len(self.row))
        mine = [codes[r] if codes[r] is not None else np.zeros(0, dtype=np.int64) for r in self.row]
        unit, code = np.repeat(units, [len(c) for c in mine]), np.concatenate([np.zeros(0, dtype=np.int64), *mine])
        at = (code >> 12) - self.shift[unit] + self.begin[unit]
        here = (at >= self.begin[unit]) & (at < self.end[unit])
        return unit[here], at[here], code[here]


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse, modulo 2^64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, SLICE_BYTES)
        _POWERS[base] = tuple(np.cumprod(np.where(np.arange(size) > 0, np.uint64(b), np.uint64(1))) for b in (base, pow(base, -1, 2**64)))
    power, inverse = _POWERS[base]
    return power[:n], inverse[:n]


def _slices(batch: pa.RecordBatch, length: int, most: int) -> Iterator[Slice]:
    texts = batch.column("text").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, dtype=np.uint8)
    margin, row = 2 * length + GRAM, 0
    while row < len(texts):
        size = int(offsets[row + 1] - offsets[row])
        if size > most:
            for at in range(0, size, most):
                low, high, stop = max(0, at - margin), min(size, at + most + margin), min(size, at + most)
                one = lambda v: np.array([v], dtype=np.int64)
                yield Slice(data[offsets[row] + low : offsets[row] + high], one(row), one(0), one(high - low), one(at - low), one(stop - low), one(low), False)
            row += 1
            continue
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        begin, end = offsets[row:to] - offsets[row], offsets[row + 1 : to + 1] - offsets[row]
        yield Slice(data[offsets[row] : offsets[to]], np.arange(row, to), begin, end, begin, end, np.zeros(to - row, dtype=np.int64), True)
        row = to


def _lists(column: pa.Array) -> list[np.ndarray | None]:
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[offsets[i] : offsets[i + 1]] for i in range(len(column))]


def _rows(part: Slice, keys: np.ndarray, at: np.ndarray, code: np.ndarray, names: tuple[np.ndarray, np.ndarray], fold: bool, lead: np.ndarray | None = None) -> pa.RecordBatch | None:
    """One row per name: how often it occurs in the slice, its places (row key and code, 24 bytes each), and its first phrase if given.

    With ``fold``, a name that occurs twice in one whole text is known to be repeated there, so only the first of those places is sent.
    """
    if not len(at):
        return None
    order = np.argsort(names[0], kind="stable")
    one, two, unit = names[0][order], names[1][order], part.unit(at[order])
    fresh = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
    start = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    sent, local = np.ones(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
    if fold and part.whole:
        apart = fresh.copy()
        apart[1:] |= unit[1:] != unit[:-1]
        run = np.flatnonzero(apart)
        sent, local = apart, (np.diff(np.concatenate([run, [len(order)]])) > 1)[np.cumsum(apart) - 1]
    # Rows in the order of their first place: neighbours share their row key, which shuffle files pack well.
    rank = np.empty(len(start), dtype=np.int64)
    by_place = np.argsort(order[start], kind="stable")
    rank[by_place] = np.arange(len(start))
    kept = np.flatnonzero(sent)
    kept = kept[np.argsort(rank[group[kept]], kind="stable")]
    marked = code[order[kept]]
    marked += np.where(local[kept] & (marked & PHRASE == 0), LOCAL, 0)
    places = np.concatenate([keys[part.row[unit[kept]]], marked[:, None]], axis=1)
    ends = np.cumsum(np.bincount(rank[group[kept]], minlength=len(start))) * 24
    binary = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(places.tobytes())])
    counts = np.diff(np.concatenate([start, [len(order)]]))[by_place]
    first = (np.zeros(len(at), dtype=np.int64) if lead is None else lead)[order[start][by_place]]
    return pa.RecordBatch.from_arrays([pa.array(one[start][by_place]), pa.array(two[start][by_place]), pa.array(counts), binary, pa.array(first)], names=["one", "two", "n", "places", "lead"])


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in ("d", "k")], axis=1)


def _code(part: Slice, at: np.ndarray, extra: np.ndarray | int) -> np.ndarray:
    unit = part.unit(at)
    return ((at - part.begin[unit] + part.shift[unit]) << 12) + extra


def _bare(part: Slice, length: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Starts of the strings without a whole phrase."""
    at = np.flatnonzero(part.starts(length) & (part.inside(a, b, length) == 0))
    return at[part.owned(at)] if len(at) else at


def _twice(part: Slice, at: np.ndarray, names: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether each name occurs twice in its unit."""
    if not len(at):
        return np.zeros(0, dtype=bool)
    order = np.argsort(names[0], kind="stable")
    key = np.stack([names[0][order], names[1][order], part.unit(at[order])], axis=1)
    same = (key[1:] == key[:-1]).all(axis=1)
    out = np.zeros(len(at), dtype=bool)
    out[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    return out


def _open(part: Slice, codes: list[np.ndarray | None], length: int) -> np.ndarray:
    """Whether each byte starts a string whose phrases, one or more, are all repeated."""
    a, b = part.phrases(length)
    if not len(a):
        return np.zeros(len(part.data), dtype=bool)
    _, at, code = part.located(codes)
    marked = np.zeros(len(part.data), dtype=bool)
    marked[at[code & PHRASE > 0]] = True
    repeated = marked[a]
    if part.whole:
        repeated |= _twice(part, a, part.named(a, b, 1, False))
    # A string holds fewer than 2^9 phrases, so the other ones count 2^9 each.
    held = part.inside(a, b, length, np.where(repeated, 1, FURTHER + 1))
    return part.starts(length) & (held > 0) & (held <= FURTHER)


def _phrase_rows(part: Slice, batch_keys: np.ndarray, codes: list, length: int) -> Iterator[pa.RecordBatch | None]:
    a, b = part.phrases(length)
    bare = _bare(part, length, a, b)
    own = part.owned(a) if len(a) else np.zeros(0, dtype=bool)
    a, b = a[own], b[own]
    yield _rows(part, batch_keys, a, _code(part, a, PHRASE), part.named(a, b, 1, False), True)
    yield _rows(part, batch_keys, bare, _code(part, bare, 0), part.named(bare, bare + length, 0, True), True)


def _stretch_rows(part: Slice, batch_keys: np.ndarray, codes: list, length: int) -> Iterator[pa.RecordBatch | None]:
    t = part.trigger
    if len(t):
        unit = part.unit(t)
        before = np.concatenate([[-1], t[:-1]])
        before[np.concatenate([[True], unit[1:] != unit[:-1]])] = -1
        low = np.maximum(np.maximum(before + 1, part.begin[unit]), t - length + GRAM)
        high = np.minimum(t, part.end[unit] - length)
        fit = (low <= high) & part.owned(t)
        t, low, high = t[fit], low[fit], high[fit]
        opened = np.concatenate([[0], np.cumsum(_open(part, codes, length))])
        some = opened[high + 1] > opened[low]
        t, low, high = t[some], low[some], high[some]
        # Open strings hold the phrase that starts at their first trigger, so every trigger left here starts one.
        a, b = part.phrases(length)
        lead = part.named(a, b, 1, False)[0][np.searchsorted(a, t)] if len(t) else None
        yield _rows(part, batch_keys, low, _code(part, low, high - low), part.named(low, high + length, 2 + t - low, True), False, lead)


def _suffix_rows(part: Slice, batch_keys: np.ndarray, codes: list, length: int) -> Iterator[pa.RecordBatch | None]:
    _, at, code = part.located(codes)

    def under(mark: int) -> np.ndarray:
        those = code & (PHRASE | AGAIN) == mark
        return part.depth(at[those], at[those] + (code[those] & FURTHER)) > 0

    left = np.flatnonzero((_open(part, codes, length) & ~under(0)) | (under(AGAIN) & part.starts(length)))
    left = left[part.owned(left)] if len(left) else left
    yield _rows(part, batch_keys, left, _code(part, left, 0), part.named(left, left + length, 0, True), False)


def _step(texts: DataFrame, rows_of: Callable, length: int, most: int) -> DataFrame:
    """The rows of one step over all texts, with the places found so far in ``codes``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, codes = _keys(batch), _lists(batch.column("codes"))
            for part in _slices(batch, length, most):
                for rows in rows_of(part, keys, codes, length):
                    if rows is not None:
                        yield rows

    return texts.select("d", "k", "text", "codes").mapInArrow(work, "one bigint, two bigint, n bigint, places binary, lead bigint")


def _repeated(rows: DataFrame, scratch: Scratch, name: str, buckets: int, again: bool) -> DataFrame:
    """d, k, codes: the places of all names that occur more than once, gathered per text.

    With ``again``, the first place of such a name is also marked to be named again, where a name that occurs once has the same first phrase.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("places").to_pylist()
            marked = [p[:24] for p, m in zip(found, batch.column("again").to_pylist(), strict=True) if m]
            flat = np.frombuffer(b"".join(found + marked), dtype=np.int64).reshape(-1, 3).copy()
            flat[len(flat) - len(marked) :, 2] += AGAIN
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], names=["d", "k", "code"])

    of_name = Window.partitionBy("one", "two")  # at most one row per slice of texts
    counted = rows.withColumn("total", F.sum("n").over(of_name))
    if again:
        counted = scratch.store(counted.withColumn("nth", F.row_number().over(of_name.orderBy("n"))).drop("one", "two", "n"), f"{name}-named")
        open_ = counted.filter("total = 1").select("lead").distinct().withColumn("again", F.lit(True))
        known = counted.filter("total > 1").join(open_.hint("merge"), "lead", "left").select("places", (F.coalesce("again", F.lit(False)) & (F.col("nth") == 1)).alias("again"))
    else:
        known = counted.filter("total > 1").select("places", F.lit(False).alias("again"))
    places = known.mapInArrow(unpack, "d bigint, k bigint, code bigint")
    return scratch.store(places.repartition(buckets, "d", "k").groupBy("d", "k").agg(F.collect_set("code").alias("codes")), name)


def _with_codes(texts: DataFrame, found: list[DataFrame], buckets: int, every: bool = False) -> DataFrame:
    """The texts with the places found so far; unless ``every``, only those with a repeated phrase or string, since others cannot gain any later."""
    none = F.array().cast("array<bigint>")
    if not found:
        return texts.withColumn("codes", none)
    joined = texts  # never sorted: a bucket's places, far fewer bytes than its texts, are the hashed side
    for i, codes in enumerate(found):
        joined = joined.join(codes.repartition(buckets, "d", "k").withColumnRenamed("codes", f"codes{i}").hint("shuffle_hash"), ["d", "k"], "left" if i or every else "inner")
    return joined.withColumn("codes", F.concat(*[F.coalesce(f"codes{i}", none) for i in range(len(found))])).drop(*[f"codes{i}" for i in range(len(found))])


def _cut(texts: DataFrame, length: int, most: int) -> DataFrame:
    """doc_id, n_bytes, spans, kept: the strings in ``codes`` and those that a text repeats by itself, joined to maximal spans and cut."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _lists(batch.column("codes"))
            found: list[list[np.ndarray]] = [[] for _ in codes]
            for r, c in enumerate(codes):
                c = c[c & (PHRASE | AGAIN) == 0]
                if len(c):
                    found[r].append(np.stack([c >> 12, (c >> 12) + (c & FURTHER) + length], axis=1))
            own = np.array([r for r, c in enumerate(codes) if (c & LOCAL).any()], dtype=np.int64)
            for part in _slices(batch.select(["text"]).take(pa.array(own)), length, most) if len(own) else ():
                if part.whole:
                    bare = _bare(part, length, *part.phrases(length))
                    bare = bare[_twice(part, bare, part.named(bare, bare + length, 0, True))]
                    unit = part.unit(bare)
                    at = bare - part.begin[unit]
                    for u in np.unique(unit):
                        mine = at[unit == u]
                        found[own[part.row[u]]].append(np.stack([mine, mine + length], axis=1))
            texts_, out = batch.column("text"), ([], [], [])
            for r, runs in enumerate(found):
                text = texts_[r].as_py()
                spans, kept = [], text
                if runs:
                    run = np.concatenate(runs)
                    run = run[np.argsort(run[:, 0], kind="stable")]
                    reach = np.maximum.accumulate(run[:, 1])
                    first = np.flatnonzero(np.concatenate([[True], run[1:, 0] > reach[:-1]]))
                    spans = list(zip(run[first, 0].tolist(), reach[np.concatenate([first[1:] - 1, [len(run) - 1]])].tolist(), strict=True))
                    edges = [0, *[e for s in spans for e in s], len(text)]
                    kept = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                for column, value in zip(out, (len(text), [{"start": a, "end": b} for a, b in spans], kept), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(span)), pa.array(out[2], pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return texts.select("doc_id", "text", "codes").mapInArrow(work, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")


def _dealt(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """doc_id, d, k, text in a table bucketed by the row key (d, k), and its number of buckets."""
    spark = docs.sparkSession
    raw = own_columns(docs, doc_id=F.col("doc_id").cast("bigint"), text=F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    total = raw.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = int(min(MOST_BUCKETS, max(1, -(-total // BUCKET_BYTES))))
    keyed = raw.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("d"), F.xxhash64("text").alias("k"), "text")
    table = f"repeats_{uuid.uuid4().hex}"
    keyed.repartition(buckets, "d", "k").write.bucketBy(buckets, "d", "k").option("path", scratch.path("texts")).format("parquet").saveAsTable(table)
    texts = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay in the shared folder
    return texts, buckets


def without_repeats(docs: DataFrame, length: int = 200, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges, maximal), kept (the remaining bytes): one row per input row.

    ``slice_bytes`` bounds what is looked at in one piece; longer texts are read in pieces of that size.
    """
    if not 2 * GRAM <= length <= FURTHER:
        raise ValueError(f"length must lie between {2 * GRAM} and {FURTHER}")
    scratch = Scratch(docs.sparkSession, "repeats")
    texts, buckets = _dealt(docs, scratch)
    found: list[DataFrame] = []
    scratch.settle(4, 1.5)
    for name, rows_of in (("phrases", _phrase_rows), ("stretches", _stretch_rows), ("suffixes", _suffix_rows)):
        found.append(_repeated(_step(_with_codes(texts, found, buckets), rows_of, length, slice_bytes), scratch, name, buckets, name == "stretches"))
        scratch.settle(4, 1.5)
    scratch.forget("stretches-named")
    return _cut(_with_codes(texts, found, buckets, True), length, slice_bytes)
