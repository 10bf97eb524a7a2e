"""Problem 3: texts that return with small edits, found by covering locality-sensitive hashing.

A text is its set of distinct words. Two sets of sizes a and b with a similarity of at least t differ in at
most r = (a + b)(1 - t)/(1 + t) words. The words are split into k = r//2 + 1 parts by a hash; by counting, at
least one part has at most one differing word. Within a part each word has one of the three non-zero
vectors of two bits, and table v keeps the words whose vector has an odd product with v: for any one vector there is
a v that masks it out, so a pair within the radius has equal keys in at least one of the 3k tables. No pair is lost.
Sizes are cut into levels, each with its own radius; a pair meets in the level of its smaller text, which the larger one
enters too if it could have a partner there.

Most keys belong to one text only, so whole keys don't move at first. Texts are packed into chunks (a list of words, and their numbers by text), each
different set of words in one chunk only. A chunk sends the sorted 26-bit fingerprints of its keys, as differences of about two bytes; a chunk gets back
one bit for each, whether it occurs elsewhere, and sends just those keys, with the name of the set and a parity sketch of 116 bits. The sketch's
Hamming distance never exceeds the number of differing words, so it rejects false candidates without losing a pair; the rest
are compared word by word. Within a key's run, sets are compared by sketch; runs longer than ``bucket`` are refined by the tables of a
second, independent split, which covers every pair as well, and what is still longer is joined in blocks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.canon import canonicalise
from postmill.llm.common import hash64, if_small, materialise, mix, strings, table, word_lists

GROWTH = 1.5
PAIR, HOT = 1, 2
FULL = 4095
#: Bits of a fingerprint within its range, and keys in a range: about one key in 64 seems to occur elsewhere by chance.
BITS, RANGE = 26, 1_000_000
#: x has 52 bits of the sketch and the number of words (12 bits), y the other 64 bits of the sketch.
KEYED = "key long, s long, x long, y long"
FOUND = "kind int, key long, s long, x long, y long"
CHUNKS = "chunk long, id long, c long, s long, keys long, sets binary, sizes binary, codes binary, vocab binary"
#: The two tables that hold words of each vector, by vector.
FIRST, SECOND = np.array([0, 0, 1, 0]), np.array([0, 2, 2, 1])


def radius(a: int, b: int, similarity: float) -> int:
    """How many words two sets of these sizes may differ in."""
    return math.floor((a + b) * (1 - similarity) / (1 + similarity) + 1e-9)


def levels(n: np.ndarray, least: int, similarity: float) -> Iterator[tuple[np.ndarray, int]]:
    """For each level of sizes: the texts in it, and the number of parts."""
    if not len(n):
        return
    lo = least
    while lo <= n.max():
        hi = math.ceil(lo * GROWTH)
        widest = math.floor((hi - 1) / similarity + 1e-9)
        inside = np.flatnonzero((n >= lo) & (n <= widest))
        if len(inside):
            yield inside, radius(hi - 1, widest, similarity) // 2 + 1
        lo = hi


class Chunk:
    """Sets of words: their names, their sizes, and the words of one after the other as numbers in a list of word hashes."""

    def __init__(self, sets: np.ndarray, sizes: np.ndarray, codes: np.ndarray, vocab: np.ndarray):
        self.sets, self.sizes, self.codes, self.vocab = sets, sizes, codes, vocab
        self.starts = np.concatenate([[0], np.cumsum(sizes)])

    @classmethod
    def of_texts(cls, texts: pa.Array, least: int) -> tuple[np.ndarray, Chunk]:
        """The texts with at least ``least`` distinct words, and their sets, one for each of these texts."""
        doc, codes, words = word_lists(texts)
        n_words = max(1, len(words))
        cells = np.unique(doc.astype(np.int64) * n_words + codes)
        doc, codes = cells // n_words, cells % n_words
        n = np.bincount(doc, minlength=len(texts))
        docs = np.flatnonzero(n >= least)
        codes = codes[n[doc] >= least]
        vocab = hash64(words) if len(words) else np.zeros(0, np.uint64)
        used, codes = np.unique(codes, return_inverse=True)
        chunk = cls(np.zeros(len(docs), np.uint64), n[docs], codes, vocab[used])
        names = np.zeros(len(docs), np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(names, chunk.owners(), mix(chunk.vocab ^ np.uint64(0xA11CE))[codes])
            chunk.sets = mix(names + n[docs].astype(np.uint64))
        return docs, chunk

    @classmethod
    def of_row(cls, sets, sizes, codes, vocab) -> Chunk:
        return cls(np.frombuffer(sets, np.uint64), np.frombuffer(sizes, np.int32).astype(np.int64), np.frombuffer(codes, np.uint16 if len(vocab) <= 8 << 16 else np.uint32).astype(np.int64), np.frombuffer(vocab, np.uint64))

    def packed(self) -> tuple[bytes, bytes, bytes, bytes]:
        small = np.uint16 if len(self.vocab) <= 1 << 16 else np.uint32
        return self.sets.tobytes(), self.sizes.astype(np.int32).tobytes(), self.codes.astype(small).tobytes(), self.vocab.tobytes()

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def only(self, keep: np.ndarray) -> Chunk:
        """The sets at these places."""
        inside = np.zeros(len(self.sizes), bool)
        inside[keep] = True
        return Chunk(self.sets[inside], self.sizes[inside], self.codes[inside[self.owners()]], self.vocab)

    def sketch(self) -> tuple[np.ndarray, np.ndarray]:
        """The parity sketch of each set in two numbers, the first with the set's size in its lowest bits."""
        at = mix(self.vocab ^ np.uint64(0x5E7C)) % np.uint64(116)
        low, high = at < 52, at >= 52
        one = np.uint64(1)
        bits = np.where(low, one << (np.minimum(at, np.uint64(51)) + np.uint64(12)), np.uint64(0)), np.where(high, one << (np.maximum(at, np.uint64(52)) - np.uint64(52)), np.uint64(0))
        out = []
        for b in bits:
            running = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(b[self.codes])])
            out.append(running[self.starts[1:]] ^ running[self.starts[:-1]])
        return out[0] | np.minimum(self.sizes, FULL).astype(np.uint64), out[1]

    def keys(self, docs: np.ndarray, k: int, seed: int) -> np.ndarray:
        """Keys by set, part and table."""
        with np.errstate(over="ignore"):
            h = mix(self.vocab + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
            vector, value, place = 1 + ((h >> np.uint64(33)) % np.uint64(3)).astype(np.int64), mix(h ^ np.uint64(0xC0FFEE)), h & np.uint64(0xFFFFFFFF)
            part = ((place * np.uint64(k)) >> np.uint64(32)).astype(np.int64) * 3
            a, b = part + FIRST[vector], part + SECOND[vector]
            rank = np.full(len(self.sizes), -1)
            rank[docs] = np.arange(len(docs))
            rank = np.repeat(rank, self.sizes)
            mine = np.flatnonzero(rank >= 0)
            base, codes = rank[mine] * (3 * k), self.codes[mine]
            sums = np.zeros(len(docs) * k * 3, np.uint64)
            each = value[codes]
            np.add.at(sums, base + a[codes], each)
            np.add.at(sums, base + b[codes], each)
            tag = mix(np.arange(3 * k, dtype=np.uint64) + np.uint64(1000 * k + 7919 * seed))
            return mix(sums.reshape(-1, 3 * k) + tag)

    def all_keys(self, least: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """Every key, and the place of its set."""
        keys, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for docs, k in levels(self.sizes, least, similarity):
            keys.append(self.keys(docs, k, 1).ravel())
            rows.append(np.repeat(docs, 3 * k))
        return np.concatenate(keys), np.concatenate(rows)


def _pack(least: int, similarity: float):
    """Map task: a row for each text (its class and its set), and a row for each chunk."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = (TaskContext.get().partitionId() << 32) if TaskContext.get() else 0
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        types = [pa.int64() if x.endswith("long") else pa.binary() for x in CHUNKS.split(", ")]
        for number, batch in enumerate(batches):
            docs, chunk = Chunk.of_texts(strings(batch["text"]), least)
            if not len(docs):
                continue
            name = pa.array(np.full(len(docs), task + number, np.int64))
            ids, classes = (batch[x].take(pa.array(docs)).cast(pa.int64()) for x in ("id", "c"))
            none = [pa.nulls(len(docs), t) for t in types[4:]]
            yield pa.RecordBatch.from_arrays([name, ids, classes, pa.array(chunk.sets.view(np.int64)), *none], names)
            chunk = chunk.only(np.unique(chunk.sets, return_index=True)[1])
            n = sum(3 * k * len(d) for d, k in levels(chunk.sizes, least, similarity))
            row = [task + number, None, None, None, n, *chunk.packed()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

    return pack


def _own(batch: pa.RecordBatch) -> Iterator[tuple[int, Chunk, dict]]:
    """The chunks of a batch without the sets that belong to another chunk."""
    for row in batch.to_pylist():
        chunk = Chunk.of_row(row["sets"], row["sizes"], row["codes"], row["vocab"])
        if row["others"]:
            chunk = chunk.only(np.flatnonzero(~np.isin(chunk.sets.view(np.int64), np.array(row["others"], np.int64))))
        yield row["chunk"], chunk, row


def _spots(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Range and fingerprint of each key in one number."""
    return (((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32) << np.uint64(BITS)) | (keys & np.uint64((1 << BITS) - 1))


def _planes(values: np.ndarray) -> bytes:
    """Differences of sorted numbers, the bytes of one rank together, so that compression finds the empty ones."""
    return zlib.compress(np.ascontiguousarray(np.diff(values, prepend=np.uint64(0)).astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _fingerprints(least: int, similarity: float, ranges: int):
    """Map task: for each chunk and range, the fingerprints in it and which of them several sets of the chunk share."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, chunk, _ in _own(batch):
                spots, n = np.unique(_spots(chunk.all_keys(least, similarity)[0], ranges), return_counts=True)
                owner = (spots >> np.uint64(BITS)).astype(np.int64)
                used = np.unique(owner)
                edges = np.searchsorted(owner, [*used, ranges])
                parts = [(spots[a:b] & np.uint64((1 << BITS) - 1), n[a:b] > 1) for a, b in zip(edges[:-1], edges[1:])]
                cols = [pa.array(used.astype(np.int64)), pa.array(np.full(len(used), name, np.int64)), pa.array([_planes(f) for f, _ in parts], pa.binary()), pa.array([np.packbits(m).tobytes() for _, m in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["range", "chunk", "prints", "several"])

    return send


def _elsewhere(part: pd.DataFrame) -> pd.DataFrame:
    """For each chunk's fingerprints in one range: one bit, whether several sets have it."""
    each = [np.cumsum(np.frombuffer(zlib.decompress(p), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel(), dtype=np.uint64).astype(np.uint32) for p in part["prints"]]
    values = np.concatenate(each)
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    flags = np.zeros(len(values), bool)
    flags[order[1:]] = same
    flags[order[:-1]] |= same
    out, at = [], 0
    for p, several in zip(each, part["several"]):
        out.append(np.packbits(flags[at : at + len(p)] | np.unpackbits(np.frombuffer(several, np.uint8), count=len(p)).astype(bool)).tobytes())
        at += len(p)
    return pd.DataFrame({"chunk": part["chunk"], "range": part["range"], "bits": out})


def _rows(key, s, x, y) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a).view(np.int64)) for a in (key, s, x, y)], ["key", "s", "x", "y"])


def _shared_keys(least: int, similarity: float, ranges: int):
    """Map task: the keys of each chunk that occur elsewhere, with the name and sketch of their set."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, chunk, row in _own(batch):
                keys, rows = chunk.all_keys(least, similarity)
                spots, at = np.unique(_spots(keys, ranges), return_inverse=True)
                edges = np.searchsorted(spots >> np.uint64(BITS), np.arange(ranges + 1))
                flags = np.zeros(len(spots), bool)
                for b in row["bits"]:
                    lo, hi = edges[b["range"]], edges[b["range"] + 1]
                    flags[lo:hi] = np.unpackbits(np.frombuffer(b["bits"], np.uint8), count=hi - lo)
                take = np.flatnonzero(flags[at])
                x, y = chunk.sketch()
                take = take[np.argsort(rows[take], kind="stable")]
                rows = rows[take]
                for k in range(0, len(take), 100_000):
                    r = rows[k : k + 100_000]
                    yield _rows(keys[take[k : k + 100_000]], chunk.sets[r], x[r], y[r])

    return send


def _finer_keys(least: int, similarity: float):
    """Map task: for each chunk and the hot keys of its sets, the keys of a second split under each of them."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, chunk, row in _own(batch):
                hot = np.unique(np.array([x["key"] for x in row["hot"]], np.int64).view(np.uint64))
                x, y = chunk.sketch()
                for docs, k in levels(chunk.sizes, least, similarity):
                    # A hot key belongs to one level, so it is refined in that level only.
                    own = chunk.keys(docs, k, 1)
                    at, column = np.nonzero(np.isin(own, hot))
                    if not len(at):
                        continue
                    finer = chunk.keys(docs, k, 2)
                    with np.errstate(over="ignore"):
                        keys = mix(finer[at] + own[at, column][:, None])
                    r = np.repeat(docs[at], keys.shape[1])
                    keys = keys.ravel()
                    for j in range(0, len(r), 100_000):
                        yield _rows(keys[j : j + 100_000], chunk.sets[r[j : j + 100_000]], x[r[j : j + 100_000]], y[r[j : j + 100_000]])

    return send


def _pairs(bucket: int, similarity: float):
    """Task over rows sorted by (key, set): runs of one key become pairs, longer ones stay rows."""
    per_word = (1 - similarity) / (1 + similarity)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last run so far
        long_key = None  # the key of a run that is known to be too long

        def out(kind, *cols):
            cols = [np.full(len(cols[0]), kind, np.int32), *cols]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)) for a in cols], ["kind", "key", "s", "x", "y"])

        def work(rows, last):
            nonlocal held, long_key
            if len(rows[0]) > 1:  # a set may be repeated
                key, s = rows[0], rows[1]
                first = np.concatenate([[True], (key[1:] != key[:-1]) | (s[1:] != s[:-1])])
                rows = [r[first] for r in rows]
            key = rows[0]
            starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1]) if len(key) else np.zeros(0, np.int64)
            sizes = np.diff(np.concatenate([starts, [len(key)]]))
            if not last and len(starts):
                cut = starts[-1]
                if sizes[-1] <= bucket and key[cut] != long_key:
                    held, starts, sizes = [r[cut:] for r in rows], starts[:-1], sizes[:-1]
                else:
                    long_key = key[cut]
            runs = np.repeat(np.arange(len(sizes)), sizes)
            rows = [r[: len(runs)] for r in rows]
            too_long = (sizes > bucket) | (rows[0][starts] == long_key if long_key is not None and len(starts) else False)
            hot = too_long[runs] if len(runs) else np.zeros(0, bool)
            if hot.any():
                yield out(HOT, *(r[hot] for r in rows))
                rows = [r[~hot] for r in rows]
            key, s, x, y = rows
            x, y = np.ascontiguousarray(x).view(np.uint64), np.ascontiguousarray(y).view(np.uint64)
            n = (x & np.uint64(FULL)).astype(np.int64)
            bits, words = x >> np.uint64(12), np.where(n == FULL, 1e9, n * per_word + 5e-10).astype(np.float32)

            def checked(a, b):
                apart = np.bitwise_count(bits[a] ^ bits[b]).astype(np.int32) + np.bitwise_count(y[a] ^ y[b])
                low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
                good = (apart <= (low + high) * per_word + 1e-9) & (low >= similarity * high - 1e-9) | (high == FULL)
                a, b = a[good], b[good]
                return out(PAIR, key[a], s[a], s[b], s[b])

            starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)
            sizes = np.diff(starts)
            # Long runs by blocks of a matrix, short ones all together, by the distance of their rows.
            for lo, hi in zip(starts[:-1][sizes > 32], starts[1:][sizes > 32]):
                for i in range(lo, hi, 256):
                    top = min(hi, i + 256)
                    near = np.bitwise_count(bits[i:top, None] ^ bits[None, i:hi]) <= words[i:top, None] + words[None, i:hi] + np.float32(1e-3)
                    a, b = np.nonzero(near)
                    keep = b > a
                    yield checked(a[keep] + i, b[keep] + i)
            short = np.repeat(sizes <= 32, sizes)
            left = np.flatnonzero((key[1:] == key[:-1]) & short[1:]) if len(key) else np.zeros(0, np.int64)
            step = 1
            while len(left):
                near = np.bitwise_count(bits[left] ^ bits[left + step]) <= words[left] + words[left + step] + np.float32(1e-3)
                yield checked(left[near], left[near] + step)
                step += 1
                left = left[left + step < len(key)]
                left = left[key[left] == key[left + step]]

        for batch in batches:
            rows = [batch[i].to_numpy(zero_copy_only=False) for i in ("key", "s", "x", "y")]
            if held is not None:
                rows, held = [np.concatenate([a, b]) for a, b in zip(held, rows)], None
            yield from work(rows, False)
        if held is not None:
            yield from work(held, True)

    return pairs


def _runs(keyed: DataFrame, bucket: int, similarity: float) -> DataFrame:
    return materialise(keyed.repartition("key").sortWithinPartitions("key", "s").mapInArrow(_pairs(bucket, similarity), FOUND))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map task: the words of the wanted sets of each chunk."""
    for batch in batches:
        for row in batch.to_pylist():
            chunk = Chunk.of_row(row["sets"], row["sizes"], row["codes"], row["vocab"])
            chunk = chunk.only(np.flatnonzero(np.isin(chunk.sets.view(np.int64), np.array(row["wanted"], np.int64))))
            lists = pa.ListArray.from_arrays(pa.array(chunk.starts.astype(np.int32)), pa.array(chunk.vocab[chunk.codes].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(chunk.sets.view(np.int64)), lists], ["s", "w"])


def similar_sets(df: DataFrame, key: str, col: str, similarity: float = 0.8, least: int = 30, bucket: int = 16384) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links between different sets of words, the texts of each set, and the sets.

    Returns ``links(a, b, shared, either)``, a < b, one row for each two sets whose similarity is at least
    ``similarity``, ``members(id, c, s)``: rows, the class of equal texts each is in, and the set of their words, and
    ``sets(s, lo, hi)``: each set with the least and largest of its classes. Only texts with at least ``least`` distinct words, as a reader sees them, take part;
    NULL, empty and blank texts therefore never do. Classes are named by the 64-bit hash of the canonical text, sets by one of their words. Rows
    repeated under one id count once. An empty table gives empty results.
    """
    text = canonicalise(df.select(F.col(key).cast("long").alias("id"), F.col(col).alias("text")), "text", "text")
    text = text.where("id is not null and text <> ''").select("id", F.xxhash64("text").alias("c"), "text")
    packed = materialise(text.mapInArrow(_pack(least, similarity), CHUNKS))
    rows, chunks = packed.where("sets is null"), packed.where("sets is not null").select("chunk", "sets", "sizes", "codes", "vocab")
    ranges = max(8, -(-(packed.agg(F.sum("keys")).first()[0] or 0) // RANGE))
    places = materialise(rows.groupBy("s").agg(F.min("chunk").alias("own"), F.max("chunk").alias("last"), F.min("c").alias("lo"), F.max("c").alias("hi")))
    twice = places.where("own < last").select("s", "own")
    others = materialise(rows.select("s", "chunk").join(if_small(twice), "s").where("chunk <> own").groupBy("chunk").agg(F.collect_set("s").alias("others")))
    mine = chunks.join(if_small(others, F.size("others") * 8), "chunk", "left")
    prints = mine.mapInArrow(_fingerprints(least, similarity, ranges), "range long, chunk long, prints binary, several binary")
    bits = materialise(prints.groupBy("range").applyInPandas(_elsewhere, "chunk long, range long, bits binary"))
    told = materialise(bits.groupBy("chunk").agg(F.collect_list(F.struct("range", "bits")).alias("bits")))
    shared = mine.join(if_small(told, F.expr("aggregate(bits, 0L, (n, b) -> n + length(b.bits))")), "chunk").mapInArrow(_shared_keys(least, similarity, ranges), KEYED)
    found = _runs(shared, bucket, similarity)
    pairs = found.where(F.col("kind") == PAIR).select("s", F.col("x").alias("t"))
    hot = found.where(F.col("kind") == HOT).select("key", "s")
    if not hot.isEmpty():
        of_chunk = hot.join(places.select("s", F.col("own").alias("chunk")), "s").groupBy("chunk", "key").agg(F.collect_list("s").alias("s")).groupBy("chunk").agg(F.collect_list(F.struct("key", "s")).alias("hot"))
        again = _runs(mine.join(of_chunk, "chunk").mapInArrow(_finer_keys(least, similarity), KEYED), bucket, similarity)
        pairs = pairs.union(again.where(F.col("kind") == PAIR).select("s", F.col("x").alias("t")))
        still = again.where(F.col("kind") == HOT).select("key", "s", "x", "y").distinct()
        if not still.isEmpty():
            pairs = pairs.union(_blocks(still, similarity))
    pairs = materialise(pairs.select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct())
    used = if_small(materialise(pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct())).join(places, "s").groupBy(F.col("own").alias("chunk")).agg(F.collect_list("s").alias("wanted"))
    words = materialise(chunks.join(if_small(materialise(used), F.size("wanted") * 8), "chunk").mapInArrow(_words, "s long, w array<long>"))
    both = F.size(F.array_intersect("wa", "wb"))
    checked = (
        pairs.join(words.select(F.col("s").alias("a"), F.col("w").alias("wa")), "a")
        .join(words.select(F.col("s").alias("b"), F.col("w").alias("wb")), "b")
        .select("a", "b", both.alias("shared"), (F.size("wa") + F.size("wb")).alias("all"))
        .select("a", "b", "shared", (F.col("all") - F.col("shared")).alias("either"))
    )
    links = materialise(checked.where(F.col("shared") >= similarity * F.col("either") - 1e-9))
    return links, rows.select("id", "c", "s"), places.select("s", "lo", "hi")


def _blocks(still: DataFrame, similarity: float, block: int = 2000) -> DataFrame:
    """Pairs of sets that share a key too often for one task, by sketch, a pair of blocks at a time."""
    blocks = still.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = still.join(blocks, "key").withColumn("b", F.expr("pmod(s, blocks)").cast("int"))
    each = F.explode(F.expr("sequence(0, blocks - 1)"))
    left = rows.select("key", F.col("b").alias("ba"), each.alias("bb"), "s", "x", "y")
    right = rows.select("key", each.alias("ba"), F.col("b").alias("bb"), F.col("s").alias("t"), F.col("x").alias("xx"), F.col("y").alias("yy"))
    near = F.expr(
        f"s < t and (greatest(x & {FULL}, xx & {FULL}) = {FULL} or bit_count(shiftrightunsigned(x ^ xx, 12)) + bit_count(y ^ yy) <= ((x & {FULL}) + (xx & {FULL})) * {(1 - similarity) / (1 + similarity)!r} + 1e-9)"
    )
    return left.join(right, ["key", "ba", "bb"]).where(near).select("s", "t")


def near_duplicate_pairs(df: DataFrame, key: str, col: str, **options) -> DataFrame:
    """Pairs (id_a < id_b) of rows with different but similar texts; see ``similar_sets``."""
    links, members, sets = similar_sets(df, key, col, **options)
    linked = if_small(materialise(links.select(F.explode(F.array("a", "b")).alias("s")).distinct()))
    rows = materialise(members.join(linked, "s").select("s", "id").distinct())
    across = links.join(rows.select(F.col("s").alias("a"), F.col("id").alias("i")), "a").join(rows.select(F.col("s").alias("b"), F.col("id").alias("j")), "b")
    # Texts of the same words in another order, number or punctuation.
    same = materialise(members.join(if_small(sets.where("lo < hi").select("s")), "s").select("s", "c", "id").distinct())
    classes = same.select("s", "c").distinct()
    within = classes.join(classes.select("s", F.col("c").alias("d")), "s").where("c < d").join(same.select("c", F.col("id").alias("i")), "c").join(same.select(F.col("c").alias("d"), F.col("id").alias("j")), "d")
    return across.select("i", "j").union(within.select("i", "j")).select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))


def near_duplicate_groups(df: DataFrame, key: str, col: str, **options) -> DataFrame:
    """One row for each row with at least ``least`` distinct words: (id, class_id, group_id, links).

    ``class_id`` and ``group_id`` are the least ids of the rows with an equal text, and of all texts linked directly or
    through others; ``links`` counts the different texts directly linked to the row's own.
    """
    links, members, _ = similar_sets(df, key, col, **options)
    members = materialise(members.distinct())
    classes = materialise(members.groupBy("s", "c").agg(F.min("id").alias("class_id")))
    sets = materialise(classes.groupBy("s").agg(F.min("class_id").alias("g"), F.count("*").alias("texts")))
    edges = materialise(links.select("a", "b").union(links.select("b", "a")).toDF("u", "v"))
    around = edges.join(sets.select(F.col("s").alias("v"), "texts"), "v").groupBy(F.col("u").alias("s")).agg(F.sum("texts").alias("others"))
    name = sets.select("s", F.col("g").alias("u"))
    edges = materialise(edges.join(name.select(F.col("s").alias("v"), F.col("u").alias("w")), "v").join(name.select(F.col("s").alias("u"), F.col("u").alias("t")), "u").select(F.col("t").alias("u"), F.col("w").alias("v")))
    label = materialise(sets.select(F.col("g").alias("u"), "g"))
    while True:
        lowest = edges.join(label.withColumnsRenamed({"u": "v", "g": "h"}), "v").groupBy("u").agg(F.min("h").alias("h"))
        step = label.join(lowest, "u", "left").select("u", F.least("g", F.coalesce("h", "g")).alias("g"), F.col("g").alias("old"))
        # Pointer jumping: a label that is a set of its own takes that set's label.
        jump = step.join(step.select(F.col("u").alias("g"), F.col("g").alias("top")), "g", "left").select("u", F.coalesce("top", "g").alias("g"), "old")
        step = materialise(jump)
        label = step.select("u", "g")
        if step.where("g <> old").isEmpty():
            break
    each = sets.join(around, "s", "left").join(label.select(F.col("u").alias("g"), F.col("g").alias("group_id")), "g").select("s", "group_id", (F.coalesce("others", F.lit(0)) + F.col("texts") - 1).alias("links"))
    return members.select("id", "s", "c").join(classes, ["s", "c"]).join(each, "s").select("id", "class_id", "group_id", "links")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_pairs(table(spark, sf_dir, "raw_posts"), "id", "posts")


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "raw_posts"), "id", "posts")


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}
