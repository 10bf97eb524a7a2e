"""Helpers shared by the corpus operators: table access, materialised stages, batch word arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.session import new_path

#: A word is a longest run of letters and digits, in lower case.
NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the test data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that later uses neither recompute
    it nor depend on any single executor. All stages of an application are in one folder, which is deleted when its driver exits."""
    spark = df.sparkSession
    path = new_path(spark, "stage")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def if_small(df: DataFrame, row_bytes: Column | int = 16, most: int = 64_000_000) -> DataFrame:
    """``df`` to be broadcast in a join, if the sum of ``row_bytes`` over its rows is at most ``most``; else as it is, to be shuffled."""
    size = df.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def strings(array) -> pa.Array:
    """A string array without chunks; NULL becomes an empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return pc.fill_null(array.cast(pa.large_string()), "")


def word_lists(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text: (document of each word, code of each word, distinct words)."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), NOT_WORD)
    doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    coded = pc.list_flatten(lists).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    words = coded.dictionary
    blank = pc.index(words, pa.scalar("", words.type)).as_py()
    if blank >= 0:
        keep = codes != blank
        doc, codes = doc[keep], codes[keep]
    return doc, codes, words


def hash64(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each distinct word, the same in every process."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words.to_pylist()), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit value of each 64-bit value (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
