"""Problem 8: evaluation passages inside a corpus.

Words are typed: numbers, units and names become placeholders, so that a window of ten typed words is a
template. Windows of the items are hash-joined with windows of the documents on the template; the slots then decide. Equal
slots make a verbatim passage (``p8_found``); other slots that map one to one onto the item's make a re-parameterised question, for which
a number with decimals or thousands is one word.

A word's type depends on its lower-case form alone wherever that form occurs in an item, so a passage copied in other letter
case has the item's template and no verbatim window is missed. Before the join, a bit map of a fixed size over the items' templates drops most
windows of documents; with very many items it only drops fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import NOT_WORD, hash64, if_small, materialise, mix, strings, table

# Unit words.
UNITS = frozenset("mm cm m km inch inches ft feet yard yards mile miles g kg mg lb lbs oz pound pounds ounce ounces ml l litre litres liter liters s sec second seconds min minute minutes hour hours day days week weeks month months year years percent euro euros dollar dollars crown crowns cent cents watt watts volt volts degree degrees".split())
#: Size of the bit map over the items' templates.
SLOTS = 1 << 20
WINDOWS = "owner long, template long, exact long, slots array<string>"


def _cased_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    lists = pc.split_pattern_regex(texts, NOT_WORD)
    doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    coded = pc.list_flatten(lists).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    filled = (pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0)[codes] if len(codes) else np.zeros(0, bool)
    return doc[filled], codes[filled], coded.dictionary


def _typed(words: pa.Array, plain: frozenset, names: frozenset) -> pa.Array:
    """What each word is in a template."""

    def one(word: str) -> str:
        low = word.lower()
        if any(c.isdigit() for c in low):
            return "<number>"
        if low in UNITS:
            return "<unit>"
        if low in names or low not in plain and word[:1].isupper():
            return "<name>"
        return low

    return pa.array([one(w) for w in words.to_pylist()], pa.large_string())


def _rolling(values: np.ndarray, size: int) -> np.ndarray:
    """A hash of every window of ``size`` values."""
    n = max(0, len(values) - size + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + values[j : j + n])
    return out


def _windows(texts: pa.Array, size: int, plain: frozenset, names: frozenset):
    """(text, first word, template hash, exact hash) of every window that lies in one text, and the words."""
    doc, codes, words = _cased_words(texts)
    low = pc.utf8_lower(words)
    exact, template = hash64(low)[codes] if len(words) else np.zeros(0, np.uint64), hash64(_typed(words, plain, names))[codes] if len(words) else np.zeros(0, np.uint64)
    n = max(0, len(doc) - size + 1)
    inside = doc[:n] == doc[size - 1 :][:n]
    at = np.flatnonzero(inside)
    return doc, codes, words, at, _rolling(template, size)[at], _rolling(exact, size)[at]


def vocabulary(items: DataFrame, col: str) -> tuple[frozenset, frozenset]:
    """(words seen in lower case, words seen only with a capital) of the items: as many as their language has, whatever the corpus' size."""
    words = items.select(F.explode(F.array_distinct(F.split(col, NOT_WORD))).alias("w")).where("w <> ''")
    seen = words.groupBy(F.lower("w").alias("low")).agg(F.max(F.col("w") == F.lower("w")).alias("plain")).collect()
    return frozenset(r["low"] for r in seen if r["plain"]), frozenset(r["low"] for r in seen if not r["plain"])


def _hashed(size: int, words, numbers: bool, wanted=None):
    """Map task: the windows of each text, all of them or those whose template can be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, names = words.value
        allowed = None if wanted is None else np.unpackbits(np.frombuffer(wanted.value, np.uint8)).astype(bool)
        for batch in batches:
            texts = strings(batch["text"])
            if numbers:
                texts = pc.replace_substring_regex(texts, r"(\d)[.,](\d)", r"\1\2")
            doc, codes, found, at, template, exact = _windows(texts, size, plain, names)
            if allowed is not None:
                keep = np.flatnonzero(allowed[(template & np.uint64(SLOTS - 1)).astype(np.int64)]) if len(at) else at
                at, template, exact = at[keep], template[keep], exact[keep]
            low = pc.utf8_lower(found)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * size), low.take(pa.array(codes[at[:, None] + np.arange(size)].ravel())).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([batch["owner"].take(pa.array(doc[at])).cast(pa.int64()), pa.array(template.view(np.int64)), pa.array(exact.view(np.int64)), lists], ["owner", "template", "exact", "slots"])

    return run


def template_matches(docs: DataFrame, doc_key: str, doc_col: str, items: DataFrame, item_key: str, item_col: str, size: int = 10, numbers: bool = False) -> DataFrame:
    """Documents and items that share at least one template window of ``size`` words.

    Columns: doc, item, windows (shared), verbatim (with equal words), one_to_one (slots of the other windows map one to one). With ``numbers``, a number
    with decimals or thousands is one word. NULL and short texts share nothing; rows that share a key are one document or item. An empty table of
    either kind gives an empty result. Whole texts are read, of any length; any number of items.
    """
    context = docs.sparkSession.sparkContext
    tests = items.where(F.col(item_key).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_key).cast("long").alias("owner"), F.col(item_col).alias("text"))
    words = context.broadcast(vocabulary(tests, "text"))
    known = materialise(tests.mapInArrow(_hashed(size, words, numbers), WINDOWS).distinct())
    bits = np.zeros(SLOTS, bool)
    bits[[r[0] for r in known.select(F.col("template").bitwiseAND(SLOTS - 1)).distinct().collect()]] = True
    wanted = context.broadcast(np.packbits(bits).tobytes())
    rows = docs.where(F.col(doc_key).isNotNull() & F.col(doc_col).isNotNull()).select(F.col(doc_key).cast("long").alias("owner"), F.col(doc_col).alias("text"))
    mine = rows.mapInArrow(_hashed(size, words, numbers, wanted), WINDOWS).withColumnsRenamed({"owner": "doc", "exact": "x", "slots": "mine"})
    known = if_small(known.withColumnRenamed("owner", "item"), F.lit(400))
    same = F.col("exact") == F.col("x")
    # The pairs of slots of windows that are no verbatim copy; of one document and item there are as many as the item has words.
    slots = F.when(~same, F.arrays_zip("slots", "mine"))
    joined = mine.join(known, "template").groupBy("doc", "item").agg(F.count("*").alias("windows"), F.count(F.when(same, 1)).alias("verbatim"), F.array_distinct(F.flatten(F.collect_set(slots))).alias("pairs"))
    one = (F.size(F.array_distinct(F.col("pairs.slots"))) == F.size("pairs")) & (F.size(F.array_distinct(F.col("pairs.mine"))) == F.size("pairs"))
    return joined.select("doc", "item", "windows", "verbatim", one.alias("one_to_one"))


def _all(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return template_matches(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text", **options)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir).where("verbatim > 0").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p8_reparameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an item's question in other numbers, names or units only."""
    return _all(spark, sf_dir, numbers=True).where("verbatim = 0 and one_to_one").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "windows")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each leaked item is in."""
    return p8_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"))


QUERIES = {"p8_found": p8_found, "p8_items": p8_items, "p8_reparameterised": p8_reparameterised}

_WINDOWS_SQL = r"""
with words as (select {key} k, regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}]+') w from {table} where text is not null),
     spots as (select k, w, unnest(range(1, len(w) - 8)) i from words where len(w) >= 10)
select distinct k, array_to_string(w[i:i + 9], ' ') s from spots
"""
_FOUND_SQL = f"""
select distinct d.k as doc_id, e.k as item_id
from ({_WINDOWS_SQL.format(key="doc_id", table="documents")}) d join ({_WINDOWS_SQL.format(key="item_id", table="eval_items")}) e using (s)
"""
ORACLE = {"p8_found": _FOUND_SQL, "p8_items": f"select item_id, count(*) as documents from ({_FOUND_SQL}) group by item_id"}
