"""Problem 2: text cut off by field limits or in transfer.

Lengths are recomputed as a store may have counted them: characters, UTF-16 units, UTF-8 bytes, with HTML entities, with JSON escapes,
with two-character line ends. A length at which many more texts end than at the lengths around it is a hidden limit. Then the endings are
inspected: what stands after the author's last words (page lines, emoji, tags, links, "see more" marks) is taken off, and
the last words are compared with the whole corpus: how often a sentence ends after them, and how often it goes on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.boilerplate import canonical_lines, page_lines
from postmill.llm.common import materialise, mix, table

# Marks that say a text goes on elsewhere.
MORE = r"(?:\[\s*(?:…|\.{2,}|\+|more|mehr|más|plus|altro|mais)\s*\]|\(\s*(?:…|\.{2,}|more|continued|cont\.?|mehr|más|suite|segue|continua)\s*\)|…|\.{2,}|(?:see|read|show|view) more|continue reading|\bmore\b(?=\s*$)(?<=… more)|(?:mehr|alles) (?:anzeigen|lesen)|weiterlesen|(?:ver|leer|mostrar) más|seguir leyendo|voir plus|lire (?:la suite|plus)|afficher plus|(?:mostra|leggi|vedi) (?:altro|di più|tutto)|continua a leggere|(?:ver|ler|leia|mostrar) mais|continuar lendo|\[truncated\]|\(truncated\)|<cut>|\[cut\])"
EMOJI = "\U0001f000-\U0001faff☀-➿←-⇿⌀-⏿⬀-⯿️‍"
AFTER = re.compile(rf"""(?:\s*(?:[{EMOJI}]+|#\w+|@\w+|(?:https?://|www\.)\S*|[:;]-?[()DP](?!\w)|\(["“][^()"”]{{0,80}}["”]\)))+\s*$""")
MORE_END = re.compile(rf"\s*{MORE}\s*$", re.I)
FINAL = re.compile(r"[.!?。！？][\"'”’»)\]]*\s*$|[.!?][\"'”’»)\]]*\s*[!?]+\s*$")
PLATFORMS = ("reddit", "twitter", "quora", "facebook", "linkedin")
#: How the last words can look: contexts of three words, of two and the kind of the third, of two, of one.
ORDERS = 4
MARK, PAUSE, WORD = 0, 1, 2
MARKS = frozenset(".!?…\n")
START = 0x5EED
STRETCH = 120
COLUMNS = ["key", "c0", "c1", "c2", "c3", "words", "small", "range", "contexts", "tallies"]
SCANNED = "key long, c0 long, c1 long, c2 long, c3 long, words long, small long, range long, contexts binary, tallies binary"
LINK = re.compile(r"(?:https?://|www\.)\S*")


def lengths(text: Column) -> dict[str, Column]:
    """The length of a text under other ways to count."""

    def count(ch: str) -> Column:
        return F.char_length(text) - F.char_length(F.replace(text, F.lit(ch), F.lit("")))

    chars = F.char_length(text)
    return {
        "characters": chars,
        "utf16": F.when(F.octet_length(text) == chars, chars).otherwise((F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")),
        "utf8": F.octet_length(text),
        "html": chars + 4 * count("&") + 3 * (count("<") + count(">")) + 5 * count('"'),
        "json": chars + count('"') + count("\\") + count("\n") + count("\t"),
        "crlf": chars + count("\n"),
    }


def hidden_limits(rows: DataFrame, measures: list[str], reach: int = 8, times: float = 3.0, sigmas: float = 6.0, shortest: int = 40) -> DataFrame:
    """(measure, length): lengths with far more texts than the ``reach`` lengths on either side.

    Lengths below ``shortest`` are those of stock phrases, whose copies stand out as well.
    ``rows`` has a column for each measure. The histogram has at most one row for each measure and length.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("int").alias("length")) for m in measures])).alias("x")
    counts = materialise(rows.select(pairs).select("x.*").groupBy("measure", "length").agg(F.count("*").alias("n")))
    near = counts.select("measure", F.explode(F.sequence(F.col("length") - reach, F.col("length") + reach)).alias("length"), F.col("length").alias("at"), "n")
    around = near.where("at <> length").groupBy("measure", "length").agg((F.sum("n") / (2 * reach)).alias("usual"))
    found = counts.join(around, ["measure", "length"], "left").withColumn("usual", F.coalesce("usual", F.lit(0.0)))
    return found.where((F.col("length") >= shortest) & (F.col("n") >= times * F.col("usual")) & (F.col("n") - F.col("usual") >= sigmas * F.sqrt(F.col("usual") + 4))).select("measure", "length", "n", "usual")


def author_end(lines: list[str]) -> str:
    """The author's words up to their last, without what was put after them."""
    kept = [x for x, page in zip(lines, page_lines(lines)) if not page and x.strip()] if len(lines) > 1 else lines
    text = "\n".join(kept).rstrip()
    # What stands after the last words is searched from the end, a stretch at a time, until nothing more comes off.
    while text:
        cut = text
        last = cut.rsplit(None, 1)[-1]
        if len(last) < len(cut) and LINK.fullmatch(last):  # a link of any length
            cut = cut[: -len(last)].rstrip()
        for pattern in (AFTER, MORE_END):
            if m := pattern.search(cut, max(0, len(cut) - STRETCH)):
                cut = cut[: m.start()].rstrip()
        if cut == text:
            return text
        text = cut
    return text


def _sequence(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Words and marks of the texts in order: (text, kind, hash, shape); kinds are MARK, PAUSE and WORD."""
    import xxhash

    arr = pc.replace_substring_regex(pa.array(texts, pa.large_string()), r"[0-9]+(?:[.,:][0-9]+)*", "0")
    arr = pc.replace_substring_regex(arr, r"[^\p{L}\p{M}\p{N}.!?;:,…\n'’-]+", " ")
    arr = pc.replace_substring_regex(arr, r"([.!?;:,…\n])", r" \1 ")
    lists = pc.split_pattern(arr, " ")
    doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    coded = pc.list_flatten(lists).dictionary_encode()
    codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    kind = np.array([MARK if w in MARKS else PAUSE if w in ";:," else WORD if any(c.isalnum() for c in w) else -1 for w in words], np.int8)
    kind[[i for i, w in enumerate(words) if not w]] = -1
    value = np.array([START if k == MARK else xxhash.xxh3_64_intdigest(w.strip("'’-").lower()) for w, k in zip(words, kind)], np.uint64)
    shape = np.array([11 if w[:1].isdigit() else 12 if w[:1].isupper() else 13 for w in words], np.uint64)
    keep = kind[codes] >= 0 if len(codes) else np.zeros(0, bool)
    doc, codes = doc[keep], codes[keep]
    return doc, kind[codes], value[codes], shape[codes]


def _scan(ranges: int):
    """Map task: a row for each text without a final mark (its last words), and, by range of the contexts, packed counts of endings after the words of all texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _scanned(batches, ranges)

    return scan


def _scanned(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def pack():
        keys, kinds = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        at, unique = pd.factorize(keys)
        counts = np.stack([np.bincount(at, kinds == k, len(unique)) for k in (MARK, PAUSE, WORD)], 1).astype(np.uint32)
        unique = unique.view(np.int64)
        part = np.mod(unique, ranges)
        order = np.argsort(part, kind="stable")
        used, first = np.unique(part[order], return_index=True)
        slices = [order[a:b] for a, b in zip(first, [*first[1:], len(order)])]
        none = pa.nulls(len(used), pa.int64())
        blobs = [pa.array([x[i].tobytes() for i in slices], pa.binary()) for x in (unique, counts)]
        return pa.RecordBatch.from_arrays([*[none] * 7, pa.array(used), *blobs], COLUMNS)

    for batch in batches:
        texts = [author_end(x) if len(x) > 1 or not FINAL.search((x[0] or "")[-9:]) or MORE_END.search((x[0] or "")[-40:]) else x[0] for x in batch["lines"].to_pylist()]
        doc, kind, value, shape = _sequence(texts)
        if not len(doc):
            continue
        follower = np.full(len(doc), -1, np.int8)
        follower[:-1] = np.where(doc[1:] == doc[:-1], kind[1:], -1)
        # Words before, across pauses but not across the start of a sentence.
        full = np.flatnonzero(kind != PAUSE)
        d, v, m = doc[full], value[full], kind[full] == MARK
        one = np.full(len(full), START, np.uint64)
        one[1:] = np.where(d[1:] == d[:-1], v[:-1], np.uint64(START))
        two = np.full(len(full), START, np.uint64)
        two[2:] = np.where((d[2:] == d[:-2]) & ~m[1:-1], v[:-2], np.uint64(START))
        word = ~m
        contexts, after = _orders(two[word], one[word], v[word], shape[full][word]), follower[full][word]
        owner = d[word]
        told = after >= 0
        parts.append((contexts[told].T.ravel(), np.tile(after[told], ORDERS)))
        # The last word of a text that has no mark after it.
        last = np.flatnonzero(np.concatenate([owner[1:] != owner[:-1], [True]])) if len(owner) else np.zeros(0, np.int64)
        open_ = last[(after[last] == -1) | (after[last] == PAUSE) & (kind[np.searchsorted(doc, owner[last], "right") - 1] == PAUSE)]
        n = np.bincount(owner, minlength=len(texts))[owner[open_]]
        keys = batch["key"].to_numpy(zero_copy_only=False)[owner[open_]]
        c = contexts[open_].view(np.int64)
        spare = [pa.nulls(len(open_), t) for t in (pa.int64(), pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(np.ascontiguousarray(c[:, i])) for i in range(ORDERS)], pa.array(n.astype(np.int64)), pa.array((shape[full][word][open_] == 13).astype(np.int64)), *spare], COLUMNS)
        if sum(len(k) for k, _ in parts) > 12_000_000:
            yield pack()
    if parts:
        yield pack()


def _told(packs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """The counts of the contexts of one range that some open ending asks for."""
    need = np.unique(asked["context"].to_numpy(np.int64))
    total = np.zeros((len(need), 3), np.int64)
    for contexts, tallies in zip(packs["contexts"], packs["tallies"]) if len(need) else ():
        contexts, tallies = np.frombuffer(contexts, np.int64), np.frombuffer(tallies, np.uint32).reshape(-1, 3)
        at = np.minimum(np.searchsorted(need, contexts), len(need) - 1)
        hit = need[at] == contexts
        total[at[hit]] += tallies[hit]
    return pd.DataFrame({"context": need, "ends": total[:, 0], "pauses": total[:, 1], "goes_on": total[:, 2]})


def _orders(a: np.ndarray, b: np.ndarray, c: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Context hashes (rows x orders) of the last word but two, the last but one, the last, and its kind."""
    with np.errstate(over="ignore"):
        two = mix(b * np.uint64(3) + np.uint64(2))
        three = mix(a * np.uint64(5) + two)
        return np.stack([mix(three + c), mix(three + shape), mix(two ^ mix(c)), mix(c + np.uint64(1))], 1)


def find_cut_texts(df: DataFrame, key: str, col: str, least: int = 6) -> DataFrame:
    """The keys of texts whose author's words stop inside a word or sentence.

    NULL, empty and blank texts are never cut. A text without a final mark is cut if it ends at a hidden limit, or, with fewer than
    ``least`` words, if a sentence mostly goes on after its last three words, or else if its last word is unknown to the corpus or never follows the word before it though others do, or if after its last words (three, else two and the kind of the third, else two, else one, whichever the
    corpus knows) a sentence goes on more often than it ends or pauses. The counts cover all texts, whole. Rows that share a key are judged
    one by one. An empty table gives an empty result.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(col).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(col).alias("text"))
    measured = rows.select("key", *[v.alias(k) for k, v in lengths(F.col("text")).items()])
    measures = measured.columns[1:]
    limits = hidden_limits(measured, measures)
    # Few lengths can stand out so far from the ones around them; still a join, not a list.
    at_limit = measured.select("key", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("int").alias("length")) for m in measures])).alias("x")).select("key", "x.*").join(limits.select("measure", "length"), ["measure", "length"]).select("key").distinct()
    ranges = max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    seen = canonical_lines(rows).select("key", "lines")
    scanned = materialise(seen.mapInArrow(_scan(ranges), SCANNED))
    asked = scanned.where("key is not null").select("key", "words", "small", F.posexplode(F.array("c0", "c1", "c2", "c3")).alias("k", "context"))
    # Only the counts of contexts that are asked for leave their packs.
    wanted = asked.select("context").distinct().select("context", F.pmod("context", F.lit(ranges)).alias("range"))
    packs = scanned.where("range is not null").select("range", "contexts", "tallies")
    counts = packs.groupBy("range").cogroup(wanted.groupBy("range")).applyInPandas(_told, "context long, ends long, pauses long, goes_on long").where("ends + pauses + goes_on > 0")
    told = asked.join(counts, "context", "left").groupBy("key", "words", "small").pivot("k", [0, 1, 2, 3]).agg(F.max("ends").alias("e"), F.max("pauses").alias("p"), F.max("goes_on").alias("g"))

    def total(k):
        return sum((F.coalesce(F.col(f"{k}_{x}"), F.lit(0)) for x in "epg"), F.lit(0))

    def goes_on(k):
        return F.col(f"{k}_g") > F.col(f"{k}_e") + F.col(f"{k}_p")

    verdict = F.when((total(3) == 0) | (total(2) == 0) & (total(1) >= 8) & (F.col("small") == 1), True)
    for k in range(ORDERS):
        verdict = verdict.when(total(k) >= (2 if k == 0 else 3), goes_on(k))
    # So few words tell little, so three of them must be known to go on.
    stub = (F.col("words") >= 3) & (total(0) >= 3) & (F.col("0_g") > 3 * (F.col("0_e") + F.col("0_p")))
    judged = told.withColumn("cut", F.when(F.col("words") < least, stub).otherwise(verdict.otherwise(True)))
    return judged.join(at_limit.withColumn("limit", F.lit(True)), "key", "left").where("cut or limit").select("key").distinct()


def cut_platform(value: Column) -> Column:
    """Whether a value is an incomplete beginning, of three letters or more, of a platform's name."""
    low = F.lower(F.trim(F.regexp_replace(value, r"[\s…]+|\.+$", "")))
    return F.coalesce((F.char_length(low) >= 3) & ~low.isin(*PLATFORMS) & low.isin(*{p[:k] for p in PLATFORMS for k in range(3, len(p))}), F.lit(False))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = table(spark, sf_dir, "raw_posts")
    texts = find_cut_texts(posts, "id", "posts").select(F.col("key").alias("id"), F.lit("posts").alias("field"))
    return texts.union(posts.where(cut_platform(F.col("social"))).select("id", F.lit("social"))).distinct()


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each platform, its posts, the cut ones and their share."""
    posts = table(spark, sf_dir, "raw_posts").select("id", "social")
    cut = find_cut_texts(table(spark, sf_dir, "raw_posts"), "id", "posts").select(F.col("key").alias("id"), F.lit(1).alias("cut"))
    low = F.lower(F.trim("social"))
    # A value that was cut itself still names its platform.
    name = F.coalesce(*[F.when((F.char_length(low) >= 3) & F.lit(p).startswith(low), p) for p in PLATFORMS], F.lit("other"))
    return posts.join(cut, "id", "left").groupBy(name.alias("platform")).agg(F.count("*").alias("posts"), F.count("cut").alias("cut")).withColumn("share", F.col("cut") / F.col("posts"))


QUERIES = {"p2_found": p2_found, "p2_rates": p2_rates}
ORACLE: dict[str, str] = {}
