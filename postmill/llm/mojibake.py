"""Problem 10: text read with the wrong encoding.

Tokens with characters beyond ASCII have a window: what is left of them and of their neighbours without those characters.
A garbled token meets its clean near-twins there: the tokens of its window that it could be a wrong reading of. Aligning the two on their ASCII characters gives pairs of runs; the pairs
tell which wrong readings (written as A, read as B, once or twice) occur in this corpus, and how often. The learned readings are
then undone in every token: at once where bytes of UTF-8 come to light, which clean text does not imitate, and by comparison
with the corpus' own words where one letter stands for another. Each distinct text counts once, however often it is copied; a word that
the comparison leaves open is decided by the other words of its document that the same reading restores.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import materialise, table

# Encodings that text is written in and read with.
WRITTEN = ("utf-8", "cp1252", "mac_roman", "cp437", "cp850")
READ = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "iso8859-15", "iso8859-2", "koi8-r", "cp1253", "cp1254", "utf-8")

TOKEN = re.compile(r"[^\s\x80-\U0010ffff]*[\x80-\U0010ffff]\S*", re.ASCII)
RUN = re.compile(r"[^\x00-\x7f]+")
PLACE = re.compile(r"\S+", re.ASCII)
EDGE = "\"'().,;:!?*-[]{}<>#"
LOST = "\ufffd"
#: Signs of a wrong reading by themselves: lost characters, C1 controls, private use.
BROKEN = re.compile("[\ufffd\x80-\x84\x86-\x9f\ue000-\uf8ff]")
# Letters beyond ASCII of the six languages, and signs that may stand inside a word.
LETTERS = frozenset("àáâãäåæçèéêëìíîïñòóôõöœùúûüýÿßªº")
USUAL = frozenset("'’‘‚“”„«»‹›–—…·¡¿€°")
EMOJI_PARTS = frozenset("\ufe0e\ufe0f\u20e3")
INSIDE = frozenset("'’‘-‐‑–—·…/&\u00ad")


@lru_cache(maxsize=None)
def _byte_table(encoding: str) -> tuple[dict[str, int], dict[int, str]]:
    """A single-byte encoding both ways; bytes it leaves undefined stand for the control character of their number."""
    to_char = {}
    for b in range(128, 256):
        try:
            to_char[b] = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            to_char[b] = chr(b)
    return {c: b for b, c in reversed(list(to_char.items()))}, to_char


def misread(text: str, written: str, read: str) -> str | None:
    """What ``text`` becomes if it is written in one encoding and read with the other."""
    try:
        raw = text.encode("utf-8") if written == "utf-8" else bytes(ord(c) if ord(c) < 128 else _byte_table(written)[0][c] for c in text)
        if read == "utf-8":
            return raw.decode("utf-8", "replace")
        return "".join(chr(b) if b < 128 else _byte_table(read)[1][b] for b in raw)
    except (KeyError, UnicodeEncodeError):
        return None


def undo(text: str, written: str, read: str) -> str | None:
    """What was written, if it was read wrongly as ``text``; None if no text gives that."""
    if read == "utf-8":
        return None
    try:
        raw = bytes(ord(c) if ord(c) < 128 else _byte_table(read)[0][c] for c in text)
        if written == "utf-8":
            return raw.decode("utf-8")
        return "".join(chr(b) if b < 128 else _byte_table(written)[1][b] for b in raw)
    except (KeyError, UnicodeDecodeError):
        return None


def readings() -> list[tuple[str, str, int]]:
    """(written, read, times) of every wrong reading that is considered."""
    return [(w, r, k) for w in WRITTEN for r in READ if w != r for k in ((1, 2) if w == "utf-8" and r != "utf-8" else (1,))]


def _apply(f, text: str | None, written: str, read: str, times: int) -> str | None:
    for _ in range(times):
        text = text if text is None else f(text, written, read)
    return text


def bare(token: str) -> str:
    """A token without characters beyond ASCII, with digits made equal."""
    return re.sub(r"\d+", "0", RUN.sub("", token)).lower()


def _core(token: str) -> str:
    return re.sub(r"\d+", "0", token.strip(EDGE))


def oddness(token: str) -> tuple[int, int]:
    """Signs of a wrong reading in one token: (capitals after small letters and signs between letters, these and letters of other languages)."""
    shape = sum(
        b > "\x7f" and (a.islower() and b.isupper() or a.isalpha() and c.isalpha() and not b.isalpha() and not unicodedata.combining(b) and b not in INSIDE)
        for a, b, c in zip(token, token[1:], token[2:] + " ")
    )
    return shape, shape + sum(c > "\x7f" and c.isalpha() and c.lower() not in LETTERS for c in token)


def align(a: str, b: str) -> list[tuple[str, str]] | None:
    """Runs beyond ASCII of two tokens that face each other between equal ASCII characters."""
    pa_, pb = RUN.split(a), RUN.split(b)
    if "".join(pa_).lower() != "".join(pb).lower():
        return None
    if [x.lower() for x in pa_] == [x.lower() for x in pb]:
        return [(x, y) for x, y in zip(RUN.findall(a), RUN.findall(b)) if x != y]
    return None


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map task: each (document, hash of its text, token beyond ASCII, window) once."""
    import xxhash

    for batch in batches:
        seen: dict[tuple, None] = {}
        for doc, text in zip(batch["doc"].to_pylist(), batch["text"].to_pylist()):
            if text.isascii():
                continue
            h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63
            every = PLACE.findall(text)
            plain = [bare(x).strip(EDGE) for x in every]
            # The nearest neighbour with anything in ASCII, on either side.
            after, left = [""] * len(every), ""
            for i in range(len(every) - 1, 0, -1):
                left = plain[i] or left
                after[i - 1] = left
            before = ""
            for whole, own, right in zip(every, plain, after):
                if not whole.isascii() and not (token := _core(whole)).isascii():
                    seen[doc, h, token, f"{before} {bare(token)} {right}"] = None
                before = own or before
        cols = list(zip(*seen)) if seen else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc", "h", "token", "window"])


def _undone(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Map task: what each token would be if one of the wrong readings were undone in all its runs beyond ASCII."""
    for part in rows:
        out = []
        for token in part["token"]:
            runs = set(RUN.findall(token))
            for w, r, k in readings():
                to = {x: _apply(undo, x, w, r, k) for x in runs}
                if r != "utf-8" and any(v is not None and v != x for x, v in to.items()):
                    new = RUN.sub(lambda m: m.group() if to[m.group()] is None else to[m.group()], token)
                    if not BROKEN.search(new):
                        out.append((token, new, w, r, k))
        yield pd.DataFrame(out, columns=["a", "b", "written", "read", "times"])


def _explained(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Map task: the pairs of runs that face each other in a token and its near-twin and that the wrong reading explains."""
    for part in rows:
        out = []
        for a, b, w, r, k, n in part[["a", "b", "written", "read", "times", "n"]].itertuples(index=False):
            out += [(w, r, k, odd, clean, n) for odd, clean in set(align(a, b) or ()) if _apply(misread, clean, w, r, k) == odd]
        yield pd.DataFrame(out, columns=["written", "read", "times", "odd", "clean", "n"])


def restorations(learned: list[tuple[str, str, int]], known: frozenset[str]):
    """A function that gives the certain and the possible originals of a token under the learned wrong readings, with the reading.

    ``known`` has the characters of the corpus: a possible original with a character that occurs nowhere is none. A certain one may hold
    a new one, since a letter or emoji can be garbled wherever it occurs, unless the token has only usual characters or would mix scripts.
    """
    strict = sorted((x for x in learned if x[0] == "utf-8"), key=lambda x: -x[2])
    loose = [x for x in learned if x[0] != "utf-8"]

    def sound(token: str, new: str) -> bool:
        if fits(new) or BROKEN.search(new):
            return not BROKEN.search(new)
        # A quotation mark before an accented letter can look like bytes of UTF-8; what they give is no part of a word in Latin letters.
        strange = {c: unicodedata.category(c) for c in new if c > "\x7f" and c not in known}
        usual = all(c.lower() in LETTERS or c in USUAL for x in RUN.findall(token) for c in x)
        mixed = any(v[0] in "LM" and not unicodedata.name(c, "").startswith("LATIN") and c not in EMOJI_PARTS for c, v in strange.items()) and re.search("[A-Za-z]", new)
        return not usual and not mixed and not any(v in ("Cn", "Cc", "Cs", "Co") for v in strange.values())

    def fits(new: str) -> bool:
        return not BROKEN.search(new) and all(c < "\x80" or c in known for c in new)

    def restore(token: str) -> tuple[tuple[str, str] | None, list[tuple[str, str]]]:
        """((original, reading), possible ones): the first only if bytes of UTF-8 came to light."""
        runs = RUN.findall(token)
        for w, r, k in strict:
            new = RUN.sub(lambda m: v if (v := _apply(undo, m.group(), w, r, k)) is not None and v != m.group() else m.group(), token)
            if new != token and len(new) < len(token) and sound(token, new):
                return (new, f"{w} {r} {k}"), []
        # Part of a run may be clean, such as a quotation mark before the first garbled letter.
        for w, r, k in strict:
            if any(len(x) > 2 for x in runs):
                new = RUN.sub(lambda m: _inside(m.group(), w, r, k), token)
                if new != token and sound(token, new):
                    return (new, f"{w} {r} {k}"), []
        maybe = []
        for w, r, k in strict:
            if k == 1 and (last := _byte_table(r)[1][0xC3]) and token.endswith(last):
                maybe.append((token[: -len(last)] + "à", f"{w} {r} {k}"))  # the second byte was a no-break space, since lost as white space
        for w, r, k in loose:
            new = RUN.sub(lambda m: v if (v := undo(m.group(), w, r)) is not None else m.group(), token)
            if new != token and fits(new):
                maybe.append((new, f"{w} {r} {k}"))
        return None, maybe

    return restore


def _inside(run: str, written: str, read: str, times: int) -> str:
    """A run with its longest garbled parts undone."""
    out, i = [], 0
    while i < len(run):
        for j in range(min(len(run), i + 12), i + 1, -1):
            v = _apply(undo, run[i:j], written, read, times)
            if v is not None and v != run[i:j] and len(v) < j - i:
                out.append(v)
                i = j
                break
        else:
            out.append(run[i])
            i += 1
    return "".join(out)


def learn(windows: DataFrame, least_pairs: int = 2, least_support: int = 3) -> list[tuple[str, str, int]]:
    """The wrong readings that near-twins show, from rows (window, token, n).

    A reading counts if it explains at least ``least_pairs`` different pairs of runs in ``least_support`` windows; where bytes of UTF-8
    explain a pair, which does not happen by chance, one is enough. The result has at
    most one row for each reading in ``readings()``, whatever the corpus' size.
    """
    tokens = windows.select("token").distinct()
    # A token meets the tokens of its window that it could be a wrong reading of, not all of them: a window may hold every word of a language in another script.
    undone = materialise(tokens.repartition("token").mapInPandas(_undone, "a string, b string, written string, read string, times int"))
    twins = undone.join(tokens.select(F.col("token").alias("b")), "b", "left_semi")
    a, b = windows.select("window", F.col("token").alias("a")), windows.select("window", F.col("token").alias("b"))
    pairs = twins.join(a, "a").join(b, ["window", "b"]).groupBy("a", "b", "written", "read", "times").agg(F.count("*").alias("n"))
    shown = pairs.mapInPandas(_explained, "written string, read string, times int, odd string, clean string, n long")
    support = shown.groupBy("written", "read", "times").agg(F.count_distinct("odd").alias("pairs"), F.sum("n").alias("n"))
    return [(r[0], r[1], r[2]) for r in support.where((F.col("written") == "utf-8") | (F.col("pairs") >= least_pairs) & (F.col("n") >= least_support)).collect()]


def garbled_tokens(held: DataFrame, windows: DataFrame, learned: list[tuple[str, str, int]]) -> DataFrame:
    """(token, window, h, original): tokens that were read wrongly, everywhere, in one window or in one text; a NULL original can't be restored.

    ``held`` has each token of each distinct text (h), ``windows`` the number of distinct texts of each token in each window. A token with a
    possible original counts if the original is in at least three times as many texts in the same window, or, with three letters of
    ASCII or more, in the corpus; or by its shape, if the corpus has the original in three texts. Otherwise its text decides: another of its
    tokens must be restored by the same reading, and the token must lose signs of a wrong reading, or have its original in the corpus and
    stand mostly in such texts.
    """

    # At most one row for each character of Unicode.
    letters = windows.select(F.explode(F.array_distinct(F.split("token", ""))).alias("c")).distinct()
    known = frozenset(r[0] for r in letters.collect())

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restore = restorations(learned, known)
        for part in parts:
            out = []
            for token in part["token"]:
                sure, maybe = restore(token)
                if sure is not None or LOST in token or BROKEN.search(token):
                    out.append((token, *(sure or (None, None)), True, 0, 0))
                shape, odd = oddness(token)
                for new, reading in dict.fromkeys(maybe) if sure is None else ():
                    new_shape, new_odd = oddness(new)
                    out.append((token, new, reading, False, shape - new_shape, odd - new_odd))
            yield pd.DataFrame(out, columns=["token", "original", "reading", "sure", "shape", "odd"])

    counts = materialise(held.groupBy("token").agg(F.count("*").alias("n")))
    judged = materialise(counts.select("token").mapInPandas(judge, "token string, original string, reading string, sure boolean, shape int, odd int"))
    often = counts.select(F.col("token").alias("original"), F.col("n").alias("m"))
    wordy = F.length(F.regexp_replace("token", r"[^a-zA-Z]", "")) >= 3
    rated = judged.where("not sure").join(often, "original", "left").fillna(0, ["m"]).where("m > 0 or odd > 0").join(counts, "token")
    maybe = materialise(rated.withColumn("alone", wordy & F.expr("m >= 3 and (m >= 3 * n or shape > 0)")).withColumn("support", F.col("alone") | wordy & F.expr("m >= 1 and odd > 0")))
    here = windows.select("window", F.col("token").alias("original"), F.col("n").alias("m"))
    by_window = judged.where("not sure").select("token", "original").distinct().join(windows, "token").join(here, ["window", "original"]).where("m >= 3 * n and m >= 3")
    # The evidence of a text for a reading: how many of its tokens the reading restores by themselves.
    signs = judged.where("sure and reading is not null").select("token", "reading").union(maybe.where("support").select("token", "reading")).distinct()
    evidence = materialise(held.join(signs, "token").groupBy("h", "reading").agg(F.count("*").alias("signs")))
    asked = maybe.where("not alone and odd >= 0").select("token", "original", "reading", "m", "n", "odd", F.col("support").cast("int").alias("own"))
    evident = materialise(held.join(asked, "token").join(evidence, ["h", "reading"]).where("signs - own >= 1"))
    mostly = evident.groupBy("token", "reading").agg(F.count_distinct("h").alias("texts"))
    by_text = evident.join(mostly, ["token", "reading"]).where("odd > 0 or m > 0 and 2 * texts >= n and signs - own >= 2")
    nowhere, no_text = F.lit(None).cast("string").alias("window"), F.lit(None).cast("long").alias("h")
    parts = [
        judged.where("sure").select("token", nowhere, no_text, "original"),
        maybe.where("alone").select("token", nowhere, no_text, "original"),
        by_window.select("token", "window", no_text, "original"),
        by_text.select("token", nowhere, "h", "original"),
    ]
    return functools.reduce(DataFrame.unionByName, parts).distinct()


def find_garbled(df: DataFrame, key: str, col: str) -> DataFrame:
    """(doc, token, original) for each garbled token of each document; ``original`` is NULL where it is lost.

    NULL, empty and ASCII texts have none. Rows that share a key count as one document. An empty table gives an empty result. Texts
    of any length are read whole; other columns are ignored.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(col).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(col).alias("text"))
    tokens = materialise(rows.mapInArrow(_tokens, "doc long, h long, token string, window string"))
    windows = materialise(tokens.select("window", "token", "h").distinct().groupBy("window", "token").agg(F.count("*").alias("n")))
    held = materialise(tokens.select("h", "token").distinct())
    bad = materialise(garbled_tokens(held, windows, learn(windows)))
    anywhere = tokens.join(bad.where("window is null and h is null").select("token", "original"), "token").select("doc", "token", "original")
    there = tokens.join(bad.where("window is not null").drop("h"), ["token", "window"]).select("doc", "token", "original")
    within = tokens.join(bad.where("h is not null").drop("window"), ["h", "token"]).select("doc", "token", "original")
    return anywhere.union(there).union(within).distinct()


def restored_texts(df: DataFrame, key: str, col: str) -> DataFrame:
    """Documents with garbled tokens: (doc, restored text, tokens restored, tokens lost)."""
    found = find_garbled(df, key, col)
    one = found.groupBy("doc", "token").agg(F.min("original").alias("original"))
    fixes = one.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("token", F.coalesce("original", "token").alias("to")))).alias("fix"), F.count("original").alias("restored"), F.sum(F.col("original").isNull().cast("long")).alias("lost"))

    @F.pandas_udf("string")
    def repair(texts: pd.Series, fix: pd.Series) -> pd.Series:
        def one(text, to):
            to = dict(to)

            def token(m):
                whole = m.group()
                core = whole.strip(EDGE)
                masked = _core(whole)
                if masked not in to or to[masked] == masked:
                    return whole
                new, digits = to[masked], re.findall(r"\d+", core)
                new = re.sub(r"0", lambda _: digits.pop(0) if digits else "0", new)
                return whole.replace(core, new, 1)

            return TOKEN.sub(token, text)

        return pd.Series([one(t, f) for t, f in zip(texts, fix)])

    rows = df.where(F.col(col).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(col).alias("text"))
    return rows.join(fixes, "doc").select("doc", repair("text", "fix").alias("restored_text"), "restored", "lost")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_garbled(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("doc").alias("doc_id")).distinct()


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restored_texts(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("doc", "doc_id")


QUERIES = {"p10_found": p10_found, "p10_restored": p10_restored}
ORACLE: dict[str, str] = {}
