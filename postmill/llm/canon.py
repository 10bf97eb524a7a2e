"""Problem 1: one form for text that looks the same.

Texts with characters outside the plain set are exploded to positioned code points, joined with a broadcast
table of decompositions and look-alike letters, put together again, split into clusters of a base and its
combining marks, and each cluster is recomposed by a second broadcast join. Both tables depend on Unicode only
(about 13,000 and 1,000 rows), so their size does not grow with the data.
"""

from __future__ import annotations

import functools
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import table

# Cyrillic, Greek and other letters with the Latin letter they look like.
LOOK_ALIKE = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s",
    "ԝ": "w", "х": "x", "у": "y", "ү": "y", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K",
    "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ӏ": "I",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j", "Α": "A",
    "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y",
    "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʋ": "v", "օ": "o", "ս": "u", "հ": "h", "ո": "n",
    "ց": "g", "զ": "q", "Ս": "U", "Օ": "O", "Տ": "S", "Լ": "L", "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E",
    "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y", "Ꮐ": "G", "Ꮓ": "Z", "Ꮥ": "S", "Ꮪ": "S", "Ꮩ": "V", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S",
    "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U", "‐": "-", "‑": "-", "‒": "-", "−": "-", "﹣": "-",
}

# Kinds of compatibility decomposition that change width, weight or joining only.
SAME_LOOK = ("<font>", "<wide>", "<narrow>", "<compat>", "<noBreak>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>")

#: A joiner between emoji, held by a private character while the other joiners and variation selectors are taken out.
JOINED = r"([\p{So}\p{Sk}]\x{FE0F}?)\x{200D}(?=\p{So})"
HELD = ""
INVISIBLE = r"[\x{FE0E}\x{FE0F}\x{200D}]"
LINE_BREAKS = "\r\v\f\x85  "
ZWJ = 0x200D


@lru_cache(maxsize=4096)
def _parts(ch: str) -> str:
    """The full decomposition of a character with look-alikes replaced; empty for what has no width."""
    if ch in LINE_BREAKS:
        return "\n"
    if ch == "\t" or unicodedata.category(ch) == "Zs" or ch in "⠀ㅤ":
        return " "
    cp = ord(ch)
    if unicodedata.category(ch) == "Cf" and cp != ZWJ or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x34F, 0x180B, 0x180C, 0x180D, 0x115F, 0x1160):
        return ""
    if unicodedata.category(ch) == "Cc" and ch != "\n":
        return ""
    if ch in LOOK_ALIKE:
        return LOOK_ALIKE[ch]
    kind, *codes = unicodedata.decomposition(ch).split() or [""]
    if not kind:
        return ch
    if kind.startswith("<"):
        if kind not in SAME_LOOK:
            return ch
    else:
        codes = [kind, *codes]
    out = "".join(_parts(chr(int(x, 16))) if chr(int(x, 16)) != ch else ch for x in codes)
    # Spacing accents decompose to a blank with a mark; they stay as they are.
    return ch if out.startswith(" ") and len(out) > 1 else out


@lru_cache(maxsize=1)
def fold_rows() -> tuple[tuple[str, str], ...]:
    """(character, what it becomes) for every character that changes."""
    out = []
    for cp in range(0x110000):
        if 0xD800 <= cp < 0xE000 or 0xAC00 <= cp < 0xD7A4 or 0x20000 <= cp < 0x2F800 or 0xE0200 <= cp:
            continue
        ch = chr(cp)
        if ch != "\n" and not 32 < cp < 127 and (d := _parts(ch)) != ch:
            out.append((ch, d))
    return tuple(out)


@lru_cache(maxsize=1)
def compose_rows() -> tuple[tuple[str, str], ...]:
    """(base with its marks in canonical order, the composed character)."""
    out = {}
    for cp in range(0xC0, 0x30000):
        ch = chr(cp)
        d = unicodedata.normalize("NFD", ch)
        if 0xAC00 <= cp < 0xD7A4 or len(d) < 2 or unicodedata.normalize("NFC", ch) != ch:
            continue
        if all(unicodedata.combining(c) for c in d[1:]) and _parts(d[0]) == d[0]:
            out[d] = ch
    return tuple(out.items())


@lru_cache(maxsize=1)
def mark_classes() -> tuple[str, str]:
    """All marks, and for each a character that sorts as its combining class does."""
    marks = [chr(cp) for cp in range(0x300, 0xE0200) if not 0x3400 <= cp < 0xA000 and not 0xAC00 <= cp < 0xE000 and unicodedata.category(chr(cp))[0] == "M"]
    return "".join(marks), "".join(chr(0x100 + unicodedata.combining(c)) for c in marks)


#: Hangul letters that join: a leading consonant and a vowel, perhaps with a final consonant; or a syllable and a final consonant.
JAMO = r"[\x{1100}-\x{1112}][\x{1161}-\x{1175}][\x{11A8}-\x{11C2}]?|[\x{AC00}-\x{D7A3}][\x{11A8}-\x{11C2}]"


def syllable(jamo: Column) -> Column:
    """The one character of a sequence that matches ``JAMO``, by Unicode's arithmetic."""

    def code(at: int) -> Column:
        return F.ascii(F.substring(jamo, at, 1))

    joined = F.when(code(1) >= 0xAC00, code(1)).otherwise(0xAC00 + ((code(1) - 0x1100) * 21 + code(2) - 0x1161) * 28)
    final = F.ascii(F.substring(jamo, -1, 1)) - 0x11A7
    cp = joined + F.when((final > 0) & (final < 28) & ((code(1) < 0xAC00) | ((code(1) - 0xAC00) % 28 == 0)), final).otherwise(0)
    # As three bytes of UTF-8.
    raw = (F.shiftright(cp, 12) + 0xE0) * 0x10000 + (F.shiftright(cp, 6).bitwiseAND(0x3F) + 0x80) * 0x100 + cp.bitwiseAND(0x3F) + 0x80
    return F.unhex(F.hex(raw)).cast("string")


@lru_cache(maxsize=1)
def plain_class() -> str:
    """A regular expression class of the common characters that are their own final form.

    It has few ranges, as each costs time for every character; texts with other characters only take the longer way.
    """
    composed = {v: k for k, v in compose_rows()}
    spans: list[list[int]] = []
    for lo, hi in ((0x20, 0x7E), (0xA1, 0xFF), (0x2013, 0x2027), (0x20A0, 0x20BF), (0x2600, 0x27BF), (0x1F300, 0x1FAFF)):
        for cp in range(lo, hi + 1):
            d = _parts(chr(cp))
            if d == chr(cp) and not unicodedata.combining(chr(cp)) or composed.get(chr(cp)) == d:
                if spans and spans[-1][1] == cp - 1:
                    spans[-1][1] = cp
                else:
                    spans.append([cp, cp])
    return r"\n\x{200D}" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in spans if b - a > 4)


def tidy(text: Column) -> Column:
    """One blank for any run of blanks and tabs, none at the ends of a line."""
    odd = [F.contains(text, F.lit(x)) for x in ("\t", "\r", "  ", " \n", "\n ")] + [text.startswith(" "), text.endswith(" ")]
    odd = functools.reduce(Column.__or__, odd)
    one = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]+", " ")
    return F.when(odd, F.trim(F.regexp_replace(one, r" ?\n ?", "\n"))).otherwise(text)


def _rebuilt(pieces: DataFrame, key: str, rest: str) -> DataFrame:
    """The pieces of each key in the order of their positions as one text, beside the columns kept in ``rest``."""
    pieces = pieces.groupBy(key).agg(F.collect_list(F.struct("_at", "_piece")).alias("_all"), F.max(rest).alias(rest))
    return pieces.select(key, rest, F.array_join(F.transform(F.array_sort("_all"), lambda x: x["_piece"]), "").alias("_text"))


def canonicalise(df: DataFrame, col: str, out: str = "canonical") -> DataFrame:
    """Add ``out``: the text of ``col`` in one form in which texts that look the same are equal.

    Width, weight and script of origin of letters, the split of accents, invisible characters and the kind and
    amount of white space within a line vanish; case, accents, line breaks and emoji stay. NULL gives NULL; an
    empty or blank text gives an empty one. Texts of any length are processed whole. Input rows need no unique
    key; every input column is kept, and ``out`` replaces a column of that name.
    """
    spark = df.sparkSession
    names = [c for c in df.columns if c != out]
    source = F.col(f"`{col}`")
    joined = functools.reduce(Column.__or__, [F.contains(source, F.lit(x)) for x in ("\u200d", "\ufe0e", "\ufe0f")])
    held = F.regexp_replace(source, JOINED, "$1" + HELD)
    clean = F.when(joined, F.translate(F.regexp_replace(held, INVISIBLE, ""), HELD, "\u200d")).otherwise(source)
    # Exploding a single value keeps Catalyst from evaluating the expression again wherever it is used.
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.explode(F.array(clean)).alias("_t"))
    other = ((F.octet_length("_t") > F.char_length("_t")) | F.col("_t").rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")) & F.col("_t").rlike(f"[^{plain_class()}\\t\\r]")
    easy = rows.where(F.coalesce(~other, F.lit(True))).select("_row", tidy(F.col("_t")).alias("_text"))

    # Positioned pieces: single code points, and runs of plain ones, which no later step changes, as one piece each.
    fold = F.broadcast(spark.createDataFrame(list(fold_rows()), "_ch string, _to string"))
    hard = rows.where(other).withColumn("_key", F.monotonically_increasing_id())
    points = F.regexp_extract_all(F.regexp_replace("_t", r"\r\n?", "\n"), F.lit(rf"(?s)(?:[{plain_class()}](?!\p{{M}}))+|."), F.lit(0))
    points = hard.select("_key", "_row", F.posexplode(points).alias("_at", "_ch"))
    points = points.select("_key", F.when(F.col("_at") == 0, F.col("_row")).alias("_row"), "_at", "_ch")
    points = points.join(fold, "_ch", "left").select("_key", "_row", "_at", F.coalesce("_to", "_ch").alias("_piece"))
    decomposed = _rebuilt(points, "_key", "_row")

    compose = F.broadcast(spark.createDataFrame(list(compose_rows()), "_ordered string, _to string"))
    marked = F.col("_text").rlike(r"[\p{M}\x{1100}-\x{11FF}]")
    pieces = F.regexp_extract_all("_text", F.lit(rf"(?s)\P{{M}}\p{{M}}+|{JAMO}|(?:(?!{JAMO})\P{{M}}(?!\p{{M}}))+|\p{{M}}+"), F.lit(0))
    clusters = F.when(marked, pieces).otherwise(F.array("_text"))
    clusters = decomposed.select("_key", "_row", F.posexplode(clusters).alias("_at", "_c"))
    # Marks of a class above 0 are ordered by class; one of class 0 stays where it is, and none moves across it.
    marks = F.transform(F.split(F.expr("substring(_c, 2)"), ""), lambda m, i: F.struct(i.alias("i"), F.translate(m, *mark_classes()).alias("k"), m.alias("m")))
    blocks = F.transform(marks, lambda x: F.struct(F.size(F.filter(marks, lambda y: (y["i"] <= x["i"]) & (y["k"] == "\u0100"))).alias("b"), x["k"].alias("k"), x["i"].alias("i"), x["m"].alias("m")))
    ordered = F.concat(F.substring("_c", 1, 1), F.array_join(F.transform(F.array_sort(blocks), lambda x: x["m"]), ""))
    formed = F.when(F.col("_c").rlike(r"^\P{M}\p{M}{2,}$"), ordered).when(F.col("_c").rlike(f"^(?:{JAMO})$"), syllable(F.col("_c"))).otherwise(F.col("_c"))
    clusters = clusters.withColumn("_ordered", formed)
    clusters = clusters.join(compose, "_ordered", "left").select("_key", F.when(F.col("_at") == 0, F.col("_row")).alias("_row"), "_at", F.coalesce("_to", "_ordered").alias("_piece"))
    done = _rebuilt(clusters, "_key", "_row").select("_row", tidy(F.col("_text")).alias("_text"))
    return easy.unionByName(done).select("_row.*", F.col("_text").alias(out))


def look_alike_pairs(df: DataFrame, key: str, col: str, block: int = 2000) -> DataFrame:
    """Pairs (id_a < id_b) of rows whose texts differ as stored but have one canonical form.

    NULL and blank texts have no pairs. Exact copies are never paired with each other. Members of a large class
    are spread over blocks of about ``block`` rows, and each pair of blocks is joined in its own group, so
    that no task gets a whole class.
    """
    rows = canonicalise(df.select(F.col(key).alias("id"), F.col(col).alias("_stored")), "_stored", "_canon").where(F.col("_canon") != "")
    rows = rows.select("id", F.xxhash64("_stored").alias("raw"), F.xxhash64("_canon").alias("k1"), F.xxhash64(F.reverse("_canon")).alias("k2"))
    classes = rows.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    classes = classes.where("lo <> hi").select("k1", "k2", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    members = rows.join(classes, ["k1", "k2"]).withColumn("b", F.expr("pmod(xxhash64(id), blocks)").cast("int"))
    left = members.select("k1", "k2", F.col("b").alias("ba"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("bb"), F.col("id").alias("id_a"), F.col("raw").alias("ra"))
    right = members.select("k1", "k2", F.explode(F.expr("sequence(0, blocks - 1)")).alias("ba"), F.col("b").alias("bb"), F.col("id").alias("id_b"), F.col("raw").alias("rb"))
    pairs = left.join(right, ["k1", "k2", "ba", "bb"]).where("id_a < id_b and ra <> rb")
    return pairs.select("id_a", "id_b")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike_pairs(table(spark, sf_dir, "raw_posts"), "id", "posts")


def p1_canonical_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post in its one form."""
    return canonicalise(table(spark, sf_dir, "raw_posts").select("id", "posts"), "posts").withColumn("changed", ~F.col("posts").eqNullSafe(F.col("canonical")))


QUERIES = {"p1_found": p1_found, "p1_canonical_posts": p1_canonical_posts}
