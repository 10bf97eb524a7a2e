"""Problem 4: personal information in free text.

A learned model, a bidirectional LSTM with CRF transitions over words (``reader``), reads every word of every text and tags it; nothing is chosen before.
It is trained by ``train_reader`` on text made for it. A last check rejects what contradicts a kind (a phone number without digits,
a name with digits or function words) and names that are brands.
"""

from __future__ import annotations

import io
import pkgutil
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.boilerplate import SPEAKER, STOP
from postmill.llm.canon import canonicalise
from postmill.llm.common import if_small, materialise, strings, table
from postmill.llm.reader import spans
from postmill.llm.tagger import KINDS

PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}

# Particles and titles in names.
PARTICLES = frozenset("de di da do dos das del della van von der den la le du al bin el dr mr mrs ms san".split())
# Public formats of personal numbers that no telephone number has (9 a digit, A a letter), and of telephone numbers that no personal number has.
PERSONAL = "999-99-9999|999 99 9999|99 999 999 999|99/999/99999|99 999999 A 999|9 99 99 99 999 999 99|9 99 99 99 999 999|999.999.999-99|99.999.999-9|99/99999999/99"
TELEPHONE = "9.999.999.9999|9-999-999-9999|999-999-9999|999.999.9999|999-9999|999 9999|9999 9999|9999999999"
# Formats of parcel, order and card numbers.
PARCEL = "9999-9999-999|9999 9999 9999 9999|999-9999999-9999999"
# Formats of parcel numbers and of personal numbers (twelve digits: Aadhaar), so only what stands around tells; no telephone number.
TWELVE = "9999 9999 9999|999999999999"
# The dot of a domain, as it is or spelled out.
DOT = re.compile(r"\w\s*\.\s*\w|\b(?:dot|punkt|punto|point|ponto)\b", re.I)
SPANS = "array<struct<kind:string,start:bigint,stop:bigint,value:string>>"


@lru_cache(maxsize=1)
def weights() -> dict[str, np.ndarray]:
    # The package may be a zip file on executors.
    with np.load(io.BytesIO(pkgutil.get_data("postmill.llm", "tagger_weights.npz"))) as f:
        return {k: f[k] if f[k].dtype.kind == "U" else f[k].astype(np.float32) for k in f.files}


@lru_cache(maxsize=1)
def model(path: str | None = None) -> tuple[dict[str, np.ndarray], dict[str, list[str]]]:
    """The weights of the reader and the names of its traits."""
    with np.load(path or io.BytesIO(pkgutil.get_data("postmill.llm", "reader_weights.npz"))) as f:
        names = {k.removeprefix("names_"): str(f[k]).split("\n") for k in f.files if k.startswith("names_")}
        return {k: f[k].astype(np.float32) for k in f.files if not k.startswith("names_")}, names


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """A span without the marks at its ends; a bracket of which the other half is inside stays, as do a plus sign and a number sign."""
    while a < b and not (text[a].isalnum() or text[a] in "+#" or (text[a] in PAIRS and PAIRS[text[a]] in text[a + 1 : b])):
        a += 1
    while a < b and not (text[b - 1].isalnum() or any(text[b - 1] == close and text[a : b - 1].count(start) >= text[a:b].count(close) for start, close in PAIRS.items())):
        b -= 1
    return a, b


def settled(kind: str, span: str) -> str | None:
    """The kind of a span that was found as ``kind``, None if what it holds contradicts any: a number in a public format of the other kind of numbers is of that kind."""
    if kind in ("phone", "id_number"):
        form = re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "9", span.strip(" ().:#")))
        if form in PARCEL.split("|") or (kind == "phone" and form in TWELVE.split("|")):
            return None
        kind = "id_number" if form in PERSONAL.split("|") else "phone" if form in TELEPHONE.split("|") or "+" in span else kind
        if kind == "phone" and "A" in form:
            kind = "id_number"
    return kind if valid(kind, span) else None


def valid(kind: str, span: str) -> bool:
    """Whether nothing in a span contradicts its kind."""
    digits, letters = sum(c.isdigit() for c in span), sum(c.isalpha() for c in span)
    words = re.findall(r"[^\W_]+(?:['’][^\W_]+)*", span)
    if "\n" in span:
        return False
    if kind == "email":
        return len(words) >= 2 and letters >= 4 and ("@" in span or DOT.search(span) is not None)
    if kind == "phone":
        return 6 <= digits <= 16 and letters <= 1
    if kind == "id_number":
        return 5 <= digits <= 18 and digits + letters >= 7
    if kind == "address":
        return digits >= 1 and letters >= 4
    plain = [w for w in words if w.lower() not in PARTICLES]
    return not digits and sum(len(w) > 1 for w in plain) >= 2 and not any(len(w) > 1 and (w.lower() in STOP or w in SPEAKER) for w in plain)


def read(texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """The spans (kind, start, end) of each text."""
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for i, k, a, b in spans(pa.array(texts, pa.large_string()), *model()):
        a, b = trimmed(texts[i], a, b)
        if a < b and (kind := settled(KINDS[k], texts[i][a:b])):
            found[i].append((kind, a, b))
    return found


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map task: the canonical text of each row and its spans."""
    for batch in batches:
        texts = strings(batch["canonical"]).to_pylist()
        spans = [[{"kind": k, "start": a, "stop": b, "value": t[a:b]} for k, a, b in each] for t, each in zip(texts, read(texts))]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("value", pa.string())]))
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names), pa.array(spans, kind)], [*batch.schema.names, "spans"])


def _tagged(df: DataFrame, key: str, col: str, stored: bool) -> DataFrame:
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(col).alias("text"))
    rows = canonicalise(rows, "text") if stored else canonicalise(rows.where("key is not null and text is not null"), "text").drop("text")
    return rows.mapInArrow(_spans, f"key long, {'text string, ' if stored else ''}canonical string, spans {SPANS}")


def _no_brands(spans: DataFrame, brands: DataFrame | None, col: str) -> DataFrame:
    """The spans, one a row, without names and addresses that are brands; a long list of brands is joined by a shuffle."""
    if brands is None:
        return spans
    names = brands.select(F.lower(F.trim(col)).alias("_name")).where("_name is not null").distinct()
    same = F.col("kind").isin("name", "address") & (F.lower(F.trim("value")) == F.col("_name"))
    return spans.join(if_small(names, F.length("_name") + 16), same, "left_anti")


def find_personal(df: DataFrame, key: str, col: str, brands: DataFrame | None = None, brand_col: str = "brand") -> DataFrame:
    """(key, kind, start, stop, value): the personal information of each text, in positions of its canonical form.

    NULL, empty and blank texts have none. Texts are read whole, of any length. Rows that share a key are read one by one; an empty table gives
    an empty result.
    """
    each = _tagged(df, key, col, False).select("key", F.explode("spans").alias("x")).select("key", "x.*")
    return _no_brands(each, brands, brand_col)


def masked(stored: str, canonical: str, spans: list[tuple[str, int, int]]) -> str:
    """The stored text with placeholders for spans of its canonical form.

    The words between blanks of both forms face each other, so only words with personal information change; if their numbers differ, the canonical form is masked instead.
    """
    words = [m.span() for m in re.finditer(r"[^\s⠀ㅤ]+", stored)]
    forms = [m.span() for m in re.finditer(r"[^ \n]+", canonical)]
    text = stored if len(words) == len(forms) else canonical
    for kind, a, b in sorted(spans, key=lambda s: -s[1]):
        if text is canonical or len(words) != len(forms):
            text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
            continue
        i = next(i for i, (_, e) in enumerate(forms) if e > a)
        j = next(j for j in range(len(forms) - 1, -1, -1) if forms[j][0] < b)
        # Marks around the span in its first and last word stay.
        start = min(words[i][1], words[i][0] + max(0, a - forms[i][0]))
        stop = max(words[j][0], words[j][1] - max(0, forms[j][1] - b))
        text = f"{text[:start]}[{kind.upper()}]{text[max(start, stop):]}"
    return text


def mask_personal(df: DataFrame, key: str, col: str, brands: DataFrame | None = None, brand_col: str = "brand") -> DataFrame:
    """(key, text): each text as it is stored, with a typed placeholder for each piece of personal information; NULL stays NULL."""
    rows = materialise(_tagged(df, key, col, True).withColumn("_row", F.monotonically_increasing_id()))
    spans = _no_brands(rows.select("_row", F.explode("spans").alias("x")).select("_row", "x.*"), brands, brand_col)
    kept = spans.groupBy("_row").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("kept"))

    @F.pandas_udf("string")
    def replace(texts, forms, lists):
        return type(texts)([t if s is None or t is None else masked(t, c, [(x["kind"], x["start"], x["stop"]) for x in s]) for t, c, s in zip(texts, forms, lists)], dtype=object)

    return rows.drop("spans").join(kept, "_row", "left").select("key", replace("text", "canonical", "kept").alias("text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(table(spark, sf_dir, "raw_posts"), "id", "posts", table(spark, sf_dir, "brands")).select(F.col("key").alias("id"), "kind").distinct()


def p4_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post with placeholders."""
    return mask_personal(table(spark, sf_dir, "raw_posts"), "id", "posts", table(spark, sf_dir, "brands")).withColumnsRenamed({"key": "id", "text": "posts"})


QUERIES = {"p4_found": p4_found, "p4_masked": p4_masked}
ORACLE: dict[str, str] = {}
