"""Problem 6: the languages of documents and of their parts.

Scripts come first: a word in Latin letters can be in any of the six languages, one with letters of another script only in ``other``. Each word then has a score in
each candidate, from counts of whole words and, for words not seen, of their letter triples; Viterbi's algorithm with a penalty for each switch, smaller
where a sentence starts, labels the words. Segments are the stretches of one label within a sentence, so a sentence that changes its language has several.

The counts are fitted on a documented, bounded sample of rows that have a usable label, counted in the executors; all rows are labelled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.boilerplate import canonical_lines, page_lines
from postmill.llm.common import table

LANGUAGES = ("en", "de", "es", "fr", "it", "pt")
# Names and three-letter codes of the six languages.
NAMES = {
    "en": ("eng", "english", "englisch", "inglés", "ingles", "anglais", "inglese", "inglês"),
    "de": ("deu", "ger", "german", "deutsch", "alemán", "aleman", "allemand", "tedesco", "alemão"),
    "es": ("spa", "spanish", "spanisch", "español", "espanol", "castellano", "espagnol", "spagnolo", "espanhol"),
    "fr": ("fra", "fre", "french", "französisch", "francés", "frances", "français", "francais", "francese", "francês"),
    "it": ("ita", "italian", "italienisch", "italiano", "italien"),
    "pt": ("por", "portuguese", "portugiesisch", "portugués", "portugues", "portugais", "portoghese", "português"),
}
# Labels that say nothing.
NO_LABEL = ("", "und", "unk", "unknown", "none", "null", "n/a", "na", "zxx", "mul", "xx", "??", "?", "-")

OTHER = "other"
STATES = (*LANGUAGES, OTHER)
SENTENCE_END = re.compile(r"[.!?…][\"”»')\]]*$")
ASIDE = re.compile(r"\(\s*[\"“'‘][^()]{0,80}\)|[\"“„«][^\"“”„«»]{0,60}[\"”»]|(?:https?://|www\.)\S+|\S*@\S+|#\w+|\bRT\b")
MAYBE_ASIDE = re.compile(r"[\"“„«@#]|://|www\.|\bRT\b|\([\"“'‘]")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
OTHER_SCRIPT = re.compile("[Ͱ-᳿Ⰰ-ⱟⴀ-ꜟꠀ-﫿]")


def label_language(label: Column) -> Column:
    """One of the six codes for a label in any usual spelling; ``other`` for another language, NULL for none."""
    low = F.lower(F.trim(label))
    out = F.when(label.isNull() | low.isin(*NO_LABEL) | ~low.rlike(r"^\p{L}"), F.lit(None).cast("string"))
    for code, names in NAMES.items():
        out = out.when(low.isin(*names) | low.rlike(rf"^{code}([-_ ].*)?$"), code)
    return out.otherwise("other")


class Model:
    """Log probabilities of words and letter triples by language."""

    def __init__(self, words: dict[str, list[int]], smooth: float = 0.5, clip: float = 6.0):
        counts = np.array(list(words.values()), float).reshape(-1, len(LANGUAGES))
        totals = counts.sum(0) + 1
        p = (counts + smooth) / (totals + smooth * len(counts))
        self.words = {w: row for w, row in zip(words, np.clip(np.log(p) - np.log(p).mean(1, keepdims=True), -clip, clip))}
        grams: dict[str, np.ndarray] = {}
        for w, row in zip(words, counts):
            for g in self._grams(w):
                grams[g] = grams.get(g, 0) + np.minimum(row, 20)
        size = np.maximum(sum(grams.values()) if grams else np.ones(len(LANGUAGES)), 1)
        self.grams = {g: np.log((v + 1) / size) - np.log((v + 1) / size).mean() for g, v in grams.items()}

    @staticmethod
    def _grams(word: str) -> list[str]:
        w = f"^{word}$"
        return [w[i : i + 3] for i in range(len(w) - 2)]

    def score(self, word: str) -> np.ndarray:
        """Evidence for each language; none for names and numbers it has never seen in an ordinary place."""
        low = word.lower()
        if OTHER_SCRIPT.search(low):
            return np.zeros(len(LANGUAGES))
        if (v := self.words.get(low)) is not None:
            return v
        found = [self.grams[g] for g in self._grams(low) if g in self.grams]
        if not found:
            return np.zeros(len(LANGUAGES))
        return np.clip(np.mean(found, 0), -2, 2) * (0.2 if word[0].isupper() else 0.7)


def fit(df: DataFrame, key: str, col: str, label: str, sample: int = 20_000, least: int = 2, most: int = 200_000) -> Model:
    """Fit on about ``sample`` labelled rows, an equal part of each language as far as there are enough, chosen by a hash of their key.

    Words are counted where the rows are; those of fewer than ``least`` rows are left out, and the ``most`` frequent ones reach the driver. Wrong labels
    of a few percent only flatten the counts.
    """
    rows = df.select(F.col(key).alias("k"), F.col(col).alias("t"), label_language(F.col(label)).alias("l")).where(F.col("l").isin(*LANGUAGES))
    part = sample // len(LANGUAGES)
    # One number for each language.
    share = {r["l"]: min(1.0, part / r["count"]) for r in rows.groupBy("l").count().collect()}
    limit = F.lit(0)
    for code, x in share.items():
        limit = F.when(F.col("l") == code, int(x * 1_000_000)).otherwise(limit)
    chosen = rows.where(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < limit).where("t is not null").select("t", "l")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for t, code in zip(batch["t"].to_pylist(), batch["l"].to_pylist()):
                n.update((w, code) for w in {w.lower() for w in WORD.findall(ASIDE.sub(" ", t))})
        words = list(n)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in words], pa.string()), pa.array([c for _, c in words], pa.string()), pa.array([n[x] for x in words], pa.int64())], ["word", "l", "n"])

    sums = [F.sum(F.when(F.col("l") == code, F.col("n")).otherwise(0)).alias(code) for code in LANGUAGES]
    counts = chosen.mapInArrow(count, "word string, l string, n long").groupBy("word").agg(F.sum("n").alias("n"), *sums).where(F.col("n") >= least)
    # Words that stand beside all labels alike, such as names, carry nothing by themselves.
    return Model({r["word"]: [r[code] for code in LANGUAGES] for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()})


def viterbi(scores: np.ndarray, start: np.ndarray, valid: np.ndarray, inside: float, between: float) -> np.ndarray:
    """Best paths for a batch: scores (texts x words x languages), sentence starts and words in use (texts x words)."""
    n, t, k = scores.shape
    back = np.empty((t, n, k), np.int8)
    best = scores[:, 0].copy()
    own = np.arange(k)
    for i in range(1, t):
        top = best.argmax(1)
        change = best[np.arange(n), top] - np.where(start[:, i], between, inside)
        stay = best >= change[:, None]
        back[i] = np.where(stay, own, top[:, None])
        best = np.where(valid[:, i, None], np.where(stay, best, change[:, None]) + scores[:, i], best)
        back[i][~valid[:, i]] = own
    path = np.empty((n, t), np.int8)
    path[:, -1] = best.argmax(1)
    for i in range(t - 1, 0, -1):
        path[:, i - 1] = back[i, np.arange(n), path[:, i]]
    return path


class Tokens:
    """What is known of each token between blanks: its scores, its number of words, and whether a sentence ends with it. Kept beside the model."""

    def __init__(self, model: Model, most: int = 500_000):
        self.model, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((4096, len(STATES) + 2), np.float32)

    def of(self, tokens: list[str]) -> np.ndarray:
        if len(self.index) > self.most:
            self.clear()
        found = np.fromiter((self.index.get(t, -1) for t in tokens), np.int64, len(tokens))
        for i in np.flatnonzero(found < 0).tolist():
            found[i] = at = self.index.setdefault(tokens[i], len(self.index))
            if at >= len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[at] = self.row(tokens[i])
        return self.rows[found]

    def row(self, token: str) -> np.ndarray:
        out = np.zeros(len(STATES) + 2, np.float32)
        for word in WORD.findall(token):
            # The script names the candidates.
            if OTHER_SCRIPT.search(word):
                out[: len(LANGUAGES)] -= 2
                out[len(LANGUAGES)] += 2
            else:
                out[: len(LANGUAGES)] += self.model.score(word)
                out[len(LANGUAGES)] -= 2
            out[-2] += 1
        out[-1] = token == "\n" or SENTENCE_END.search(token) is not None
        return out


def paths(scores: np.ndarray, start: np.ndarray, doc: np.ndarray, inside: float, between: float) -> np.ndarray:
    """Best labels of words (sorted by text): texts of like length go together, so one long text does not widen all."""
    path = np.empty(len(doc), np.int8)
    names, first, counts = np.unique(doc, return_index=True, return_counts=True)
    place = np.arange(len(doc)) - np.repeat(first, counts)
    order = np.argsort(counts, kind="stable")
    row = np.repeat(np.arange(len(names)), counts)
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo) * counts[order[hi]] < 60_000:
            hi += 1
        group = order[lo:hi]
        rank = np.full(len(names), -1)
        rank[group] = np.arange(len(group))
        mine = np.flatnonzero(rank[row] >= 0)
        r, p = rank[row[mine]], place[mine]
        shape = (len(group), int(counts[group].max()))
        grid, starts, valid = np.zeros((*shape, len(STATES)), np.float32), np.zeros(shape, bool), np.zeros(shape, bool)
        grid[r, p], starts[r, p], valid[r, p] = scores[mine], start[mine], True
        path[mine] = viterbi(grid, starts, valid, inside, between)[r, p]
        lo = hi
    return path


def _hidden(m: re.Match) -> str:
    """An aside with digits in place of its letters, which say nothing."""
    return re.sub(r"\S", "0", m.group())


def label_texts(texts: list[str], tokens: Tokens, inside: float, between: float) -> dict[str, np.ndarray]:
    """The segments of texts as arrays: text, first and last character, label, confidence, words, and whether it is a whole sentence.

    Texts have blanks around their line breaks.
    """
    seen = [ASIDE.sub(_hidden, t) if MAYBE_ASIDE.search(t) else t for t in texts]
    lists = pc.split_pattern(pa.array(seen, pa.large_string()), " ")
    doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    coded = pc.list_flatten(lists).dictionary_encode()
    codes, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    rows = tokens.of(names)
    length = np.fromiter(map(len, names), np.int64, len(names))[codes] + 1
    at = np.cumsum(length) - length
    at -= at[np.searchsorted(doc, doc)] if len(doc) else 0
    # The number of the sentence each token is in, over all texts.
    ends = rows[codes, -1] > 0 if len(codes) else np.zeros(0, bool)
    fresh = np.concatenate([[True], ends[:-1] | (doc[1:] != doc[:-1])]) if len(doc) else ends
    sentence = np.cumsum(fresh)
    word = np.flatnonzero(rows[codes, -2] > 0) if len(codes) else np.zeros(0, np.int64)
    if not len(word):
        return {k: np.zeros(0, np.int64) for k in ("doc", "start", "stop", "label", "sure", "words", "whole")}
    doc, sentence, codes_, at, length = doc[word], sentence[word], codes[word], at[word], length[word]
    scores = rows[codes_, : len(STATES)]
    new = np.concatenate([[True], sentence[1:] != sentence[:-1]])
    path = paths(scores, new, doc, inside, between)
    cut = np.flatnonzero(new | np.concatenate([[True], path[1:] != path[:-1]]))
    stop = np.append(cut[1:], len(word))
    evidence = np.add.reduceat(scores.astype(np.float64), cut, 0)
    soft = np.exp(evidence - evidence.max(1, keepdims=True))
    label = path[cut]
    whole = new[cut] & np.append(new[cut[1:]], True)
    return {
        "doc": doc[cut], "start": at[cut], "stop": at[stop - 1] + length[stop - 1] - 1, "label": label, "sure": (soft / soft.sum(1, keepdims=True))[np.arange(len(cut)), label],
        "words": np.add.reduceat(rows[codes_, -2], cut).astype(np.int64), "whole": whole,
    }


def _texts(batch: pa.RecordBatch) -> list[str]:
    """The author's text of each row, with blanks around line breaks."""
    out = []
    for lines in batch["lines"].to_pylist():
        lines = [x or "" for x in lines or ()]
        if len(lines) > 1:
            lines = [x for x, page in zip(lines, page_lines(lines)) if not page]
        out.append(" \n ".join(lines))
    return out


def _tokens(shared) -> Tokens:
    model = shared.value
    # Workers that run several tasks keep what they know of tokens with the model.
    if not hasattr(model, "tokens"):
        model.tokens = Tokens(model)
    return model.tokens


SEGMENTS = "key long, part int, lang string, confidence double, words int, text string"


def segments(df: DataFrame, key: str, col: str, model: Model, inside: float = 8.0, between: float = 2.5) -> DataFrame:
    """(key, part, lang, confidence, words, text): each stretch of one language within a sentence; ``lang`` is ``other`` for other scripts.

    NULL, empty and blank texts, and sentences without letters, give nothing. Short quotes, links, tags and lines of the page are no evidence. A text
    in Latin letters in none of the six languages gets the nearest, with a low confidence. Texts are read whole; rows that share a key are read one by one.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the number of its words

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch)
            x = label_texts(texts, _tokens(shared), inside, between)
            part = np.arange(len(x["doc"])) - np.searchsorted(x["doc"], x["doc"])
            text = [texts[i][a:b] for i, a, b in zip(x["doc"].tolist(), x["start"].tolist(), x["stop"].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch["key"].take(pa.array(x["doc"])), pa.array(part.astype(np.int32)), pa.array([STATES[k] for k in x["label"]], pa.string()), pa.array(x["sure"].astype(float)), pa.array(x["words"].astype(np.int32)), pa.array(text, pa.string())],
                ["key", "part", "lang", "confidence", "words", "text"],
            )

    rows = df.where(F.col(key).isNotNull() & F.col(col).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(col).alias("text"))
    return _lines(rows).mapInArrow(label, SEGMENTS)


def _lines(rows: DataFrame) -> DataFrame:
    return canonical_lines(rows).drop("text")


def languages(df: DataFrame, key: str, col: str, model: Model, label: Column | None = None, least_words: int = 3, least_part: int = 5, least_confidence: float = 0.9, inside: float = 8.0, between: float = 2.5) -> DataFrame:
    """(key, label, blanks, found): for each text, its label, its number of words between blanks, and an array of (lang, words, confidence) of the languages in which it has at least a sentence.

    A sentence of fewer words than ``least_words``, a part of a sentence of fewer than ``least_part``, or one less sure, counts only for the language that has most of the text's words.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the number of its words
    kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64()), ("confidence", pa.float64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch)
            x = label_texts(texts, _tokens(shared), inside, between)
            n = len(STATES)
            cell = x["doc"] * n + x["label"]
            words = np.bincount(cell, x["words"], len(texts) * n).reshape(-1, n)
            sure = np.bincount(cell, x["words"] * x["sure"], len(texts) * n).reshape(-1, n)
            fine = (x["words"] >= np.where(x["whole"], least_words, least_part)) & (x["sure"] >= least_confidence)
            keep = np.bincount(cell, fine, len(texts) * n).reshape(-1, n) > 0
            top = np.arange(len(texts)), words.argmax(1)
            keep[top] |= words[top] > 0
            found = [[{"lang": STATES[k], "words": int(words[i, k]), "confidence": float(sure[i, k] / words[i, k])} for k in np.flatnonzero(keep[i])] for i in range(len(texts))]
            blanks = [sum(map(len, map(str.split, lines or ()))) for lines in batch["lines"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["label"], pa.array(blanks, pa.int32()), pa.array(found, kind)], ["key", "label", "blanks", "found"])

    rows = df.where(F.col(key).isNotNull() & F.col(col).isNotNull()).select(F.col(key).cast("long").alias("key"), (F.lit(None).cast("string") if label is None else label).alias("label"), F.col(col).alias("text"))
    return _lines(rows).mapInArrow(find, "key long, label string, blanks int, found array<struct<lang:string,words:bigint,confidence:double>>")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = table(spark, sf_dir, "raw_posts")
    found = languages(posts, "id", "posts", fit(posts, "id", "posts", "lang"), label_language(F.col("lang"))).where("blanks >= 8")
    codes = found.select("key", "label", F.filter(F.col("found.lang"), lambda x: x != OTHER).alias("langs"))
    case = F.col("label").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.col("label"))
    return codes.where(case).select(F.col("key").alias("id"), F.explode("langs").alias("lang")).distinct()


def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every post with its language and confidence."""
    posts = table(spark, sf_dir, "raw_posts")
    return segments(posts, "id", "posts", fit(posts, "id", "posts", "lang")).withColumnRenamed("key", "id")


QUERIES = {"p6_found": p6_found, "p6_segments": p6_segments}
ORACLE: dict[str, str] = {}
