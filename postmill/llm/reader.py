"""The model of problem 4: a bidirectional LSTM with CRF transitions over the words of whole texts, in numpy.

A word is what stands between blanks; the model sees its traits: the word without marks, its shape, its first and last letters, its marks and the number of its digits.
Every word of every text is read; nothing is chosen before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from postmill.llm.tagger import TAGS, _lstm, decode, words_of

#: The traits that have a list of names, and how many names at most.
NAMED = {"bare": 12_000, "shape": 1_500, "coarse": 400, "first": 3_000, "last": 3_000, "marks": 200}
DIGITS = 20
# Words of a text that are read at once, and words of its neighbourhood that are read besides if it is longer.
CORE, AROUND, ROWS = 400, 100, 256


def traits(words: pa.Array) -> dict[str, pa.Array]:
    """What the model sees of each word."""
    sub = pc.replace_substring_regex
    bare = sub(sub(pc.utf8_lower(words), r"^[^\p{L}\p{N}@]+|[^\p{L}\p{N}@]+$", ""), r"^[dl]['’]|['’]s$", "")
    shape = words
    for pattern, sign in ((r"\p{Lu}", "A"), (r"\p{Ll}|\p{Lo}", "a"), (r"\p{N}", "0"), ("aa+", "a"), ("AA+", "AA"), ("0{17,}", "0" * 17)):
        shape = sub(shape, pattern, sign)
    coarse = sub(sub(shape, "00+", "0"), "AA", "A")
    marks = sub(words, r"(?s)^([^\p{L}\p{N}]?).*?([^\p{L}\p{N}]?)$", r"\1 \2")
    digits = pc.min_element_wise(pc.utf8_length(sub(words, r"\P{N}", "")), DIGITS)
    return {"bare": bare, "shape": shape, "coarse": coarse, "first": pc.utf8_slice_codeunits(bare, 0, 3), "last": pc.utf8_slice_codeunits(bare, -3), "marks": marks, "digits": digits}


def numbers(words: pa.Array, names: dict[str, list[str]]) -> dict[str, np.ndarray]:
    """The traits of each word as numbers; 0 for what training did not see."""
    seen = traits(words)
    out = {t: (pc.fill_null(pc.index_in(seen[t], pa.array(names[t], seen[t].type)), -1).to_numpy(zero_copy_only=False) + 1).astype(np.int64) for t in NAMED}
    return {**out, "digits": seen["digits"].to_numpy(zero_copy_only=False).astype(np.int64)}


def embedded(w: dict, marks: dict[str, np.ndarray]) -> np.ndarray:
    """The vector of each word: the sum over its traits."""
    return sum(w["emb_" + t][m] for t, m in marks.items())


def _pieces(count: np.ndarray) -> np.ndarray:
    """(first, end, first to keep, end to keep), in words, of what is read at once: texts, or overlapping parts of longer ones."""
    base = np.cumsum(count) - count
    parts = np.where(count > CORE + 2 * AROUND, -(-count // CORE), 1)
    owner = np.repeat(np.arange(len(count)), parts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    whole = parts[owner] == 1
    lo = base[owner] + number * CORE
    end = base[owner] + count[owner]
    hi = np.where(whole, end, np.minimum(end, lo + CORE))
    return np.stack([np.maximum(base[owner], lo - AROUND), np.minimum(end, np.where(whole, end, hi + AROUND)), lo, hi], 1)


def scores(w: dict, doc: np.ndarray, codes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The tag scores of each word; ``words`` are the vectors of the distinct words. What a word gets does not depend on other texts."""
    out = np.full((len(codes), TAGS), w["ob"], np.float32)
    size = len(w["out"]) // 2
    count = np.bincount(doc)
    pieces = _pieces(count[count > 0])
    pieces = pieces[np.argsort(pieces[:, 1] - pieces[:, 0], kind="stable")]
    into = {d: words @ w["x" + d] + w["b" + d] for d in "fb"}
    for k in range(0, len(pieces), ROWS):
        a, b, lo, hi = pieces[k : k + ROWS].T
        step = np.arange(int((b - a).max()))[:, None]
        for d, spots, weights in (("f", a + step, w["out"][:size]), ("b", b - 1 - step[::-1], w["out"][size:])):
            # Each direction begins at an end of the text (the second goes through the cells backwards), so what stands in the cells past the other end changes nothing.
            states, _ = _lstm(w, d, codes[np.clip(spots, a, b - 1)], False, into[d])
            keep = (spots >= lo) & (spots < hi)
            out[spots[keep]] += (states @ weights)[keep]
    return out


def paths(w: dict, doc: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The tag of each word on the best path of its text, before and after which no tag stands.

    Words that no tagged stretch of a best path can hold are left out of the search: replacing a stretch of n words by no tags
    costs at most the n + 1 changes of tag, so one whose scores lose more than that is never best.
    """
    tags = np.zeros(len(doc), np.int8)
    gain = max(0.0, float(w["tr"].max() - w["tr"][0, 0]))
    total = np.concatenate([[0.0], np.cumsum((e[:, 0] - e[:, 1:].max(1) - 2 * gain).astype(np.float64))])
    after = np.minimum.accumulate(total[:0:-1])[::-1]
    open_ = after < np.maximum.accumulate(total[:-1])
    at = np.flatnonzero(open_)
    if not len(at):
        return tags
    fresh = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (doc[at[1:]] != doc[at[:-1]])]))
    start, size = at[fresh], np.diff(np.append(fresh, len(at)))
    order = np.argsort(size, kind="stable")
    first = {**w, "st": w["tr"][0]}
    none = np.full(TAGS, -1e4, np.float32)
    none[0] = 0
    for k in range(0, len(order), ROWS):
        some = order[k : k + ROWS]
        step = np.arange(int(size[some].max()) + 1)[:, None]
        inside = step < size[some]
        spots = start[some] + step
        grid = np.where(inside[:, :, None], e[np.minimum(spots, len(e) - 1)], none)
        tags[spots[inside]] = decode(first, grid).T[inside]
    return tags


def spans(texts: pa.Array, w: dict, names: dict[str, list[str]]) -> list[tuple[int, int, int, int]]:
    """(text, kind, first character, end) of what is tagged, with the marks that stand at its words."""
    doc, start, codes, words = words_of(texts)
    if not len(doc):
        return []
    e = scores(w, doc, codes, embedded(w, numbers(words, names)))
    tags = paths(w, doc, e)
    kind = (tags + 1) // 2
    new = (kind > 0) & ((tags % 2 == 1) | (np.diff(kind, prepend=0) != 0) | (np.diff(doc, prepend=-1) != 0))
    first = np.flatnonzero(new)
    if not len(first):
        return []
    last = np.array([i + int(np.argmin(np.append((kind[i + 1 : j] == kind[i]) & (doc[i + 1 : j] == doc[i]), False))) for i, j in zip(first, [*first[1:], len(doc)])])
    end = start[last] + pc.utf8_length(words.take(pa.array(codes[last]))).to_numpy(zero_copy_only=False)
    return [(int(d), int(k) - 1, int(a), int(b)) for d, k, a, b in zip(doc[first], kind[first], start[first], end)]
