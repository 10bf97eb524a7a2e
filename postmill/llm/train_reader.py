"""Trains the model of problem 4 on the text that ``train_tagger`` makes: python -m postmill.llm.train_reader POSTS.parquet OUT.npz [ROUNDS [WEIGHTS]].

With WEIGHTS, training goes on from there at a lower rate. What is written scores no tag less than training did (``lean``), so that more is found.
"""

from __future__ import annotations

import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa

from postmill.llm import pii, reader
from postmill.llm.tagger import gradients, new_weights, words_of
from postmill.llm.train_tagger import FAMILY, GIVEN, STREET, Maker, carriers, labelled

LENGTH, BATCH, WIDE = 32, 128, 32


def lean(w: dict, sign: int = 1) -> dict:
    """The weights with the lean to find more, or without it."""
    ob = w["ob"].copy()
    ob[0] -= sign * 0.5
    return {**w, "ob": ob}


def word_tags(data: list[tuple[str, list[int]]]):
    """(text of each word, number of each word, distinct words, tag of each word) of texts with a mark at each character."""
    doc, start, codes, words = words_of(pa.array([t for t, _ in data], pa.large_string()))
    base = np.cumsum([0, *(len(m) + 1 for _, m in data)])[:-1]
    marks = np.concatenate([[*m, 0] for _, m in data]).astype(np.int64)
    size = np.array([len(w) for w in words.to_pylist()])[codes]
    at = base[doc] + start
    cuts = np.stack([at, at + np.maximum(size, 1)], 1).ravel()
    kind = np.maximum.reduceat((marks + 1) // 2, cuts)[::2] * (size > 0)
    begins = np.maximum.reduceat(marks % 2, cuts)[::2]
    return doc, codes, words, np.where(kind > 0, 2 * kind - begins, 0)


def spanless(path: str, most: int = 20_000) -> list[str]:
    """Carriers without those that may hold what the tests of ``carriers`` let through: numbers beside words for streets, sentences cut at an abbreviation before a number, and in German pairs of capitals with a rare word."""
    every = carriers(path, 4 * most)
    count = Counter(w.strip(".,:;!?()") for s in every for w in s.split())
    streets = {w.lower().strip(".") for words in STREET.values() for w in words} | {"flat", "apt", "apartment", "unit"}
    german = re.compile(rf"(?:{'|'.join(w.strip('.') for w in STREET['de'])}|str)\b", re.I)
    pair = re.compile(r"([A-ZÀ-Þ][\w'’-]+),? (?=([A-ZÀ-Þ][\w'’-]+))")
    cut = re.compile(r"(?:\bno|\bnr|nº|n°|\bflat|\bapt|\bst|\b\w)\.?$", re.I)

    def clean(s: str) -> bool:
        words = {w.lower().strip(".,:;!?()") for w in s.split()}
        return not (cut.search(s) or (any(c.isdigit() for c in s) and (words & streets or german.search(s))) or any(count[w] < 25 for m in pair.finditer(s) for w in m.groups()))

    return [s for s in every if clean(s)][:most]


def made(seed: int, around: list[str], texts: int):
    make = Maker(seed, True, plain_words(around))
    return word_tags([labelled(make, around, make.r.choice([60, 260, 340])) for _ in range(texts)])


def plain_words(around: list[str]) -> list[str]:
    """Words of the text around; a fourth of the list are those that stand before or after a word for a street there, so that the number beside it tells an address and not the street's name."""
    words = [w for w in sorted({w.lower() for s in around for w in s.split()}) if len(w) > 3 and w.isalpha()]
    streets = {w.lower().strip(".") for each in STREET.values() for w in each}
    beside: set[str] = set()
    for s in around:
        each = [w.strip(".,:;!?()") for w in s.split()]
        for a, b in zip(each, each[1:]):
            beside |= {x.lower() for x, y in ((a, b), (b, a)) if y.lower() in streets and y[0].isupper() and x[:1].isupper() and len(x) > 3 and x.isalpha()}
    return words + sorted(beside) * (len(words) // (3 * len(beside) + 1))


def names_of(around: list[str], texts: int = 30_000, least: int = 3) -> dict[str, list[str]]:
    """The names of traits that are seen often enough; words that are seen only in spans have none but for given and common family names, so that no invented word is learned by heart."""
    _, codes, words, tags = made(31, around, texts)
    known = {w.lower() for s in around for w in s.split()} | {w.lower() for w in [*GIVEN, *FAMILY]}
    count, out = np.bincount(codes, minlength=len(words)), {}
    for t, values in reader.traits(words).items():
        if t in reader.NAMED:
            n: Counter = Counter()
            outside = np.bincount(codes[tags == 0], minlength=len(words))
            for name, k, other in zip(values.to_pylist(), count, outside):
                if t != "bare" or name in known or other > 0.3 * k:
                    n[name] += int(k)
            out[t] = [name for name, k in n.most_common(reader.NAMED[t]) if k >= least]
    return out


_pool: dict = {}


def _start(around, names):
    _pool.update(around=around, names=names)


def _round(job):
    """Some steps of Adam of one worker on text of its own, from common weights and with its own moments."""
    w, state, seed, steps, rate, texts = job
    doc, codes, words, tags = made(seed, _pool["around"], texts)
    marks = reader.numbers(words, _pool["names"])
    rng = np.random.default_rng(seed)
    first, count = np.unique(doc, return_index=True)[1], np.bincount(doc)
    count = count[count > 0]
    first, count = first[count >= 4], count[count >= 4]
    m, v, done = state or ({k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0)
    w, total = {k: x.copy() for k, x in w.items()}, 0.0
    for s in range(done + 1, done + steps + 1):
        length = LENGTH if rng.random() < 0.8 else int(rng.integers(4, 20))
        usable = np.flatnonzero(count >= length)
        some = rng.choice(usable, BATCH)
        slack = count[some] - length
        place = rng.random(BATCH)
        # A fifth of the windows each begin and end with the text.
        at = first[some] + np.where(place < 0.2, 0, np.where(place < 0.4, slack, (rng.random(BATCH) * (slack + 1)).astype(np.int64)))
        spots = at[:, None] + np.arange(length)
        used, ids = np.unique(codes[spots], return_inverse=True)
        ids = ids.reshape(spots.shape)
        each = {t: x[used].copy() for t, x in marks.items()}
        # Words and their parts are hidden at random, so that unknown ones are told by their shape and neighbours.
        hidden = rng.random(len(used))
        each["bare"][hidden < 0.3] = 0
        part = rng.random(len(used)) < np.where(each["bare"] == 0, 0.5, 0.05)
        each["first"][part] = 0
        each["last"][part] = 0
        core = {k: x for k, x in w.items() if not k.startswith("emb_")}
        loss, g = gradients({**core, "emb": reader.embedded(w, each)}, ids, tags[spots])
        top = g.pop("emb")
        for t, x in each.items():
            g["emb_" + t] = np.zeros_like(w["emb_" + t])
            np.add.at(g["emb_" + t], x, top)
        clip = min(1.0, 3.0 / (np.sqrt(sum(float((x * x).sum()) for x in g.values())) + 1e-9))
        for k in w:
            x = (g[k] * clip).astype(np.float32)
            m[k] += 0.1 * (x - m[k])
            v[k] += 0.001 * (x * x - v[k])
            w[k] -= rate * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.999**s)) + 1e-8)
        total += loss
    return w, (m, v, done + steps), total / steps


if __name__ == "__main__":
    import multiprocessing

    rounds, workers, each = int(sys.argv[3]) if len(sys.argv) > 3 else 24, 8, 100
    around = spanless(sys.argv[1])
    names = names_of(around) if len(sys.argv) < 5 else pii.model(sys.argv[4])[1]
    w = {k: x for k, x in new_weights(WIDE, 40).items() if k != "emb"}
    rng = np.random.default_rng(2)
    for t, size in [*((t, len(n) + 1) for t, n in names.items()), ("digits", reader.DIGITS + 1)]:
        w["emb_" + t] = rng.normal(0, 0.15, (size, WIDE)).astype(np.float32)
    if len(sys.argv) > 4:
        w = lean(pii.model(sys.argv[4])[0], -1)
    print({t: len(n) for t, n in names.items()}, flush=True)
    first = 1000 if len(sys.argv) < 5 else 100_000 + int(abs(w["ob"].sum()) * 1e4) % 9_000  # new text if training goes on
    states = [None] * workers
    with multiprocessing.get_context("spawn").Pool(workers, _start, (around, names)) as pool:
        for n in range(rounds):
            rate = (0.008 if len(sys.argv) < 5 else 0.004) * (1.02 - n / rounds)
            # The workers' weights are averaged after each round.
            done = pool.map(_round, [(w, states[i], first + 100 * n + i, each, rate, 5_000) for i in range(workers)], chunksize=1)
            w = {k: np.mean([d[0][k] for d in done], 0, dtype=np.float32) for k in w}
            states = [d[1] for d in done]
            print(f"round {n + 1}: loss {np.mean([d[2] for d in done]):.3f}", flush=True)
            np.savez_compressed(sys.argv[2], **{k: v.astype(np.float16) for k, v in lean(w).items()}, **{"names_" + t: np.array("\n".join(n)) for t, n in names.items()})
