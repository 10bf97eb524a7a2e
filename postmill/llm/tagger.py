"""A character-level bidirectional LSTM with CRF transitions, in numpy: training and decoding; and a linear scorer of words.

Gates and cells use x / (1 + |x|) where tanh is usual: a quarter of the time.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 64

KINDS = ("email", "phone", "id_number", "address", "name")
#: Tag 0 is outside; 1 + 2k begins and 2 + 2k continues kind k.
TAGS = 1 + 2 * len(KINDS)
CHARS = " abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,:;!?-_+@()[]<>/'\"&#€$£%*=|\nºª°"
_CODE = np.full(0x250, len(CHARS) + 1, np.int16)
for _i, _c in enumerate(CHARS):
    _CODE[ord(_c) % 0x250 if ord(_c) < 0x250 else 0] = _i + 1
for _c, _b in zip("äöüßéèêëáàâãåçñóòôõúùûíìîïœæÄÖÜÉÈÁÀÂÃÇÑÓÒÔÚÙÍÌ", "aousEEEEaaaaacnooooUUUiiiiooAOUEEAAAACNOOOUUII"):
    _CODE[ord(_c) if ord(_c) < 0x250 else 0] = CHARS.index(_b.lower() if _c.islower() else _b) + 1
# What digits there are matters less than how many: 0, which begins many numbers, and any other.
for _c in "123456789":
    _CODE[ord(_c)] = CHARS.index("5") + 1
VOCABULARY = len(CHARS) + 2


def encode(text: str) -> np.ndarray:
    """Codes of the characters of a text; accented letters are as their base."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 0x250, _CODE[np.minimum(points, 0x24F)], VOCABULARY - 1).astype(np.int16)


def new_weights(embed: int = 14, hidden: int = 36, seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {"emb": rng.normal(0, 0.3, (VOCABULARY, embed)), "out": rng.normal(0, 0.2, (2 * hidden, TAGS)), "ob": np.zeros(TAGS), "tr": np.zeros((TAGS, TAGS)), "st": np.zeros(TAGS)}
    for d in "fb":
        w["x" + d] = rng.normal(0, 0.25, (embed, 4 * hidden))
        w["h" + d] = rng.normal(0, 0.25, (hidden, 4 * hidden))
        w["b" + d] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
    w["ob"][0] = 2.0
    for k in range(len(KINDS)):  # a kind continues only itself
        for a in range(TAGS):
            if a not in (1 + 2 * k, 2 + 2 * k):
                w["tr"][a, 2 + 2 * k] = -20.0
        w["st"][2 + 2 * k] = -1.0
    return {k: v.astype(np.float32) for k, v in w.items()}


def _lstm(w, d, ids, keep, into=None):
    """Hidden states (time first); gates in the order input, forget, output, new. ``into`` is what each code adds to the gates, if that is known."""
    t, n = ids.shape
    size = w["h" + d].shape[0]
    into, across = w["emb"] @ w["x" + d] + w["b" + d] if into is None else into, w["h" + d]
    h, c = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
    hs = np.empty((t, n, size), np.float32)
    kept = []
    room = np.empty((n, 4 * size), np.float32)
    for i in range(t) if d == "f" else range(t - 1, -1, -1):
        z = into[ids[i]]
        z += np.matmul(h, across, out=room)
        np.abs(z, out=room)
        room += 1
        z /= room
        s = z[:, : 3 * size]
        s *= 0.5
        s += 0.5
        before = c
        c = z[:, size : 2 * size] * c
        c += z[:, :size] * z[:, 3 * size :]
        tc = c / (1 + np.abs(c))
        if keep:
            kept.append((i, z, before, tc, h))
        h = z[:, 2 * size : 3 * size] * tc
        hs[i] = h
    return hs, kept


def emissions(w, ids: np.ndarray, keep: bool = False):
    """Tag scores (time, windows, tags) of windows of codes (windows, time)."""
    ids = np.ascontiguousarray(ids.T)
    f, kf = _lstm(w, "f", ids, keep)
    b, kb = _lstm(w, "b", ids, keep)
    size = f.shape[2]
    e = f @ w["out"][:size] + b @ w["out"][size:] + w["ob"]
    return (e, (ids, f, b, kf, kb)) if keep else e


def decode(w, e: np.ndarray) -> np.ndarray:
    """The best path (windows, time) under the CRF; windows in which no tag can win are not searched."""
    t, n, _ = e.shape
    path = np.zeros((n, t), np.int8)
    gain = max(0.0, float(w["tr"].max() - w["tr"][0, 0]), float(w["st"].max() - w["st"][0]))
    rows = np.flatnonzero((e[:, :, 0] - e[:, :, 1:].max(2)).min(0) < 2 * gain)
    if not len(rows):
        return path
    e = e[:, rows]
    best = e[0] + w["st"]
    back = np.empty((t, len(rows), TAGS), np.int8)
    to = np.ascontiguousarray(w["tr"].T)
    for i in range(1, t):
        s = best[:, None, :] + to
        back[i] = s.argmax(2)
        best = np.take_along_axis(s, back[i][:, :, None].astype(np.intp), 2)[:, :, 0] + e[i]
    tag = best.argmax(1)
    each = np.arange(len(rows))
    for i in range(t - 1, -1, -1):
        path[rows, i] = tag
        tag = back[i][each, tag] if i else tag
    return path


def _lse(x, axis):
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def gradients(w, ids: np.ndarray, tags: np.ndarray):
    """Negative log likelihood of a batch under the CRF, and its gradients by back-propagation through time."""
    e, (idt, f, b, kf, kb) = emissions(w, ids, True)
    t, n, _ = e.shape
    y = tags.T
    tr, st = w["tr"], w["st"]
    alpha, beta = np.empty_like(e), np.empty_like(e)
    alpha[0] = e[0] + st
    for i in range(1, t):
        alpha[i] = _lse(alpha[i - 1][:, :, None] + tr, 1) + e[i]
    z = _lse(alpha[-1], 1)
    beta[-1] = 0
    for i in range(t - 2, -1, -1):
        beta[i] = _lse(tr + (e[i + 1] + beta[i + 1])[:, None, :], 2)
    each = np.arange(n)
    gold = st[y[0]] + sum(e[i][each, y[i]] for i in range(t)) + sum(tr[y[i - 1], y[i]] for i in range(1, t))
    de = np.exp(alpha + beta - z[None, :, None])
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["st"] = de[0].sum(0) - np.bincount(y[0], minlength=TAGS)
    for i in range(1, t):
        g["tr"] += np.exp(alpha[i - 1][:, :, None] + tr + (e[i] + beta[i] - z[:, None])[:, None, :]).sum(0)
        np.add.at(g["tr"], (y[i - 1], y[i]), -1)
    for i in range(t):
        de[i][each, y[i]] -= 1
    de /= n
    g["st"], g["tr"] = g["st"] / n, g["tr"] / n
    size = f.shape[2]
    g["out"] = np.concatenate([np.einsum("tnh,tnk->hk", f, de, optimize=True), np.einsum("tnh,tnk->hk", b, de, optimize=True)])
    g["ob"] = de.sum((0, 1))
    demb = np.zeros(w["emb"].shape, np.float32)
    for d, kept, dh_all in (("f", kf, de @ w["out"][:size].T), ("b", kb, de @ w["out"][size:].T)):
        dh, dc = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
        into = np.zeros((len(w["emb"]), 4 * size), np.float32)
        for i, gate, before, tc, hb in reversed(kept):
            dh = dh + dh_all[i]
            gi, gf, go, gn = (gate[:, k * size : (k + 1) * size] for k in range(4))
            dc = dc + dh * go * (1 - np.abs(tc)) ** 2
            slope = [0.5 * (1 - np.abs(2 * g - 1)) ** 2 for g in (gi, gf, go)]
            dz = np.concatenate([dc * gn * slope[0], dc * before * slope[1], dh * tc * slope[2], dc * gi * (1 - np.abs(gn)) ** 2], 1)
            g["h" + d] += hb.T @ dz
            np.add.at(into, idt[i], dz)
            dh, dc = dz @ w["h" + d].T, dc * gf
        g["x" + d] = w["emb"].T @ into
        g["b" + d] = into.sum(0)
        demb += into @ w["x" + d].T
    g["emb"] = demb
    return float((z - gold).mean()), g


def train(batches, w, rate: float, steps: int, state=None):
    """Adam over (codes, tags) batches: (weights, moments, mean loss); ``state`` goes on with earlier moments."""
    m, v, done = state or ({k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0)
    w, total = {k: x.copy() for k, x in w.items()}, 0.0
    for s, (ids, tags) in zip(range(done + 1, done + steps + 1), batches):
        loss, g = gradients(w, ids, tags)
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        clip = min(1.0, 3.0 / (norm + 1e-9))
        for k in w:
            x = (g[k] * clip).astype(np.float32)
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.999 * v[k] + 0.001 * x * x
            w[k] -= rate * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.999**s)) + 1e-8)
        total += loss
    return w, (m, v, done + steps), total / steps


# The first pass: a linear model over the words around each word, which says where the LSTM has to read.

REACH = 3
PAIRS = 64


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Words between blanks and line breaks: (text, first character, number of the word, distinct words)."""
    lists = pc.split_pattern_regex(texts, "[ \n]")
    doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    coded = pc.list_flatten(lists).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    length = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)[codes] + 1 if len(codes) else np.zeros(0, np.int64)
    start = np.cumsum(length) - length
    first = np.searchsorted(doc, doc) if len(doc) else doc
    return doc, start - start[first] if len(doc) else start, codes, coded.dictionary


def traits(words: pa.Array) -> list[pa.Array]:
    """What the scorer sees of a word: the word without marks, its shape, and its last three letters."""
    bare = pc.utf8_lower(pc.replace_substring_regex(words, r"^[^\p{L}\p{N}@]+|[^\p{L}\p{N}@]+$", ""))
    shape = words
    for pattern, sign in ((r"\p{Lu}", "A"), (r"\p{Ll}|\p{Lo}", "a"), (r"\p{N}", "0"), ("aa+", "a"), ("AA+", "AA"), ("0{6,}", "000000")):
        shape = pc.replace_substring_regex(shape, pattern, sign)
    return [bare, shape, pc.utf8_slice_codeunits(bare, -3)]


def seen(words: pa.Array, scorer: dict) -> list[np.ndarray]:
    """The traits of each word as numbers; 0 for what training did not see."""
    return [(pc.fill_null(pc.index_in(t, pa.array(scorer[f"scorer_names{i}"].tolist(), t.type)), -1).to_numpy(zero_copy_only=False) + 1).astype(np.int64) for i, t in enumerate(traits(words))]


def word_scores(texts: pa.Array, scorer: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first character, end, score) of each word."""
    doc, start, codes, words = words_of(texts)
    if not len(doc):
        return doc, start, start, np.zeros(0, np.float32)
    marks = seen(words, scorer)
    each = sum(scorer[f"scorer_weights{i}"][:, m] for i, m in enumerate(marks))  # (positions, distinct words)
    score = np.full(len(doc), float(scorer["scorer_bias"]), np.float32)
    for k in range(-REACH, REACH + 1):
        lo, hi = max(0, -k), len(doc) - max(0, k)
        if lo < hi:
            score[lo:hi] += np.where(doc[lo:hi] == doc[lo + k : hi + k], each[k + REACH][codes[lo + k : hi + k]], 0)
    shape = np.minimum(marks[1], PAIRS - 1)[codes]
    score[:-1] += np.where(doc[:-1] == doc[1:], scorer["scorer_pairs"][shape[:-1], shape[1:]], 0)
    score[1:] += np.where(doc[:-1] == doc[1:], scorer["scorer_before"][shape[:-1], shape[1:]], 0)
    end = start + pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
    return doc, start, end, score


def fit_scorer(data: list[tuple[str, list[int]]], epochs: int = 14, least: int = 4, most: tuple = (6000, 400, 2500), found: float = 0.997, margin: float = 4.0, say=print) -> dict[str, np.ndarray]:
    """Logistic regression over the words of labelled texts; the last tenth sets the threshold, ``margin`` below the one at which the share ``found`` of spans has a word above it."""
    texts = pa.array([t for t, _ in data], pa.large_string())
    doc, start, codes, words = words_of(texts)
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
    inside = [np.array([0, *np.cumsum(np.array(m) > 0)]) for _, m in data]
    y = np.array([inside[d][min(len(inside[d]) - 1, a + n)] - inside[d][a] > 0 for d, a, n in zip(doc, start, size)])
    scorer: dict = {"scorer_bias": np.float32(-3)}
    count = np.bincount(codes, minlength=len(words))
    for i, t in enumerate(traits(words)):
        n: Counter = Counter()
        for name, k in zip(t.to_pylist(), count):
            n[name] += int(k)
        scorer[f"scorer_names{i}"] = np.array([name for name, k in n.most_common(most[i]) if k >= least])
        scorer[f"scorer_weights{i}"] = np.zeros((2 * REACH + 1, len(scorer[f"scorer_names{i}"]) + 1), np.float32)
    scorer["scorer_pairs"], scorer["scorer_before"] = np.zeros((PAIRS, PAIRS), np.float32), np.zeros((PAIRS, PAIRS), np.float32)
    marks = [m[codes] for m in seen(words, scorer)]
    shape = np.minimum(marks[1], PAIRS - 1)
    total = {k: np.full(np.shape(v), 1e-3) for k, v in scorer.items() if "names" not in k}
    train_to = int(0.9 * len(data))
    rows = np.flatnonzero(doc < train_to)
    rng = np.random.default_rng(3)
    at = np.arange(len(doc))

    def forward(r):
        z = np.full(len(r), float(scorer["scorer_bias"]))
        near = []
        for k in range(-REACH, REACH + 1):
            q = np.clip(r + k, 0, len(doc) - 1)
            ok = (doc[q] == doc[r]) & (q == r + k)
            near.append((q[ok], ok))
            for i, m in enumerate(marks):
                z[ok] += scorer[f"scorer_weights{i}"][k + REACH, m[q[ok]]]
        for name, k in (("scorer_pairs", 1), ("scorer_before", -1)):
            q, ok = near[k + REACH]
            a, b = (shape[r[ok]], shape[q]) if k > 0 else (shape[q], shape[r[ok]])
            z[ok] += scorer[name][a, b]
        return z, near

    for epoch in range(epochs):
        rng.shuffle(rows)
        rate = 0.3 * (1 - epoch / epochs) + 0.02
        for lo in range(0, len(rows), 4000):
            r = rows[lo : lo + 4000]
            z, near = forward(r)
            g = (1 / (1 + np.exp(-z)) - y[r]) * np.where(y[r], 4.0, 1.0)

            def step(name, index, values):
                d = np.zeros(np.shape(scorer[name]))
                np.add.at(d, index, values)
                total[name] += d * d
                scorer[name] = (scorer[name] - rate * d / np.sqrt(total[name])).astype(np.float32)

            for i, m in enumerate(marks):
                where, values = [], []
                for k, (q, ok) in enumerate(near):
                    where.append(np.stack([np.full(len(q), k), m[q]]))
                    values.append(g[ok])
                step(f"scorer_weights{i}", tuple(np.concatenate(where, 1)), np.concatenate(values))
            for name, k in (("scorer_pairs", 1), ("scorer_before", -1)):
                q, ok = near[k + REACH]
                step(name, (shape[r[ok]], shape[q]) if k > 0 else (shape[q], shape[r[ok]]), g[ok])
            scorer["scorer_bias"] = np.float32(scorer["scorer_bias"] - rate * 0.01 * g.mean())
    test = np.flatnonzero(doc >= train_to)
    z, _ = forward(test)
    best: dict = {}
    for j, v in zip(test, z):
        marked = data[doc[j]][1]
        for c in range(start[j], min(len(marked), start[j] + size[j])):
            if marked[c]:
                first = c
                while first > 0 and marked[first] % 2 == 0 and marked[first]:
                    first -= 1
                key = (doc[j], first)
                best[key] = max(v, best.get(key, -99.0))
                break
    # Made text is easier than other text, so the limit lies lower than it needs to.
    limit = float(np.quantile(list(best.values()), 1 - found)) - margin
    scorer["scorer_limit"] = np.float32(limit)
    say(f"scorer: limit {limit:.2f}, {len(best)} spans, words read besides: {(z[~y[test]] >= limit).mean():.4f}, {len(at)} words")
    return scorer
