"""Character-level bidirectional LSTM with CRF transitions, in numpy: training from labelled spans and windowed decoding.

Texts are cut into overlapping windows; the emissions of overlapping windows are averaged, weighted by the distance to the window's
edge, and one Viterbi pass over the whole text reconciles all windows globally. Texts of any length are decoded whole.
"""

from __future__ import annotations

import unicodedata

import numpy as np

KINDS = ("email", "phone", "identity", "account", "address", "name")
TAGS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
WINDOW, OVERLAP = 128, 32
# The characters the model tells apart; others fall into classes by Unicode category.
ALPHABET = "abcdefghijklmnopqrstuvwxyz" "ABCDEFGHIJKLMNOPQRSTUVWXYZ" "0123456789" " \n.,;:!?@#&%/\\()[]{}<>*+-=_'\"|~^°º€£$"
_ID = {c: i + 1 for i, c in enumerate(ALPHABET)}
_CLASSES = {"Lu": len(ALPHABET) + 1, "Ll": len(ALPHABET) + 2, "Lo": len(ALPHABET) + 3, "Mn": len(ALPHABET) + 4, "Zs": len(ALPHABET) + 5, "Cf": len(ALPHABET) + 6}
SYMBOLS = len(ALPHABET) + 8


_FOLDED: dict[int, str] = {ord(c): "'" for c in "’ʼ＇‘"}


def fold(text: str) -> str:
    """Full-width and accented characters to their base, one for one, so that offsets stay those of the text."""
    if text.isascii():
        return text
    for ch in {c for c in text if ord(c) > 127 and ord(c) not in _FOLDED}:
        d = unicodedata.normalize("NFKD", ch)
        _FOLDED[ord(ch)] = d[0] if d and (len(d) == 1 or unicodedata.combining(d[1])) else ch
    return text.translate(_FOLDED)


_ASCII = np.array([_ID.get(chr(i)) or SYMBOLS - 1 for i in range(128)], np.int64)


def encode(text: str) -> np.ndarray:
    flat = fold(text)
    if flat.isascii():
        return _ASCII[np.frombuffer(flat.encode(), np.uint8)]
    return np.array([_ID.get(c) or _CLASSES.get(unicodedata.category(c), SYMBOLS - 1) for c in flat], np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def init(hidden: int = 48, embedding: int = 24, seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    n = len(TAGS)
    w = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
    p = {"E": w(SYMBOLS, embedding) * 3, "Wo": w(2 * hidden, n), "bo": np.zeros(n, np.float32), "T": np.zeros((n, n), np.float32), "Ts": np.zeros(n, np.float32), "Te": np.zeros(n, np.float32)}
    for d in "fb":
        p |= {f"Wx{d}": w(embedding, 4 * hidden), f"Wh{d}": w(hidden, 4 * hidden), f"b{d}": np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)}
    return p


def _run(p: dict, ids: np.ndarray, d: str, keep: bool = False):
    """Hidden states (T, B, H) of one direction over ids (T, B); padding is id 0 and leaves the state as it is."""
    steps, batch = ids.shape
    hidden = p["Wh" + d].shape[0]
    table = p["E"] @ p["Wx" + d] + p["b" + d]
    h, c = np.zeros((batch, hidden), np.float32), np.zeros((batch, hidden), np.float32)
    out, cache = np.empty((steps, batch, hidden), np.float32), []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = table[ids[t]] + h @ p["Wh" + d]
        s = _sigmoid(z[:, : 3 * hidden])
        i, f, o = s[:, :hidden], s[:, hidden : 2 * hidden], s[:, 2 * hidden :]
        g = np.tanh(z[:, 3 * hidden :])
        m = (ids[t] > 0)[:, None]
        c2 = np.where(m, f * c + i * g, c)
        tc = np.tanh(c2)
        h2 = np.where(m, o * tc, h)
        if keep:
            cache.append((t, i, f, o, g, c, tc, h, m))
        h, c = h2, c2
        out[t] = h
    return (out, cache) if keep else out


def _states(p: dict, ids: np.ndarray, d: str) -> np.ndarray:
    """Hidden states as in _run, without what training keeps; one tanh gives all gates, since a sigmoid is a shifted tanh."""
    steps, batch = ids.shape
    hidden = p["Wh" + d].shape[0]
    half = np.concatenate([np.full(3 * hidden, 0.5), np.ones(hidden)]).astype(np.float32)
    table, wh = ((p["E"] @ p["Wx" + d] + p["b" + d]) * half).astype(np.float32), (p["Wh" + d] * half).astype(np.float32)
    h, c = np.zeros((batch, hidden), np.float32), np.zeros((batch, hidden), np.float32)
    out = np.empty((steps, batch, hidden), np.float32)
    full = (ids > 0).all(1)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = h @ wh
        z += table[ids[t]]
        np.tanh(z, out=z)
        s = z[:, : 3 * hidden]
        s *= 0.5
        s += 0.5
        c2 = s[:, hidden : 2 * hidden] * c
        c2 += s[:, :hidden] * z[:, 3 * hidden :]
        h2 = np.tanh(c2)
        h2 *= s[:, 2 * hidden :]
        if not full[t]:
            m = (ids[t] > 0)[:, None]
            c2, h2 = np.where(m, c2, c), np.where(m, h2, h)
        h, c = h2, c2
        out[t] = h
    return out


def emissions(p: dict, ids: np.ndarray) -> np.ndarray:
    """(T, B, tags) scores of windows given as columns of ids (T, B)."""
    return np.concatenate([_states(p, ids, "f"), _states(p, ids, "b")], 2) @ p["Wo"] + p["bo"]


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def _crf(p: dict, e: np.ndarray, y: np.ndarray, m: np.ndarray):
    """Loss per window and its gradients by emissions and transitions; e (T, B, n), tags y (T, B), mask m (T, B) of leading ones."""
    steps, batch, n = e.shape
    trans = p["T"]
    alpha = np.empty((steps, batch, n))
    alpha[0] = p["Ts"] + e[0]
    for t in range(1, steps):
        a = _logsumexp(alpha[t - 1][:, :, None] + trans[None], 1) + e[t]
        alpha[t] = np.where(m[t][:, None], a, alpha[t - 1])
    z = _logsumexp(alpha[-1] + p["Te"], 1)
    beta = np.broadcast_to(p["Te"], (batch, n)).copy()
    de, dt = np.zeros_like(e), np.zeros((n, n))
    cols, last = np.arange(batch), m.sum(0).astype(int) - 1
    for t in range(steps - 1, -1, -1):
        mt = m[t][:, None]
        de[t] = np.where(mt, np.exp(alpha[t] + beta - z[:, None]), 0)
        if t:
            inner = e[t] + beta
            pair = np.exp(np.clip(alpha[t - 1][:, :, None] + trans[None] + inner[:, None, :] - z[:, None, None], -60, 60)) * mt[:, :, None]
            dt += pair.sum(0)
            beta = np.where(mt, _logsumexp(trans[None] + inner[:, None, :], 2), beta)
    ds, dte = de[0].sum(0), np.exp(alpha[-1] + p["Te"] - z[:, None]).sum(0)
    gold = p["Ts"][y[0]] + e[0, cols, y[0]] + p["Te"][y[last, cols]]
    np.subtract.at(ds, y[0], 1)
    np.subtract.at(dte, y[last, cols], 1)
    for t in range(steps):
        on = m[t]
        de[t, cols[on], y[t][on]] -= 1
        if t:
            gold = gold + np.where(on, trans[y[t - 1], y[t]] + e[t, cols, y[t]], 0)
            np.subtract.at(dt, (y[t - 1][on], y[t][on]), 1)
    return (z - gold).sum(), de, dt, ds, dte


def _back(p: dict, d: str, ids: np.ndarray, cache: list, dout: np.ndarray, grad: dict) -> None:
    hidden = p["Wh" + d].shape[0]
    dh = dc = np.zeros((ids.shape[1], hidden), np.float32)
    dtable = np.zeros((SYMBOLS, 4 * hidden), np.float32)
    for t, i, f, o, g, c, tc, h, m in reversed(cache):
        dh = dh + dout[t]
        dcc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dcc * g * i * (1 - i), dcc * c * f * (1 - f), dh * tc * o * (1 - o), dcc * i * (1 - g * g)], 1) * m
        grad["Wh" + d] += h.T @ dz
        np.add.at(dtable, ids[t], dz)
        dh = np.where(m, dz @ p["Wh" + d].T, dh)
        dc = np.where(m, dcc * f, dc)
    grad["E"] += dtable @ p["Wx" + d].T
    grad["Wx" + d] += p["E"].T @ dtable
    grad["b" + d] += dtable.sum(0)


def step(p: dict, ids: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Loss per character and gradients of one batch of windows (T, B)."""
    m = ids > 0
    hf, cf = _run(p, ids, "f", True)
    hb, cb = _run(p, ids, "b", True)
    both = np.concatenate([hf, hb], 2)
    loss, de, dt, ds, dte = _crf(p, both @ p["Wo"] + p["bo"], y, m)
    de = (de / ids.shape[1]).astype(np.float32)
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    grad["Wo"] = np.tensordot(both, de, ([0, 1], [0, 1]))
    grad["bo"] = de.sum((0, 1))
    for k, v in (("T", dt), ("Ts", ds), ("Te", dte)):
        grad[k] = (v / ids.shape[1]).astype(np.float32)
    dboth = de @ p["Wo"].T
    hidden = hf.shape[2]
    _back(p, "f", ids, cf, dboth[:, :, :hidden], grad)
    _back(p, "b", ids, cb, dboth[:, :, hidden:], grad)
    return loss / m.sum(), grad


def windows(length: int, window: int = WINDOW, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Begin and end of overlapping windows that cover a text."""
    stride = window - overlap
    return [(b, min(b + window, length)) for b in range(0, max(length - overlap, 1), stride)]


def spans(tags: np.ndarray) -> list[tuple[str, int, int]]:
    """(kind, begin, end) of a sequence of tag numbers."""
    out, now = [], None
    for i, t in enumerate([*tags.tolist(), 0]):
        name = TAGS[t]
        if now and name != f"I-{now[0]}":
            out.append((now[0], now[1], i))
            now = None
        if name[0] == "B" or (name[0] == "I" and not now):
            now = (name[2:], i)
    return out


def viterbi(p: dict, scores: list[np.ndarray]) -> list[np.ndarray]:
    """The best tags of each text; texts of like length are decoded in step."""
    n = len(TAGS)
    allowed = np.array([[not TAGS[j].startswith("I") or TAGS[i][2:] == TAGS[j][2:] for j in range(n)] for i in range(n)])
    trans = np.where(allowed, p["T"], -1e4).astype(np.float32).T[None]  # (1, to, from)
    start = p["Ts"] + np.array([-1e4 if t.startswith("I") else 0 for t in TAGS], np.float32)
    out: list = [None] * len(scores)
    order, at = sorted(range(len(scores)), key=lambda k: len(scores[k])), 0
    while at < len(order):
        longest = len(scores[order[at]])
        part = [order[at]]
        while at + len(part) < len(order) and len(part) < 128 and len(scores[order[at + len(part)]]) <= longest * 1.25 + 8:
            part.append(order[at + len(part)])
        at += len(part)
        steps, cols = len(scores[part[-1]]), np.arange(len(part))
        e = np.zeros((steps, len(part), n), np.float32)
        for col, k in enumerate(part):
            e[: len(scores[k]), col] = scores[k]
        ends = np.array([len(scores[k]) - 1 for k in part])
        score, back, last = start + e[0], np.empty((steps, len(part), n), np.int8), np.empty(len(part), np.int64)
        for t in range(steps):
            if t:
                every = score[:, None, :] + trans
                back[t] = best = every.argmax(2)
                score = np.take_along_axis(every, best[:, :, None], 2)[:, :, 0] + e[t]
            for col in np.flatnonzero(ends == t):
                last[col] = (score[col] + p["Te"]).argmax()
        path = np.zeros((steps, len(part)), np.int64)
        now = last.copy()
        for t in range(steps - 1, -1, -1):
            now = np.where(ends == t, last, now)
            path[t] = now
            if t:
                now = np.where(ends >= t, back[t, cols, now], now)
        for col, k in enumerate(part):
            out[k] = path[: len(scores[k]), col]
    return out


def margin(p: dict) -> float:
    """By how much O must lead every other tag at every character of a text for the path of O alone to be the best one, whatever the transitions: m other
    tags in a row lose m times this much and win at most m + 1 of the greatest gains of a transition, begin or end over O's."""
    n = len(TAGS)
    gains = [p["T"][i, j] - p["T"][0, 0] for i in range(n) for j in range(n) if (i or j) and (not TAGS[j].startswith("I") or TAGS[i][2:] == TAGS[j][2:])]
    return 2 * float(max(0.0, max(gains), p["Ts"].max() - p["Ts"][0], p["Te"].max() - p["Te"][0]))


def decode(p: dict, texts: list[str], batch: int = 384) -> list[list[tuple[str, int, int]]]:
    """Spans of each text. Windows of all texts are scored in batches of like length; each text is decoded as a whole."""
    coded = [encode(t) for t in texts]
    jobs = sorted(((k, b, e) for k, c in enumerate(coded) if len(c) for b, e in windows(len(c))), key=lambda j: j[2] - j[1])
    total = [np.zeros((len(c), len(TAGS)), np.float32) for c in coded]
    weight = [np.zeros(len(c), np.float32) for c in coded]
    for at in range(0, len(jobs), batch):
        part = jobs[at : at + batch]
        ids = np.zeros((max(e - b for _, b, e in part), len(part)), np.int64)
        for col, (k, b, e) in enumerate(part):
            ids[: e - b, col] = coded[k][b:e]
        scores = emissions(p, ids)
        for col, (k, b, e) in enumerate(part):
            size = e - b
            w = np.minimum(np.arange(1, size + 1), np.arange(size, 0, -1)).astype(np.float32)
            if b == 0:
                w[: size // 2] = size
            if e == len(coded[k]):
                w[size // 2 :] = size
            total[k][b:e] += scores[:size, col] * w[:, None]
            weight[k][b:e] += w
    scores = [s / w[:, None] if len(w) else s for s, w in zip(total, weight)]
    lead = margin(p)  # texts in which O leads by so much throughout have no spans, and needn't be decoded to know it
    worth = [k for k, e in enumerate(scores) if len(e) and (e[:, 1:].max(1) > e[:, 0] - lead).any()]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for k, tags in zip(worth, viterbi(p, [scores[k] for k in worth])):
        out[k] = spans(tags)
    return out


def fit(examples: list[tuple[str, list[tuple[str, int, int]]]], *, epochs: int = 8, batch: int = 64, rate: float = 4e-3, window: int = 96, seed: int = 7, minutes: float = 15, start: dict | None = None, log=print) -> dict[str, np.ndarray]:
    """Adam over windows of labelled texts: (text, [(kind, begin, end)]); `start` goes on from earlier weights."""
    import time

    number = {t: i for i, t in enumerate(TAGS)}
    r, jobs = np.random.default_rng(seed), []
    for text, found in examples:
        ids, y = encode(text), np.zeros(len(text), np.int64)
        for kind, b, e in found:
            y[b:e] = number["I-" + kind]
            y[b] = number["B-" + kind]
        jobs += [(ids[b:e], y[b:e]) for b, e in windows(len(ids), window, 24) if e > b]
    p = {k: v.copy() for k, v in start.items()} if start else init(seed=seed)
    mean, var, n, began = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0, time.time()
    average = {k: v.copy() for k, v in p.items()}
    steps = epochs * (len(jobs) // batch + 1)
    for epoch in range(epochs):
        order = r.permutation(len(jobs))
        chunks = [sorted(order[a : a + batch * 16], key=lambda j: len(jobs[j][0])) for a in range(0, len(order), batch * 16)]
        parts = [c[a : a + batch] for c in chunks for a in range(0, len(c), batch)]
        r.shuffle(parts)
        seen = 0.0
        for part in parts:
            ids = np.zeros((max(len(jobs[j][0]) for j in part), len(part)), np.int64)
            y = np.zeros_like(ids)
            for col, j in enumerate(part):
                ids[: len(jobs[j][0]), col], y[: len(jobs[j][0]), col] = jobs[j]
            loss, grad = step(p, ids, y)
            seen += loss
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            n += 1
            lr = rate * min(1, n / 50) * max(0.05, 1 - n / steps)
            for k, g in grad.items():
                g = g * min(1, 5 / (norm + 1e-9))
                mean[k] = 0.9 * mean[k] + 0.1 * g
                var[k] = 0.999 * var[k] + 0.001 * g * g
                p[k] -= (lr * (mean[k] / (1 - 0.9**n)) / (np.sqrt(var[k] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)
                average[k] += (p[k] - average[k]) * np.float32(max(0.002, 1 / n))
        log(f"epoch {epoch + 1}: loss per character {seen / len(parts):.5f}, {time.time() - began:.0f} s")
        if time.time() - began > 60 * minutes:
            break
    return {k: v.astype(np.float32) for k, v in average.items()}
