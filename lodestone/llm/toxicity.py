"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Each word is read as a vector of its own (hashed table) and as the elementwise maximum
of the vectors of its character n-grams, so that it is recognised by its parts as well.
Two gated recurrent layers, one in each direction, read windows of ``WINDOW`` words; an
attention layer pools their states into one logit. Windows overlap by half and cover the
whole text; a document's logit is that of its highest window, calibrated on documents
that the fit left out.

The network is fitted in one task on a bounded sample: at most ``MAX_TOXIC`` and
``MAX_CLEAN`` labelled documents of at most ``MAX_SAMPLE_BYTES`` each, taken in the order of a
hash of their id, of those whose crc32(id as text) mod 3 is not 1 (of an id that is repeated,
the first text). Of a toxic document the window that scores highest is
its example (the label says that some window is toxic), of a clean one the highest and a
random one. Neither labels, language, source nor ids are inputs of a score.

Null and empty texts, and texts without a word, score 0.0. Without labels of both kinds
all scores are 0.0. Repeated rows score alike. Repeated labels count once, null ones and
those without an id are ignored; a row without an id is scored and not held out. Empty tables
give empty results; a very long text is scored in all its windows. A column that has the
score's name is replaced by it; ``drop_toxic`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, compress
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map, fields, fresh, released, sliced, text_or_empty

WINDOW, STRIDE = 32, 16
MAX_TOXIC, MAX_CLEAN = 1200, 1800
#: Longer texts are scored but not fitted on, so the sample is bounded in bytes too.
MAX_SAMPLE_BYTES = 1 << 15
THRESHOLD = 0.7
HIDDEN, WORD_DIM, CHAR_DIM, ATTEND = 8, 8, 12, 8
WORD_ROWS, GRAM_ROWS = 1 << 14, 1 << 16
#: Lengths in bytes of n-grams taken anywhere in a word, and of its beginnings.
GRAMS, BEGINNINGS = (3, 4, 5), (6, 7, 8, 9, 10)
EPOCHS, BATCH, RATE = 5, 128, 0.01
#: Small samples are gone through more often, until there are so many steps (or epochs).
STEPS, MOST_EPOCHS = 180, 25
#: Words that a task remembers; beyond it the table starts anew.
CACHE_WORDS = 100_000
#: Words whose n-grams are expanded at once.
CHUNK_WORDS = 8192
WORD = re.compile(r"\w+")


def held_out(id_col: Column) -> Column:
    """Whether a label is kept from the fit."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of all words (framed by ^ and $), and each one's word; by word."""
    framed = [b"^" + w + b"$" for w in words]
    lengths = np.array([len(w) for w in framed], dtype=np.int64)
    data = np.frombuffer(b"".join(framed), dtype=np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(data))  # characters from here to the word's end
    h = np.zeros(len(data), dtype=np.uint32)
    found, of = [], []
    first = left == np.repeat(lengths, lengths)
    for n in range(1, max(BEGINNINGS) + 1):
        if n == len(GRAMS) + 3:
            # Longer ones are beginnings of words only.
            places = np.flatnonzero(first)
            h, left, owner = h[places], left[places], owner[places]
        elif n < len(GRAMS) + 3:
            places = np.arange(len(data))
        h = h * np.uint32(0x01000193) + data[np.minimum(places + n - 1, len(data) - 1)]
        if n >= min(GRAMS):
            ok = left >= n
            x = h[ok] + np.uint32(n)
            x = (x ^ x >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
            found.append((x ^ x >> np.uint32(13)) % np.uint32(GRAM_ROWS))
            of.append(owner[ok])
    grams, of_word = np.concatenate(found), np.concatenate(of)
    order = np.argsort(of_word, kind="stable")
    return grams[order], of_word[order]


def word_rows(words: list[bytes]) -> np.ndarray:
    return np.array([zlib.crc32(w) % WORD_ROWS for w in words], dtype=np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(1) / (np.float32(1) + np.exp(-x))


class Network:
    """Parameters, forward and backward pass."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.Generator(np.random.PCG64(seed))
        f = lambda *shape, scale: r.normal(0, scale, shape).astype(np.float32)
        width = WORD_DIM + CHAR_DIM
        self.p = {
            "words": f(WORD_ROWS, WORD_DIM, scale=0.05),
            "grams": f(GRAM_ROWS, CHAR_DIM, scale=0.05),
            "Wa": f(2 * HIDDEN, ATTEND, scale=0.3),
            "va": f(ATTEND, scale=0.3),
            "wo": f(2 * HIDDEN, scale=0.3),
            "bo": np.zeros(1, dtype=np.float32),
        }
        for d in "fb":
            self.p |= {f"W{d}": f(width, 3 * HIDDEN, scale=0.3), f"U{d}": f(HIDDEN, 3 * HIDDEN, scale=0.3), f"b{d}": np.zeros(3 * HIDDEN, dtype=np.float32)}
        self.scale = (1.0, 0.0)
        self.fitted = False

    def word_vectors(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        """One vector per word, and what the backward pass needs."""
        rows = word_rows(words)
        grams, owner = grams_of(words)
        starts = np.searchsorted(owner, np.arange(len(words)))
        values = self.p["grams"][grams]
        top = np.maximum.reduceat(values, starts, axis=0)
        return np.concatenate([self.p["words"][rows], top], axis=1), (rows, grams, owner, values, top)

    def projections_of(self, words: list[bytes]) -> dict[str, np.ndarray]:
        """The projections of many words, a block at a time into one table."""
        out = self.projections(np.zeros((0, WORD_DIM + CHAR_DIM), dtype=np.float32))
        out = {d: np.concatenate([pad, np.empty((len(words), 3 * HIDDEN), dtype=np.float32)]) for d, pad in out.items()}
        for a in range(0, len(words), CHUNK_WORDS):
            for d, own in self.projections(self.word_vectors(words[a : a + CHUNK_WORDS])[0]).items():
                out[d][1 + a : a + len(own)] = own[1:]
        return out

    def projections(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Each word's share of the gates, by direction; row 0 is the pad, which keeps the state."""
        out = {}
        for d in "fb":
            pad = np.zeros((1, 3 * HIDDEN), dtype=np.float32)
            pad[:, HIDDEN : 2 * HIDDEN] = 30
            out[d] = np.concatenate([pad, x @ self.p[f"W{d}"] + self.p[f"b{d}"]])
        return out

    def forward(self, projected: dict[str, np.ndarray], index: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of windows of word rows (``index``: windows x WINDOW, 0 for the pad)."""
        n, t = index.shape
        states = np.empty((t, n, 2 * HIDDEN), dtype=np.float32)
        tape: dict = {"fb"[k]: [] for k in range(2)}
        for k, d in enumerate("fb"):
            h = np.zeros((n, HIDDEN), dtype=np.float32)
            u = self.p[f"U{d}"]
            for step in range(t) if d == "f" else range(t - 1, -1, -1):
                x = projected[d][index[:, step]]
                hu = h @ u
                rz = sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
                r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
                c = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
                new = c + z * (h - c)
                if keep:
                    tape[d].append((step, h, hu, r, z, c))
                h = new
                states[step, :, k * HIDDEN : (k + 1) * HIDDEN] = h
        a = np.tanh(states @ self.p["Wa"])
        e = a @ self.p["va"]
        e = np.where(index.T > 0, e, np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = (alpha[:, :, None] * states).sum(axis=0)
        logits = pooled @ self.p["wo"] + self.p["bo"]
        tape |= {"states": states, "a": a, "alpha": alpha, "pooled": pooled}
        return logits, tape

    def backward(self, tape: dict, index: np.ndarray, dlogits: np.ndarray, n_words: int) -> tuple[dict, dict[str, np.ndarray]]:
        """Gradients of the dense parameters, and of the words' projections by direction."""
        g = {"wo": tape["pooled"].T @ dlogits, "bo": dlogits.sum(keepdims=True)}
        states, a, alpha = tape["states"], tape["a"], tape["alpha"]
        dpooled = dlogits[:, None] * self.p["wo"]
        dalpha = (states * dpooled).sum(axis=2)
        de = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        g["va"] = (a * de[:, :, None]).sum(axis=(0, 1))
        da = de[:, :, None] * self.p["va"] * (1 - a * a)
        g["Wa"] = np.einsum("tnh,tna->ha", states, da)
        dstates = alpha[:, :, None] * dpooled + da @ self.p["Wa"].T
        dproj = {}
        for k, d in enumerate("fb"):
            u = self.p[f"U{d}"]
            du, dx = np.zeros_like(u), np.zeros((n_words + 1, 3 * HIDDEN), dtype=np.float32)
            dh = np.zeros((index.shape[0], HIDDEN), dtype=np.float32)
            for step, h, hu, r, z, c in reversed(tape[d]):
                dh = dh + dstates[step, :, k * HIDDEN : (k + 1) * HIDDEN]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * hu[:, 2 * HIDDEN :] * r * (1 - r)
                dhu = np.concatenate([dr, dz, dc * r], axis=1)
                np.add.at(dx, index[:, step], np.concatenate([dr, dz, dc], axis=1))
                du += h.T @ dhu
                dh = dh * z + dhu @ u.T
            g[f"U{d}"], dproj[d] = du, dx[1:]
        return g, dproj


def windows_of(rows: np.ndarray) -> np.ndarray:
    """All overlapping windows over a text's word rows; short texts are padded with 0."""
    n = max(1, -(-(len(rows) - WINDOW) // STRIDE) + 1) if len(rows) > WINDOW else 1
    padded = np.zeros((n - 1) * STRIDE + WINDOW, dtype=np.int32)
    padded[: len(rows)] = rows
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def words_of(text: str | None) -> list[str]:
    """Lower-case words; a word said over and over counts once, or it would fill a window alone."""
    words = WORD.findall(text.lower()) if text else []
    return list(compress(words, map(ne, words, chain(words[1:], (None,)))))


class Scorer:
    """Scores texts; words met before are taken from a bounded table."""

    def __init__(self, network: Network) -> None:
        self.network = network
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.table = self.network.projections(np.zeros((0, WORD_DIM + CHAR_DIM), dtype=np.float32))

    def learn(self, words: list[str]) -> None:
        encoded = [w.encode("utf-8", "surrogatepass") for w in words]
        base = len(self.index) + 1
        self.index.update(zip(words, range(base, base + len(words))))
        new = self.network.projections_of(encoded)
        self.table = {d: np.concatenate([self.table[d], new[d][1:]]) for d in "fb"}

    def window_logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Logits of all windows, each one's text, and the texts' windows."""
        if len(self.index) > CACHE_WORDS:
            self.forget()
        cut = [words_of(t) for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.index)
        if new:
            self.learn(list(new))
        index = self.index
        found = [windows_of(np.fromiter(map(index.__getitem__, w), dtype=np.int64, count=len(w))) for w in cut]
        owner = np.repeat(np.arange(len(found)), [len(w) for w in found])
        every = np.concatenate(found) if found else np.zeros((0, WINDOW), dtype=np.int32)
        logits = np.concatenate([self.network.forward(self.table, every[a : a + 4096])[0] for a in range(0, len(every), 4096)]) if len(every) else np.zeros(0)
        return logits, owner, found

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.network.fitted or not len(texts):
            return np.zeros(len(texts))
        logits, owner, found = self.window_logits(texts)
        top = np.maximum.reduceat(logits.astype(np.float64), np.searchsorted(owner, np.arange(len(texts))))
        a, b = self.network.scale
        empty = np.array([not w[0].any() for w in found])
        return np.where(empty, 0.0, 1 / (1 + np.exp(-np.clip(a * top + b, -40, 40))))


def _log_odds(features: Iterable[np.ndarray], labels: np.ndarray, rows: int) -> np.ndarray:
    """Of each feature: how much likelier a toxic text holds it, as a log ratio; 0 if rare.

    The ratio less its standard error, so that what chance may have done counts less.
    """
    seen = np.zeros((2, rows))
    for f, y in zip(features, labels, strict=True):
        seen[int(y), f] += 1
    of = [max(1, int((labels == y).sum())) for y in (0, 1)]
    ratio = np.log((seen[1] + 0.5) / (of[1] + 1)) - np.log((seen[0] + 0.5) / (of[0] + 1))
    ratio -= np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5))
    # What few toxic texts hold (a group of copies, say) may be chance.
    return np.where(seen[1] >= max(4, of[1] // 50), np.clip(ratio, 0, 6), 0).astype(np.float32)


def fit(texts: Iterable[str], labels: np.ndarray, toxic_share: float | None = None, seed: int = 7) -> Network:
    """The network fitted on labelled texts; unfitted if a label is missing.

    ``toxic_share`` is the share of toxic texts among those to be scored, if the sample's
    differs: the calibrated odds are corrected by it.
    """
    net = Network(seed)
    index: dict[str, int] = {}
    texts_rows = []
    for text in texts:
        # Each text becomes numbers at once: lists of words would take most of the memory.
        words = words_of(text)
        texts_rows.append(np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int32, count=len(words)))
    usable = np.array([len(t) > 0 for t in texts_rows], dtype=bool)
    labels = np.asarray(labels)[usable].astype(np.int64)
    texts_rows = [t for t in texts_rows if len(t)]
    n_texts = len(texts_rows)
    if n_texts < 20 or labels.min() == labels.max():
        return net
    r = np.random.Generator(np.random.PCG64(seed))
    encoded = [w.encode("utf-8", "surrogatepass") for w in index]
    rows = word_rows(encoded)
    del index
    grams, bounds = [], []  # by blocks of words
    for at in range(0, len(encoded), CHUNK_WORDS):
        own, owner = grams_of(encoded[at : at + CHUNK_WORDS])
        grams.append(own)
        bounds.append(np.concatenate([[0], np.cumsum(np.bincount(owner))]))
    aside = r.random(n_texts) < 0.2  # for the calibration
    train = np.flatnonzero(~aside)

    def grams_in(words: np.ndarray) -> np.ndarray:
        places = [divmod(w, CHUNK_WORDS) for w in np.unique(words).tolist()]
        return np.unique(np.concatenate([grams[c][bounds[c][k] : bounds[c][k + 1]] for c, k in places]))

    # A first guess of each part's weight, from the texts that hold it, finds the windows.
    net.p["grams"][:, 0] += _log_odds((grams_in(texts_rows[k]) for k in train), labels[train], GRAM_ROWS) * 0.75
    net.p["words"][:, 0] += _log_odds((np.unique(rows[texts_rows[k]]) for k in train), labels[train], WORD_ROWS) * 0.75
    del grams, bounds
    windows = [windows_of(t + 1) for t in texts_rows]
    moments = {k: np.zeros_like(v) for k, v in net.p.items()}
    squares = {k: np.zeros_like(v) for k, v in net.p.items()}
    steps = 0
    # Toxic examples are fewer; they count as many as the clean ones, up to a factor of 4.
    weight = np.float32(min(4.0, 2 * (len(train) - labels[train].sum()) / max(1, labels[train].sum())))

    def all_logits() -> list[np.ndarray]:
        if steps == 0:
            guess = [np.zeros(1)]
            for at in range(0, len(encoded), CHUNK_WORDS):
                x = net.word_vectors(encoded[at : at + CHUNK_WORDS])[0]
                guess.append(x[:, 0] + x[:, WORD_DIM])
            guess = np.concatenate(guess)
            return [guess[w].max(axis=1) for w in windows]
        table = net.projections_of(encoded)
        every = np.concatenate(windows)
        flat = np.concatenate([net.forward(table, every[a : a + 2048])[0] for a in range(0, len(every), 2048)])
        return np.split(flat, np.cumsum([len(w) for w in windows])[:-1])

    per_epoch = -(-int((2 - labels[train]).sum()) // BATCH)
    for _ in range(min(MOST_EPOCHS, max(EPOCHS, -(-STEPS // per_epoch)))):
        now = all_logits()
        released()
        examples, targets = [], []
        for k in train:
            examples.append(windows[k][now[k].argmax()])
            targets.append(labels[k])
            if not labels[k]:
                examples.append(windows[k][r.integers(len(windows[k]))])
                targets.append(0)
        order = r.permutation(len(examples))
        examples, targets = np.array(examples)[order], np.array(targets, dtype=np.float32)[order]
        for at in range(0, len(examples), BATCH):
            batch, y = examples[at : at + BATCH], targets[at : at + BATCH]
            some, local = np.unique(batch, return_inverse=True)
            local = local.reshape(batch.shape)
            if some[0] != 0:
                some, local = np.concatenate([[0], some]), local + 1
            x, (w_rows, g_rows, g_owner, values, top) = net.word_vectors([encoded[s - 1] for s in some[1:]])
            logits, tape = net.forward(net.projections(x), local, keep=True)
            d = ((sigmoid(logits) - y) * np.where(y > 0, weight, 1) / len(y)).astype(np.float32)
            grads, dproj = net.backward(tape, local, d, len(x))
            dx = np.zeros_like(x)
            for k in "fb":
                grads[f"W{k}"], grads[f"b{k}"] = x.T @ dproj[k], dproj[k].sum(axis=0)
                dx += dproj[k] @ net.p[f"W{k}"].T
            dwords, dgrams = np.zeros_like(net.p["words"]), np.zeros_like(net.p["grams"])
            np.add.at(dwords, w_rows, dx[:, :WORD_DIM])
            won = values == top[g_owner]
            gram_at, dim = np.nonzero(won)
            np.add.at(dgrams, (g_rows[gram_at], dim), dx[g_owner[gram_at], WORD_DIM + dim])
            grads |= {"words": dwords, "grams": dgrams}
            steps += 1
            for k, g in grads.items():
                # Adam; rows without a gradient rest.
                live = slice(None) if k not in ("words", "grams") else np.flatnonzero(g.any(axis=1))
                moments[k][live] = 0.9 * moments[k][live] + 0.1 * g[live]
                squares[k][live] = 0.99 * squares[k][live] + 0.01 * g[live] ** 2
                bias = np.sqrt(1 - 0.99**steps) / (1 - 0.9**steps)
                net.p[k][live] -= RATE * bias * moments[k][live] / (np.sqrt(squares[k][live]) + 1e-6)
    top = np.array([x.max() for x in all_logits()], dtype=np.float64)
    net.scale = _calibrated(top[aside], labels[aside]) if 0 < labels[aside].sum() < aside.sum() else (1.0, 0.0)
    if toxic_share:
        own = labels.mean()
        shift = np.log(toxic_share / (1 - toxic_share)) - np.log(own / (1 - own))
        net.scale = (net.scale[0], net.scale[1] + float(shift))
    net.fitted = True
    return net


def _calibrated(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> tuple[float, float]:
    """Logistic calibration a * x + b by Newton steps, with the usual smoothed targets; each example counts ``n`` times."""
    n = np.ones(len(x)) if n is None else n
    target = np.where(y == 1, ((n * y).sum() + 1) / ((n * y).sum() + 2), 1 / ((n * (1 - y)).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        w = n * np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(n * (p - target) * x).sum() + 1e-3 * (a - 1), (n * (p - target)).sum()])
        hess = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        norm = float(np.abs(step).max())
        step *= min(1.0, 2.0 / max(norm, 1e-9))
        a, b = a - step[0], b - step[1]
        if norm < 1e-6:
            break
    return (float(max(a, 1e-3)), float(b))


def _labelled(labels: DataFrame, id_col: str) -> DataFrame:
    """``__id, toxic``: the labels that a fit may use."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    return usable.select(F.col(id_col).alias("__id"), "toxic").distinct()


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The bounded sample of labelled texts: ``__id, toxic, text``."""
    usable = _labelled(labels, id_col)
    order = [F.xxhash64("__id"), F.col("__id")]
    picked = [usable.where(f"toxic = {y}").orderBy(*order).limit(n) for y, n in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    sample = picked[0].unionByName(picked[1])
    text = text_or_empty(text_col)
    short = docs.where(F.octet_length(text) <= MAX_SAMPLE_BYTES).select(F.col(id_col).alias("__own"), text.alias("text"))
    # At most MAX_TOXIC + MAX_CLEAN ids are broadcast.
    found = short.join(F.broadcast(sample), F.col("__own") == F.col("__id"))
    return found.groupBy("__id", "toxic").agg(F.min("text").alias("text"))


def score_toxicity(
    docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text", score_col: str = "__score"
) -> DataFrame:
    """``docs`` with its columns and the score."""
    model = docs.sparkSession.sparkContext.broadcast(network)
    names = [c for c in docs.columns if c != score_col]
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for whole in batches:
            for batch in sliced(whole, at, 250):
                scores = pa.array(scorer.scores(batch.column(at).to_pylist()), pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*names, score_col])

    own = docs.select(*[F.col(f"`{c}`") for c in names])
    return arrow_map(own, run, f"{fields(docs, names)}, `{score_col}` double")


def fitted_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """The network fitted on the bounded sample of ``docs`` that have labels.

    One task fits it, so the texts never reach the driver; a lost executor repeats that task.
    """
    sample = training_sample(docs, labels, id_col, text_col)
    share = _labelled(labels, id_col).agg(F.avg("toxic")).first()[0]
    toxic_share = share if share and share < 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        texts = (text.as_py() for batch in held for text in batch.column(0))
        toxic = [y for batch in held for y in batch.column(1).to_pylist()]
        network = fit(texts, np.array(toxic, dtype=np.int64), toxic_share)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(network)], pa.binary())], names=["network"])

    in_order = sample.repartition(1).sortWithinPartitions("__id", "toxic").select("text", "toxic")
    made = arrow_map(in_order, run, "network binary").first()
    return pickle.loads(made["network"]) if made else Network()


def drop_toxic(docs: DataFrame, network: Network, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents below the threshold, with their own columns."""
    score = fresh(docs, "__score")
    scored = score_toxicity(docs, network, id_col, text_col, score)
    return scored.where(F.col(score) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
