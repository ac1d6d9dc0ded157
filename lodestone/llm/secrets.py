"""Secret scan: patterns give findings, a character convolutional network adds to them.

Base findings, leftmost and non-overlapping per kind: ``assign`` (a keyword, a sign and a
value of 8 or more characters), ``access`` (AKIA keys of 16 or more) and ``hex`` (32 or
more). Every other candidate (a run of 8 or more key characters with a digit among its
first 20, or of 20 or more) is scored, with the characters around it, by a convolutional
network in numpy; of a long run all overlapping windows, and the highest counts.

The network is trained on labelled findings. Positive are base findings and made-up keys of
several formats (``FORMATS``); negative are the corpus' other candidates and made-up
look-alikes (numbers, dates, paths, names). Made-up values stand in surroundings taken from
the corpus' candidates of either label. Every distinct window of the corpus is learnt from: tasks
of some ``EXAMPLES`` windows learn side by side, each with some ``MADE_UP`` made-up ones of either label (in
proportion to its windows), and their parameters are averaged after each of ``ROUNDS`` rounds (few windows are one task). Of half the examples
the surroundings are blanked, so that the value itself must tell. Logits are calibrated on
all examples left out, a quarter, and the threshold is the highest that keeps ``RECALL`` of the positives
among them (from counts by logit, in steps of 1/``STEPS``, where there is more than one task). A candidate at
or above it that meets no base finding becomes a ``learned`` span.

Null and empty texts have no findings. Without corpus examples of both labels the network
has made-up ones only. Repeated rows are scanned each, null ids pass through, an empty
table gives an empty result; very long texts and runs are read whole; columns other than id
and text are ignored.

Every text is read once; the scan's table (spans and candidates with their
surroundings) is stored, and learning and scoring use that table only. Only parameters and counts by
logit reach the driver.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map, sliced, stored, text_or_empty
from lodestone.llm.toxicity import _calibrated, sigmoid

KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A run of key characters that holds a digit early on or is long.
CANDIDATE = re.compile(
    r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z0-9+/_.=-]{20}|[A-Za-z+/_.=-]{0,19}[0-9])[A-Za-z0-9+/_.=-]{8,}"
)
#: Windows that a task learns from, and how often tasks that learn side by side are averaged.
EXAMPLES, ROUNDS, EPOCHS = 6000, 4, 8
MADE_UP = 1500
#: Calibration counts: steps per unit of a logit, and the largest logit.
STEPS, MOST = 64, 40
RECALL = 0.98
BEFORE, VALUE, AFTER = 20, 40, 8
SCAN_SCHEMA = "base array<struct<kind:string,start:int,end:int>>, candidates array<struct<start:int,end:int,shown:array<string>,known:boolean>>"

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
Draw = Callable[[str, int, int], str]


def _drawer(r: np.random.Generator) -> Draw:
    """``draw(alphabet, least, most)``: a random string."""
    return lambda alphabet, least, most: "".join(alphabet[k] for k in r.integers(0, len(alphabet), int(r.integers(least, most + 1))))


ALNUM = LOWER + UPPER + DIGITS
#: Made-up keys by format.
FORMATS: dict[str, Callable[[Draw], str]] = {
    "mixed": lambda draw: draw(ALNUM, 20, 64),
    "letters": lambda draw: draw(LOWER + UPPER, 24, 48),
    "lower": lambda draw: draw(LOWER + DIGITS, 20, 40),
    "upper": lambda draw: draw(UPPER + DIGITS, 20, 40),
    "base64": lambda draw: draw(ALNUM + "+/", 22, 88) + "=" * (len(draw("x", 0, 2))),
    "url64": lambda draw: draw(ALNUM + "_-", 20, 64),
    "big_hex": lambda draw: draw(DIGITS + "ABCDEF", 32, 64),
    "short_hex": lambda draw: draw(DIGITS + "abcdef", 20, 31),
    "web_token": lambda draw: f"eyJ{draw(ALNUM, 17, 30)}.eyJ{draw(ALNUM, 30, 90)}.{draw(ALNUM + '_-', 43, 43)}",
    "payment": lambda draw: f"sk_{('live', 'test')[len(draw('x', 0, 1))]}_{draw(ALNUM, 24, 32)}",
    "code_host": lambda draw: f"gh{draw('pousr', 1, 1)}_{draw(ALNUM, 36, 36)}",
    "chat": lambda draw: f"xox{draw('abp', 1, 1)}-{draw(DIGITS, 10, 12)}-{draw(DIGITS, 10, 12)}-{draw(ALNUM, 24, 24)}",
    "maps": lambda draw: f"AIza{draw(ALNUM + '_-', 35, 35)}",
    "packages": lambda draw: f"npm_{draw(ALNUM, 36, 36)}",
}


def _word(draw: Draw) -> str:
    """A made-up word: syllables of a consonant or two and a vowel."""
    return "".join(draw("bcdfghklmnprstvw", 1, 2) + draw("aeiou", 1, 1) for _ in draw("x", 2, 5))


#: Made-up look-alikes that are no keys.
LOOKALIKES: dict[str, Callable[[Draw], str]] = {
    "number": lambda draw: draw(DIGITS, 8, 24),
    "grouped": lambda draw: "-".join(draw(DIGITS, 2, 5) for _ in draw("x", 3, 5)),
    "decimal": lambda draw: f"{draw(DIGITS, 1, 9)}.{draw(DIGITS, 2, 14)}",
    "date": lambda draw: f"20{draw(DIGITS, 2, 2)}-0{draw('123456789', 1, 1)}-1{draw(DIGITS, 1, 1)}T0{draw(DIGITS, 1, 1)}",
    "version": lambda draw: f"{_word(draw)}-{draw(DIGITS, 1, 2)}.{draw(DIGITS, 1, 2)}.{draw(DIGITS, 1, 3)}",
    "path": lambda draw: "/".join(_word(draw) for _ in draw("x", 3, 6)) + f"/{_word(draw)}{draw(DIGITS, 0, 3)}.{draw(LOWER, 2, 4)}",
    "name": lambda draw: "_".join(_word(draw) for _ in draw("x", 3, 6)) + draw(DIGITS, 0, 2),
    "dashed": lambda draw: "-".join(_word(draw) for _ in draw("x", 3, 6)),
    "host": lambda draw: f"{_word(draw)}{draw(DIGITS, 0, 4)}.{_word(draw)}.{_word(draw)}.org",
    "camel": lambda draw: "".join(_word(draw).capitalize() for _ in draw("x", 3, 6)) + draw(DIGITS, 0, 2),
    "long_word": lambda draw: "".join(_word(draw) for _ in draw("x", 3, 7)),
    "numbered": lambda draw: f"{_word(draw)}{_word(draw)}{draw(DIGITS, 1, 6)}",
    "rule": lambda draw: draw("-=_.", 1, 1) * (20 + len(draw("x", 0, 40))),
}


def base_findings(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


def window(before: str, value: str, after: str) -> str:
    """The fixed window that the network reads."""
    return before[-BEFORE:].rjust(BEFORE, "\0") + value[:VALUE].ljust(VALUE, "\0") + after[:AFTER].ljust(AFTER, "\0")


def shown(text: str, start: int, end: int) -> list[str]:
    """All windows over the value, half overlapping; one if it is short."""
    starts = [*range(start, max(start + 1, end - VALUE), VALUE // 2), *([end - VALUE] if end - start > VALUE else [])]
    cuts = [(at, min(end, at + VALUE)) for at in starts]
    return [window(text[max(0, a - BEFORE) : a], text[a:b], text[b : b + AFTER]) for a, b in cuts]


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, list[str], bool]]:
    """``(start, end, windows, whether base)`` of everything that the network looks at."""
    out, k, reached = [], 0, 0
    for m in CANDIDATE.finditer(text):
        # Base findings by start: those that begin before the candidate's end, and how far they reach.
        while k < len(base) and base[k][1] < m.end():
            reached = max(reached, base[k][2])
            k += 1
        out.append((m.start(), m.end(), shown(text, m.start(), m.end()), reached > m.start()))
    return out


def made_up(formats: dict[str, Callable[[Draw], str]], n: int, contexts: Sequence[str], r: np.random.Generator) -> list[str]:
    """Windows of ``n`` made-up values, all formats in turn, in the surroundings of other windows."""
    draw, makers = _drawer(r), list(formats.values())
    out = []
    for k in range(n):
        value = makers[k % len(makers)](draw)
        around = contexts[int(r.integers(len(contexts)))] if len(contexts) else "\0" * (BEFORE + VALUE + AFTER)
        pieces = shown(around[:BEFORE] + value + around[BEFORE + VALUE :], BEFORE, BEFORE + len(value))
        out.append(pieces[int(r.integers(len(pieces)))])
    return out


def encoded(windows: list[str]) -> np.ndarray:
    """Windows as codes below 128: ASCII, and one code for everything else."""
    raw = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(windows), -1)
    return np.where(raw < 127, raw, 127).astype(np.int64)


class CharNetwork:
    """Character vectors, one convolution, a maximum over places, two dense layers."""

    WIDTH, DIM, FILTERS, DENSE = 5, 8, 24, 16

    def __init__(self, seed: int = 5) -> None:
        r = np.random.Generator(np.random.PCG64(seed))
        f = lambda *s, scale: r.normal(0, scale, s).astype(np.float32)
        places = BEFORE + VALUE + AFTER
        role = np.zeros((places, 3), dtype=np.float32)
        for k, cut in enumerate((slice(0, BEFORE), slice(BEFORE, BEFORE + VALUE), slice(BEFORE + VALUE, places))):
            role[cut, k] = 1
        self.role = role
        self.p = {
            "chars": f(128, self.DIM, scale=0.3),
            "conv": f(self.WIDTH * (self.DIM + 3), self.FILTERS, scale=0.15),
            "cb": np.zeros(self.FILTERS, dtype=np.float32),
            "dense": f(self.FILTERS, self.DENSE, scale=0.2),
            "db": np.zeros(self.DENSE, dtype=np.float32),
            "out": f(self.DENSE, scale=0.2),
            "ob": np.zeros(1, dtype=np.float32),
        }
        self.scale, self.threshold = (1.0, 0.0), 1.0

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
        n, places = codes.shape
        x = np.concatenate([self.p["chars"][codes], np.broadcast_to(self.role, (n, places, 3))], axis=2)
        wide = np.lib.stride_tricks.sliding_window_view(x, self.WIDTH, axis=1)  # n, places', channels, width
        wide = wide.transpose(0, 1, 3, 2).reshape(n, places - self.WIDTH + 1, -1)
        conv = np.maximum(wide @ self.p["conv"] + self.p["cb"], 0)
        best = conv.argmax(axis=1)
        top = np.take_along_axis(conv, best[:, None, :], axis=1)[:, 0]
        dense = np.maximum(top @ self.p["dense"] + self.p["db"], 0)
        return dense @ self.p["out"] + self.p["ob"], (wide, best, top, dense)

    def gradients(self, codes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        logits, (wide, best, top, dense) = self.forward(codes)
        d = ((sigmoid(logits) - y) / len(y)).astype(np.float32)
        g = {"out": dense.T @ d, "ob": d.sum(keepdims=True)}
        dd = d[:, None] * self.p["out"] * (dense > 0)
        g["dense"], g["db"] = top.T @ dd, dd.sum(axis=0)
        dt = (dd @ self.p["dense"].T) * (top > 0)
        g["cb"] = dt.sum(axis=0)
        patches = np.take_along_axis(wide, best[:, :, None], axis=1)  # n, filters, inputs
        g["conv"] = np.einsum("nfi,nf->if", patches, dt)
        dwide = dt[:, :, None] * self.p["conv"].T
        g["chars"] = np.zeros_like(self.p["chars"])
        rows = np.arange(len(codes))[:, None]
        for w in range(self.WIDTH):
            at = w * (self.DIM + 3)
            np.add.at(g["chars"], codes[rows, best + w], dwide[:, :, at : at + self.DIM])
        return g

    def probabilities(self, windows: list[str]) -> np.ndarray:
        a, b = self.scale
        out = [self.forward(encoded(windows[k : k + 2048]))[0] for k in range(0, len(windows), 2048)]
        return sigmoid(a * np.concatenate(out).astype(np.float64) + b) if out else np.zeros(0)


class Lesson:
    """What one fit or task learns from: its windows and made-up ones, a quarter of them left ``aside``."""

    def __init__(self, windows: list[str], labels: np.ndarray, formats: dict[str, Callable[[Draw], str]], seed: int, n_made: int = MADE_UP) -> None:
        self.random, self.windows = np.random.Generator(np.random.PCG64(seed)), len(windows)
        made = [made_up(kind, n_made, windows, self.random) for kind in (formats, LOOKALIKES)]
        self.y = np.concatenate([np.asarray(labels, dtype=np.float32), np.ones(n_made, np.float32), np.zeros(n_made, np.float32)])
        self.codes = encoded([*windows, *made[0], *made[1]])
        self.aside = self.random.random(len(self.y)) < 0.25

    def learn(self, net: CharNetwork, epochs: int) -> None:
        r, train = self.random, np.flatnonzero(~self.aside)
        m = {k: np.zeros_like(v) for k, v in net.p.items()}
        s = {k: np.zeros_like(v) for k, v in net.p.items()}
        step = 0
        for _ in range(epochs):
            order = r.permutation(train)
            for at in range(0, len(order), 64):
                some = order[at : at + 64]
                batch = self.codes[some].copy()
                blank = r.random(len(some)) < 0.5
                batch[blank, :BEFORE] = 0
                batch[blank, BEFORE + VALUE :] = 0
                step += 1
                for k, g in net.gradients(batch, self.y[some]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.99 * s[k] + 0.01 * g * g
                    net.p[k] -= 0.01 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step) * m[k] / (np.sqrt(s[k]) + 1e-6)

    def left_out(self, net: CharNetwork) -> tuple[np.ndarray, np.ndarray]:
        """Logits and labels of the examples left aside."""
        codes = self.codes[self.aside]
        return np.concatenate([net.forward(codes[k : k + 2048])[0] for k in range(0, len(codes), 2048)]).astype(np.float64), self.y[self.aside]


def _settled(net: CharNetwork, logits: np.ndarray, y: np.ndarray, n: np.ndarray) -> CharNetwork:
    """``net`` with its scale and threshold, from examples left out, each ``n`` times."""
    net.scale = _calibrated(logits, y, n)
    positive = np.flatnonzero(y == 1)
    order = positive[np.argsort(logits[positive], kind="stable")]
    reached = np.cumsum(n[order])
    at = order[int(np.searchsorted(reached, np.floor((1 - RECALL) * reached[-1]), side="right"))]
    net.threshold = float(sigmoid(net.scale[0] * logits[at : at + 1] + net.scale[1])[0])
    return net


def fit(
    windows: list[str], labels: np.ndarray, formats: dict[str, Callable[[Draw], str]] = FORMATS, epochs: int = EPOCHS, seed: int = 5
) -> CharNetwork:
    """The network fitted on labelled windows and made-up ones, here and now."""
    net, lesson = CharNetwork(seed), Lesson(windows, labels, formats, seed)
    lesson.learn(net, epochs)
    logits, y = lesson.left_out(net)
    return _settled(net, logits, y, np.ones(len(y)))


def _lessons(examples: DataFrame, run: Callable[[Lesson], pa.RecordBatch], tasks: int, schema: str, turn: int = 0) -> DataFrame:
    """What ``run`` gives per task; a task has the same windows, made-up ones and examples aside in every round."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            windows, known = ([x for b in held for x in b.column(k).to_pylist()] for k in (0, 1))
            # The first window names the task: made-up examples differ between tasks, and not between attempts.
            n_made = max(2 * len(FORMATS), MADE_UP * len(windows) // EXAMPLES)
            lesson = Lesson(windows, np.array(known), FORMATS, zlib.crc32(windows[0].encode("utf-8", "surrogatepass")), n_made)
            lesson.random = np.random.Generator(np.random.PCG64([turn, len(windows)]))
            yield run(lesson)

    dealt = examples.select("shown", "known").repartition(tasks, F.xxhash64("shown")).sortWithinPartitions("shown", "known")
    return arrow_map(dealt, learn, schema)


def trained(examples: DataFrame, rounds: int = ROUNDS, seed: int = 5) -> CharNetwork:
    """The network fitted on all ``examples`` (``shown, known``: distinct windows): by one task, or by many whose parameters are averaged."""
    n = examples.count()
    tasks = -(-n // EXAMPLES)
    if tasks <= 1:
        rows = examples.select("shown", "known").toPandas().sort_values(["shown", "known"], kind="stable")
        return fit(rows["shown"].tolist(), rows["known"].to_numpy(), seed=seed)
    net = CharNetwork(seed)
    context = examples.sparkSession.sparkContext
    for turn in range(rounds):
        start = context.broadcast(net.p)

        def learnt(lesson: Lesson, start=start) -> pa.RecordBatch:
            own = CharNetwork(seed)
            own.p = {k: v.copy() for k, v in start.value.items()}
            lesson.learn(own, max(1, EPOCHS // rounds))
            return pa.RecordBatch.from_arrays(
                [pa.array(list(own.p)), pa.array([v.ravel().tolist() for v in own.p.values()], pa.list_(pa.float32())), pa.array([len(lesson.y)] * len(own.p), pa.int64())],
                names=["name", "values", "n"],
            )

        found = _lessons(examples, learnt, tasks, "name string, values array<float>, n long", turn)
        # Summed in Spark: a few thousand numbers reach the driver, however many tasks there are.
        places = found.select("name", "n", F.posexplode("values").alias("place", "value")).groupBy("name", "place")
        mean = places.agg((F.sum(F.col("value").cast("double") * F.col("n")) / F.sum("n")).alias("value")).toPandas().sort_values(["name", "place"])
        net.p = {k: mean.loc[mean["name"] == k, "value"].to_numpy(np.float32).reshape(v.shape) for k, v in net.p.items()}
        start.destroy()
    done = context.broadcast(net)

    def counted(lesson: Lesson) -> pa.RecordBatch:
        logits, y = lesson.left_out(done.value)
        cell = np.floor(np.clip(logits, -MOST, MOST) * STEPS).astype(np.int64) * 2 + (y == 1)
        cells, times = np.unique(cell, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(cells), pa.array(times.astype(np.int64))], names=["cell", "n"])

    counts = _lessons(examples, counted, tasks, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toPandas()
    cell = counts["cell"].to_numpy(np.int64)
    return _settled(net, (cell // 2) / STEPS, (cell % 2).astype(np.float64), counts["n"].to_numpy(np.float64))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base findings and candidates of every whole text, stored."""
    kind = docs.schema[id_col].dataType.simpleString()
    base_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    cand_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("shown", pa.list_(pa.string())), ("known", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, 1):
                base, cand = [], []
                for text in batch.column(1).to_pylist():
                    found = base_findings(text)
                    base.append([dict(zip(("kind", "start", "end"), f, strict=True)) for f in found])
                    cand.append([dict(zip(("start", "end", "shown", "known"), c, strict=True)) for c in candidates(text, found)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, base_type), pa.array(cand, cand_type)], names=[id_col, "base", "candidates"])

    texts = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    return stored(arrow_map(texts, run, f"`{id_col}` {kind}, {SCAN_SCHEMA}"), "secret-scan")


def labelled(scanned: DataFrame) -> DataFrame:
    """``shown, known``: every distinct window of the scan, base or other, stored."""
    every = scanned.select(F.explode("candidates").alias("c")).select(F.explode("c.shown").alias("shown"), "c.known").distinct()
    return stored(every, "secret-examples")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, spans ARRAY<STRUCT<kind, start, end, score>>``: base findings (score 1) and learned ones."""
    scanned = scan(docs, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(trained(labelled(scanned)))
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            base, cand = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            open_ = [(k, c) for k, row in enumerate(cand) for c in row if not c["known"]]
            out = [[b | {"score": 1.0} for b in row] for row in base]
            scores = net.probabilities([w for _, c in open_ for w in c["shown"]])
            at = 0
            for k, c in open_:
                p = float(scores[at : (at := at + len(c["shown"]))].max())
                if p >= net.threshold:
                    out[k].append({"kind": "learned", "start": c["start"], "end": c["end"], "score": p})
            for row in out:
                row.sort(key=lambda s: (s["start"], KINDS.index(s["kind"])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, span)], names=[id_col, "spans"])

    return arrow_map(scanned, run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:int,end:int,score:double>>")
