"""Language-model scores: a log-bilinear network trained by noise-contrastive estimation, in numpy.

Tokens are words (A-Z lower-cased, parted by ASCII white space) and one end per text. All training
texts are counted by Spark. The network knows ``CLASSES`` tokens: the end, the most frequent
words, and one class for all others, whose words follow their smoothed counts. It
predicts a class from the ``CONTEXT`` tokens before it: a sum of their vectors, each through the
matrix of its place, times the vector of the class, plus a bias. So a text's probability is
normalised over every word, seen or not: the softmax over all classes (batched matrix
products), times the share of the word in its class.

Training goes through every training text. In each of ``ROUNDS`` rounds the tasks start from the
same parameters, learn from their part of a block of the texts (one of ``ROUNDS``), and the mean
of their parameters, by tokens, is the next round's start; a lost executor repeats its tasks of
one round. The noise is the tokens' own distribution, and the bias begins there, so the network
begins as a unigram model. Blocks have ``LEAST_EXAMPLES`` tokens at least, so a smaller corpus is
gone through in more than one round, or several times in a round.

Counts of rare words never reach a driver or a model: their occurrences meet the table of
counts in one join. The ``FREQUENT`` words (and at most that many, of ``WORD_BYTES`` bytes at most)
are kept beside the model, so no word of many texts is shuffled but for very long ones.

Null texts count as empty: one token, the end. Rows without an id are training rows. Repeated ids
and rows are scored row by row. An empty table, or one without training rows, gives scores
from the smoothing alone. Very long texts are scored whole. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map, sliced, stored, text_or_empty

#: Added to every count, and the part of documents that is held out (one of so many).
SMOOTH, HELD_OUT = 0.1, 10
CLASSES, CONTEXT, DIM = 1024, 3, 16
END, OTHER = 0, 1
#: Stands before a text's first token; only ever context.
BEGIN = CLASSES
FREQUENT, WORD_BYTES = 1 << 16, 64
#: Steps of the logarithm by which words are taken as frequent; all words of a step or none.
STEPS_PER_OCTAVE = 64
ROUNDS, BATCH, NOISE, DRAWS, RATE = 4, 512, 16, 64, 0.1
LEAST_EXAMPLES, MOST_PASSES = 1 << 22, 4
#: Tokens that a training task sees in a round at least, if there are so many; and that it holds at once.
TASK_TOKENS, HELD_TOKENS = 1 << 21, 1 << 18
SCORE_ROWS, EXAMPLE_ROWS = 512, 1 << 14
LN10 = float(np.log(10))


def held_out(id_col: Column) -> Column:
    """Whether a text is kept from training."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and the number of each one's text.

    The texts are laid out anew, as ``ascii_lower`` reads the wrong bytes of a slice that was cast.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts.to_pylist(), pa.large_string())))
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(flat), 0)
    return pc.filter(flat, real), pc.filter(parent, real).to_numpy(zero_copy_only=False)


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, c`` over a table of one column ``text``; each batch is counted before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, 0):
                counted = pc.value_counts(words_of(batch.column(0))[0])
                yield pa.RecordBatch.from_arrays([counted.field(0).cast(pa.string()), counted.field(1)], names=["word", "n"])

    return arrow_map(texts, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """What the corpus was counted as. ``words`` are the frequent ones, from the most frequent on."""

    words: list[str]
    counts: np.ndarray
    tokens: int  # all training tokens, ends included
    distinct: int  # distinct ones, the end included
    texts: int

    @property
    def modelled(self) -> int:
        """How many words have a class of their own."""
        return min(len(self.words), CLASSES - 2)

    @property
    def other_tokens(self) -> int:
        return self.tokens - self.texts - int(self.counts[: self.modelled].sum())

    @property
    def other_distinct(self) -> int:
        return max(0, self.distinct - 1 - self.modelled)

    def noise(self) -> np.ndarray:
        """The smoothed distribution of the classes."""
        p = np.full(CLASSES, SMOOTH)
        p[END] += self.texts
        p[OTHER] += self.other_tokens
        p[2 : 2 + self.modelled] += self.counts[: self.modelled]
        return p / p.sum()


def vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    """Totals, and the most frequent words: whole steps of the logarithm of the count while they are ``FREQUENT`` at most.

    A histogram by step (some thousand rows) says where to stop, so nothing is sorted.
    """
    step = F.floor(F.log2("c") * STEPS_PER_OCTAVE)
    short = F.octet_length("word") <= WORD_BYTES
    histogram = counts.groupBy(step.alias("step")).agg(F.count_if(short).alias("n"), F.count(F.lit(1)).alias("all"), F.sum("c").alias("c")).collect()
    room, least = FREQUENT, None
    for row in sorted(histogram, reverse=True):
        if row["n"] > room:
            break
        room, least = room - row["n"], row["step"]
    frequent = counts.where(short & (step >= least)).collect() if least is not None else []
    frequent.sort(key=lambda r: (-r["c"], r["word"]))
    return Vocabulary(
        [r["word"] for r in frequent], np.array([r["c"] for r in frequent], dtype=np.int64),
        sum(r["c"] for r in histogram) + texts, sum(r["all"] for r in histogram) + (texts > 0), texts,
    )


def encoded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``docs`` (``id, held, text``) as ``key, id, held, n_tokens, known, logs, other, other_logs, classes, rare``.

    ``logs`` is the sum of log10(c + 0.1) over the end and the frequent words, ``other_logs`` that over
    frequent words of the other class, ``other`` how many words that class has; ``classes`` are
    16-bit numbers, ``rare`` the words whose counts are to be looked up.
    """
    model = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = model.value
        known_words = pa.array(v.words, pa.large_string())
        logs = np.log10(v.counts + SMOOTH)
        end_log, end_known = float(np.log10(v.texts + SMOOTH)), int(v.texts > 0)
        for whole in batches:
            for batch in sliced(whole, 3):
                n = batch.num_rows
                flat, parent = words_of(batch.column(3))
                at = pc.fill_null(pc.index_in(flat, known_words), -1).to_numpy(zero_copy_only=False)
                is_rare, is_other = at < 0, (at < 0) | (at >= v.modelled)
                size = np.bincount(parent, minlength=n)
                summed = lambda mask, w=None: np.bincount(parent[mask], weights=w, minlength=n)  # noqa: B023, E731
                middle = ~is_rare & is_other
                classes = np.zeros(len(at) + n, dtype=np.uint16)  # ends stay 0
                classes[np.arange(len(at)) + parent] = np.where(is_other, OTHER, at + 2)
                bounds = np.concatenate([[0], np.cumsum(size + 1, dtype=np.int64)])
                rare_bounds = np.concatenate([[0], np.cumsum(summed(is_rare), dtype=np.int64)]).astype(np.int32)
                made = [
                    pa.array(size + 1, pa.int64()),
                    pa.array(summed(~is_rare).astype(np.int64) + end_known, pa.int64()),
                    pa.array(summed(~is_rare, logs[at[~is_rare]]) + end_log, pa.float64()),
                    pa.array(summed(is_other).astype(np.int64), pa.int64()),
                    pa.array(summed(middle, logs[at[middle]]).astype(np.float64), pa.float64()),
                    pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds * 2), pa.py_buffer(classes)]).cast(pa.binary()),
                    pa.ListArray.from_arrays(pa.array(rare_bounds), pc.filter(flat, pa.array(is_rare)).cast(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["key", "id", "held", *MADE])

    MADE = ("n_tokens", "known", "logs", "other", "other_logs", "classes", "rare")
    kind = docs.schema["id"].dataType.simpleString()
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), "id", "held", "text")
    return arrow_map(
        keyed, run, f"key long, id {kind}, held boolean, n_tokens long, known long, logs double, other long, other_logs double, classes binary, rare array<string>"
    )


def examples(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts as classes: every token, the tokens before it ``(n, CONTEXT)``, nearest first, and where texts begin."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 2
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    token = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).astype(np.int64)
    place = np.arange(len(token)) - np.repeat(bounds[:-1], sizes)
    before = np.full((len(token), CONTEXT), BEGIN, dtype=np.int64)
    for k in range(min(CONTEXT, max(0, len(token) - 1))):
        before[k + 1 :, k] = np.where(place[k + 1 :] > k, token[: len(token) - k - 1], BEGIN)
    return token, before, bounds


class LogBilinear:
    """Parameters, a step of noise-contrastive estimation, and normalised log-probabilities."""

    def __init__(self, noise: np.ndarray, seed: int = 11) -> None:
        r = np.random.Generator(np.random.PCG64(seed))
        self.noise = noise
        self.log_noise = np.log(noise)
        self.p = {
            "before": r.normal(0, 0.1, (CLASSES + 1, DIM)).astype(np.float32),
            "place": np.stack([np.eye(DIM) / (k + 1) + r.normal(0, 0.02, (DIM, DIM)) for k in range(CONTEXT)]).astype(np.float32),
            "target": r.normal(0, 0.1, (CLASSES, DIM)).astype(np.float32),
            "bias": self.log_noise.astype(np.float32),
        }
        self.squares = {name: np.full(x.shape, 1e-2, dtype=np.float32) for name, x in self.p.items()}

    def flat(self) -> np.ndarray:
        """All parameters and the sums of their squared gradients."""
        return np.concatenate([x.ravel() for part in (self.p, self.squares) for x in part.values()])

    def set_flat(self, values: np.ndarray) -> None:
        at = 0
        for part in (self.p, self.squares):
            for name, x in part.items():
                part[name] = values[at : at + x.size].reshape(x.shape).astype(np.float32)
                at += x.size

    def predicted(self, before: np.ndarray) -> np.ndarray:
        return sum(self.p["before"][before[:, k]] @ self.p["place"][k] for k in range(CONTEXT))

    def _odds(self, q: np.ndarray, token: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds that a token is no noise: of each token, and of each noise token after what is before it."""
        p = self.p
        ratio = (p["bias"] - self.log_noise - np.log(NOISE)).astype(np.float32)
        return np.einsum("ij,ij->i", q, p["target"][token]) + ratio[token], q @ p["target"][drawn].T + ratio[drawn]

    def objective(self, token: np.ndarray, before: np.ndarray, drawn: np.ndarray) -> float:
        """Log-likelihood of telling tokens from ``NOISE`` noise tokens each.

        All tokens share the noise tokens ``drawn``, which so weigh ``NOISE / len(drawn)`` each.
        """
        true, false = self._odds(self.predicted(before), token, drawn)
        return float(-np.logaddexp(0, -true).sum() - NOISE / len(drawn) * np.logaddexp(0, false).sum())

    def gradients(self, token: np.ndarray, before: np.ndarray, drawn: np.ndarray) -> dict[str, np.ndarray]:
        """The gradients of ``objective``."""
        p = self.p
        q = self.predicted(before)
        true, false = self._odds(q, token, drawn)
        up = 1 / (1 + np.exp(true))
        down = np.float32(-NOISE / len(drawn)) / (1 + np.exp(-false))
        dq = up[:, None] * p["target"][token] + down @ p["target"][drawn]
        target = _scattered(token, up[:, None] * q, CLASSES)
        np.add.at(target, drawn, down.T @ q)
        bias = np.bincount(token, weights=up, minlength=CLASSES)
        np.add.at(bias, drawn, down.sum(axis=0))
        place = np.stack([p["before"][before[:, k]].T @ dq for k in range(CONTEXT)])
        context = np.concatenate([dq @ p["place"][k].T for k in range(CONTEXT)])
        return {"before": _scattered(before.T.ravel(), context, CLASSES + 1), "place": place, "target": target, "bias": bias}

    def learn(self, token: np.ndarray, before: np.ndarray, random: np.random.Generator) -> None:
        """One pass in random order, in steps of ``BATCH`` tokens, each scaled by its past gradients."""
        order = random.permutation(len(token))
        edges = np.cumsum(self.noise)
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            drawn = np.minimum(np.searchsorted(edges, random.random(DRAWS)), CLASSES - 1)
            for name, g in self.gradients(token[some], before[some], drawn).items():
                g = g.astype(np.float32)
                self.squares[name] += g * g
                self.p[name] += RATE * g / np.sqrt(self.squares[name])

    def log_probs(self, token: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Natural log-probabilities, normalised over all classes."""
        key = before[:, 0]
        for k in range(1, CONTEXT):
            key = key * (CLASSES + 1) + before[:, k]
        # Many tokens stand after the same ones: each such context is normalised once.
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        tables = [self.p["before"] @ m for m in self.p["place"]]
        q = sum(t[before[first, k]] for k, t in enumerate(tables))
        total = self._log_totals(q)
        own = np.empty(len(token))
        for at in range(0, len(token), EXAMPLE_ROWS):
            some = slice(at, at + EXAMPLE_ROWS)
            own[some] = np.einsum("ij,ij->i", q[which[some]], self.p["target"][token[some]])
        return own + self.p["bias"][token] - total[which]

    def _log_totals(self, q: np.ndarray) -> np.ndarray:
        """The logarithm of the sum of all classes' exponentials after each predicted vector."""
        across, ones = np.ascontiguousarray(self.p["target"].T), np.ones(CLASSES, dtype=np.float32)
        length, highest = float(np.linalg.norm(self.p["target"], axis=1).max()), float(np.abs(self.p["bias"]).max())
        found = np.empty(len(q))
        for at in range(0, len(q), SCORE_ROWS):
            some = q[at : at + SCORE_ROWS]
            logits = some @ across
            logits += self.p["bias"]
            most = np.zeros(len(some), dtype=np.float32)
            if float(np.linalg.norm(some, axis=1).max(initial=0)) * length + highest > 60:
                # Only then could an exponential leave single precision.
                most = logits.max(axis=1)
                logits -= most[:, None]
            np.exp(logits, out=logits)
            found[at : at + SCORE_ROWS] = most + np.log((logits @ ones).astype(np.float64))
        return found


def _scattered(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sums of ``values`` by row."""
    at = (rows[:, None] * values.shape[1] + np.arange(values.shape[1])).ravel()
    return np.bincount(at, weights=values.ravel(), minlength=n * values.shape[1]).reshape(n, -1)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    """Single columns of classes in pieces of about ``HELD_TOKENS`` tokens; a longer text is a piece of its own."""
    for whole in batches:
        for batch in sliced(whole, 0, rows=1 << 14, size=2 * HELD_TOKENS):
            yield batch.column(0)


def trained(texts: DataFrame, vocab: Vocabulary) -> LogBilinear:
    """The network after all rounds over ``texts`` (``key, n_tokens, classes``), which hold every training text."""
    network = LogBilinear(vocab.noise())
    context = texts.sparkSession.sparkContext
    blocks = min(ROUNDS, max(1, vocab.tokens // LEAST_EXAMPLES))
    passes = min(MOST_PASSES, max(1, LEAST_EXAMPLES // (ROUNDS * max(1, vocab.tokens))))
    tasks = max(1, vocab.tokens // (blocks * TASK_TOKENS))
    for number in range(ROUNDS):
        start = context.broadcast(network)

        def run(batches: Iterator[pa.RecordBatch], start=start, number=number) -> Iterator[pa.RecordBatch]:
            own = LogBilinear(start.value.noise)
            own.set_flat(start.value.flat())
            random, seen = np.random.Generator(np.random.PCG64(number)), 0
            for column in _held(batches):
                token, before, _ = examples(column)
                seen += len(token)
                for _ in range(passes):
                    own.learn(token, before, random)
            if seen:
                values = np.concatenate([own.flat().astype(np.float64) * seen, [seen]])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["i", "v"])

        block = texts.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == number % blocks).select("classes")
        summed = arrow_map(block.coalesce(tasks), run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        start.unpersist()
        if summed.num_rows:
            # As many rows as the network has parameters, whatever the corpus.
            values = np.empty(summed.num_rows)
            values[summed["i"].to_numpy()] = summed["v"].to_numpy()
            network.set_flat(values[:-1] / values[-1])
    return network


def with_model_logs(rows: DataFrame, network: LogBilinear) -> DataFrame:
    """``rows`` of ``encoded`` without classes and rare words, and with ``model``: the log10-probability of the classes."""
    model = rows.sparkSession.sparkContext.broadcast(network)
    names = ["key", "id", "held", "n_tokens", "known", "logs", "other", "other_logs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, len(names), rows=1 << 14, size=2 * HELD_TOKENS):
                token, before, bounds = examples(batch.column(len(names)))
                total = np.add.reduceat(model.value.log_probs(token, before), bounds[:-1]) / LN10
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(total)], names=[*names, "model"])

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"key long, id {kind}, held boolean, n_tokens long, known long, logs double, other long, other_logs double, model double"
    return arrow_map(rows.select(*names, "classes"), run, schema)


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row per row.

    ``base_score`` is the smoothed unigram log10-probability, ``score`` the network's.
    """
    own = F.col(f"`{id_col}`")
    texts = docs.select(own.alias("id"), held_out(own).alias("held"), text_or_empty(F.col(f"`{text_col}`")).alias("text"))
    training = texts.where("not held")
    counts = stored(word_counts(training.select("text")), "lm-counts")
    vocab = vocabulary(counts, training.count())
    rows = stored(encoded(texts, vocab), "lm-encoded")
    network = trained(rows.where("not held").select("key", "n_tokens", "classes"), vocab)
    rare = rows.select("key", F.explode("rare").alias("word")).join(counts, "word", "left")
    looked_up = rare.groupBy("key").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("rare_logs"), F.count("c").alias("rare_known"))
    scored = with_model_logs(rows, network).join(looked_up, "key", "left")
    rare_logs = F.coalesce("rare_logs", F.lit(0.0))
    all_share = float(np.log10(vocab.tokens + SMOOTH * (vocab.distinct + 1)))
    other_share = float(np.log10(vocab.other_tokens + SMOOTH * (vocab.other_distinct + 1)))
    return scored.select(
        F.col("id").alias(id_col),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + rare_logs - F.col("n_tokens") * F.lit(all_share)).alias("base_score"),
        (F.col("model") + F.col("other_logs") + rare_logs - F.col("other") * F.lit(other_share)).alias("score"),
    )
