"""Toxicity after noisy-channel deobfuscation.

Disguised words (figures for letters, letters set apart, letters repeated or masked) become
lattices of what each character may stand for. A Viterbi search under a character trigram
model, counted over the whole corpus, picks the likeliest reading; the restored words are then
scored by log-odds learned from labelled documents.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.llm.common import texts_of
from contestry.session import cut_lineage

# Letters of the character model (0 is any break, the last number any other
# letter), what figures and signs may stand for, and signs that may only set letters apart.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäåæçèéêëìíîïñòóôöøùúûüßœ"
STANDS_FOR = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
    "*": "aeiou", "#": "aeiou", "%": "aeiou",
}
SYMBOLS = 64
OTHER = SYMBOLS - 1
NUMBER = {c: i + 1 for i, c in enumerate(LETTERS)}

#: Costs in nats of the channel: a sign read as a letter, a sign left out, a letter repeated.
COST_STANDS, COST_MASK, COST_SKIP, COST_BREAK, COST_REPEAT = 1.5, 3.5, 1.5, 0.5, 0.5
#: The cost of a letter typed twice for one; many words have a double letter of their own.
COST_DOUBLE = 4.0

#: At most about so many labelled rows are learned from; a share of them only calibrates.
SAMPLE_ROWS, CALIBRATION_SHARE = 20_000, 0.25
FEATURE_SPACE, MOST_FEATURES, LEAST_DOCUMENTS, LEAST_LOG_ODDS = 1 << 22, 50_000, 4, 2.0
PREFIXES = (4, 5, 6)
TOP = 5
REMEMBERED = 300_000

#: A word between signs that stand for nothing; any other token is read by its lattice.
PLAIN = re.compile(rf"[\"'\[{{<¿¡«]*([^\W\d_]+)[^\w{re.escape(''.join(STANDS_FOR))}]*")
RUN = re.compile(r"(.)\1")


def _code_table() -> np.ndarray:
    table = np.zeros(0x250, np.int64)
    for code in range(len(table)):
        if chr(code).isalpha():
            table[code] = NUMBER.get(chr(code), OTHER)
    return table


CODES = _code_table()


def codes_of(text: str) -> np.ndarray:
    """Symbol numbers of the lower-case text; letters beyond the table are OTHER."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < len(CODES), CODES[np.minimum(points, len(CODES) - 1)], OTHER)


def trigram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``code`` and ``n``: how often each triple of symbols occurs in all texts.

    A task sends its sums once for each batch, at most SYMBOLS ** 3 rows.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                c = np.concatenate([[0, 0], codes_of(text), [0]])
                np.add.at(total, (c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:], 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return texts.mapInArrow(counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def character_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b) from trigram counts, backing off to pairs and single symbols."""
    cube = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    single = cube.sum((0, 1)) + 1.0
    chance = single / single.sum()
    pair = cube.sum(0) + 5.0 * chance
    chance = pair / pair.sum(1, keepdims=True)
    triple = cube + 5.0 * chance
    return np.log(triple / triple.sum(2, keepdims=True))


def options(token: str) -> list[list[tuple[str, float]]]:
    """For each run of one character, what it may stand for and at what cost.

    A break within the token is written as a blank; the empty string means left out.
    """
    out = []
    for char, run in groupby(token):
        n = len(list(run))
        if char.isalpha():
            once = COST_DOUBLE if n == 2 else COST_REPEAT * (n - 1)
            out.append([(char, once), (char * 2, COST_REPEAT * (n - 2))] if n > 1 else [(char, 0.0)])
        elif char in STANDS_FOR:
            cost = COST_MASK if len(STANDS_FOR[char]) > 2 else COST_STANDS
            choice = [(letter * k, cost * k) for letter in STANDS_FOR[char] for k in ({1, min(n, 2)})]
            out.append([*choice, ("", COST_SKIP), (" ", COST_BREAK)])
        else:
            out.append([("", COST_SKIP), (" ", COST_BREAK)])
    return out


def viterbi(token: str, model: np.ndarray) -> str:
    """The likeliest reading of a token's lattice; states are the last two symbols."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for choices in [*options(token), [(" ", 0.0)]]:
        reached: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in states.items():
            for text, cost in choices:
                x, y, total = a, b, score - cost
                for char in text:
                    c = 0 if char == " " else NUMBER.get(char, OTHER)
                    total += model[x, y, c]
                    x, y = y, c
                if (x, y) not in reached or total > reached[x, y][0]:
                    reached[x, y] = (total, (path, text) if text else path)
        states = reached
    _, path = max(states.values(), key=lambda s: s[0])
    parts = []
    while path is not None:
        path, text = path
        parts.append(text)
    return "".join(reversed(parts))[:-1]


class Restorer:
    """Restored words of whole texts; remembers tokens up to a bound."""

    def __init__(self, model: np.ndarray):
        self.model, self.known = model, {}

    def token(self, token: str) -> tuple[str, ...]:
        """Words that one token of non-blanks (lower case) stands for."""
        plain = PLAIN.fullmatch(token)
        if plain and not RUN.search(plain[1]):
            return (plain[1],)
        if not any(c.isalpha() or c in STANDS_FOR for c in token):
            return ()
        return tuple(viterbi(token, self.model).split())

    def remembered(self, token: str) -> tuple[str, ...]:
        words = self.known.get(token)
        if words is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            words = self.known[token] = self.token(token)
        return words

    def tokens(self, text: str) -> list[str]:
        """Tokens in order; three or more single characters in a row are one token."""
        tokens = text.lower().split()
        singles = [i for i, t in enumerate(tokens) if len(t) == 1]
        if len(singles) < 3:
            return tokens
        out, at = [], 0
        for _, run in groupby(enumerate(singles), key=lambda p: p[1] - p[0]):
            run = [i for _, i in run]
            if len(run) >= 3:
                out += [*tokens[at : run[0]], " ".join(tokens[run[0] : run[-1] + 1])]
                at = run[-1] + 1
        return [*out, *tokens[at:]]

    def words(self, text: str) -> list[str]:
        return [w for t in self.tokens(text) for w in self.remembered(t)]


def features_of(word: str) -> list[int]:
    """Hash numbers of a word and its beginnings."""
    parts = [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]
    return [zlib.crc32(p.encode()) & (FEATURE_SPACE - 1) for p in parts]


class Evidence:
    """Numbers of a text that calibration turns into a score."""

    def __init__(self, model: np.ndarray, weights: dict[int, float]):
        self.restorer, self.weights, self.known = Restorer(model), weights, {}

    def _weight(self, token: str) -> float:
        weight = self.known.get(token)
        if weight is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = (self.weights.get(f, 0.0) for w in self.restorer.token(token) for f in features_of(w))
            weight = self.known[token] = max(found, default=0.0)
        return weight

    def of(self, text: str) -> tuple[float, float]:
        """The largest weight of a token, and the sum of the TOP largest."""
        weights = sorted(filter(None, map(self._weight, set(self.restorer.tokens(text)))))[-TOP:]
        return (weights[-1], sum(weights)) if weights else (0.0, 0.0)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str, rows: int
) -> DataFrame:
    """About ``rows`` labelled documents at most: ``_text``, ``_label``, ``_calibrates``.

    ``learn`` speaks of ``labels``. The ids that a hash picks are bounded by ``rows``, so they
    may be broadcast to the documents.
    """
    known = labels.where(learn).where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    share = rows / max(known.count(), 1)
    draw = F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    part = F.pmod(F.xxhash64("_id", F.lit(12)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = known.where(draw < share).withColumn("_calibrates", part < CALIBRATION_SHARE)
    return texts_of(docs, id_col, text_col).join(F.broadcast(picked), "_id").select("_text", "_label", "_calibrates")


def _feature_counts(sample: DataFrame, model) -> DataFrame:
    """Documents of either label that have a feature."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, sums = Restorer(model.value), (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[label > 0].update({f for w in set(restorer.words(text)) for f in features_of(w)})
        every = list(sums[0].keys() | sums[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(every, pa.int64()), *(pa.array([s[f] for f in every], pa.int64()) for s in sums)],
            names=["feature", "neg", "pos"],
        )

    found = sample.select("_text", "_label").mapInArrow(counted, "feature long, neg long, pos long")
    return found.groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of a logistic curve over the columns of ``x`` and a constant, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rows: int = SAMPLE_ROWS,
) -> tuple[np.ndarray, dict[int, float], np.ndarray]:
    """Character model, feature weights and calibration.

    The character model counts every text of ``docs``. Weights are log-odds of features in at
    most ``rows`` labelled documents; another part of those, not counted for the weights, fits
    the calibration. The driver gets the trigram table, MOST_FEATURES weights at most, and two
    numbers for each calibrating document. With one kind of label or none, the score is a
    constant.
    """
    spark = docs.sparkSession
    counts = np.zeros(SYMBOLS**3, np.int64)
    for row in trigram_counts(docs, text_col).collect():
        counts[row.code] = row.n
    model = character_model(counts)
    shared = spark.sparkContext.broadcast(model)
    sample = cut_lineage(labelled_sample(docs, labels, learn, id_col, text_col, label_col, rows))
    sizes = {(r._calibrates, r._label > 0): r.n for r in sample.groupBy("_calibrates", "_label").agg(F.count("*").alias("n")).collect()}
    neg, pos = sizes.get((False, False), 0), sizes.get((False, True), 0)
    odds = F.log((F.col("pos") + 0.5) / (pos + 1.0)) - F.log((F.col("neg") + 0.5) / (neg + 1.0))
    told = (
        _feature_counts(sample.where("NOT _calibrates"), shared)
        .where(F.col("pos") >= LEAST_DOCUMENTS)
        .withColumn("weight", odds)
        .where(F.col("weight") >= LEAST_LOG_ODDS)
        .orderBy(F.desc(F.col("weight") * F.sqrt("pos")), "feature")
        .limit(MOST_FEATURES)
    )
    weights = {r.feature: r.weight for r in told.collect()}
    shared_weights = spark.sparkContext.broadcast(weights)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(shared.value, shared_weights.value)
        for batch in batches:
            found = [evidence.of(t) for t in batch.column(0).to_pylist()]
            columns = [pa.array([f[k] for f in found], pa.float64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(1), *columns], names=["label", "most", "sum"])

    rest = sample.where("_calibrates").select("_text", "_label")
    points = rest.mapInArrow(measured, "label int, most double, sum double").toPandas()
    y = (points["label"] > 0).to_numpy(float)
    if 0 < y.sum() < len(y):
        return model, weights, fit_logistic(points[["most", "sum"]].to_numpy(), y)
    share = (pos + 0.5) / (neg + pos + 1.0)
    return model, weights, np.array([0.0, 0.0, math.log(share / (1 - share))])


def score_toxicity(
    docs: DataFrame,
    fitted: tuple[np.ndarray, dict[int, float], np.ndarray],
    threshold: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Id, ``score`` (0 to 1) and ``predicted`` of every row, from its whole text.

    Null and empty texts have no evidence and get the score of a text without any. Repeated
    rows and null ids are scored like others, an empty table gives no rows, other columns are
    not read. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights, curve = shared.value
        evidence = Evidence(model, weights)
        for batch in batches:
            found = np.array([evidence.of(t) for t in batch.column(1).to_pylist()]).reshape(-1, 2)
            score = 1 / (1 + np.exp(-np.clip(found @ curve[:2] + curve[2], -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                names=[id_col, "score", "predicted"],
            )

    schema = f"`{id_col}` long, score double, predicted int"
    return texts_of(docs, id_col, text_col).mapInArrow(scored, schema)


def restore_texts(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and ``restored``: the words of every text as read by the character model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for batch in batches:
            texts = [" ".join(restorer.words(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "restored"])

    return texts_of(docs, id_col, text_col).mapInArrow(restored, f"`{id_col}` long, restored string")
