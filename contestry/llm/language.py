"""Language of a text by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The forward
algorithm adds up the probability of all ways to cut a word into pieces; a text is its words.
The piece probabilities are learned by expectation maximisation over the same sums, on a
bounded sample of labelled documents.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict, deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contestry.llm.common import carried, let_go, texts_of
from contestry.session import cut_lineage

WORD = re.compile(r"[^\W\d_]+")
#: Words of more letters are summed in logarithms, one by one; others side by side.
WORD_LETTERS = 32
#: The learning sample: about so many labelled documents of each language, spread by a hash.
SAMPLE_PER_LANGUAGE = 2_000
EM_ROUNDS = 3
#: Probability of a letter that no piece covers, and the count every piece starts with.
UNKNOWN, SMOOTHING = 1e-7, 0.05
REMEMBERED = 200_000
UNDETERMINED = "und"
BEGIN = "▁"


def read_pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece model that stand for letters, begin mark included, lower case."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    inner = (p for p in pieces if WORD.fullmatch(p.removeprefix(BEGIN)))
    return sorted({p.lower() for p in inner} | {BEGIN})


def words_of(text: str) -> list[str]:
    """Words in lower case."""
    return WORD.findall(text.lower())


class Lattice:
    """All segmentations of words over a fixed list of pieces."""

    def __init__(self, pieces: list[str]):
        self.number = {p: i for i, p in enumerate(pieces)}
        self.size = len(pieces)
        self.longest = max(map(len, pieces), default=1)

    def edges(self, words: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """Piece numbers by (start, end) for marked words of one length; -1 where none is.

        Where a single letter is no piece, it has the number of the unknown piece.
        """
        length, get, out = len(words[0]), self.number.get, {}
        for i in range(length):
            out[i, i + 1] = np.array([get(w[i], self.size) for w in words])
            for j in range(i + 2, min(length, i + self.longest) + 1):
                found = np.array([get(w[i:j], -1) for w in words])
                if (found >= 0).any():
                    out[i, j] = found
        return out

    def forward(self, edges, length: int, chance: np.ndarray) -> np.ndarray:
        """alpha[position, word, language]: sum over segmentations up to the position.

        ``chance`` is pieces by languages, with the unknown piece and a row of zeros behind.
        """
        count = len(edges[0, 1])
        alpha = np.zeros((length + 1, count, chance.shape[1]))
        alpha[0] = 1.0
        for (i, j), pieces in sorted(edges.items(), key=lambda e: e[0][1]):
            alpha[j] += alpha[i] * chance[pieces]
        return alpha

    def expected(self, words: list[str], times: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """Expected piece counts over all segmentations; ``times`` is words by languages."""
        total = np.zeros((self.size + 2, chance.shape[1]))
        short, long = _by_length(words)
        for place in long:
            self._add_expected(words[place], times[place], chance, total)
        for length, places in short.items():
            own, weight = [words[p] for p in places], times[places]
            edges = self.edges(own)
            alpha = self.forward(edges, length, chance)
            beta = np.zeros_like(alpha)
            beta[length] = 1.0
            for (i, j), pieces in sorted(edges.items(), key=lambda e: -e[0][0]):
                beta[i] += chance[pieces] * beta[j]
            share = weight / alpha[length]
            for (i, j), pieces in edges.items():
                np.add.at(total, pieces, alpha[i] * chance[pieces] * beta[j] * share)
        return total[: self.size]

    def log_chance(self, words: list[str], chance: np.ndarray) -> np.ndarray:
        """Log of the summed probability, words by languages."""
        out = np.zeros((len(words), chance.shape[1]))
        short, long = _by_length(words)
        for length, places in short.items():
            edges = self.edges([words[p] for p in places])
            out[places] = np.log(self.forward(edges, length, chance)[length])
        if long:
            with np.errstate(divide="ignore"):
                logs = np.log(chance)
            for place in long:
                for total, _ in self._log_forward(words[place], logs):
                    out[place] = total
        return out

    def _log_forward(self, word: str, logs: np.ndarray) -> Iterator[tuple[np.ndarray, list[tuple[int, int]]]]:
        """For each letter the log of the sum up to it, and (start, piece) of the pieces that end
        there; sums are kept no further back than the longest piece."""
        window = deque([np.zeros(logs.shape[1])], maxlen=self.longest)
        for end in range(1, len(word) + 1):
            pieces = ((i, self.number.get(word[i:end], -1)) for i in range(max(0, end - self.longest), end - 1))
            ends = [x for x in pieces if x[1] >= 0] + [(end - 1, self.number.get(word[end - 1], self.size))]
            total = np.logaddexp.reduce([window[i - end] + logs[p] for i, p in ends], axis=0)
            window.append(total)
            yield total, ends

    def _add_expected(self, word: str, times: np.ndarray, chance: np.ndarray, total: np.ndarray) -> None:
        """Add to ``total`` the expected piece counts of one long word."""
        with np.errstate(divide="ignore"):
            logs = np.log(chance)
        steps = list(self._log_forward(word, logs))
        ahead = np.array([np.zeros(logs.shape[1]), *(s for s, _ in steps)])
        behind = np.full_like(ahead, -np.inf)
        behind[-1] = 0.0
        for end in range(len(word), 0, -1):
            for i, p in steps[end - 1][1]:
                onward = logs[p] + behind[end]
                behind[i] = np.logaddexp(behind[i], onward)
                total[p] += times * np.exp(ahead[i] + onward - ahead[-1])


def _by_length(words: list[str]) -> tuple[dict[int, list[int]], list[int]]:
    """Places of the words of each length, and of the long words."""
    out, long = defaultdict(list), []
    for place, word in enumerate(words):
        (long if len(word) > WORD_LETTERS else out[len(word)]).append(place)
    return out, long


def with_tail(probabilities: np.ndarray) -> np.ndarray:
    """Rows for the unknown piece and for no piece, behind those of the pieces."""
    return np.vstack([probabilities, np.full(probabilities.shape[1], UNKNOWN), np.zeros(probabilities.shape[1])])


def _sample(labelled: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` documents of each language: a hash of text and id below a share."""
    sizes = labelled.groupBy("_lang").agg(F.count("*").alias("_n"))
    spread = F.pmod(F.xxhash64("_id", "_text", F.lit(7)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return labelled.join(F.broadcast(sizes), "_lang").where(spread * F.col("_n") < per_language)


def fit_languages(
    docs: DataFrame,
    pieces: list[str],
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE,
) -> tuple[list[str], np.ndarray]:
    """(languages in order, piece probabilities by language).

    Learns from rows where ``learn`` holds and the language is not null, on a sample of about
    ``per_language`` documents of each. Counting is distributed; the driver gets sums per
    piece and language, so as many numbers as the vocabulary has. Without any such row there
    is no language.
    """
    labelled = docs.where(learn).select(
        F.col(id_col).cast("long").alias("_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        F.col(lang_col).alias("_lang"),
    ).where(F.col("_lang").isNotNull())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            sums: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums.update((lang, w) for w in words_of(text))
            if sums:
                langs, words = zip(*sums, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs), pa.array(words), pa.array(list(sums.values()))], names=["lang", "word", "n"]
                )

    sampled = _sample(labelled, per_language).select("_lang", "_text")
    counts = sampled.mapInArrow(counted, "lang string, word string, n long")
    words = cut_lineage(counts.groupBy("word", "lang").agg(F.sum("n").alias("n")).repartition("word"))
    languages = sorted(r.lang for r in words.select("lang").distinct().collect())
    if not languages:
        return [], np.zeros((len(pieces), 0))
    column = {lang: i for i, lang in enumerate(languages)}
    probabilities = np.full((len(pieces), len(languages)), 1.0 / len(pieces))
    context = docs.sparkSession.sparkContext
    for _ in range(EM_ROUNDS):
        shared = context.broadcast((pieces, with_tail(probabilities)))

        def expected(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            pieces, chance = shared.value
            lattice, total = Lattice(pieces), np.zeros((len(pieces), chance.shape[1]))
            for frame in frames:
                table = frame.pivot_table(index="word", columns="lang", values="n", fill_value=0)
                times = np.zeros((len(table), chance.shape[1]))
                for lang in table.columns:
                    times[:, column[lang]] = table[lang]
                total += lattice.expected([BEGIN + w for w in table.index], times, chance)
            at, language = np.nonzero(total)
            yield pd.DataFrame({"piece": at, "language": language, "n": total[at, language]})

        sums = words.mapInPandas(expected, "piece int, language int, n double")
        sums = sums.groupBy("piece", "language").agg(F.sum("n").alias("n")).toPandas()
        total = np.full(probabilities.shape, SMOOTHING)
        total[sums["piece"], sums["language"]] += sums["n"]
        probabilities = total / total.sum(axis=0)
    return languages, probabilities


class Scorer:
    """Scores whole texts; remembers words up to a bound."""

    def __init__(self, pieces: list[str], probabilities: np.ndarray):
        self.lattice, self.chance = Lattice(pieces), with_tail(probabilities)
        self.place: dict[str, int] = {}
        self.letters = 0
        self.rows = np.zeros((1024, probabilities.shape[1]))

    def _learn(self, words: list[str]) -> None:
        first = len(self.place)
        if first + len(words) > len(self.rows):
            wider = np.zeros((2 * (first + len(words)), self.rows.shape[1]))
            wider[:first] = self.rows[:first]
            self.rows = wider
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            self.rows[first + at : first + at + len(part)] = self.lattice.log_chance([BEGIN + w for w in part], self.chance)
        self.place.update(zip(words, range(first, first + len(words)), strict=True))

    def prepare(self, words: set[str]) -> None:
        """Score in one go what many texts will ask for."""
        missing = words.difference(self.place)
        if missing and (len(self.place) + len(missing) > REMEMBERED or self.letters > REMEMBERED * WORD_LETTERS):
            self.place.clear()
            self.letters, missing = 0, words
        if missing:
            self.letters += sum(map(len, missing))
            self._learn(list(missing))

    def totals(self, words: list[str]) -> np.ndarray:
        """Log probability of the words under every language."""
        place = self.place
        return self.rows[[place[w] for w in words]].sum(axis=0)


def posterior(totals: np.ndarray) -> tuple[int, float]:
    """Best language and its share of the probability, all languages alike beforehand."""
    best = int(totals.argmax())
    return best, 1.0 / float(np.exp(totals - totals[best]).sum())


def _predicted(scorer: Scorer, languages: list[str], texts: list[str]) -> tuple[list[str], list[float]]:
    names, scores = [], []
    for at in range(0, len(texts), 64):
        words = [words_of(t) for t in texts[at : at + 64]]
        scorer.prepare(set().union(*words))
        for own in words:
            best, score = posterior(scorer.totals(own)) if own and languages else (None, 0.0)
            names.append(UNDETERMINED if best is None else languages[best])
            scores.append(score)
    return names, scores


def identify(
    docs: DataFrame,
    pieces: list[str],
    languages: list[str],
    probabilities: np.ndarray,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Id, ``lang_pred`` and ``score`` of every row, and the columns named in ``carry``.

    Null text and text without a letter are ``und`` with score 0; so is everything when no
    language was learned. Ties go to the first language by name. Repeated rows and null ids are
    scored like any other, an empty table gives no rows, other columns are not read. Whole
    texts, no shuffle; the broadcast model has vocabulary size times languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast((pieces, languages, probabilities))
    texts = texts_of(docs, id_col, text_col, carry)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        pieces, languages, probabilities = shared.value
        scorer = Scorer(pieces, probabilities)
        for batch in batches:
            names, scores = _predicted(scorer, languages, batch.column(1).to_pylist())
            arrays = [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *arrays, *batch.columns[2:]], names=schema.names
            )

    schema = T.StructType().add(id_col, "long").add("lang_pred", "string").add("score", "double")
    if carry:
        schema.add(texts.schema["_carried"])
    return texts.mapInArrow(scored, schema).select(id_col, "lang_pred", "score", *carried(carry))
