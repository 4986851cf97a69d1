"""Reading level of each document: a linear ranker learned from graded pairs, calibrated into levels."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells that runs of characters are counted in.
CELLS = 1 << 14

#: Frequent function words that the languages don't share.
FUNCTION_WORDS = {
    "en": "the and of to is was it that for with this my i not are were have had we they you but on from at be which its has by our than",
    "de": "der die das und ist nicht ich wir sie mit den dem ein eine einen auf für im war sehr von zu hat noch aber nach seit meine auch wurde dass sich",
    "fr": "le la les et est une un des du je nous vous pas pour dans que qui très sur au avec ce cette elle il sont était plus déjà après depuis par",
    "es": "el la los las y es una un de que no en por para con muy del se lo mi me este esta ya pero más al su desde después hace fue sigue uso",
    "it": "il lo gli di che non per con una un è sono molto della del nel alla anche più questo questa ho ma dopo ancora mia mio stato da",
}
#: Words that open subordinate clauses or join thoughts in English.
CONNECTIVES = "although though because since whereas while unless until whether which whose whereby thereby therefore however notwithstanding despite nevertheless moreover furthermore consequently whereupon hence subsequently"
#: Endings of abstract nouns, and pronouns.
SUFFIXES = ("tion", "ment", "ity", "ance", "ence", "ness", "ism")
PRONOUNS = "i we my our it you she he they"
#: Abbreviations whose full stop ends no sentence, as a pattern.
ABBREVIATIONS = r"approx|incl|excl|cf|e\.g|i\.e|viz|vs|no|mr|mrs|dr|st"
#: Accented vowels and the plain ones meant where English is written with accents.
ACCENTED, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÝ", "aaaaaaeeeeiiiiooooouuuuyyAAAAAAEEEEIIIIOOOOOUUUUY"

_TAG = re.compile(r"<[^<>]{0,200}>")
_BLOCK = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|h[1-6])\b[^<>]{0,200}>", re.I)
_LINE = re.compile(r"\n\s*(?=\S)")
_WORD, _ASCII_WORD = re.compile(r"[^\W\d_]+"), re.compile("[a-z]+")
_END = re.compile(r"[.!?]+[\"')\]]*(?=\s|$)")
# looks back from full stops, for looking for abbreviations at every character takes ten times as long
_NO_END = re.compile(r"\.(?=\s|$)(?:" + "|".join(rf"(?<=\b{a}\.)" for a in ABBREVIATIONS.split("|")) + ")", re.I)
_VOWELS = re.compile(r"[aeiouy]+")
_PLAIN = str.maketrans(ACCENTED, PLAIN)
_SETS = {lang: frozenset(listed.split()) for lang, listed in FUNCTION_WORDS.items()}
_LANGUAGES = list(FUNCTION_WORDS)
_CONNECTIVES = frozenset(CONNECTIVES.split())
_PRONOUNS = frozenset(PRONOUNS.split())
#: Columns of a word before its languages, and features of a text.
_WORD_COLUMNS, _FEATURES = 10, 13


def _cells(word: str) -> list[int]:
    """The cells of a word's runs of three characters, its ends marked."""
    w = f"^{word}$".encode("utf-32-le")
    return [zlib.crc32(w[i : i + 12]) % CELLS for i in range(0, len(w) - 8, 4)]


def _words(text: str) -> list[str]:
    """The lower-case words of a text."""
    t = text.lower()
    return (_ASCII_WORD if t.isascii() else _WORD).findall(t)


def _folded(text: str) -> str:
    """The text after compatibility folding, without invisible format characters and combining marks."""
    t = unicodedata.normalize("NFKC", text)
    dropped = [c for c in set(t) if c > "\x7f" and unicodedata.category(c) in ("Cf", "Mn")]
    return t.translate(dict.fromkeys(map(ord, dropped))) if dropped else t


@dataclass
class LanguageModel:
    """Logarithms of how likely runs of three characters are in each of the languages of ``FUNCTION_WORDS``; a text is in the language that makes its words likeliest."""

    logs: np.ndarray

    def word(self, word: str) -> list[float]:
        return self.logs.take(_cells(word), axis=1).sum(axis=1).tolist()


def _word_row(word: str, languages: LanguageModel | None = None) -> list[float]:
    """What one lower-case word adds to its text: syntax and vocabulary counts, then for each language what speaks for it: how likely the word is there or, without a model, whether it is a function word."""
    w = word.translate(_PLAIN)
    stem = w[:-1] if w.endswith("s") else w
    return [
        len(w), len(_VOWELS.findall(w)), len(w) >= 7, len(w) >= 10, len(w) <= 3, w in _CONNECTIVES, stem.endswith(SUFFIXES), len(w) >= 5 and w.endswith("ly"), w in _PRONOUNS, w in ("the", "of"),
        *(languages.word(word) if languages else [word in _SETS[lang] for lang in _LANGUAGES]),
    ]


class _Numbers(dict):
    """Numbers of words, given as they are first asked for; ``words`` lists them in that order."""

    def __init__(self):
        super().__init__()
        self.words = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        return n


class Analyser:
    """Features of whole texts. What a word adds is computed once per word; texts are sums of rows of that table."""

    def __init__(self, remembered: int = 500_000, languages: LanguageModel | None = None):
        self.remembered, self.languages, self.ids = remembered, languages, _Numbers()
        self.table = np.empty((0, _WORD_COLUMNS + len(_LANGUAGES)), np.float64)

    def analyse(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features, whether English, blank-separated words) of each text; a NULL text is like an empty one.

        A text is English if that is the likeliest of the model's languages or, without a model, if English function words outnumber those of each other language.
        A sentence ends at a mark; in a text without any, at the end of a line. A text that has neither gets an ordinary length and is told by the last feature, so that
        the ranker learns what to make of it.
        """
        if len(self.ids) > self.remembered:
            self.ids, self.table = _Numbers(), self.table[:0]
        found, lengths, other = [], [], []
        for t in texts:
            t = t or ""
            blank = len(t.split())
            if "<" in t:
                t = _TAG.sub(" ", _BLOCK.sub("\n", t))
            if not t.isascii():
                t = _folded(t)
            before = len(found)
            found += map(self.ids.__getitem__, _words(t))
            lengths.append(len(found) - before)
            ends = len(_END.findall(t))
            ends = ends - len(_NO_END.findall(t)) if ends else 0
            if not ends and (lines := len(_LINE.findall(t.strip()))):
                ends = lines + 1
            other.append((ends, t.count(",") + t.count(";") + t.count(":"), blank))
        if new := self.ids.words[len(self.table) :]:
            self.table = np.concatenate([self.table, np.array([_word_row(w, self.languages) for w in new], np.float64)])
        sums = np.zeros((len(texts), self.table.shape[1]))
        n = np.array(lengths, int)
        if found:
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            filled = n > 0
            sums[filled] = np.add.reduceat(self.table[np.array(found)], starts[filled], axis=0)
        ends, commas, blank = np.array(other, float).reshape(len(texts), 3).T
        tokens = np.maximum(n, 1)
        unknown = ends < 1
        length = np.where(unknown, 15.0, tokens / np.maximum(ends, 1.0))
        w = sums[:, :_WORD_COLUMNS] / tokens[:, None]
        x = np.column_stack([w[:, 0], np.log(length), w[:, 1:6], commas / tokens, w[:, 6:], unknown])
        lang = sums[:, _WORD_COLUMNS:]
        english = (n > 0) & (lang[:, 0] > lang[:, 1:].max(axis=1))
        return x, english, blank.astype(int)


@dataclass
class Ranker:
    """score = (features - mean) / scale . weights; ``cuts`` are the scores from which levels 2, 3, ... hold."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    lowest: int
    cuts: list[float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights

    def levels(self, x: np.ndarray) -> np.ndarray:
        return self.lowest + np.searchsorted(np.array(self.cuts), self.scores(x), side="right")


def isotonic(y: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence closest to ``y`` (pool adjacent violators)."""
    means, sizes = [], []
    for v in y.astype(float):
        means.append(v)
        sizes.append(1)
        while len(means) > 1 and means[-2] > means[-1]:
            n = sizes[-2] + sizes[-1]
            means[-2:] = [(means[-2] * sizes[-2] + means[-1] * sizes[-1]) / n]
            sizes[-2:] = [n]
    return np.repeat(means, sizes)


def _pair_sums(z: np.ndarray, y: np.ndarray, s: np.ndarray, *, width: float = 2.0, points: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Over all pairs of documents i, j with y[i] > y[j]: the sums of p d and of p (1 - p) d d', where d = z[i] - z[j] and p = 1 / (1 + exp(s[i] - s[j])).

    No pair is left out, nor are pairs visited one by one: p is smooth in both scores, so a document counts as weights on the Chebyshev ``points`` of its score's interval (which is exact to
    rounding at this ``width``), and pairs of documents become pairs of points. Where points outnumber documents, the scores themselves are the points.
    """
    box, at = np.unique(np.floor(s / width), return_inverse=True)
    middle = (box + 0.5) * width
    if len(box) * points >= len(s):
        at, middle, points = np.arange(len(s)), s, 1
    angles, powers = (2 * np.arange(points) + 1) * np.pi / (2 * points), np.arange(points)
    levels, level = np.unique(y, return_inverse=True)
    order = np.lexsort((at, level))
    starts = np.flatnonzero(np.diff(level[order], prepend=-1) | np.diff(at[order], prepend=-1))
    groups = [order[i : min(i + 65_536, end)] for start, end in zip(starts, [*starts[1:], len(s)], strict=True) for i in range(start, end, 65_536)]

    def weights(rows: np.ndarray) -> np.ndarray:
        series = np.cos(np.arccos(np.clip((s[rows] - middle[at[rows[0]]]) * 2 / width, -1, 1))[:, None] * powers)
        series[:, 0] = 0.5
        return series @ np.cos(powers[:, None] * angles) * (2 / points)

    # per level and point: documents and sums of their features
    own = np.zeros((len(levels), len(middle), points, 1 + z.shape[1]))
    for rows in groups:
        own[level[rows[0]], at[rows[0]]] += weights(rows).T @ np.column_stack([np.ones(len(rows)), z[rows]])
    own = own.reshape(len(levels), -1, 1 + z.shape[1])
    below = np.cumsum(own, axis=0) - own
    others = own.sum(axis=0) - own
    at_points = (middle[:, None] + np.cos(angles) * width / 2).ravel()
    first, second, near = np.zeros(z.shape[1]), np.zeros((z.shape[1],) * 2), np.empty(own.shape[:2])
    step = max(1, (1 << 22) // len(at_points))
    for i in range(0, len(at_points), step):
        part = slice(i, i + step)
        p = 1 / (1 + np.exp(np.clip(at_points[part, None] - at_points, -700, 700)))
        q = p * (1 - p)
        for k in range(len(levels)):
            first += own[k, part, 1:].T @ (p @ below[k, :, 0]) - below[k, :, 1:].T @ (own[k, part, 0] @ p)
            mixed = q @ others[k]
            near[k, part] = mixed[:, 0]
            second -= own[k, part, 1:].T @ mixed[:, 1:]
    near = near.reshape(len(levels), len(middle), points)
    for rows in groups:
        second += z[rows].T @ (z[rows] * (weights(rows) @ near[level[rows[0]], at[rows[0]]])[:, None])
    return first, second


def fit_ranker(x: np.ndarray, y: np.ndarray, *, penalty: float = 1e-2, rounds: int = 30) -> Ranker:
    """Learn from all pairs of documents with different levels, then calibrate.

    Logistic loss on feature differences (the higher level should score higher), by Newton steps.
    Isotonic regression of level on score gives a level for every score; a level holds from the lowest score whose regression rounds to it.
    """
    if len(y) == 0:
        raise ValueError("no labelled documents")
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - mean) / scale
    sizes = np.unique(y, return_counts=True)[1].astype(float)
    pairs = (sizes.sum() ** 2 - (sizes**2).sum()) / 2
    w = np.zeros(x.shape[1])
    for _ in range(rounds if pairs else 0):
        first, second = _pair_sums(z, y, z @ w)
        gradient = first / pairs - penalty * w
        hessian = second / pairs + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    s = z @ w
    order = np.argsort(s, kind="stable")
    fit, s = isotonic(y[order]), s[order]
    lowest, highest = int(y.min()), int(y.max())
    cuts = []
    for level in range(lowest + 1, highest + 1):
        at = int(np.argmax(fit >= level - 0.5)) if (fit >= level - 0.5).any() else len(s)
        cuts.append(float("inf") if at == len(s) else float(s[at]) if at == 0 else float((s[at - 1] + s[at]) / 2))
    return Ranker(mean, scale, w, lowest, cuts)


class _Runs:
    """Counts of runs of three characters, per language and cell, in texts whose function words speak clearly for the language: outnumber those of each other language twofold and are three at least."""

    def __init__(self, remembered: int = 500_000):
        self.remembered, self.counts = remembered, np.zeros((len(_LANGUAGES), CELLS), np.int64)
        self._forget()

    def _forget(self) -> None:
        self.ids, self.speaks, self.said = _Numbers(), np.empty((0, len(_LANGUAGES)), np.int32), np.zeros((len(_LANGUAGES), 0), np.int64)

    def add(self, texts: list[str]) -> None:
        found, lengths = [], []
        for t in texts:
            before = len(found)
            found += map(self.ids.__getitem__, _words(_TAG.sub(" ", t) if "<" in t else t))
            if len(found) > before:
                lengths.append(len(found) - before)
        if not found:
            return
        if new := self.ids.words[len(self.speaks) :]:
            self.speaks = np.concatenate([self.speaks, np.array([[w in _SETS[lang] for lang in _LANGUAGES] for w in new], np.int32)])
            self.said = np.pad(self.said, ((0, 0), (0, len(new))))
        words, n = np.array(found), np.array(lengths)
        spoken = np.add.reduceat(self.speaks[words], np.cumsum(n) - n, axis=0)
        *_, second, most = np.sort(spoken, axis=1).T
        lang = np.repeat(np.where((most >= 3) & (most >= 2 * second), spoken.argmax(axis=1), -1), n)
        for i in range(len(_LANGUAGES)):
            self.said[i] += np.bincount(words[lang == i], minlength=len(self.speaks))
        if len(self.ids) > self.remembered:
            self.total()

    def total(self) -> np.ndarray:
        """The counts so far; each word's runs are looked up once, not per occurrence."""
        heard = np.flatnonzero(self.said.any(axis=0))
        if len(heard):
            cells = [_cells(self.ids.words[i]) for i in heard]
            runs, words = np.concatenate(cells), np.repeat(heard, [len(c) for c in cells])
            for i in range(len(_LANGUAGES)):
                np.add.at(self.counts[i], runs, self.said[i, words])
        self._forget()
        return self.counts


def fit_languages(documents: DataFrame, *, doc: str = "doc_id", text: str = "text", max_documents: int | None = None, smooth: float = 0.5) -> LanguageModel:
    """Learn languages from all documents that have a text. Only a caller who gives ``max_documents`` gets a model of about so many, chosen by hash.

    Texts whose function words speak clearly for one language are its examples; how often runs of three characters occur in them, counted where the texts are, is the model. It then judges
    every text by all its words. A language without examples is never the likeliest. Language labels play no part, for they may be wrong.
    """
    read = documents.filter(F.col(text).isNotNull())
    if max_documents is not None and (n := documents.count()) > max_documents:
        read = read.filter(F.pmod(F.xxhash64(F.col(doc), F.lit("language")), F.lit(1_000_000_000)) < F.lit(int(1_000_000_000 * max_documents / n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs()
        for batch in batches:
            runs.add(batch.column(0).to_pylist())
        counts = runs.total()
        lang, cell = counts.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(cell, pa.int32()), pa.array(counts[lang, cell], pa.int64())], names=["lang", "cell", "n"])

    counts = np.zeros((len(_LANGUAGES), CELLS))
    # at most a row per language and cell
    for r in read.select(text).mapInArrow(run, "lang int, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n")).collect():
        counts[r["lang"], r["cell"]] = r["n"]
    totals = counts.sum(axis=1, keepdims=True)
    logs = np.log((counts + smooth) / (totals + smooth * CELLS))
    logs[totals[:, 0] == 0] = -100.0
    return LanguageModel(logs)


def labelled_features(documents: DataFrame, labels: DataFrame, *, doc: str = "doc_id", text: str = "text", level: str = "level") -> tuple[np.ndarray, np.ndarray]:
    """Features and levels of all labelled documents: a dozen numbers for each go to the driver. Labels that are NULL or of unknown documents are left out; of several labels of a document the largest counts."""
    judged = labels.filter(F.col(doc).isNotNull() & F.col(level).isNotNull()).groupBy(F.col(doc).alias("__d")).agg(F.max(level).alias("__y"))
    joined = documents.select(F.col(doc).alias("__k"), F.col(text).alias("__t")).join(judged, F.col("__k") == F.col("__d")).filter("__t IS NOT NULL").select("__k", "__y", "__t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analyser = Analyser()
        for batch in batches:
            x, _, _ = analyser.analyse(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["k", "y", "x"])

    schema = T.StructType([T.StructField("k", joined.schema["__k"].dataType), T.StructField("y", joined.schema["__y"].dataType), T.StructField("x", T.ArrayType(T.DoubleType()))])
    rows = joined.mapInArrow(run, schema).toArrow().sort_by("k")
    x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in rows["x"].chunks] or [np.empty(0)])
    return x.reshape(-1, _FEATURES), np.array(rows["y"].to_pylist(), int)


def reading_levels(documents: DataFrame, ranker: Ranker, *, text: str = "text", keep: list[str] | None = None, languages: LanguageModel | None = None) -> DataFrame:
    """The columns ``keep`` (by default all but the text) with ``score``, ``level``, ``english`` and ``words`` (they replace columns of those names).

    ``words`` are blank-separated; score and level are NULL for NULL texts. One pass over the documents, no shuffle; texts go to Python in Arrow batches and are scored a batch at a time.
    ``languages`` (of ``fit_languages``) tells which texts are English; without it their function words do.
    """
    made = ("score", "level", "english", "words")
    rest = [c for c in (keep if keep is not None else documents.columns) if c not in (*made, text)]
    rows = documents.select(*rest, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analyser = Analyser(languages=languages)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            x, english, blank = analyser.analyse(texts.to_pylist())
            absent = texts.is_null().to_numpy(zero_copy_only=False)
            score = ranker.scores(x) if len(x) else np.empty(0)
            level = ranker.lowest + np.searchsorted(np.array(ranker.cuts), score, side="right")
            columns = [*[batch.column(i) for i in range(batch.num_columns - 1)], pa.array(score, pa.float64(), mask=absent), pa.array(level, pa.int32(), mask=absent), pa.array(english), pa.array(blank, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, *made])

    kinds = (T.DoubleType(), T.IntegerType(), T.BooleanType(), T.IntegerType())
    return rows.mapInArrow(run, T.StructType([*[rows.schema[c] for c in rest], *[T.StructField(n, k) for n, k in zip(made, kinds, strict=True)]]))
