"""Language identification of mixed text: scripts narrow the candidates, and Viterbi over words labels spans.

Each word (a stretch between white space with a letter in it) gets a score for each learned language, the log posterior
from its letter trigrams under a uniform prior, cut off at `FLOOR`. Languages whose training text does not use the
word's script are no candidates for it. Viterbi finds the labels with the highest sum of scores less `SWITCH` for each
change; all documents of a chunk advance together, a word a step. A document's language is the one whose spans hold
most letters, and its score the share of all letters that they hold.

Learning: trigram counts of a bounded sample, at most about `SAMPLE` whole documents of each of `MOST_LANGUAGES`
languages, or fewer of each if there are more languages, chosen by a hash of doc_id. Each language that labels a text is
learned; more than `ALL_LANGUAGES` raise ValueError. The counts are summed by Spark; what reaches the driver is bounded
by the sample.

Defined results: `und` with score 0 for a null text, one without letters, or if nothing was learned. A text whose
scripts no learned language uses gets the most frequent language and score 0. Ties go to the language that comes first by
name. Repeated rows and null doc_ids are kept and labelled alike. An empty table gives no rows. Columns besides doc_id,
text and (in learning) lang are not read.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import record_batch
from .words import annotate

SAMPLE, MOST_LANGUAGES, ALL_LANGUAGES = 400, 64, 1000
SWITCH, FLOOR = 14.0, -4.0
KEEP = 1_000_000
UNDETERMINED = "und"

# First code point and name of script ranges; a range ends where the next begins.
_SCRIPTS = [
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"),
    (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"),
]
_STARTS = np.array([start for start, _ in _SCRIPTS])
_NAMES = sorted({name for _, name in _SCRIPTS})
#: For each code point: whether it is a letter, whether it is part of a word (a letter or a mark), and its script.
_letter = _part = _script = None


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    global _letter, _part, _script
    if _letter is None:
        n = 0x110000
        _letter = np.fromiter((chr(i).isalpha() for i in range(n)), bool, n)
        _part = _letter | np.fromiter((unicodedata.category(chr(i))[0] == "M" for i in range(n)), bool, n)
        ids = np.array([_NAMES.index(name) for _, name in _SCRIPTS], np.uint8)
        _script = ids[np.maximum(np.searchsorted(_STARTS, np.arange(n), side="right") - 1, 0)]
    return _letter, _part, _script


def script(letter: str) -> str:
    return _NAMES[_tables()[2][ord(letter)]]


_SPACE = 32


class Letters:
    """Words as code points: a space before and after each, and one for what is no letter in between. key: a number for
    each trigram, and the word that it is in. letters: how many each word has. script: that of most of them, ties to the
    first by name, or -1."""

    def __init__(self, units: list[str]):
        letter, part, kind = _tables()
        n = len(units)
        size = np.fromiter(map(len, units), np.int64, n)
        points = np.frombuffer((" ".join(["", *units, ""])).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)[: int(size.sum()) + n + 1]
        unit = np.repeat(np.arange(n), size + 1)  # each with the space before it
        points, last = points[:-1], np.cumsum(size + 1)
        points, unit = np.insert(points, last, _SPACE), np.insert(unit, last, np.arange(n))  # and its own after it
        alpha = letter[points]
        self.letters = np.bincount(unit[alpha], minlength=n)
        by_script = np.bincount(unit[alpha] * len(_NAMES) + kind[points[alpha]], minlength=n * len(_NAMES)).reshape(n, len(_NAMES)) if n else np.zeros((0, len(_NAMES)), np.int64)
        self.script = np.where(self.letters > 0, by_script.argmax(axis=1), -1) if n else np.zeros(0, np.int64)
        points = np.where(part[points], points, _SPACE)
        held = np.ones(len(points), bool)
        held[1:] = (points[1:] != _SPACE) | (points[:-1] != _SPACE) | (unit[1:] != unit[:-1])
        points, unit = points[held], unit[held]
        inside = unit[2:] == unit[:-2]
        self.key = (points[:-2] << 42 | points[1:-1] << 21 | points[2:])[inside]
        self.unit = unit[2:][inside]


# --- learning -----------------------------------------------------------------------------------------------------


def sample(docs: DataFrame, per_language: int = SAMPLE, most: int = MOST_LANGUAGES) -> DataFrame:
    """About `per_language` whole documents of each language, fewer if there are more than `most`; one at least."""
    labelled = docs.filter("lang is not null and text is not null")
    point = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    shares = labelled.groupBy("lang").agg(F.count("*").alias("count"), F.min(point).alias("low"))
    n = shares.count()
    if n > ALL_LANGUAGES:
        raise ValueError(f"{n} languages, more than {ALL_LANGUAGES}")
    each = per_language if n <= most else max(1, per_language * most // n)
    shares = shares.select("lang", "low", F.least(F.lit(1.0), F.lit(each) / F.col("count")).alias("share"))
    return labelled.join(F.broadcast(shares), "lang").filter((point < F.col("share")) | (point == F.col("low"))).select("text", "lang")


def learn(docs: DataFrame, per_language: int = SAMPLE) -> "Model":
    """docs: (doc_id, text, lang), the rows to learn from."""
    schema = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                units, times = zip(*Counter(text.lower().split()).items()) if text.split() else ((), ())
                found, times = Letters(list(units)), np.array(times, np.int64)
                counts[lang, "doc", 0] += 1
                for k, n in enumerate(np.bincount(found.script + 1, weights=found.letters * times, minlength=1).tolist()[1:]):
                    counts[lang, "script", k] += int(n)
                keys, at = np.unique(found.key[found.letters[found.unit] > 0], return_inverse=True)
                for key, n in zip(keys.tolist(), np.bincount(at, weights=times[found.unit[found.letters[found.unit] > 0]], minlength=len(keys)).tolist()):
                    counts[lang, "gram", key] += int(n)
        if counts:
            yield record_batch(schema, dict(zip(schema.names, [*zip(*counts), list(counts.values())])))

    rows = sample(docs, per_language).mapInArrow(run, "lang string, kind string, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    return Model(rows.toArrow())  # bounded by the sample


class Model:
    """rows: (lang, kind, key, n), the number of documents, of letters by script and of trigrams."""

    def __init__(self, rows: pa.Table):
        lang, kind = (np.array(rows.column(c).to_pylist(), object) for c in ("lang", "kind"))
        key, n = (rows.column(c).to_numpy() for c in ("key", "n"))
        of = {name: np.flatnonzero(kind == name) for name in ("doc", "script", "gram")}
        sizes = dict(zip(lang[of["doc"]].tolist(), n[of["doc"]].tolist()))
        self.languages = sorted(sizes)
        self.common = max(range(len(sizes)), key=lambda k: (sizes[self.languages[k]], -k), default=None)
        at = {x: k for k, x in enumerate(self.languages)}
        column = np.fromiter(map(at.__getitem__, lang.tolist()), np.int64, len(lang))
        letters = np.zeros((len(_NAMES), len(at)))
        letters[key[of["script"]], column[of["script"]]] = n[of["script"]]
        self.keys, place = np.unique(key[of["gram"]].astype(np.int64), return_inverse=True)
        counts = np.zeros((len(self.keys) + 1, len(at)))  # the last row: trigrams that were not seen
        counts[place, column[of["gram"]]] = n[of["gram"]]
        smoothed = counts + 0.5
        self.logs = np.log(smoothed / smoothed.sum(axis=0)).astype(np.float32)
        #: A language uses a script that holds a hundredth of its letters or more.
        self.uses = (letters > 0) & (letters >= 0.01 * letters.sum(axis=0))

    def score(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word its scores by language, its letters, and whether some language uses its script; if none does,
        or it has no letter, its scores are 0."""
        found = Letters(units)
        n = len(units)
        row = np.minimum(np.searchsorted(self.keys, found.key), max(len(self.keys) - 1, 0))
        row = np.where(self.keys[row] == found.key, row, len(self.keys)) if len(self.keys) else np.zeros(len(found.key), np.int64)
        score = np.zeros((n, len(self.languages)), np.float32)
        first = np.flatnonzero(np.diff(found.unit, prepend=-1))
        score[found.unit[first]] = np.add.reduceat(self.logs[row], first, axis=0) if len(first) else 0
        allowed = self.uses[found.script] & (found.script >= 0)[:, None]
        scored = allowed.any(axis=1)
        score = np.where(allowed, score, -np.inf)
        score[~scored] = 0
        score -= score.max(axis=1, keepdims=True)
        score -= np.log(np.exp(score).sum(axis=1, keepdims=True))
        score = np.maximum(score, np.where(allowed, FLOOR, 2 * FLOOR))
        score[~scored] = 0
        return score.astype(np.float32), found.letters, scored


# --- labelling ----------------------------------------------------------------------------------------------------


def viterbi(scores: np.ndarray, word: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word. scores: a row for each distinct word. word: the rows of all documents' words one
    after another. lengths: words of each document. All documents take a step together; ended ones drop out."""
    n_docs, width = len(lengths), scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty(n_docs, np.int64)
    rank[order] = np.arange(n_docs)
    steps = int(lengths.max(initial=0))
    if not steps:
        return np.empty(0, np.int16)
    active = n_docs - np.searchsorted(np.sort(lengths), np.arange(steps), side="right")
    offset = np.concatenate([[0], np.cumsum(active)])
    begins = np.cumsum(lengths) - lengths
    step_of = np.arange(len(word)) - np.repeat(begins, lengths)
    place = offset[step_of] + np.repeat(rank, lengths)
    by_step = np.empty(len(word), np.int64)
    by_step[place] = word
    comes_from = np.empty(len(word), np.int16)  # the best label before, for those that switch
    switched = np.empty((len(word), width), bool)
    best = scores[by_step[: active[0]]].astype(np.float32)
    final = np.zeros(n_docs, np.int64)
    for t in range(1, steps):
        n, a, b = active[t], offset[t], offset[t + 1]
        if n < len(best):
            final[n : len(best)] = best[n:].argmax(axis=1)
            best = best[:n]
        top = best.argmax(axis=1)
        floor = best[np.arange(n), top] - np.float32(switch)
        comes_from[a:b] = top
        np.greater(floor[:, None], best, out=switched[a:b])
        best = np.maximum(best, floor[:, None]) + scores[by_step[a:b]]
    final[: len(best)] = best.argmax(axis=1)
    labels = np.empty(len(word), np.int16)
    now = np.zeros(0, np.int64)
    for t in range(steps - 1, -1, -1):
        a, b = offset[t], offset[t + 1]
        if active[t] > len(now):
            now = np.concatenate([now, final[len(now) : active[t]]])
        labels[a:b] = now
        if t:
            now = np.where(switched[a:b][np.arange(len(now)), now], comes_from[a:b], now)
    return labels[place]


class _Words:
    """Scores of the distinct words that a worker has met; it forgets all when it has KEEP, or fewer of many
    languages."""

    def __init__(self, model: Model):
        self.model = model
        #: What is held at once is less by as much as there are more languages than MOST_LANGUAGES.
        self.wide = max(1.0, len(model.languages) / MOST_LANGUAGES)
        self.keep, self.step = int(KEEP / self.wide), int((1 << 14) / self.wide)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.scores, self.letters, self.scored = np.zeros((1 << 14, len(self.model.languages)), np.float32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, bool)

    def rows(self, units: list[str]) -> np.ndarray:
        """The rows of words that are all different."""
        if len(self.index) + len(units) > self.keep:
            self._forget()
        found = list(map(self.index.get, units))
        missing = [i for i, k in enumerate(found) if k is None]
        if missing:
            first, last = len(self.index), len(self.index) + len(missing)
            new = [units[i] for i in missing]
            while last > len(self.letters):
                self.scores, self.letters, self.scored = (np.concatenate([a, np.zeros_like(a)]) for a in (self.scores, self.letters, self.scored))
            for i in range(0, len(new), self.step):
                at = slice(first + i, min(first + i + self.step, last))
                self.scores[at], self.letters[at], self.scored[at] = self.model.score(new[i : i + self.step])
            self.index.update(zip(new, range(first, last)))
            for i, k in zip(missing, range(first, last)):
                found[i] = k
        return np.array(found, np.int64)


def label_texts(words: _Words, texts: pa.Array) -> list[list[tuple[str, int, int, int]]]:
    """The spans of each text: (language, first word, words, letters), words being stretches with a letter."""
    lowered = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    cut = pc.utf8_split_whitespace(lowered)
    n_units = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.list_flatten(cut).dictionary_encode()
    rows = words.rows(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
    doc = np.repeat(np.arange(len(n_units)), n_units)
    held = words.letters[rows] > 0
    rows, doc = rows[held], doc[held]
    lengths = np.bincount(doc, minlength=len(n_units))
    labels = viterbi(words.scores, rows, lengths)
    letters, scored = words.letters[rows], words.scored[rows]
    first = np.cumsum(lengths) - lengths
    out: list[list[tuple[str, int, int, int]]] = [[] for _ in n_units]
    if len(rows):
        new = np.flatnonzero(np.concatenate([[True], (np.diff(labels) != 0) | (np.diff(doc) != 0)]))
        n_words = np.diff(np.append(new, len(rows)))
        n_letters = np.add.reduceat(letters, new)
        any_scored = np.add.reduceat(scored.astype(np.int64), new)
        for i, n, m, s in zip(new.tolist(), n_words.tolist(), n_letters.tolist(), any_scored.tolist()):
            d = doc[i]
            out[d].append((words.model.languages[labels[i]] if s else None, i - int(first[d]), n, m))
    return out


_SPAN = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """`row`, a struct of the columns in `keep` (all), with lang_pred, score and spans, an array of (lang, first_word,
    n_words) over the words with a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        own = shared.value
        words = _Words(own) if own.languages else None

        def compute(texts: pa.Array) -> list[pa.Array]:
            n = len(texts)
            if words is None:
                return [pa.array([UNDETERMINED] * n), pa.array([0.0] * n), pa.array([[]] * n, _SPAN)]
            preds, scores, spans = [], [], []
            for found in label_texts(words, texts):
                totals: Counter = Counter()
                for lang, _, _, letters in found:
                    totals[lang] += letters
                whole = sum(totals.values())
                totals.pop(None, None)
                lang = min(totals, key=lambda x: (-totals[x], x)) if totals else own.languages[own.common] if whole else UNDETERMINED
                preds.append(lang)
                scores.append(totals[lang] / whole if whole else 0.0)
                spans.append([{"lang": x or UNDETERMINED, "first_word": a, "n_words": n} for x, a, n, _ in found])
            return [pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, _SPAN)]

        return compute

    return annotate(docs, keep or docs.columns, work, "lang_pred string, score double, spans array<struct<lang:string,first_word:long,n_words:long>>", max_bytes=int((8 << 20) / max(1.0, len(model.languages) / MOST_LANGUAGES)))


def held_out(doc_id: Column) -> Column:
    """A null doc_id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def op5_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, learn(docs.filter(~held_out(F.col("doc_id")))), ["doc_id"])
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
