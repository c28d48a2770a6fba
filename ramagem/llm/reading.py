"""Reading level of documents: regularised ordinal regression over features of the text, calibrated to graded texts.

Features: lexical diversity, word rarity, connectives, a proxy of clause depth, word and sentence length. Rarity needs
the frequency of every word of the corpus; it is counted over all documents into a fixed number of hash counters, so
what the workers get has the same size for any corpus. The model is a proportional-odds regression with an L2 penalty,
fitted on a bounded sample of graded documents, cut points and all; it gives a probability for each band.

Null, empty and blank texts have no band (null). Texts are read whole. Several grades of one document are averaged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ramagem.llm.codepoints import SEPARATOR, WordTable, class_table, classes, expand, hash_of, points, run_hashes, runs

#: Hash counters of word frequencies.
WORD_COUNTERS = 1 << 18
#: Most graded documents the model is fitted on, chosen by hash of their id.
MAX_GRADED = 20_000
PENALTY = 1.0
BANDS = 5

#: Longer runs of letters (keyboard runs, encoded data) tell nothing of the length and rarity of words; their share is a feature of its own.
LENGTH_COUNTED = 24
#: Words are told apart for the diversity in windows of so many.
DIVERSITY_WINDOW = 50
#: Characters read at a time.
CHUNK_CHARS = 1 << 21
_URL = re.compile(r"https?://\S+|www\.\S+|\S+@\S+|`[^`\n]*`|<[^<>\n]{1,200}>|&[#\w]{2,8};")
_VOWELS = re.compile(r"[aeiouyáéíóúâêôãõàü]+")
_LETTER, _STOP, _COMMA, _APART = 1, 2, 4, 8
_CLASS: list[np.ndarray] = []


def _class() -> np.ndarray:
    if not _CLASS:
        _CLASS.append(class_table(str.isalpha, ".!?…\n", ",;:", "\x1e"))
    return _CLASS[0]


# Fixed word lists in Portuguese, Spanish and English.
CONNECTIVES = """
além ademais contudo todavia entretanto portanto logo assim porém outrossim destarte conforme consoante segundo entanto contrapartida sobretudo enquanto tanto
además asimismo obstante tanto mientras según conforme
moreover furthermore however therefore thus hence nevertheless nonetheless consequently whereas accordingly according although
""".split()
#: Connectives of two words.
CONNECTIVE_PAIRS = (("sin", "embargo"),)
SUBORDINATORS = """
que porque embora conquanto porquanto quando se como cujo cuja qual quais onde enquanto caso ainda apesar sem pois
aunque cuando si donde cuyo cuya cual porque pues sino mientras
that which because although though when if whose where while since unless whether who
""".split()
FUNCTION_WORDS = {
    "pt": "o a os as um uma de do da dos das em no na nos nas e é não que com por para se eu meu minha".split(),
    "es": "el la los las un una de del en y es no que con por para se yo mi su lo al".split(),
    "en": "the a an of in on and is not that with by for if i my it to was this".split(),
}
_CONNECTIVES, _SUBORDINATORS = frozenset(CONNECTIVES), frozenset(SUBORDINATORS)
_FUNCTION = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}
#: A word is rare from this surprise (minus the logarithm of its share of all words) on, a sentence hard from this mean length of its words on.
RARE_WORD, HARD_SENTENCE = 9.0, 6.2
FEATURES = (
    "log_words", "word_length", "word_length_sd", "long_words", "very_long_words", "syllables", "diversity", "rarity", "rarity_high", "rare_words",
    "sentence_length", "sentence_length_max", "commas", "connectives", "subordinators", "depth", "top_sentence_words", "low_sentence_words", "hard_sentences", "lang_en", "lang_es", "runs",
)


def counter_of(word: str) -> int:
    return (hash_of(word) >> 1) & (WORD_COUNTERS - 1)


_PAIRS = {w: i for i, (w, _) in enumerate(CONNECTIVE_PAIRS)}, {w: i for i, (_, w) in enumerate(CONNECTIVE_PAIRS)}


def _facts(word: str) -> tuple:
    """Counter, length, syllables, connective, subordinator, language, and the numbers of the pairs that it begins and ends."""
    kind = [int(word in v) for v in _FUNCTION.values()]
    return (counter_of(word), min(len(word), LENGTH_COUNTED + 1), len(_VOWELS.findall(word)), word in _CONNECTIVES, word in _SUBORDINATORS, *kind, _PAIRS[0].get(word, -1), _PAIRS[1].get(word, -2))


_COLUMNS = (np.int32, np.int16, np.int16, bool, bool, np.int8, np.int8, np.int8, np.int8, np.int8)


class Reader:
    """The words of many texts in order, as arrays."""

    def __init__(self) -> None:
        self.words = WordTable(_facts, _COLUMNS)

    def read(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        clean = [_URL.sub(" ", t).lower() if t else "" for t in texts]
        whole = SEPARATOR.join(clean)
        if whole.count("\x1e") >= max(1, len(clean)):
            whole = SEPARATOR.join(t.replace("\x1e", " ") for t in clean)
        code = points(whole)
        kind = classes(_class(), code)
        first, last = runs((kind & _LETTER) > 0)
        hashes = run_hashes(code, first, last)
        row = self.words.rows(whole, first, last, hashes)
        sentence = np.cumsum((kind & _STOP) > 0, dtype=np.int32)[first]
        apart = np.cumsum((kind & _APART) > 0, dtype=np.int32)
        out = dict(zip(("counter", "length", "syllables", "connective", "subordinator", "pt", "es", "en", "begins", "ends"), (c[row] for c in self.words.columns)))
        commas = np.bincount(apart[(kind & _COMMA) > 0], minlength=len(texts))
        return out | {"word": hashes, "sentence": sentence, "text": apart[first], "commas": commas}


def _chunked(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about CHUNK_CHARS, with the number of the first; one long text is a run of its own."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > CHUNK_CHARS:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += n
    if texts:
        yield begin, texts[begin:]


def count_words(documents: DataFrame) -> np.ndarray:
    """Occurrences of all words of all documents in hash counters. Partial counts are merged before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, table = Reader(), np.zeros(WORD_COUNTERS, np.int64)
        for batch in batches:
            for _, texts in _chunked(batch.column(0).to_pylist()):
                table += np.bincount(reader.read(texts)["counter"], minlength=WORD_COUNTERS)
        used = np.flatnonzero(table)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(table[used])], names=["counter", "n"])

    counted = documents.select("text").mapInArrow(run, "counter int, n bigint").groupBy("counter").agg(F.sum("n").alias("n"))
    out = np.zeros(WORD_COUNTERS, np.int64)
    rows = counted.toArrow()  # at most WORD_COUNTERS rows
    out[rows.column("counter").to_numpy()] = rows.column("n").to_numpy()
    return out


def _quantiles(group: np.ndarray, value: np.ndarray, first: np.ndarray, size: np.ndarray, q: float) -> np.ndarray:
    """Quantiles with linear interpolation of the values of each group; groups in order, none empty."""
    ordered = value[np.lexsort((value, group))]
    at = (size - 1) * q
    low = np.floor(at).astype(np.int64)
    a = ordered[first + low]
    return a + (ordered[first + np.minimum(low + 1, size - 1)] - a) * (at - low)


class FeatureMaker:
    """Turns texts into feature rows, given the word counters of the corpus."""

    def __init__(self, counters: np.ndarray):
        total = max(1, int(counters.sum()))
        self.surprise = np.log((total + WORD_COUNTERS) / (counters + 1.0)).astype(np.float32)
        self.reader = Reader()

    def rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the text, features) of the texts that have words."""
        parts = [(np.zeros(0, np.int64), np.zeros((0, len(FEATURES))))]
        for begin, some in _chunked(texts):
            at, x = self._rows(some)
            parts.append((at + begin, x))
        return np.concatenate([a for a, _ in parts]), np.concatenate([x for _, x in parts])

    def _rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        r = self.reader.read(texts)
        if not len(r["word"]):
            return np.zeros(0, np.int64), np.zeros((0, len(FEATURES)))
        first = np.flatnonzero(np.diff(r["text"], prepend=-1))
        at = r["text"][first].astype(np.int64)
        n = np.diff(first, append=len(r["word"])).astype(float)
        group = np.repeat(np.arange(len(at)), n.astype(np.int64))
        total = lambda v: np.bincount(group, v, minlength=len(at))
        proper = r["length"] <= LENGTH_COUNTED
        length, surprise = r["length"] * proper.astype(float), self.surprise[r["counter"]] * proper.astype(float)
        counted = np.maximum(1.0, total(proper))
        mean = total(length) / counted
        pairs = np.zeros(len(group), bool)
        pairs[:-1] = (r["begins"][:-1] == r["ends"][1:]) & (r["sentence"][:-1] == r["sentence"][1:])
        # sentences
        s_first = np.flatnonzero(np.diff(r["sentence"], prepend=-1))
        sizes = np.diff(s_first, append=len(group)).astype(float)
        s_group = group[s_first]
        s_mean = np.add.reduceat(length, s_first) / np.maximum(1.0, np.add.reduceat(proper.astype(float), s_first))
        s_count = np.bincount(s_group, minlength=len(at))
        s_begin = np.searchsorted(s_group, np.arange(len(at)))
        # windows for the diversity; a short last one counts only if it is the only one
        place = np.arange(len(group)) - first[group]
        window, w_size = place // DIVERSITY_WINDOW, n.astype(np.int64)
        key = np.lexsort((r["word"], window, group))
        fresh = (np.diff(group[key], prepend=-1) != 0) | (np.diff(window[key], prepend=-1) != 0) | (np.diff(r["word"][key], prepend=np.uint64(0)) != 0)
        windows = -(-w_size // DIVERSITY_WINDOW)
        w_first = np.concatenate(([0], np.cumsum(windows)))
        slot = w_first[group] + window
        distinct = np.bincount(slot[key][fresh], minlength=w_first[-1])
        held = np.bincount(slot, minlength=w_first[-1])
        w_group, w_place = expand(np.zeros(len(at), np.int64), windows)
        use = (held * 2 >= DIVERSITY_WINDOW) | (w_place == 0)
        diversity = np.bincount(w_group[use], (distinct / held)[use], minlength=len(at)) / np.bincount(w_group[use], minlength=len(at))
        subordinate, commas = total(r["subordinator"]), r["commas"][at]
        share = {k: total(r[k]) / n for k in _FUNCTION}
        sentence_share = np.bincount(s_group, sizes * (s_mean > HARD_SENTENCE), minlength=len(at)) / n
        integral = first, n.astype(np.int64)
        features = (
            np.log1p(n), mean, np.sqrt(np.maximum(total(length * length) / counted - mean * mean, 0)), total(length >= 9) / n, total(length >= 13) / n, total(r["syllables"] * proper) / counted, diversity,
            total(surprise) / counted, _quantiles(group, surprise, *integral, 0.75), total(surprise > RARE_WORD) / n,
            np.log1p(np.bincount(s_group, sizes, minlength=len(at)) / s_count), np.log1p(np.maximum.reduceat(sizes, s_begin)), commas / n, total(r["connective"] | pairs) / n, subordinate / n,
            (subordinate + commas) / s_count, _quantiles(s_group, s_mean, s_begin, s_count, 0.9), _quantiles(s_group, s_mean, s_begin, s_count, 0.1), sentence_share, share["en"] - share["pt"], share["es"] - share["pt"], total(~proper) / n,
        )
        return at, np.stack(features, 1)


@dataclass
class OrdinalModel:
    """P(band > k) = sigmoid(x . weights - cuts[k])."""

    mean: np.ndarray
    scale: np.ndarray
    knots: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    @staticmethod
    def _expand(z: np.ndarray, knots: np.ndarray) -> np.ndarray:
        """Standardised features and their parts beyond each knot (piecewise linear)."""
        return np.hstack([z] + [np.maximum(0.0, z - k) for k in knots.T[:, None, :]] if len(knots) else [z])

    def design(self, x: np.ndarray) -> np.ndarray:
        return self._expand(np.clip((x - self.mean) / self.scale, -5, 5), self.knots)

    def above(self, x: np.ndarray) -> np.ndarray:
        """Columns P(band > 1) .. P(band > BANDS - 1)."""
        return 1.0 / (1.0 + np.exp(self.cuts[None, :] - (self.design(x) @ self.weights)[:, None]))


def fit_ordinal(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 400) -> OrdinalModel:
    """Proportional odds by gradient descent with momentum on the penalised likelihood.

    y may lie between bands (the mean of several grades); it then counts for both neighbours in proportion.
    """
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.clip((x - mean) / scale, -5, 5)
    knots = np.quantile(z, [0.33, 0.67], axis=0).T
    model = OrdinalModel(mean, scale, knots, np.zeros(0), np.zeros(0))
    d = model.design(x)
    n, m = d.shape
    low = np.floor(y).astype(int)
    part = y - low
    target = np.stack([(low > k) + (low == k) * part for k in range(1, BANDS)], 1)  # P(band > k)
    start = np.clip(target.mean(0), 0.01, 0.99)
    cuts = np.log((1 - start) / start)
    weights = np.zeros(m)
    # the cut-wise likelihood is convex; its curvature is bounded by that of the design
    step = 1.0 / (0.25 * (BANDS - 1) * np.linalg.norm(d, 2) ** 2 / n + penalty / n)
    vw, vc, momentum = np.zeros(m), np.zeros(BANDS - 1), 0.0
    for i in range(steps * 5):
        momentum = i / (i + 3)
        w, c = weights + momentum * vw, cuts + momentum * vc
        p = 1.0 / (1.0 + np.exp(c[None, :] - (d @ w)[:, None]))
        gap = p - target
        gw = d.T @ gap.sum(1) / n + penalty * w / n
        gc = -gap.mean(0)
        new_w, new_c = w - step * gw, c - min(4.0, step * 4) * gc
        vw, vc, weights, cuts = new_w - weights, new_c - cuts, new_w, new_c
    cuts = np.maximum.accumulate(cuts)
    return OrdinalModel(mean, scale, knots, weights, cuts)


_SCORED = "doc_id bigint, level double, band int, p_hard double"


def graded_sample(documents: DataFrame, grades: DataFrame, limit: int = MAX_GRADED) -> DataFrame:
    """(doc_id, text, band) of at most `limit` graded documents with text; the band is the mean of its grades."""
    mean = grades.where("band is not null").groupBy("doc_id").agg(F.avg("band").alias("band"))
    few = mean.orderBy(F.xxhash64("doc_id")).limit(limit)
    return documents.where("text is not null").select("doc_id", "text").join(F.broadcast(few), "doc_id")


def fit(documents: DataFrame, grades: DataFrame, limit: int = MAX_GRADED) -> tuple[OrdinalModel | None, np.ndarray]:
    """The model, or None without graded texts, and the word counters of the corpus."""
    counters = count_words(documents)
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(counters)  # WORD_COUNTERS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = FeatureMaker(shared.value)
        for batch in batches:
            at, x = maker.rows(batch.column("text").to_pylist())
            if len(at):
                band = batch.column("band").cast(pa.float64()).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), band], names=["x", "band"])

    seen = graded_sample(documents, grades, limit).select("text", "band").mapInArrow(run, "x array<double>, band double").toArrow()
    if not seen.num_rows:
        return None, counters
    x = np.array(seen.column("x").to_pylist())
    y = np.clip(seen.column("band").to_numpy(), 1, BANDS)
    order = np.lexsort((*x.T, y))  # the same fit whatever the order of arrival
    return fit_ordinal(x[order], y[order]), counters


def score(documents: DataFrame, model: OrdinalModel | None, counters: np.ndarray, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, level, band, p_hard, *extra): expected band, most likely band and P(band >= 4); nulls for texts without words."""
    shared = documents.sparkSession.sparkContext.broadcast((model, counters))
    kinds = {f.name: f.dataType for f in documents.schema.fields}
    schema = T.StructType([*T._parse_datatype_string(_SCORED).fields, *(T.StructField(c, kinds[c]) for c in extra)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counters = shared.value
        maker = FeatureMaker(counters)
        for batch in batches:
            at, x = maker.rows(batch.column("text").to_pylist()) if model else (np.zeros(0, np.int64), np.zeros((0, len(FEATURES))))
            level, band, hard = (np.full(batch.num_rows, np.nan) for _ in range(3))
            if len(at):
                above = model.above(x)
                level[at] = 1 + above.sum(1)
                band[at] = 1 + (above >= 0.5).sum(1)
                hard[at] = above[:, 2]
            mask = np.isnan(level)
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(level, mask=mask), pa.array(np.where(mask, 0, band).astype(np.int32), mask=mask), pa.array(hard, mask=mask)]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c) for c in extra)], names=["doc_id", "level", "band", "p_hard", *extra])

    return documents.select("doc_id", "text", *extra).mapInArrow(run, schema)
