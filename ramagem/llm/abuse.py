"""Abusive, hateful and sexual content: nearest labelled examples by exact TF-IDF cosine over a block-max index.

A comment is read in segments (sentences, and windows of long ones), because abuse is often one sentence of many. Terms
are words and word pairs, told apart by hashes of 40 bits; their document frequencies are counted over all comments in
TERM_SPACE counters. Labelled comments give labelled segments: of a flagged comment the segments that look like those of
other flagged comments, and unlike those of clean ones, carry its flag. The index keeps postings in blocks with the
largest weight of each, so that blocks (and whole lists of common terms) that cannot lift a segment over the bar are never
read; what remains is scored exactly. The nearest examples vote with weights by distance. A few examples that share a
segment's most telling terms give a first bar; if no flagged example can be nearer than NEIGHBOURS of them, the vote is 0
and nothing else is searched, with the same result. Votes are calibrated to probabilities by leaving each labelled
comment out in turn, and the probabilities corrected for the rate of flagged comments among all (labels over-represent
them), which is estimated from the share of high votes among all comments. A comment scores as its worst segment; the nearest flagged
example is given as evidence.

Null, empty and blank bodies and moderation markers score 0 without evidence. Bodies are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ramagem.llm.codepoints import SEPARATOR, HashTable, WordTable, class_table, classes, expand, hash_of, mixed, points, run_hashes, runs
from ramagem.session import cut_lineage

#: Number of counters of document frequencies.
TERM_SPACE = 1 << 20
#: Most flagged and most clean labelled comments used as examples, chosen by hash of their id.
MAX_FLAGGED, MAX_CLEAN = 6_000, 6_000
#: Neighbours that vote, and the cosine below which none does.
NEIGHBOURS, LEAST_COSINE = 9, 0.35
#: An example counts as flagged from this share of its labels on, else as clean.
FLAGGED_FROM = 0.25
#: A vote weighs cosine to this power.
VOTE_POWER = 4.0
#: Weight of a silent vote for "clean", so that one distant neighbour does not decide.
CLEAN_VOTE = 0.02
BLOCK = 16
WINDOW, STRIDE = 14, 9
BATCH_SEGMENTS = 8192
#: Queries times documents scored at a time.
CELLS_AT_ONCE = 4_000_000
#: The weakest terms of a query, up to this part of its bar, bring up no candidates.
WEAK_PART = 0.5
#: Terms of a query and examples of each (those with its largest weights) that are tried for a first bar, and for a second where that won't do.
SEEDS = (2, 9), (6, 16), (12, 40)
#: Scored segments a worker remembers; a bound on memory, without effect on results.
REMEMBERED = 1 << 18
MARKERS = frozenset(("[deleted]", "[removed]", "[automoderator]", "[empty]"))

_INVISIBLE_CHARS = "\u00ad\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\ufeff"
_COMBINING_CHARS = "".join(map(chr, range(0x300, 0x370)))
_INVISIBLE = re.compile(f"[{_INVISIBLE_CHARS}]+")
_COMBINING = re.compile(f"[{_COMBINING_CHARS}]+")
_ENTITY = re.compile(r"&(?:amp;)?[#\w]{2,8};")
_LINK = re.compile(r"https?://\S+|!?\[[^\]\n]*\]\([^)\n]*\)")
_REPEAT = re.compile(r"(.)\1{2,}")
_STARS = re.compile(r"\*+")
# Fixed tables: digits and signs written for letters, and letters of other scripts that look like Latin ones.
_LEET = str.maketrans("0134578@$", "oieastbas")
_LOOKALIKE = str.maketrans("аеорсухіјһѕԁοαειρνкмтвн", "aeopcyxijhsdoaeipvkmtbh")
_LATIN = re.compile(r"[a-z]")
_TOKEN, _BREAK, _BLANK, _DASH, _APART = 1, 2, 4, 8, 16
_CLASS: list[np.ndarray] = []


def _class() -> np.ndarray:
    if not _CLASS:
        word = {"_", "@", "$", "*", *_INVISIBLE_CHARS, *_COMBINING_CHARS}
        _CLASS.append(class_table(lambda c: c.isalnum() or c in word, ".!?…\r\n;|", " ", "-–—", "\x1e"))
    return _CLASS[0]


def plain_word(raw: str) -> str:
    """A lower-case word without accents, disguises and drawn-out letters."""
    word = raw
    if not word.isascii():
        word = _COMBINING.sub("", unicodedata.normalize("NFKD", _INVISIBLE.sub("", word))).lower()
        if not word.isascii() and _LATIN.search(word):
            word = word.translate(_LOOKALIKE)
    if "*" in word:
        word = _STARS.sub("*", word.strip("*"))
    if not word.isalpha() and _LATIN.search(word) and 3 * sum(map(str.isdigit, word)) <= 2 * len(word):
        word = word.translate(_LEET)
    return _REPEAT.sub(r"\1", word)


def _facts(raw: str) -> tuple:
    """Hash (0: no word), whether masked by stars, whether a single letter, and the plain word."""
    word = plain_word(raw)
    return (hash_of(word), "*" in word, len(word) == 1 and word.isalpha(), word) if word else (0, False, False, "")


@dataclass
class Read:
    """The words of many bodies in order: hash, plain form, and the numbers of sentence and body; sentences don't span bodies."""

    word: np.ndarray
    plain: np.ndarray
    star: np.ndarray
    sentence: np.ndarray
    body: np.ndarray

    def segments(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 word of every segment: sentences, long ones as overlapping windows."""
        edge = np.flatnonzero(np.diff(self.sentence, prepend=-1))
        size = np.diff(edge, append=len(self.sentence))
        long = size > WINDOW + 2
        run, place = expand(np.zeros(len(edge), np.int64), np.where(long, -(-(size - (WINDOW - STRIDE)) // STRIDE), 1))
        first = edge[run] + STRIDE * place
        last = (edge + size)[run]
        return first, np.where(long[run], np.minimum(first + WINDOW, last), last)

    def text(self, first: int, last: int) -> str:
        return " ".join(self.plain[first:last])


class Reader:
    """Reads bodies; keeps the words it met, up to a bound."""

    def __init__(self) -> None:
        self.words = WordTable(_facts, (np.uint64, bool, bool, object))

    def read(self, bodies: list[str | None]) -> Read:
        texts = []
        for b in bodies:
            low = b.lower() if b else ""
            if len(low) < 64 and low.strip() in MARKERS:
                low = ""
            if "&" in low:
                low = _ENTITY.sub(" ", low)
            if "http" in low or "](" in low:
                low = _LINK.sub(" ", low)
            texts.append(low)
        text = SEPARATOR.join(texts)
        if text.count("\x1e") >= max(1, len(texts)):
            text = SEPARATOR.join(t.replace("\x1e", " ") for t in texts)
        code = points(text)
        kind = classes(_class(), code)
        stop = (kind & _BREAK) > 0
        dash = np.flatnonzero(kind & _DASH)
        dash = dash[(dash > 0) & (dash < len(kind) - 1)]
        stop[dash[((kind[dash - 1] & kind[dash + 1]) & _BLANK) > 0]] = True
        first, last = runs((kind & _TOKEN) > 0)
        row = self.words.rows(text, first, last, run_hashes(code, first, last))
        word, star, single, plain = (c[row] for c in self.words.columns)
        sentence = np.cumsum(stop, dtype=np.int32)[first]
        body = np.cumsum((kind & _APART) > 0, dtype=np.int32)[first]
        keep = word != 0
        for at in self._spelt(single & keep, keep, sentence, code, first):
            whole = plain_word("".join(plain[at]))
            word[at[0]], plain[at[0]], star[at[0]] = hash_of(whole), whole, False
            keep[at[1:]] = False
        return Read(word[keep], plain[keep], star[keep], sentence[keep], body[keep])

    @staticmethod
    def _spelt(single: np.ndarray, keep: np.ndarray, sentence: np.ndarray, code: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """Words spelt out: runs of four and more single letters with the same sign between them."""
        held = np.flatnonzero(keep)
        own = single[held]
        if own.sum() < 4:
            return []
        group = np.cumsum((np.diff(sentence[held], prepend=-1) != 0) | ~own)
        at = held[own]
        _, start, size = np.unique(group[own], return_index=True, return_counts=True)
        # a word that isn't single starts a group too; the singles after it are counted alone
        out = []
        for run in (at[a : a + n] for a, n in zip(start, size) if n > 3):
            sign, i = code[first[run[1:]] - 1], 0
            while i < len(sign):
                j = i
                while j < len(sign) and sign[j] == sign[i]:
                    j += 1
                if j - i > 2:
                    out.append(run[i : j + 1])
                i = j + (j - i > 2)
        return out


def segments(body: str | None) -> list[tuple[str, ...]]:
    """The segments of a body as plain words; none for markers."""
    read = Reader().read([body])
    return [tuple(read.plain[a:z]) for a, z in zip(*read.segments())]


_MASK = np.uint64(hash_of("<masked>"))
_TERM_BITS = np.uint64(24)


def terms_of(read: Read, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, term, count), ordered and distinct, for runs of words: words, pairs of neighbouring words, and a mark for masked ones."""
    run, at = expand(first, last)
    own = mixed(read.word)
    pair = mixed(read.word[:-1] * np.uint64(0xD6E8FEB86659FD93) + (read.word[1:] ^ (read.word[1:] >> np.uint64(17))))
    paired = at + 1 < last[run]
    starred = np.unique(run[read.star[at]])
    key = np.concatenate(
        (
            (run.astype(np.uint64) << np.uint64(40)) | (own[at] >> _TERM_BITS),
            (run[paired].astype(np.uint64) << np.uint64(40)) | (pair[at[paired]] >> _TERM_BITS),
            (starred.astype(np.uint64) << np.uint64(40)) | (_MASK >> _TERM_BITS),
        )
    )
    key.sort()
    fresh = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    count = np.diff(fresh, append=len(key))
    key = key[fresh]
    return (key >> np.uint64(40)).astype(np.int64), (key & np.uint64((1 << 40) - 1)).astype(np.int64), count


def counter_of(term: np.ndarray) -> np.ndarray:
    return term & (TERM_SPACE - 1)


def idf_of(frequency: np.ndarray, comments: int) -> np.ndarray:
    return np.log((1.0 + comments) / (1.0 + frequency)).astype(np.float32) + np.float32(0.1)


def weighted(seg: np.ndarray, term: np.ndarray, count: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """TF-IDF weights of unit length per segment."""
    w = (1.0 + np.log(count)) * idf[counter_of(term)]
    norm = np.sqrt(np.bincount(seg, w * w, minlength=n))
    return w / norm[seg]

def _by_value(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The order by group and, nearly (to 2^-22), by value from 0 to 2; one sort of packed numbers where they fit."""
    if len(group) >= 1 << 20:
        return np.lexsort((value, group))
    key = (group << 44) | ((value * (1 << 22)).astype(np.int64) << 20) | np.arange(len(group))
    key.sort()
    return key & ((1 << 20) - 1)


def _kth_best(group: np.ndarray, value: np.ndarray, k: int, n: int) -> np.ndarray:
    """The k-th largest value (from 0 to 2) of each of n groups, rounded down by 2^-30 at most; -1 where there are fewer."""
    key = (group << 32) | ((2 << 30) - (value * (1 << 30)).astype(np.int64))
    key.sort()
    first = np.searchsorted(key, np.arange(n + 1) << 32)
    out = np.full(n, -1.0)
    held = np.flatnonzero(np.diff(first) >= k)
    out[held] = ((2 << 30) - (key[first[held] + k - 1] & ((1 << 32) - 1))) / (1 << 30)
    return out


class BlockMaxIndex:
    """Inverted index over unit vectors: the postings of a term are cut at blocks of documents, with the largest weight in each.

    Documents that share their most telling term are numbered together, so that the blocks of a list are few and the sum
    of the block maxima over the terms of a query is a sharp bound on the cosines in a block. Terms are small numbers;
    documents come in order.
    """

    def __init__(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, docs: int):
        self.docs, self.terms = docs, int(term.max()) + 1 if len(term) else 0
        self.blocks = -(-docs // BLOCK)
        order = self._numbering(doc, term, weight, docs, self.terms)
        self.outside = order.astype(np.int32)  # own number -> number given
        own = np.empty(docs, np.int64)
        own[order] = np.arange(docs)
        if not len(term):
            return
        place = np.arange(len(doc)) - np.searchsorted(doc, doc)
        self.doc_terms = np.full((docs, int(place.max()) + 1), self.terms, np.int32)  # padded with a term that no query has
        self.doc_weights = np.zeros(self.doc_terms.shape)
        self.doc_terms[doc, place], self.doc_weights[doc, place] = term, weight
        given, given_weight = term, weight
        by = np.lexsort((own[doc], term))
        self.post_doc, self.post_weight, term = own[doc[by]].astype(np.int32), weight[by], term[by]
        self.term_first = np.searchsorted(term, np.arange(self.terms + 1))
        self.heavy = doc[np.lexsort((doc, -given_weight, given))].astype(np.int32)  # of each term, documents by falling weight
        key = term * self.blocks + self.post_doc // BLOCK
        self.entry_first = np.flatnonzero(np.diff(key, prepend=-1))
        self.entry_last = np.append(self.entry_first[1:], len(key))
        self.entry_block = (key[self.entry_first] % self.blocks).astype(np.int32)
        self.entry_max = np.maximum.reduceat(self.post_weight, self.entry_first)
        self.term_max = np.zeros(self.terms)
        np.maximum.at(self.term_max, term[self.entry_first], self.entry_max)
        self.local = np.zeros(self.terms + 1, np.int32)
        self.entry_of_term = np.searchsorted(term[self.entry_first], np.arange(self.terms + 1))

    @staticmethod
    def _numbering(doc: np.ndarray, term: np.ndarray, weight: np.ndarray, docs: int, terms: int) -> np.ndarray:
        shared = np.bincount(term, minlength=terms)[term] if len(term) else term
        telling = weight * weight * np.log1p(shared) * (shared > 1)
        order = np.lexsort((term, -telling, doc))
        first = np.searchsorted(doc[order], np.arange(docs))
        anchor, second = np.full(docs, -1, np.int64), np.full(docs, -1, np.int64)
        size = np.bincount(doc, minlength=docs) if len(doc) else np.zeros(docs, np.int64)
        held, more = np.flatnonzero(size), np.flatnonzero(size > 1)
        anchor[held] = term[order[first[held]]]
        second[more] = term[order[first[more] + 1]]
        return np.lexsort((np.arange(docs), second, anchor))

    def bounds(self, seg: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """No document is nearer to a query than this."""
        if not self.terms:
            return np.zeros(n)
        use = term < self.terms
        return np.bincount(seg[use], weight[use] * self.term_max[term[use]], minlength=n)

    def _cosines(self, who: np.ndarray, doc: np.ndarray, q: np.ndarray, t: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
        """Cosines of pairs (query, document), by looking the documents' terms up in the queries' weights."""
        used = np.sort(t)
        used = used[np.flatnonzero(np.diff(used, prepend=-1))]
        self.local[used] = np.arange(1, len(used) + 1)
        table = np.zeros((n, len(used) + 1))  # column 0: terms that no query has
        table[q, self.local[t]] = w
        flat, out = table.ravel(), np.empty(len(who))
        for a in range(0, len(who), 4096):  # pieces that stay in the processor's cache
            some = doc[a : a + 4096]
            at = self.local.take(self.doc_terms.take(some, 0, mode="clip"), mode="clip")
            at += (who[a : a + 4096] * table.shape[1]).astype(np.int32)[:, None]
            np.einsum("ij,ij->i", flat.take(at, mode="clip"), self.doc_weights.take(some, 0, mode="clip"), out=out[a : a + 4096])
        self.local[used] = 0
        return out

    def proven(self, seg: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int, terms: int, each: int) -> np.ndarray:
        """A cosine that at least k documents reach, for each query; -1 if not found. Tries `each` documents of `terms` terms."""
        out = np.full(n, -1.0)
        if not self.terms:
            return out
        step = 96
        cuts = np.searchsorted(seg, np.arange(0, n + step, step))
        for i, (a, z) in enumerate(zip(cuts, cuts[1:])):
            use = np.flatnonzero(term[a:z] < self.terms) + a
            if not len(use):
                continue
            q, t, w = seg[use] - i * step, term[use], weight[use]
            size = self.term_first[t + 1] - self.term_first[t]
            top = _by_value(q, 2.0 - w * self.term_max[t] * np.minimum(size, k) / k)
            top = top[np.arange(len(q)) - np.searchsorted(q, np.arange(step))[q] < terms]  # q is in order already
            pair, at = expand(self.term_first[t[top]], np.minimum(self.term_first[t[top] + 1], self.term_first[t[top]] + each))
            code = np.sort(q[top][pair] * self.docs + self.heavy[at])
            code = code[np.flatnonzero(np.diff(code, prepend=-1))]
            who, doc = code // self.docs, code % self.docs
            best = _kth_best(who, self._cosines(who, doc, q, t, w, step), k, step)
            out[i * step : (i + 1) * step] = best[: n - i * step]
        return out

    def nearest(self, seg: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document, cosine) of the k nearest documents of each query, if their cosine reaches the query's bar.

        Ties at the last place go to the lower document number. Exact: the weakest terms of a query, whose bounds add up
        to a part of its bar only, bring up no documents; blocks and documents are passed over only if what they have
        from the other terms, plus all that the weak ones could add, misses the bar.
        """
        none = np.zeros(0, np.int64)
        found = [(none, none, np.zeros(0))]
        use = term < self.terms
        seg, term, weight = seg[use], term[use], weight[use]
        step = max(8, min(256, CELLS_AT_ONCE // max(1, self.blocks)))
        cuts = np.searchsorted(seg, np.arange(0, n + step, step)) if self.terms else ()
        for i, (a, z) in enumerate(zip(cuts, cuts[1:])):
            if z > a:
                q, d, s = self._nearest(seg[a:z] - i * step, term[a:z], weight[a:z], step, k, np.resize(bar[i * step : (i + 1) * step], step))
                o = np.lexsort((d, -s, q))
                q, d, s = q[o], d[o], s[o]
                top = np.arange(len(q)) - np.searchsorted(q, q) < k
                found.append((q[top] + i * step, d[top], s[top]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _nearest(self, q: np.ndarray, t: np.ndarray, w: np.ndarray, n: int, k: int, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        bound = w * self.term_max[t]
        able = np.bincount(q, bound, minlength=n) >= bar - 1e-9
        some = np.flatnonzero(able[q])
        q, t, w, bound = q[some], t[some], w[some], bound[some]
        if not len(q):
            return none, none, np.zeros(0)
        order = _by_value(q, np.minimum(bound, 1.99))
        upto = np.cumsum(bound[order])
        first = np.searchsorted(q, np.arange(n))
        upto -= np.concatenate(([0.0], upto))[first][q[order]]
        weak = np.empty(len(q), bool)
        weak[order] = upto <= WEAK_PART * bar[q[order]]
        rest = np.bincount(q[weak], bound[weak], minlength=n)
        strong = np.flatnonzero(~weak)
        short = bar - rest - 1e-9
        run, entry = expand(self.entry_of_term[t[strong]], self.entry_of_term[t[strong] + 1])
        run = strong[run]
        cell = q[run] * self.blocks + self.entry_block[entry]
        most = np.bincount(cell, w[run] * self.entry_max[entry], minlength=n * self.blocks)
        good = most[cell] >= short[q[run]]
        cell, run, entry = cell[good], run[good], entry[good]
        if not len(cell):
            return none, none, np.zeros(0)
        open_cells = np.flatnonzero(np.bincount(cell, minlength=n * self.blocks))
        slot = np.zeros(n * self.blocks, np.int32)
        slot[open_cells] = np.arange(len(open_cells), dtype=np.int32)
        own = slot[cell]
        inner, at = expand(self.entry_first[entry], self.entry_last[entry])
        sums = np.bincount(own[inner].astype(np.int64) * BLOCK + self.post_doc[at] % BLOCK, w[run[inner]] * self.post_weight[at], minlength=len(open_cells) * BLOCK)
        cells = np.flatnonzero(sums > 0)
        place = open_cells[cells // BLOCK]
        who = place // self.blocks
        near = np.flatnonzero(sums[cells] >= short[who])
        who, cells, place = who[near], cells[near], place[near]
        known = sums[cells]
        # the strong terms alone prove k documents to be at least so near: a higher bar, still exact
        bar = np.maximum(bar, _kth_best(who, known, k, n))
        near = known >= (bar - rest - 1e-9)[who]
        who, doc = who[near], self.outside[place[near] % self.blocks * BLOCK + cells[near] % BLOCK].astype(np.int64)
        cosine = self._cosines(who, doc, q, t, w, n)
        good = cosine >= bar[who] - 1e-12
        return who[good], doc[good], cosine[good]


def weights_of(s: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Weights of votes: by distance and, slowly, by the number of equal examples."""
    return s**VOTE_POWER * np.sqrt(m)


def votes(q: np.ndarray, s: np.ndarray, y: np.ndarray, m: np.ndarray, n: int) -> np.ndarray:
    """Share of the weighted votes for "flagged"."""
    w = weights_of(s, m)
    return np.bincount(q, w * y, minlength=n) / (np.bincount(q, w, minlength=n) + CLEAN_VOTE)


@dataclass
class AbuseModel:
    idf: np.ndarray
    vocabulary: HashTable
    every: BlockMaxIndex
    flagged: BlockMaxIndex  # the examples with any flag
    y: np.ndarray
    m: np.ndarray
    example: list[str]
    flagged_y: np.ndarray
    flagged_m: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    base: float = 0.5  # share of flagged among the labelled, and of either kind the share with a vote of `even` or more
    hits: float = 1.0
    false: float = 0.0

    @property
    def even(self) -> float:
        """The vote that makes a comment as likely flagged as not, with as many flagged as among the labelled."""
        return -self.offset / self.slope

    def weights(self, read: Read, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, number of a term of the examples, weight); the other terms only count for the length."""
        seg, term, count = terms_of(read, first, last)
        w = weighted(seg, term, count, self.idf, len(first))
        number = self.vocabulary.find(mixed(term) | np.uint64(1))
        known = number >= 0
        return seg[known], number[known].astype(np.int64), w[known]

    def neighbours(self, seg: np.ndarray, term: np.ndarray, w: np.ndarray, n: int, k: int = NEIGHBOURS, least: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, example, cosine) of the k nearest of each query with a flagged example among them; nothing for the others.

        Queries whose vote can't reach `least` may be left out too. With at least k examples within a cosine c, only
        flagged ones as near as c vote; if they are f, weighing F in all, k - f clean ones weigh c ** VOTE_POWER or more each.
        """
        none = np.zeros(0, np.int64)
        left = np.flatnonzero(self.flagged.bounds(seg, term, w, n) >= LEAST_COSINE - 1e-9)
        bar = np.full(n, LEAST_COSINE)
        fq, fd, fs = none, none, np.zeros(0)
        for stage, seeds in enumerate((*SEEDS, None)):
            if not len(left):
                return none, none, np.zeros(0)
            number = np.full(n, -1, np.int64)
            number[left] = np.arange(len(left))
            use = number[seg] >= 0
            own = number[seg[use]], term[use], w[use], len(left)
            if seeds is None:
                q, d, s = self.every.nearest(*own, k, bar[left])
                return left[q], d, s
            proven = self.every.proven(*own, k, *seeds)
            bar[left] = np.maximum(bar[left], proven)
            if stage == 0:
                fq, fd, fs = self.flagged.nearest(*own, k, bar[left])
                fq = left[fq]
            near = fs >= bar[fq] - 1e-9
            fq, fd, fs = fq[near], fd[near], fs[near]
            weight = weights_of(fs, self.flagged_m[fd])
            most, number = np.bincount(fq, weight * self.flagged_y[fd], minlength=n), np.bincount(fq, minlength=n)
            clean = np.where(bar > LEAST_COSINE, np.maximum(0, k - number) * bar**VOTE_POWER, 0.0)
            able = most / (most + clean + CLEAN_VOTE) >= least - 1e-9
            left = left[(number > 0)[left] & able[left]]
        raise AssertionError

    def raw(self, read: Read, first: np.ndarray, last: np.ndarray, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Vote and nearest flagged example (-1) of each segment; 0 is as good as any vote under `least`."""
        n = len(first)
        q, d, s = self.neighbours(*self.weights(read, first, last), n, least=least)
        vote = votes(q, s, self.y[d], self.m[d], n)
        near = np.full(n, -1, np.int64)
        hot = np.flatnonzero(self.y[d] > 0)[::-1]
        near[q[hot]] = d[hot]
        return vote, near

    def probability(self, vote: np.ndarray, rate: float | None = None) -> np.ndarray:
        """Of a vote, where a part `rate` of all comments is flagged (None: as among the labelled)."""
        p = 1.0 / (1.0 + np.exp(-(self.slope * vote + self.offset + self.shift(rate))))
        return np.where(vote > 0, p, 0.0)

    def shift(self, rate: float | None) -> float:
        """What another share of flagged comments adds to the logit."""
        return 0.0 if rate is None else float(np.log(rate / (1 - rate)) - np.log(self.base / (1 - self.base)))

    def rate(self, over: float) -> float:
        """The share of flagged ones among comments of which a part `over` has a vote of `even` or more; not beyond `base`."""
        return float(np.clip((over - self.false) / max(self.hits - self.false, 1e-6), 1e-5, self.base))


class Scorer:
    """Scores bodies with a model; remembers segments met, in a table where newer ones displace older ones."""

    def __init__(self, model: AbuseModel, least: float = 0.0):
        self.model, self.least, self.reader = model, least, Reader()
        self.key, self.vote, self.near = np.zeros(REMEMBERED, np.uint64), np.zeros(REMEMBERED), np.zeros(REMEMBERED, np.int32)

    def segments(self, read: Read, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, at, back = np.unique(run_hashes(read.word, first, last), return_index=True, return_inverse=True)
        slot = (keys >> np.uint64(64 - REMEMBERED.bit_length() + 1)).astype(np.int64)
        vote, near = self.vote[slot], self.near[slot].astype(np.int64)
        fresh = np.flatnonzero(self.key[slot] != keys)
        for a in range(0, len(fresh), BATCH_SEGMENTS):
            some = fresh[a : a + BATCH_SEGMENTS]
            vote[some], near[some] = self.model.raw(read, first[at[some]], last[at[some]], self.least)
        self.key[slot], self.vote[slot], self.near[slot] = keys, vote, near
        return vote[back], near[back]

    def bodies(self, bodies: list[str | None]) -> tuple[np.ndarray, list[str | None], list[str | None]]:
        """Vote, worst segment and nearest flagged example of each body; of equally bad segments the first."""
        out = np.zeros(len(bodies))
        text: list[str | None] = [None] * len(bodies)
        example: list[str | None] = [None] * len(bodies)
        read = self.reader.read(bodies)
        first, last = read.segments()
        if len(first):
            vote, near = self.segments(read, first, last)
            body = read.body[first]
            order = np.lexsort((np.arange(len(body)), -vote, body))
            worst = order[np.flatnonzero(np.diff(body[order], prepend=-1))]
            worst = worst[vote[worst] > 0]
            out[body[worst]] = vote[worst]
            for b, i in zip(body[worst].tolist(), worst.tolist()):
                text[b] = read.text(first[i], last[i])
                example[b] = self.model.example[near[i]] if near[i] >= 0 else None
        return out, text, example


def term_frequencies(bodies: DataFrame) -> tuple[np.ndarray, int]:
    """In how many bodies (column body) the terms of each counter occur, over all of them, and how many bodies there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, table, total = Reader(), np.zeros(TERM_SPACE, np.int64), 0
        for batch in batches:
            total += batch.num_rows
            frequencies(reader, batch.column(0).to_pylist(), table)
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(table[used], total))], names=["term", "n"])

    counted = bodies.select("body").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # at most TERM_SPACE + 1 rows
    term, n = counted.column("term").to_numpy(), counted.column("n").to_numpy()
    out = np.zeros(TERM_SPACE, np.int64)
    out[term[term >= 0]] = n[term >= 0]
    return out, int(n[term < 0].sum())


def frequencies(reader: Reader, bodies: list[str | None], table: np.ndarray) -> None:
    """Add the bodies in which each counter's terms occur to the table."""
    read = reader.read(bodies)
    edge = np.flatnonzero(np.diff(read.sentence, prepend=-1))
    if not len(edge):
        return
    sentence, term, _ = terms_of(read, edge, np.append(edge[1:], len(read.word)))
    code = np.sort((read.body[edge][sentence].astype(np.int64) << 20) | counter_of(term))
    code = code[np.flatnonzero(np.diff(code, prepend=-1))]
    table += np.bincount(code & (TERM_SPACE - 1), minlength=TERM_SPACE)


def labelled_bodies(comments: DataFrame, marks: DataFrame, most_flagged: int = MAX_FLAGGED, most_clean: int = MAX_CLEAN) -> list[tuple[str, str, float]]:
    """(id, body, share of raters that flagged it) of a bounded number of labelled comments.

    comments: id, body; marks: id, content_flag; ids bare. Null flags are no ratings.
    """
    rated = marks.where("id is not null and content_flag is not null").groupBy("id").agg(F.avg((F.col("content_flag") != "none").cast("double")).alias("y"))
    mixed_id = F.xxhash64("id")
    few = rated.where("y > 0").orderBy(mixed_id).limit(most_flagged).unionByName(rated.where("y = 0").orderBy(mixed_id).limit(most_clean))
    joined = comments.where("body is not null").join(F.broadcast(few), "id").groupBy("id").agg(F.min("body").alias("body"), F.first("y").alias("y"))
    return sorted((r["id"], r["body"], r["y"]) for r in joined.collect())  # at most most_flagged + most_clean rows


def fit(labelled: list[tuple[str, str, float]], frequency: np.ndarray, comments: int) -> AbuseModel | None:
    """The model, calibrated on votes by leaving each labelled comment out in turn. Copies of a body are one labelled comment."""
    if not labelled:
        return None
    labelled = sorted(labelled)
    reader = Reader()
    read = reader.read([b for _, b, _ in labelled])
    first, last = read.segments()
    body = read.body[first].astype(np.int64)
    # copies of one body count once, so that reposts do not vouch for each other
    start = np.searchsorted(read.body, np.arange(len(labelled) + 1))
    whole = run_hashes(read.word, start[:-1], start[1:])
    _, original, copy = np.unique(whole, return_index=True, return_inverse=True)
    flag = (np.bincount(copy, [y for *_, y in labelled]) / np.bincount(copy)).astype(float)
    kept = np.isin(body, original)
    first, last, body = first[kept], last[kept], copy[body[kept]]
    _, at, seg_of = np.unique(run_hashes(read.word, first, last), return_index=True, return_inverse=True)
    n = len(at)
    once = np.unique(np.stack((body, seg_of), 1), axis=0) if n else np.zeros((0, 2), np.int64)
    body_of, seg_of = once[:, 0], once[:, 1]
    example = [labelled[i][0] for i in original[body[at]]] if n else []

    idf = idf_of(frequency, comments)
    seg, term, count = terms_of(read, first[at], last[at])
    w = weighted(seg, term, count, idf, n)
    known, term = np.unique(term, return_inverse=True)
    vocabulary = HashTable(max(16, len(known)))
    vocabulary.add(mixed(known) | np.uint64(1), np.arange(len(known), dtype=np.int32))
    index = BlockMaxIndex(seg, term, w, n)
    m = np.bincount(seg_of, minlength=n).astype(float)
    y = np.bincount(seg_of, flag[body_of], minlength=n) / np.maximum(m, 1)
    # only segments of flagged bodies can carry a flag
    asked = np.unique(seg_of[flag[body_of] > 0])
    q, d, s = _among(index, seg, term, w, asked, n)
    other = q != d
    for _ in range(3):
        mine = votes(q[other], s[other], y[d[other]], m[d[other]], n)
        # a segment's own label counts as much as it was seen
        belief = 0.5 * mine + 0.5 * y
        best = np.zeros(len(flag))
        np.maximum.at(best, body_of, belief[seg_of])
        share = np.where(flag[body_of] > 0, flag[body_of] * np.clip(belief[seg_of] / np.maximum(best[body_of], 1e-9), 0, 1) ** 3, 0.0)
        y = np.bincount(seg_of, share, minlength=n) / np.maximum(m, 1)
    total, y = y * m, np.where(y >= FLAGGED_FROM, y, 0.0)
    hot = np.flatnonzero(y)
    inside = np.isin(seg, hot)
    flagged = BlockMaxIndex(np.searchsorted(hot, seg[inside]), term[inside], w[inside], len(hot))
    model = AbuseModel(idf, vocabulary, index, flagged, y, m, example, y[hot], m[hot])

    q, d, s = model.neighbours(seg, term, w, n, NEIGHBOURS + 1)
    q, d, s = (x[q != d] for x in (q, d, s))
    place = np.arange(len(q)) - np.searchsorted(q, q)
    alone = votes(*(x[place < NEIGHBOURS] for x in (q, s, y[d], m[d])), n)
    near = place < NEIGHBOURS - 1  # a segment that other bodies have too is its own neighbour, with their flags
    weight = weights_of(s, m[d]) * near
    left = m[seg_of] - 1
    own = np.sqrt(left)
    theirs = (total[seg_of] - share) / np.maximum(left, 1)
    theirs = np.where(theirs >= FLAGGED_FROM, theirs, 0.0)
    shared = (np.bincount(q, weight * y[d], minlength=n)[seg_of] + own * theirs) / (np.bincount(q, weight, minlength=n)[seg_of] + own + CLEAN_VOTE)
    held = np.zeros(len(flag))
    np.maximum.at(held, body_of, np.where(left > 0, shared, alone[seg_of]))
    model.slope, model.offset, sure = calibrate(held, flag)
    model.base = float(np.clip(sure.mean(), 1e-6, 1 - 1e-6))
    over = held >= model.even
    model.hits = float(np.sum(sure * over) / max(1e-9, sure.sum()))
    model.false = float(np.sum((1 - sure) * over) / max(1e-9, (1 - sure).sum()))
    return model


def _among(index: BlockMaxIndex, seg: np.ndarray, term: np.ndarray, w: np.ndarray, asked: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest examples of some of the examples, with themselves."""
    number = np.full(n, -1, np.int64)
    number[asked] = np.arange(len(asked))
    use = number[seg] >= 0
    own = number[seg[use]], term[use], w[use], len(asked), NEIGHBOURS + 1
    q, d, s = index.nearest(*own, np.maximum(LEAST_COSINE, index.proven(*own, *SEEDS[0])))
    return asked[q], d, s


def calibrate(vote: np.ndarray, y: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Slope and offset of a logistic curve from votes to true flags, and the probability that each labelled one is flagged.

    Labels are taken to be wrong at two unknown rates, one for flagged and one for clean comments, which are found along
    with the curve by expectation and maximisation; else the few wrong labels at either end would flatten the curve.
    """
    slope, offset, missed, false = 6.0, -3.0, 0.03, 0.03
    flagged = y
    for _ in range(200):
        p = 1 / (1 + np.exp(-(slope * vote + offset)))
        if_flagged = p * (1 - missed) / np.maximum(p * (1 - missed) + (1 - p) * false, 1e-12)
        if_clean = p * missed / np.maximum(p * missed + (1 - p) * (1 - false), 1e-12)
        flagged = y * if_flagged + (1 - y) * if_clean
        missed = float(np.clip(np.sum(flagged * (1 - y)) / max(1e-9, flagged.sum()), 1e-3, 0.2))
        false = float(np.clip(np.sum((1 - flagged) * y) / max(1e-9, (1 - flagged).sum()), 1e-3, 0.2))
        old = slope, offset
        for _ in range(5):
            p = 1 / (1 + np.exp(-(slope * vote + offset)))
            g = p - flagged
            h = p * (1 - p) + 1e-6
            # a weak pull to (6, -3), as of one comment, for few or well separated labels
            a = np.array([[np.sum(h * vote * vote) + 0.05, np.sum(h * vote)], [np.sum(h * vote), np.sum(h) + 0.05]])
            move = np.linalg.solve(a, [np.sum(g * vote) + 0.05 * (slope - 6), np.sum(g) + 0.05 * (offset + 3)])
            slope, offset = slope - move[0], offset - move[1]
        if abs(slope - old[0]) + abs(offset - old[1]) < 1e-6:
            break
    return float(slope), float(offset), flagged


#: A comment is reported from this probability on.
THRESHOLD = 0.5


def learn(comments: DataFrame, marks: DataFrame) -> AbuseModel | None:
    """Count terms over all comments (id, body) and build the examples from those that marks (id, content_flag) rate."""
    frequency, total = term_frequencies(comments)
    return fit(labelled_bodies(comments, marks), frequency, total)


def voted(comments: DataFrame, model: AbuseModel | None, extra: tuple[str, ...] = (), exact: bool = True) -> DataFrame:
    """(id, vote, segment, example, *extra) for every row of comments (id, body, *extra).

    segment is the worst segment in plain words and example the id of the nearest flagged example to it; both null where
    the vote is 0. Unless `exact`, votes that can't reach the model's `even` may be 0. Without any labelled comment all
    votes are 0.
    """
    shared = comments.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_FLAGGED + MAX_CLEAN examples and TERM_SPACE
    kinds = {f.name: f.dataType for f in comments.schema.fields}
    schema = T.StructType([*T._parse_datatype_string("id string, vote double, segment string, example string").fields, *(T.StructField(c, kinds[c]) for c in extra)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, 0.0 if exact else shared.value.even) if shared.value else None
        for batch in batches:
            bodies = batch.column("body").to_pylist()
            vote, text, example = scorer.bodies(bodies) if scorer else (np.zeros(len(bodies)), [None] * len(bodies), [None] * len(bodies))
            columns = [batch.column("id").cast(pa.string()), pa.array(vote, pa.float64()), pa.array(text, pa.string()), pa.array(example, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c) for c in extra)], names=["id", "vote", "segment", "example", *extra])

    return comments.select("id", "body", *extra).mapInArrow(run, schema)


def scored(comments: DataFrame, model: AbuseModel | None, extra: tuple[str, ...] = (), exact: bool = True) -> DataFrame:
    """The frame of voted() with a score, the probability, in place of the vote; votes are written once, then read twice.

    Unless `exact`, scores under THRESHOLD may be 0.
    """
    if model is None:
        return voted(comments, None, extra).withColumnRenamed("vote", "score")
    rows = cut_lineage(voted(comments, model, extra, exact))
    over = rows.agg(F.avg((F.col("vote") >= model.even).cast("double"))).first()[0] or 0.0
    logit = F.col("vote") * model.slope + F.lit(model.offset + model.shift(model.rate(over)))
    score = F.when(F.col("vote") > 0, 1 / (1 + F.exp(-logit))).otherwise(0.0)
    return rows.select("id", score.alias("score"), "segment", "example", *extra)
