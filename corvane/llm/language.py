"""Document languages by bit-sliced Bloom filters that answer, per n-gram, with a bitmask of languages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.kernels import mix, tables
from corvane.session import table

#: Orders of n-grams and what a hit of each weighs; slots of each order's filter (one byte of language bits a slot).
ORDERS, WEIGHTS, SLOTS = (3, 5), (1.0, 1.0), 1 << 19
#: A sentence votes when the best language leads by this share of its n-grams and it has so many letters.
LEAD, LETTERS = 0.08, 6
#: Sentences of one language that make a segment.
SEGMENT_SENTENCES = 2

# Names and three-letter codes of the languages the samples cover.
NAMES = {
    "english": "en", "eng": "en", "german": "de", "deu": "de", "ger": "de", "deutsch": "de", "french": "fr", "fra": "fr", "fre": "fr", "français": "fr",
    "spanish": "es", "spa": "es", "español": "es", "italian": "it", "ita": "it", "italiano": "it", "portuguese": "pt", "por": "pt", "português": "pt",
    "dutch": "nl", "nld": "nl", "dut": "nl", "nederlands": "nl",
}
NOT_KNOWN = ("", "und", "unknown")

# What is no running text: code fences, inline code, markup, URLs, table and JSON lines, speaker names.
_APART = re.compile(
    r"```[^\0]*?(?:```|(?=\0))|`[^`\n\0]*`|</?[A-Za-z][^<>\n\0]{0,200}>|&[a-z]{2,8};|https?://[^\s\0]+|^[ \t]*[|{}\[][^\n\0]*|^[ \t]*(?:<p>)?(?:[-*>] )?(?:user|assistant|system|tool): ",
    re.M,
)


def clean_label(lang: str | None) -> str | None:
    """Two-letter code of a label however it is written; None when it names no language."""
    s = re.split(r"[-_]", (lang or "").strip().lower())[0]
    return None if s in NOT_KNOWN else NAMES.get(s, s)


def _letters(texts: list[str | None], apart: re.Pattern | None = _APART, spans: bool = False) -> tuple[np.ndarray, ...]:
    """Lower-cased letters with single spaces between words, their sentence, and each sentence's text; also letters a sentence.

    With ``spans`` also where each sentence's first letter and the end of its last one lie in its text.
    """
    is_word, low = tables()
    joined = "\n" + "\0\n".join((t or "").replace("\0", " ") for t in texts) + "\0"
    if apart:
        joined = apart.sub((lambda m: " " * len(m.group())) if spans else " ", joined)  # places must stay
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = is_word[cp] & ~((cp >= 48) & (cp <= 57))
    space = (cp == 32) | (cp == 10) | (cp == 9) | (cp == 0)
    stop = (cp == 46) | (cp == 33) | (cp == 63) | (cp == 0x3002)
    cut = (cp == 10) | (cp == 0)
    cut[1:] |= space[1:] & stop[:-1]
    sentence = np.cumsum(cut)
    text_of = np.cumsum(cp == 0)
    keep = letter.copy()
    keep[1:] |= letter[:-1] & ~letter[1:]
    c = np.where(letter, low[cp], np.uint32(32))[keep]
    s = sentence[keep]
    n_sentences = int(sentence[-1]) + 1
    owner = np.zeros(n_sentences, np.int64)
    owner[sentence[::-1]] = text_of[::-1]  # a sentence's first character decides
    owner[sentence] = np.minimum(owner[sentence], text_of)
    letters = np.bincount(sentence[letter], minlength=n_sentences)
    if not spans:
        return c, s, owner, letters
    at = np.flatnonzero(letter)
    first, last = np.zeros(n_sentences, np.int64), np.zeros(n_sentences, np.int64)
    of = sentence[at]
    first[of[::-1]] = at[::-1]
    last[of] = at + 1
    begin = np.concatenate([[1], np.flatnonzero(cp == 0)[:-1] + 2])  # each text stands after a line end
    begin = np.append(begin, 0)[np.minimum(owner, len(begin))]
    return c, s, owner, letters, first - begin, last - begin


def _grams(c: np.ndarray, s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that lie in one sentence, and their sentence."""
    if len(c) < n:
        return np.empty(0, np.uint64), np.empty(0, s.dtype)
    m = len(c) - n + 1
    h = np.zeros(m, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x100000001B3) + c[i : i + m]
    one = s[n - 1 :] == s[:m]
    return h[one], s[:m][one]


def _slots(h: np.ndarray, order: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    m = mix(h + np.uint64(order))
    return (m & np.uint64(slots - 1)).astype(np.int64), ((m >> np.uint64(32)) & np.uint64(slots - 1)).astype(np.int64)


@dataclass
class LanguageFilters:
    """One byte a slot, one bit a language; an n-gram's languages are the AND of its two slots."""

    langs: tuple[str, ...]
    bits: dict[int, np.ndarray]
    chance: dict[int, np.ndarray]  # by order, how often each language's bit answers to a strange n-gram

    @classmethod
    def fit(cls, samples: list[tuple[str, str]], slots: int = SLOTS) -> LanguageFilters:
        """From (language, text) rows; also with accents left out, as many texts are written so. Up to eight languages."""
        import unicodedata

        langs = tuple(sorted({x for x, _ in samples}))
        if len(langs) > 8:
            raise ValueError("one byte a slot holds eight languages")
        bits, chance = {}, {}
        for n in ORDERS:
            b = np.zeros(slots, np.uint8)
            for k, lang in enumerate(langs):
                texts = [t for x, t in samples if x == lang]
                texts += ["".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)) for t in texts]
                c, s, _, _ = _letters(texts)
                for at in _slots(_grams(c, s, n)[0], n, slots):
                    b[at] |= np.uint8(1 << k)
            bits[n] = b
            chance[n] = np.array([np.mean((b >> k) & 1) ** 2 for k in range(len(langs))])
        return cls(langs, bits, chance)

    def sentences(self, texts: list[str | None], apart: re.Pattern | None = _APART, spans: bool = False) -> tuple[np.ndarray, ...]:
        """Per sentence: its text's index, its letters, its best language and by how large a share of n-grams it leads; with ``spans`` its place."""
        c, s, owner, letters, *place = _letters(texts, apart, spans)
        n_s, n_l = len(owner), len(self.langs)
        score, total = np.zeros((n_s, n_l)), np.zeros(n_s)
        low, high = (np.array([sum(1 << 16 * (k - 4 * half) for k in range(4 * half, min(n_l, 4 * half + 4)) if m >> k & 1) for m in range(256)], np.uint64) for half in (0, 1))
        for n, weight in zip(ORDERS, WEIGHTS, strict=True):
            h, of = _grams(c, s, n)
            if not len(h):
                continue
            a, b = _slots(h, n, len(self.bits[n]))
            mask = self.bits[n][a] & self.bits[n][b]
            # popcounts of all languages at once: 16-bit counters packed in words, summed over at most 60,000 n-grams
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]) | (np.arange(len(of)) % 60_000 == 0))
            for half, packed in ((0, low), (1, high)):
                sums = np.add.reduceat(packed[mask], first)
                for k in range(4 * half, min(n_l, 4 * half + 4)):
                    np.add.at(score[:, k], of[first], weight * ((sums >> np.uint64(16 * (k - 4 * half))) & np.uint64(0xFFFF)).astype(float))
            count = np.bincount(of, minlength=n_s)
            score -= weight * count[:, None] * self.chance[n]
            total += weight * count
        part = np.partition(score, -2, axis=1) if n_l > 1 else np.concatenate([np.zeros((n_s, 1)), score], axis=1)
        lead = (part[:, -1] - part[:, -2]) / np.maximum(total, 1)
        return owner, letters, score.argmax(axis=1), np.where(total > 0, lead, 0), *place


OUT = "doc_id long, segment int, true_lang string, confidence double, sentences int, letters long, mixed boolean, given string"


def label_languages(documents: DataFrame, samples: list[tuple[str, str]]) -> DataFrame:
    """Language of every document of ``documents(doc_id, text, lang)`` and of every segment of mixed ones.

    Each sentence gets the language whose bit the most n-grams answer (false answers of the filters
    subtracted); markup, code, tables and speaker names are no sentences, and a sentence without a
    clear lead votes for none. Languages with two or more sentences are segments if there are several:
    one row each, in order of size, ``mixed`` true. Otherwise one row with the language that has most of
    the letters. ``confidence`` is the mean lead of the language's sentences over the lead plus one
    tenth, in [0, 1). ``given`` is the label in two letters, null when it names none.

    A text that is null, empty or without a clear sentence has one row with a null language and
    confidence 0. Repeated rows each get their rows; an empty table gives none; other columns are ignored.
    """
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(LanguageFilters.fit(samples))  # one megabyte

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.value
        # a few hundred texts at a time: their n-grams then stay in the processor's cache
        for b in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            n_l, rows = len(f.langs), b.num_rows
            owner, letters, best, lead = f.sentences(b.column(1).to_pylist())
            vote = (lead >= LEAD) & (letters >= LETTERS)
            owner_v, cell = owner[vote], owner[vote] * n_l + best[vote]
            owner_v = owner_v[owner_v < rows]
            size = np.bincount(cell, minlength=rows * n_l)[: rows * n_l].reshape(rows, n_l)
            mass = np.bincount(cell, letters[vote], minlength=rows * n_l)[: rows * n_l].reshape(rows, n_l)
            trust = np.bincount(cell, lead[vote], minlength=rows * n_l)[: rows * n_l].reshape(rows, n_l) / np.maximum(size, 1)
            # texts that hold nothing but tables, lists in brackets or code are read as they are
            bare = np.flatnonzero(np.bincount(owner, letters, minlength=rows)[:rows] == 0)
            if len(bare):
                column = b.column(1)
                o2, l2, b2, x2 = f.sentences([column[int(i)].as_py() for i in bare], None)
                ok = o2 < len(bare)
                o2, l2, b2, x2 = bare[o2[ok]], l2[ok], b2[ok], x2[ok]
                owner, letters, best, lead = (np.concatenate(p) for p in ((owner, o2), (letters, l2), (best, b2), (lead, x2)))
            # texts too short for a vote take their longest sentence's language
            weak = np.flatnonzero((size.sum(axis=1) == 0) & (np.bincount(owner, letters, minlength=rows)[:rows] > 0))
            if len(weak):
                w = np.isin(owner, weak) & (letters > 0) & (lead > 0)
                soft = np.bincount(owner[w] * n_l + best[w], lead[w] * letters[w], minlength=rows * n_l)[: rows * n_l].reshape(rows, n_l)
                some = weak[soft[weak].sum(axis=1) > 0]
                k = soft[some].argmax(axis=1)
                size[some, k], mass[some, k] = 1, soft[some, k] + 1
            several = (size >= SEGMENT_SENTENCES).sum(axis=1) >= 2
            out: list[tuple] = []
            main, ids, given = mass.argmax(axis=1), b.column(0).to_pylist(), [clean_label(x) for x in b.column(2).to_pylist()]
            for i in range(rows):
                if several[i]:
                    for seg, k in enumerate(sorted(np.flatnonzero(size[i] >= SEGMENT_SENTENCES), key=lambda k: (-mass[i, k], k))):
                        t = trust[i, k]
                        out.append((ids[i], seg, f.langs[k], t / (t + 0.1), int(size[i, k]), int(mass[i, k]), True, given[i]))
                elif mass[i, main[i]]:
                    t = trust[i, main[i]]
                    out.append((ids[i], 0, f.langs[main[i]], t / (t + 0.1), int(size[i, main[i]]), int(mass[i, main[i]]), False, given[i]))
                else:
                    out.append((ids[i], 0, None, 0.0, 0, 0, False, given[i]))
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in OUT.split(", ")])

    return documents.select(F.col("doc_id").cast("long"), "text", "lang").mapInArrow(label, OUT)


SEGMENTS = "doc_id long, segment int, lang string, confidence double, begin int, end int"


def language_segments(documents: DataFrame, samples: list[tuple[str, str]]) -> DataFrame:
    """Stretches of one language in every document of ``documents(doc_id, text)``, with their places.

    Sentences are judged as in ``label_languages``. Neighbouring sentences of one language are one
    segment, from its first letter to the end of its last one (``begin`` counts from 0, ``end`` is one
    past it); a sentence without a clear lead joins the segment before it, or the one after it at the
    start. ``confidence`` is the mean lead, by letters, over itself plus one tenth. A text without a
    clear sentence, null texts and empty tables give no row; repeated rows each get their rows; other
    columns are ignored.
    """
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(LanguageFilters.fit(samples))  # one megabyte

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.value
        for b in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            owner, letters, best, lead, first, last = f.sentences(b.column(1).to_pylist(), spans=True)
            at = np.flatnonzero((letters > 0) & (owner < b.num_rows))
            clear = at[(lead[at] >= LEAD) & (letters[at] >= LETTERS)]
            if not len(clear):
                continue
            new = np.ones(len(clear), bool)
            new[1:] = (owner[clear][1:] != owner[clear][:-1]) | (best[clear][1:] != best[clear][:-1])
            heads = np.flatnonzero(new)
            text = owner[clear[heads]]
            # of all sentences with letters: the number of the segment that began last, in the same text
            seg = np.searchsorted(clear[heads], at, side="right") - 1
            seg = np.where((seg < 0) | (text[np.maximum(seg, 0)] != owner[at]), seg + 1, seg)
            ok = (seg < len(heads)) & (text[np.minimum(seg, len(heads) - 1)] == owner[at])
            at, seg = at[ok], seg[ok]
            begin, end = np.full(len(heads), 1 << 40), np.zeros(len(heads), np.int64)
            np.minimum.at(begin, seg, first[at])
            np.maximum.at(end, seg, last[at])
            of = np.cumsum(new) - 1
            mass = np.bincount(of, letters[clear])
            trust = np.bincount(of, lead[clear] * letters[clear]) / mass
            number = np.arange(len(heads)) - np.searchsorted(text, text)
            ids = b.column(0).take(pa.array(text))
            yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array([f.langs[k] for k in best[clear[heads]]]), pa.array(trust / (trust + 0.1)), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], [x.split()[0] for x in SEGMENTS.split(", ")])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, SEGMENTS)


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of one language of every document, with its place and confidence."""
    samples = [(r["lang"], r["text"]) for r in table(spark, d, "lang_samples").collect()]  # fixed size: 280 rows
    return language_segments(table(spark, d, "documents"), samples).withColumn("confidence", F.round("confidence", 6))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    samples = [(r["lang"], r["text"]) for r in table(spark, d, "lang_samples").collect()]  # fixed size: 280 rows
    return label_languages(table(spark, d, "documents"), samples)


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every document and segment."""
    return _labelled(spark, d).withColumn("confidence", F.round("confidence", 6))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose label is missing or wrong, and those in several languages."""
    got = _labelled(spark, d).filter("true_lang IS NOT NULL")
    issue = F.when(F.col("mixed"), "mixed").when(F.col("given").isNull(), "missing").when(F.col("given") != F.col("true_lang"), "wrong")
    return got.select("doc_id", issue.alias("issue"), "true_lang").filter("issue IS NOT NULL")
