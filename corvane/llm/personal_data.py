"""Personal items in free text: a linear-chain conditional random field over word shapes, decoded in numpy batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.kernels import code_points, mix, powers, tables
from corvane.llm.personal_examples import FAMILY, GIVEN, TYPES, labelled_examples
from corvane.session import table

#: No item, and for each type a token that begins an item and one that goes on with it.
LABELS = ("O", *(f"{b}-{t}" for t in TYPES for b in "BI"))
OFFSETS = (-4, -3, -2, -1, 0, 1, 2, 3)
#: Labelled texts the model is fitted on, passes over them, step size, texts a step, and by what part of itself a weight shrinks.
EXAMPLES, EPOCHS, STEP, BATCH, SHRINK = 24_000, 7, 0.2, 200, 0.008
#: A feature that fewer tokens of the examples have is left out, as invented words leave many.
LEAST = 25
#: Where the fitted weights are kept, under a digest of what they were fitted on.
WEIGHTS = Path(__file__).with_name("personal_model.npz")
#: Islands are decoded together as long as their tokens, padded to the longest, are no more than this.
CELLS = 1 << 20


def token_bounds(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of tokens (runs of letters and digits, or one other visible character) and their hashes."""
    is_word, _ = tables()
    word = is_word[cp] | ((cp >= 0x300) & (cp < 0x370))
    space = (cp <= 32) | (cp == 0xA0) | ((cp >= 0x2000) & (cp <= 0x200B)) | (cp == 0x202F) | (cp == 0x3000)
    begin = ~space
    begin[1:] &= ~(word[1:] & word[:-1])
    start = np.flatnonzero(begin)
    if not len(start):
        return start, start, np.empty(0, np.uint64)
    visible = np.flatnonzero(~space)
    first = np.searchsorted(visible, start)
    lengths = np.diff(np.append(first, len(visible)))
    place = np.arange(len(visible)) - np.repeat(first, lengths)
    value = (cp[visible].astype(np.uint64) + np.uint64(0x51ED27)) * powers(1 << max(6, int(lengths.max() - 1).bit_length()))[place]
    return start, start + lengths, mix(np.add.reduceat(value, first) ^ lengths.astype(np.uint64))


def _digits(w: str) -> int:
    return 0 if w.isalpha() else len(w) if w.isdigit() else sum(c.isdigit() for c in w)


@cache
def _given() -> frozenset[str]:
    return frozenset(x.lower() for x in GIVEN)


@cache
def _family() -> frozenset[str]:
    return frozenset(x.lower() for x in FAMILY)


def _shape(w: str) -> str:
    """Digits, capitals and other letters as d, X and x, runs of one as it and a plus."""
    if w.isalpha():
        if w.islower():
            return "x+" if len(w) > 1 else "x"
        if w[0].isupper() and w[1:].islower():
            return "Xx+" if len(w) > 2 else "Xx"
    return re.sub(r"(.)\1+", r"\1+", "".join("d" if c.isdigit() else "X" if c.isupper() else "x" for c in w))


def word_features(w: str) -> list[str]:
    """Features of one token: itself, shape, ends, digits."""
    low = w.lower()
    if not (w[0].isalnum()):
        return ["p" + w, "punct"]
    out = []
    digits = _digits(w)
    if digits == len(w):
        out += [f"d{min(len(w), 16)}", f"d{min(len(w), 16)}^{w[:2]}", "digits"]
        if len(w) <= 4:
            out.append("w" + w)
    else:
        shape = _shape(w)
        out += ["s" + shape[:12], "w" + low, "e" + low[-3:], "f" + low[-4:], "g" + low[-2:]]
        if digits:
            out += ["mixed", f"m{min(len(w), 20)}", f"n{min(digits, 16)}"]
        if len(w) == 1:
            out.append("one")
        if low in _given():
            out.append("given")
        if low in _family():
            out.append("family")
        if w.isupper() and len(w) > 1:
            out.append("upper")
        elif w[0].isupper():
            out.append("title")
    return out


#: Classes of tokens, of which three in a row are a feature: beyond the text, on another line, marks, digits by number, words by case.
MARKS = ".,@()-+/:;#_[]\"'|"
_DIGITS, _WORDS = 3 + len(MARKS), 13 + len(MARKS)
CLASSES = _WORDS + 13


def word_class(w: str) -> int:
    """The class of one token."""
    if not w[0].isalnum():
        return 3 + MARKS.index(w) if w in MARKS else 3 + MARKS.index("'") if w == "’" else 2
    digits = _digits(w)
    if digits == len(w):
        return _DIGITS + min(digits, 10) - 1
    if digits:
        return _WORDS + (0 if w[0].isalpha() else 1 if len(w) <= 4 and digits == len(w) - 1 else 2)
    case = 1 if w.isupper() else 2 if w[0].isupper() else 0
    if len(w) == 1:
        return _WORDS + 3 + bool(case)
    if w.lower() in _given():
        return _WORDS + 5 + case
    if w.lower() in _family():
        return _WORDS + 8
    return _WORDS + 9 + (3 if not case and len(w) <= 3 else case)


def in_threes(c: np.ndarray, owner: np.ndarray, line: np.ndarray) -> np.ndarray:
    """(3, token) numbers of the classes of a token and two before it, one at either side, and two after it."""
    n = len(c)

    def at(o: int) -> np.ndarray:
        i = np.clip(np.arange(n) + o, 0, max(n - 1, 0))
        out = np.where(owner[i] != owner, 0, np.where(line[i] != line, 1, c[i]))
        if o < 0:
            out[: min(-o, n)] = 0
        elif o:
            out[max(n - o, 0) :] = 0
        return out

    a, b, d, e = at(-2), at(-1), at(1), at(2)
    return np.stack([(a * CLASSES + b) * CLASSES + c, (b * CLASSES + c) * CLASSES + d, (c * CLASSES + d) * CLASSES + e])


class Crf:
    """Weights of a chain over ``LABELS``: per offset and word feature, per gap before a token, per three classes, and per label pair."""

    def __init__(self, index: dict[str, int], words: np.ndarray, gaps: np.ndarray, steps: np.ndarray, threes: np.ndarray, three_weights: np.ndarray):
        self.index, self.words, self.gaps, self.steps, self.threes, self.three_weights = index, words, gaps, steps, threes, three_weights
        self.row_of = np.zeros(3 * CLASSES**3, np.int32)  # threes that were not seen take the zero row
        self.row_of[threes] = np.arange(len(threes)) + 1
        self.of_gaps = (gaps[4:7, None] + gaps[None, :3]).reshape(9, -1).astype(np.float32)  # by the gap after and before
        self.of_three = np.concatenate([np.zeros((1, len(LABELS)), np.float32), three_weights])
        self.known = np.empty(0, np.uint64)
        self.scores = np.empty((0, len(OFFSETS) * len(LABELS)), np.float32)
        self.kinds = np.empty(0, np.int64)

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("index", "words", "gaps", "steps", "threes", "three_weights")}

    def __setstate__(self, s: dict) -> None:
        self.__init__(**s)

    def save(self, path: Path, digest: str) -> None:
        """As a file of half-precision numbers."""
        half = {k: v.astype(np.float16) for k, v in (("words", self.words), ("gaps", self.gaps), ("steps", self.steps), ("three_weights", self.three_weights))}
        np.savez_compressed(path, digest=np.array(digest), index=np.array("\n".join(sorted(self.index, key=self.index.get))), threes=self.threes.astype(np.int32), **half)

    @classmethod
    def load(cls, path: Path, digest: str) -> Crf | None:
        """The weights of a file; None where there is none or it was fitted on something else."""
        try:
            with np.load(path) as f:
                if str(f["digest"]) != digest:
                    return None
                index = {x: i for i, x in enumerate(str(f["index"]).split("\n"))}
                return cls(index, *(f[k].astype(np.float32) for k in ("words", "gaps", "steps")), f["threes"], f["three_weights"].astype(np.float32))
        except (OSError, KeyError):
            return None

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(word, offset * label) sums of feature weights."""
        rows, cols = [], []
        for i, w in enumerate(words):
            ids = [self.index[f] for f in word_features(w) if f in self.index]
            rows += [i] * len(ids)
            cols += ids
        out = np.zeros((len(words), self.words.shape[1]), np.float32)
        if rows:
            r = np.array(rows)
            first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            out[r[first]] = np.add.reduceat(self.words[np.array(cols)], first, axis=0)
        return out

    def emissions(self, text: str, cp: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """(token, label) scores of joined texts; each distinct word is scored once and kept.

        ``owner`` numbers each token's text, in order. As in training, nothing beyond a text's ends counts.
        """
        uniq, at, kind = np.unique(h, return_index=True, return_inverse=True)
        pos = np.searchsorted(self.known, uniq)
        new = np.flatnonzero((pos >= len(self.known)) | (self.known[np.minimum(pos, max(len(self.known) - 1, 0))] != uniq) if len(self.known) else np.ones(len(uniq), bool))
        if len(new):
            new_words = [text[start[i] : end[i]] for i in at[new]]
            s = self.word_scores(new_words)
            if len(self.known) > 200_000:
                self.known, self.scores, self.kinds = self.known[:0], self.scores[:0], self.kinds[:0]
                return self.emissions(text, cp, start, end, h, owner)
            order = np.argsort(np.concatenate([self.known, uniq[new]]), kind="stable")
            self.known = np.concatenate([self.known, uniq[new]])[order]
            self.scores = np.concatenate([self.scores, s])[order]
            self.kinds = np.concatenate([self.kinds, np.array([word_class(w) for w in new_words], np.int64)])[order]
        row = np.searchsorted(self.known, uniq)
        n, k, none = len(h), len(LABELS), len(uniq)
        gap = gap_before(cp, start)
        nxt = np.zeros(n, np.int64)
        if n:
            nxt[:-1] = np.where(owner[1:] == owner[:-1], gap[1:], 0)
        e = self.of_gaps[3 * nxt + gap]
        for i, three in enumerate(in_threes(self.kinds[row][kind], owner, np.cumsum(cp == 10)[start])):
            e += self.of_three[self.row_of[three + i * CLASSES**3]]
        # the batch's own words, a few thousand, stay in the processor's cache; the row after them is zero
        own = np.concatenate([self.scores[row], np.zeros((1, self.scores.shape[1]), np.float32)]).reshape(none + 1, len(OFFSETS), k).transpose(1, 0, 2).copy()
        for j, o in enumerate(OFFSETS):
            lo, hi = max(0, -o), min(n, n - o)
            if lo < hi:
                e[lo:hi] += own[j][np.where(owner[lo + o : hi + o] == owner[lo:hi], kind[lo + o : hi + o], none)]
        return e

    def decode(self, e: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Best labels of each sequence; ``last`` marks the tokens that end one.

        Where "O" leads every other label by more than the steps around it can make up, whatever stands
        beside it, the best path is "O"; only the islands between such tokens need Viterbi's recursion.
        The labels are those of the full recursion.
        """
        t = self.steps
        n = len(e)
        out = np.zeros(n, np.int64)
        gain = np.maximum(0, (t - t[:, :1]).max(axis=0)) + np.maximum(0, (t - t[:1]).max(axis=1))  # at most, by label
        open_ = (e[:, 1:] + gain[1:]).max(axis=1) >= e[:, 0]
        if not open_.any():
            return out
        joined = np.zeros(n, bool)
        joined[1:] = open_[1:] & open_[:-1] & ~last[:-1]
        idx = np.flatnonzero(open_)
        first = np.flatnonzero(~joined[idx])
        lengths = np.diff(np.append(first, len(idx)))
        begins = idx[first]
        before = np.where((begins > 0) & ~last[np.maximum(begins - 1, 0)], 1, 0)  # an "O" token stands before
        ends = begins + lengths - 1
        after = np.where(~last[ends], 1, 0)
        order = np.argsort(-lengths, kind="stable")
        lengths, begins, before, after = lengths[order], begins[order], before[order], after[order]
        s = 0
        while s < len(order):
            width = int(lengths[s])
            stop = s + max(1, min(4096, CELLS // width))
            ln, b0, bf, af = (x[s:stop] for x in (lengths, begins, before, after))
            s = stop
            scores = np.empty((width, len(ln), len(LABELS)), np.float32)
            scores[0] = e[b0] + bf[:, None] * t[0]
            final = scores[0].copy()
            for i in range(1, width):
                alive = int(np.searchsorted(-ln, -i))
                final[:alive] = scores[i, :alive] = (scores[i - 1, :alive, :, None] + t).max(axis=1) + e[b0[:alive] + i]
            y = (final + af[:, None] * t[:, 0]).argmax(axis=1)
            for i in range(width - 1, -1, -1):
                alive = int(np.searchsorted(-ln, -i))
                out[b0[:alive] + i] = y[:alive]
                if i:  # the step that led here
                    y[:alive] = (scores[i - 1, :alive] + t[:, y[:alive]].T).argmax(axis=1)
        return out


def gap_before(cp: np.ndarray, start: np.ndarray) -> np.ndarray:
    """0: glued to the token before; 1: a space between; 2: a line starts."""
    if not len(start):
        return np.zeros(0, np.int64)
    p = cp[np.maximum(start - 1, 0)]
    return np.where((start == 0) | (p == 10), 2, np.where((p <= 32) | (p == 0xA0) | ((p >= 0x2000) & (p <= 0x200B)) | (p == 0x202F), 1, 0))


def fit(examples: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = EPOCHS, step: float = STEP) -> Crf:
    """Maximum-likelihood weights (Adagrad on minibatches, forward-backward over padded sequences)."""
    k = len(LABELS)
    words, types, seqs = {}, [], []
    for text, spans in examples:
        cp, _ = code_points([text])
        cp = cp[:-1]
        start, end, _ = token_bounds(cp)
        ids = []
        for a, b in zip(start, end, strict=True):
            w = text[a:b]
            if w not in words:
                words[w] = len(types)
                types.append(w)
            ids.append(words[w])
        y = np.zeros(len(start), np.int64)
        for a, b, label in spans:
            at = np.flatnonzero((start >= a) & (start < b))
            y[at] = LABELS.index(f"I-{label}")
            y[at[:1]] = LABELS.index(f"B-{label}")
        g = gap_before(cp, start)
        c = np.array([word_class(text[a:b]) for a, b in zip(start, end, strict=True)], np.int64)
        three = in_threes(c, np.zeros(len(c), int), np.cumsum(cp == 10)[start]) + np.arange(3)[:, None] * CLASSES**3
        seqs.append((np.array(ids, np.int64), y, g, np.append(g[1:], 0), three))
    feats = [word_features(w) for w in types]
    seen: dict[str, int] = {}
    for ids, *_ in seqs:
        for i in ids:
            for f in feats[i]:
                seen[f] = seen.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= LEAST))}
    per = [[index[f] for f in fs if f in index] for fs in feats]
    flat = np.array([i for p in per for i in p])
    owner = np.repeat(np.arange(len(per)), [len(p) for p in per])
    m = len(OFFSETS) * k
    threes, times = np.unique(np.concatenate([q[4].ravel() for q in seqs]), return_counts=True)
    threes = threes[times >= 3]
    seqs = [(*q[:4], np.where(np.isin(q[4], threes), np.searchsorted(threes, q[4]), len(threes))) for q in seqs]
    w, gaps, steps, tri = (np.zeros(n, np.float32) for n in ((len(index), m), (8, k), (k, k), (len(threes) + 1, k)))
    sq = [np.full(x.shape, 1e-2, np.float32) for x in (w, gaps, steps, tri)]
    rng = np.random.default_rng(7)
    for epoch in range(epochs):
        order = rng.permutation(len(seqs))
        for s in range(0, len(order), BATCH):
            part = [seqs[i] for i in order[s : s + BATCH]]
            part.sort(key=lambda x: -len(x[0]))
            width, count = len(part[0][0]), len(part)
            used, local = np.unique(np.concatenate([p[0] for p in part]), return_inverse=True)
            ids = np.full((count, width), -1)
            y, g, g2 = np.zeros((count, width), int), np.zeros((count, width), int), np.zeros((count, width), int)
            th = np.full((3, count, width), len(threes))
            at = 0
            for r, p in enumerate(part):
                n = len(p[0])
                ids[r, :n], y[r, :n], g[r, :n], g2[r, :n] = local[at : at + n], p[1], p[2], p[3]
                th[:, r, :n] = p[4]
                at += n
            real = ids >= 0
            mask = np.isin(owner, used)
            rows, cols = np.searchsorted(used, owner[mask]), flat[mask]
            score = np.zeros((len(used) + 1, m), np.float32)
            np.add.at(score, rows, w[cols])
            e = gaps[g] + gaps[4 + g2] + tri[th].sum(axis=0)
            for j, o in enumerate(OFFSETS):
                lo, hi = max(0, -o), min(width, width - o)
                if lo < hi:
                    e[:, lo:hi] += score[ids[:, lo + o : hi + o], j * k : (j + 1) * k]  # -1 takes the zero row at the end
            a, b = np.zeros((width, count, k)), np.zeros((width, count, k))
            a[0] = e[:, 0]
            for i in range(1, width):
                x = a[i - 1][:, :, None] + steps
                top = x.max(axis=1)
                a[i] = np.where(real[:, i, None], np.log(np.exp(x - top[:, None]).sum(axis=1)) + top + e[:, i], a[i - 1])
            for i in range(width - 2, -1, -1):
                x = steps[None] + (b[i + 1] + e[:, i + 1])[:, None, :]
                top = x.max(axis=2)
                b[i] = np.where(real[:, i + 1, None], np.log(np.exp(x - top[:, :, None]).sum(axis=2)) + top, 0)
            z = a[-1].max(axis=1, keepdims=True)
            z = z + np.log(np.exp(a[-1] - z).sum(axis=1, keepdims=True))
            p = np.exp(a + b - z)  # (width, count, k)
            diff = -p.transpose(1, 0, 2) * real[:, :, None]
            diff[np.nonzero(real) + (y[real],)] += 1
            pair = np.zeros((k, k))
            for i in range(1, width):
                r = real[:, i]
                if not r.any():
                    break
                x = np.exp(a[i - 1][r][:, :, None] + steps + (e[r, i] + b[i][r])[:, None, :] - z[r][:, :, None])
                pair -= x.sum(axis=0)
                np.add.at(pair, (y[r, i - 1], y[r, i]), 1)
            gs = np.zeros_like(score)
            for j, o in enumerate(OFFSETS):
                lo, hi = max(0, -o), min(width, width - o)
                if lo < hi:
                    t = ids[:, lo + o : hi + o]
                    np.add.at(gs[:, j * k : (j + 1) * k], t.ravel(), diff[:, lo:hi].reshape(-1, k))
            gw = np.zeros_like(w)
            np.add.at(gw, cols, gs[rows])
            gg = np.zeros_like(gaps)
            np.add.at(gg, g[real], diff[real])
            np.add.at(gg, 4 + g2[real], diff[real])
            gt = np.zeros_like(tri)
            for x in th:
                np.add.at(gt, x[real], diff[real])
            gt[-1] = 0
            for param, grad, acc in ((w, gw - SHRINK * w, sq[0]), (gaps, gg, sq[1]), (steps, pair, sq[2]), (tri, gt - SHRINK * tri, sq[3])):
                acc += grad * grad
                param += step * grad / np.sqrt(acc)
    return Crf(index, w, gaps, steps.astype(np.float32), threes, tri[:-1])


def _holds(kind: str, s: str) -> bool:
    """Whether a decoded item has what any item of its type has."""
    digits = sum(c.isdigit() for c in s)
    if kind == "email":
        return "@" in s or bool(re.search(r"\bat\b", s, re.I))
    if kind == "phone":
        return 7 <= digits <= 17
    if kind == "id_number":
        return digits >= 5
    if kind == "address":
        return digits > 0 and bool(re.search(r"[^\W\d]{3}", s))
    return not digits and bool(re.search(r"[^\W\d_]{2}", s)) and bool(re.search(r"\w\W+\w", s))


def find_items(model: Crf, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, type) of every text, in order, none inside another: as decoded, without outer marks that no item has.

    An item never goes on in the next line; one without what all of its type have is none.
    """
    distinct = list(dict.fromkeys(texts))
    if len(distinct) < len(texts):  # repeated texts are read once
        found = dict(zip(distinct, find_items(model, distinct), strict=True))
        return [list(found[t]) for t in texts]
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    clean = [(t or "") for t in texts]
    joined = "\n".join(clean) + "\n"
    cp, starts = code_points(clean)
    start, end, h = token_bounds(cp)
    if not len(start):
        return out
    owner = np.searchsorted(starts, start, side="right")
    e = model.emissions(joined, cp, start, end, h, owner)
    last = np.ones(len(start), bool)
    last[:-1] = owner[1:] != owner[:-1]
    y = model.decode(e, last)
    line = np.cumsum(cp == 10)[start]
    kind = (y + 1) // 2  # 0 none, then one number a type
    same = np.zeros(len(y), bool)
    same[1:] = (kind[1:] == kind[:-1]) & (y[1:] % 2 == 0) & (line[1:] == line[:-1])
    first = np.flatnonzero((y > 0) & ~same)
    stop = np.flatnonzero((y > 0) & ~np.append(same[1:], False))
    for f, g in zip(first, stop, strict=True):
        i = int(owner[f]) - 1
        base, a, b = int(starts[i]), int(start[f]), int(end[g])
        name = TYPES[kind[f] - 1]
        edge = "+(" if name == "phone" else ""
        while a < b and not (joined[a].isalnum() or joined[a] in edge):
            a += 1
        while b > a and not joined[b - 1].isalnum():
            b -= 1
        if a < b and _holds(name, joined[a:b]):
            out[i].append((a - base, b - base, name))
    return out


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its type in brackets, all else as it was."""
    parts, at = [], 0
    for a, b, kind in spans:
        parts += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*parts, text[at:]])


@cache
def default_model() -> Crf:
    """The model fitted on the labelled examples of this package: its weights as kept, or fitted anew where the code or examples have changed."""
    import inspect

    from corvane.llm import personal_examples

    fitted_on = [inspect.getsource(x) for x in (personal_examples, fit, word_features, word_class, in_threes, token_bounds, gap_before)]
    digest = hashlib.sha256(repr((fitted_on, EXAMPLES, EPOCHS, STEP, BATCH, SHRINK, LEAST, OFFSETS, LABELS, MARKS)).encode()).hexdigest()
    model = Crf.load(WEIGHTS, digest)
    if model is None:
        model = fit(labelled_examples(EXAMPLES))
        model.digest = digest
    return model


ITEMS = "array<struct<part: int, kind: string, found: string, start: int>>"


def mark_items(rows: DataFrame, mask: bool = True) -> DataFrame:
    """``rows(..., texts array<string>)`` with ``items`` (type, text and place of each) and ``clean`` (texts with placeholders; not without ``mask``).

    A null array gives null items and texts, a null text stays null, a text without an item stays
    as it is to the last character. Items inside another item do not count. Every text is read
    whole; an empty table gives an empty result; columns of the input are kept.
    """
    spark = rows.sparkSession
    model = spark.sparkContext.broadcast(default_model())  # a few megabytes, whatever the data
    kinds = [(f.name, f.dataType.simpleString()) for f in rows.schema]
    schema = ", ".join(f"`{n}` {t}" for n, t in kinds) + f", items {ITEMS}" + (", clean array<string>" if mask else "")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in (b.slice(i, 2000) for b in batches for i in range(0, b.num_rows, 2000)):
            lists = b.column("texts").to_pylist()
            flat = [t for x in lists for t in (x or [])]
            spans = iter(find_items(m, flat))
            items, clean = [], []
            for x in lists:
                if x is None:
                    items.append(None)
                    clean.append(None)
                    continue
                found, new = [], []
                for i, t in enumerate(x):
                    s = next(spans)
                    found += [{"part": i, "kind": k, "found": t[a:z], "start": a} for a, z, k in s]
                    if mask:
                        new.append(masked(t, s) if s else t)
                items.append(found)
                clean.append(new)
            kind = pa.list_(pa.struct([("part", pa.int32()), ("kind", pa.string()), ("found", pa.string()), ("start", pa.int32())]))
            more = [pa.array(clean, pa.list_(pa.string()))] if mask else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(items, kind), *more], [*b.schema.names, "items", *(["clean"] if mask else [])])

    return rows.mapInArrow(mark, schema)


def _messages(spark: SparkSession, d: str) -> DataFrame:
    logs = table(spark, d, "production_logs").select(F.lit("production_logs").alias("tbl"), F.col("log_id").alias("rec_id"), F.posexplode("messages").alias("msg_idx", "m"))
    logs = logs.select("tbl", "rec_id", "msg_idx", F.array("m.content").alias("texts"))
    chat = table(spark, d, "chat_examples").select(F.lit("chat_examples").alias("tbl"), F.col("example_id").alias("rec_id"), F.posexplode("messages").alias("msg_idx", "m"))
    return logs.unionByName(chat.select("tbl", "rec_id", "msg_idx", F.transform("m.content", lambda p: p["text"]).alias("texts")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Each different item once per message."""
    got = mark_items(_messages(spark, d), mask=False).select("rec_id", "msg_idx", F.explode("items").alias("i"))
    return got.select("rec_id", "msg_idx", F.col("i.kind").alias("pii_type"), F.col("i.found").alias("found_text")).distinct()


def p7_masked(spark: SparkSession, d: str) -> DataFrame:
    """Every message's texts with typed placeholders."""
    return mark_items(_messages(spark, d)).select("tbl", "rec_id", "msg_idx", F.array_join("clean", "\n").alias("text"), F.coalesce(F.size("items"), F.lit(0)).alias("items"))
