"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks.

The kernel of two strings sums, over all triples of characters that occur in order in both, the
products of their weights; an occurrence weighs DECAY to the power of the characters it spans, so
gaps and inserted characters weaken a match without breaking it. Spans are bounded. Strings are
windows of LENGTH characters of sentences, spaces included; a triple never spans a sentence's end.

A support vector machine is trained in the space of Nyström landmarks. Its instances are windows of
labelled sentences (multiple-instance learning): a text shows by its highest window, the two highest
peaks beside it, and how many windows it has, from which a calibration makes its probability. A toxic text is first shown by the windows around parts that speak for
toxic texts by their smoothed log-odds, so a part that some clean-labelled texts hold as well, by a
wrong label or a quotation, still counts by how much. Clean texts are shown by random windows and,
round by round, by the windows that score highest. Landmarks are the telling parts, random clean
windows and such hard ones. Landmark features enter the decision linearly, so the trained machine
folds into one weight a triple, which scores every window of a text without visiting the landmarks;
the value is the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penumbra.llm.common import slices, text_or_empty, utf8

DECAY, SPAN = 0.7, 6
#: Places of the second and third character of a triple after its first.
OFFSETS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]
#: Characters of a window, and the places in it at which a triple may begin.
LENGTH = 16
FIRSTS = LENGTH - SPAN + 1
#: Codes: 0 for none and between sentences, letters from 1, space and marks, signs, digits, then the bytes of other characters.
SYMBOLS, BLANK, SIGN, DIGIT, OTHER = 64, 27, 28, 29, 30
#: Characters of a telling part.
PART = 5
#: Places among which only the highest window is a peak, and the fewest windows that a text counts as having.
PEAK, FEWEST = 24, 500
#: Bytes of text that a task scores at once; bytes of a longer text's stretches, and how many around them they see.
SLICE, STRETCH, LAP = 4 << 20, 4 << 20, 256

_CODE = np.array([OTHER + b % (SYMBOLS - OTHER) for b in range(256)], np.uint8)
_CODE[:128] = SIGN
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz"):
    _CODE[[ord(_c), ord(_c.upper())]] = _i + 1
_CODE[[ord(_c) for _c in "0123456789"]] = DIGIT
_CODE[[*range(33), *map(ord, ".,;:!?()[]{}<>\"'")]] = BLANK


def _kept(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code of every byte of a column of texts, which of them stay, and each byte's text, as ``coded`` describes."""
    data, bounds = utf8(texts)
    many = np.diff(bounds)
    owner = np.repeat(np.arange(len(many)), many)
    at = np.arange(len(data)) + owner + 1
    byte = np.full(len(data) + len(many) + 1, 10, np.uint8)  # a line end between texts
    byte[at] = data
    code = _CODE[byte]
    kept = byte < 0xC0
    blank = code == BLANK
    kept[1:] &= ~(blank[1:] & blank[:-1])
    code[1:][np.isin(byte[:-1], (33, 46, 63)) & (byte[1:] <= 32)] = 0
    code[byte == 10] = 0
    kept |= (code == 0) & (byte != 10)
    letter = (code >= 1) & (code <= 26)
    alone = letter.copy()
    alone[1:] &= ~letter[:-1]
    alone[:-1] &= ~letter[1:]
    gap = np.zeros(len(code), bool)
    gap[1:-1] = alone[:-2] & alone[2:] & ~letter[1:-1] & (code[1:-1] > 0)
    several = np.zeros(len(code), bool)
    several[2:] |= gap[:-2]
    several[:-2] |= gap[2:]
    kept &= ~(gap & several)
    return code[at], kept[at], owner


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The character codes of a column of texts, LENGTH zeros before and after each, and the place of each text's codes.

    Case falls away; runs of blanks count once; a blank that follows a sentence's end, or a line end, is 0; three
    or more single letters with single signs or blanks between them stand together; of a character of
    several bytes the first byte is left out.
    """
    code, kept, owner = _kept(texts)
    sizes = np.bincount(owner[kept], minlength=len(texts))
    before = np.cumsum(sizes) - sizes
    starts = LENGTH * np.arange(1, len(sizes) + 1) + before
    out = np.zeros(int(sizes.sum()) + LENGTH * (len(sizes) + 1), np.uint8)
    out[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))] = code[kept]
    return out, np.append(starts, len(out))


def coded_long(text: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    """``coded`` of one text of any length, in stretches that see LAP bytes around them, as its working memory is many times the text."""
    done = []
    for i in range(0, text.size, STRETCH):
        first, last = max(0, i - LAP), min(text.size, i + STRETCH + LAP)
        code, kept, _ = _kept(pa.array([text.slice(first, last - first).to_pybytes()], pa.binary()))
        own = slice(i - first, i - first + STRETCH)
        done.append(code[own][kept[own]])
    codes = np.concatenate([np.zeros(LENGTH, np.uint8), *done, np.zeros(LENGTH, np.uint8)])
    return codes, np.array([LENGTH, len(codes)])


def _triples(rows: np.ndarray, firsts: int) -> Iterator[tuple[np.ndarray, float]]:
    """Triple numbers (0 for none) and weights of rows of codes, a place and offset at a time."""
    rows, width = rows.astype(np.int32), rows.shape[1]
    for i in range(min(firsts, width - 2)):
        for j, k in OFFSETS:
            if i + k < width:
                a, b, c = rows[:, i], rows[:, i + j], rows[:, i + k]
                yield np.where((a > 0) & (b > 0) & (c > 0), a << 12 | b << 6 | c, 0), DECAY ** (k + 1)


def kernel(windows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """The kernel of every window with every landmark (rows of codes), a landmark scaled to length one."""
    column = np.zeros(SYMBOLS**3, np.int32)
    used = np.unique(np.concatenate([t for t, _ in _triples(landmarks, LENGTH)]))
    used = used[used > 0]
    column[used] = np.arange(1, len(used) + 1)
    phi = np.zeros((len(used) + 1, len(landmarks)), np.float32)
    for t, weight in _triples(landmarks, LENGTH):
        np.add.at(phi, (column[t], np.arange(len(landmarks))), weight)
    phi[0] = 0
    phi /= np.maximum(np.linalg.norm(phi, axis=0), 1e-9)
    out = np.zeros((len(windows), len(landmarks)), np.float32)
    for at in range(0, len(windows), 2048):
        part = out[at : at + 2048]
        for t, weight in _triples(windows[at : at + 2048], FIRSTS):
            c = column[t]
            hit = np.flatnonzero(c)
            if len(hit):
                part[hit] += np.float32(weight) * phi[c[hit]]
    return out


@dataclass
class Model:
    """A weight a triple, the bias, and the calibration: the highest window's slope, the shift, and the slopes of the second and
    third peak and of the logarithm of the windows."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    more: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def windows(self, codes: np.ndarray) -> np.ndarray:
        """The decision value of the window that begins at each place but the last ones."""
        value = np.zeros(len(codes) + 1)
        for at in range(0, len(codes), 1 << 18):
            part = codes[at : at + (1 << 18) + SPAN].astype(np.int32)
            n = min(1 << 18, len(codes) - at, max(0, len(part) - 2))
            total = np.zeros(n, np.float32)
            for j, k in OFFSETS:
                m = min(n, len(part) - k)
                if m > 0:
                    total[:m] += np.float32(DECAY ** (k + 1)) * self.weights[part[:m] << 12 | part[j : j + m] << 6 | part[k : k + m]]
            value[at + 1 : at + 1 + n] = total
        value = np.cumsum(value)
        return value[FIRSTS:] - value[:-FIRSTS] + self.bias

    def values(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Decision values of texts: of the highest window."""
        return np.concatenate([np.empty(0), *(np.maximum.reduceat(v, at) for v, at in self._runs(codes, starts))])

    def evidence(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of each text the three highest peaks among its windows (the lowest again where it has fewer) and the number of its windows.

        A peak is the highest window of PEAK places that neither neighbour of PEAK places tops, so one insult isn't counted twice.
        """
        rows, sizes = [], np.diff(starts)
        for d, high in enumerate(self._highs(codes, starts)):
            around = np.concatenate([[-np.inf], high, [-np.inf]])
            peaks = np.sort(high[(high > around[:-2]) & (high >= around[2:])])[::-1][:3]
            rows.append([*peaks, *[peaks[-1]] * (3 - len(peaks)), sizes[d]])
        return np.array(rows, np.float64).reshape(-1, 4)

    def _highs(self, codes: np.ndarray, starts: np.ndarray, size: int = PEAK << 15) -> Iterator[np.ndarray]:
        """Of each text the highest window of every PEAK places; of a long text's windows ``size`` are held at once."""

        def high(v: np.ndarray) -> np.ndarray:
            places = np.full(-(-len(v) // PEAK) * PEAK, -np.inf)
            places[: len(v)] = v
            return places.reshape(-1, PEAK).max(1)

        run = 0
        while run < len(starts) - 1:
            end = max(run + 1, min(int(np.searchsorted(starts, starts[run] + size, "right")) - 1, len(starts) - 1))
            first = starts[run] - LENGTH
            if end == run + 1:
                stop = starts[end] - LENGTH
                part = range(first, stop, size)
                yield np.concatenate([high(self.windows(codes[a : min(a + size, stop) + FIRSTS + SPAN])[: min(size, stop - a)]) for a in part])
            else:
                v = self.windows(codes[first : starts[end]])
                for d in range(run, end):
                    yield high(v[starts[d] - LENGTH - first : starts[d + 1] - LENGTH - first])
            run = end

    def highest(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where the highest window of each text begins."""
        best, run = [], 0
        for v, at in self._runs(codes, starts):
            first = starts[run] - LENGTH
            best += [first + a + int(v[a:b].argmax()) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(v)], strict=True)]
            run += len(at)
        return np.array(best, np.int64)

    def _runs(self, codes: np.ndarray, starts: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Window values of runs of texts of about ``size`` codes, and where each text's windows begin among them."""
        run = 0
        while run < len(starts) - 1:
            end = max(run + 1, min(int(np.searchsorted(starts, starts[run] + size, "right")) - 1, len(starts) - 1))
            first = starts[run] - LENGTH
            yield self.windows(codes[first : starts[end]]), starts[run:end] - LENGTH - first
            run = end

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_traits(evidence) @ np.array([self.slope, *self.more]) + self.shift, -500, 500)))


def _traits(evidence: np.ndarray) -> np.ndarray:
    """What the calibration reads: the peaks, and the logarithm of the windows in thousands."""
    return np.column_stack([evidence[:, :3], np.log(np.maximum(evidence[:, 3], FEWEST) / 1000)])


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float, steps: int = 30) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by Newton steps with a halving line search. Only runs of rows are held in
    double precision."""
    runs = [slice(at, at + 2048) for at in range(0, len(x), 2048)]
    w = np.zeros(x.shape[1] + 1)
    ridge = np.ones(len(w))
    ridge[-1] = 1e-3

    def rows(run: slice) -> np.ndarray:
        return np.hstack([x[run].astype(np.float64), np.ones((len(x[run]), 1))])

    def gaps(v: np.ndarray) -> np.ndarray:
        return 1 - y * np.concatenate([rows(run) @ v for run in runs])

    def loss(v: np.ndarray, gap: np.ndarray) -> float:
        return 0.5 * (ridge * v * v).sum() + c * (weight * np.maximum(0, gap) ** 2).sum()

    gap = gaps(w)
    now = loss(w, gap)
    for _ in range(steps):
        gradient, curve = ridge * w, np.diag(ridge)
        for run in runs:
            on = gap[run] > 0
            r = rows(run)[on]
            part = r * weight[run][on, None]
            gradient = gradient - 2 * c * part.T @ (y[run][on] * gap[run][on])
            curve = curve + 2 * c * part.T @ r
        step = np.linalg.solve(curve, gradient)
        size, gap = 1.0, gaps(w - step)
        while size > 1e-4 and loss(w - size * step, gap) > now - 1e-4 * size * (gradient @ step):
            size /= 2
            gap = gaps(w - size * step)
        w = w - size * step
        before, now = now, loss(w, gap)
        if before - now < 1e-6 * max(1.0, before):
            break
    return w[:-1], float(w[-1])


def _fold(landmarks: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The landmarks' weights as one weight a triple."""
    out = np.zeros(SYMBOLS**3)
    for landmark, weight in zip(landmarks, v, strict=True):
        phi = np.zeros(SYMBOLS**3)
        for t, w in _triples(landmark[None, :], LENGTH):
            phi[t] += w
        phi[0] = 0
        out += weight * phi / max(np.linalg.norm(phi), 1e-9)
    return out.astype(np.float32)


def _parts(codes: np.ndarray) -> np.ndarray:
    """The number of the part that begins at each place; 0 if it holds a sentence's end."""
    n = len(codes) - PART + 1
    out, whole = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(PART):
        out = out << 6 | codes[i : i + n]
        whole &= codes[i : i + n] > 0
    return np.where(whole, out, 0)


def _telling(codes: np.ndarray, starts: np.ndarray, toxic: np.ndarray, count: int, cover: int, pool_size: int) -> np.ndarray:
    """Parts that speak for toxic texts: by two standard errors, their smoothed log-odds are above one. Where none is (few
    labels), those with the most certain odds. Of these greedily the parts that most toxic texts hold that hold fewer than
    ``cover`` chosen ones."""
    def bag(d: int) -> np.ndarray:
        return np.unique(_parts(codes[starts[d] : starts[d + 1]]))

    toxic_bags = {d: bag(d) for d in np.flatnonzero(toxic).tolist()}
    keys, shows = np.unique(np.concatenate(list(toxic_bags.values())), return_counts=True)
    held = [np.zeros(len(keys), np.int64), shows]
    for d in np.flatnonzero(toxic == 0).tolist():
        b = bag(d)
        at = np.minimum(np.searchsorted(keys, b), len(keys) - 1)
        held[0][at[keys[at] == b]] += 1
    many = [int((toxic == c).sum()) for c in (0, 1)]
    odds = np.log((held[1] + 0.5) / (many[1] + 1)) - np.log((held[0] + 0.5) / (many[0] + 1))
    error = np.sqrt(1 / (held[1] + 0.5) + 1 / (held[0] + 0.5))
    odds[keys == 0] = -np.inf
    sure = np.where(odds - 2 * error > 1, odds / error, -np.inf)
    if not np.isfinite(sure).any():
        sure = np.where((odds > 0) & (held[1] > 1), odds / error, -np.inf)
    pool = np.sort(keys[np.argsort(-sure, kind="stable")[: min(pool_size, int(np.isfinite(sure).sum()))]])
    if not len(pool):
        return pool
    rows, columns = [], []
    for d in np.flatnonzero(toxic):
        at = np.minimum(np.searchsorted(pool, toxic_bags[d]), len(pool) - 1)
        mine = at[pool[at] == toxic_bags[d]]
        rows.append(np.full(len(mine), d))
        columns.append(mine)
    rows, columns = np.concatenate(rows), np.concatenate(columns)
    covered, chosen = np.zeros(len(toxic), np.int64), []
    weight = np.maximum(odds[np.searchsorted(keys, pool)], 0)
    while len(chosen) < count:
        gain = np.bincount(columns, covered[rows] < cover, len(pool)) * weight
        best = int(gain.argmax())
        if gain[best] <= 0:
            break
        covered[rows[columns == best]] += 1
        weight[best] = 0
        chosen.append(pool[best])
    return np.sort(np.array(chosen, np.int64))


def _cut(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The windows that begin at the places."""
    return codes[np.clip(at[:, None] + np.arange(LENGTH), 0, len(codes) - 1)].astype(np.int32)


def _with_letter(rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The windows with a letter pushed in near their middle."""
    out = rows.copy()
    for row, at, letter in zip(out, rng.integers(LENGTH // 2 - 2, LENGTH // 2 + 2, len(rows)), rng.integers(1, 27, len(rows)), strict=True):
        row[at + 1 :] = row[at:-1].copy()
        row[at] = letter
    return out


def _coded_in_runs(texts: list[str], run: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """``coded`` of many texts, some at a time, as its working memory is many times the text."""
    done = [coded(pa.array(texts[i : i + run], pa.string())) for i in range(0, len(texts), run)]
    lead = np.cumsum([0, *(len(c) - LENGTH for c, _ in done)])
    codes = np.concatenate([*(c[:-LENGTH] for c, _ in done), np.zeros(LENGTH, np.uint8)])
    return codes, np.append(np.concatenate([a[:-1] + n for (_, a), n in zip(done, lead, strict=False)]), len(codes))


def train(
    texts: list[str],
    toxic: list[int],
    priors: tuple[float, float],
    landmarks: int = 384,
    rounds: int = 3,
    c: float = 3.0,
    cover: int = 3,
    pool: int = 4000,
    shown: int = 3,
) -> Model:
    """Fit on labelled texts. ``priors``: how many labelled rows each class (0, 1) has in all. ``pool``
    bounds the parts among which landmarks are chosen, ``shown`` the windows that show one toxic text or
    random clean one.

    Without both classes the model answers every text with the share of class 1.
    """
    y = np.array(toxic)
    share = (priors[1] + 0.5) / (sum(priors) + 1)
    constant = Model(np.zeros(SYMBOLS**3, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return constant
    codes, starts = _coded_in_runs(texts)
    telling = _telling(codes, starts, y, landmarks // 2, cover, pool)
    rng = np.random.default_rng(1)
    hits = []
    for d in np.flatnonzero(y):
        found = np.flatnonzero(np.isin(_parts(codes[starts[d] : starts[d + 1]]), telling))
        hits.append(starts[d] + rng.permutation(found)[:shown])
    good = _cut(codes, np.concatenate(hits).astype(np.int64) - (LENGTH - PART) // 2)
    if not len(good):
        return constant
    clean = np.flatnonzero((y == 0) & (np.diff(starts) > LENGTH))
    often = np.repeat(clean, shown)
    plain = _cut(codes, starts[often] + (rng.random(len(often)) * (np.diff(starts)[often] - LENGTH)).astype(np.int64)) if len(clean) else np.zeros((1, LENGTH), np.int32)
    positive = np.concatenate([good, _with_letter(good, rng)])
    marks = np.zeros((len(telling), LENGTH), np.int32)
    for i in range(PART):
        marks[:, i] = telling >> 6 * (PART - 1 - i) & 63
    marks = np.concatenate([marks, plain[rng.permutation(len(plain))[: landmarks // 4]]])
    hard = np.empty((0, LENGTH), np.int32)
    model = constant
    for _ in range(rounds):
        marks = np.unique(marks[(marks > 0).sum(1) >= 3], axis=0)
        mm = kernel(marks, marks).astype(np.float64)
        eigen, vectors = np.linalg.eigh((mm + mm.T) / 2)
        keep = eigen > 1e-4 * eigen.max()
        root = vectors[:, keep] / np.sqrt(eigen[keep])
        x = kernel(np.concatenate([positive, plain, hard]), marks) @ root.astype(np.float32)
        labels = np.concatenate([np.ones(len(positive)), -np.ones(len(plain) + len(hard))])
        sizes = [(len(good), 800), (len(good), 200), (len(plain), 500 if len(hard) else 1000), (len(hard), 500)]
        weight = np.concatenate([np.full(n, total / max(n, 1)) for n, total in sizes])
        w, bias = _svm(x, labels, weight, c)
        model = Model(_fold(marks, root @ w), bias, 1.0, 0.0)
        if len(clean):
            worst = _cut(codes, model.highest(codes, starts)[clean])
            hard = np.unique(np.concatenate([hard, worst]), axis=0)
            marks = np.concatenate([marks, worst[np.argsort(-model.values(codes, starts)[clean], kind="stable")[: landmarks // 8]]])
    each = np.where(y == 1, priors[1] / y.sum(), priors[0] / (len(y) - y.sum()))
    slopes, model.shift = calibrate(_traits(model.evidence(codes, starts)), y, each / each.mean())
    model.slope, model.more = slopes[0], tuple(slopes[1:])
    return model


def _platt(traits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic calibration by weighted Newton steps, with a light ridge; ``y`` may lie between 0 and 1. The shift comes last."""
    x = np.column_stack([traits, np.ones(len(traits))])
    w = np.zeros(x.shape[1])
    w[0] = 1.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (weight * (p - y)) + 1e-2 * w)
        w -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    w[0] = max(w[0], 1e-3)
    return w


def calibrate(traits: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 40, most: float = 0.1) -> tuple[list[float], float]:
    """Slopes and shift of the probability that a text is toxic, where labels may be wrong.

    Each class has a share of wrong labels (``most`` at most, and 1 in 100 before any evidence). Shares, calibration
    and the odds that each label is right are fitted in turn (expectation and maximisation).
    """
    w = _platt(traits, y, weight)
    wrong = np.array([0.01, 0.01])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(traits @ w[:-1] + w[-1], -50, 50)))
        toxic = p * np.where(y == 1, 1 - wrong[1], wrong[1])
        clean = (1 - p) * np.where(y == 1, wrong[0], 1 - wrong[0])
        truth = toxic / (toxic + clean)
        for c, belief in ((0, 1 - truth), (1, truth)):
            mass = weight * belief
            wrong[c] = min(most, ((mass * (y != c)).sum() + 0.1) / (mass.sum() + 10))
        w = _platt(traits, truth, weight)
    return w[:-1].tolist(), float(w[-1])


def held_out(id_col: Column) -> Column:
    """Rows that no training reads: crc32 of the id's text leaves 1 by division by 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _shown(text: Column, most: int, stretches: int = 4) -> Column:
    """What of a text the fit reads: the whole, or of one longer than ``most`` characters evenly spaced stretches of that many together."""
    size = most // stretches
    step = (F.length(text) - size) / (stretches - 1)
    parts = [F.substring(text, F.floor(step * i).cast("int") + 1, F.lit(size)) for i in range(stretches)]
    return F.when(F.length(text) <= most, text).otherwise(F.concat_ws("\n", *parts))


def fit(
    docs: DataFrame, labels: DataFrame, per_class: int = 2000, sample_chars: int = 16384, id_col: str = "doc_id", text_col: str = "text"
) -> Model:
    """Train on a bounded sample of labelled rows: of each class the ``per_class`` training rows whose ids hash
    lowest. Of a text of over ``sample_chars`` characters evenly spaced stretches are read, so the driver holds a fixed amount at
    most and no long text shuts others out. Of rows that repeat an id the one with the smallest text is read."""
    known = (
        labels.where("toxic is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .where(~held_out(F.col("doc_id")))
    )
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", _shown(F.col("text"), sample_chars).alias("text"))  # at most 2 * per_class ids
    sample = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    sample.sort(key=lambda r: r["doc_id"])
    return train([r["text"] for r in sample], [r["toxic"] for r in sample], (totals.get(0, 0), totals.get(1, 0)))


def probabilities(model: Model, texts: pa.Array) -> np.ndarray:
    """The probability of each text; one of over STRETCH bytes is read in stretches, to the same result."""
    if len(texts) != 1 or len(utf8(texts)[0]) <= STRETCH:
        return model.probability(model.evidence(*coded(texts)))
    return model.probability(model.evidence(*coded_long(texts.cast(pa.large_binary())[0].as_buffer())))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and ``predicted`` of every whole text.

    The text alone decides. Null and empty texts get the score of a text without characters; null ids and
    repeated rows are answered like any other; other columns are ignored. A task works on 4 MB of text at once, a longer
    text in stretches, so its memory is bounded.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed 262,144 weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, size=SLICE)):
            p = probabilities(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())],
                ["doc_id", "score", "predicted"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def drop(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``score`` does not call toxic. Each row is judged by its own
    text, so ids may be null or repeated."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, at, SLICE)):
            yield batch.filter(pa.array(probabilities(shared.value, batch.column(at).fill_null("")) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
