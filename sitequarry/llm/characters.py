"""Character n-gram models: conditional probabilities with interpolated orders, and tables of their log ratios."""

from __future__ import annotations

import numpy as np

#: Characters of an n-gram; bits of the table of log ratios.
ORDER, TABLE_BITS = 5, 21
#: Orders that all models of a comparison share: that a word is new to one of them is no evidence.
BASE = 3
#: Characters that a model spreads its last remaining mass over.
ALPHABET = 400
#: Log ratios are cut here, so that no single character decides.
LEAST_LOG, MOST_LOG = -2.0, 3.0


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character codes of all texts, lower case, digits as 0, one after the other with a line break after each; and their lengths."""
    lowered = [t.lower() if len(t.lower()) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t) for t in texts]
    codes = np.frombuffer("".join(t + "\n" for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes[(codes >= 48) & (codes <= 57)] = 48
    return codes, np.array([len(t) + 1 for t in lowered], np.int64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = h * np.uint64(0x9E3779B97F4A7C15) + c + np.uint64(1)
    return _mixed(h)


def slots(codes: np.ndarray) -> np.ndarray:
    """Table slot of the n-gram that starts at each place but the last ORDER - 1."""
    n = len(codes) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    return (_hash([codes[k : k + n] for k in range(ORDER)]) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class CharacterModel:
    """P(character | the characters before it in its line), orders 1 to ORDER interpolated by Witten and Bell's rule."""

    def __init__(self, lines: list[str], discount: int = 0) -> None:
        """``discount`` is taken off each n-gram's count: what stands in a large collection just once proves nothing."""
        codes, _ = codes_of([""] + lines)
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.codes = np.zeros((0, ORDER), np.uint64)
        for k in range(1, ORDER + 1):
            n = max(0, len(codes) - k + 1)
            columns = [codes[j : j + n] for j in range(k)]
            # a break may open a gram or close it, but lines aren't connected
            whole = np.ones(n, bool)
            for c in columns[1:-1]:
                whole &= c != 10
            if k > 1:
                whole &= (columns[0] != 10) | (columns[-1] != 10)
            columns = [c[whole] for c in columns]
            key, at, count = np.unique(_hash(columns), return_index=True, return_counts=True)
            key, at, count = key[count > discount], at[count > discount], count[count > discount] - discount
            self.grams.append((key, count.astype(np.float64)))
            before = _hash([c[at] for c in columns[:-1]]) if k > 1 else np.zeros(len(at), np.uint64)
            context, place = np.unique(before, return_inverse=True)
            self.contexts.append((context, np.bincount(place, count, len(context)), np.bincount(place, minlength=len(context)).astype(np.float64)))
            if k == ORDER:
                self.codes = np.stack([c[at] for c in columns], 1) if len(at) else self.codes

    def probability(self, codes: np.ndarray, base: np.ndarray, order: int) -> np.ndarray:
        """Of the last character of each row of ``codes`` given the others; ``base`` is what orders below ``order`` say."""
        p = base
        for k in range(order, ORDER + 1):
            seen, total, kinds = self._counts(codes, k)
            p = np.where(total > 0, (seen + kinds * p) / np.maximum(total + kinds, 1.0), p)
        return p

    def _counts(self, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How often the k-gram at the end of each row was seen, and its context, and with how many next characters."""
        last = [codes[:, ORDER - k + j] for j in range(k)]
        before = _hash(last[:-1]) if k > 1 else np.zeros(len(codes), np.uint64)
        context, total, kinds = self.contexts[k - 1]
        return _look(self.grams[k - 1][0], _hash(last), self.grams[k - 1][1]), _look(context, before, total), _look(context, before, kinds)


def pooled(models: list[CharacterModel], codes: np.ndarray) -> np.ndarray:
    """What all models together say by the orders up to BASE."""
    p = np.full(len(codes), 1.0 / ALPHABET)
    for k in range(1, BASE + 1):
        seen, total, kinds = np.sum([m._counts(codes, k) for m in models], axis=0)
        p = np.where(total > 0, (seen + kinds * p) / np.maximum(total + kinds, 1.0), p)
    return p


def _look(keys: np.ndarray, wanted: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each wanted key, 0 for unknown ones; ``keys`` is sorted."""
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


def ratio_table(positive: list[CharacterModel], negative: list[CharacterModel]) -> np.ndarray:
    """By slot, the log ratio of the likeliest positive to the likeliest negative model; 0 for n-grams that none has seen."""
    codes = np.concatenate([m.codes for m in (*positive, *negative)])
    slot = (_hash(list(codes.T)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    slot, first = np.unique(slot, return_index=True)
    codes = codes[first]
    base = pooled([*positive, *negative], codes)
    best = [np.max([m.probability(codes, base, BASE + 1) for m in models], axis=0) for models in (positive, negative)]
    ratio = np.log(best[0] / best[1])
    table = np.zeros(1 << TABLE_BITS, np.float16)
    table[slot] = np.clip(ratio, LEAST_LOG, MOST_LOG)
    return table


def line_means(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Mean log ratio of each line of all texts, in order; 0 for lines without an n-gram of their own."""
    codes, _ = codes_of(["\n" + t for t in texts])
    grams = slots(codes)
    breaks = np.flatnonzero(codes == 10)
    total = np.r_[0.0, np.cumsum(table[grams], dtype=np.float64)]
    # a line's n-grams start at the break before it and end at the break after it
    first, last = np.minimum(breaks[:-1], len(grams)), np.minimum(breaks[1:] - ORDER + 2, len(grams))
    number = np.maximum(last - first, 0)
    mean = np.where(number > 0, (total[np.maximum(last, first)] - total[first]) / np.maximum(number, 1), 0.0)
    # between two texts there is an empty line that belongs to neither
    drop = np.cumsum(np.array([t.count("\n") + 2 for t in texts])) - 1
    keep = np.ones(len(mean), bool)
    keep[drop[drop < len(mean)]] = False
    return mean[keep]
