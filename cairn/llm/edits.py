"""Which pairs of texts are within an edit distance, many pairs at once, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textgrams import U64, bytes_of

#: Words of the tables of letters that are held at once; pairs that are compared at once, at least (else one by one) and at most.
_TABLE, LEAST, _MOST = 1 << 22, 24, 2048
_ONES = ~U64(0)
#: Kinds of letters that are counted; letters that are compared at a time where texts begin or end alike.
_KINDS, _STEP = 32, 16


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one after the other, and where each text's begin."""
    data, _ = bytes_of(texts)
    at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    if at[-1] == len(data):
        return data, at
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4"), at


def _ragged(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of all runs (begin, size): its place, and its number within its run."""
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(begin, size) + inner, inner


def _counted(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many letters of each of _KINDS kinds each text has."""
    many = len(at) - 1
    owner = np.repeat(np.arange(many) * _KINDS, np.diff(at))
    return np.bincount(owner + text % _KINDS, minlength=many * _KINDS).reshape(many, _KINDS)


def _alike(data: np.ndarray, p: np.ndarray, q: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many letters are the same from places p and q on (step 1) or backwards (step -1), at most `most`."""
    found, going = np.zeros(len(p), np.int64), np.arange(len(p))
    while len(going):
        inner = found[going, None] + np.arange(_STEP)
        left, right = (np.clip(x[going, None] + step * inner, 0, len(data) - 1) for x in (p, q))
        same = (data[left] == data[right]) & (inner < most[going, None])
        run = np.where(same.all(axis=1), _STEP, same.argmin(axis=1))
        found[going] += run
        going = going[run == _STEP]
    return found


def within(a: pa.Array, b: pa.Array, most: np.ndarray, one_by_one) -> np.ndarray:
    """Whether the Levenshtein distance of each pair of texts is at most its `most`.

    one_by_one: the function (a, b, most) for pairs that are too few, or of too many different letters, to be worth a table.
    """
    (x, x_at), (y, y_at) = letters(a), letters(b)
    m, n = np.diff(x_at), np.diff(y_at)
    most = np.asarray(most, np.int64)
    out = np.maximum(m, n) <= most
    todo = np.flatnonzero(~out & (np.abs(m - n) <= most) & (np.minimum(m, n) > 0))
    # an edit takes one letter away, brings one or both, so letters that one text has more of need as many edits
    apart = _counted(x, x_at) - _counted(y, y_at)
    todo = todo[np.maximum(np.maximum(apart, 0).sum(axis=1), np.maximum(-apart, 0).sum(axis=1))[todo] <= most[todo]]
    data = np.concatenate([x.astype(np.uint32, copy=False), y.astype(np.uint32, copy=False)])
    # what texts begin and end with alike takes no edits
    p, q, shorter = x_at[:-1][todo], y_at[:-1][todo] + len(x), np.minimum(m, n)[todo]
    head = _alike(data, p, q, shorter, 1)
    both = head + _alike(data, p + m[todo] - 1, q + n[todo] - 1, shorter - head, -1)
    starts = p + head, q + head
    m, n = m[todo] - both, n[todo] - both
    longer = np.maximum(m, n)
    out[todo] = longer <= most[todo]
    order = np.flatnonzero(~out[todo])
    order = order[np.argsort(longer[order], kind="stable")]
    todo, longer, m, n, starts = todo[order], longer[order], m[order], n[order], (starts[0][order], starts[1][order])
    seen = np.zeros(int(data.max()) + 1 if len(data) else 1, bool)
    seen[data] = True
    kinds = int(np.count_nonzero(seen))
    code = (np.cumsum(seen) - 1).astype(np.int32)[data]
    low, high, short = np.where(m > n, starts[1], starts[0]), np.where(m > n, starts[0], starts[1]), np.minimum(m, n)
    at = 0
    while at < len(todo):
        end = min(at + _MOST, int(np.searchsorted(longer, 2 * longer[at] + 64, "right")))
        # a pair's table: a row of bits for each letter, as long as the text and the band together
        room = _TABLE // (kinds * (int(longer[end - 1]) // 32 + 4))
        end = min(end, at + max(room, LEAST))
        some = todo[at:end]
        if end - at < LEAST or room < LEAST:
            picked = a.take(pa.array(some)).to_pylist(), b.take(pa.array(some)).to_pylist(), most[some].tolist()
            out[some] = [one_by_one(p, q, k) is not None for p, q, k in zip(*picked)]
        else:
            place, inner = _ragged(low[at:end], short[at:end])
            spot, _ = _ragged(high[at:end], longer[at:end])
            out[some] = _band(code[place], inner, short[at:end], code[spot], longer[at:end], most[some], kinds)
        at = end
    return out


def _band(pattern: np.ndarray, inner: np.ndarray, m: np.ndarray, text: np.ndarray, n: np.ndarray, most: np.ndarray, kinds: int) -> np.ndarray:
    """The same for pairs in order of their longer text's length n; letters are numbers below `kinds`.

    Only cells of the table in a band of diagonals can lie on a path of `most` edits, so a column is as many bits as that band is
    wide (Hyyrö's bit vectors, which move down by one row for each column), in some 64-bit words for each pair. The value on the
    diagonal that ends in the last cell never falls: once it is over `most`, a pair is done.
    """
    pairs, apart = len(m), n - m
    aside = (most - apart) // 2
    mid = int(aside.max())
    words = (int((apart + mid + aside).max()) >> 6) + 1
    top = apart + mid
    width = pairs * kinds
    table = np.zeros(((int(n.max()) + mid >> 6) + words + 2) * width, U64)
    owner = np.repeat(np.arange(pairs), m)
    bit = inner + top[owner]
    # each bit is set once, so the sum is their union
    np.add.at(table, (bit >> 6) * width + owner * kinds + pattern, U64(1) << (bit & 63).astype(U64))
    table = table.reshape(-1, width)
    grid = np.zeros((pairs, int(n.max())), np.intp)
    grid[np.arange(grid.shape[1]) < n[:, None]] = text
    letter = np.ascontiguousarray((grid + (np.arange(pairs) * kinds)[:, None]).T)
    del grid
    shift = np.clip(top - 64 * np.arange(words)[:, None], 0, 64)
    up = np.where(shift == 64, U64(0), _ONES << np.minimum(shift, 63).astype(U64))
    down, score = np.zeros_like(up), np.zeros(pairs, np.int64)
    spot, bit_of = mid >> 6, U64(mid & 63)
    out, who, begun, j = np.zeros(pairs, bool), np.arange(pairs), 0, 0
    got, first = np.empty((words + 1, pairs), U64), 0
    while len(who):
        for j in range(j, int(n[-1])):
            word, bits = j >> 6, j & 63
            for w in range(words + 1 if bits else words):
                np.take(table[word + w], letter[j - first], out=got[w], mode="clip")
            same = got[:words] >> U64(bits)
            if bits:
                same |= got[1:] << U64(64 - bits)
            diagonal = same & up
            diagonal += up
            if words > 1:
                over = diagonal < up
                for w in range(1, words):
                    diagonal[w] += over[w - 1]
                    over[w] |= over[w - 1] & (diagonal[w] == 0)
            diagonal ^= up
            diagonal |= same
            diagonal |= down
            score += 1
            score -= ((diagonal[spot] >> bit_of) & U64(1)).view(np.int64)
            more = diagonal | up
            np.invert(more, out=more)
            more |= down
            less = diagonal & up
            np.right_shift(diagonal, U64(1), out=same)
            if words > 1:
                same[:-1] |= diagonal[1:] << U64(63)
            np.bitwise_and(more, same, out=down)
            np.bitwise_or(more, same, out=up)
            np.invert(up, out=up)
            up |= less
            if j + 1 == n[begun]:
                end = int(np.searchsorted(n, j + 1, "right"))
                out[who[begun:end]] = score[begun:end] <= most[begun:end]
                begun = end
                if begun == len(who):
                    return out
            if j & 15 == 15:
                left = score <= most
                left[:begun] = False
                if 4 * np.count_nonzero(left) <= 3 * len(left):
                    break
        # the pairs that are not done yet
        who, n, most, score, up, down, begun, j = who[left], n[left], most[left], score[left], up[:, left], down[:, left], 0, j + 1
        letter, first = np.ascontiguousarray(letter[j - first :, left]), j
        got = np.empty((words + 1, len(who)), U64)
    return out
