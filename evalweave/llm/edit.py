"""Edit distances by Myers' bit-parallel columns, on Python integers of any width or for many pairs at once."""

import numpy as np

# Pairs whose columns are computed together: words of masks that they have, the fewest pairs worth it for
# each word of 64 letters, and the most words; classes of letters that they are told apart by.
MASK_WORDS = 1 << 17
FEWEST = 16
MOST_WORDS = 16
CLASSES = 32
# Letters that are looked at beyond one and a half times the budget.
BEGIN = 32
# Letters between two looks at whether a budget can still be kept to, and the size from which masks are made in arrays.
LOOKED = 128
LONG = 192


def letter_masks(pattern: str) -> dict[str, int]:
    """For each letter, the places of ``pattern`` that hold it, as bits."""
    if len(pattern) >= LONG:
        letters = np.frombuffer(pattern.encode("utf-32-le", "surrogatepass"), "<u4")
        packed = ((x, np.packbits(letters == x, bitorder="little")) for x in np.unique(letters))
        return {chr(x): int.from_bytes(places.tobytes(), "little") for x, places in packed}
    masks: dict[str, int] = {}
    bit = 1
    for letter in pattern:
        masks[letter] = masks.get(letter, 0) | bit
        bit <<= 1
    return masks


def _nearest(masks: dict[str, int], size: int, text: str) -> int:
    """Edits from a pattern of ``size`` letters to the nearest substring of ``text``."""
    every, last = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score, best = every, 0, size, size
    for letter in text:
        equal = masks.get(letter, 0)
        vertical = equal | minus
        diagonal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (every & ~(diagonal | plus))
        down = plus & diagonal
        if up & last:
            score += 1
        elif down & last:
            score -= 1
            if score < best:
                best = score
        up = (up << 1) & every
        down = (down << 1) & every
        plus = down | (every & ~(vertical | up))
        minus = up & vertical
    return best


def _steps(bits: int, size: int) -> np.ndarray:
    packed = np.frombuffer(bits.to_bytes(-(-size // 8), "little"), np.uint8)
    return np.unpackbits(packed, bitorder="little")[:size].view(np.int8)


def _whole(masks: dict[str, int], size: int, text: str, budget: int | None) -> int:
    """Edits from a pattern of ``size`` letters to ``text``.

    With a ``budget``, as soon as no way to the end of both can keep to it, some more than that.
    """
    every, held = (1 << size) - 1, masks.get
    plus, minus, left, rest = every, 0, len(text), np.arange(size - 1, -1, -1, dtype=np.int32)
    for begin in range(0, len(text), LOOKED):
        some = text[begin : begin + LOOKED]
        for letter in some:
            equal = held(letter, 0)
            diagonal = (((equal & plus) + plus) ^ plus) | equal
            up = (minus | (every & ~(diagonal | plus))) << 1 | 1
            vertical = equal | minus
            plus, minus = ((plus & diagonal) << 1 | ~(vertical | up)) & every, up & vertical
        left -= len(some)
        if budget is not None and left and size > LOOKED:
            # Edits up to here by letters of the pattern, and at least as many more as the rests differ in size.
            edits = np.cumsum(_steps(plus, size) - _steps(minus, size), dtype=np.int32)
            least = len(text) - left + min(int((edits + np.abs(rest - left)).min()), abs(size - left))
            if least > budget:
                return least
    return len(text) + plus.bit_count() - minus.bit_count()


def within(masks: dict[str, int], size: int, text: str) -> int:
    """The least edits between a pattern, given by its masks, and any substring of ``text``."""
    return _nearest(masks, size, text) if size else 0


def _common(a: str, b: str) -> int:
    """How many letters both begin with alike."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) >> 1
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """Both without the letters they begin and end with alike."""
    start = _common(a, b)
    a, b = a[start:], b[start:]
    end = _common(a[::-1], b[::-1])
    return a[: len(a) - end], b[: len(b) - end]


def distance(a: str, b: str, budget: int | None = None) -> int:
    """Insertions, deletions and replacements that turn ``a`` into ``b``; if over ``budget``, at least that many."""
    a, b = _trimmed(a, b)
    if not a or not b:
        return len(a) + len(b)
    return _whole(letter_masks(a), len(a), b, budget)


# Words skipped at a time to find where two texts go on alike.
_AHEAD = 3


def _enough(a: str, b: str, budget: int) -> bool:
    """Whether editing word by word, skipping or replacing what differs, keeps to the budget."""
    first, second = a.split(" "), b.split(" ")
    i = j = cost = 0
    while i < len(first) and j < len(second):
        if first[i] == second[j]:
            i, j = i + 1, j + 1
            continue
        for step in range(1, _AHEAD + 1):
            if first[i + step : i + step + 1] == [second[j]]:
                cost += step + sum(map(len, first[i : i + step]))
                i += step
                break
            if second[j + step : j + step + 1] == [first[i]]:
                cost += step + sum(map(len, second[j : j + step]))
                j += step
                break
        else:
            cost += max(len(first[i]), len(second[j]))
            i, j = i + 1, j + 1
        if cost > budget:
            return False
    rest = first[i:] + second[j:]
    return cost + len(rest) + sum(map(len, rest)) <= budget


def undecided(a: str, b: str, percent: int) -> bool | tuple[str, str, int]:
    """``alike``, or what is left of both to compare and the edits that they may be apart."""
    longer = max(len(a), len(b))
    budget = longer * (100 - percent) // 100
    if abs(len(a) - len(b)) > budget:
        return False
    a, b = _trimmed(a, b)
    if max(len(a), len(b)) <= budget or _enough(a, b, budget):
        return True
    return a, b, budget


def alike(a: str, b: str, percent: int) -> bool:
    """Whether at least ``percent`` of the longer text is left by the edits between both."""
    left = undecided(a, b, percent)
    return left if isinstance(left, bool) else distance(*left[:2]) <= left[2]


def least_edits(pairs: list[tuple[str, str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Edits that each pair is at least apart, and whether it is no more or they are over its budget.

    Many pairs are looked at together, column by column: the begin of their texts, as far as it takes to
    spend the budget on texts that have little in common, with letters told apart by their class only.
    """
    found, sure = np.zeros(len(pairs), dtype=np.int64), np.ones(len(pairs), dtype=bool)
    sizes = np.array([(len(a), len(b), budget) for a, b, budget in pairs], dtype=np.int64).reshape(-1, 3)
    rows, columns, budgets = sizes.T
    # A way to a row further down than the budget spends it on the way.
    seen = np.minimum(columns, budgets * 3 // 2 + BEGIN)
    deep = np.minimum(rows, seen + budgets)
    words = -(-deep // 64)
    # Of five words and more, such as have at most half as many again are taken together.
    half = 1 << np.maximum(0, np.frexp(np.maximum(words - 1, 0))[1] - 1)
    shared = np.where(words < 5, words, np.where(2 * words <= 3 * half, 3 * half // 2, 2 * half))
    for count in np.unique(shared).tolist():
        some = np.flatnonzero(shared == count)
        if count > MOST_WORDS or len(some) < FEWEST * max(1, count):
            found[some] = [distance(*pairs[i]) for i in some.tolist()]
            continue
        some = some[np.argsort(-seen[some], kind="stable")]
        most = max(1, MASK_WORDS // (CLASSES * max(1, count)))
        for part in (some[begin : begin + most] for begin in range(0, len(some), most)):
            begins = [(pairs[i][0][:m], pairs[i][1][:n]) for i, m, n in zip(part.tolist(), deep[part].tolist(), seen[part].tolist())]
            edits = _columns(begins, (rows - deep)[part], (columns - seen)[part])
            found[part] = np.where(deep[part] < rows[part], np.minimum(edits, budgets[part] + 1), edits)
        sure[some] = found[some] > budgets[some]
    return found, sure


def distances(pairs: list[tuple[str, str, int]]) -> np.ndarray:
    """``distance`` of each pair within its budget."""
    found, sure = least_edits(pairs)
    for i in np.flatnonzero(~sure).tolist():
        found[i] = distance(*pairs[i])
    return found


def _columns(pairs: list[tuple[str, str]], below: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The least edits of a way through the last column of each pair, were letters of a class equal.

    So many letters of the first texts come ``below`` and of the second ones ``after``; these add what
    they differ in size. Second texts come by falling size.
    """
    n = len(pairs)
    rows, columns = (np.array([len(text) for text in texts], dtype=np.int64) for texts in zip(*pairs))
    words = int(-(-rows.max() // 64))
    flat = [np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4") for texts in zip(*pairs)]
    first = np.arange(n, dtype=np.int32) * CLASSES
    kind = [np.repeat(first, size) + (f & (CLASSES - 1)).astype(np.int32) for f, size in zip(flat, (rows, columns))]
    place = [np.arange(len(f)) - np.repeat(np.cumsum(s) - s, s) for f, s in zip(flat, (rows, columns))]
    masks = np.zeros((words, n * CLASSES), dtype=np.uint64)
    bit = np.uint64(1) << (place[0] & 63).astype(np.uint64)
    np.bitwise_or.at(masks, (place[0] >> 6, kind[0]), bit)
    looked = np.zeros((int(columns.max(initial=0)), n), dtype=np.int32)
    looked[place[1], np.repeat(np.arange(n), columns)] = kind[1]
    plus, minus = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), dtype=np.uint64)
    one, last = np.uint64(1), np.uint64(63)
    active = np.searchsorted(-columns, -np.arange(len(looked)), "left")
    for at, many in zip(looked, active.tolist()):
        at = at[:many]
        rises, falls = one, np.uint64(0)
        for word in range(words):
            equal, up, down = masks[word][at], plus[word, :many], minus[word, :many]
            vertical = equal | down
            equal |= falls
            diagonal = (((equal & up) + up) ^ up) | equal
            rise, fall = down | ~(diagonal | up), up & diagonal
            raised, fallen = rise << one | rises, fall << one | falls
            rises, falls = rise >> last, fall >> last
            plus[word, :many] = fallen | ~(vertical | raised)
            minus[word, :many] = raised & vertical
    # Edits to each row of the last column, of those that there are, and from there on.
    up, down = (np.unpackbits(bits.T.copy().view(np.uint8), axis=1, bitorder="little").view(np.int8) for bits in (plus, minus))
    place = np.arange(64 * words + 1)
    edits = np.zeros((n, len(place)), dtype=np.int64)
    np.cumsum(up - down, axis=1, out=edits[:, 1:])
    edits += np.abs((rows + below)[:, None] - place - after[:, None])
    edits[place > rows[:, None]] = np.iinfo(np.int64).max // 2
    return columns + edits.min(axis=1)
