"""Token-set similarity of two texts: the share of common characters after common words are set aside.

With A, B the word sets: no words on a side give 0; a common word and nothing left on a side give 100. Otherwise the
score is 100 * (1 - indel / total length) of the sorted rests, each with the common words before it, and, where there
are common words, also of the common words alone against each side; the largest counts.

``token_set_ratio`` is a column of built-in functions: the longest common subsequence is a fold over the characters of one rest, a
row of the table in the bits of a number, or of several for longer rests. ``Names`` does the same for very many pairs
of a task at once, with a bound of the score first, so that only what may be similar is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: characters of a rest that one number of the fold holds, so that sums stay within a long
BITS = 62
#: what Python and the OCR engines take for white space between words
BETWEEN = r"(?U)[\s\x1c-\x1f]+"


def words(c: Column) -> Column:
    """Different words in order; none for null."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), BETWEEN), lambda w: w != "")))


def _characters(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1))))


def _fold(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of texts, of which a is not empty."""
    every = (1 << BITS) - 1
    numbers = F.ceil(F.length(a) / BITS).cast("int")
    alphabet = F.array_join(F.array_distinct(_characters(a)), "")

    def places(letters: Column, c: Column) -> Column:
        """Where c stands in a, as ones among zeros."""
        at = F.instr(letters, c)
        one = F.concat(F.repeat(F.lit("0"), at - 1), F.lit("1"), F.repeat(F.lit("0"), F.length(letters) - at))
        return F.when(at > 0, F.call_function("translate", a, letters, one)).otherwise("")

    def number(bits: Column) -> Column:
        return F.conv(F.reverse(bits), 2, 10).cast("long")

    def step(row: Column, hit: Column) -> Column:
        u = row.bitwiseAND(hit)
        return (row + u).bitwiseOR(row - u).bitwiseAND(F.lit(every))

    def short(letters: Column) -> Column:
        hits = F.transform(_characters(b), lambda c: number(places(letters, c)))
        row = F.aggregate(hits, F.lit(every).cast("long"), lambda r, h: F.when(h.isNull() | (h == 0), r).otherwise(step(r, h)))
        return BITS - F.bit_count(row)

    def long(letters: Column) -> Column:
        start = F.array_repeat(F.lit(every).cast("long"), numbers)

        def next_row(row: Column, c: Column) -> Column:
            def cell(state: Column, k: Column) -> Column:
                r = F.get(row, k)
                h = F.coalesce(number(F.substring(state["bits"], k * BITS + 1, F.lit(BITS))), F.lit(0).cast("long"))
                u = r.bitwiseAND(h)
                total = r + u + state["carry"]
                done = total.bitwiseOR(r - u).bitwiseAND(F.lit(every))
                return F.struct(F.array_append(state["row"], done).alias("row"), F.shiftright(total, BITS).alias("carry"), state["bits"].alias("bits"))

            first = F.struct(F.array().cast("array<bigint>").alias("row"), F.lit(0).cast("long").alias("carry"), places(letters, c).alias("bits"))
            folded = F.aggregate(F.sequence(F.lit(0), numbers - 1), first, cell, lambda s: s["row"])
            return F.when(F.instr(letters, c) > 0, folded).otherwise(row)

        rows = F.aggregate(_characters(b), start, next_row)
        return F.aggregate(rows, F.lit(0), lambda n, r: n + BITS - F.bit_count(r))

    return let(alphabet, lambda letters: F.when(numbers == 1, short(letters)).otherwise(long(letters)))


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence; the shorter text gives the bits."""
    swap = F.length(a) > F.length(b)
    pair = F.struct(F.when(swap, b).otherwise(a).alias("a"), F.when(swap, a).otherwise(b).alias("b"))
    return let(pair, lambda p: F.when(F.length(p["a"]) == 0, 0).otherwise(_fold(p["a"], p["b"])))


def _of_rests(common: Column, rest_a: Column, rest_b: Column) -> Column:
    gap = (F.length(common) > 0).cast("int")

    def scores(n: Column) -> Column:
        indel = n["ra"] + n["rb"] - 2 * n["lcs"]
        score = 100.0 * (1 - indel / (n["a"] + n["b"]))
        alone = [100.0 * (1 - (n["gap"] + n[r]) / (n["shared"] + n[x])) for r, x in (("ra", "a"), ("rb", "b"))]
        return F.when(n["shared"] > 0, F.greatest(score, *alone)).otherwise(score)

    shared, ra, rb = F.length(common), F.length(rest_a), F.length(rest_b)
    numbers = F.struct(shared.alias("shared"), gap.alias("gap"), ra.alias("ra"), rb.alias("rb"), (shared + gap + ra).alias("a"), (shared + gap + rb).alias("b"), common_subsequence(rest_a, rest_b).alias("lcs"))
    return F.when((gap == 1) & ((ra == 0) | (rb == 0)), 100.0).otherwise(let(numbers, scores))


def token_set_ratio(a: Column, b: Column) -> Column:
    """0 to 100; null counts as empty."""

    def compared(w: Column) -> Column:
        parts = F.struct(*(F.array_join(x, " ").alias(n) for n, x in (("common", F.array_intersect(w["a"], w["b"])), ("a", F.array_except(w["a"], w["b"])), ("b", F.array_except(w["b"], w["a"])))))
        rated = let(parts, lambda p: _of_rests(p["common"], p["a"], p["b"]))
        return F.when((F.size(w["a"]) == 0) | (F.size(w["b"]) == 0), 0.0).otherwise(rated)

    return let(F.struct(words(a).alias("a"), words(b).alias("b")), compared)


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table in the bits of one number of any length."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every = row = (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & every
    return len(a) - row.bit_count()


def token_set_ratio_of(a: str, b: str) -> float:
    """The ratio of one pair, for texts too long for Names."""
    words_a, words_b = set(a.split()), set(b.split())
    if not words_a or not words_b:
        return 0.0
    common = words_a & words_b
    rest_a, rest_b = (" ".join(sorted(w - common)) for w in (words_a, words_b))
    if common and (not rest_a or not rest_b):
        return 100.0
    shared = len(" ".join(common))
    gap = shared > 0
    len_a, len_b = shared + gap + len(rest_a), shared + gap + len(rest_b)
    score = 100.0 * (1 - (len(rest_a) + len(rest_b) - 2 * lcs_length(rest_a, rest_b)) / (len_a + len_b))
    return max(score, *(100.0 * (1 - (gap + len(r)) / (shared + n)) for r, n in ((rest_a, len_a), (rest_b, len_b)))) if shared else score


class Names:
    """Texts made ready for the comparison of many pairs: words in order, their places as bits, counts of signs by class."""

    CHARACTERS, WORDS, CLASSES = 64, 8, 16
    #: pairs of a table, columns of a table of texts of one length, and pairs of one kind from which on they are taken together
    TILE, COLUMNS, TOGETHER = 1 << 16, 1 << 10, 1 << 10
    #: words by which texts are listed together, each in at least one of so many texts, and lists
    FREQUENT, LISTS = 8, 4

    def __init__(self, texts: list[str]) -> None:
        self.texts, n = texts, len(texts)
        split = [sorted(set(t.split())) for t in texts]
        joined = [" ".join(w) for w in split]
        self.length = np.array([len(t) for t in joined], np.int64)
        self.many = np.array([len(w) for w in split], np.int64)
        #: texts that fit the bits; others are compared one by one
        self.fits = (self.length <= self.CHARACTERS) & (self.many <= self.WORDS) & ~np.array(["\0" in t for t in texts], bool)
        width = int(self.length[self.fits].max(initial=1))
        points = np.array([t if f else "" for t, f in zip(joined, self.fits, strict=True)], dtype=f"U{max(width, 1)}").view(np.uint32).reshape(n, -1)
        table = np.full(0x110000, -1, np.int32)
        table[points.ravel()] = 0
        table[0] = -1
        letters = np.flatnonzero(table == 0)
        table[letters] = np.arange(len(letters))
        self.code = table[points]
        self.classes = np.zeros((n, self.CLASSES), np.int16)
        self.hits = np.zeros((n, len(letters) + 1), np.uint64)  # the last column is for no letter
        for p in range(points.shape[1]):
            some = np.flatnonzero(self.code[:, p] >= 0)
            self.hits[some, self.code[some, p]] |= np.uint64(1 << p)
            self.classes[some, points[some, p] % self.CLASSES] += 1
        number: dict[str, int] = {}
        slots = max(1, int(self.many[self.fits].max(initial=1)))
        self.word = np.full((n, slots), -1, np.int64)
        self.bits, self.space, self.size = (np.zeros((n, slots), np.uint64) for _ in range(3))
        of = np.flatnonzero(self.fits)
        text = np.repeat(of, self.many[of])
        each = [w for i in of.tolist() for w in split[i]]
        if each:
            size = np.fromiter(map(len, each), np.int64, len(each))
            first = np.repeat(np.cumsum(self.many[of]) - self.many[of], self.many[of])
            before = np.cumsum(size + 1) - size - 1
            at, place = before - before[first], np.arange(len(each)) - first
            is_last = place == self.many[text] - 1
            self.word[text, place] = np.fromiter((number.setdefault(w, len(number)) for w in each), np.int64, len(each))
            self.size[text, place] = size
            whole = np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - (size + ~is_last)).astype(np.uint64)
            self.bits[text, place] = whole << at.astype(np.uint64)
            self.space[text, place] = np.where(is_last, np.uint64(0), np.uint64(1) << np.where(is_last, 0, at + size).astype(np.uint64))

    def _kept(self, i: np.ndarray, common: np.ndarray) -> np.ndarray:
        """The bits of words that are not common, without the space behind the last."""
        kept, space = np.zeros(len(i), np.uint64), np.zeros(len(i), np.uint64)
        for k in range(self.word.shape[1]):
            own = ~common[:, k] & (self.word[i, k] >= 0)
            kept |= np.where(own, self.bits[i, k], np.uint64(0))
            space = np.where(own, self.space[i, k], space)
        return kept & ~space

    def ratios(self, i: np.ndarray, j: np.ndarray, least: float) -> tuple[np.ndarray, int]:
        """The ratio of each pair (i, j), or 0 where a bound shows that it is below least; and how many pairs were compared in full."""
        out = np.zeros(len(i))
        slow = ~(self.fits[i] & self.fits[j])
        for k in np.flatnonzero(slow).tolist():
            out[k] = token_set_ratio_of(self.texts[i[k]], self.texts[j[k]])
        fast = np.flatnonzero(~slow & (self.many[i] > 0) & (self.many[j] > 0))
        a, b = i[fast], j[fast]
        in_a, in_b = (np.zeros((len(a), self.word.shape[1]), bool) for _ in range(2))
        for k in range(int(self.many[a].max(initial=0))):
            for m in range(int(self.many[b].max(initial=0))):
                same = (self.word[a, k] == self.word[b, m]) & (self.word[a, k] >= 0)
                in_a[:, k] |= same
                in_b[:, m] |= same
        n_common = in_a.sum(axis=1)
        shared = (self.size[a].astype(np.int64) * in_a).sum(axis=1) + np.maximum(n_common - 1, 0)
        gap = (n_common > 0).astype(np.int64)
        len_a, len_b = self.length[a], self.length[b]
        rest_a, rest_b = len_a - shared - gap, len_b - shared - gap
        whole = (gap == 1) & ((n_common == self.many[a]) | (n_common == self.many[b]))
        alone = np.where(gap == 1, np.maximum(100.0 * (1 - (gap + rest_a) / (shared + len_a)), 100.0 * (1 - (gap + rest_b) / (shared + len_b))), 0.0)
        apart = np.abs(self.classes[a] - self.classes[b]).sum(axis=1)
        bound = 100.0 * (1 - apart / (len_a + len_b))
        score = np.where(whole, 100.0, alone)
        open_ = np.flatnonzero(~whole & (bound >= least) & (bound > alone))
        x, y = a[open_], b[open_]
        kept_a, kept_b = self._kept(x, in_a[open_]), self._kept(y, in_b[open_])
        lcs = self._lcs(x, y, kept_a, kept_b).astype(np.int64)
        indel = rest_a[open_] + rest_b[open_] - 2 * lcs
        score[open_] = np.maximum(100.0 * (1 - indel / (len_a + len_b)[open_]), alone[open_])
        out[fast] = score
        return out, len(open_) + int(slow.sum())

    def _kept_of(self, i: np.ndarray, common: int) -> np.ndarray:
        """The bits of the rests of texts whose words of these places are common."""
        places = (common >> np.arange(self.word.shape[1]) & 1).astype(bool)
        return self._kept(i, np.broadcast_to(places, (len(i), len(places))))

    def _letters(self, i: np.ndarray, kept: np.ndarray) -> np.ndarray:
        """The kept letters of texts without gaps, then the last number, for none."""
        code = self.code[i]
        is_kept = (kept[:, None] >> np.arange(code.shape[1], dtype=np.uint64) & np.uint64(1)).astype(bool)
        order = np.argsort(~is_kept, axis=1, kind="stable")[:, : int(is_kept.sum(axis=1).max(initial=0))]
        letters = np.where(np.take_along_axis(is_kept, order, axis=1), np.take_along_axis(code, order, axis=1), -1)
        return np.where(letters < 0, self.hits.shape[1] - 1, letters)

    def _alike(self, i: np.ndarray) -> list[np.ndarray]:
        """Texts by their length and which of the frequent words they have, so that pairs of two such lists mostly have the same words in common; few lists."""
        if len(i) ** 2 <= self.TILE:  # one table
            return [i] if len(i) else []
        of, times = np.unique(self.word[i][self.word[i] >= 0], return_counts=True)
        frequent = of[np.argsort(-times, kind="stable")][: min(self.FREQUENT, int((times * self.FREQUENT >= len(i)).sum()))]
        key = self.length[i] << self.FREQUENT
        for k, w in enumerate(frequent.tolist()):
            key |= (self.word[i] == w).any(axis=1).astype(np.int64) << k
        _, place, size = np.unique(key, return_inverse=True, return_counts=True)
        large = np.argsort(-size, kind="stable")[: self.LISTS]
        lists = [i[place == k] for k in large.tolist() if 8 * size[k] >= len(i)]
        others = i[~np.isin(place, [k for k in large.tolist() if 8 * size[k] >= len(i)])]
        return lists + ([others] if len(others) else [])

    def cross(self, i: np.ndarray, j: np.ndarray | None, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool, int]]:
        """(some x, some y, their ratios as a table, halved, pairs compared in full): each of i with each of j, as by ``ratios``.

        Without j each two of i meet once; of a table that is halved only what stands right of the diagonal counts.
        """
        for x, y, code, values, halved, full in self.coded(i, j, least):
            yield x, y, values if code is None else values[code], halved, full

    def coded(self, i: np.ndarray, j: np.ndarray | None, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray, bool, int]]:
        """``cross`` with tables of small numbers, each the place of a ratio in the values behind it; without a table the values are the ratios."""
        fast = self.fits & (self.many > 0)
        rows = [*self._alike(i[fast[i]]), i[~fast[i]]]
        columns = rows if j is None else [*self._alike(j[fast[j]]), j[~fast[j]]]
        even = lambda of: len(of) > 0 and fast[of[0]] and (self.length[of] == self.length[of[0]]).all()
        sides = [_Side(self, some) if even(some) else None for some in rows]
        for c, others in enumerate(columns):
            for begin in range(0, len(others), self.COLUMNS if even(others) else max(1, len(others))):
                end = begin + self.COLUMNS if even(others) else len(others)
                side = _Side(self, others[begin:end]) if even(others) else None
                for r, some in enumerate(rows if j is not None else rows[: c + 1]):
                    if not len(some):
                        continue
                    if sides[r] is None or side is None:
                        yield from self._uneven(some, others, j is None and c == r, fast, least)
                        continue
                    step = max(1, self.TILE // len(side.of))
                    if j is not None or c != r:
                        whole = len(some)
                    else:  # of its own list a column meets the rows before it; those beside it are halved
                        whole = begin
                        for at in range(begin, begin + len(side.of), step):
                            x, y = sides[r].part(at, min(at + step, begin + len(side.of))), side.part(at - begin, len(side.of))
                            code, values, full = self._even(x, y, least)
                            yield x.of, y.of, code, values, True, full
                    for at in range(0, whole, step):
                        x = sides[r].part(at, min(at + step, whole))
                        code, values, full = self._even(x, side, least)
                        yield x.of, side.of, code, values, False, full

    def _uneven(self, some: np.ndarray, others: np.ndarray, halved: bool, fast: np.ndarray, least: float) -> Iterator[tuple]:
        """``coded`` of two lists of which one has texts of different lengths, or such as don't fit the bits."""
        step = max(1, self.TILE // len(others))
        for begin in range(0, len(some), step):
            x, y = some[begin : begin + step], others[begin:] if halved else others
            if fast[x[0]] and fast[y[0]]:
                table, _, full = self._table(x, y, least, halved)
                yield x, y, None, table, halved, full
                continue
            one, two = (z.ravel() for z in np.indices((len(x), len(y))))
            if halved:
                one, two = one[two > one], two[two > one]
            table = np.zeros((len(x), len(y)))
            table[one, two], full = self.ratios(x[one], y[two], least)
            yield x, y, None, table, halved, full

    def _even(self, x: _Side, y: _Side, least: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(codes, values, pairs compared in full) of texts of one length with texts of one length.

        All numbers are below 256: tables hold bytes, and what depends on lengths alone is looked up. With m characters set aside or
        in the common subsequence of the rests the ratio is values[m], that of s characters set aside alone values[66 + s].
        """
        shape = (len(x.of), len(y.of))
        len_x, len_y = int(self.length[x.of[0]]), int(self.length[y.of[0]])
        total, number = len_x + len_y, np.arange(self.CHARACTERS + 2)
        values = np.zeros(256)
        values[:66] = 100.0 * (1 - (total - 2.0 * number) / total)
        gap = (number > 0).astype(np.int64)  # the space behind the common words is set aside with them
        values[66:132] = np.maximum(100.0 * (1 - (gap + len_x - number) / (number - gap + len_x)), 100.0 * (1 - (gap + len_y - number) / (number - gap + len_y))) * gap
        values[255] = 100.0
        better = np.searchsorted(values[:66], values[66:132], side="right").astype(np.uint8)
        need = np.maximum(better, np.searchsorted(values[:66], least, side="left")).astype(np.uint8)

        common_x, common_y, aside = (np.zeros(shape, np.uint8) for _ in range(3))
        bit, some = np.empty(shape, np.uint8), np.empty(shape, np.uint8)
        places = y.places(self.word[x.of])
        for k in range(int(self.many[x.of].max())):
            np.take(y.slots, places[:, k], axis=0, out=bit, mode="clip")
            common_y |= bit
            np.not_equal(bit, 0, out=some.view(bool))
            np.multiply(some, (self.size[x.of, k] + np.uint64(1)).astype(np.uint8)[:, None], out=bit)
            aside += bit
            np.left_shift(some, np.uint8(k), out=some)
            common_x |= some
        every = lambda of: ((np.uint16(1) << self.many[of].astype(np.uint16)) - np.uint16(1)).astype(np.uint8)
        whole = (common_x == every(x.of)[:, None]) | (common_y == every(y.of))
        signs = np.zeros(shape, np.uint8)
        for k in np.flatnonzero(x.classes.any(axis=0) & y.classes.any(axis=0)).tolist():
            np.minimum(x.classes[:, k][:, None], y.by_class[k], out=bit)
            signs += bit
        open_ = (signs >= np.take(need, aside)) & ~whole
        code = aside + np.uint8(66)
        code[whole] = 255
        full = self._rests(x, y, common_x, common_y, aside, open_, np.take(better, aside), code)
        return code, values, full

    def _rests(self, x: _Side, y: _Side, common_x: np.ndarray, common_y: np.ndarray, aside: np.ndarray, open_: np.ndarray, better: np.ndarray, code: np.ndarray) -> int:
        """Writes into code what is set aside and the common subsequence of the rests, where open and better; how many subsequences were worked out."""
        kind = common_x.astype(np.uint16)
        kind <<= np.uint16(8)
        kind |= common_y
        kind[~open_] = 0xFFFF  # none open has all words common
        step = max(1, kind.size >> 10)
        of, times = np.unique(kind.ravel()[::step], return_counts=True)
        left, full = open_.copy(), 0
        for k in of[(times * step >= self.TOGETHER) & (of != 0xFFFF)].tolist():
            here = kind == k
            rest, hits = x.rests(k >> 8), y.hits(k & 0xFF)
            bits = hits.dtype.type
            if 4 * np.count_nonzero(here) >= kind.size:
                row, hit, up = (np.full(kind.shape, np.iinfo(bits).max, bits) for _ in range(3))
                for p in range(rest.shape[1]):
                    np.take(hits, rest[:, p], axis=0, out=hit, mode="clip")
                    hit &= row
                    np.add(row, hit, out=up)
                    row -= hit
                    row |= up
                m = np.bitwise_count(~row)
                m += aside
                np.copyto(code, m, where=here & (m >= better))
                full += kind.size
            else:
                r, c = np.divmod(np.flatnonzero(here), here.shape[1])
                row = np.full(len(r), np.iinfo(bits).max, bits)
                for p in range(rest.shape[1]):
                    hit = row & hits[rest[r, p], c]
                    row = (row + hit) | (row - hit)
                m = np.bitwise_count(~row) + aside[r, c]
                code[r, c] = np.where(m >= better[r, c], m, code[r, c])
                full += len(r)
            left &= ~here
        r, c = np.divmod(np.flatnonzero(left), left.shape[1])
        if len(r):
            places = np.arange(self.word.shape[1], dtype=np.uint8)
            kept_x, kept_y = (self._kept(z[k], (common[r, c][:, None] >> places & 1).astype(bool)) for z, k, common in ((x.of, r, common_x), (y.of, c, common_y)))
            m = self._lcs(x.of[r], y.of[c], kept_x, kept_y) + aside[r, c]
            code[r, c] = np.where(m >= better[r, c], m, code[r, c])
        return full + len(r)

    def _table(self, x: np.ndarray, y: np.ndarray, least: float, halved: bool) -> tuple[np.ndarray, bool, int]:
        """Ratios of each of x with each of y, all of which fit the bits and have words; halved is handed through."""
        shape, each = (len(x), len(y)), np.arange(len(y))
        slots = int(max(self.many[x].max(initial=0), self.many[y].max(initial=0)))
        # a row or column a word; the last is for none
        some, place = np.unique(np.concatenate([self.word[x, :slots].ravel(), self.word[y, :slots].ravel()]), return_inverse=True)
        word_x, word_y = place[: len(x) * slots].reshape(-1, slots), place[len(x) * slots :].reshape(-1, slots)
        in_x, in_y = np.zeros((len(x), len(some)), np.uint8), np.zeros((len(some), len(y)), np.uint8)
        for k in range(slots):
            in_x[np.arange(len(x)), word_x[:, k]] = 1
            in_y[word_y[:, k], each] = 1
        if some[0] < 0:
            in_x[:, 0] = in_y[0] = 0
        common_x, common_y = np.zeros(shape, np.uint8), np.zeros(shape, np.uint8)
        shared = np.zeros(shape, np.int16)
        for k in range(slots):
            same = in_y[word_x[:, k]]
            shared += same * self.size[x, k].astype(np.int16)[:, None]
            common_x |= same << np.uint8(k)
            common_y |= np.take(in_x, word_y[:, k], axis=1) << np.uint8(k)
        n_common = np.bitwise_count(common_x)
        gap = (n_common > 0).astype(np.int16)
        shared += n_common - gap
        len_x, len_y = self.length[x].astype(np.float64)[:, None], self.length[y].astype(np.float64)
        set_aside = (shared + gap).astype(np.float64)
        rest_x, rest_y = len_x - set_aside, len_y - set_aside
        whole = (gap == 1) & ((n_common == self.many[x].astype(np.uint8)[:, None]) | (n_common == self.many[y].astype(np.uint8)))
        alone = np.maximum(100.0 * (1 - (gap + rest_x) / (shared + len_x)), 100.0 * (1 - (gap + rest_y) / (shared + len_y))) * gap
        total = len_x + len_y
        apart = np.zeros(shape, np.uint8)
        for k in np.flatnonzero(self.classes[x].any(axis=0) | self.classes[y].any(axis=0)).tolist():
            apart += np.abs(self.classes[x, k].astype(np.int8)[:, None] - self.classes[y, k].astype(np.int8)).view(np.uint8)
        bound = 100.0 * (1 - apart / total)
        open_ = ~whole & (bound >= least) & (bound > alone)
        score = np.where(whole, 100.0, alone)
        lcs, full = self._subsequences(x, y, common_x, common_y, open_)
        compared = 100.0 * (1 - (rest_x + rest_y - 2.0 * lcs) / total)
        np.copyto(score, np.maximum(compared, alone), where=open_)
        return score, halved, full

    def _subsequences(self, x: np.ndarray, y: np.ndarray, common_x: np.ndarray, common_y: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, int]:
        """The longest common subsequences of the rests where open, and how many were worked out.

        Pairs are taken together by the places of their common words, so that only the letters of the rests are gone through. If a
        quarter of the table is of one kind, the whole table is worked out as such.
        """
        kind = np.where(open_, common_x.astype(np.uint16) << np.uint16(8) | common_y, np.uint16(0xFFFF))  # none open has all words common
        number = np.bincount(kind.ravel(), minlength=1 << 16)
        number[0xFFFF] = 0
        lcs, full = np.zeros(open_.shape, np.uint8), 0
        bits = np.uint32 if int(self.length[y].max(initial=0)) <= 32 else np.uint64
        left = open_
        kinds = np.flatnonzero(number >= self.TOGETHER)
        for of in kinds.tolist():
            rest, kept = self._letters(x, self._kept_of(x, of >> 8)), self._kept_of(y, of & 0xFF)
            hits = np.ascontiguousarray((self.hits[y] & kept[:, None]).T.astype(bits))
            kept = kept.astype(bits)
            here = kind == of
            if 4 * number[of] >= kind.size:
                row, hit, up = (np.full(kind.shape, np.iinfo(bits).max, bits) for _ in range(3))
                for p in range(rest.shape[1]):
                    np.take(hits, rest[:, p], axis=0, out=hit, mode="clip")
                    hit &= row
                    np.add(row, hit, out=up)
                    row -= hit
                    row |= up
                np.copyto(lcs, np.bitwise_count(~row & kept), where=here)
                full += kind.size
            else:
                r, c = np.nonzero(here)
                row = np.full(len(r), np.iinfo(bits).max, bits)
                for p in range(rest.shape[1]):
                    hit = row & hits[rest[r, p], c]
                    row = (row + hit) | (row - hit)
                lcs[r, c] = np.bitwise_count(~row & kept[c])
                full += len(r)
            left = left & ~here
        r, c = np.nonzero(left) if left.any() else (np.zeros(0, np.int64),) * 2
        if len(r):
            places = np.arange(self.word.shape[1], dtype=np.uint8)
            kept_x, kept_y = (self._kept(z[k], (common[r, c][:, None] >> places & 1).astype(bool)) for z, k, common in ((x, r, common_x), (y, c, common_y)))
            lcs[r, c] = self._lcs(x[r], y[c], kept_x, kept_y)
        return lcs, full + len(r)

    def _lcs(self, x: np.ndarray, y: np.ndarray, kept_x: np.ndarray, kept_y: np.ndarray) -> np.ndarray:
        """The longest common subsequences of the kept letters of pairs."""
        row = np.full(len(x), np.uint64(0xFFFFFFFFFFFFFFFF))
        for p in range(int(self.length[y].max(initial=0))):
            now = (kept_y >> np.uint64(p)) & np.uint64(1)
            u = row & self.hits[x, self.code[y, p]] & kept_x & (np.uint64(0) - now)
            row = (row + u) | (row - u)
        return np.bitwise_count(~row & kept_x)


class _Side:
    """Texts of one length in tables: what serves each table that they are in is worked out once."""

    def __init__(self, names: Names, of: np.ndarray) -> None:
        self.names, self.of = names, of
        self.classes = names.classes[of].astype(np.uint8)
        self.by_class = np.ascontiguousarray(self.classes.T)
        self._rests: dict[int, np.ndarray] = {}
        self._hits: dict[int, np.ndarray] = {}
        self._words: tuple[np.ndarray, np.ndarray] | None = None

    def part(self, begin: int, end: int) -> _Side:
        """The texts of these places, sharing what is worked out."""
        return self if begin == 0 and end == len(self.of) else _Part(self, begin, end)

    def rests(self, common: int) -> np.ndarray:
        """The letters of the rests where the words of these places are common."""
        if common not in self._rests:
            self._rests[common] = self.names._letters(self.of, self.names._kept_of(self.of, common))
        return self._rests[common]

    def hits(self, common: int) -> np.ndarray:
        """Where each letter, a row, stands in the rest of each text, as bits; the last row is for none."""
        if common not in self._hits:
            rest = self.rests(common)
            bits = np.uint16 if rest.shape[1] <= 16 else np.uint32 if rest.shape[1] <= 32 else np.uint64
            hits, each = np.zeros((self.names.hits.shape[1], len(self.of)), bits), np.arange(len(self.of))
            for p in range(rest.shape[1]):
                hits[rest[:, p], each] |= bits(1 << p)
            hits[-1] = 0
            self._hits[common] = hits
        return self._hits[common]

    @property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Words in order, and for each, a row, its place in each text as a bit; the last row is for none."""
        if self._words is None:
            word = self.names.word[self.of]
            some, place = np.unique(word, return_inverse=True)
            slots, place = np.zeros((len(some) + 1, len(self.of)), np.uint8), place.reshape(word.shape)
            for k in range(word.shape[1]):
                slots[place[:, k], np.arange(len(self.of))] |= np.uint8(1 << k)
            if some[0] < 0:
                slots[0] = 0
            self._words = some, slots
        return self._words

    @property
    def slots(self) -> np.ndarray:
        return self.words[1]

    def places(self, word: np.ndarray) -> np.ndarray:
        """The rows of words."""
        some = self.words[0]
        at = np.minimum(np.searchsorted(some, word), len(some) - 1)
        return np.where(some[at] == word, at, len(some))


class _Part(_Side):
    """Some of the texts of a side."""

    def __init__(self, whole: _Side, begin: int, end: int) -> None:
        self.whole, self.at = whole, slice(begin, end)
        self.names, self.of, self.classes, self.by_class = whole.names, whole.of[self.at], whole.classes[self.at], whole.by_class[:, self.at]

    def rests(self, common: int) -> np.ndarray:
        return self.whole.rests(common)[self.at]

    def hits(self, common: int) -> np.ndarray:
        return self.whole.hits(common)[:, self.at]

    @property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        some, slots = self.whole.words
        return some, slots[:, self.at]
