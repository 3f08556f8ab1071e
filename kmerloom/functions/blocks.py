"""Graph work on blocks of two-bit k-mers, in numpy.

Windows of a read that follow each other mostly share a minimizer, so they travel as one run of
bases. All occurrences of a k-mer come to the block of its minimizer, where it is counted and
joined with its neighbours; what is passed on are pieces of unitigs with open ends. An end is named
by the k + 1 bases over which it goes on; ends with one name belong together.

For k up to 31 and at most 62 colors. Node i has sides 2i (before it) and 2i + 1 (after it); state
s is a node left by side s, and its other strand is s ^ 1.
"""

from __future__ import annotations

import numpy as np

MAX_K, MAX_COLORS = 31, 62
#: Bases of the shortest words by which neighbouring k-mers come to one place.
MINIMIZER = 15

_U = np.uint64
_BASE = np.full(256, 4, np.uint8)
_BASE[np.frombuffer(b"ACGTacgt", np.uint8)] = [0, 1, 2, 3] * 2
LETTER = np.frombuffer(b"ACGT", np.uint8)
_BEFORE = np.array([0x80, 0x40, 0x20, 0x10, 0], np.uint8)
_AFTER = np.array([0x01, 0x02, 0x04, 0x08, 0], np.uint8)
_ALL = np.arange(256)
SWAP = ((_ALL << 4 | _ALL >> 4) & 255).astype(np.uint8)
#: The base of a mask's only flag on one side, -1 if there is none or more than one.
_ONE_AFTER = np.full(256, -1, np.int8)
_ONE_BEFORE = np.full(256, -1, np.int8)
for _b in range(4):
    _ONE_AFTER[(_ALL & 15) == _AFTER[_b]] = _b
    _ONE_BEFORE[(_ALL & 240) == _BEFORE[_b]] = _b


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bases 0 to 3 of the letters acgt of rows of text, and where each row begins."""
    codes = _BASE[data]
    keep = codes < 4
    places = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], places[offsets]


def segments(bases: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n bases from each place on, and of their reverse complement, by doubling."""
    if len(bases) < n:
        return np.zeros(0, _U), np.zeros(0, _U)
    one = bases.astype(_U)
    other, have = one ^ _U(3), 1
    forward, backward, size = np.zeros(len(bases) + 1, _U), np.zeros(len(bases) + 1, _U), 0
    while True:
        if n & have:
            count = len(bases) - size - have + 1
            forward = forward[:count] << _U(2 * have) | one[size : size + count]
            backward = other[size : size + count] << _U(2 * size) | backward[:count]
            size += have
        if 2 * have > n:
            return forward, backward
        m = len(one) - have
        one, other, have = one[:m] << _U(2 * have) | one[have : have + m], other[have : have + m] << _U(2 * have) | other[:m], 2 * have


def reverse(codes: np.ndarray, n: int) -> np.ndarray:
    """Reverse complement of codes of n bases, n up to 32."""
    x = ~codes
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        x = (x >> _U(shift)) & _U(mask) | (x & _U(mask)) << _U(shift)
    return x.byteswap() >> _U(64 - 2 * n)


def _mixed(x: np.ndarray, by: int) -> np.ndarray:
    x = x * _U(by)
    x ^= x >> _U(32)
    return x * _U(0x9E3779B97F4A7C15) >> _U(32)


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each n values that follow each other."""
    have = 1
    while 2 * have <= n:
        x, have = np.minimum(x[:-have], x[have:]), 2 * have
    return np.minimum(x[: len(x) - (n - have)], x[n - have :]) if have < n else x


def block_of(bases: np.ndarray, k: int, blocks: int) -> np.ndarray:
    """The block of the k-mer at each place: that of the least hash of its short words, of either strand."""
    m = min(MINIMIZER, k)
    a, b = segments(bases, m)
    low = _least(_mixed(np.minimum(a, b), 0xD6E8FEB86659FD93), k - m + 1)
    return (_mixed(low, 0xA0761D6478BD642F) * _U(blocks) >> _U(32)).astype(np.int32)


def block_of_codes(codes: np.ndarray, k: int, blocks: int) -> np.ndarray:
    """The same of codes."""
    return block_of(bases_of(codes, k).ravel(), k, blocks)[::k] if len(codes) else np.zeros(0, np.int32)


def bases_of(codes: np.ndarray, k: int) -> np.ndarray:
    return (codes[:, None] >> (_U(2) * np.arange(k - 1, -1, -1, dtype=_U)) & _U(3)).astype(np.uint8)


def places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs, one after the other."""
    total = int(sizes.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def packed(bases: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of bases, four a byte, each from a byte of its own; and their bytes."""
    size = (sizes + 3) // 4
    at = np.minimum(places(starts, 4 * size), len(bases) - 1)
    b = bases[at].reshape(-1, 4)
    return b[:, 0] << 6 | b[:, 1] << 4 | b[:, 2] << 2 | b[:, 3], size


def unpacked(data: np.ndarray) -> np.ndarray:
    out = np.empty((len(data), 4), np.uint8)
    for i in range(4):
        out[:, i] = data >> (6 - 2 * i) & 3
    return out.ravel()


def runs(bases: np.ndarray, offsets: np.ndarray, k: int, blocks: int):
    """``block, row, size, ends, first`` of the runs of windows of rows that share a block.

    ``ends`` is five times the base before a run plus that after it, 4 where the row ends.
    """
    if len(bases) < k:
        return None
    block = block_of(bases, k, blocks)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[: len(block)] == row[k - 1 :]
    change = np.ones(len(block) + 1, bool)
    change[1:-1] = (block[1:] != block[:-1]) | (inside[1:] != inside[:-1])
    at = np.flatnonzero(change)
    first, size = at[:-1], np.diff(at)
    own = inside[first]
    first, size = first[own], size[own]
    r = row[first]
    end = first + size + k - 1
    before = np.where(first > offsets[r], bases[np.maximum(first - 1, 0)], 4)
    after = np.where(end < offsets[r + 1], bases[np.minimum(end, len(bases) - 1)], 4)
    return block[first], r, size, (before * 5 + after).astype(np.uint8), first


def counted(size: np.ndarray, ends: np.ndarray, color: np.ndarray, home: np.ndarray, data: np.ndarray, k: int, colors: int):
    """``codes, coverage, edges, home`` of the k-mers of a block's runs; codes in order, home the least of them."""
    length = size + k - 1
    four = (length + 3) // 4 * 4
    bases = unpacked(data)
    start = np.cumsum(four) - four
    forward, backward = segments(bases, k)
    at = places(start, size)
    first = np.cumsum(size) - size
    before, after = bases[at - 1], bases[np.minimum(at + k, len(bases) - 1)]
    before[first] = ends // 5
    after[first + size - 1] = ends % 5
    a, b = forward[at], backward[at]
    flags = _BEFORE[before] | _AFTER[after]
    flags = np.where(a <= b, flags, SWAP[flags])
    code = np.minimum(a, b)
    return gathered(code, np.repeat(color, size), None, flags, np.repeat(home, size), colors)


def gathered(code, color, coverage, flags, home, colors: int):
    """``codes, coverage, edges, home`` of rows: one node for each code, colors side by side."""
    order = np.argsort(code)
    code = code[order]
    new = np.ones(len(code), bool)
    new[1:] = code[1:] != code[:-1]
    rank = np.cumsum(new) - 1
    n = int(rank[-1]) + 1 if len(rank) else 0
    slot = rank * colors + color[order]
    if coverage is None:
        total = np.bincount(slot, minlength=n * colors)
    else:
        total = np.zeros(n * colors, np.int64)
        np.add.at(total, slot, coverage[order])
    edges = np.zeros(n * colors, np.uint8)
    np.bitwise_or.at(edges, slot, flags[order])
    return code[new], total.reshape(n, colors), edges.reshape(n, colors), np.minimum.reduceat(home[order], np.flatnonzero(new)) if n else home[:0]


def only_bases(coverage: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Colors present, as bits, and by side the one base that follows in all of them, or -1.

    There is none if another color has an edge there.
    """
    here = coverage > 0
    present = (here.astype(_U) << np.arange(here.shape[1], dtype=_U)).sum(1, dtype=_U)
    every = np.bitwise_or.reduce(np.where(here, edges, 0), 1)
    same = np.bitwise_and.reduce(np.where(here, edges, 255), 1) ^ every
    bad = same | np.bitwise_or.reduce(np.where(here, 0, edges), 1)
    out = np.empty((len(edges), 2), np.int8)
    out[:, 0] = np.where(bad & 240, -1, _ONE_BEFORE[every])
    out[:, 1] = np.where(bad & 15, -1, _ONE_AFTER[every])
    return present, out.ravel()


def links(codes: np.ndarray, present: np.ndarray, base: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``link, open, key`` of the sides of nodes: the side they are joined to or -1; sides that go on elsewhere, with their name."""
    side = np.flatnonzero(base >= 0)
    code, b = codes[side >> 1], base[side].astype(_U)
    out = (side & 1).astype(bool)
    whole = np.where(out, code << _U(2) | b, b << _U(2 * k) | code)
    far = np.where(out, whole & _U((1 << 2 * k) - 1), whole >> _U(2))
    turned = reverse(far, k)
    # a side after a node meets the side before the next, on its own strand
    meets = (out == (far > turned)).astype(np.int64)
    far = np.minimum(far, turned)
    at = np.minimum(np.searchsorted(codes, far), len(codes) - 1)
    found = codes[at] == far
    wish = np.full(len(base), -1, np.int64)
    wish[side[found]] = 2 * at[found] + meets[found]
    have = np.flatnonzero(wish >= 0)
    to = wish[have]
    good = (wish[to] == have) & (have >> 1 != to >> 1) & (present[have >> 1] == present[to >> 1])
    link = np.full(len(base), -1, np.int64)
    link[have[good]] = to[good]
    gone, key = np.zeros(len(base), bool), np.zeros(len(base), _U)
    gone[side[~found]] = True
    key[side] = np.minimum(whole, reverse(whole, k + 1))
    return link, gone, key


def matched(open_: np.ndarray, key: np.ndarray, present: np.ndarray) -> np.ndarray:
    """The link of each side of pieces: open sides of one name whose pieces have the same colors."""
    link = np.full(len(open_), -1, np.int64)
    side = np.flatnonzero(open_)
    side = side[np.argsort(key[side], kind="stable")]
    pair = np.flatnonzero((key[side[1:]] == key[side[:-1]]) & (present[side[1:] >> 1] == present[side[:-1] >> 1]))
    a, b = side[pair], side[pair + 1]
    link[a], link[b] = b, a
    return link


def _heads(before: np.ndarray, states: np.ndarray, head: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Heads and distances of states by pointer doubling; what is left are states of cycles."""
    head[states], pos[states] = np.where(before[states] >= 0, before[states], states), before[states] >= 0
    active = states
    for _ in range(len(before).bit_length() + 2):
        to = head[active]
        more = before[to] >= 0
        active, to = active[more], to[more]
        if not len(active):
            break
        further, beyond = pos[to], head[to]
        pos[active] += further
        head[active] = beyond
    return active


def chains(link: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``states, sizes, loop``: one strand of every chain of nodes, in order, one after the other.

    A cycle is cut somewhere.
    """
    link = link.copy()
    every = np.arange(len(link))
    before = link[every ^ 1]
    head, pos = np.empty(len(link), np.int64), np.zeros(len(link), np.int64)
    round_ = _heads(before, every, head, pos)
    loop = np.zeros(len(link), bool)
    if len(round_):
        low, jump = every.copy(), before.copy()
        for _ in range(len(round_).bit_length() + 1):
            low[round_], jump[round_] = np.minimum(low[round_], low[jump[round_]]), jump[jump[round_]]
        cut = round_[(low[round_] == round_) & (low[round_] < low[round_ ^ 1])]
        link[link[cut ^ 1]] = -1
        link[cut ^ 1] = -1
        before = link[every ^ 1]
        _heads(before, round_, head, pos)
        loop[round_] = True
    last = np.flatnonzero(link < 0)
    begin = head[last]
    keep = begin > last ^ 1
    last, begin = last[keep], begin[keep]
    sizes = pos[last] + 1
    first = np.full(len(link), -1, np.int64)
    first[begin] = np.cumsum(sizes) - sizes
    mine = np.flatnonzero(first[head] >= 0)
    states = np.empty(len(mine), np.int64)
    states[first[head[mine]] + pos[mine]] = mine
    return states, sizes, loop[begin]


class Pieces:
    """Parts of unitigs, one strand of each: ``bases`` one after the other, ``nk`` k-mers each,
    ``edges`` by color before the first and after the last k-mer, colors ``present``, sides
    ``open`` with their ``key``, ``loop``, and what ``extra`` is summed (coverage) or kept by k-mer."""

    def __init__(self, bases, nk, edges, present, open_, key, loop, extra):
        self.bases, self.nk, self.edges, self.present, self.open, self.key, self.loop, self.extra = bases, nk, edges, present, open_, key, loop, extra

    def __len__(self):
        return len(self.nk)

    def starts(self, k: int) -> np.ndarray:
        size = self.nk + k - 1
        return np.cumsum(size) - size


def _ends(states, sizes, edges, open_, key):
    """Edges, open sides and keys at both ends of chains."""
    stop = np.cumsum(sizes)
    h, t = states[stop - sizes], states[stop - 1]
    turn = lambda s: np.where((s & 1).astype(bool)[:, None], edges[s >> 1], SWAP[edges[s >> 1]])
    both = np.stack([h ^ 1, t], 1).ravel()
    return turn(h) & 240 | turn(t) & 15, open_[both], key[both], h


def compacted(codes, coverage, edges, k: int, mode: str) -> tuple[Pieces, np.ndarray]:
    """Pieces of the nodes of a block, and by node (in the order of the pieces) its index."""
    present, base = only_bases(coverage, edges)
    link, open_, key = links(codes, present, base, k)
    states, sizes, loop = chains(link)
    node = states >> 1
    own = codes[node]
    back = (states & 1) == 0
    own[back] = reverse(own[back], k)
    e, o, n, h = _ends(states, sizes, edges, open_, key)
    stop = np.cumsum(sizes)
    first = stop - sizes
    begin = first + np.arange(len(sizes)) * (k - 1)
    bases = np.empty(len(states) + len(sizes) * (k - 1), np.uint8)
    bases[places(begin + k - 1, sizes)] = own & _U(3)
    bases[(begin[:, None] + np.arange(k - 1)).ravel()] = bases_of(own[first] >> _U(2), k - 1).ravel()
    extra = None if mode == "none" else coverage[node] if mode == "all" else np.add.reduceat(coverage[node], first) if len(first) else coverage[:0]
    return Pieces(bases, sizes, e, present[h >> 1], o & ~np.repeat(loop, 2), n, loop, extra), node


def joined(p: Pieces, k: int, mode: str) -> Pieces:
    """Pieces put together at their open ends, as far as both sides are here."""
    states, sizes, loop = chains(matched(p.open, p.key, p.present))
    piece = states >> 1
    back = (states & 1) == 0
    e, o, n, h = _ends(states, sizes, p.edges, p.open, p.key)
    stop = np.cumsum(sizes)
    first = stop - sizes
    inner = np.ones(len(states), bool)
    inner[first] = False
    # of all but the first the k - 1 bases that overlap are left out
    nk = p.nk[piece]
    size = nk + np.where(inner, 0, k - 1)
    start = p.starts(k)[piece]
    length = nk + k - 1
    begin = np.where(back, start + length - 1 - np.where(inner, k - 1, 0), start + np.where(inner, k - 1, 0))
    step = np.where(back, -1, 1)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    bases = p.bases[np.repeat(begin, size) + np.repeat(step, size) * at] ^ np.repeat(np.where(back, 3, 0).astype(np.uint8), size)
    total = np.add.reduceat(nk, first) if len(first) else nk
    extra = None
    if mode == "sum":
        extra = np.add.reduceat(p.extra[piece], first) if len(first) else p.extra
    elif mode == "all":
        rows = (np.cumsum(p.nk) - p.nk)[piece]
        at = np.arange(int(nk.sum())) - np.repeat(np.cumsum(nk) - nk, nk)
        extra = p.extra[np.repeat(np.where(back, rows + nk - 1, rows), nk) + np.repeat(step, nk) * at]
    was = np.add.reduceat(p.loop[piece].astype(np.int64), first) > 0 if len(first) else loop
    return Pieces(bases, total, e, p.present[h >> 1], o & ~np.repeat(loop, 2), n, loop | was, extra)


def select(p: Pieces, which: np.ndarray, k: int, mode: str) -> Pieces:
    """Some of the pieces, in the order of ``which``."""
    both = (2 * which[:, None] + np.arange(2)).ravel()
    bases = p.bases[places(p.starts(k)[which], p.nk[which] + k - 1)]
    extra = p.extra if mode == "none" else p.extra[which] if mode == "sum" else p.extra[places((np.cumsum(p.nk) - p.nk)[which], p.nk[which])]
    return Pieces(bases, p.nk[which], p.edges[which], p.present[which], p.open[both], p.key[both], p.loop[which], extra)


def merged(parts: list[Pieces]) -> Pieces:
    cat = lambda name: np.concatenate([getattr(p, name) for p in parts])
    return Pieces(*[cat(n) for n in ("bases", "nk", "edges", "present", "open", "key", "loop")], None if parts[0].extra is None else cat("extra"))
