"""What line dedup does, a text or an array at a time in Python: the reference that tests hold its columns against."""

from __future__ import annotations

from itertools import combinations

import numpy as np

from .kernels import joined, mix

U64 = np.uint64
BITS = 64
#: A logarithm's unit: lengths a factor of 0.8 apart differ by 446.3 of them.
LOG = 2000
#: Bits, about, of the integers in which one text is compared with several.
LANES = 1 << 16


def simhash(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For runs of hashes that begin at ``first``: each bit by majority over the run."""
    if not len(first):
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    count = np.diff(np.r_[first, len(h)])
    return np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def block_keys(sims: np.ndarray, blocks: int, radius: int) -> np.ndarray:
    """A column for each choice of blocks - radius of the blocks, its number mixed in."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    out = []
    for number, choice in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in choice)
        out.append(mix((sims & U64(mask)) ^ mix(np.full(1, number + 1, np.uint64))))
    return np.stack(out, 1) if len(sims) else np.zeros((0, 0), np.uint64)


def tight(key: np.ndarray, node: np.ndarray, sim: np.ndarray, size: np.ndarray, most: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """What is connected under one key by length and SimHash: places of ``node`` but the least, and that one's
    place. Entries alike in all are one; others are compared with those that follow under their key, nearest
    first, and what that connects is folded up now and then."""
    order = np.lexsort((node, size, sim, key))
    k, s, n, m = key[order], sim[order], size[order].astype(np.int64), most[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1]) | (n[1:] != n[:-1])]
    lead = np.flatnonzero(new)
    twins = np.flatnonzero(~new)
    a, b = [twins], [lead[np.cumsum(new) - 1][twins]]
    k, s, n, m = k[lead], s[lead], n[lead], m[lead]
    last = np.r_[np.flatnonzero(k[1:] != k[:-1]) + 1, len(k)]
    last = np.repeat(last, np.diff(np.r_[0, last]))
    apart = -np.log(similarity) * LOG + 1
    at, d, held = np.arange(len(k)), 1, 0
    while True:
        at = at[at + d < last[at]]
        if not len(at):
            break
        near = at[(np.bitwise_count(s[at] ^ s[at + d]) <= m[at]) & (np.abs(n[at] - n[at + d]) <= apart)]
        a.append(lead[near + d])
        b.append(lead[near])
        held += len(near)
        if held > 1 << 21:
            x, y = joined(np.concatenate(a), np.concatenate(b))
            a, b, held = [x], [y], 0
        d += 1
    x, y = joined(np.concatenate(a), np.concatenate(b))
    # the least node of what is connected, not the least place
    x, y = order[x], order[y]
    if not len(x):
        return x, y
    least = node.copy()
    np.minimum.at(least, y, node[x])
    where = np.arange(len(node))
    best = node[x] == least[y]
    where[y[best]] = x[best]
    moved = np.unique(y[best])
    x, y = np.r_[x, moved], np.r_[where[y], where[moved]]
    other = x != y
    return x[other], y[other]


def jobs_of(x: np.ndarray, y: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(job, node), each once, of what ``tight`` connected under a key, where that is three nodes or more. A job is
    named by a hash of its nodes, so that keys with the same ones have one."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = np.unique(y)
    group, member = np.r_[head, y], np.r_[node[head], node[x]]
    order = np.lexsort((member, group))
    group, member = group[order], member[order]
    new = np.r_[True, (group[1:] != group[:-1]) | (member[1:] != member[:-1])]
    group, member = group[new], member[new]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, len(group)])
    name = mix(np.add.reduceat(mix(member.view(np.uint64)), first) + size.astype(np.uint64))
    once = np.zeros(len(first), bool)
    once[np.unique(name, return_index=True)[1]] = True
    some = np.repeat(once & (size > 2), size)
    return np.repeat(name, size)[some].view(np.int64), member[some]


def swapped(a: str, b: str) -> int | None:
    """A bound from above of the edit distance of lines with as many words: words that differ, each replaced
    as a whole. None where the numbers of words differ."""
    x, y = a.split(" "), b.split(" ")
    return sum(max(len(p), len(q)) for p, q in zip(x, y, strict=True) if p != q) if len(x) == len(y) else None


def alike(a: str, b: str, similarity: float) -> bool:
    """Whether 1 less the edit distance over the longer length reaches ``similarity``, at any length. What swapped
    words alone prove needs no edit distance."""
    shorter, longer = sorted((len(a), len(b)))
    if shorter < similarity * longer or not longer:
        return False
    sure = swapped(a, b)
    if sure is not None and 1 - sure / longer >= similarity:
        return True
    return 1 - edit_distance(a, b, int((1 - similarity) * longer) + 1) / longer >= similarity


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Myers' bit vectors, one integer of len(a) bits a vector. Beyond ``most``, something greater than it."""
    while a and b and a[0] == b[0]:
        n = min(len(a), len(b))
        step = next((i for i in range(64, n, 64) if a[i - 64 : i] != b[i - 64 : i]), n)
        same = next((i for i in range(max(0, step - 64), step) if a[i] != b[i]), step)
        a, b = a[same:], b[same:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b)
    n, where = len(a), {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    most = n + len(b) if most is None else most
    for j, x in enumerate(b):
        if score - (len(b) - j) > most:  # each sign still to come lowers it by one at best
            return most + 1
        eq = where.get(x, 0)
        v = eq | minus
        eq |= ((eq & plus) + plus) ^ plus
        up, down = minus | ~(eq | plus), plus & eq
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, (down << 1) & full
        plus, minus = (down | ~(v | up)) & full, up & v
    return score


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _integer(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def distances(text: str, others: list[str]) -> np.ndarray:
    """Edit distances of ``text`` from each of the others, which are not empty: the bit vectors of all of them
    lie in one integer, a bit that stays empty after each, so that a step goes through all at once."""
    codes = np.concatenate([x for o in others for x in (_codes(o), np.full(1, -1))])
    size = np.array([len(o) + 1 for o in others])
    first = np.cumsum(size) - size
    head = np.zeros(len(codes), bool)
    head[first] = True
    full, low = _integer(codes >= 0), _integer(head)
    where = {x: _integer(codes == ord(x)) for x in set(text)}
    plus, minus = full, 0
    for x in text:
        eq = where[x]
        v = eq | minus
        eq = (eq | (((eq & plus) + plus) ^ plus)) & full
        up, down = minus | (full ^ (eq | plus)), plus & eq
        up, down = (up << 1 | low) & full, (down << 1) & full
        plus, minus = down | (full ^ (v | up)), up & v
    most = -(-len(codes) // 8)
    rise, fall = (np.unpackbits(np.frombuffer(x.to_bytes(most, "little"), np.uint8), bitorder="little")[: len(codes)].astype(np.int64) for x in (plus, minus))
    return len(text) + np.add.reduceat(rise - fall, first)


def alike_to(text: str, others: list[str], similarity: float) -> list[bool]:
    """``alike`` for one text and several, many of which are compared in one go."""
    if len(others) < 4:
        return [alike(text, o, similarity) for o in others]
    out, rest = [False] * len(others), []
    for i, o in enumerate(others):
        shorter, longer = sorted((len(text), len(o)))
        if shorter and shorter >= similarity * longer:
            sure = swapped(text, o)
            if sure is not None and 1 - sure / longer >= similarity:
                out[i] = True
            else:
                rest.append(i)
    step = max(1, LANES // (len(text) + 1))
    for at in range(0, len(rest), step):
        some = rest[at : at + step]
        for i, d in zip(some, distances(text, [others[i] for i in some]).tolist(), strict=True):
            out[i] = 1 - d / max(len(text), len(others[i])) >= similarity
    return out


def compare(texts: list[str], labels: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links (places) of alike texts of different labels, so that all alike ones end up joined. Counts of two
    letters in a row bound the edit distance from below: an edit changes four of them at most."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(size, kind="stable")
    size, label = size[order], np.unique(labels, return_inverse=True)[1][order]
    bins = np.zeros((len(texts), 256), np.int16 if size.max(initial=0) < 1 << 14 else np.int32)
    for r, i in enumerate(order.tolist()):
        code = _codes(texts[i])
        bins[r] = np.bincount((code[:-1] * 31 + code[1:] * 7) % 256, minlength=256)
    most = np.searchsorted(size, np.floor(size / similarity + 1e-9), "right")
    found = []
    for r in range(len(order)):
        other = np.arange(r + 1, most[r])
        other = other[label[other] != label[r]]
        for at in range(0, len(other), 512):
            some = other[at : at + 512]
            some = some[label[some] != label[r]]
            bound = np.abs(bins[some] - bins[r]).sum(1, dtype=np.int32) / 4
            close = some[1 - bound / np.maximum(size[some], 1) >= similarity]
            same = alike_to(texts[order[r]], [texts[i] for i in order[close].tolist()], similarity)
            for o in close[np.array(same, bool)].tolist():
                if label[o] != label[r]:
                    found.append((int(order[r]), int(order[o])))
                    label[label == label[o]] = label[r]
    return found
