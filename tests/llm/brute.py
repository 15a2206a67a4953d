"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return [w for w in BLANK.split(text or "") if w]


def repeated(units: dict, width: int) -> dict:
    """Covered unit positions of each document."""
    where = defaultdict(list)
    for key, own in units.items():
        for i in range(len(own) - width + 1):
            where[tuple(own[i : i + width]) if isinstance(own, list) else own[i : i + width]].append((key, i))
    out = {key: set() for key in units}
    for places in where.values():
        if len(places) > 1:
            for key, i in places:
                out[key].update(range(i, i + width))
    return out


def passages(docs: list[tuple], width: int = 35) -> set[tuple]:
    units = {i: words(text) for i, (_, text) in enumerate(docs)}
    gone, rows = repeated(units, width), []
    for i, (doc_id, _) in enumerate(docs):
        kept = [w for j, w in enumerate(units[i]) if j not in gone[i]]
        rows.append((doc_id, len(units[i]), len(gone[i]), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return Counter(rows)


def strings(docs: list[tuple], width: int = 200) -> set[tuple]:
    units = {i: (text or "").encode() for i, (_, text) in enumerate(docs)}
    gone, rows = repeated(units, width), []
    for i, (doc_id, _) in enumerate(docs):
        kept = bytes(b for j, b in enumerate(units[i]) if j not in gone[i])
        spans = sum(j - 1 not in gone[i] for j in gone[i])
        rows.append((doc_id, len(units[i]), len(gone[i]), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(rows)


def shingles(text: str | None, n: int = 5) -> frozenset:
    own = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(own[i : i + n]) for i in range(len(own) - n + 1)) if len(own) >= n else frozenset([tuple(own)] if own else [])


def near_copies(docs: list[tuple], percent: int = 80) -> Counter:
    sets = [shingles(text) for _, text in docs]
    holders = defaultdict(list)
    for i, own in enumerate(sets):
        for x in own:
            holders[x].append(i)
    top = list(range(len(docs)))

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i, own in enumerate(sets):
        for j, n in Counter(j for x in own for j in holders[x] if j > i).items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                top[find(i)] = find(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(docs):
        ids = smallest.setdefault(find(i), [])
        if doc_id is not None:
            ids.append(doc_id)
    return Counter((doc_id, len(sets[i]), min(smallest[find(i)], default=None)) for i, (doc_id, _) in enumerate(docs))


def unigram(docs: list[tuple]) -> dict:
    """n_tokens, n_known, train_tokens and base score by position."""
    import math
    import zlib

    own = [[*words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), None] for _, text in docs]
    train = [doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2 for doc_id, _ in docs]
    c = Counter(t for tokens, ok in zip(own, train, strict=True) if ok for t in tokens)
    n, v = sum(c.values()), len(c)
    return [(len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t)) for t in own]


def mixed(rows: list[tuple], hashes: list[list[int]], lm) -> list[float]:
    """log10 scores by plain counting; rows are (node, train), hashes each row's token hashes, the end token last."""
    import math

    end, mask, bits = int(lm.END), int(lm.LOW), lm.CODE_BITS
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    tokens, times, codes, nodes = [], Counter(), Counter(), Counter()
    for i in order:
        before = [end, end, end]
        for h in hashes[i]:
            reduced = [before[0] & mask, *((x >> 24) & (lm.CODES - 1) for x in before[1:])]
            a, b, c = (int(x[0]) for x in lm.longer([lm.np.array([x], lm.np.uint64) for x in reduced]))
            route = b if before[0] == end else before[0]
            tokens.append((i, rows[i][1], h, h % lm.CODES, (a, b, c), before[0] == end, ((route >> 40) * 4) >> 24))
            before = [h, *before[:2]]
            times[h] += rows[i][1]
            codes[h % lm.CODES] += rows[i][1]
    visits = Counter()
    for _, train, _, code, found, _, _ in tokens:
        for depth in range(bits + 1):
            nodes[depth, code >> (bits - depth)] += train
            for x in enumerate(found):
                visits[x, depth, code >> (bits - depth)] += train
    total = [0.0] * len(rows)
    for i, train, h, code, *_ in tokens:
        total[i] += math.log10(max(times[h] - train, 1)) - math.log10(codes[code] - train + 1)
    squash = lambda x: 1 / (1 + math.exp(-x))
    for fragment in range(4):
        own = [t for t in tokens if t[6] == fragment]
        for depth in range(bits):
            w = {g: [0.4] * 4 for g in range(8)}
            ones, seen_at = [4 * squash(-8 + x / 2) for x in range(33)], [4.0] * 33
            cases = []
            for i, train, _, code, found, first, _ in own:
                bit, x, gate = code >> (bits - 1 - depth) & 1, [0.0] * 4, 0
                same, every = nodes[depth + 1, code >> (bits - 1 - depth)] - train, nodes[depth, code >> (bits - depth)] - train
                x[0] = math.log((same + 0.4) / (every - same + 0.4)) * (2 * bit - 1)
                for k, context in enumerate(enumerate(found)):
                    every = visits[context, depth, code >> (bits - depth)] - train
                    if every > 0 and not (k == 0 and first and depth >= lm.HOT_BITS):
                        same = visits[context, depth + 1, code >> (bits - 1 - depth)] - train
                        x[k + 1], gate = math.log((same + 0.4) / (every - same + 0.4)) * (2 * bit - 1), gate | 1 << k
                cases.append((i, train, bit, x, gate, same_rest(nodes, code, depth, train, bits)))
            for i, *_, g, plain in cases:
                total[i] += 0 if g else math.log10(plain)
            cases, low, step = [c for c in cases if c[4]], 0, lm.FIRST_STEP
            while low < len(cases):
                slope, bend, new = defaultdict(lambda: [0.0] * 4), Counter(), []
                for i, train, bit, x, g, _ in cases[low : low + step]:
                    y = max(-8.0, min(8.0, sum(a * b for a, b in zip(x, w[g], strict=True))))
                    at = round((y + 8) * 2)
                    p = (squash(y) + ones[at] / seen_at[at]) / 2
                    total[i] += math.log10(p if bit else 1 - p)
                    if train:
                        new.append((at, bit))
                        for k in range(4):
                            slope[g][k] += (bit - squash(y)) * x[k]
                        bend[g] += sum(v * v for v in x)
                for at, bit in new:
                    ones[at] += bit
                    seen_at[at] += 1
                for g, s in slope.items():
                    w[g] = [a + b / (bend[g] / 4 + 8) for a, b in zip(w[g], s, strict=True)]
                low, step = low + step, min(lm.LAST_STEP, step + step // 4)
    return total


def same_rest(nodes: Counter, code: int, depth: int, train: int, bits: int) -> float:
    below, above = nodes[depth + 1, code >> (bits - 1 - depth)] - train, nodes[depth, code >> (bits - depth)] - train
    return (max(below, 0) + 0.4) / (max(above, 0) + 0.8)
