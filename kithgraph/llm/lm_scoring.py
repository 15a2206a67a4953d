"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A token's hash gives it a code of 16 bits. Each bit is a binary decision; several predictors, counted over all
training documents, look at a context (no context, the token before, the two before, the three before) and at
the code's earlier bits. Their logits are added with weights gated by the bit's place and by which contexts were
seen; the sum is refined by an adaptive table of probabilities. Once none of the contexts was seen with the
earlier bits, what is left of the code follows the counts without a context. Tokens that share a code follow
their training counts. The log-probabilities of all tokens add up to the score, from which bits per byte follow.

Tokens are dealt by the token before them to fragments, whose number grows with the input. So each fragment has
all occurrences of its contexts, and its context counts grow with the training tokens. A fragment's weights and
table are learned online: its tokens are taken in order, each is predicted without its own count and before the
weights learn from it, and held-out ones are only predicted. Weights are not merged between fragments. A token that is not
hot stands before all of its successors in one fragment, so its exact count is found there too, and with it the
plain base score. Contexts that hold more than one in ``HOT_SHARE`` of all tokens, counted over all rows, are hot: their
tokens are dealt by the next longer context or by the row, to as many fragments as the context's share asks for, and each of
these gets the context's training counts of all codes, which are partial sums over all rows. Each document's sums travel back by
its row's hash.

Defined results: null text is empty and consists of its end token; null doc_id counts as training; repeated
rows count as often as they occur and score alike; an empty table gives no rows; extra columns are ignored.
A training document's own tokens count for the base score and, in the mixing, never for themselves. Tokens are
told apart by 40 bits of their hash and the fragment's number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm import textscan as ts
from kithgraph.llm.common import discard, materialize, table

CODE_BITS = 16
CODES = 1 << CODE_BITS
#: Bits of the code for which hot contexts are counted: all.
HOT_BITS = CODE_BITS
#: Predictors: no context, and the last one, two and three tokens.
ORDERS = 3
#: Contexts with more than one in HOT_SHARE tokens, and HOT_LEAST at least, are hot.
HOT_SHARE, HOT_LEAST = 4096, 2048
#: A hot context is dealt to so many fragments that it fills this part of one at most.
SPREAD = 16
#: Cells of counts that an order's contexts fall in by their hash, and tokens among which a task looks for frequent contexts.
CELLS, STRETCH = 1 << 16, 1 << 20
#: Counts that are added up in one group.
BLOCK = 1 << 13
FRAGMENT_BYTES = 16 << 20
END = np.uint64(0x5851F42D4C957F2D)
#: The bits of a token before that travel; the upper ones choose the fragment.
LOW = np.uint64((1 << 40) - 1)
LEVELS, REACH = 33, 8.0
#: Training tokens that are predicted before their misses change the weights: from few to many, as the weights settle.
FIRST_STEP, LAST_STEP = 64, 16384
#: Bytes of a token on its way: the token before, 16 bits of the hashes of the two before that, the code.
WIDTHS = (5, 2, 2, 2)
#: Bits that numbers up to CODES take.
LENGTHS = np.append(0, np.log2(np.arange(1, CODES + 1)).astype(np.uint8) + 1).astype(np.uint8)


def token_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row of a slice, its token hashes (words with A-Z lower-cased, then the end) and row bounds."""
    data, offsets = ts.string_buffers(column)
    for low, high in ts.slices(offsets):
        part, own = ts.lower_ascii(data[offsets[low] : offsets[high]]), offsets[low : high + 1] - offsets[low]
        starts, ends, rows = ts.word_spans(part, own)
        words = ts.span_hashes(ts.byte_sums(part), starts, ends)
        after = np.searchsorted(rows, np.arange(1, high - low + 1))
        tokens = np.insert(words, after, END)
        yield low, tokens, np.append(0, after + np.arange(1, high - low + 1))


def contexts(tokens: np.ndarray, bounds: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The three tokens before each one, as they travel, and the contexts they make; the end stands before a row."""
    nth = np.arange(len(tokens)) - np.repeat(bounds[:-1], np.diff(bounds))
    last = []
    for back in range(1, ORDERS + 1):
        own = np.full(len(tokens), END)
        inside = np.flatnonzero(nth >= back)
        own[inside] = tokens[inside - back]
        last.append(own & LOW if back == 1 else own >> np.uint64(24) & np.uint64(CODES - 1))
    return last, list(longer(last))


def longer(last: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
    """The contexts of one, two and three tokens, one after the other."""
    found = None
    for further in last:
        found = further if found is None else ts.mix(found * np.uint64(3) + further)
        del further
        yield found


def codes_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(CODES - 1)).astype(np.int64)


def places(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value in a sorted array, or -1."""
    out = np.full(len(values), -1, np.int32)
    for low in range(0, len(values) if len(known) else 0, BLOCK):
        part = values[low : low + BLOCK]
        at = np.minimum(np.searchsorted(known, part), len(known) - 1)
        out[low : low + BLOCK] = np.where(known[at] == part, at, -1)
    return out


def cells_of(x: np.ndarray) -> np.ndarray:
    return (ts.mix(x) & np.uint64(CELLS - 1)).astype(np.int64)


COUNTS = "block int, counts binary"


def packed_counts(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's counts by blocks, those without any left out."""
    for low in range(0, len(counts), BLOCK):
        part = np.append(counts[low : low + BLOCK], np.zeros(max(0, low + BLOCK - len(counts)), np.int64))
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([low // BLOCK], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["block", "counts"])


def added_counts(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of the tasks' counts."""

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, dtype=np.int64)
        for x in group.column("counts"):
            total += np.frombuffer(zlib.decompress(x.as_py()), dtype=np.int64)
        return pa.table({"block": group.column("block")[:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    out = np.zeros(-(-size // BLOCK) * BLOCK, dtype=np.int64)
    for row in parts.groupBy("block").applyInArrow(add, COUNTS).collect():
        out[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(zlib.decompress(row.counts), dtype=np.int64)
    return out[:size]


def is_hot(n: np.ndarray, total: int) -> np.ndarray:
    return (n * HOT_SHARE > total) & (n >= HOT_LEAST)


def hot_candidates(rows: DataFrame) -> tuple[list[np.ndarray], int]:
    """Sorted contexts of each order, all hot ones among them, and the number of tokens, from all rows.

    What is hot among all tokens has the same share of the tokens of one stretch at least, and so has the cell of
    counts that it falls in; only contexts for which both hold are candidates, and they are counted later.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, held, size = np.zeros((ORDERS, CELLS), np.int64), [[] for _ in range(ORDERS)], 0

        def frequent() -> Iterator[pa.RecordBatch]:
            for order, own in enumerate(held):
                x = np.concatenate(own)
                own.clear()
                cell = cells_of(x)
                n = np.bincount(cell, minlength=CELLS)
                cells[order] += n
                found, n = np.unique(x[(n * HOT_SHARE > size)[cell]], return_counts=True)
                found = found[n * HOT_SHARE > size]
                yield pa.RecordBatch.from_arrays([pa.array([-1 - order], pa.int32()), pa.array([found.tobytes()], pa.binary())], names=["block", "counts"])

        for batch in batches:
            for _, tokens, bounds in token_slices(batch.column(0)):
                for own, x in zip(held, contexts(tokens, bounds)[1], strict=True):
                    own.append(x)
                size += len(tokens)
                if size >= STRETCH:
                    yield from frequent()
                    size = 0
        if size:
            yield from frequent()
        yield from packed_counts(cells.ravel())

    parts = materialize(rows.select("text").mapInArrow(count, COUNTS), "contexts")
    cells = added_counts(parts.filter("block >= 0"), ORDERS * CELLS).reshape(ORDERS, CELLS)
    total = int(cells[0].sum())
    full = is_hot(cells, total)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, found in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(found.as_buffer(), np.uint64)
                x = x[full[-1 - kind][cells_of(x)]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), -1 - kind), pa.int32()), pa.array(x.view(np.int64))], names=["kind", "context"])

    often = parts.filter("block < 0").mapInArrow(pick, "kind int, context long").distinct().collect()
    discard(parts)
    out = [np.array([r.context for r in often if r.kind == order], dtype=np.int64).view(np.uint64) for order in range(ORDERS)]
    return [np.unique(np.append(x, END & LOW) if order == 0 else x) for order, x in enumerate(out)], total


COUNTED = "kind int, context long, parent long, n long, codes binary, counts binary"


def candidate_counts(rows: DataFrame) -> DataFrame:
    """Each order's candidates (kind: the order): the token before (parent), all tokens (n), and the codes of training tokens with their counts.

    The row of kind -1 has the counts without a context. All are partial sums over all rows.
    """
    known, _ = hot_candidates(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, every, sizes, parents = np.zeros(CODES, np.int64), 0, [np.zeros(len(x), np.int64) for x in known], [np.zeros(len(x), np.uint64) for x in known]
        fresh, held = [[] for _ in known], [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in known]

        def rows_of(order: int) -> Iterator[pa.RecordBatch]:
            keys, n = held[order]
            held[order], size = (keys[:0], n[:0]), sizes[order].copy()
            sizes[order][:] = 0
            own = np.flatnonzero(size)
            edges = np.searchsorted(keys, np.append(own, len(size)) << CODE_BITS)
            if len(own):
                yield counted_rows(order, known[order][own], parents[order][own], size[own], [(keys[a:b] & (CODES - 1), n[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)])

        def compact(order: int) -> None:
            keys, n = held[order]
            new, times = np.unique(np.concatenate(fresh[order]), return_counts=True)
            fresh[order].clear()
            keys, which = np.unique(np.concatenate([keys, new]), return_inverse=True)
            held[order] = keys, np.bincount(which, weights=np.concatenate([n, times]), minlength=len(keys)).astype(np.int64)

        for batch in batches:
            learns = np.asarray(batch.column(1).cast(pa.int8())) > 0
            for low, tokens, bounds in token_slices(batch.column(0)):
                codes, found = codes_of(tokens), contexts(tokens, bounds)[1]
                train = np.repeat(learns[low : low + len(bounds) - 1], np.diff(bounds))
                base += np.bincount(codes[train], minlength=CODES)
                every += len(codes)
                for order, x in enumerate(found):
                    at = places(known[order], x)
                    inside = np.flatnonzero(at >= 0)
                    at, learning = at[inside].astype(np.int64), train[inside]
                    sizes[order] += np.bincount(at, minlength=len(known[order]))
                    parents[order][at] = found[0][inside]
                    fresh[order].append((at << CODE_BITS | codes[inside])[learning])
                    if sum(map(len, fresh[order])) >= STRETCH:
                        compact(order)
                    if len(held[order][0]) >= STRETCH:
                        yield from rows_of(order)
        for order in range(ORDERS):
            if fresh[order]:
                compact(order)
            yield from rows_of(order)
        seen = np.flatnonzero(base)
        yield counted_rows(-1, np.zeros(1, np.uint64), np.zeros(1, np.uint64), np.array([every]), [(seen, base[seen])])

    def add(group: pa.Table) -> pa.Table:
        codes, n = (np.frombuffer(b"".join(group.column(name).to_pylist()), kind) for name, kind in (("codes", "<u2"), ("counts", "<i8")))
        total, first = np.bincount(codes, weights=n, minlength=CODES).astype(np.int64), [int(group.column(name)[0].as_py()) for name in ("kind", "context", "parent")]
        seen = np.flatnonzero(total)
        return pa.Table.from_batches([counted_rows(first[0], *(np.array([x]).view(np.uint64) for x in first[1:]), np.asarray(group.column("n")).sum(keepdims=True), [(seen, total[seen])])])

    return materialize(rows.select("text", "train").mapInArrow(count, COUNTED).groupBy("kind", "context").applyInArrow(add, COUNTED), "counts")


def counted_rows(kind: int, context: np.ndarray, parent: np.ndarray, n: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows of ``COUNTED``; parts are codes and their counts."""
    codes, counts = ([x.astype(width).tobytes() for x in own] for own, width in zip(zip(*parts, strict=True), ("<u2", "<i8"), strict=True))
    columns = [pa.array(np.full(len(context), kind), pa.int32()), *(pa.array(x.view(np.int64)) for x in (context, parent)), pa.array(n), pa.array(codes, pa.binary()), pa.array(counts, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=[field.split()[0] for field in COUNTED.split(", ")])


def hot_counts(rows: DataFrame, counted: DataFrame | None = None) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Training counts of the codes without a context, each order's hot contexts, and for each of these a row with its training tokens.

    Hot contexts are sorted; the end token is one of them. ``counted``: the ``candidate_counts`` of the rows.
    """
    counted = candidate_counts(rows) if counted is None else counted

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trained = [int(np.frombuffer(x.as_buffer(), "<i8").sum()) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(trained, pa.int64())], names=["kind", "context", "n", "trained"])

    base, total, known = np.zeros(CODES, np.int64), 0, [[] for _ in range(ORDERS)]
    for r in counted.filter("kind < 0").collect():
        base[np.frombuffer(r.codes, "<u2")], total = np.frombuffer(r.counts, "<i8"), r.n
    for r in counted.filter("kind >= 0").select("kind", "context", "n", "counts").mapInArrow(totals, "kind int, context long, n long, trained long").collect():
        known[r.kind].append((r.context, r.n, r.trained))
    hot, trained = [], []
    for order, own in enumerate(known):
        context, n, learned = np.array(own, dtype=np.int64).reshape(-1, 3).T
        context = np.ascontiguousarray(context).view(np.uint64)
        stays = np.flatnonzero(is_hot(n, total) | ((context == END & LOW) & (order == 0)))
        stays = stays[np.argsort(context[stays])]
        hot.append(context[stays])
        trained.append(learned[stays][:, None])
    return base, hot, trained


def arcs(counted: DataFrame, hot: np.ndarray, fragments: int) -> tuple[np.ndarray, np.ndarray]:
    """The first fragment of each hot context of one token, and how many neighbouring ones its tokens are dealt to; the end's go to all.

    Contexts begin side by side by their shares, so that fragments get equal parts.
    """
    n = {r.context: r.n for r in counted.filter("kind = 0").select("context", "n").collect()}
    total, size = counted.filter("kind < 0").first(), np.array([n[x] for x in hot.view(np.int64).tolist()], dtype=np.float64)
    spread = np.clip(np.ceil(size / max(1, total.n if total else 0) * (SPREAD * fragments)), 1, fragments).astype(np.int64)
    spread[hot == END & LOW] = fragments
    size[spread == fragments] = 0
    first = ((np.cumsum(size) - size / 2) / max(1, size.sum()) * fragments).astype(np.int64)
    return np.where(spread < fragments, first, 0), spread


def followers(counted: DataFrame, hot: list[np.ndarray], first: np.ndarray, spread: np.ndarray, fragments: int) -> DataFrame:
    """fragment, kind, context, codes, counts: the counts of each hot context, once for every fragment that its tokens are dealt to."""
    spark = counted.sparkSession
    chosen = spark.createDataFrame([(order, x) for order, own in enumerate(hot) for x in own.view(np.int64).tolist()], "kind int, context long")
    places = spark.createDataFrame(list(zip(hot[0].view(np.int64).tolist(), first.tolist(), spread.tolist(), strict=True)), "parent long, first long, spread long")
    own = counted.join(F.broadcast(chosen), ["kind", "context"]).join(F.broadcast(places), "parent")
    fragment = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("spread") - 1)).alias("fragment")
    return own.select(fragment, "kind", "context", "codes", "counts").withColumn("fragment", (F.col("fragment") % fragments).cast("int"))


class Counted:
    """Counts of training tokens along the codes that follow some contexts of one order.

    Tokens are sorted by 48 bits of the context and the code. Of these keys stays the number of low bits up to the first in
    which each differs from the one before. With ``followers``, (context, codes, counts) over all rows, these are sorted among the tokens and
    count for them. Nodes that hold one token, or none to learn from or to predict, are dropped.
    """

    def __init__(self, chosen: np.ndarray, context: np.ndarray, codes: np.ndarray, train: np.ndarray, followers: list[tuple[np.uint64, np.ndarray, np.ndarray]] | None = None) -> None:
        self.types, self.none, own = 0, len(codes), np.flatnonzero(chosen).astype(np.int32)
        keys = context[own]
        keys <<= np.uint64(CODE_BITS)
        keys |= codes[own].astype(np.uint64)
        if followers:
            more = np.repeat(np.array([x[0] for x in followers], np.uint64), [len(x[1]) for x in followers]) << np.uint64(CODE_BITS)
            keys, own = np.append(keys, more | np.concatenate([x[1] for x in followers])), np.append(own, np.full(len(more), self.none, own.dtype))
        order = np.argsort(keys)
        # A follower is no token: it has the place after the last.
        self.place, keys = own[order], keys[order]
        if followers is None:
            self.train = train[self.place]
            self.weights, self.kind = self.train, np.int32
        else:
            counts = np.concatenate([np.zeros(0, np.int64), *(x[2] for x in followers)])
            self.kind = np.int32 if counts.sum() < 1 << 31 else np.int64
            self.weights = np.append(np.zeros(len(own) - len(counts), self.kind), counts.astype(self.kind))[order]
            self.train = np.append(train, np.int8(0))[self.place]
        del order, own
        self.split = np.full(len(keys), CODE_BITS + 1, np.uint8)
        keys[1:] ^= keys[:-1].copy()
        self.split[1:] = LENGTHS[np.minimum(keys[1:], CODES, out=keys[1:]).astype(np.int32)]

    def visits(self, depth: int, out: np.ndarray) -> None:
        if not len(self.split):
            return
        edges = np.flatnonzero(self.split > CODE_BITS - depth)
        total, size = np.add.reduceat(self.weights, edges, dtype=self.kind), np.diff(np.append(edges, len(self.split)))
        stays = (total > 0) & (size > 1)
        if self.weights is self.train:
            if not depth:
                self.types = int((total > 0).sum())
            others = np.repeat(total, size)
            others -= self.train
            out[self.place] = others
            del others
            stays = np.repeat(stays, size)
            self.split, self.train, self.place = self.split[stays], self.train[stays], self.place[stays]
            self.weights = self.train
        else:
            out[self.place] = np.maximum(np.repeat(total, size) - self.train, 0)
            stays = np.repeat(stays & (np.add.reduceat(self.place < self.none, edges, dtype=np.int32) > 0), size)
            self.split, self.train, self.place, self.weights = self.split[stays], self.train[stays], self.place[stays], self.weights[stays]


class Context:
    """Counts of training tokens along the codes that follow each context of one order; hot contexts' followers are given."""

    def __init__(self, context: np.ndarray, codes: np.ndarray, train: np.ndarray, hot: np.ndarray, followers: list[tuple[np.uint64, np.ndarray, np.ndarray]]) -> None:
        is_hot = places(hot, context) >= 0
        self.parts = [Counted(~is_hot, context, codes, train), Counted(is_hot, context, codes, train, followers)]
        self.kind = self.parts[1].kind

    @property
    def types(self) -> int:
        """Contexts with training tokens that are not hot."""
        return self.parts[0].types

    def visits(self, depth: int, out: np.ndarray) -> None:
        """Set ``out`` to the other training tokens at the node that each token reaches after ``depth`` bits; 0 if none."""
        out[:] = 0
        for part in self.parts:
            part.visits(depth, out)


def tree(counts: np.ndarray) -> list[np.ndarray]:
    """Counts of the nodes at each depth, from the counts of all codes."""
    return [counts.reshape(1 << depth, -1).sum(axis=1) for depth in range(CODE_BITS + 1)]


def rest_of_code(nodes: list[np.ndarray], own: int) -> np.ndarray:
    """log2-probability of each code's bits from each depth on, by counts without a context and without ``own`` tokens."""
    out = np.zeros((CODE_BITS + 1, CODES), np.float32)
    for depth in range(CODE_BITS - 1, -1, -1):
        below = np.maximum(np.repeat(nodes[depth + 1], CODES >> (depth + 1)) - own, 0)
        above = np.maximum(np.repeat(nodes[depth], CODES >> depth) - own, 0)
        out[depth] = out[depth + 1] + np.log2((below + 0.4) / (above + 0.8))
    return out


def log2_codes(codes: np.ndarray, train: np.ndarray, orders: list[Context], nodes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """log2-probability of each token's code, and the training count of the token before it.

    Tokens are taken in order, a step at a time: a step is predicted, then the weights and the table learn from
    its training tokens.
    """
    # One place more, for what is no token.
    kind = np.result_type(*(own.kind for own in orders))
    above, below = [np.zeros(len(codes) + 1, kind) for _ in orders], np.zeros(len(codes) + 1, kind)
    for own, out in zip(orders, above, strict=True):
        own.visits(0, out)
    above = [x[:-1] for x in above]
    count, rest = above[0] + train, [rest_of_code(nodes, own) for own in (0, 1)]
    total, alive, own, is_train = np.zeros(len(codes), np.float32), np.arange(len(codes), dtype=np.int32), codes, train
    for depth in range(CODE_BITS + 1):
        going = np.logical_or.reduce([x > 0 for x in above])
        out = np.flatnonzero(~going)
        total[alive[out]] += np.where(is_train[out] > 0, rest[1][depth, own[out]], rest[0][depth, own[out]])
        alive, own, is_train, above = alive[going], own[going], is_train[going], [above.pop(0)[going] for _ in orders]
        if depth == CODE_BITS or not len(alive):
            break
        reached = []
        for context in orders:
            context.visits(depth + 1, below)
            reached.append(below[alive])
        mixer, low, step = Mixer(), 0, FIRST_STEP
        while low < len(alive):
            part = slice(low, low + step)
            bit, known = own[part] >> (CODE_BITS - 1 - depth), is_train[part]
            counted = [(nodes[depth][bit >> 1] - known, nodes[depth + 1][bit] - known), *((x[part], y[part]) for x, y in zip(above, reached, strict=True))]
            total[alive[part]] += mixer.step(counted, bit & 1, known)
            low, step = low + step, min(LAST_STEP, step + step // 4)
        above = reached
    return total, count


class Mixer:
    """Weights by gate and refined probabilities by level for one bit of the code."""

    def __init__(self) -> None:
        self.weights = np.full((ORDERS + 1, 1 << ORDERS), 0.4, np.float32)
        levels = np.linspace(-REACH, REACH, LEVELS)
        self.ones, self.visits = 4 / (1 + np.exp(-levels)), np.full(LEVELS, 4.0)

    def step(self, counted: list[tuple[np.ndarray, np.ndarray]], bit: np.ndarray, train: np.ndarray) -> np.ndarray:
        """log2-probability of each bit, given the (visits of the node, of those with this bit) for every context; then learn."""
        n, small = len(bit), np.float32(0.4)
        inputs, gate, learns, is_one = np.empty((ORDERS + 1, n), np.float32), np.zeros(n, np.int64), train.astype(np.float32), bit.astype(np.float32)
        for i, (every, same) in enumerate(counted):
            # Nothing seen gives 0.
            other = np.maximum(every - same, 0).astype(np.float32)
            np.log((same.astype(np.float32) + small) / (other + small), out=inputs[i])
            if i:
                gate |= (every > 0).astype(np.int64) << (i - 1)
        inputs *= 2 * is_one - 1
        mixed = (inputs * self.weights.take(gate, axis=1)).sum(axis=0)
        np.clip(mixed, np.float32(-REACH), np.float32(REACH), out=mixed)
        level = np.rint((mixed + np.float32(REACH)) * np.float32((LEVELS - 1) / (2 * REACH))).astype(np.int64)
        p = 1 / (1 + np.exp(-mixed))
        refined = (self.ones / self.visits).astype(np.float32).take(level)
        out = np.log(np.abs(1 - is_one - (p + refined) / 2)) * np.float32(1 / np.log(2))
        self.ones += np.bincount(level, weights=is_one * learns, minlength=LEVELS)
        self.visits += np.bincount(level, weights=learns, minlength=LEVELS)
        which = np.eye(1 << ORDERS, dtype=np.float32).take(gate, axis=0)
        slope = (inputs * ((is_one - p) * learns)) @ which
        # The loss bends by a quarter of the squared inputs at most, so this step never overshoots.
        bend = (np.einsum("ij,ij->j", inputs, inputs) * learns) @ which
        self.weights += slope / (bend / 4 + 8)
        return out


def as_bytes(values: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]


def as_numbers(part: np.ndarray) -> np.ndarray:
    out = np.zeros((len(part), 8), np.uint8)
    out[:, : part.shape[1]] = part
    return out.view("<i8").ravel()


def cut_by(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, first, last) of the runs of equal keys."""
    edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return list(zip(keys[edges].tolist(), edges.tolist(), [*edges[1:].tolist(), len(keys)], strict=True))


DEALT = "fragment int, nodes binary, runs binary, tokens binary"
FOLLOWERS = ("kind", "context", "codes", "counts")


def dealt(docs: DataFrame, fragments: int, model) -> DataFrame:
    """Every token dealt by context; runs hold the number of a row's tokens, doubled, and whether it is training."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, arc = model.value["hot"], model.value["arcs"]
        for batch in batches:
            node, train = np.asarray(batch.column(1)), np.asarray(batch.column(2).cast(pa.int8())).astype(np.int64)
            for low, tokens, bounds in token_slices(batch.column(0)):
                last, found = contexts(tokens, bounds)
                row = np.repeat(np.arange(low, low + len(bounds) - 1), np.diff(bounds))
                route = ts.mix(node[row].view(np.uint64))
                whole = np.append(END, tokens[:-1])
                whole[bounds[:-1]] = END
                for known, x, by in zip(hot[::-1], found[::-1], [found[2], found[1], whole], strict=True):
                    route = np.where(places(known, x) < 0, by, route)
                # The upper 24 bits choose the fragment, of all or of those of the hot token before; the 40 lower ones of that token travel.
                at = places(hot[0], found[0])
                first, spread = (np.append(x, y).astype(np.uint64)[at] for x, y in zip(arc, (0, fragments), strict=True))
                key = (((route >> np.uint64(40)) * spread >> np.uint64(24)) + first) % np.uint64(fragments)
                key = key.astype(np.uint32 if fragments > CODES else np.uint16)
                order = np.argsort(key, kind="stable")
                key, row = key[order], row[order]
                body = np.concatenate([as_bytes(x[order], width) for x, width in zip((*last, tokens), WIDTHS, strict=True)], axis=1)
                out: list[tuple] = []
                for fragment, first, end in cut_by(key):
                    runs = cut_by(row[first:end])
                    owner = np.array([x[0] for x in runs])
                    counts = np.array([x[2] - x[1] for x in runs]) * 2 + train[owner]
                    out.append((fragment, node[owner].tobytes(), counts.astype("<u4").tobytes(), body[first:end].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], names=["fragment", "nodes", "runs", "tokens"])

    return docs.select("text", "node", "train").mapInArrow(scan, DEALT)


SUMS = {"nodes": "<i8", "tokens": "<u4", "known": "<u4", "base": "<f8", "logs": "<f4"}


def fragment_sums(docs: DataFrame, fragments: int, model, hot_counts: DataFrame) -> DataFrame:
    """Partial sums of each row by fragment, dealt by row (bucket and, packed, SUMS), and each fragment's number of types that are not hot."""
    columns = ", ".join(f"{name} binary" for name in SUMS)

    def mix(group: pa.Table) -> pa.Table:
        m = model.value
        known: list[list] = [[] for _ in range(ORDERS)]
        for order, *own in zip(*(group.column(name) for name in FOLLOWERS), strict=True):
            if order.is_valid:
                known[order.as_py()].append((np.int64(own[0].as_py()).view(np.uint64), np.frombuffer(own[1].as_buffer(), "<u2"), np.frombuffer(own[2].as_buffer(), "<i8")))
        nodes, runs = (np.frombuffer(b"".join(x.as_py() for x in group.column(name) if x.is_valid), dtype=kind) for name, kind in (("nodes", "<i8"), ("runs", "<u4")))
        body = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x.as_buffer(), np.uint8) for x in group.column("tokens") if x.is_valid)]).reshape(-1, sum(WIDTHS))
        counts = (runs >> 1).astype(np.int64)
        # The same order whoever sends first.
        order, begins = np.argsort(nodes, kind="stable"), np.cumsum(counts) - counts
        nodes, counts = nodes[order], counts[order]
        owner = np.repeat(np.arange(len(nodes), dtype=np.int32), counts)
        take = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts - begins[order], counts)
        body, train = body[take], (runs[order] & 1).astype(np.int8)[owner]
        del take, owner
        cuts = np.append(0, np.cumsum(WIDTHS))
        *last, codes = (body[:, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        codes, last = as_numbers(codes).astype(np.int32), (as_numbers(x).view(np.uint64) for x in last)
        # An order at a time, so that only one has its keys.
        orders = [Context(x, codes, train, *own) for x, *own in zip(longer(last), m["hot"], known, strict=True)]
        del last, body
        each, c = log2_codes(codes, train, orders, m["nodes"])
        types = orders[0].types
        n_of_code = m["nodes"][CODE_BITS][codes] - train
        # Of a code's tokens, a seen one follows its count; all others together count once.
        each = each * np.log10(2) + np.log10(np.maximum(c - train, 1)) - np.log10(n_of_code + 1)
        owner = np.repeat(np.arange(len(nodes), dtype=np.int32), counts)
        found = {
            "nodes": nodes,
            "tokens": counts,
            "known": np.bincount(owner, weights=c > 0, minlength=len(nodes)),
            "base": np.bincount(owner, weights=np.log10(c + 1), minlength=len(nodes)),
            "logs": np.bincount(owner, weights=each, minlength=len(nodes)),
        }
        # Repeated rows send the same sums; one of them is enough.
        _, once = np.unique(nodes, return_index=True)
        bucket = nodes[once] & (m["buckets"] - 1)
        once, bucket = once[np.argsort(bucket, kind="stable")], np.sort(bucket)
        parts = cut_by(bucket)
        packed = {name: [found[name][once[a:b]].astype(kind).tobytes() for _, a, b in parts] for name, kind in SUMS.items()}
        return pa.table({"bucket": pa.array([*(x[0] for x in parts), None], pa.int32()), **{name: pa.array([*x, None], pa.binary()) for name, x in packed.items()}, "types": pa.array([0] * len(parts) + [types], pa.int64())})

    return dealt(docs, fragments, model).unionByName(hot_counts, allowMissingColumns=True).groupBy("fragment").applyInArrow(mix, f"bucket int, {columns}, types long")


def row_sums(sums: DataFrame) -> DataFrame:
    """node, n_tokens, n_known, base and logs of each row, its partial sums added up."""

    def add(group: pa.Table) -> pa.Table:
        own = {name: np.frombuffer(b"".join(group.column(name).to_pylist()), dtype=kind) for name, kind in SUMS.items()}
        found, which = np.unique(own["nodes"], return_inverse=True)
        total = {name: np.bincount(which, weights=own[name]) for name in list(SUMS)[1:]}
        return pa.table({"node": found, "n_tokens": total["tokens"].astype(np.int64), "n_known": total["known"].astype(np.int64), "base": total["base"], "logs": total["logs"]})

    return sums.filter("bucket IS NOT NULL").select("bucket", *SUMS).groupBy("bucket").applyInArrow(add, "node long, n_tokens long, n_known long, base double, logs double")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row."""
    spark = docs.sparkSession
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"), (~held_out).alias("train"), F.xxhash64("doc_id", "text").alias("node"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = int(max(4, -(-size // FRAGMENT_BYTES)))
    counted = candidate_counts(rows)
    base_counts, hot, counts = hot_counts(rows, counted)
    nodes, arc = tree(base_counts), arcs(counted, hot[0], fragments)
    model = spark.sparkContext.broadcast({"hot": hot, "arcs": arc, "nodes": nodes, "buckets": 1 << fragments.bit_length()})
    sums = materialize(fragment_sums(rows, fragments, model, followers(counted, hot, *arc, fragments)), "sums")
    n, v = int(nodes[0][0]), int((counts[0].sum(axis=1) > 0).sum()) + (sums.agg(F.sum("types")).first()[0] or 0)
    scored = rows.select("doc_id", "node", "held_out", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n_bytes"))
    return scored.join(row_sums(sums), "node").select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        F.col("logs").alias("score"),
        F.when(F.col("n_bytes") > 0, -F.col("logs") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
