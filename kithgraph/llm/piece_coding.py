"""Encoding into the pieces of a SentencePiece vocabulary, and decoding.

A segmentation is what byte-pair merging gives exactly if every two neighbouring pieces are: merging the two
pieces' text alone gives these two back. So encoding is a max-plus path problem over pieces, in which a pair
of neighbours weighs 0 if it is stable and minus infinity if not, and one path has weight 0. Giant documents
are cut into chunks of fixed length that are dealt over the cluster. The states of a boundary are the pieces
that may cover it. A chunk yields its boundary-state transfer matrix, the best weight from each state at its
begin to each state at its end. Matrices combine associatively: a tree of Spark groupings multiplies ``FAN``
neighbours at a time up to one matrix a document, and hands the two states of each product down again to its
factors, so no task holds a document's chunks. Each chunk is then backtraced on its own. Pieces hold no blank
after another character and no line end, so within a chunk the path falls into short runs. A short run's path
is what merging it gives, and all new runs of a batch are merged side by side; a long one is solved piece by
piece. Characters outside the vocabulary become their UTF-8 byte pieces.

Defined results: null and empty texts have no pieces; null doc_id is kept; repeated rows are coded alike; an
empty table gives no rows; extra columns are ignored. Decoding restores the text, except that the blank
marker itself becomes a blank.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm.common import document_rows, materialize, table

BLANK = "▁"
CHUNK = 16384
#: Neighbouring matrices that one grouping multiplies.
FAN = 64
RUNS = re.compile("▁+[^▁\n]*|[^▁\n]+|\n")
#: Places that every path passes: before a blank that follows another character, and before a line end.
PASSED = re.compile("(?<=[^▁])▁|\n")
NEVER = -(1 << 60)
#: Runs that a worker keeps in each of two generations, and pairs of pieces.
KEPT_RUNS, KEPT_PAIRS = 150_000, 200_000
#: Longer runs are solved piece by piece and not kept.
SHORT_RUN = 64
NO_MERGE = 1 << 30
_models: dict[str, Model] = {}


def packed_ids(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


def id_lists(rows: list[bytes]) -> pa.ListArray:
    offsets = np.cumsum([0, *(len(x) // 4 for x in rows)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(rows), dtype="<i4")))


class Model:
    """Pieces with their merge ranks, and the paths of runs and stable pairs seen so far."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes, self.spelled, self.ids, self.ranks = {}, [], {}, {}
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            special = lib.is_control(i) or lib.is_unknown(i)
            self.spelled.append(b"" if special else bytes([int(piece[3:5], 16)]) if lib.is_byte(i) else piece.replace(BLANK, " ").encode())
            if lib.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not special:
                self.ids[piece], self.ranks[piece] = i, -lib.get_score(i)
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in self.ids):
            raise ValueError("pieces with a blank or line end inside would change how runs are cut")
        self.reach = max(map(len, self.ids))
        self.pairs: dict[int, bool] = {}
        # Pieces that merging their own text reaches; id 0 stands for the begin and for unknown characters.
        self.whole_pieces = {p: i for p, i in self.ids.items() if len(p) == 1 or self.merged(p) == [p]}
        self.pieces = {i: p for p, i in self.whole_pieces.items()}
        self.of_point = np.zeros(max(ord(p) for p in self.ids if len(p) == 1) + 2, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.of_point[ord(p)] = i
        self.tables = self.merge_tables()
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """A short text after all merges, best rank and leftmost first."""
        never, ranks, parts = float("inf"), self.ranks, list(text)
        waits = [ranks.get(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
        while waits and (best := min(waits)) < never:
            i = waits.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del waits[i]
            if i:
                waits[i - 1] = ranks.get(parts[i - 1] + parts[i], never)
            if i < len(waits):
                waits[i] = ranks.get(parts[i] + parts[i + 1], never)
        return parts

    def is_piece(self, text: str) -> bool:
        """Whether text is one character or a piece that merging reaches."""
        return len(text) == 1 or text in self.whole_pieces

    def stable(self, a: str, b: str) -> bool:
        return self.stable_ids(self.whole_pieces.get(a, 0), self.whole_pieces.get(b, 0))

    def stable_ids(self, a: int, b: int) -> bool:
        """Whether two pieces may stand side by side; no merge crosses an unknown character."""
        if not a or not b:
            return True
        found = self.pairs.get(a << 32 | b)
        if found is None:
            if len(self.pairs) > KEPT_PAIRS:
                self.pairs.clear()
            left, right = self.pieces[a], self.pieces[b]
            found = self.pairs[a << 32 | b] = self.merged(left + right) == [left, right]
        return found

    def paths(self, text: str, before: str, last_start: int) -> list[dict[str, str]]:
        """For each place the pieces that can end there (and the piece before each), after ``before``."""
        found: list[dict[str, str]] = [{before: ""}] + [{} for _ in text]
        for i in range(min(len(text), last_start)):
            if found[i]:
                for j in range(i + 1, min(len(text), i + self.reach) + 1):
                    piece = text[i:j]
                    if self.is_piece(piece):
                        for own in found[i]:
                            if self.stable(own, piece):
                                found[j][piece] = own
                                break
        return found

    def back(self, found: list[dict[str, str]], end: int, piece: str) -> list[int]:
        """Ids of the path to a piece that ends at a place."""
        out: list[int] = []
        while end > 0:
            out += [self.ids[piece]] if piece in self.ids else [self.bytes[b] for b in reversed(piece.encode())]
            end, piece = end - len(piece), found[end][piece]
        return out[::-1]

    def long_run(self, text: str) -> bytes:
        """Ids of a run, 4 bytes each; from its begin, one piece can end at each place."""
        n, ids, begins = len(text), [0], [0]
        known, reach = self.whole_pieces.get, self.reach
        for j in range(1, n + 1):
            for i in range(max(0, j - reach), j):
                own = known(text[i:j], 0)
                if (own or j - i == 1) and self.stable_ids(ids[i], own):
                    break
            ids.append(own)
            begins.append(i)
        out: list[int] = []
        while n:
            out += [ids[n]] if ids[n] else [self.bytes[b] for b in reversed(text[begins[n] : n].encode())]
            n = begins[n]
        return packed_ids(out[::-1])

    def merge_pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair of ids, NO_MERGE where there is none; nested hash tables of pairs."""
        keys = (left << 15 | right).astype(np.int32)
        rank, whole = np.full(len(keys), NO_MERGE, np.int64), np.zeros(len(keys), np.int64)
        for known, ranks, wholes in self.tables:
            at = slot(keys, len(known))
            hit = np.flatnonzero(known[at] == keys)
            rank[hit], whole[hit] = ranks[at[hit]], wholes[at[hit]]
        return rank, whole

    def merge_tables(self) -> list[tuple[np.ndarray, ...]]:
        """Tables of all mergeable pairs; what finds its slot taken goes to the next, smaller one."""
        if max(self.ids.values()) >= 1 << 15:
            raise ValueError("a pair of ids has 30 bits here")
        found = [(self.ids[p[:i]] << 15 | self.ids[p[i:]], self.ranks[p], self.ids[p]) for p in self.ids for i in range(1, len(p)) if p[:i] in self.ids and p[i:] in self.ids]
        keys, ranks, wholes = (np.array(x, dtype=np.int32) for x in zip(*found, strict=True))
        tables = []
        while len(keys):
            size = 1 << (4 * len(keys)).bit_length()
            known, own_ranks, own_wholes = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32)
            at = slot(keys, size)
            _, first = np.unique(at, return_index=True)
            known[at[first]], own_ranks[at[first]], own_wholes[at[first]] = keys[first], ranks[first], wholes[first]
            tables.append((known, own_ranks, own_wholes))
            left = np.setdiff1d(np.arange(len(keys)), first)
            keys, ranks, wholes = keys[left], ranks[left], wholes[left]
        return tables

    def short_runs(self, runs: list[str]) -> list[bytes]:
        """Ids of each run, 4 bytes each: in every round each run takes its best merge, the leftmost of equals."""
        if not runs:
            return []
        lengths = np.fromiter(map(len, runs), np.int64, len(runs))
        points = np.frombuffer("".join(runs).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        ids, owner = self.of_point[np.minimum(points, len(self.of_point) - 1)].astype(np.int64), np.repeat(np.arange(len(runs)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        places = np.arange(len(ids))
        while len(ids):
            rank, whole = self.merge_pairs(ids[:-1], ids[1:])
            rank[owner[1:] != owner[:-1]] = NO_MERGE
            rank, whole = np.append(rank, NO_MERGE), np.append(whole, 0)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), first)
            going = best >> 32 < NO_MERGE
            at = (best & 0xFFFFFFFF)[going]
            ids[at] = whole[at]
            stays = np.ones(len(ids), dtype=bool)
            stays[at + 1] = False
            goes = np.repeat(going, np.diff(np.append(first, len(ids))))
            done.append((places[~goes], ids[~goes]))
            stays &= goes
            ids, owner, places = ids[stays], owner[stays], places[stays]
        place, found = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place, kind="stable")
        place, found = place[order], found[order]
        begins = np.append(0, np.cumsum(lengths))
        bounds = np.searchsorted(place, begins)
        body, cuts = found.astype("<i4").tobytes(), (bounds * 4).tolist()
        out = [body[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        # Characters outside the vocabulary.
        for run in set(np.searchsorted(bounds, np.flatnonzero(found == 0), side="right").tolist()):
            own = [(int(x), runs[run - 1][p - begins[run - 1]]) for x, p in zip(found[bounds[run - 1] : bounds[run]], place[bounds[run - 1] : bounds[run]], strict=True)]
            out[run - 1] = packed_ids([i for x, char in own for i in ([x] if x else [self.bytes[b] for b in char.encode()])])
        return out

    def wholes(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, 4 bytes each."""
        runs = [RUNS.findall(text) for text in texts]
        kept, older, new = self.kept, self.older, {}
        for own in runs:
            for run in own:
                if run not in kept:
                    new[run] = older.get(run)
        missing = [run for run, ids in new.items() if ids is None and len(run) < SHORT_RUN]
        new.update(zip(missing, self.short_runs(missing), strict=True))
        for run, ids in new.items():
            kept[run] = self.long_run(run) if ids is None else ids
        out = [b"".join([kept[run] for run in own]) for own in runs]
        for run in new:
            if len(run) >= SHORT_RUN:
                del kept[run]
        if len(kept) > KEPT_RUNS:
            self.kept, self.older = {}, kept
        return out

    def whole(self, text: str) -> bytes:
        return self.wholes([text])[0]

    def states(self, left: str, right: str) -> list[tuple[str, int]]:
        """Pieces that may cover or end at a boundary, and how far each reaches beyond it."""
        found = []
        for back in range(1, min(self.reach, len(left)) + 1):
            for beyond in range(min(self.reach - back, len(right)) + 1):
                piece = left[len(left) - back :] + right[:beyond]
                if self.is_piece(piece):
                    found.append((piece, beyond))
        return found

    def cuts(self, text: str, n: int) -> tuple[int, int]:
        """First and last place in text[:n] that every path passes; (n, n) if there is none."""
        found = PASSED.search(text, 0, n)
        if not found:
            return n, n
        blank = text.rfind(BLANK, 0, n)
        while blank > 0 and text[blank - 1] == BLANK:
            blank -= 1
        return found.start(), max(blank, text.rfind("\n", 0, n), found.start())

    def ends(self, left: str, body: str, n: int) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
        """States at both boundaries of a chunk; the first chunk begins in a state of its own."""
        return self.states(left, body) if left else [("", 0)], self.states(body[:n], body[n:])

    def transfer(self, left: str, body: str, n: int) -> np.ndarray:
        """The matrix of the chunk body[:n]; left is the text before it, body[n:] what follows."""
        into, out = self.ends(left, body, n)
        matrix = np.full((len(into), len(out)), NEVER, dtype=np.int64)
        first, last = self.cuts(body, n)
        tail = self.paths(body[last:], "", n - last) if first < n else []
        for i, (piece, begin) in enumerate(into):
            if begin > first:
                continue
            head = self.paths(body[begin : first if first < n else len(body)], piece, first - begin)
            for j, (own, beyond) in enumerate(out):
                if first < n:
                    ok = bool(head[-1]) and own in tail[n + beyond - last]
                else:
                    ok = n + beyond >= begin and own in head[n + beyond - begin]
                matrix[i, j] = 0 if ok else NEVER
        return matrix

    def between(self, left: str, body: str, n: int, begin_state: int, end_state: int) -> bytes:
        """The ids of the chunk's pieces that follow its begin state, up to its end state's piece."""
        into, out = self.ends(left, body, n)
        (piece, begin), (own, beyond) = into[begin_state], out[end_state]
        first, last = self.cuts(body, n)
        if first == n:
            return packed_ids(self.back(self.paths(body[begin:], piece, n - begin), n + beyond - begin, own))
        head = self.paths(body[begin:first], piece, first - begin)
        tail = self.paths(body[last:], "", n - last)
        return packed_ids(self.back(head, first - begin, next(iter(head[-1])))) + self.whole(body[first:last]) + packed_ids(self.back(tail, n + beyond - last, own))

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.spelled[i] for i in ids])[1:].decode("utf-8", "replace")


def slot(keys: np.ndarray, size: int) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def model_of(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of transfer matrices."""
    return np.maximum((a[:, :, None] + b[None]).max(axis=1), NEVER)


def inner_states(matrices: list[np.ndarray], begin: int, end: int) -> list[int]:
    """The state of each boundary on the path of greatest weight from a state before to one after all matrices."""
    forward = [matrices[0][begin]]
    for m in matrices[1:]:
        forward.append(combined(forward[-1][None], m)[0])
    states = [end]
    for m, before in zip(matrices[:0:-1], forward[-2::-1], strict=True):
        states.append(int((before + m[:, states[-1]]).argmax()))
    return [begin, *states[::-1]]


def chunks_of(text: str, chunk: int, reach: int) -> list[tuple[str, str, int]]:
    """(text before, text from the chunk's begin to ``reach`` beyond its end, length); none shorter than reach but a whole text."""
    if chunk < reach:
        raise ValueError(f"a chunk has at least {reach} characters")
    at = list(range(0, max(1, len(text) - reach), chunk))
    return [(text[max(0, i - reach) : i], text[i : j + reach], j - i) for i, j in zip(at, [*at[1:], len(text)], strict=True)]


def marked(text: str | None) -> str:
    return BLANK + text.replace(" ", BLANK) if text else ""


def encode(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text_key, ids of every row of docs (doc_id, text, text_key)."""

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for b in batches:
            for low in range(0, b.num_rows, 500):
                part = b.slice(low, 500)
                ids = model.wholes([marked(t.as_py()) for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), id_lists(ids)], names=["doc_id", "text_key", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = model_of(path).reach
        for b in batches:
            for text, key, size in zip(b.column(0), b.column(1), b.column(2), strict=True):
                parts = chunks_of(marked(text.as_py()), chunk, reach)
                own = [pa.array([key.as_py()] * len(parts), pa.int64()), pa.array([size.as_py()] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32())]
                more = [pa.array([x[k] for x in parts], t) for k, t in ((2, pa.int32()), (1, pa.string()), (0, pa.string()))]
                yield pa.RecordBatch.from_arrays([*own, *more], names=["text_key", "size", "chunk", "n", "body", "left"])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for b in batches:
            found = [model.transfer(x.as_py(), t.as_py(), n.as_py()) for x, t, n in zip(b.column(5), b.column(4), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([len(m) for m in found], pa.int32()), pa.array([m.tobytes() for m in found], pa.binary())], names=["text_key", "size", "chunk", "side", "matrix"])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for b in batches:
            ids = [model.between(*(x.as_py() for x in row)) for row in zip(*b.columns[3:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(ids, pa.binary())], names=["text_key", "size", "chunk", "ids"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                one = b.slice(row, 1)
                yield pa.RecordBatch.from_arrays([*one.columns[:2], id_lists([b"".join(one.column(2)[0].as_py())])], names=["doc_id", "text_key", "ids"])

    size = F.length("text")
    giant = F.coalesce(size >= chunk, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "text_key")
    plain = rows.filter(~giant).mapInArrow(short, "doc_id long, text_key long, ids array<int>")
    # A giant text is coded once and its pieces are handed to each row that holds it.
    large = rows.filter(giant).select("text", "text_key", size.alias("size")).dropDuplicates(["text_key", "size"])
    chunks = materialize(large.mapInArrow(cut, "text_key long, size int, chunk int, n int, body string, left string"), "chunks")
    states = chunk_states(materialize(chunks.mapInArrow(matrices, MATRIX), "matrices"))
    traced = chunks.join(states, ["text_key", "size", "chunk"]).select("text_key", "size", "chunk", "left", "body", "n", "begin", "beyond")
    traced = traced.mapInArrow(trace, "text_key long, size int, chunk int, ids binary")
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])
    gathered = traced.groupBy("text_key", "size").agg(in_order.alias("parts"))
    copies = rows.filter(giant).select("doc_id", "text_key", size.alias("size")).join(gathered, ["text_key", "size"])
    return plain.unionByName(copies.select("doc_id", "text_key", "parts").mapInArrow(joined, "doc_id long, text_key long, ids array<int>"))


MATRIX = "text_key long, size int, chunk int, side int, matrix binary"
GROUP = ["text_key", "size", "above"]


def matrix_of(row: dict) -> np.ndarray:
    return np.frombuffer(row["matrix"], dtype=np.int64).reshape(row["side"], -1)


def chunk_states(lowest: DataFrame) -> DataFrame:
    """text_key, size, chunk, begin, beyond: the states of each chunk's two boundaries, by a tree over ``lowest``."""

    def multiply(group: pa.Table) -> pa.Table:
        parts = group.sort_by("chunk").to_pylist()
        product = matrix_of(parts[0])
        for x in parts[1:]:
            product = combined(product, matrix_of(x))
        one = group.slice(0, 1)
        return pa.table({"text_key": one["text_key"], "size": one["size"], "chunk": one["above"], "side": pa.array([len(product)], pa.int32()), "matrix": pa.array([product.tobytes()], pa.binary())})

    def hand_down(group: pa.Table) -> pa.Table:
        group = group.sort_by("chunk")
        parts = group.to_pylist()
        states = inner_states([matrix_of(x) for x in parts], parts[0]["begin"], parts[0]["beyond"])
        return group.select(["text_key", "size", "chunk"]).append_column("begin", pa.array(states[:-1], pa.int32())).append_column("beyond", pa.array(states[1:], pa.int32()))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last = [int(matrix_of(x)[0].argmax()) for x in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([0] * b.num_rows, pa.int32()), pa.array(last, pa.int32())], names=["text_key", "size", "chunk", "begin", "beyond"])

    state = "text_key long, size int, chunk int, begin int, beyond int"
    above = F.expr(f"chunk div {FAN}").cast("int").alias("above")
    levels, widest = [lowest], lowest.agg(F.max("chunk")).first()[0] or 0
    while widest:
        levels.append(materialize(levels[-1].select("*", above).groupBy(*GROUP).applyInArrow(multiply, MATRIX), "products"))
        widest //= FAN
    states = levels[-1].mapInArrow(ends, state)
    for level in levels[-2::-1]:
        given = states.withColumnRenamed("chunk", "above")
        states = level.select("*", above).join(given, GROUP).groupBy(*GROUP).applyInArrow(hand_down, state)
    return states


def decode(coded: DataFrame, path: str) -> DataFrame:
    """coded (doc_id, text_key, ids) with the decoded text and the checksum of the ids."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for b in batches:
            for low in range(0, b.num_rows, 500):
                part = b.slice(low, 500)
                flat, bounds = np.asarray(part.column(2).flatten()), np.append(0, np.cumsum(part.column(2).value_lengths().to_numpy(zero_copy_only=False)))
                ids = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                text = pa.array([model.decode(x.tolist()) for x in ids], pa.string())
                crc = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, text, crc], names=["doc_id", "text_key", "ids", "decoded", "ids_crc32"])

    return coded.mapInArrow(spell, "doc_id long, text_key long, ids array<int>, decoded string, ids_crc32 long")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = decode(encode(document_rows(table(spark, sf_dir, "documents")), path), path)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids_crc32", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), (F.xxhash64("decoded") == F.col("text_key")).alias("restored"))
